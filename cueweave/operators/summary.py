"""Per-track and per-pair aggregates. All of them combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.language import detect_lang, is_chinese_track, is_english_track
from cueweave.functions.text import line_class, strip_ws
from cueweave.plans.lineage import cut_lineage


def track_summary(cues: DataFrame) -> DataFrame:
    """Count, first start, last end, span and end of the last cue in file order."""
    return cues.groupBy("media_id").agg(
        F.count("*").alias("n_cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"),
        (F.max("end_ms") - F.min("start_ms")).alias("span_ms"),
        F.max_by("end_ms", "cue_idx").alias("final_end_ms"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("shown_ms"),
    )


def zip_diff(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """``media_id, cue_idx, diff_ms``: start differences of the first ``k`` cues, position by position."""
    left = a.where(F.col("cue_idx") < k).select("media_id", "cue_idx", F.col("start_ms").alias("_a"))
    right = b.where(F.col("cue_idx") < k).select("media_id", "cue_idx", F.col("start_ms").alias("_b"))
    return left.join(right, ["media_id", "cue_idx"]).select(
        "media_id", "cue_idx", F.abs(F.col("_a") - F.col("_b")).alias("diff_ms")
    )


def timing_stats(diffs: DataFrame) -> DataFrame:
    """Average, maximum and mean of the best 80 % of at most ``k`` differences per media."""
    sorted_diffs = F.array_sort(F.collect_list("diff_ms"))
    per = diffs.groupBy("media_id").agg(sorted_diffs.alias("_d"))
    keep = F.expr("cast(floor(size(_d) * 8 / 10) as int)")
    core = F.when(keep > 0, F.slice("_d", 1, keep)).otherwise(F.col("_d"))

    def mean(c: Column) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(c)

    return per.select(
        "media_id", F.size("_d").alias("n"), mean(F.col("_d")).alias("avg_ms"),
        F.array_max("_d").alias("max_ms"), mean(core).alias("core_ms"),
    )


def sync_level(core: Column, longest: Column) -> Column:
    return (
        F.when((core < 500) & (longest < 2_000), "EXCELLENT")
        .when((core < 1_000) & (longest < 5_000), "GOOD")
        .when((core < 3_000) & (longest < 10_000), "MODERATE")
        .otherwise("POOR")
    )


def sync_ok(core: Column, longest: Column, threshold_ms: int = 1_000) -> Column:
    return (core < threshold_ms) & (longest < 3 * threshold_ms)


def misaligned(a: DataFrame, b: DataFrame, roles: DataFrame, threshold_ms: int = 5_000) -> DataFrame:
    """Per media of mixed sources: are the first five cues far apart?"""
    stats = zip_diff(a, b, 5).groupBy("media_id").agg(
        F.avg("diff_ms").alias("avg_ms"), F.max("diff_ms").alias("max_ms")
    )
    both = F.col("source1") == F.col("source2")
    mixed = ~(both & F.col("source1").isin("embedded", "external"))
    far = (F.col("avg_ms") > threshold_ms) | (F.col("max_ms") > threshold_ms * 1.5)
    return stats.join(roles, "media_id").select(
        "media_id", "avg_ms", "max_ms", (mixed & far).alias("misaligned")
    )


def robust_offset(anchors: DataFrame) -> DataFrame:
    """Median offset of ``media_id, time_offset_ms`` anchors and its consistency.

    Offsets are counted per distinct value before the medians, so a media with
    very many anchors ships its distinct offsets, not its anchors.
    """
    def median(value: str) -> Column:
        return F.percentile(value, 0.5, F.col("n"))

    counted = cut_lineage(anchors.groupBy("media_id", F.col("time_offset_ms").alias("o")).agg(F.count("*").alias("n")), "offsets")
    first = counted.groupBy("media_id").agg(median("o").alias("m0"), F.sum("n").alias("n_all"))
    near = F.abs(F.col("o") - F.col("m0")) < 5_000
    marked = counted.join(first, "media_id").withColumn("_in", near)
    some = marked.groupBy("media_id").agg(F.bool_or("_in").alias("_any"))
    kept = cut_lineage(marked.join(some, "media_id").where("n_all < 3 or _in or not _any"), "inliers")
    second = kept.groupBy("media_id").agg(median("o").alias("median_ms"), F.sum("n").alias("n_inliers"))
    spread = kept.join(second, "media_id").withColumn("d", F.abs(F.col("o") - F.col("median_ms")))
    mad = spread.groupBy("media_id", "median_ms", "n_inliers", "n_all").agg(median("d").alias("_mad"))
    mad_ms = F.when(F.col("n_inliers") >= 2, F.col("_mad")).otherwise(0.0)
    step = (
        F.when(mad_ms < 100, 1.0).when(mad_ms < 500, 0.9).when(mad_ms < 1_000, 0.7)
        .when(mad_ms < 2_000, 0.5).otherwise(0.3)
    )
    confidence = step * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n_inliers") / 3.0))
    return mad.select(
        "media_id", "median_ms", mad_ms.alias("mad_ms"), F.col("n_all").alias("n_anchors"), "n_inliers",
        confidence.alias("confidence"),
    )


def forced_track(a: DataFrame, b: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``first`` or ``second`` where one track has less than a tenth of the other's cues."""
    na = a.groupBy("media_id").agg(F.count("*").alias("n1"))
    nb = b.groupBy("media_id").agg(F.count("*").alias("n2"))
    return na.join(nb, "media_id").select(
        "media_id", "n1", "n2",
        F.when(F.col("n1") / F.col("n2") < threshold, "first")
        .when(F.col("n2") / F.col("n1") < threshold, "second").alias("forced"),
    )


def boundaries(cues: DataFrame) -> DataFrame:
    """Distinct start and end times: ``media_id, t``."""
    return cues.select("media_id", F.explode(F.array("start_ms", "end_ms")).alias("t")).distinct()


def preservation(original: DataFrame, merged: DataFrame, exact: bool = False) -> DataFrame:
    """Share of the original's timing that survives in the merged track.

    By boundary set (80 % passes), or with ``exact`` by equal cues at equal
    index (equal counts and 99 % pass).
    """
    if exact:
        left = original.select("media_id", "cue_idx", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.lit(1).alias("l"))
        right = merged.select("media_id", "cue_idx", F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"), F.lit(1).alias("r"))
        joined = left.join(right, ["media_id", "cue_idx"], "full")
        hit = F.count_if((F.col("s") == F.col("s2")) & (F.col("e") == F.col("e2")))
        agg = joined.groupBy("media_id").agg(F.count("l").alias("n_original"), F.count("r").alias("n_merged"), hit.alias("n_kept"))
        ratio = F.col("n_kept") / F.col("n_original")
        ok = (F.col("n_original") == F.col("n_merged")) & (ratio >= 0.99)
        return agg.where("n_original > 0").select("media_id", "n_original", "n_kept", ratio.alias("ratio"), ok.alias("preserved"))
    have = boundaries(merged).withColumn("_m", F.lit(1))
    joined = boundaries(original).join(have, ["media_id", "t"], "left")
    agg = joined.groupBy("media_id").agg(F.count("*").alias("n_original"), F.count("_m").alias("n_kept"))
    ratio = F.col("n_kept") / F.col("n_original")
    return agg.select("media_id", "n_original", "n_kept", ratio.alias("ratio"), (ratio >= 0.8).alias("preserved"))


def content_score(cues: DataFrame, first: int | None = None) -> DataFrame:
    """Dialogue, sign and forced indicators summed over the cues (or the ``first`` ones), and the resulting score."""
    t = strip_ws(F.col("text"))
    low = F.lower(t)
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))

    def any_of(col: Column, *parts: str) -> Column:
        test = F.contains(col, F.lit(parts[0]))
        for p in parts[1:]:
            test = test | F.contains(col, F.lit(p))
        return test

    def points(*rules: tuple[Column, int]) -> Column:
        total = F.lit(0)
        for rule, n in rules:
            total = total + F.when(rule, n).otherwise(0)
        return total

    # The marks and words of each rule, and its points.
    dialogue = points(
        (any_of(t, ".", ",", "!", "?"), 2), (any_of(low, "i", "you", "we", "they", "he", "she"), 1),
        (n_words > 5, 1), (any_of(t, '"', "'"), 2),
    )
    forced = points(
        (t.startswith("(") & t.endswith(")"), 3), (any_of(low, "speaking", "in ", "language"), 2),
        (n_words <= 4, 1), (any_of(low, "alien", "foreign", "untranslated"), 2),
    )
    upper = (t == F.upper(t)) & (low != t)
    signs = points(
        (upper & (F.length(t) > 3), 2), (any_of(t, "♪", "♫", "♬"), 3),
        (t.startswith("[") & t.endswith("]"), 2), ((n_words <= 2) & (F.length(t) < 15), 1),
    )
    head = cues if first is None else cues.where(F.col("cue_idx") < first)
    filled = t != ""
    per = head.groupBy("media_id").agg(
        F.count("*").alias("n"), F.sum(F.length(t)).alias("chars"),
        F.coalesce(F.sum(F.when(filled, dialogue)), F.lit(0)).alias("dialogue"),
        F.coalesce(F.sum(F.when(filled, signs)), F.lit(0)).alias("signs"),
        F.coalesce(F.sum(F.when(filled, forced)), F.lit(0)).alias("forced"),
    )
    net = (F.col("dialogue") / F.col("n") - F.col("signs") / F.col("n") - F.col("forced") / F.col("n") * 0.5) / 5.0
    score = (
        F.when(F.col("chars") == 0, 0.0).when(F.col("forced") / F.col("n") > 0.3, -0.8)
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net)))
    )
    return per.select("media_id", "n", "dialogue", "signs", "forced", score.alias("content_score"))


def is_bilingual(cues: DataFrame, first: int | None = None) -> DataFrame:
    """Does any cue (or any of the ``first`` ones) have a CJK line, and any a Latin line?"""
    lines = F.transform(F.split("text", "\n"), lambda x: line_class(strip_ws(x)))
    per = (cues if first is None else cues.where(F.col("cue_idx") < first)).select("media_id", lines.alias("k"))
    has = {k: F.coalesce(F.bool_or(F.array_contains("k", k)), F.lit(False)) for k in ("cjk", "latin")}
    return per.groupBy("media_id").agg(
        has["cjk"].alias("has_cjk"), has["latin"].alias("has_latin"), (has["cjk"] & has["latin"]).alias("bilingual")
    )


def sample_text(cues: DataFrame, k: int | None = 10) -> DataFrame:
    """``media_id, sample``: the texts of at most ``k`` given cues (None: of all) in order, joined by spaces."""
    pairs = F.array_sort(F.collect_list(F.struct("cue_idx", "text")))
    whole = F.transform(pairs, lambda p: p["text"])
    return cues.groupBy("media_id").agg(F.array_join(whole if k is None else F.slice(whole, 1, k), " ").alias("sample"))


def same_language(a: DataFrame, b: DataFrame, sampled: bool = True, k: int | None = 10) -> DataFrame:
    """Do samples of both tracks (evenly spread, or the first cues; ``k`` None: all cues) read as one known language?"""
    from cueweave.operators.timing import even_sample

    def lang(cues: DataFrame, out: str) -> DataFrame:
        head = cues if k is None else even_sample(cues, k) if sampled else cues.where(F.col("cue_idx") < k)
        return sample_text(head, k).select("media_id", detect_lang(F.col("sample")).alias(out))

    return lang(a, "lang_a").join(lang(b, "lang_b"), "media_id").select(
        "media_id", "lang_a", "lang_b", ((F.col("lang_a") == F.col("lang_b")) & (F.col("lang_a") != "unknown")).alias("same")
    )


def track_is_lang(cues: DataFrame, languages: DataFrame, first: int = 3) -> DataFrame:
    """Chinese / English flags from the tag or the ``first`` cues (``languages``: media_id, language)."""
    sample = sample_text(cues.where(F.col("cue_idx") < first), first)
    return languages.join(sample, "media_id", "left").select(
        "media_id", is_chinese_track(F.col("language"), F.col("sample")).alias("is_chinese"),
        is_english_track(F.col("language"), F.col("sample")).alias("is_english"),
    )


def merge_stats(merged: DataFrame) -> DataFrame:
    """Bilingual share and number of used overlay cues of a merged track (needs ``kind``)."""
    return merged.groupBy("media_id").agg(
        F.count("*").alias("n_merged"), F.count_if(F.col("kind") == "both").alias("n_both"),
        F.count_if(F.col("kind") == "first").alias("n_first"), F.count_if(F.col("kind") == "second").alias("n_second"),
        (F.count_if(F.contains("text", F.lit("\n"))) / F.count("*")).alias("bilingual_share"),
    )
