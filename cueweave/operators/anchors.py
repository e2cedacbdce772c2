"""Anchor pairs between two tracks and the offsets they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.keywords import folded_keywords, numbers
from cueweave.operators.matching import signature_pairs
from cueweave.operators.similarity_join import anchor_similarity, similarity_align, similarity_sample
from cueweave.operators.token_matching import match_by_tokens
from cueweave.plans.lineage import cut_lineage


def with_keywords(cues: DataFrame) -> DataFrame:
    return cues.select("media_id", "cue_idx", "start_ms", folded_keywords(F.col("text")).alias("tokens"))


def with_numbers(cues: DataFrame) -> DataFrame:
    return cues.select("media_id", "cue_idx", "start_ms", numbers(F.col("text")).alias("tokens"))


def keyword_pairs(src: DataFrame, ref: DataFrame) -> DataFrame:
    """Distinct keyword sets of both tracks that share a keyword, with their cue counts."""
    return signature_pairs(with_keywords(src), with_keywords(ref))


def number_pairs(src: DataFrame, ref: DataFrame) -> DataFrame:
    return signature_pairs(with_numbers(src), with_numbers(ref))


def _token_anchors(src: DataFrame, ref: DataFrame, by_weight: bool, base: float, method: str) -> DataFrame:
    # Token extraction is the costly step and is read three times.
    src, ref = cut_lineage(src, "tokens"), cut_lineage(ref, "tokens")
    picks = match_by_tokens(src, ref, by_weight)
    left = src.select("media_id", F.col("cue_idx").alias("src_idx"), F.col("start_ms").alias("_s"), F.col("tokens").alias("_t1"))
    right = ref.select("media_id", F.col("cue_idx").alias("ref_idx"), F.col("start_ms").alias("_r"), F.col("tokens").alias("_t2"))
    return picks.join(left, ["media_id", "src_idx"]).join(right, ["media_id", "ref_idx"]).select(
        "media_id", "src_idx", "ref_idx", (F.col("_r") - F.col("_s")).alias("time_offset_ms"),
        F.least(F.lit(1.0), base + 0.2 * F.col("weight")).alias("confidence"), F.lit(method).alias("method"),
        F.array_intersect("_t1", "_t2").alias("keywords"),
    )


def keyword_anchors(src: DataFrame, ref: DataFrame) -> DataFrame:
    """Pairs by number of shared keywords, greedy; confidence 0.5 + 0.2 per keyword."""
    return _token_anchors(with_keywords(src), with_keywords(ref), True, 0.5, "keyword")


def number_anchors(src: DataFrame, ref: DataFrame) -> DataFrame:
    """Each source takes the free reference with most shared numbers; confidence 0.4 + 0.2 per number."""
    return _token_anchors(with_numbers(src), with_numbers(ref), False, 0.4, "number")


def sample_anchors(src: DataFrame, ref: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """Anchors by text similarity (of the ``media`` listed alone, if given).

    Only the sources are cut to these media: references meet samples by their media, and picks
    their times, so another join would move the texts again for nothing.
    """
    picks = similarity_sample(src if media is None else src.join(media, "media_id", "left_semi"), ref)
    left = src.select("media_id", F.col("cue_idx").alias("src_idx"), F.col("start_ms").alias("_s"))
    right = ref.select("media_id", F.col("cue_idx").alias("ref_idx"), F.col("start_ms").alias("_r"))
    return picks.join(left, ["media_id", "src_idx"]).join(right, ["media_id", "ref_idx"]).select(
        "media_id", "src_idx", "ref_idx", (F.col("_r") - F.col("_s")).alias("time_offset_ms"),
        "confidence", F.lit("similarity").alias("method"), F.array().cast("array<string>").alias("keywords"),
    )


def anchors_all(src: DataFrame, ref: DataFrame, same_language: DataFrame | None = None) -> DataFrame:
    """Keyword, number and (for media flagged ``same``) similarity anchors.

    A pair found by several strategies keeps the first one. ``same_language``
    is ``media_id, same``.
    """
    found = keyword_anchors(src, ref).withColumn("_p", F.lit(0)).unionByName(
        number_anchors(src, ref).withColumn("_p", F.lit(1))
    )
    if same_language is not None:
        # Telling the language moves the texts of both tracks; the samples and their anchors look at what it gives.
        same = cut_lineage(same_language.where("same").select("media_id"), "same")
        found = found.unionByName(sample_anchors(src, ref, same).withColumn("_p", F.lit(2)))
    rest = ["time_offset_ms", "confidence", "method", "keywords"]
    return found.groupBy("media_id", "src_idx", "ref_idx").agg(
        F.min_by(F.struct(*rest), "_p").alias("a")
    ).select("media_id", "src_idx", "ref_idx", *[f"a.{c}" for c in rest])


def best_anchor(anchors: DataFrame) -> DataFrame:
    """Highest confidence per media; ties go to the lowest source index, then strategy order."""
    rank = F.when(F.col("method") == "keyword", 0).when(F.col("method") == "number", 1).otherwise(2)
    order = F.struct((-F.col("confidence")).alias("c"), "src_idx", rank.alias("r"), "ref_idx")
    return anchors.groupBy("media_id").agg(
        F.min_by(F.struct("src_idx", "ref_idx", "confidence", "method"), order).alias("a")
    ).select("media_id", "a.*")


def _question(text: Column, words: tuple[str, ...], marks: tuple[str, ...], longer_than: int, strict: bool) -> Column:
    t = F.lower(F.trim(text))
    def any_of(parts):
        test = F.contains(t, F.lit(parts[0]))
        for p in parts[1:]:
            test = test | F.contains(t, F.lit(p))
        return test
    hit = any_of(words) & any_of(marks) if strict else any_of(words + marks)
    return (F.length(t) > longer_than) & hit


def first_dialogue(embedded: DataFrame, external: DataFrame, strict: bool = False, first: int | None = None) -> DataFrame:
    """First question-like cue of both tracks as an anchor.

    Within the ``first`` cues (five) at confidence 0.8; ``strict`` looks at
    three, wants a question word and a question mark, and gives 0.95.
    """
    k = first if first is not None else 3 if strict else 5
    # Question words and marks.
    en = ("who", "what") if strict else ("who", "what", "how", "why")
    zh = ("你", "什么") if strict else ("你", "什么", "怎么", "为什么")

    def earliest(cues: DataFrame, test: Column, side: str) -> DataFrame:
        return cues.where((F.col("cue_idx") < k) & test).groupBy("media_id").agg(
            F.min(F.struct(F.col("cue_idx"), F.col("start_ms"))).alias("f")
        ).select("media_id", F.col("f.cue_idx").alias(f"{side}_idx"), F.col("f.start_ms").alias(f"{side}_ms"))

    left = earliest(embedded, _question(F.col("text"), en, ("?",), 20, strict), "src")
    right = earliest(external, _question(F.col("text"), zh, ("?", "？"), 5, strict), "ref")
    return left.join(right, "media_id").select(
        "media_id", "src_idx", "ref_idx", (F.col("src_ms") - F.col("ref_ms")).alias("offset_ms"),
        F.lit(0.95 if strict else 0.8).alias("confidence"),
    )


def auto_align(src: DataFrame, ref: DataFrame, same_language: DataFrame | None = None, min_confidence: float = 0.6) -> DataFrame:
    """Anchors where a media has any; the similarity join only for media without.

    ``media_id, src_idx, ref_idx, confidence, method``.
    """
    cols = ["media_id", "src_idx", "ref_idx", "confidence", "method"]
    anchors = cut_lineage(anchors_all(src, ref, same_language).select(*cols), "anchors")
    done = anchors.select("media_id").distinct()
    rest = similarity_align(
        src.join(done, "media_id", "left_anti"), ref.join(done, "media_id", "left_anti"), min_confidence
    ).withColumn("method", F.lit("similarity_analysis"))
    return anchors.unionByName(rest.select(*cols))


def semantic_anchor(embedded: DataFrame, external: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """Anchor and offset of the external track per media, by the first strategy that succeeds.

    ``media_id, src_idx (embedded), ref_idx (external), offset_ms, confidence, method``
    with offset to be added to external times. Order: robust multi-anchor
    offset (confidence >= 0.5), optional translated anchors (``media_id,
    src_idx, ref_idx, confidence`` with src external, >= 0.7) with the strict
    dialogue rule behind them, first dialogue pair, similarity of the first cues.
    """
    from cueweave.operators.summary import robust_offset, same_language
    same = same_language(embedded, external)
    anchors = cut_lineage(anchors_all(embedded, external, same), "anchors")
    robust = robust_offset(anchors).where("confidence >= 0.5")
    cols = ["media_id", "src_idx", "ref_idx", "offset_ms", "confidence", "method"]
    out = best_anchor(anchors).drop("confidence", "method").join(robust, "media_id").select(
        "media_id", "src_idx", "ref_idx", (-F.col("median_ms")).alias("offset_ms"), "confidence", F.lit("multi_anchor").alias("method")
    )
    starts_e = embedded.select("media_id", F.col("cue_idx").alias("src_idx"), F.col("start_ms").alias("_e"))
    starts_x = external.select("media_id", F.col("cue_idx").alias("ref_idx"), F.col("start_ms").alias("_x"))

    def add(found: DataFrame, method: str) -> None:
        nonlocal out
        new = found.join(out.select("media_id"), "media_id", "left_anti")
        out = out.unionByName(new.withColumn("method", F.lit(method)).withColumn("offset_ms", F.col("offset_ms").cast("double")).select(*cols))

    def timed(pairs: DataFrame) -> DataFrame:
        return pairs.join(starts_e, ["media_id", "src_idx"]).join(starts_x, ["media_id", "ref_idx"]).withColumn(
            "offset_ms", F.col("_e") - F.col("_x")
        )

    if translated is not None:
        good = translated.where("confidence >= 0.7").select(
            "media_id", F.col("ref_idx").alias("src_idx"), F.col("src_idx").alias("ref_idx"), "confidence"
        )
        add(timed(good), "translation")
        add(first_dialogue(embedded, external, strict=True), "first_dialogue_strict")
    add(first_dialogue(embedded, external), "first_dialogue")
    out = cut_lineage(out, "anchor")
    last = anchor_similarity(
        embedded.join(out, "media_id", "left_anti"), external.join(out, "media_id", "left_anti")
    ).select("media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"), "confidence")
    add(timed(last), "similarity")
    return out
