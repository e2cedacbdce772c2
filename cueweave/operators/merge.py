"""Merging two tracks into one bilingual track.

Every merge runs over all media at once. Tables: two cue tables (``media_id,
cue_idx, start_ms, end_ms, text`` and optionally ``style, raw``) and ``roles``
(``media_id, source1, source2, language1, language2``). The merged table is
``media_id, idx1, idx2, start_ms, end_ms, text, style, raw, kind`` where kind
says which side the cue came from (``both``, ``first``, ``second``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import combine_texts, is_dialogue_style
from cueweave.operators.joins import overlap_candidates, time_candidates
from cueweave.operators.matching import match_serial
from cueweave.operators.summary import misaligned, sync_level, timing_stats, zip_diff
from cueweave.operators.timing import anti_jitter, apply_offset
from cueweave.plans.lineage import cut_lineage
from cueweave.plans.ordered import number_rows
from cueweave.plans.ranges import near_pairs
from cueweave.sources import ass

MERGED = ["media_id", "idx1", "idx2", "start_ms", "end_ms", "text", "style", "raw", "kind"]
_HAN = r"[\x{4E00}-\x{9FFF}]"


def with_style(cues: DataFrame) -> DataFrame:
    for name in ("style", "raw"):
        if name not in cues.columns:
            cues = cues.withColumn(name, F.lit(None).cast("string"))
    return cues.select("media_id", "cue_idx", "start_ms", "end_ms", "text", "style", "raw")


def _alone(cues: DataFrame, kind: str) -> DataFrame:
    """Cues of one side that stay on their own."""
    none = F.lit(None).cast("int")
    idx = [F.col("cue_idx").alias("idx1"), none.alias("idx2")] if kind == "first" else [none.alias("idx1"), F.col("cue_idx").alias("idx2")]
    return cues.select("media_id", *idx, "start_ms", "end_ms", "text", "style", "raw", F.lit(kind).alias("kind"))


def _right(cues: DataFrame, *more: str) -> DataFrame:
    return cues.select(
        "media_id", F.col("cue_idx").alias("ref_idx"), F.col("start_ms").alias("_s"),
        F.col("end_ms").alias("_e"), F.col("text").alias("_t"), *[F.col(c).alias(c if c.startswith("_") else f"_{c}") for c in more],
    )


def merged_order(merged: DataFrame) -> DataFrame:
    """``seq`` from 1: by start, at equal starts pairs first, then leftovers of side 1, then of side 2."""
    rank = F.when(F.col("kind") == "both", 0).when(F.col("kind") == "first", 1).otherwise(2)
    ranked = merged.withColumn("_rank", rank).withColumn("_i", F.coalesce("idx1", "idx2")).withColumn(
        "_j", F.coalesce("idx2", "idx1")
    )
    out = number_rows(ranked, ["media_id"], "start_ms", ["_rank", "_i", "_j"], "_pos")
    return out.withColumn("seq", F.col("_pos") + 1).drop("_rank", "_i", "_j", "_pos")


def comprehensive_edges(a: DataFrame, b: DataFrame, min_score: float = 0.3) -> DataFrame:
    return overlap_candidates(a, b).where(F.col("score") > min_score).select(
        "media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"), "score", F.lit(0.0).alias("near")
    )


def merge_comprehensive(a: DataFrame, b: DataFrame, top: str = "first") -> DataFrame:
    """Keep every cue of both tracks; pairs overlapping by more than 30 % become one cue.

    Cues of side 1 in order take their best free overlap. A pair spans both
    cues; the side with Han characters (tested on side 1) goes first.
    """
    a, b = with_style(a), with_style(b)
    picks = match_serial(comprehensive_edges(a, b))
    # One join gives pairs and both leftovers, so that the texts of side 2 move once. Cues of side 1 without a
    # pair match nothing; their own index spreads them.
    left = a.join(picks.withColumnRenamed("src_idx", "cue_idx"), ["media_id", "cue_idx"], "left").withColumn(
        "_key", F.when(F.col("ref_idx").isNull(), F.col("cue_idx")).otherwise(0)
    ).withColumn("_one", F.lit(True))
    right = _right(b.withColumn("_two", F.lit(True)), "_two", "style", "raw").withColumn("_key", F.lit(0))
    every = left.join(right, ["media_id", "ref_idx", "_key"], "full")
    text = F.when(
        F.col("text").rlike(_HAN), combine_texts(F.col("text"), F.col("_t"), top)
    ).otherwise(combine_texts(F.col("_t"), F.col("text"), top))
    none = F.lit(None).cast("string")
    both, first = F.col("_one") & F.col("_two"), F.col("_one").isNotNull()

    def of(joined: Column, mine: str, other: str) -> Column:
        return F.when(both, joined).when(first, F.col(mine)).otherwise(F.col(other)).alias(mine)

    return every.select(
        "media_id", F.col("cue_idx").alias("idx1"), F.col("ref_idx").alias("idx2"),
        of(F.least("start_ms", "_s"), "start_ms", "_s"), of(F.greatest("end_ms", "_e"), "end_ms", "_e"), of(text, "text", "_t"),
        of(none, "style", "_style"), of(none, "raw", "_raw"), F.when(both, "both").when(first, "first").otherwise("second").alias("kind"),
    )


def _plan(roles: DataFrame) -> DataFrame:
    """Which side is the timing reference, and how overlay cues are matched."""
    e1, e2 = F.col("source1") == "embedded", F.col("source2") == "embedded"
    second = e2 & ~e1
    lang = F.when(second, F.col("language2")).otherwise(F.col("language1"))
    mixed = e1 != e2
    zh = lang == "chinese"
    mode = F.when(mixed & ~zh, "keep_foreign").when(mixed, "mixed").otherwise("standard")
    return roles.select(
        "media_id", F.when(second, 2).otherwise(1).alias("_ref"), zh.alias("_zh"), mode.alias("_mode")
    )


def _by_role(a: DataFrame, b: DataFrame, plan: DataFrame, reference: bool) -> DataFrame:
    """The reference (or overlay) side of every media, with its plan columns."""
    pick = F.col("_ref") == F.lit(1 if reference else 2)
    one = a.join(plan, "media_id").where(pick).withColumn("_track", F.lit(1))
    two = b.join(plan, "media_id").where(~pick).withColumn("_track", F.lit(2))
    return one.unionByName(two)


def preserved_edges(ref: DataFrame, overlay: DataFrame) -> DataFrame:
    """Candidates of the three matching modes, one row per pair, on a common score scale.

    standard: at least 100 ms overlap. mixed: any overlap, or centres within
    2 s. keep_foreign: any overlap, or centres within 5 s. Scores are scaled so
    that 10 x seconds of overlap compare with the nearness as the rule says;
    distances between centres are doubled to stay integral.
    """
    pairs = overlap_candidates(ref, overlay)
    modes = ref.select("media_id", "_mode").distinct()
    timed = pairs.join(modes, "media_id").where("_mode <> 'standard' or overlap_ms >= 100").select(
        "media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"),
        (F.col("overlap_ms") * F.when(F.col("_mode") == "mixed", 40).otherwise(20)).cast("double").alias("score"),
        F.lit(0.0).alias("near"),
    )
    out = timed
    for mode, reach in (("mixed", 4_000), ("keep_foreign", 10_000)):
        def centre(cues: DataFrame, side: str) -> DataFrame:
            return cues.where(F.col("_mode") == mode).select(
                "media_id", F.col("cue_idx").alias(f"{side}_idx"), (F.col("start_ms") + F.col("end_ms")).alias(f"{side}_c")
            )

        near = near_pairs(centre(ref, "a"), centre(overlay, "b"), "a_c", "b_c", reach).select(
            "media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"), F.lit(0.0).alias("score"),
            (reach - F.abs(F.col("a_c") - F.col("b_c"))).cast("double").alias("near"),
        )
        out = out.unionByName(near.where("near > 0"))
    return out.groupBy("media_id", "src_idx", "ref_idx").agg(F.max("score").alias("score"), F.max("near").alias("near"))


def merge_preserved(a: DataFrame, b: DataFrame, roles: DataFrame, top: str = "first") -> DataFrame:
    """Reference timing kept exactly; overlay text joins the reference cue it matches.

    Mixed sources with a non-Chinese reference also keep the unmatched overlay
    cues (see :func:`merge_keep_foreign`); otherwise those are dropped and the
    result has exactly the reference's cues.
    """
    a, b = with_style(a), with_style(b)
    plan = _plan(roles)
    ref, overlay = _by_role(a, b, plan, True), _by_role(a, b, plan, False)
    picks = match_serial(preserved_edges(ref, overlay)).withColumnRenamed("src_idx", "cue_idx")
    # One join gives pairs and leftovers, so that overlay texts move once; reference cues without a pair match nothing
    # and are spread by their own index. Both sides read the same columns of a track, which is dealt out once for them.
    left = ref.join(picks, ["media_id", "cue_idx"], "left").withColumn(
        "_key", F.when(F.col("ref_idx").isNull(), F.col("cue_idx")).otherwise(0)
    ).withColumn("_one", F.lit(True))
    right = _right(overlay.withColumnsRenamed({"_mode": "_mode2", "_track": "_track2"}), "style", "raw", "_mode2", "_track2").withColumn("_key", F.lit(0))
    every = left.join(right, ["media_id", "ref_idx", "_key"], "full").where("_one or _mode2 = 'keep_foreign'")
    first, matched = F.col("_one").isNotNull(), F.col("_track2").isNotNull()
    text = F.when(F.col("_zh"), combine_texts(F.col("text"), F.col("_t"), top)).otherwise(
        combine_texts(F.col("_t"), F.col("text"), top)
    )
    own = F.when(first, F.col("_track") == 1).otherwise(F.col("_track2") == 2)

    def of(mine: str, other: str) -> Column:
        return F.when(first, F.col(mine)).otherwise(F.col(other)).alias(mine)

    return every.select(
        "media_id", F.when(own, F.col("cue_idx")).otherwise(F.col("ref_idx")).alias("idx1"),
        F.when(own, F.col("ref_idx")).otherwise(F.col("cue_idx")).alias("idx2"), of("start_ms", "_s"), of("end_ms", "_e"),
        F.when(first & matched, text).when(first, F.col("text")).otherwise(F.col("_t")).alias("text"), of("style", "_style"), of("raw", "_raw"),
        F.when(first & matched, "both").when(first == own, "first").otherwise("second").alias("kind"),
    )


def merge_keep_foreign(english: DataFrame, foreign: DataFrame, top: str = "first") -> DataFrame:
    """English timing as base, foreign text on top, and every unmatched foreign cue kept."""
    media = english.select("media_id").unionByName(foreign.select("media_id")).distinct()
    roles = media.select(
        "media_id", F.lit("embedded").alias("source1"), F.lit("external").alias("source2"),
        F.lit("english").alias("language1"), F.lit("chinese").alias("language2"),
    )
    return merge_preserved(english, foreign, roles, top)


def time_align(a: DataFrame, b: DataFrame, tolerance_ms: int = 500) -> DataFrame:
    """``media_id, a_idx, b_idx, confidence``: nearest free start within the tolerance, in order of side 1."""
    pairs = time_candidates(a, b, tolerance_ms)
    edges = pairs.select(
        "media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"),
        (tolerance_ms + 1 - F.col("delta_ms")).cast("double").alias("score"), F.lit(0.0).alias("near"),
    )
    starts_a = a.select("media_id", F.col("cue_idx").alias("a_idx"), F.col("start_ms").alias("_a"))
    starts_b = b.select("media_id", F.col("cue_idx").alias("b_idx"), F.col("start_ms").alias("_b"))
    picks = match_serial(edges).select("media_id", F.col("src_idx").alias("a_idx"), F.col("ref_idx").alias("b_idx"))
    timed = picks.join(starts_a, ["media_id", "a_idx"]).join(starts_b, ["media_id", "b_idx"])
    return timed.select(
        "media_id", "a_idx", "b_idx", (1.0 - F.abs(F.col("_a") - F.col("_b")) / tolerance_ms).alias("confidence")
    )


def merge_strategy(a: DataFrame, b: DataFrame, roles: DataFrame, align: bool) -> DataFrame:
    """``media_id, strategy`` for every media of ``roles``."""
    na = a.groupBy("media_id").agg(F.count("*").alias("_n1"))
    nb = b.groupBy("media_id").agg(F.count("*").alias("_n2"))
    far = misaligned(a, b, roles).select("media_id", "misaligned")
    stats = timing_stats(zip_diff(a, b, 10)).select(
        "media_id", sync_level(F.col("core_ms"), F.col("max_ms")).alias("level")
    )
    joined = roles.join(na, "media_id", "left").join(nb, "media_id", "left").join(far, "media_id", "left").join(stats, "media_id", "left")
    e1, e2 = F.col("source1") == "embedded", F.col("source2") == "embedded"
    on = F.lit(align)
    strategy = (
        F.when(F.col("_n1").isNull() & F.col("_n2").isNull(), "empty")
        .when(F.col("_n1").isNull(), "copy_second").when(F.col("_n2").isNull(), "copy_first")
        .when(e1 & e2, "preserved")
        .when((e1 | e2) & on & F.coalesce("misaligned", F.lit(False)), "mixed")
        .when(e1 | e2, "preserved")
        .when(on & F.coalesce("level", F.lit("POOR")).isin("MODERATE", "POOR"), "enhanced")
        .otherwise("comprehensive")
    )
    return joined.select("media_id", strategy.alias("strategy"))


def merge_mixed(
    a: DataFrame, b: DataFrame, roles: DataFrame, top: str = "first", translated: DataFrame | None = None
) -> DataFrame:
    """Realign the external track on the embedded one, then merge with preserved timing.

    The anchor comes from :func:`cueweave.operators.anchors.semantic_anchor`;
    external cues before it are dropped, the rest moves by its offset. Media
    without an anchor are merged as they are.
    """
    from cueweave.operators.anchors import semantic_anchor

    a, b = with_style(a), with_style(b)
    first = roles.select("media_id", (F.col("source1") == "embedded").alias("_emb1"))

    def side(embedded: bool) -> DataFrame:
        flag = F.col("_emb1") if embedded else ~F.col("_emb1")
        one = a.join(first, "media_id").where(flag).withColumn("_track", F.lit(1))
        two = b.join(first, "media_id").where(~flag).withColumn("_track", F.lit(2))
        return one.unionByName(two).drop("_emb1")

    embedded, external = cut_lineage(side(True), "embedded"), cut_lineage(side(False), "external")
    anchor = cut_lineage(
        semantic_anchor(embedded, external, translated).select(
            "media_id", F.col("ref_idx").alias("_from"), F.round("offset_ms").cast("bigint").alias("_off")
        ),
        "anchor",
    )
    planned = external.join(anchor, "media_id", "left").where("_from is null or cue_idx >= _from")
    moved = apply_offset(planned, F.coalesce("_off", F.lit(0))).drop("_from", "_off")
    cols = ["media_id", "cue_idx", "start_ms", "end_ms", "text", "style", "raw"]
    every = cut_lineage(embedded.unionByName(moved), "realigned")
    return merge_preserved(
        every.where("_track = 1").select(*cols), every.where("_track = 2").select(*cols), roles, top
    )


def merge_enhanced(
    a: DataFrame, b: DataFrame, roles: DataFrame, top: str = "first", threshold: float = 0.8,
    gap_ms: int = 100, translated: DataFrame | None = None, sync: str = "first-line", preference: str = "auto",
) -> DataFrame:
    """Global sync, nearest starts, text similarity for poorly aligned media, leftovers, anti-jitter.

    ``sync`` is the strategy of the global synchronisation (see
    :func:`cueweave.operators.sync.global_plan`), ``preference`` the language
    whose track is the reference, ``threshold`` that of the text similarity.
    ``translated`` (``media_id, a_idx, b_idx, confidence``) gives anchors for
    the cross-language case; media with one are completed by
    :func:`cueweave.operators.joins.align_from_anchor` instead of similarity.
    """
    from cueweave.operators.joins import align_from_anchor, merge_from_alignments
    from cueweave.operators.similarity_join import similarity_align
    from cueweave.operators.sync import apply_global_offset, global_plan, reference_track

    a, b = with_style(a), with_style(b)
    plan = cut_lineage(global_plan(a, b, roles, sync, translated, preference), "plan")
    # Both tracks are read many times below; written once, the plans stay small.
    one = cut_lineage(apply_global_offset(a, plan, 1), "track")
    two = cut_lineage(apply_global_offset(b, plan, 2), "track")
    timed = cut_lineage(time_align(one, two), "aligned")
    counts = one.groupBy("media_id").agg(F.count("*").alias("_n1")).join(
        two.groupBy("media_id").agg(F.count("*").alias("_n2")), "media_id"
    ).join(timed.groupBy("media_id").agg(F.count("*").alias("_n")), "media_id", "left")
    poor = counts.where(F.coalesce("_n", F.lit(0)) * 10 < F.least("_n1", "_n2") * 7).select("media_id")

    def open_cues(cues: DataFrame, idx: str) -> DataFrame:
        taken = timed.select("media_id", F.col(idx).alias("cue_idx"))
        rest = cues.join(poor, "media_id", "left_semi").join(taken, ["media_id", "cue_idx"], "left_anti")
        return number_rows(rest, ["media_id"], "cue_idx", [], "_pos", width=8192)

    left, right = cut_lineage(open_cues(one, "a_idx"), "open"), cut_lineage(open_cues(two, "b_idx"), "open")

    def listed(cues: DataFrame) -> DataFrame:
        return cues.select("media_id", F.col("_pos").alias("cue_idx"), "start_ms", "end_ms", "text")

    found = similarity_align(listed(left), listed(right), threshold).select(
        "media_id", F.col("src_idx").alias("_i"), F.col("ref_idx").alias("_j")
    )
    back_a = left.select("media_id", F.col("_pos").alias("_i"), F.col("cue_idx").alias("a_idx"))
    back_b = right.select("media_id", F.col("_pos").alias("_j"), F.col("cue_idx").alias("b_idx"))
    by_text = found.join(back_a, ["media_id", "_i"]).join(back_b, ["media_id", "_j"]).select("media_id", "a_idx", "b_idx")
    if translated is not None:
        anchor = translated.where(F.col("confidence") >= threshold)
        plain = left.drop("_pos"), right.drop("_pos")
        chained = align_from_anchor(*plain, anchor)
        by_text = by_text.join(anchor.select("media_id"), "media_id", "left_anti").unionByName(
            anchor.select("media_id", "a_idx", "b_idx")
        ).unionByName(chained.select("media_id", "a_idx", "b_idx"))
    pairs = timed.select("media_id", "a_idx", "b_idx").unionByName(by_text)
    merged = merge_from_alignments(one, two, pairs, reference_track(one, two, roles, preference), top)
    ordered = merged_order(merged).withColumnRenamed("seq", "cue_idx")
    return anti_jitter(ordered, gap_ms).select(*MERGED)


def merge(
    a: DataFrame, b: DataFrame, roles: DataFrame, align: bool = True, top: str = "first", threshold: float = 0.8,
    gap_ms: int = 100, sync: str = "auto", preference: str = "auto", translated: DataFrame | None = None,
) -> DataFrame:
    """Merge every media by its own strategy; adds ``strategy``.

    ``translated`` (``media_id, a_idx, b_idx, confidence``) are anchors between
    the tracks found through a translation; they serve the realignment of mixed
    sources and the enhanced merge. The other options go to the enhanced merge.
    """
    # All strategies read both tracks, most of them several times: they are computed once.
    a, b, roles = cut_lineage(with_style(a), "track"), cut_lineage(with_style(b), "track"), cut_lineage(roles, "roles")
    chosen = cut_lineage(merge_strategy(a, b, roles, align), "strategy")

    # Each cue learns its strategy in one join; the parts are then read as they stand, without moving a text again.
    one, two = (cut_lineage(t.join(chosen.distinct(), "media_id"), "parted") for t in (a, b))

    def part(name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        mine = F.col("strategy") == name
        some = roles.join(chosen.where(mine).select("media_id"), "media_id", "left_semi")
        return one.where(mine).drop("strategy"), two.where(mine).drop("strategy"), some

    def tag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*MERGED).withColumn("strategy", F.lit(name))

    pa, pb, pr = part("preserved")
    out = tag(merge_preserved(pa, pb, pr, top), "preserved")
    ca, cb, _ = part("comprehensive")
    out = out.unionByName(tag(merge_comprehensive(ca, cb, top), "comprehensive"))
    out = out.unionByName(tag(_alone(part("copy_first")[0], "first"), "copy_first"))
    out = out.unionByName(tag(_alone(part("copy_second")[1], "second"), "copy_second"))
    if align:
        ma, mb, mr = part("mixed")
        out = out.unionByName(tag(merge_mixed(ma, mb, mr, top, _by_source(translated, mr)), "mixed"))
        ea, eb, er = part("enhanced")
        out = out.unionByName(tag(merge_enhanced(ea, eb, er, top, threshold, gap_ms, translated, sync, preference), "enhanced"))
    return out


def _by_source(translated: DataFrame | None, roles: DataFrame) -> DataFrame | None:
    """Anchors by track as anchors from the external track (``src_idx``) to the embedded one (``ref_idx``)."""
    if translated is None:
        return None
    first = F.col("source1") == "embedded"
    return translated.join(roles.select("media_id", "source1"), "media_id").select(
        "media_id", F.when(first, F.col("b_idx")).otherwise(F.col("a_idx")).alias("src_idx"),
        F.when(first, F.col("a_idx")).otherwise(F.col("b_idx")).alias("ref_idx"), "confidence",
    )


def merge_ass(a: DataFrame, b: DataFrame, roles: DataFrame, align: bool = False, top: str = "first") -> DataFrame:
    """ASS with ASS: only dialogue styles merge, side 2's other events are kept unchanged.

    Pairs without a style and unmatched side-1 dialogue get style ``Bilingual``.
    """
    a, b = with_style(a), with_style(b)
    dialogue_a = a.where(is_dialogue_style(F.col("style")))
    dialogue_b = b.where(is_dialogue_style(F.col("style")))
    other_b = b.where(~is_dialogue_style(F.col("style")))
    merged = merge(dialogue_a, dialogue_b, roles, align, top).drop("strategy")
    zh_styles = dialogue_a.select("media_id", F.coalesce("style", F.lit("Default")).alias("style")).distinct().withColumn(
        "_zh", F.lit(True)
    )
    styled = merged.join(zh_styles, ["media_id", "style"], "left")
    combined: Column = F.col("style").isNull()
    bilingual = combined | F.coalesce("_zh", F.lit(False))
    out = styled.select(
        "media_id", "idx1", "idx2", "start_ms", "end_ms", "text",
        F.when(bilingual, "Bilingual").otherwise(F.col("style")).alias("style"),
        F.when(~combined, F.col("raw")).alias("raw"), "kind",
    )
    return out.unionByName(_alone(other_b, "second"))


def ass_file(merged: DataFrame, english: DataFrame) -> DataFrame:
    """``media_id, seq, block`` of whole ASS files: the English file's header and styles, the Bilingual style, events by start and end.

    ``merged`` is the result of :func:`merge_ass`, ``english`` the English files (``media_id, text``).
    """
    parts = ass.header_parts(english)
    style = bilingual_style(ass.script_info(english)).select("media_id", "style_line")
    lines = parts.join(style, "media_id", "left").withColumn(
        "style_line", F.coalesce("style_line", bilingual_line(F.lit(1080)))
    )
    with_format = F.when(
        F.exists("styles", lambda x: F.lower(F.trim(x)).startswith("format:")), F.col("styles")
    ).otherwise(F.concat(F.array(F.lit(ass.STYLE_FORMAT)), F.col("styles")))
    header = lines.select("media_id", F.concat(
        F.lit("[Script Info]\n"), F.array_join("info", "\n"), F.lit("\n\n[V4+ Styles]\n"), F.array_join(with_format, "\n"), F.lit("\n"),
        "style_line", F.lit(f"\n\n[Events]\n{ass.EVENT_FORMAT}"),
    ).alias("block"))
    rank = F.when(F.col("kind") == "both", 0).when(F.col("kind") == "first", 1).otherwise(2)
    ranked = merged.withColumn("_rank", rank).withColumn("_i", F.coalesce("idx1", "idx2")).withColumn("_j", F.coalesce("idx2", "idx1"))
    placed = number_rows(ranked, ["media_id"], "start_ms", ["end_ms", "_rank", "_i", "_j"], "cue_idx")
    return ass.render(placed.select("media_id", "cue_idx", "start_ms", "end_ms", "text", "style", "raw"), header)


def bilingual_line(play_res_y: Column) -> Column:
    """Fixed wording: the style line, its font size from the height."""
    font = F.greatest(F.lit(40), F.call_function("div", play_res_y * 48, F.lit(1000)).cast("int"))
    return F.concat(
        F.lit("Style: Bilingual,Microsoft YaHei,"), font.cast("string"),
        F.lit(",&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,15,15,50,1"),
    )


def bilingual_style(script_info: DataFrame) -> DataFrame:
    """``media_id, font_size, style_line``: font size from PlayResY (``key, value`` header rows)."""
    res = F.max(F.when(F.col("key") == "playresy", F.col("value").try_cast("int")))
    size = script_info.groupBy("media_id").agg(F.coalesce(res, F.lit(1080)).alias("_y"))
    font = F.greatest(F.lit(40), F.expr("_y * 48 div 1000").cast("int"))
    line = bilingual_line(F.col("_y"))
    return size.select("media_id", font.alias("font_size"), line.alias("style_line"))
