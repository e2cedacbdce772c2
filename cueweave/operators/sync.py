"""Offset voting, track sync, reference choice, global sync and batch alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.operators.joins import anchor_first, anchor_scan
from cueweave.operators.summary import track_is_lang
from cueweave.operators.timing import apply_offset, realign, shift


#: Fixed value: the packets that the sync rule compares with the first starts of an external file.
PACKET_WINDOW_MS = 120_000


#: Offsets times starts that a step of the vote holds.
_VOTE_CELLS = 1_000_000
#: Stands for a start without an index, which has no vote.
_NO_INDEX = -(1 << 62)


def _votes(batches: Iterator[pd.DataFrame], tolerance_ms: int) -> Iterator[pd.DataFrame]:
    """Best candidate of each row, a span of a media's embedded times (``_own``) and those near it (``_near``), by (votes desc, ext_i, emb_ms)."""
    for pdf in batches:
        out = []
        for media, index, ext, own, near in zip(*[pdf[c].tolist() for c in ("media_id", "_i", "_e", "_own", "_near")], strict=True):
            index, ext = np.asarray(index, np.int64), np.asarray(ext, np.int64)
            own, near = np.sort(np.asarray(own, np.int64)), np.sort(np.asarray(near, np.int64))
            begin = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
            counted = index[begin] != _NO_INDEX
            best, step = None, max(1, _VOTE_CELLS // len(ext) ** 2)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                # The embedded time that each start would have at each offset, and whether there is one within the tolerance.
                want = ext[:, None, None] - (ext[:, None] - part)[None]
                place = np.searchsorted(near, want - tolerance_ms)
                found = near[np.minimum(place, len(near) - 1)]
                hit = (place < len(near)) & (found <= want + tolerance_ms)
                votes = np.logical_or.reduceat(hit, begin, axis=0)[counted].sum(axis=0)
                k, m = divmod(int(votes.argmax()), len(part))
                # Starts of one index stand together; of these the smallest embedded time goes first, then the smallest offset.
                rows, cols = np.nonzero(votes == votes[k, m])
                alike = index[rows] == index[k]
                rows, cols = rows[alike], cols[alike]
                first = np.lexsort((ext[rows] - part[cols], part[cols]))[0]
                k, m = rows[first], cols[first]
                key = (-int(votes[k, m]), int(index[k]), int(part[m]), int(ext[k] - part[m]))
                best = key if best is None or key < best else best
            out.append((media, *best))
        yield pd.DataFrame(out, columns=["media_id", "v", "i", "emb_ms", "offset_ms"])


def offset_vote(ext: DataFrame, emb: DataFrame, tolerance_ms: int = 200) -> DataFrame:
    """Offset between external and embedded starts that most external starts agree on.

    ``ext``: ``media_id, ext_i, ext_ms`` (the few first starts of a file),
    ``emb``: ``media_id, emb_ms`` distinct. Every difference is a candidate. An
    external start votes for it if one of its own differences is within the
    tolerance. Embedded times are cut into spans, as long as the external starts
    lie apart or longer, and those that a span's candidates may meet are copied
    to it: a few rows of single times move and are gathered, never the
    differences, and no media is a task's alone. Ties go to the smallest (i, j).
    """
    least = max(60_000, 2 * tolerance_ms)
    known = F.col("ext_ms").isNotNull()
    start = F.struct(F.coalesce(F.col("ext_i").cast("bigint"), F.lit(_NO_INDEX)).alias("i"), F.col("ext_ms").cast("bigint").alias("ms"))
    starts = ext.where("media_id is not null").groupBy("media_id").agg(
        F.count("*").alias("n_ext"), F.array_sort(F.collect_list(F.when(known, start))).alias("_s"),
        (F.max("ext_ms") - F.min("ext_ms") + tolerance_ms).cast("bigint").alias("_reach"),
    ).where("size(_s) > 0").withColumn("_width", F.greatest(F.lit(least).cast("bigint"), F.col("_reach")))
    spans = emb.where("emb_ms is not null").select("media_id", F.col("emb_ms").cast("bigint").alias("emb_ms")).join(
        starts.select("media_id", "_reach", "_width"), "media_id"
    )
    span = lambda ms: F.floor(ms / F.col("_width")).cast("bigint")
    copied = spans.select(
        "media_id", "emb_ms", span(F.col("emb_ms")).alias("_at"),
        F.explode(F.sequence(span(F.col("emb_ms") - F.col("_reach")), span(F.col("emb_ms") + F.col("_reach")))).alias("_span"),
    )
    gathered = copied.groupBy("media_id", "_span").agg(
        F.collect_list(F.when(F.col("_at") == F.col("_span"), F.col("emb_ms"))).alias("_own"), F.collect_list("emb_ms").alias("_near")
    ).where("size(_own) > 0")
    rows = gathered.join(starts.select("media_id", F.col("_s.i").alias("_i"), F.col("_s.ms").alias("_e")), "media_id").drop("_span")
    kind = rows.schema["media_id"].dataType.simpleString()
    voted = rows.mapInPandas(
        lambda batches: _votes(batches, tolerance_ms), f"media_id {kind}, v bigint, i bigint, emb_ms bigint, offset_ms bigint"
    )
    best = voted.groupBy("media_id").agg(F.min(F.struct("v", "i", "emb_ms", "offset_ms")).alias("m"))
    return best.join(starts.select("media_id", "n_ext"), "media_id").select(
        "media_id", F.col("m.offset_ms"), (-F.col("m.v")).alias("votes"), "n_ext"
    )


def sync_report(ext: DataFrame, emb: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per media with a chosen track: offset, shift to apply, votes and outcome (dry run)."""
    voted = offset_vote(ext, emb)
    n_ext = ext.groupBy("media_id").agg(F.count("*").alias("_n"))
    joined = chosen.select("media_id", "label").join(voted, "media_id", "left").join(n_ext, "media_id", "left")
    has_emb = emb.select("media_id").distinct().withColumn("_e", F.lit(True))
    joined = joined.join(has_emb, "media_id", "left")
    off = F.coalesce("offset_ms", F.lit(0))
    message = (
        F.when(F.col("_e").isNull(), "no embedded timestamps").when(F.col("_n").isNull(), "no external timestamps")
        .when(off == 0, "in sync").otherwise("shift")
    )
    return joined.select(
        "media_id", F.col("label").alias("track_used"), off.alias("offset_ms"), (-off).alias("shift_ms"),
        F.coalesce("votes", F.lit(0)).alias("match_count"), F.coalesce("_n", F.lit(0)).alias("total_compared"),
        (F.col("_e").isNotNull() & F.col("_n").isNotNull()).alias("success"), message.alias("message"),
    )


def sync_cues(cues: DataFrame, report: DataFrame) -> DataFrame:
    """Apply the shifts of successful report rows."""
    plan = report.where("success").select("media_id", "shift_ms")
    joined = cues.join(plan, "media_id", "left")
    return shift(joined, F.coalesce("shift_ms", F.lit(0))).drop("shift_ms")


def reference_track(a: DataFrame, b: DataFrame, roles: DataFrame, preference: str = "auto") -> DataFrame:
    """``media_id, reference`` (1 or 2): embedded over external, then language, then earlier start."""
    s1, s2 = F.col("source1"), F.col("source2")
    first_a = a.where("cue_idx = 0").select("media_id", F.col("start_ms").alias("_a"))
    first_b = b.where("cue_idx = 0").select("media_id", F.col("start_ms").alias("_b"))
    joined = roles.join(first_a, "media_id", "left").join(first_b, "media_id", "left")
    rule: Column = F.when((s1 == "embedded") & (s2 == "external"), 1).when((s2 == "embedded") & (s1 == "external"), 2)
    if preference != "auto":
        flag = {"chinese": "is_chinese", "english": "is_english"}[preference]
        for track, lang, out in ((a, "language1", "_p1"), (b, "language2", "_p2")):
            flags = track_is_lang(track, roles.select("media_id", F.col(lang).alias("language")))
            joined = joined.join(flags.select("media_id", F.col(flag).alias(out)), "media_id", "left")
        rule = rule.when(F.col("_p1"), 1).when(F.col("_p2"), 2)
    return joined.select("media_id", rule.when(F.col("_a") > F.col("_b"), 2).otherwise(1).alias("reference"))


def global_offset(a: DataFrame, b: DataFrame, reference: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Offset to add to the non-reference track; 0 below 100 ms or without anchor.

    ``anchors`` (``media_id, a_idx, b_idx``) defaults to the first-line rule.
    """
    found = anchors if anchors is not None else anchor_first(a, b)
    at_a = a.select("media_id", F.col("cue_idx").alias("a_idx"), F.col("start_ms").alias("_a"))
    at_b = b.select("media_id", F.col("cue_idx").alias("b_idx"), F.col("start_ms").alias("_b"))
    timed = found.select("media_id", "a_idx", "b_idx").join(at_a, ["media_id", "a_idx"]).join(at_b, ["media_id", "b_idx"])
    diff = F.when(F.col("reference") == 1, F.col("_a") - F.col("_b")).otherwise(F.col("_b") - F.col("_a"))
    off = F.coalesce(F.when(F.abs(diff) > 100, diff), F.lit(0))
    return reference.join(timed, "media_id", "left").select("media_id", "reference", off.cast("bigint").alias("offset_ms"))


def apply_global_offset(cues: DataFrame, plan: DataFrame, track: int) -> DataFrame:
    """Move a track by the plan's offset where it is not the reference."""
    mine = plan.select("media_id", F.when(F.col("reference") != track, F.col("offset_ms")).otherwise(0).alias("_o"))
    joined = cues.join(mine, "media_id", "left")
    return apply_offset(joined, F.coalesce("_o", F.lit(0))).drop("_o")


def global_sync(a: DataFrame, b: DataFrame, roles: DataFrame, strategy: str = "first-line", translated: DataFrame | None = None) -> DataFrame:
    """Both tracks after global synchronisation: cue columns plus ``track`` (1 or 2).

    Strategies: ``first-line``, ``scan``, ``scan60`` (30 cues, a minute) and
    ``translation`` with given ``media_id, a_idx, b_idx`` pairs, falling back
    to the wide scan.
    """
    plan = global_plan(a, b, roles, strategy, translated)
    one = apply_global_offset(a, plan, 1).withColumn("track", F.lit(1))
    two = apply_global_offset(b, plan, 2).withColumn("track", F.lit(2))
    return one.unionByName(two)


def global_plan(
    a: DataFrame, b: DataFrame, roles: DataFrame, strategy: str = "first-line", translated: DataFrame | None = None, preference: str = "auto"
) -> DataFrame:
    """Reference track and offset per media; ``auto`` is ``translation`` where such anchors are given, else ``first-line``."""
    reference = reference_track(a, b, roles, preference)
    if strategy == "auto":
        strategy = "first-line" if translated is None else "translation"
    if strategy not in ("first-line", "scan", "scan60", "translation"):
        raise ValueError(f"unknown sync strategy {strategy}")
    if strategy == "first-line":
        found = anchor_first(a, b)
    elif strategy == "scan":
        found = anchor_scan(a, b)
    else:
        found = anchor_scan(a, b, 30, 60_000, 0.3)
        if strategy == "translation" and translated is not None:
            cols = ["media_id", "a_idx", "b_idx"]
            found = translated.select(*cols).unionByName(found.join(translated, "media_id", "left_anti").select(*cols))
    return global_offset(a, b, reference, found)


def batch_align(src: DataFrame, ref: DataFrame) -> DataFrame:
    """Align all given pairs at their first cues."""
    zero = src.select("media_id").distinct().select("media_id", F.lit(0).alias("src_idx"), F.lit(0).alias("ref_idx"))
    return realign(src, ref, zero)


def manual_sync(a: DataFrame, b: DataFrame, manual: DataFrame) -> DataFrame:
    """Trim both tracks at given anchors and move the non-reference one.

    ``manual`` is ``media_id, a_idx, b_idx, reference``. Returns cue columns plus ``track``.
    """
    at_a = a.select("media_id", F.col("cue_idx").alias("a_idx"), F.col("start_ms").alias("_a"))
    at_b = b.select("media_id", F.col("cue_idx").alias("b_idx"), F.col("start_ms").alias("_b"))
    diff = F.when(F.col("reference") == 1, F.col("_a") - F.col("_b")).otherwise(F.col("_b") - F.col("_a"))
    plan = manual.join(at_a, ["media_id", "a_idx"]).join(at_b, ["media_id", "b_idx"]).select(
        "media_id", "a_idx", "b_idx", "reference", diff.alias("_o")
    )

    def side(cues: DataFrame, idx: str, track: int) -> DataFrame:
        kept = cues.join(plan, "media_id").where(F.col("cue_idx") >= F.col(idx))
        moved = apply_offset(kept, F.when(F.col("reference") != track, F.col("_o")).otherwise(0))
        return moved.select(*cues.columns, F.lit(track).alias("track"))

    return side(a, "a_idx", 1).unionByName(side(b, "b_idx", 2))
