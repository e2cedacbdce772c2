"""Shifts, renumbering, jitter removal and other per-track timing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.plans.ordered import islands, number_rows

GAP_MS = 100


def shift(cues: DataFrame, offset: Column | int) -> DataFrame:
    """Move cues by ``offset`` ms; a start below 0 becomes 0 and the duration stays."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    start = F.col("start_ms") + off
    end = F.col("end_ms") + off
    return cues.withColumns({
        "start_ms": F.greatest(start, F.lit(0)).cast("bigint"),
        "end_ms": F.when(start < 0, F.greatest(end - start, F.lit(0))).otherwise(end).cast("bigint"),
    })


def apply_offset(cues: DataFrame, offset: Column | int) -> DataFrame:
    """Move cues by ``offset`` ms, clamping both ends at 0 on their own."""
    off = F.lit(offset) if isinstance(offset, int) else offset
    return cues.withColumns({
        "start_ms": F.greatest(F.col("start_ms") + off, F.lit(0)).cast("bigint"),
        "end_ms": F.greatest(F.col("end_ms") + off, F.lit(0)).cast("bigint"),
    })


def shift_by_media(cues: DataFrame, offsets: DataFrame) -> DataFrame:
    """:func:`shift` with ``media_id, offset_ms``; media without an offset stay."""
    joined = cues.join(offsets.select("media_id", "offset_ms"), "media_id", "left")
    return shift(joined, F.coalesce("offset_ms", F.lit(0))).drop("offset_ms")


def shift_first_to(cues: DataFrame, target_ms: Column | int) -> DataFrame:
    """Shift each media so that its cue 0 starts at ``target_ms``."""
    target = F.lit(target_ms) if isinstance(target_ms, int) else target_ms
    first = cues.where("cue_idx = 0").select("media_id", (target - F.col("start_ms")).alias("offset_ms"))
    return shift_by_media(cues, first)


def realign(src: DataFrame, ref: DataFrame, anchors: DataFrame) -> DataFrame:
    """Drop source cues before the anchor and move the rest onto the reference.

    ``anchors`` is ``media_id, src_idx, ref_idx``; out-of-range anchors leave no row.
    """
    at_src = src.select("media_id", F.col("cue_idx").alias("src_idx"), F.col("start_ms").alias("_s"))
    at_ref = ref.select("media_id", F.col("cue_idx").alias("ref_idx"), F.col("start_ms").alias("_r"))
    plan = anchors.join(at_src, ["media_id", "src_idx"]).join(at_ref, ["media_id", "ref_idx"]).select(
        "media_id", "src_idx", (F.col("_r") - F.col("_s")).alias("offset_ms")
    )
    kept = src.join(plan, "media_id").where("cue_idx >= src_idx")
    return apply_offset(kept, F.col("offset_ms")).drop("src_idx", "offset_ms")


def renumber(cues: DataFrame) -> DataFrame:
    """``seq``: position by (start, cue_idx), from 1."""
    out = number_rows(cues, ["media_id"], "start_ms", ["cue_idx"], "_pos")
    return out.withColumn("seq", F.col("_pos") + 1).drop("_pos")


def anti_jitter(cues: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Join consecutive cues with equal text whose gap is at most ``gap_ms``.

    In (start, cue_idx) order; the joined cue ends where its last member ends.
    Needs ``media_id, cue_idx, start_ms, end_ms, text``; other columns come
    from the first member. Islands are numbered by a segmented scan.
    """
    extra = [c for c in cues.columns if c not in ("media_id", "cue_idx", "start_ms", "end_ms", "text")]
    def same(last: Column, this: Column) -> Column:
        return (this["text"] == last["text"]) & (this["start_ms"] - last["end_ms"] <= gap_ms)

    joined = islands(cues, ["media_id"], "start_ms", ["cue_idx"], ["text", "start_ms", "end_ms"], same, "_island")
    order = F.struct("start_ms", "cue_idx")
    return joined.groupBy("media_id", "_island").agg(
        F.min_by(F.struct("cue_idx", "start_ms", "text", *extra), order).alias("_f"),
        F.max_by("end_ms", order).alias("end_ms"),
        F.count("*").alias("n_joined"),
    ).select("media_id", "_f.cue_idx", "_f.start_ms", "end_ms", "_f.text", *[f"_f.{c}" for c in extra], "n_joined")


def even_sample(cues: DataFrame, k: int) -> DataFrame:
    """Every ``step``-th cue (``step = max(1, n div min(k, n))``), at most ``k`` per media.

    The counts are joined, one row per media, and each cue is tested by its
    index; a list of the wanted indexes would be ``k`` times as long as the
    counts, by whose size the planner chooses to send it to every executor.
    """
    n = cues.groupBy("media_id").agg(F.count("*").alias("_n"))
    step = F.expr(f"greatest(1L, _n div least({k}L, _n))")
    at = F.col("cue_idx")
    wanted = (at >= 0) & (at < F.col("_n")) & (at % step == 0) & (at < step * k)
    rest = [c for c in cues.columns if c not in ("media_id", "cue_idx")]
    return cues.join(n, "media_id").where(wanted).select("media_id", "cue_idx", *rest)


def rel_pos(cues: DataFrame) -> DataFrame:
    """``pos``: index over the last index of its media."""
    last = cues.groupBy("media_id").agg(F.max("cue_idx").alias("_last"))
    return cues.join(last, "media_id").withColumn(
        "pos", F.col("cue_idx") / F.greatest(F.lit(1), F.col("_last"))
    ).drop("_last")


def preview(cues: DataFrame, first: int = 5, width: int = 100) -> DataFrame:
    """First cues of each media with shortened text."""
    cut = F.concat(F.substring("text", 1, width), F.lit("..."))
    return cues.where(F.col("cue_idx") < first).withColumn(
        "text", F.when(F.length("text") > width, cut).otherwise(F.col("text"))
    )
