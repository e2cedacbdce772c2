"""Ordered computations over one media whose cues need not fit into one task: a segmented scan.

A plain ``Window.partitionBy("media_id")`` sorts a whole media inside a single
task. Here one exchange by (media, chunk) sorts each chunk; what a window gives
inside it is written with the rows. Of the written rows each chunk's state (a
sum, its first and last row) is read, folded along the media and added back. The
input is computed and moved once, however often its result is looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.plans.lineage import cut_lineage

CHUNK_MS = 600_000


def time_chunk(ms: Column, width: int = CHUNK_MS) -> Column:
    """Chunk number of a time in ms (or, with another width, of a cue index)."""
    return F.call_function("div", ms, F.lit(width))


def segments(
    df: DataFrame, keys: list[str], by: str, tie: list[str], local: dict[str, Column], sums: dict[str, Column] | None = None, width: int = CHUNK_MS,
    unwritten: list[str] | None = None,
) -> DataFrame:
    """``df`` with its ``_chunk`` and columns over each chunk in (by, *tie) order, written.

    ``local`` are window functions such as ``F.lag("x")``; ``sums`` are added up to
    the row at hand and may name columns of ``local``, of which ``unwritten`` serve them alone.
    """
    inner = Window.partitionBy(*keys, "_chunk").orderBy(by, *tie)
    found = df.withColumn("_chunk", time_chunk(F.col(by), width)).withColumns({name: value.over(inner) for name, value in local.items()})
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    summed = found.withColumns({name: F.sum(value).over(upto) for name, value in (sums or {}).items()})
    return cut_lineage(summed.drop(*(unwritten or [])), "segments")


def chunks_before(keys: list[str]) -> Window:
    """All chunks of a media before the one at hand."""
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame, keys: list[str], by: str, tie: list[str], out: str, width: int = CHUNK_MS
) -> DataFrame:
    """Dense 0-based position in (by, *tie) order within ``keys``.

    Only rows of a later chunk need what comes before theirs. Those chunks are written, so that the planner knows
    their real size and need not move the rows again where they are few.
    """
    placed = segments(df, keys, by, tie, {"_at": F.row_number()}, width=width)
    states = placed.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = states.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(chunks_before(keys)), F.lit(0)).alias("_before"))
    later = cut_lineage(before.where("_before > 0"), "later")
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, "_chunk")])  # as an inner join would have it
    position = (F.coalesce("_before", F.lit(0)) + F.col("_at") - 1).cast("int")
    return placed.where(known).join(later, [*keys, "_chunk"], "left").withColumn(out, position).drop("_chunk", "_at", "_before")


def with_neighbour(
    df: DataFrame, keys: list[str], ms: str, tie: list[str], cols: dict[str, str], after: bool
) -> DataFrame:
    """Values of the previous (or next) row in (ms, *tie) order within ``keys``.

    ``cols`` maps source column to output column. Inside a chunk this is lag or
    lead; the first (last) row of a chunk takes the border row of the nearest
    non-empty chunk before (after) it.
    """
    step, pick = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    payload = F.struct(*[F.col(c).alias(o) for c, o in cols.items()])
    near = segments(df.withColumn("_own", payload), keys, ms, tie, {"_near": step("_own")})
    across = Window.partitionBy(*keys).orderBy("_chunk")
    border = near.groupBy(*keys, "_chunk").agg(pick("_own", F.struct(ms, *tie)).alias("_edge")).select(
        *keys, "_chunk", step("_edge").over(across).alias("_far")
    )
    joined = near.drop("_own").join(border, [*keys, "_chunk"])
    chosen = F.coalesce(F.col("_near"), F.col("_far"))
    return joined.withColumns({o: chosen[o] for o in cols.values()}).drop("_chunk", "_near", "_far")


def islands(
    df: DataFrame, keys: list[str], by: str, tie: list[str], payload: list[str], same: Callable[[Column, Column], Column], out: str
) -> DataFrame:
    """``out``: number of the island of each row, in (by, *tie) order within ``keys``.

    An island goes on where ``same`` holds of the ``payload`` structs of the row
    before and the row at hand. Chunks number their own islands; whether a chunk's
    first row goes on with the island before is told by the two rows at the border.
    """
    order, this = F.struct(by, *tie), F.struct(*payload)
    # Each column is looked back for on its own: a struct of them would be moved beside the columns themselves.
    last = F.struct(*[F.col(f"_last_{c}").alias(c) for c in payload])
    fresh = F.when((F.col("_at") == 1) | F.coalesce(same(last, this), F.lit(False)), 0).otherwise(1).cast("bigint")
    back = {f"_last_{c}": F.lag(c) for c in payload}
    near = segments(df, keys, by, tie, {"_at": F.row_number(), **back}, {"_local": fresh}, unwritten=["_at", *back])
    states = near.groupBy(*keys, "_chunk").agg(
        F.max("_local").alias("_n"), F.min_by(this, order).alias("_this"), F.max_by(this, order).alias("_end")
    ).withColumn("_last", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")))
    # The first row of a chunk begins an island unless it goes on with the chunk before.
    goes_on = F.col("_last").isNotNull() & F.coalesce(same(F.col("_last"), F.col("_this")), F.lit(False))
    begun = states.withColumn("_new", F.when(goes_on, 0).otherwise(1).cast("bigint"))
    base = begun.select(*keys, "_chunk", (F.coalesce(F.sum(F.col("_n") + F.col("_new")).over(chunks_before(keys)), F.lit(0)) + F.col("_new")).alias("_base"))
    return near.join(base, [*keys, "_chunk"]).withColumn(out, F.col("_base") + F.col("_local")).drop("_chunk", "_local", "_base")
