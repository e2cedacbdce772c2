"""Range joins on the media timeline as bucketed equi-joins.

The join key is ``(media_id, bucket)``: a media that owns a large share of the
cues is spread over all its buckets, and no theta-only join is ever planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_MS = 60_000


def overlap_pairs(a: DataFrame, b: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Pairs of cues of one media whose half-open spans intersect.

    ``a`` needs ``media_id, a_start, a_end`` and ``b`` ``media_id, b_start,
    b_end`` (times clamped at 0). A pair is emitted in the bucket of its later
    start only, so spans of any length give each pair once.
    """
    a2 = a.withColumn(
        "_bucket",
        F.explode(F.expr(f"sequence(a_start div {width}, greatest(a_start, a_end - 1) div {width})")),
    )
    b2 = b.withColumn(
        "_bucket",
        F.explode(F.expr(f"sequence(b_start div {width}, greatest(b_start, b_end - 1) div {width})")),
    )
    return (
        a2.join(b2, ["media_id", "_bucket"])
        .where("a_start < b_end and b_start < a_end")
        .where(f"_bucket = greatest(a_start, b_start) div {width}")
        .drop("_bucket")
    )


def near_pairs(
    a: DataFrame, b: DataFrame, left: str, right: str, tolerance: int, keys: tuple[str, ...] = ("media_id",)
) -> DataFrame:
    """Pairs with ``abs(left - right) <= tolerance``; only ``b`` rows are copied (2 or 3 buckets)."""
    width = max(1_000, tolerance)
    a2 = a.withColumn("_bucket", F.expr(f"cast(floor({left} / {width}) as bigint)"))
    b2 = b.withColumn(
        "_bucket",
        F.explode(
            F.expr(
                f"sequence(cast(floor(({right} - {tolerance}) / {width}) as bigint),"
                f" cast(floor(({right} + {tolerance}) / {width}) as bigint))"
            )
        ),
    )
    return (
        a2.join(b2, [*keys, "_bucket"])
        .where(f"abs({left} - {right}) <= {tolerance}")
        .drop("_bucket")
    )
