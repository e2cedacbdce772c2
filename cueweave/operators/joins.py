"""Time joins between two tracks of a media. Candidate order ties go to the lower index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.text import combine_texts
from cueweave.plans.lineage import cut_lineage
from cueweave.plans.ranges import BUCKET_MS, near_pairs, overlap_pairs


def _side(cues: DataFrame, side: str, *cols: str) -> DataFrame:
    """Key, index and span of a track with ``a_`` / ``b_`` names; times are clamped at 0."""
    return cues.select(
        "media_id", F.col("cue_idx").alias(f"{side}_idx"),
        F.greatest("start_ms", F.lit(0)).alias(f"{side}_start"), F.greatest("end_ms", F.lit(0)).alias(f"{side}_end"),
        *[F.col(c).alias(f"{side}_{c}") for c in cols],
    )


def overlap_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """``media_id, a_idx, b_idx, overlap_ms, score``; score is overlap over mean duration."""
    overlap = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    both = (F.col("a_end") - F.col("a_start")) + (F.col("b_end") - F.col("b_start"))
    return overlap_pairs(_side(a, "a"), _side(b, "b")).where(overlap > 0).select(
        "media_id", "a_idx", "b_idx", overlap.alias("overlap_ms"), (2 * overlap / both).alias("score")
    )


def overlap_best(a: DataFrame, b: DataFrame, min_score: float = 0.3) -> DataFrame:
    """Best-scoring partner of each cue, shared partners allowed."""
    pairs = overlap_candidates(a, b).where(F.col("score") > min_score)
    best = F.max_by(F.struct("b_idx", "overlap_ms", "score"), F.struct("score", (-F.col("b_idx")).alias("t")))
    return pairs.groupBy("media_id", "a_idx").agg(best.alias("m")).select(
        "media_id", "a_idx", "m.b_idx", "m.overlap_ms", "m.score"
    )


def time_candidates(a: DataFrame, b: DataFrame, tolerance_ms: int = 500) -> DataFrame:
    """``media_id, a_idx, b_idx, delta_ms``: pairs whose starts differ by at most the tolerance."""
    pairs = near_pairs(_side(a, "a").drop("a_end"), _side(b, "b").drop("b_end"), "a_start", "b_start", tolerance_ms)
    return pairs.select("media_id", "a_idx", "b_idx", F.abs(F.col("a_start") - F.col("b_start")).alias("delta_ms"))


def anchor_first(a: DataFrame, b: DataFrame, tolerance_ms: int = 2_000) -> DataFrame:
    """The first cues as anchor if they start within the tolerance."""
    left = a.where("cue_idx = 0").select("media_id", F.col("start_ms").alias("_a"))
    right = b.where("cue_idx = 0").select("media_id", F.col("start_ms").alias("_b"))
    delta = F.abs(F.col("_a") - F.col("_b"))
    return left.join(right, "media_id").where(delta <= tolerance_ms).select(
        "media_id", F.lit(0).alias("a_idx"), F.lit(0).alias("b_idx"), delta.alias("delta_ms"),
        (1.0 - delta / tolerance_ms).alias("confidence"),
    )


def anchor_scan(a: DataFrame, b: DataFrame, k: int = 10, tolerance_ms: int = 2_000, floor: float = 0.0) -> DataFrame:
    """Closest pair among the first ``k`` cues of both tracks, ties to the lower indexes.

    ``k`` is also limited by the shorter track. At most ``k`` x ``k`` pairs per media.
    """
    both = a.select("media_id", "cue_idx", "start_ms", "end_ms", F.lit(1).alias("_side")).unionByName(
        b.select("media_id", "cue_idx", "start_ms", "end_ms", F.lit(2).alias("_side"))
    )
    # One pass: how long both tracks are, and their first cues.
    mine = lambda side: F.col("_side") == side
    head = lambda side: F.collect_list(F.when(mine(side) & (F.col("cue_idx") < k), F.struct("cue_idx", "start_ms", "end_ms")))
    heads = both.groupBy("media_id").agg(
        F.least(F.lit(k), F.count_if(mine(1)), F.count_if(mine(2))).alias("_k"), head(1).alias("_a"), head(2).alias("_b")
    ).where("_k > 0")
    heads = cut_lineage(heads, "heads")
    left, right = (heads.select("media_id", "_k", F.inline(c)).where("cue_idx < _k").drop("_k") for c in ("_a", "_b"))
    pairs = time_candidates(left, right, tolerance_ms)
    best = pairs.groupBy("media_id").agg(F.min(F.struct("delta_ms", "a_idx", "b_idx")).alias("m"))
    return best.select(
        "media_id", "m.a_idx", "m.b_idx", "m.delta_ms",
        F.greatest(F.lit(floor), 1.0 - F.col("m.delta_ms") / tolerance_ms).alias("confidence"),
    )


def align_from_anchor(a: DataFrame, b: DataFrame, anchors: DataFrame, tolerance_ms: int = 2_000) -> DataFrame:
    """Nearest partner on the same side of the anchor after shifting by the anchor's offset.

    ``anchors`` is ``media_id, a_idx, b_idx, confidence``. Partners may repeat.
    After the anchor ties go to the lower, before it to the higher index.
    """
    a, b = (cut_lineage(side.select("media_id", "cue_idx", "start_ms"), "starts") for side in (a, b))
    at_a = a.select("media_id", F.col("cue_idx").alias("a_idx"), F.col("start_ms").alias("_a"))
    at_b = b.select("media_id", F.col("cue_idx").alias("b_idx"), F.col("start_ms").alias("_b"))
    anchors = cut_lineage(anchors, "anchors")
    plan = anchors.join(at_a, ["media_id", "a_idx"]).join(at_b, ["media_id", "b_idx"]).select(
        "media_id", F.col("a_idx").alias("_anchor_a"), F.col("b_idx").alias("_anchor_b"),
        (F.col("_b") - F.col("_a")).alias("_off"), F.col("confidence").alias("_c"),
    )
    plan = cut_lineage(plan, "plan")
    side = F.when(F.col("cue_idx") > F.col("_anchor_a"), 1).when(F.col("cue_idx") < F.col("_anchor_a"), -1)
    left = a.join(plan, "media_id").select(
        "media_id", F.col("cue_idx").alias("a_idx"), (F.col("start_ms") + F.col("_off")).alias("_want"), side.alias("_side"), "_c"
    ).where("_side is not null")
    side_b = F.when(F.col("cue_idx") > F.col("_anchor_b"), 1).when(F.col("cue_idx") < F.col("_anchor_b"), -1)
    right = b.join(plan.select("media_id", "_anchor_b"), "media_id").select(
        "media_id", F.col("cue_idx").alias("b_idx"), F.col("start_ms").alias("_at"), side_b.alias("_side")
    ).where("_side is not null")
    pairs = near_pairs(left, right, "_want", "_at", tolerance_ms, ("media_id", "_side"))
    delta = F.abs(F.col("_want") - F.col("_at"))
    best = pairs.groupBy("media_id", "a_idx", "_side", "_c").agg(
        F.min(F.struct(delta.alias("d"), (F.col("b_idx") * F.col("_side")).alias("t"), "b_idx")).alias("m")
    )
    return best.select(
        "media_id", "a_idx", "m.b_idx", F.col("m.d").alias("delta_ms"),
        F.greatest(F.lit(0.5), F.col("_c") * (1.0 - F.col("m.d") / tolerance_ms)).alias("confidence"),
    )


#: Rows of the sweep: what a span gives to one bucket. Marks that lie elsewhere are -1.
_SEGMENT = "media_id {}, start_ms bigint, end_ms bigint, text1 string, text2 string"


def _segment_sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (media_id, _bucket, _at); state restarts with each bucket.

    Holds the marks ahead and the spans that have begun, the lowest index of each
    side on top. A mark is settled once all rows up to it are read; the next one
    ends its segment.
    """
    group, marks, begun, last = None, [], ([], []), None
    out: list[tuple] = []

    def settle(upto: float) -> None:
        nonlocal last
        while marks and marks[0] < upto:
            mark = heapq.heappop(marks)
            if last is not None and last[0] == mark:
                continue
            if last is not None and last[1] is not None:
                out.append((group[0], last[0], mark, *last[1]))
            texts = []
            for spans in begun:
                while spans and spans[0][2] <= mark:
                    heapq.heappop(spans)
                texts.append(spans[0][3] if spans else None)
            last = (mark, texts if any(texts) else None)

    def table() -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["media_id", "start_ms", "end_ms", "text1", "text2"])
        out.clear()
        return rows

    number = 0
    for pdf in batches:
        columns = [pdf[c].tolist() for c in ("media_id", "_bucket", "_at", "_side", "_idx", "_end", "_live", "_mark1", "_mark2", "text")]
        for media, bucket, at, side, idx, end, live, mark1, mark2, text in zip(*columns, strict=True):
            if (media, bucket) != group:
                settle(float("inf"))
                group, begun, last = (media, bucket), ([], []), None
            settle(at)
            if live:
                number += 1  # equal indexes: texts are not compared
                heapq.heappush(begun[side - 1], (idx, number, end, text))
            for mark in (mark1, mark2):
                if mark >= 0:
                    heapq.heappush(marks, mark)
            if len(out) >= 10_000:
                yield table()
        yield table()
    settle(float("inf"))
    yield table()


def timeline_segments(a: DataFrame, b: DataFrame, top: str = "first") -> DataFrame:
    """Elementary intervals between all boundaries with the first active cue of each track.

    One exchange by (media, bucket) moves each cue once, with a copy for every
    other bucket it reaches, and a sweep through the bucket gives its segments. The
    last one of a bucket ends at the first mark of the next bucket that has one;
    these are found beforehand, one time per bucket.
    """
    def marks(cues: DataFrame) -> DataFrame:
        return cues.select("media_id", F.explode(F.array(F.col("start_ms").cast("bigint"), F.col("end_ms").cast("bigint"))).alias("t")).where("t >= 0")

    bucket = lambda t: F.call_function("div", t, F.lit(BUCKET_MS))
    firsts = marks(a).unionByName(marks(b)).where("media_id is not null").groupBy("media_id", bucket(F.col("t")).alias("_bucket")).agg(F.min("t").alias("t"))
    none, no = F.lit(-1).cast("bigint"), F.lit(0)
    ends = firsts.select(
        "media_id", "_bucket", F.lead("t").over(Window.partitionBy("media_id").orderBy("_bucket")).alias("_at"), F.lit(1).alias("_side"),
        no.alias("_idx"), none.alias("_end"), F.lit(False).alias("_live"),
    ).where("_at is not null").withColumns({"_mark1": F.col("_at"), "_mark2": none, "text": F.lit(None).cast("string")})

    def spans(cues: DataFrame, side: int) -> DataFrame:
        start, end = (F.greatest(F.col(c), F.lit(0)).cast("bigint") for c in ("start_ms", "end_ms"))
        reached = F.sequence(bucket(start), bucket(F.greatest(start, end - 1)))
        each = cues.where("media_id is not null").select(
            "media_id", "cue_idx", start.alias("_start"), end.alias("_end"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "text",
            F.explode(F.array_union(reached, F.array(bucket(end)))).alias("_bucket"),
        )
        here = lambda raw, t: F.when((F.col(raw) >= 0) & (bucket(F.col(t)) == F.col("_bucket")), F.col(t)).otherwise(none)
        live = (F.col("_start") < F.col("_end")) & (bucket(F.col("_end") - 1) >= F.col("_bucket")) & F.col("cue_idx").isNotNull()
        return each.select(
            "media_id", "_bucket", F.greatest(F.least("_start", "_end"), F.col("_bucket") * BUCKET_MS).alias("_at"), F.lit(side).alias("_side"),
            F.coalesce("cue_idx", no).alias("_idx"), "_end", live.alias("_live"), here("_s", "_start").alias("_mark1"), here("_e", "_end").alias("_mark2"),
            F.when(live, F.col("text")).alias("text"),
        )

    rows = spans(a, 1).unionByName(spans(b, 2)).unionByName(ends)
    kind = rows.schema["media_id"].dataType.simpleString()
    both = rows.repartition("media_id", "_bucket").sortWithinPartitions("media_id", "_bucket", "_at").mapInPandas(_segment_sweep, _SEGMENT.format(kind))
    text = combine_texts(F.col("text1"), F.col("text2"), top)
    return both.select("media_id", "start_ms", "end_ms", text.alias("text")).where("text <> ''")


def merge_from_alignments(a: DataFrame, b: DataFrame, pairs: DataFrame, reference: DataFrame, top: str = "first") -> DataFrame:
    """Aligned pairs with the reference side's timing, plus the leftovers of both tracks.

    ``pairs`` is ``media_id, a_idx, b_idx`` (an index may occur in several
    pairs), ``reference`` is ``media_id, reference`` (1 or 2). A pair has the
    style of its first side, or else of its second, and no raw text; leftovers
    keep both.
    """
    def side(cues: DataFrame, idx: str, mark: str) -> DataFrame:
        for name in ("style", "raw"):
            if name not in cues.columns:
                cues = cues.withColumn(name, F.lit(None).cast("string"))
        return cues.select("media_id", F.col("cue_idx").alias(idx), *[F.col(c).alias(mark + c) for c in ("start_ms", "end_ms", "text", "style", "raw")])

    left, right = side(a, "a_idx", "a_").withColumn("_one", F.lit(True)), side(b, "b_idx", "b_").withColumn("_two", F.lit(True))
    # Pairs learn their reference before they meet a text. Two full joins give pairs and both leftovers, so that the texts
    # of side 2 move once. A cue that a pair names is no leftover, even if the pair's other cue isn't there.
    known = reference.select("media_id", "reference", F.lit(True).alias("_known"))
    named = pairs.select("media_id", "a_idx", "b_idx", F.lit(True).alias("_pair")).join(known, "media_id", "left")
    # Cues of side 1 without a pair match nothing; their own index spreads them.
    one = left.join(named, ["media_id", "a_idx"], "full").withColumn("_key", F.when(F.col("b_idx").isNull(), F.col("a_idx")).otherwise(0))
    every = one.join(right.withColumn("_key", F.lit(0)), ["media_id", "b_idx", "_key"], "full")
    pair, only_a, only_b = F.col("_pair").isNotNull(), F.col("_one").isNotNull(), F.col("_two").isNotNull()
    both = pair & only_a & only_b
    kept = every.where((both & F.col("_known").isNotNull()) | ~pair).withColumn("_both", both).withColumn("_first", only_a)
    none, no_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    style = F.coalesce(F.nullif("a_style", F.lit("")), F.nullif("b_style", F.lit("")))

    def of(joined: Column, name: str) -> Column:
        return F.when(F.col("_both"), joined).when(F.col("_first"), F.col(f"a_{name}")).otherwise(F.col(f"b_{name}")).alias(name)

    def timed(name: str) -> Column:
        return of(F.when(F.col("reference") == 1, F.col(f"a_{name}")).otherwise(F.col(f"b_{name}")), name)

    return kept.select(
        "media_id", F.when(F.col("_both") | F.col("_first"), F.col("a_idx")).otherwise(none).alias("idx1"),
        F.when(F.col("_both") | ~F.col("_first"), F.col("b_idx")).otherwise(none).alias("idx2"), timed("start_ms"), timed("end_ms"),
        of(combine_texts(F.col("a_text"), F.col("b_text"), top), "text"), of(style, "style"), of(no_text, "raw"),
        F.when(F.col("_both"), "both").when(F.col("_first"), "first").otherwise("second").alias("kind"),
    )
