"""One-to-one matching of two tracks.

Both operators reproduce a strictly sequential rule exactly, without loading a
media into memory: candidates are sorted by the rule's own order and streamed
through a small sweep that only remembers what is already taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.plans.lineage import cut_lineage

CHUNK = 4096
_PICKS = "media_id bigint, _chunk bigint, src_idx int, ref_idx int"


def _serial_sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (media_id, _chunk, src_idx, ref_idx); state restarts with each chunk.

    Among the free references of a source the first one sets the bar (its
    overlap score, or its nearness if it does not overlap); a later one only
    wins with a strictly larger overlap score.
    """
    group = source = None
    taken: set[int] = set()
    base = best = 0.0
    choice = None
    for pdf in batches:
        out = []
        rows = zip(pdf.media_id.tolist(), pdf._chunk.tolist(), pdf.src_idx.tolist(),
                   pdf.ref_idx.tolist(), pdf.score.tolist(), pdf.near.tolist())
        for media, chunk, src, ref, score, near in rows:
            if (media, chunk, src) != source:
                if choice is not None:
                    out.append((*source, choice))
                    taken.add(choice)
                if (media, chunk) != group:
                    group, taken = (media, chunk), set()
                source, choice = (media, chunk, src), None
            if ref in taken:
                continue
            if choice is None:
                base = score if score > 0 else near
                if base > 0:
                    choice, best = ref, base
            elif score > best:
                choice, best = ref, score
        yield pd.DataFrame(out, columns=["media_id", "_chunk", "src_idx", "ref_idx"])
    if choice is not None:
        yield pd.DataFrame([(*source, choice)], columns=["media_id", "_chunk", "src_idx", "ref_idx"])


def _sweep(edges: DataFrame) -> DataFrame:
    return (
        edges.repartition("media_id", "_chunk")
        .sortWithinPartitions("media_id", "_chunk", "src_idx", "ref_idx")
        .mapInPandas(_serial_sweep, _PICKS)
    )


def match_serial(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Sources in index order take their best free reference: ``media_id, src_idx, ref_idx``.

    ``edges`` has ``media_id, src_idx, ref_idx, score, near``: ``score`` > 0
    for overlapping candidates, ``near`` > 0 for merely close ones, 0 otherwise.

    A media is cut into chunks of ``chunk`` sources, which are swept in
    parallel. Where references of a chunk are taken by an earlier one, the chunk
    is swept again without them, and so on with the chunks that this disturbs.
    Chunk *k* is final once all before it are, so as many passes as there are
    chunks reach the sequential result; conflicts seldom travel through a whole
    chunk, so two or three are usual.
    """
    edges = cut_lineage(
        edges.select(
            "media_id", F.col("src_idx").cast("int"), F.col("ref_idx").cast("int"),
            F.col("score").cast("double").alias("score"), F.col("near").cast("double").alias("near"),
            F.call_function("div", F.col("src_idx"), F.lit(chunk)).alias("_chunk"),
        ),
        "edges",
    )
    last = edges.agg(F.max("_chunk")).first()[0] or 0
    picks = cut_lineage(_sweep(edges), "picks")
    key = ["media_id", "_chunk", "ref_idx"]
    later = edges.where("_chunk > 0").select(*key).distinct()
    gone = None
    for _ in range(last + 1):
        taken = picks.groupBy("media_id", "ref_idx").agg(F.min("_chunk").alias("_by"))
        now = cut_lineage(later.join(taken, ["media_id", "ref_idx"]).where("_by < _chunk").select(*key), "taken")
        moved = now if gone is None else now.join(gone, key, "left_anti").unionByName(gone.join(now, key, "left_anti"))
        disturbed = cut_lineage(moved.select("media_id", "_chunk").distinct(), "disturbed")
        if disturbed.isEmpty():
            break
        mine = ["media_id", "_chunk"]
        again = _sweep(edges.join(disturbed, mine, "left_semi").join(now, key, "left_anti"))
        picks = cut_lineage(picks.join(disturbed, mine, "left_anti").unionByName(again), "picks")
        gone = now
    return picks.drop("_chunk")


def signature_pairs(src: DataFrame, ref: DataFrame) -> DataFrame:
    """``media_id, src_sig, ref_sig, n_shared, n_src, n_ref`` of cues with a ``tokens`` array.

    Cues with equal token sets are interchangeable, so they are counted first
    and only distinct token sets meet in the join: a token that most cues of a
    media carry does not multiply into cue pairs. Empty sets go by the join: a filter
    on them would be pushed below the tokens and find these a second time, as would
    the one that the optimizer adds to the inner form of explode.
    """
    def groups(cues: DataFrame, side: str) -> DataFrame:
        return cues.groupBy("media_id", F.col("tokens").alias(f"{side}_sig")).agg(F.count("*").alias(f"n_{side}"))

    left = groups(src, "src").withColumn("token", F.explode_outer("src_sig"))
    right = groups(ref, "ref").withColumn("token", F.explode_outer("ref_sig"))
    return left.join(right, ["media_id", "token"]).groupBy(
        "media_id", "src_sig", "ref_sig", "n_src", "n_ref"
    ).agg(F.count("*").cast("int").alias("n_shared"))


def best_per_reference(edges: DataFrame, weight: str) -> DataFrame:
    """Greedy by weight when every source has a single candidate: the best source of each reference."""
    order = F.struct(F.col(weight), (-F.col("src_idx")).alias("_s"))
    rest = [c for c in edges.columns if c not in ("media_id", "ref_idx")]
    return edges.groupBy("media_id", "ref_idx").agg(
        F.max_by(F.struct(*rest), order).alias("_e")
    ).select("media_id", "ref_idx", *[F.col(f"_e.{c}").alias(c) for c in rest])


_EDGES = "media_id bigint, src_idx int, ref_idx int, weight double, accepted boolean"


def _greedy_sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges sorted by (media_id, _chunk, weight desc, src_idx, ref_idx); state restarts with each chunk.

    A chunk has all edges of its sources. An edge is accepted if nothing better
    is open at its ends here, and no better edge reaches its reference from
    elsewhere (``_w, _s, _r``: the best of those, or null); it stays open if
    something better is; it goes if one of its ends is taken.
    """
    group = None
    taken: tuple[set[int], set[int]] = (set(), set())
    open_: tuple[set[int], set[int]] = (set(), set())
    for pdf in batches:
        out = []
        columns = [pdf[c].tolist() for c in ("media_id", "_chunk", "weight", "src_idx", "ref_idx", "_w", "_s", "_r")]
        for media, chunk, weight, src, ref, w, s, r in zip(*columns, strict=True):
            if (media, chunk) != group:
                group, taken, open_ = (media, chunk), (set(), set()), (set(), set())
            if src in taken[0] or ref in taken[1]:
                continue
            beaten = w == w and w is not None and (-w, s, r) < (-weight, src, ref)
            ends = open_ if beaten or src in open_[0] or ref in open_[1] else taken
            ends[0].add(src)
            ends[1].add(ref)
            out.append((media, src, ref, weight, ends is taken))
        yield pd.DataFrame(out, columns=["media_id", "src_idx", "ref_idx", "weight", "accepted"])


def match_greedy(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Weight-greedy matching of arbitrary edges by (weight desc, source, reference).

    Chunks of ``chunk`` sources are swept in the rule's order. What an edge of
    another chunk could still overrule stays open for the next pass, whose
    chunks begin half a chunk later; a chain of edges that block each other is
    settled a chunk at a time. The best edge left is accepted in every pass, so
    the passes end. Open edges are written between passes, so a lost executor
    costs one.
    """
    kind = dict(edges.dtypes)["weight"]
    left = cut_lineage(edges.select("media_id", F.col("src_idx").cast("int"), F.col("ref_idx").cast("int"), F.col("weight").cast("double")), "greedy")
    accepted, end = [], ["media_id", "ref_idx"]
    passes = 2 * ((left.agg(F.max("src_idx")).first()[0] or 0) + 1)
    for k in range(passes):
        dealt = left.withColumn("_chunk", F.call_function("div", F.col("src_idx") + k % 2 * (chunk // 2), F.lit(chunk)))
        # The best edge at each reference, and the best that comes from another chunk than that one's.
        order = F.struct((-F.col("weight")).alias("w"), F.col("src_idx").alias("s"), F.col("ref_idx").alias("r"))
        per_chunk = dealt.groupBy(*end, "_chunk").agg(F.min(order).alias("_o"))
        first = per_chunk.groupBy(*end).agg(F.min(F.struct("_o", "_chunk")).alias("_f"))
        second = per_chunk.join(first, end).where(F.col("_chunk") != F.col("_f._chunk")).groupBy(*end).agg(F.min("_o").alias("_o2"))
        ends = first.join(second, end, "left").select(*end, F.col("_f._o").alias("_o1"), F.col("_f._chunk").alias("_c1"), "_o2")
        other = F.when(F.col("_c1") == F.col("_chunk"), F.col("_o2")).otherwise(F.col("_o1"))
        rows = dealt.join(ends, end).withColumn("_x", other).select(
            "media_id", "_chunk", "weight", "src_idx", "ref_idx", (-F.col("_x.w")).alias("_w"), F.col("_x.s").alias("_s"), F.col("_x.r").alias("_r")
        )
        swept = cut_lineage(
            rows.repartition("media_id", "_chunk").sortWithinPartitions("media_id", "_chunk", F.desc("weight"), "src_idx", "ref_idx")
            .mapInPandas(_greedy_sweep, _EDGES), "greedy",
        )
        won = swept.where("accepted").drop("accepted")
        accepted.append(won)
        left = cut_lineage(swept.where("not accepted").drop("accepted").join(won.select(*end), end, "left_anti"), "greedy")
        if left.isEmpty():
            break
    out = accepted[0]
    for more in accepted[1:]:
        out = out.unionByName(more)
    return out.withColumn("weight", F.col("weight").cast(kind))

