"""SimHash near-duplicates by a Gray-order hierarchical index.

1. ``fingerprints``: one pass over the texts, numpy inside Arrow batches.
2. ``links``: different fingerprints at ``max_bits`` or fewer differing bits. A
   fingerprint goes to the shuffle keys of ``masks``: whatever ``max_bits`` bits
   differ, one mask covers none of them, so linked fingerprints meet under some
   key, and a cluster of near copies is spread over its keys. Inside a partition
   the fingerprints are sorted by Gray rank; neighbours in that order share
   leading bits, so a group's common bits (a masked pattern) are factored out
   into upper nodes, and a search adds up a query's differences on its way down
   and leaves a whole group as soon as they exceed ``max_bits``.
   Only links that join two parts of the partition's forest leave the task, so a
   cluster of m fingerprints sends at most m rows, never its pairs.
3. ``components``: alternating stars over the links left.

Copies share a fingerprint and are never compared with each other.

Defined results: a null or wordless text has fingerprint zero, linked like any
other; a null id is skipped when the smallest id of a group is taken; rows that
repeat come out as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import slices, texts
from cueweave.llm.components import components
from cueweave.plans.lineage import cut_lineage

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: Fingerprints under one lowest node, children under an upper one.
LEAF, FAN = 16, 8
#: Most (query, node) pairs that a search holds at once.
FRONTIER = 2_000_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority bits over the hashes of all shingles; 0 without a word."""
    parts = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not parts:
        return 0
    body = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(body, SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    first = np.concatenate([[0], ends[:-words]]).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t.as_py().encode("utf-8", "surrogatepass"), words) for t in batch.column("text")]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "fp": pa.array(np.array(found, np.uint64).view(np.int64)),
            })

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- the index -----------------------------------------------------------------

def blocks(width: int, parts: int) -> list[int]:
    """Sizes of ``parts`` blocks over ``width`` bits, as equal as can be."""
    return [width // parts + (i < width % parts) for i in range(parts)]


def _cut(positions: list[int], parts: int) -> list[list[int]]:
    out, at = [], 0
    for size in blocks(len(positions), parts):
        out.append(positions[at : at + size])
        at += size
    return out


def masks(max_bits: int) -> list[int]:
    """Masks of which one at least misses any ``max_bits`` bits.

    Of ``max_bits + 1`` blocks one is free of differences, and of as many parts
    of the other bits again one: their union is a mask, (max_bits + 1)^2 in all.
    """
    out = []
    for block in _cut(list(range(64)), max_bits + 1):
        rest = [p for p in range(64) if p not in block]
        out += [sum(1 << p for p in [*block, *part]) for part in _cut(rest, max_bits + 1)]
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order below nodes that hold the bits their group shares."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, zeros, levels, size = self.codes, ~self.codes, [], LEAF
        while True:
            at = np.arange(0, len(ones), size)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            levels.append((ones, ones | zeros))  # shared pattern, mask of the shared bits
            size = FAN
            if len(ones) <= FAN:
                break
        self.levels = levels[::-1]

    def search(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of codes at most ``max_bits`` bits apart, a part at a time."""
        n, top = len(self.codes), len(self.levels[0][0])
        step = max(1, FRONTIER // (top * 64))
        for at in range(0, n, step):
            query = np.arange(at, min(n, at + step))
            q, node = np.repeat(query, top), np.tile(np.arange(top), len(query))
            yield from self._below(0, q, node, np.zeros(len(q), np.uint8), None, max_bits)

    def _below(self, level, q, node, differ, known, max_bits):
        """``differ``: differences counted in the bits the parents share (``known``)."""
        span = LEAF * FAN ** (len(self.levels) - 1 - level)
        pattern, mask = self.levels[level]
        fresh = mask[node] if known is None else mask[node] & ~known
        differ = differ + np.bitwise_count((self.codes[q] ^ pattern[node]) & fresh)
        go = (differ <= max_bits) & ((node + 1) * span > q)  # groups that end before the query are another's search
        q, node, differ = q[go], node[go], differ[go]
        last = level + 1 == len(self.levels)
        fan, below = (LEAF, len(self.codes)) if last else (FAN, len(self.levels[level + 1][0]))
        part = max(1, FRONTIER // fan)
        for at in range(0, len(q), part):
            cut = slice(at, at + part)
            child = (node[cut, None] * fan + np.arange(fan)).ravel()
            q2, real = np.repeat(q[cut], fan), child < below
            if last:
                real &= child > q2
                i, j = q2[real], child[real]
                near = np.bitwise_count(self.codes[i] ^ self.codes[j]) <= max_bits
                yield i[near], j[near]
            else:
                yield from self._below(
                    level + 1, q2[real], child[real], np.repeat(differ[cut], fan)[real], np.repeat(mask[node[cut]], fan)[real], max_bits
                )


def join_parts(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union of the parts of ``i`` and ``j`` in a forest of depth one (roots are the smallest positions)."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def forest(codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, code of its part's root) for every code that isn't a root."""
    index = GrayIndex(np.unique(codes))
    parent = np.arange(len(index.codes))
    for i, j in index.search(max_bits):
        join_parts(parent, i, j)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return index.codes[child], index.codes[parent[child]]


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``src, dst``: a spanning forest, per partition, of the links between the column ``fp`` of ``nodes``."""
    as_long = [int(np.array(m, np.uint64).view(np.int64)) for m in masks(max_bits)]
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(as_long)])
    dealt = nodes.select("fp", F.explode(keys).alias("key")).select("fp", "key.mask", "key.bits").repartition("mask", "bits").select("fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.unique(b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if held:
            src, dst = forest(np.concatenate(held).view(np.uint64), max_bits)
            for at in range(0, len(src), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.record_batch({"src": src[cut].view(np.int64), "dst": dst[cut].view(np.int64)})

    return dealt.mapInArrow(run, "src long, dst long")


# ---- groups of documents ----------------------------------------------------------

def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` (smallest id reachable by links) for every document."""
    found = cut_lineage(fingerprints(docs, words), "simhash")
    first = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"), max_bits))
    whole = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = whole.join(smallest, "root").select("fp", "component_id")
    return found.join(ids, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The smallest id of each group stays (rows without an id stay too), with the columns of ``docs``."""
    gone = near_duplicates(docs, words, max_bits).where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_digits(fp: str = "fp"):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
