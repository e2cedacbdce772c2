"""Benchmark decontamination by a distributed positional inverted index.

``index`` stores the postings of every training token: a row per slice of the
documents holds the slice's terms, and for each term the sorted places where it
stands. The index is parted by documents, not by terms, so a word that a third
of all places hold is spread over all rows, and a phrase never needs the
postings of two rows. ``search`` reads it row by row: a window whose words are
not all in the row is out at once; for the others the shortest list gives the
candidates (place less the word's place in the window), and the next lists, from
rare to frequent, keep those that have the word at its offset (exact phrase) or
at most ``slack`` words beside it (proximity). Nothing is shuffled.

The benchmark is looked up in blocks of ``ITEM_WORDS`` words: what is broadcast
is bounded, and a larger benchmark is searched block after block.

Words: runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lowered. A window
is ``WINDOW`` consecutive words of an item, or all of a shorter item.

Defined results: a null or empty text has no words and is never hit; an item
without words has no window; rows that share an item id are one item (null counts
as an id, written as an empty string); rows of documents that repeat, or lack an
id, come out as often as they stand; empty tables give no rows and no hits; other
columns of either table are not touched. A window that is near at several places
counts once for an item; a near place has each word of the window at most
``slack`` words from where the phrase would have it, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import buffers, give_back, lower_ascii, slices, starts, string_array, strings, texts
from cueweave.plans.lineage import cut_lineage

WINDOW, SLACK = 10, 2
#: Places left free between two documents of an index row: no window with its slack reaches across.
APART = 64
#: Words of benchmark items that are looked up at once, and candidates that a search holds at once.
ITEM_WORDS, FRONTIER = 1_000_000, 1_000_000
#: Rows of the index, each of up to ``SLICE_BYTES`` of text, that are held at once where it is written and read.
INDEX_ROWS = 2

_KEPT = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def split_words(array: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words, each text's words as numbers of those, and offsets."""
    data, offsets = buffers(array)
    spaced = np.frombuffer(data.tobytes().translate(_KEPT), np.uint8)
    lists = pc.ascii_split_whitespace(string_array(spaced, offsets))
    parts = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = np.concatenate([[0], np.cumsum(real)])[parts - parts[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


# ---- the index -------------------------------------------------------------------

def _list(values, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets, np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def index(docs: DataFrame) -> DataFrame:
    """A row per slice: ``doc_id, begin, n_words`` of its documents, its ``term`` list, where each one's list begins in ``position`` (``first``), and ``position``."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, codes, offsets = split_words(strings(batch))
            n_words = np.diff(offsets)
            begin = offsets[:-1] + APART * np.arange(batch.num_rows)
            place = np.arange(len(codes)) + np.repeat(begin - offsets[:-1], n_words)
            order = np.argsort(codes, kind="stable")
            first = starts(np.bincount(codes, minlength=len(words)))
            yield pa.record_batch({
                "doc_id": _list(batch.column("doc_id"), [0, batch.num_rows]), "begin": _list(begin.astype(np.int32), [0, batch.num_rows]),
                "n_words": _list(n_words, [0, batch.num_rows]), "term": _list(words.cast(pa.string()), [0, len(words)]),
                "first": _list(first.astype(np.int32), [0, len(first)]), "position": _list(place[order].astype(np.int32), [0, len(place)]),
            })

    return rows.mapInArrow(
        run, f"doc_id array<{kind}>, begin array<int>, n_words array<long>, term array<string>, first array<int>, position array<int>"
    )


# ---- the benchmark ----------------------------------------------------------------

@dataclass
class Windows:
    """Different words; the windows' words as numbers of those (-1 behind the end), their lengths and items."""

    words: pa.Array
    terms: np.ndarray
    length: np.ndarray
    item: np.ndarray
    names: list[str]


def windows(names: list[str], array: pa.Array) -> Windows:
    """All windows of items; ``names`` are their ids as strings, one per text."""
    words, codes, offsets = split_words(array)
    n_words = np.diff(offsets)
    count = np.where(n_words == 0, 0, np.maximum(n_words - WINDOW + 1, 1))
    item = np.repeat(np.arange(len(names)), count)
    at = offsets[:-1][item] + np.arange(len(item)) - np.repeat(starts(count)[:-1], count)
    length = np.minimum(n_words[item], WINDOW)
    places = at[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    terms = np.where(inside, codes[np.minimum(places, max(len(codes) - 1, 0))], -1) if len(codes) else np.zeros((0, WINDOW), np.int64)
    return Windows(words, terms, length, item, names)


def item_blocks(items: DataFrame, words: int = ITEM_WORDS) -> Iterator[Windows]:
    """The windows of all items, in blocks of about ``words`` words; an item is never cut."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = F.size(F.split(lower_ascii(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    total = named.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    n_blocks = -(-total // words)
    for k in range(n_blocks):
        part = named.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).toArrow().combine_chunks()
        array = part.column("text").chunk(0) if part.num_rows else pa.array([], pa.string())
        yield windows(part.column("item").to_pylist(), array)


# ---- search ----------------------------------------------------------------------

def intersect(found: Windows, term: pa.Array, first: np.ndarray, position: np.ndarray, slack: int) -> tuple[np.ndarray, ...]:
    """(window, start, place of its rarest word, exact) of all places of a row where a window stands or is near."""
    local = pc.index_in(found.words.cast(term.type), value_set=term)
    local = pc.fill_null(local, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    pad = found.terms < 0
    of = np.where(pad, -1, local[found.terms]) if len(local) else found.terms
    alive = np.flatnonzero(((of >= 0) | pad).all(axis=1))
    if not len(alive):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    of, pad = of[alive], pad[alive]
    size = np.where(pad, np.iinfo(np.int64).max, np.diff(first)[of])
    rare_first = np.argsort(size, axis=1, kind="stable")
    keys = np.repeat(np.arange(len(term)) << 32, np.diff(first)) | position
    least = np.take_along_axis(size, rare_first[:, :1], 1)[:, 0]
    parts, at, ends = [], 0, np.cumsum(least)
    while at < len(alive):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER // (2 * slack + 1), side="right")))
        parts.append(_candidates(of[at:stop], pad[at:stop], rare_first[at:stop], first, position, keys, slack, alive[at:stop]))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _candidates(of, pad, rare_first, first, position, keys, slack, names):
    rarest = np.take_along_axis(of, rare_first[:, :1], 1)[:, 0]
    count = (first[1:] - first[:-1])[rarest]
    out = starts(count)
    w = np.repeat(np.arange(len(of)), count)
    anchor = position[np.repeat(first[:-1][rarest] - out[:-1], count) + np.arange(out[-1])].astype(np.int64)
    start = anchor - rare_first[w, 0]
    if slack:  # the rarest word itself may stand beside its place
        wide = 2 * slack + 1
        w, anchor = np.repeat(w, wide), np.repeat(anchor, wide)
        start = np.repeat(start, wide) + np.tile(np.arange(-slack, slack + 1), len(start))
        _, one = np.unique((w << 33) + start + APART, return_index=True)
        w, anchor, start = w[one], anchor[one], start[one]
    for c in range(rare_first.shape[1]):
        j = rare_first[w, c]
        skip = pad[w, j]
        keep = skip | _stands(keys, of[w, j], start + j, slack)
        w, anchor, start = w[keep], anchor[keep], start[keep]
        if not len(w):
            break
    exact = np.ones(len(w), bool)
    for j in range(of.shape[1] if slack else 0):
        exact &= pad[w, j] | _stands(keys, of[w, j], start + j, 0)
    return names[w], start, anchor, exact


def _stands(keys: np.ndarray, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
    """Is the term at the place, or at most ``slack`` beside it?"""
    low, high = np.maximum(place - slack, 0), place + slack
    at = np.searchsorted(keys, term << 32 | low)
    return (high >= 0) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= (term << 32 | np.maximum(high, 0)))


_FOUND = pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())]))
_FOUND_SQL = "array<struct<doc:int,item:string,start:int,length:int,exact:boolean>>"
_INDEX = ("term", "first", "position")


def _search_block(rows: DataFrame, found: Windows, slack: int, last: bool) -> DataFrame:
    """``rows`` of the index with their matches added; the postings go after the last block."""
    shared = rows.sparkSession.sparkContext.broadcast(found)
    names = [c for c in rows.columns if c != "found" and not (last and c in _INDEX)]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                flat = {c: row.column(c).flatten() for c in ("begin", *_INDEX)}
                begin, first, position = (flat[c].to_numpy(zero_copy_only=False) for c in ("begin", "first", "position"))
                block = shared.value
                w, start, anchor, exact = intersect(block, flat["term"], first.astype(np.int64), position.astype(np.int64), slack)
                doc = np.searchsorted(begin, anchor, side="right") - 1
                matches = pa.StructArray.from_arrays([
                    pa.array(doc, pa.int32()), pa.array(block.names, pa.string()).take(pa.array(block.item[w])),
                    pa.array(start - begin[doc] if len(doc) else start, pa.int32()), pa.array(block.length[w], pa.int32()), pa.array(exact),
                ], fields=list(_FOUND.value_type))
                before = row.column("found").flatten() if "found" in fields else matches[:0]
                matches = pa.concat_arrays([before.cast(matches.type), matches])
                yield pa.record_batch([*(row.column(c) for c in names), _list(matches, [0, len(matches)])], names=[*names, "found"])
            give_back()

    return rows.mapInArrow(run, ", ".join([*(f"{c} {fields[c]}" for c in names), f"found {_FOUND_SQL}"]))


def search(postings: DataFrame, items: DataFrame, slack: int = SLACK, words: int = ITEM_WORDS) -> DataFrame:
    """``doc_id, n_words, found`` for every document; ``found``: ``item, start, length, exact`` of each place, words from 0."""
    if not 0 <= slack <= (APART - WINDOW) // 4:
        raise ValueError(f"slack from 0 to {(APART - WINDOW) // 4}")
    nothing = windows([], pa.array([], pa.string()))
    blocks = list(item_blocks(items, words)) or [nothing]
    rows = postings
    for k, block in enumerate(blocks):
        rows = _search_block(rows, block, slack, k + 1 == len(blocks))
        if k + 1 < len(blocks):
            rows = cut_lineage(rows, "searched", INDEX_ROWS)
    kind = rows.schema["doc_id"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_words, found = (batch.column(c).slice(k, 1).flatten() for c in ("doc_id", "n_words", "found"))
                doc = found.field("doc").to_numpy(zero_copy_only=False)
                found = found.take(pa.array(np.argsort(doc, kind="stable")))
                parts = [found.field(c) for c in ("item", "start", "length", "exact")]
                kept = pa.StructArray.from_arrays(parts, fields=list(_FOUND.value_type)[1:])
                yield pa.record_batch({"doc_id": ids, "n_words": n_words, "found": _list(kept, starts(np.bincount(doc, minlength=len(ids))))})

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, found {_FOUND_SQL.replace('doc:int,', '')}")


def covered(found: Column) -> Column:
    """Words inside at least one of the spans."""
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda m: F.sequence(m["start"], m["start"] + m["length"] - 1)))))


def report(found: DataFrame) -> DataFrame:
    """Of ``search``'s rows: ``doc_id, n_words, n_hit, n_items, items, contaminated, near_items``; ``items`` sorted as strings."""
    exact = F.filter("found", lambda m: m["exact"])
    names = lambda some: F.array_sort(F.array_distinct(F.transform(some, lambda m: m["item"])))
    return found.select("doc_id", "n_words", covered(exact).cast("long").alias("n_hit"), names(exact).alias("items"), names(F.col("found")).alias("near_items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "near_items"
    )


def contamination(docs: DataFrame, items: DataFrame, slack: int = SLACK) -> DataFrame:
    """``report`` of documents against benchmark items, through a stored index."""
    return report(search(cut_lineage(index(docs), "postings", INDEX_ROWS), items, slack))
