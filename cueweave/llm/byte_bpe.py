"""Byte-level BPE: encode texts to token ids and back.

A slice of texts is cut at spaces and reduced to its different units with Arrow
(C++), the units to their different pre-tokens, and those are merged together on
length-bucketed matrices (``merge_matrix``). Nothing is kept between slices, so
a task's memory is bound by ``SLICE_BYTES``, whatever the vocabulary of the corpus.

Defined results: a null text is empty and has no ids; rows that repeat come out
as often as they stand; decoding skips null ids' rows as empty bytes and raises
on an id outside the vocabulary; other columns of the table are not touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cueweave.llm.common import buffers, code_points, gather, slices, starts, string_array, strings, texts
from cueweave.llm.merge_matrix import PairTable, merge_all

#: The white space of the pattern's engine (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(pattern, every):
            a, b = run.span()
            table[ord(every[a]) : ord(every[b - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[[ord(c) for c in SPACES]] = BLANK
    return table


def char_classes(points: np.ndarray) -> np.ndarray:
    return _classes()[points]


class ByteBpe:
    """A rank file and the pattern that cuts texts before merging."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        blank, other = SPACES, f"[^{SPACES}]"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{blank}").replace(r"\s", f"[{blank}]").replace(r"\S", other))
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        rank = np.array(rank, np.int32)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), rank, rank)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            vocabulary[r] = token
        self.known = np.zeros(len(vocabulary), bool)
        self.known[list(ranks.values())] = True
        self.token_offsets = starts(np.array([len(t) for t in vocabulary]))
        self.token_bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    # ---- encoding

    def _pretokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut units (at most one white space in a row, a space at the front only).

        Returns the units' bytes, the offsets of their pre-tokens and the first
        pre-token of each unit. A cut falls where the class changes, except behind
        a leading space; white space of any other kind stands alone. The few units
        with an apostrophe are cut by the pattern itself.
        """
        points = code_points(data)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = starts(width)
        kind = char_classes(points)
        new = np.zeros(len(points) + 1, bool)
        new[np.searchsorted(place, offsets)] = True  # every unit's start; the end as well
        if len(points):
            before = np.concatenate([[OTHER], kind[:-1]])
            space_before = np.concatenate([[False], points[:-1] == 32])
            new[:-1] |= (kind != before) & ~space_before
        cuts = place[np.flatnonzero(new)]
        quotes = np.flatnonzero(data == 39)
        if len(quotes):
            cuts = self._by_pattern(data, offsets, cuts, np.unique(np.searchsorted(offsets, quotes, side="right") - 1))
        return data, cuts, np.searchsorted(cuts, offsets)

    def _by_pattern(self, data, offsets, cuts, units):
        drop = np.zeros(len(offsets), bool)
        drop[units] = True
        keep = ~drop[np.searchsorted(offsets, cuts, side="right") - 1] | np.isin(cuts, offsets)
        more = [cuts[keep]]
        for u in units:
            a = int(offsets[u])
            unit = data[a : offsets[u + 1]].tobytes().decode("utf-8", "surrogatepass")
            pieces = [m.group().encode("utf-8", "surrogatepass") for m in self.pattern.finditer(unit)]
            more.append(a + starts(np.array([len(p) for p in pieces], np.int64))[:-1])
        return np.unique(np.concatenate(more))

    def _merge(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pre-tokens merged: ids, their offsets, and the run of each element of ``array``."""
        coded = array.dictionary_encode()
        data, offsets = buffers(coded.dictionary)
        ids, id_offsets = merge_all(self.bytes_ids[data], offsets, self.table)
        return ids, id_offsets, coded.indices.to_numpy()

    def encode_slice(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text and their offsets."""
        wide = pc.match_substring_regex(array, "[" + SPACES + "]{2}").to_numpy(zero_copy_only=False)
        counts = np.zeros(len(array), np.int64)
        plain, rest = np.flatnonzero(~wide), np.flatnonzero(wide)
        if not len(rest):
            return self._encode_plain(array)
        ids_a, at_a = self._encode_plain(array.take(pa.array(plain)))
        found = [self.pattern.findall(t) for t in array.take(pa.array(rest)).to_numpy(zero_copy_only=False)]
        flat = pa.array([p for f in found for p in f], pa.large_string())
        ids, offsets, picks = self._merge(flat)
        ids_b, each = gather(ids, offsets, picks)
        at_b = each[starts(np.array([len(f) for f in found], np.int64))]
        counts[plain], counts[rest] = np.diff(at_a), np.diff(at_b)
        order = np.argsort(np.concatenate([plain, rest]), kind="stable")
        flat_ids, at = gather(np.concatenate([ids_a, ids_b]), np.concatenate([at_a, at_b[1:] + at_a[-1]]), order)
        return flat_ids, at

    def _encode_plain(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without white space twice in a row: units are what stands between spaces, each with the space before it."""
        if not len(array):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(array, " ")
        parts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        data, offsets = buffers(coded.dictionary)
        first, inverse = np.unique(codes[parts[:-1]], return_inverse=True)  # no space stands before a text's first unit
        codes[parts[:-1]] = len(coded.dictionary) + inverse
        head, head_at = gather(data, offsets, first)
        spaced_at = offsets + np.arange(len(offsets))
        spaced = np.full(len(data) + len(offsets) - 1, 32, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[spaced_at[:-1]] = False
        spaced[inside] = data
        data, cuts, unit_first = self._pretokens(
            np.concatenate([spaced, head]), np.concatenate([spaced_at, head_at[1:] + spaced_at[-1]])
        )
        ids, id_offsets, picks = self._merge(string_array(data, cuts))
        ids, each = gather(ids, id_offsets, picks)  # ids of all different units, pre-token by pre-token
        out, at = gather(ids, each[unit_first], codes)
        return out, at[parts]

    # ---- decoding

    def decode_slice(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each run of ids and their offsets."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id outside the vocabulary")
        data, each = gather(self.token_bytes, self.token_offsets, ids)
        return data, each[offsets]


@lru_cache(2)
def load(rank_file: str, pattern: str) -> ByteBpe:
    """One tokenizer per worker process."""
    return ByteBpe(rank_file, pattern)


def int_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": int_lists(*bpe.encode_slice(strings(batch)))})

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` (any columns, with ``ids``) and ``decoded``, the bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rank_file, pattern)
        for batch in batches:
            ids = batch.column("ids").fill_null([])
            for at in range(0, max(1, len(ids)), 2000):
                some = ids.slice(at, 2000)
                offsets = np.asarray(some.offsets).astype(np.int64)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                data, ends = bpe.decode_slice(flat.astype(np.int64), offsets - offsets[0])
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, string_array(data, ends).cast(pa.large_binary()).cast(pa.binary())], names=[*part.schema.names, "decoded"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
