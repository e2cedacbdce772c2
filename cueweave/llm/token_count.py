"""Token counts of a sentencepiece BPE model by the whole-token shortcut.

No piece of the model has its space mark behind another character, so merges
never cross from a text's unit (space marks and what follows them) into the
next, and units can be counted one by one. Offline, every piece that could be a
unit is encoded once: where the result is the piece alone, the unit is *proved*
to count one. At run time units found in that set count one directly; only the
rest is merged (``merge_matrix``).

Defined results: a null or empty text has no tokens; rows that repeat come out
as often as they stand; other columns of the table are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from cueweave.llm.common import buffers, code_points, slices, starts, string_array, strings, sums, texts
from cueweave.llm.merge_matrix import PairTable, merge_all

MARK = "▁"
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCounter:
    """The pieces of a model, what it does to a text before merging, and the units proved to be one token."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        if any(MARK in p.lstrip(MARK) for p in ids) or not any(model.is_byte(i) for i in range(size)):
            raise ValueError("units can't be counted apart with this model")
        score = [model.get_score(i) for i in range(size)]
        order = {p: r for r, p in enumerate(sorted(ids, key=lambda p: -score[ids[p]]))}
        left, right, rank, merged = [], [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(order[p]), merged.append(i)
        self.table = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32), np.array(merged, np.int32))
        self.symbol = np.full(0x110000, -1, np.int32)  # -1: no piece, falls back to bytes
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.filler = size  # a byte's symbol: it never merges
        units = pa.array([p for p in ids if _UNIT.fullmatch(p)], pa.large_string())
        self.whole = units.filter(pa.array(self._merged_counts(units) == 1))

    def _merged_counts(self, units: pa.Array) -> np.ndarray:
        """Tokens of each unit, by merging."""
        data, offsets = buffers(units)
        points = code_points(data)
        width = (1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)) if len(points) else np.zeros(0, np.int64)
        first = np.searchsorted(starts(width), offsets)  # each unit's first character
        symbol = self.symbol[points]
        times = np.where(symbol < 0, width, 1)
        symbols = np.repeat(np.where(symbol < 0, self.filler, symbol), times)
        _, at = merge_all(symbols, starts(times)[first], self.table)
        return np.diff(at)

    def unit_counts(self, units: pa.Array) -> np.ndarray:
        """Tokens of each (different) unit: one if proved offline, else by merging."""
        whole = pc.is_in(units, self.whole).to_numpy(zero_copy_only=False)
        counts = np.ones(len(units), np.int64)
        if not whole.all():
            counts[~whole] = self._merged_counts(units.filter(pa.array(~whole)))
        return counts

    def counts(self, array: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        array = array.cast(pa.large_string())
        out = np.zeros(len(array), np.int64)
        odd = pc.match_substring_regex(array, f"^ |  |{MARK}").to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd & (pc.binary_length(array).to_numpy(zero_copy_only=False) > 0))
        if len(plain):  # units are the parts between spaces, each with a mark before it
            lists = pc.split_pattern(array.take(pa.array(plain)), " ")
            coded = lists.flatten().dictionary_encode()
            parts = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            out[plain] = sums(self.unit_counts(_marked(coded.dictionary))[coded.indices.to_numpy()], parts)
        rest = np.flatnonzero(odd)
        if len(rest):
            found = [_UNIT.findall(MARK + t.replace(" ", MARK)) for t in array.take(pa.array(rest)).to_numpy(zero_copy_only=False)]
            coded = pa.array([u for f in found for u in f], pa.large_string()).dictionary_encode()
            out[rest] = sums(self.unit_counts(coded.dictionary)[coded.indices.to_numpy()], starts(np.array([len(f) for f in found])))
        return out


def _marked(parts: pa.Array) -> pa.Array:
    """Each string with a space mark before it."""
    data, offsets = buffers(parts)
    mark = np.frombuffer(MARK.encode(), np.uint8)
    at = offsets + len(mark) * np.arange(len(offsets))
    out = np.empty(len(data) + len(mark) * (len(offsets) - 1), np.uint8)
    text = np.ones(len(out), bool)
    for k, byte in enumerate(mark):
        out[at[:-1] + k] = byte
        text[at[:-1] + k] = False
    out[text] = data
    return string_array(out, at)


@lru_cache(2)
def load(model_file: str) -> PieceCounter:
    """One counter per worker process."""
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model_file)
        for batch in slices(batches):
            text = strings(batch)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(text).cast(pa.int64()), "n_tokens": pa.array(counter.counts(text)),
            })

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
