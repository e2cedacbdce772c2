"""Pair merging on length-bucketed, padded numpy matrices.

Rows are symbol sequences of similar length. Each round every row merges its
leftmost pair of lowest rank: pairs are looked up in an open-addressing hash
table, the row closes up behind the merged symbol, and rows without a pair left
are taken out of the matrix.
"""

from __future__ import annotations

import heapq

import numpy as np

from cueweave.llm.common import starts

NONE = np.int32(2**31 - 1)
#: Rows this long go through a heap instead: a matrix would need length^2 steps for a single word.
LONG = 512
#: Most symbols in a matrix.
CELLS = 2_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left, right) -> (rank, merged symbol), hashed with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 2).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE, np.int32)
        self.merged = np.full(size, -1, np.int32)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left, right):
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, key):
        return ((key * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot without a pair has rank ``NONE``."""
        key = self._key(left, right)
        slot = self._slot(key)
        held = self.keys[slot]
        todo = np.flatnonzero((held != key) & (held != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            todo = todo[(held != key[todo]) & (held != np.uint64(2**64 - 1))]
        return slot

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.find(left, right)]


def merge_rows(matrix: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix; returns matrix and lengths in the same row order."""
    out, out_lengths = matrix.copy(), lengths.copy()
    rows = np.arange(len(matrix))
    m, n = matrix.copy(), lengths.copy()
    width = m.shape[1]
    inside = np.arange(1, width)[None, :] < n[:, None]
    ranks = np.full((len(m), width - 1), NONE, np.int32)
    ranks[inside] = table.ranks(m[:, :-1][inside], m[:, 1:][inside])
    while len(rows):
        at = ranks.argmin(axis=1)
        line = np.arange(len(rows))
        go = ranks[line, at] != NONE
        if not go.all():
            out[rows[~go], :width] = m[~go]
            out_lengths[rows[~go]] = n[~go]
            rows, m, n, ranks, at = rows[go], m[go], n[go], ranks[go], at[go]
            if not len(rows):
                break
            width = int(n.max())
            m, ranks = m[:, :width], ranks[:, : width - 1]
            line = np.arange(len(rows))
        new = table.merged[table.find(m[line, at], m[line, at + 1])]
        n = n - 1
        # Close up: columns behind the merged one move left.
        cols = np.arange(width - 1)[None, :]
        m = np.take_along_axis(m, cols + (cols > at[:, None]), axis=1)
        m[line, at] = new
        width -= 1
        cols = np.arange(max(width - 1, 0))[None, :]
        ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1) if width > 1 else np.full((len(rows), 1), NONE, np.int32)
        if width > 1:
            has = at > 0
            ranks[line[has], at[has] - 1] = table.ranks(m[line[has], at[has] - 1], new[has])
            has = at + 1 < n
            ranks[line[has], at[has]] = table.ranks(new[has], m[line[has], at[has] + 1])
        else:
            m = np.concatenate([m, np.full((len(m), 1), -1, m.dtype)], axis=1)
            width = 2
    return out, out_lengths


def merge_long(symbols: list[int], table: PairTable) -> list[int]:
    """The same for one long row: pairs wait in a heap by (rank, place), symbols are a linked list."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    first = np.array(symbols, np.int64)
    ranks = table.ranks(first[:-1], first[1:])
    heap = [(int(r), i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r != NONE]
    heapq.heapify(heap)
    alive = [True] * n

    def push(i: int) -> None:
        if i >= 0 and right[i] < n:
            a, b = symbols[i], symbols[right[i]]
            r = int(table.ranks(np.array([a]), np.array([b]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, a, b))

    while heap:
        _, i, a, b = heapq.heappop(heap)
        if not alive[i] or symbols[i] != a or right[i] >= n or symbols[right[i]] != b:
            continue
        j = right[i]
        symbols[i] = int(table.merged[table.find(np.array([a]), np.array([b]))[0]])
        alive[j] = False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        push(left[i])
        push(i)
    return [s for s, live in zip(symbols, alive, strict=True) if live]


def merge_all(symbols: np.ndarray, offsets: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every run of a ragged array of symbols; returns symbols and offsets."""
    lengths = offsets[1:] - offsets[:-1]
    counts = lengths.copy()
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (rows, their symbols in a padded matrix)
    low = 1
    while low < LONG and low < lengths.max(initial=0):
        high = min(max(low * 3 // 2, low + 1), LONG)
        rows = np.flatnonzero((lengths > low) & (lengths <= high))
        step = max(1, CELLS // high)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            place = offsets[some][:, None] + np.arange(high)[None, :]
            inside = np.arange(high)[None, :] < lengths[some][:, None]
            matrix = np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], -1).astype(np.int32)
            matrix, counts[some] = merge_rows(matrix, lengths[some], table)
            parts.append((some, matrix))
        low = high
    long_rows = {int(r): merge_long(symbols[offsets[r] : offsets[r + 1]].tolist(), table) for r in np.flatnonzero(lengths > LONG)}
    for r, merged in long_rows.items():
        counts[r] = len(merged)
    out_offsets = starts(counts)
    out = np.empty(out_offsets[-1], np.int32)
    single = np.flatnonzero(lengths == 1)
    out[out_offsets[single]] = symbols[offsets[single]]
    for rows, matrix in parts:
        inside = np.arange(matrix.shape[1])[None, :] < counts[rows][:, None]
        place = out_offsets[rows][:, None] + np.arange(matrix.shape[1])[None, :]
        out[place[inside]] = matrix[inside]
    for r, merged in long_rows.items():
        out[out_offsets[r] : out_offsets[r + 1]] = merged
    return out, out_offsets
