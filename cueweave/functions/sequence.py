"""The sequence ratio of ``difflib`` for a batch of text pairs at once.

``difflib`` finds the longest common block of two texts, then of what lies left
and right of it, and so on. Here all pairs of a batch do that together, in rounds:
a round takes every open pair of intervals and finds their longest blocks, a row of
lengths per pair, one character of the first text at a time. Rules kept: of equally
long blocks the one that ends first in the first text, then in the second; in a
second text of 200 characters or more, a character on more than one place in a
hundred begins no block (it may prolong one).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Length from which frequent characters begin no block, and their share.
LONG, SHARE = 200, 100
#: Words of bits that a step works on; pairs of more than so many cells by themselves are left to ``difflib``.
CELLS, LARGEST = 400_000, 250_000
#: Classes of characters in the bound.
CLASSES = 64
#: The n lowest bits of a word, by n.
LOWEST = np.array([(1 << n) - 1 for n in range(65)], np.uint64)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and offsets."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """No ratio is larger: characters common to both texts, counted in ``CLASSES`` classes."""
    n, total = len(a), np.zeros(len(a))
    for at in range(0, n, 4_096):
        part = slice(at, at + 4_096)
        counts = []
        for side in (a[part], b[part]):
            points, offsets = _flat(side)
            row = np.repeat(np.arange(len(side)), np.diff(offsets))
            counts.append(np.bincount(row * CLASSES + points % CLASSES, minlength=len(side) * CLASSES).reshape(-1, CLASSES))
        total[part] = np.minimum(*counts).sum(axis=1)
    both = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)])
    return np.where(both == 0, 1.0, 2 * total / np.maximum(both, 1))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``SequenceMatcher(None, x, y).ratio()`` of every pair."""
    size_a, size_b = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    out = np.where(size_a + size_b == 0, 1.0, 0.0)
    same = np.array([x == y for x, y in zip(a, b, strict=True)], bool)
    out[same] = 1.0
    cells = np.where(same, 0, size_a * size_b)
    for k in np.flatnonzero(cells > LARGEST).tolist():
        out[k] = SequenceMatcher(None, a[k], b[k]).ratio()
    short = np.flatnonzero((cells > 0) & (cells <= LARGEST))
    if len(short):
        found = _matched([a[k] for k in short.tolist()], [b[k] for k in short.tolist()])
        out[short] = 2.0 * found / (size_a + size_b)[short]
    return out


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in common blocks, per pair (no text is empty)."""
    words = np.array([(len(t) + 63) // 64 for t in b])
    kind = 1 << np.ceil(np.log2(words)).astype(np.int64)
    total = np.zeros(len(a), np.int64)
    for width in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == width)
        alphabet = len(set().union(*[b[k] for k in mine.tolist()])) + 1
        # A pair has a row of words per character of its first text and of the alphabet.
        need = np.cumsum((np.array([len(a[k]) for k in mine.tolist()]) + alphabet) * width)
        at = 0
        while at < len(mine):
            stop = max(at + 1, int(np.searchsorted(need, (need[at - 1] if at else 0) + CELLS, side="right")))
            part = mine[at:stop].tolist()
            total[part] = _matched_part([a[k] for k in part], [b[k] for k in part], width)
            at = stop
    return total


def _matched_part(a: list[str], b: list[str], width: int) -> np.ndarray:
    """Characters in common blocks, per pair; second texts fit into ``width`` words of bits."""
    (x, x_at), (y, y_at) = _flat(a), _flat(b)
    popular = _popular(y, y_at)
    places, rows = _places(x, x_at, y, y_at, ~popular, width)
    total = np.zeros(len(a), np.int64)
    # Open intervals: pair, begin and end in both flat texts.
    work = np.stack([np.arange(len(a)), x_at[:-1], x_at[1:], y_at[:-1], y_at[1:]], axis=1)
    while len(work):
        i, j, size = _longest(places, rows, y_at, work)
        if popular.any():
            i, j, size = _prolonged(x, y, work, i, j, size)
        total += np.bincount(work[:, 0], size, len(total)).astype(np.int64)
        hit = size > 0
        work, i, j, size = work[hit], i[hit], j[hit], size[hit]
        left = np.stack([work[:, 0], work[:, 1], i, work[:, 3], j], axis=1)
        right = np.stack([work[:, 0], i + size, work[:, 2], j + size, work[:, 4]], axis=1)
        work = np.concatenate([left, right])
        work = work[(work[:, 1] < work[:, 2]) & (work[:, 3] < work[:, 4])]
    return total


def _places(x, x_at, y, y_at, begins, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each character in the second text of its pair, as bits, and the row of these for each character of a first text."""
    alphabet = np.unique(y)
    sizes = np.diff(y_at)
    row_y = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(y)) - y_at[:-1][row_y]
    step = len(alphabet) + 1
    places = np.zeros((width, len(sizes) * step), np.uint64)
    row = row_y * step + np.searchsorted(alphabet, y)
    np.bitwise_or.at(places, (at[begins] >> 6, row[begins]), np.uint64(1) << (at[begins] & 63).astype(np.uint64))
    code = np.searchsorted(alphabet, x)
    code[alphabet[np.minimum(code, len(alphabet) - 1)] != x] = len(alphabet)  # a row without places
    return places, np.repeat(np.arange(len(sizes)), np.diff(x_at)) * step + code


def _popular(y: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the second texts whose character begins no block."""
    sizes = np.diff(offsets)
    out = np.zeros(len(y), bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    long = sizes[row] >= LONG
    if long.any():
        _, kind, count = np.unique(row[long] << 21 | y[long], return_inverse=True, return_counts=True)
        out[long] = count[kind] > sizes[row[long]] // SHARE + 1
    return out


def _longest(places: np.ndarray, rows: np.ndarray, y_at: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, begin, length) of the longest common block of every pair of intervals."""
    width, tall = len(places), work[:, 2] - work[:, 1]
    # A row for each character of the first intervals: the places inside the second one where it stands.
    owner = np.repeat(np.arange(len(work)), tall)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(tall) - tall, tall)
    words = 64 * np.arange(width)[:, None]
    low, high = (LOWEST[np.clip(work[:, k] - y_at[work[:, 0]] - words, 0, 64)] for k in (3, 4))
    ends = places[:, rows[work[:, 1][owner] + place]]
    ends &= (high & ~low)[:, owner]
    # Level s: the ends of blocks of 2^s characters, for the intervals that have any; ``kept``: its rows that the next level has.
    levels, kept, size = [], [], np.zeros(len(work), np.int64)
    while True:
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        alive = np.logical_or.reduceat(_any(ends), begin)
        mine = np.flatnonzero(np.repeat(alive, np.diff(np.append(begin, len(owner)))))
        kept.append(mine)
        if not len(mine):
            break
        if len(mine) < len(owner):
            ends, owner, place = ends[:, mine], owner[mine], place[mine]
        size[owner] = 1 << len(levels)
        levels.append((ends, owner, place))
        ends = _after(ends, ends, size[owner[0]], place)
    best_i, best_j = work[:, 1].copy(), work[:, 3].copy()
    if not levels:
        return best_i, best_j, size
    found, owner, place = levels[-1]
    for s in range(len(levels) - 2, -1, -1):
        ends, wider, wider_place = levels[s]
        mine = kept[s + 1]
        longer = _after(ends[:, mine], found, 1 << s, place)
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        more = np.logical_or.reduceat(_any(longer), begin)
        size[owner[begin[more]]] += 1 << s
        found = np.where(np.repeat(more, np.diff(np.append(begin, len(owner)))), longer, found)
        if len(mine) < len(wider):
            every = ends.copy()
            every[:, mine] = found
            found, owner, place = every, wider, wider_place
    # The first row with an end, and its first place.
    at = np.flatnonzero(_any(found))
    at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
    word = (found[:, at] != 0).argmax(axis=0)
    bits = found[word, at]
    bit = np.frexp((bits & (~bits + np.uint64(1))).astype(np.float64))[1] - 1
    mine = owner[at]
    best_i[mine] += place[at] + 1 - size[mine]
    best_j[mine] = y_at[work[mine, 0]] + 64 * word + bit + 1 - size[mine]
    return best_i, best_j, size


def _any(words: np.ndarray) -> np.ndarray:
    """Which rows have a bit."""
    return np.bitwise_or.reduce(words, axis=0) != 0


def _after(ends: np.ndarray, before: np.ndarray, step: int, place: np.ndarray) -> np.ndarray:
    """Those ``ends`` of blocks of ``step`` characters that follow an end of ``before``."""
    out = np.zeros_like(ends)
    word, bit = divmod(int(step), 64)
    width, rows = ends.shape
    if step >= rows or word >= width:
        return out
    np.left_shift(before[: width - word, :-step], np.uint64(bit), out=out[word:, step:])
    if bit and word + 1 < width:
        out[word + 1 :, step:] |= before[: width - word - 1, :-step] >> np.uint64(64 - bit)
    out &= ends
    out *= place >= step
    return out


def _prolonged(x, y, work, i, j, size):
    """Blocks made longer by equal characters on both sides, whatever these are."""
    i, j, size = i.copy(), j.copy(), size.copy()
    live = np.flatnonzero((i > work[:, 1]) & (j > work[:, 3]))
    while len(live):
        live = live[x[i[live] - 1] == y[j[live] - 1]]
        i[live], j[live], size[live] = i[live] - 1, j[live] - 1, size[live] + 1
        live = live[(i[live] > work[live, 1]) & (j[live] > work[live, 3])]
    live = np.flatnonzero((i + size < work[:, 2]) & (j + size < work[:, 4]))
    while len(live):
        live = live[x[i[live] + size[live]] == y[j[live] + size[live]]]
        size[live] += 1
        live = live[(i[live] + size[live] < work[live, 2]) & (j[live] + size[live] < work[live, 4])]
    return i, j, size
