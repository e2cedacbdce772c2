"""The batch sequence ratio against difflib, pair by pair."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cueweave.functions import sequence

TEXT = st.text("ab c", max_size=30) | st.text(max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=12))
def test_ratios(pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert sequence.ratios(a, b).tolist() == want
    assert (sequence.bounds(a, b) >= np.array(want) - 1e-12).all()


def _texts(rng, n, longest, alphabet):
    out = []
    for _ in range(n):
        x = "".join(rng.choices(alphabet, k=rng.randrange(longest)))
        y = list(x)
        for _ in range(rng.randrange(1 + len(y) // 3)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(4)] = rng.choices(alphabet, k=rng.randrange(4))
        out.append((x, "".join(y) if rng.random() < 0.7 else "".join(rng.choices(alphabet, k=rng.randrange(longest)))))
    return out


@pytest.mark.parametrize("longest, alphabet", [(60, "abcdefgh "), (300, "abcdefghijklmnop 的是不了"), (700, [chr(k) for k in range(97, 297)])])
def test_mutated(longest, alphabet, monkeypatch):
    """Frequent characters of long texts begin no block; small steps give the same."""
    rng = random.Random(longest)
    pairs = _texts(rng, 60, longest, alphabet)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert sequence.ratios(a, b).tolist() == want
    monkeypatch.setattr(sequence, "CELLS", 50)
    assert sequence.ratios(a, b).tolist() == want


def test_large_pairs():
    rng = random.Random(1)
    pairs = _texts(rng, 4, 2_000, "abcdefghijklmnopqrstuvwxyz ") + [("x" * 3_000, "x" * 3_000)]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert sequence.ratios([p[0] for p in pairs], [p[1] for p in pairs]).tolist() == want


def test_equal_and_wide():
    """Equal texts of frequent characters alone, characters beyond 16 bits, blocks over the borders of words of bits."""
    rng = random.Random(2)
    pairs = [("a" * 300, "a" * 300), ("ab" * 150, "ab" * 150), ("a" * 300, "b" + "a" * 300), ("", ""), ("", "a"), ("a\U0001F600b" * 9, "b\U0001F600a" * 9)]
    for n in (63, 64, 65, 127, 128, 129, 200):
        x = "".join(rng.choices("abcdefgh \uFFFF", k=n))
        pairs += [(x, x[1:] + x[:1]), (x, x + "z"), ("z" + x, x), (x[: n // 2], x), (x, x[n // 3 :] + x)]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert sequence.ratios([p[0] for p in pairs], [p[1] for p in pairs]).tolist() == want


def test_equal_texts_need_no_blocks(monkeypatch):
    monkeypatch.setattr(sequence, "_matched", None)
    assert sequence.ratios(["same text", "", "x" * 3_000], ["same text", "", "x" * 3_000]).tolist() == [1.0] * 3
