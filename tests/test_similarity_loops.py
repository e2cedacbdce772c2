"""The queries that need the sequence ratio, against plain loops over the standard library on the whole smallest tables."""

from collections import Counter, defaultdict
from difflib import SequenceMatcher
from math import sqrt
from statistics import median

import pytest
import regex

from cueweave import catalog as cat
from cueweave.functions import similarity as sim
from cueweave.operators import anchors as an
from cueweave.operators import summary as sm

SF = "/root/testdata/sf0.001"


def norm(text):
    text = regex.sub(r"\{[^}]+\}", "", regex.sub("<[^>]+>", "", text.lower()))
    return regex.sub(r"[^\p{L}\p{N}_]+", " ", text).strip(" ")


def edit_distance(a, b):
    """A column of the distance table at a time, its steps up and down as the bits of two integers."""
    if not a:
        return len(b)
    places = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right, left = down | (~(diagonal | up) & full), up & diagonal
        distance += bool(right & high) - bool(left & high)
        right, left = ((right << 1) | 1) & full, (left << 1) & full
        up, down = left | (~(same | down | right) & full), right & (same | down)
    return distance


class Text:
    def __init__(self, text):
        self.text = norm(text)
        self.words = Counter(w for w in self.text.split(" ") if w)
        self.solid = set(self.words) - set(sim.STOP_WORDS)
        self.norm = sqrt(sum(n * n for n in self.words.values()))


def share(a, b):
    return len(a & b) / len(a | b)


def scores(x, y, least=0.0, weights=sim.WEIGHTS):
    """All six scores, or None if their weighted sum can't reach ``least``."""
    longest = max(len(x.text), len(y.text))
    out = {
        "jaccard": share(set(x.words), set(y.words)) if x.words or y.words else 1.0,
        "cosine": sum(n * y.words[w] for w, n in x.words.items()) / (x.norm * y.norm) if x.words and y.words else 0.0,
        "length": min(len(x.text), len(y.text)) / longest if longest else 1.0,
        "common": share(x.solid, y.solid) if x.solid and y.solid else float(not x.solid and not y.solid),
    }
    bound = 2 * min(len(x.text), len(y.text)) / (len(x.text) + len(y.text)) if longest else 1.0
    if sum(weights.get(n, 0) * v for n, v in out.items()) + weights["edit"] * out["length"] + weights["sequence"] * bound < least - 1e-9:
        return None
    out["edit"] = 1.0 - edit_distance(x.text, y.text) / longest if longest else 1.0
    out["sequence"] = SequenceMatcher(None, x.text, y.text).ratio()
    return out


def total(s, weights=sim.WEIGHTS):
    """Added up term by term, so that ties fall as in the engine (``sum`` compensates rounding)."""
    out = 0.0
    for n in weights:
        out += weights[n] * s[n]
    return out


def tracks(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.media_id, r.cue_idx)):
        assert len(out[r.media_id]) == r.cue_idx
        out[r.media_id].append(r.text)
    return out


@pytest.fixture(scope="module")
def both(spark):
    a, same, zh = (tracks(f(spark, SF)) for f in (cat.cues_a, cat.cues_same, cat.cues_zh))
    table = {r.text: r.translated for r in cat._translations(spark, SF).collect()}
    return a, same, zh, table


def sampled(n, k):
    step = max(1, n // min(k, n))
    return [i * step for i in range(k) if i * step < n]


def compare(rows, want, *cols):
    got = {(r.media_id, *[r[c] for c in cols]): r.confidence for r in rows}
    assert set(got) == set(want) and got == pytest.approx(want, abs=2e-6)
    assert want


def align_loop(left, right):
    """{(i, j): confidence} of the best reference of every source, one source per reference."""
    per_ref, left, right = {}, [Text(t) for t in left], [Text(t) for t in right]
    for i, x in enumerate(left):
        best = None
        for j, y in enumerate(right):
            s = scores(x, y, 0.6)
            if s and total(s) >= 0.6 and (best is None or total(s) > best[0]):
                best = (total(s), j, s)
        if best:
            mean = sum(best[2].values()) / 6
            spread = min(0.2, 2 * sum((v - mean) ** 2 for v in best[2].values()) / 6)
            gap = min(0.3, 0.5 * abs(i / max(1, len(left) - 1) - best[1] / max(1, len(right) - 1)))
            confidence = max(0.0, min(1.0, best[0] * (1 - gap) * (1 - spread)))
            if confidence >= 0.6 and (best[1] not in per_ref or confidence > per_ref[best[1]][0] + 1e-12):
                per_ref[best[1]] = (confidence, i)
    return {(i, j): c for j, (c, i) in per_ref.items()}


def test_align(spark, both):
    a, same, _, _ = both
    want = {(m, i, j): c for m in a.keys() & same.keys() for (i, j), c in align_loop(a[m], same[m]).items()}
    compare(cat.QUERIES["similarity_align"](spark, SF).collect(), want, "src_idx", "ref_idx")


def sample_loop(left, right):
    """{(i, j): score} of evenly sampled sources around the same place of the other track."""
    out, used, reach = {}, set(), max(10, len(right) // 10)
    for i in sampled(len(left), 20):
        centre = i * (len(right) - 1) // max(1, len(left) - 1)
        best = None
        for j in range(max(0, centre - reach), min(len(right), centre + reach)):
            if j not in used and min(len(left[i].strip(" ")), len(right[j].strip(" "))) >= 5:
                s = scores(Text(left[i]), Text(right[j]), 0.6)
                if s and total(s) >= 0.6 and (best is None or total(s) > best[0]):
                    best = (total(s), j)
        if best:
            used.add(best[1])
            out[i, best[1]] = best[0]
    return out


def test_sample(spark, both):
    a, same, _, _ = both
    want = {(m, i, j): c for m in a.keys() & same.keys() for (i, j), c in sample_loop(a[m], same[m]).items()}
    compare(cat.QUERIES["similarity_sample"](spark, SF).collect(), want, "src_idx", "ref_idx")


# ---- anchors of all kinds ---------------------------------------------------------------

def token_loop(left, right, by_weight):
    """{(i, j): shared tokens}, pair by pair in the rule's order."""
    pairs = [(len(x & y), i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x & y]
    out, used = {}, (set(), set())
    for n, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2]) if by_weight else (p[1], -p[0], p[2])):
        if i not in used[0] and j not in used[1]:
            out[i, j] = n
            used[0].add(i)
            used[1].add(j)
    return out


class Sides:
    """Both tracks of a query: texts, starts, tokens; and the media of one language."""

    def __init__(self, left, right, **rule):
        self.texts = [tracks(f) for f in (left, right)]
        self.starts = [{(r.media_id, r.cue_idx): r.start_ms for r in f.collect()} for f in (left, right)]
        self.tokens = {}
        for name, tokens in (("keyword", an.with_keywords), ("number", an.with_numbers)):
            self.tokens[name] = [defaultdict(dict), defaultdict(dict)]
            for held, f in zip(self.tokens[name], (left, right), strict=True):
                for r in tokens(f).collect():
                    held[r.media_id][r.cue_idx] = set(r.tokens)
        self.same = {r.media_id for r in sm.same_language(left, right, **rule).collect() if r.same}

    def anchors(self, m):
        """{(i, j): (confidence, method, shared)}; a pair found twice keeps the first method."""
        out = {}
        for method, base in (("keyword", 0.5), ("number", 0.4)):
            left, right = ([held[m][i] for i in sorted(held[m])] for held in self.tokens[method])
            for (i, j), n in token_loop(left, right, method == "keyword").items():
                out.setdefault((i, j), (min(1.0, base + 0.2 * n), method, "|".join(sorted(left[i] & right[j]))))
        if m in self.same:
            for pair, c in sample_loop(self.texts[0][m], self.texts[1][m]).items():
                out.setdefault(pair, (c, "similarity", ""))
        return out

    def media(self):
        return sorted(self.texts[0].keys() & self.texts[1].keys())


@pytest.fixture(scope="module")
def named(spark):
    return Sides(cat.named_a(spark, SF), cat.named_b(spark, SF))


def test_anchors_all(spark, named):
    got = {
        (r.media_id, r.src_idx, r.ref_idx): (r.time_offset_ms, pytest.approx(r.confidence, abs=2e-6), r.method, r["keywords"])
        for r in cat.QUERIES["anchors_all"](spark, SF).collect()
    }
    want = {}
    for m in named.media():
        for (i, j), (c, method, shared) in named.anchors(m).items():
            want[m, i, j] = (named.starts[1][m, j] - named.starts[0][m, i], c, method, shared)
    assert {k: (v[0], *v[2:]) for k, v in got.items()} == {k: (v[0], *v[2:]) for k, v in want.items()}
    assert all(want[k][1] == got[k][1] for k in want) and {v[2] for v in want.values()} >= {"keyword", "similarity"}


def test_auto_align(spark):
    sides = Sides(cat.cues_a(spark, SF), cat.cues_same(spark, SF), sampled=False)
    want = {}
    for m in sides.media():
        found = {k: (c, method) for k, (c, method, _) in sides.anchors(m).items()}
        found = found or {k: (c, "similarity_analysis") for k, c in align_loop(sides.texts[0][m], sides.texts[1][m]).items()}
        want |= {(m, *k): v for k, v in found.items()}
    rows = cat.QUERIES["auto_align"](spark, SF).collect()
    assert {(r.media_id, r.src_idx, r.ref_idx): r.method for r in rows} == {k: v[1] for k, v in want.items()}
    assert all(want[r.media_id, r.src_idx, r.ref_idx][0] == pytest.approx(r.confidence, abs=2e-6) for r in rows)


def robust_loop(offsets):
    """(median, confidence) of the offsets near their median."""
    middle = median(offsets)
    near = [o for o in offsets if abs(o - middle) < 5_000]
    kept = offsets if len(offsets) < 3 or not near else near
    centre = median(kept)
    spread = median([abs(o - centre) for o in kept]) if len(kept) >= 2 else 0
    step = 1.0 if spread < 100 else 0.9 if spread < 500 else 0.7 if spread < 1_000 else 0.5 if spread < 2_000 else 0.3
    return centre, step * (0.5 + 0.5 * min(1.0, len(kept) / 3))


def question_loop(texts, words, longer_than):
    return next((i for i, t in enumerate(texts[:5]) if len(t.strip(" ")) > longer_than and any(w in t.strip(" ").lower() for w in words)), None)


def test_semantic_anchor(spark, named):
    want = {}
    rank = ("keyword", "number", "similarity")
    for m in named.media():
        found, (left, right) = named.anchors(m), (t[m] for t in named.texts)
        at = lambda i, j, m=m: named.starts[0][m, i] - named.starts[1][m, j]
        if found:
            centre, confidence = robust_loop([-at(i, j) for i, j in found])
            if confidence >= 0.5:
                i, j = min(found, key=lambda k: (-found[k][0], k[0], rank.index(found[k][1]), k[1]))
                want[m] = (i, j, -centre, confidence, "multi_anchor")
                continue
        i = question_loop(left, ("who", "what", "how", "why", "?"), 20)
        j = question_loop(right, ("你", "什么", "怎么", "为什么", "?", "？"), 5)
        if i is not None and j is not None:
            want[m] = (i, j, at(i, j), 0.8, "first_dialogue")
            continue
        pairs = []
        for i, x in enumerate(left[:5]):
            for j, y in enumerate(right[:5]):
                if min(len(x.strip(" ")), len(y.strip(" "))) >= 5:
                    value = total(scores(Text(x), Text(y)), sim.ANCHOR_WEIGHTS)
                    pairs += [(value, i, j)] * (value >= 0.05)
        if pairs:
            value, i, j = top(pairs)
            want[m] = (i, j, at(i, j), value, "similarity")
    rows = cat.QUERIES["semantic_anchor"](spark, SF).collect()
    got = {r.media_id: (r.src_idx, r.ref_idx, r.offset_ms, r.confidence, r.method) for r in rows}
    assert got.keys() == want.keys() and want
    for m, (i, j, offset, confidence, method) in want.items():
        assert got[m] == (i, j, pytest.approx(offset), pytest.approx(confidence, abs=2e-6), method)


def top(pairs):
    """Best (value, i, j), ties to the lower indexes."""
    return min(pairs, key=lambda p: (-p[0], p[1], p[2])) if pairs else None


def anchors(media, find):
    out = {}
    for m in media:
        best = top(find(m))
        if best:
            out[m, best[1], best[2]] = best[0]
    return out


def test_anchor_similarity(spark, both):
    a, same, _, _ = both

    def find(m):
        out = []
        for i, x in enumerate(a[m][:5]):
            for j, y in enumerate(same[m][:5]):
                if min(len(x.strip(" ")), len(y.strip(" "))) >= 5:
                    value = total(scores(Text(x), Text(y)), sim.ANCHOR_WEIGHTS)
                    out += [(value, i, j)] * (value >= 0.05)
        return out

    compare(cat.QUERIES["anchor_similarity"](spark, SF).collect(), anchors(a.keys() & same.keys(), find), "a_idx", "b_idx")


def test_anchor_translated(spark, both):
    a, _, zh, table = both

    def find(m):
        out, right = [], [Text(t) for t in a[m]]
        for i, x in enumerate(zh[m][:20]):
            if table.get(x, "").strip(" "):
                left = Text(table[x])
                for j, y in enumerate(right):
                    s = scores(left, y, 0.4) if a[m][j].strip(" ") else None
                    if s and total(s) >= 0.4:
                        value = total(s) + max(0.0, 0.1 - (i + j) * 0.005)
                        out += [(value, i, j)] * (value >= 0.5)
        return out

    compare(cat.QUERIES["anchor_translated"](spark, SF).collect(), anchors(a.keys() & zh.keys(), find), "a_idx", "b_idx")


def test_anchor_sampled(spark, both):
    a, _, zh, table = both

    def find(m):
        out = []
        for i in sampled(len(zh[m]), 15):
            if table.get(zh[m][i], "").strip(" "):
                left = Text(table[zh[m][i]])
                for j in sampled(len(a[m]), 15):
                    s = scores(left, Text(a[m][j]), 0.5) if a[m][j].strip(" ") else None
                    if s and total(s) >= 0.5:
                        out.append((total(s), i, j))
        return out

    compare(cat.QUERIES["anchor_sampled"](spark, SF).collect(), anchors(a.keys() & zh.keys(), find), "a_idx", "b_idx")


def two_way(a, b):
    x, y = ("".join(c for c in t if regex.match(r"[\p{L}\p{N}]", c) or c.isspace()).lower().strip() for t in (a, b))
    if not x or not y:
        return 0.0
    return max(SequenceMatcher(None, x, y).ratio(), 0.8 * share(set(x.split()), set(y.split())))


def test_anchor_quartiles(spark, both):
    a, _, zh, table = both

    def find(m):
        n = min(20, len(a[m]), len(zh[m]))
        spots = sorted({0, n // 4, n // 2, 3 * n // 4, n - 1})
        out = []
        for i in spots:
            for j in spots:
                if zh[m][i] in table:
                    value = two_way(table[zh[m][i]].strip(" ").lower(), a[m][j].strip(" ").lower())
                    out += [(value, i, j)] * (value >= 0.7)
        return out

    compare(cat.QUERIES["anchor_quartiles"](spark, SF).collect(), anchors(a.keys() & zh.keys(), find), "a_idx", "b_idx")
