"""Matching operators against plain sequential loops on small random inputs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cueweave import catalog as cat
from cueweave.functions import similarity as sim
from cueweave.operators import matching as mt
from cueweave.operators import similarity_join as sj
from cueweave.operators import token_matching as tm


def serial(edges):
    """Sources in order; the first free reference sets the bar, larger overlap beats it."""
    out, used, by_src = [], set(), {}
    for src, ref, score, near in sorted(edges):
        by_src.setdefault(src, []).append((ref, score, near))
    for src, cands in sorted(by_src.items()):
        best, pick = 0.0, None
        for ref, score, near in cands:
            if ref in used:
                continue
            if score > best:
                best, pick = score, ref
            if best == 0 and near > best:
                best, pick = near, ref
        if pick is not None:
            out.append((src, pick))
            used.add(pick)
    return out


def random_edges(rng, n):
    edges = {}
    for src in range(n):
        for ref in range(max(0, src - 2), min(n, src + 3)):
            if rng.random() < 0.7:
                over = rng.choice([0, 0, 1, 2, 3])
                edges[(src, ref)] = (float(over), 0.0 if over and rng.random() < 0.5 else float(rng.choice([0.5, 1.5])))
    return [(s, r, sc, ne) for (s, r), (sc, ne) in edges.items()]


@pytest.mark.parametrize("chunk", [3, 1000])
def test_match_serial(spark, chunk):
    rng = random.Random(7)
    media = {m: random_edges(rng, rng.randint(1, 25)) for m in range(30)}
    # A chain in which every conflict pushes the next source on.
    media[99] = [(s, r, 5.0, 0.0) for s in range(20) for r in (0, s, s + 1)]
    rows = [(m, s, r, sc, ne) for m, edges in media.items() for s, r, sc, ne in set(edges)]
    df = spark.createDataFrame(rows, "media_id long, src_idx int, ref_idx int, score double, near double")
    got = {}
    for row in mt.match_serial(df, chunk=chunk).collect():
        got.setdefault(row.media_id, []).append((row.src_idx, row.ref_idx))
    for m, edges in media.items():
        assert sorted(got.get(m, [])) == serial(set(edges)), m


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_match_greedy(spark, chunk):
    rng = random.Random(3)
    rows = [(m, s, r, rng.randint(1, 3)) for m in range(15) for s in range(8) for r in range(8) if rng.random() < 0.4]
    # A chain in which every edge blocks the next.
    rows += [(99, s, r, 100 - s - r) for s in range(12) for r in (s, s + 1)]
    df = spark.createDataFrame(rows, "media_id long, src_idx int, ref_idx int, weight int")
    got = sorted((r.media_id, r.src_idx, r.ref_idx) for r in mt.match_greedy(df, chunk).collect())
    want, used_s, used_r = [], set(), set()
    for m, s, r, w in sorted(rows, key=lambda e: (e[0], -e[3], e[1], e[2])):
        if (m, s) not in used_s and (m, r) not in used_r:
            want.append((m, s, r))
            used_s.add((m, s))
            used_r.add((m, r))
    assert got == sorted(want)


@pytest.mark.parametrize("hot, chunk", [(tm.HOT, tm.CHUNK), (3, tm.CHUNK), (3, 4), (0, 3)])
@pytest.mark.parametrize("by_weight", [True, False])
def test_match_by_tokens(spark, by_weight, hot, chunk):
    rng = random.Random(11)
    words = list("abcdef")

    def track():
        # One word is on a third of all cues.
        return [(m, i, sorted(set(rng.sample(words, rng.randint(0, 3)) + (["hot"] if rng.random() < 0.33 else []))))
                for m in range(12) for i in range(14)]

    src, ref = track(), track()
    schema = "media_id long, cue_idx int, tokens array<string>"
    got = sorted(
        (r.media_id, r.src_idx, r.ref_idx)
        for r in tm.match_by_tokens(spark.createDataFrame(src, schema), spark.createDataFrame(ref, schema), by_weight, hot, chunk).collect()
    )
    want = []
    for m in range(12):
        pairs = [(len(set(a) & set(b)), i, j) for x, i, a in src if x == m for y, j, b in ref if y == m and set(a) & set(b)]
        order = sorted(pairs, key=lambda p: (-p[0], p[1], p[2])) if by_weight else sorted(pairs, key=lambda p: (p[1], -p[0], p[2]))
        us, ur = set(), set()
        for _, i, j in order:
            if i not in us and j not in ur:
                want.append((m, i, j))
                us.add(i)
                ur.add(j)
    assert got == sorted(want)


def two_tokens(src, ref):
    """Greedy by (weight, source, reference) of cues with at most a hot and a rare token, in linear time."""
    taken, picks = set(), {}
    rare = {}
    for i, tokens in enumerate(ref):
        for t in tokens:
            rare.setdefault(t, []).append(i)
    at = 0
    for weight in (2, 1):
        for s, tokens in enumerate(src):
            if s in picks:
                continue
            near = [r for t in tokens if t != "hot" for r in rare.get(t, ()) if r not in taken and len(set(tokens) & set(ref[r])) == weight]
            if weight == 1 and "hot" in tokens:
                queue = rare.get("hot", [])
                while at < len(queue) and queue[at] in taken:
                    at += 1
                near += queue[at : at + 1]
            if near:
                picks[s] = min(near)
                taken.add(picks[s])
    return picks


def test_match_by_tokens_large_media(spark):
    """One media of 200 000 cues, a word on a third of them: no task has more than a chunk."""
    rng = random.Random(2)
    n = 200_000

    def track():
        return [(["hot"] if rng.random() < 1 / 3 else []) + ([f"t{rng.randrange(n // 2)}"] if rng.random() < 0.3 else []) for _ in range(n)]

    src, ref = track(), track()
    frames = []
    for side in (src, ref):
        pdf = pd.DataFrame({"media_id": 1, "cue_idx": range(n), "t": [" ".join(x) for x in side]})
        frames.append(spark.createDataFrame(pdf).select("media_id", F.col("cue_idx").cast("int").alias("cue_idx"), F.filter(F.split("t", " "), lambda x: x != "").alias("tokens")))
    got = {r.src_idx: r.ref_idx for r in tm.match_by_tokens(*frames, True).collect()}
    assert got == two_tokens(src, ref) and len(got) > 60_000


def test_text_pairs_equals_all_pairs(spark):
    """The prefix filter loses no pair: compare with scoring every pair."""
    rng = random.Random(5)
    words = "the a of to house mouse green river running runner night light x".split()

    def track():
        return [(m, i, 0, 1, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for m in range(6) for i in range(12)]

    schema = "media_id long, cue_idx int, start_ms long, end_ms long, text string"
    a, b = spark.createDataFrame(track(), schema), spark.createDataFrame(track(), schema)
    left, right = sj._texts(a, "a"), sj._texts(b, "b")
    every = sj.profiled(left, "a_norm", "_p").join(sj.profiled(right, "b_norm", "_q"), "media_id")
    scored = sj.pair_scores(every, "_p", "_q").withColumn("t", sj.total_score())
    for threshold in (0.6, 0.8):
        want = {(r.media_id, r.a_id, r.b_id) for r in scored.where(F.col("t") >= threshold).collect()}
        got = {(r.media_id, r.a_id, r.b_id) for r in sj.text_pairs(a, b, threshold).collect()}
        assert got == want


@pytest.mark.parametrize("threshold", [0.36, 0.4, 0.42])
def test_pieces_in_common(spark, threshold):
    """Texts of slightly changed words: no pair is lost, and few are looked at in vain."""
    rng = random.Random(9)
    words = [["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(200)] for _ in range(4)]

    def changed(word):
        at = rng.randrange(len(word))
        return word[:at] + rng.choice("xyz") + word[at + 1 :]

    lines = [(m, [rng.choice(words[m]) for _ in range(rng.randint(1, 9))]) for m in range(4) for _ in range(50)]
    left = [(m, i, 0, 1, " ".join(w)) for i, (m, w) in enumerate(lines)]
    right = [(m, i, 0, 1, " ".join(changed(x) for x in w)) for i, (m, w) in enumerate(lines)]
    schema = "media_id long, cue_idx int, start_ms long, end_ms long, text string"
    a, b = sj._texts(spark.createDataFrame(left, schema), "a").cache(), sj._texts(spark.createDataFrame(right, schema), "b").cache()
    every = sj.profiled(a, "a_norm", "_p").join(sj.profiled(b, "b_norm", "_q"), "media_id")
    scored = sj.pair_scores(every, "_p", "_q").withColumn("t", sj.total_score())
    want = {(r.media_id, r.a_id, r.b_id) for r in scored.where(F.col("t") >= threshold).collect()}
    looked = {(r.media_id, r.a_id, r.b_id) for r in sj.candidate_pairs(a, b, threshold, sim.scorers()).collect()}
    assert want <= looked and len(want) >= 40
    if threshold >= 0.4:
        assert len(looked) <= 10 * len(want)


def test_own_scorers(spark):
    """A weighted sum of the user's scorers, pruned by their bounds, equals the sum over all pairs."""
    rng = random.Random(6)
    words = "the a house mouse green river run runner night light lights nights".split()
    rows = [[(m, i, 0, 1, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for m in range(4) for i in range(12)] for _ in range(2)]
    schema = "media_id long, cue_idx int, start_ms long, end_ms long, text string"
    a, b = (spark.createDataFrame(r, schema) for r in rows)
    starts = sim.Scorer("starts", 0.3, lambda p, q: (F.substring(p["text"], 1, 4) == F.substring(q["text"], 1, 4)).cast("double"), cost=0)
    ends = sim.Scorer("ends", 0.2, lambda p, q: (F.try_element_at(p["words"], F.lit(-1)) == F.try_element_at(q["words"], F.lit(-1))).cast("double"),
                      lambda p, q: F.when((F.size(p["words"]) > 0) & (F.size(q["words"]) > 0), 1.0).otherwise(0.0), cost=2)
    own = (*sim.scorers({"edit": 0.3, "jaccard": 0.2}), starts, sim.Scorer("ends", 0.2, lambda p, q: F.coalesce(ends.score(p, q), F.lit(0.0)), ends.bound, 2))
    every = sj.profiled(sj._texts(a, "a"), "a_norm", "_p").join(sj.profiled(sj._texts(b, "b"), "b_norm", "_q"), "media_id")
    p, q = F.col("_p"), F.col("_q")
    whole = every.withColumn("t", sum((k.weight * k.score(p, q) for k in own[1:]), own[0].weight * own[0].score(p, q)))
    for threshold in (0.3, 0.5, 0.75):
        want = {(r.media_id, r.a_id, r.b_id): round(r.t, 9) for r in whole.where(F.col("t") >= threshold).collect()}
        got = {(r.media_id, r.a_id, r.b_id): round(r.similarity, 9) for r in sj.text_pairs(a, b, threshold, own).collect()}
        assert got == want and want


def test_text_pairs_below_common_words(spark):
    """Low thresholds reach pairs without a common word."""
    rng = random.Random(8)

    def track():
        return [(m, i, 0, 1, " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 3)))) for m in range(4) for i in range(10)]

    schema = "media_id long, cue_idx int, start_ms long, end_ms long, text string"
    a, b = spark.createDataFrame(track(), schema), spark.createDataFrame(track(), schema)
    left, right = sj._texts(a, "a"), sj._texts(b, "b")
    every = sj.profiled(left, "a_norm", "_p").join(sj.profiled(right, "b_norm", "_q"), "media_id")
    scored = sj.pair_scores(every, "_p", "_q").withColumn("t", sj.total_score()).cache()
    for threshold in (0.0, 0.3, 0.45):
        want = {(r.media_id, r.a_id, r.b_id) for r in scored.where(F.col("t") >= threshold).collect()}
        assert {(r.media_id, r.a_id, r.b_id) for r in sj.text_pairs(a, b, threshold).collect()} == want


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_scores_with_the_sequence_ratio(spark):
    """The queries with the sequence ratio against a loop over the standard library, on whole texts."""
    sf = "/root/testdata/sf0.001"
    names = ("jaccard", "cosine", "edit", "length", "common")
    pairs = cat._near_texts(spark, sf)
    scored = sj.pair_scores(sj.profiled(sj.profiled(pairs, "_a", "_p"), "_b", "_q"), "_p", "_q", names)
    rows = scored.select("media_id", "a_idx", "b_idx", F.col("_p.text").alias("x"), F.col("_q.text").alias("y"), *[f"s_{n}" for n in names]).collect()
    want = {
        (r.media_id, r.a_idx, r.b_idx): sum(sim.WEIGHTS[n] * r[f"s_{n}"] for n in names) + sim.WEIGHTS["sequence"] * ratio(r.x, r.y) for r in rows
    }
    got = {(r.media_id, r.a_idx, r.b_idx): r.similarity for r in cat.QUERIES["similarity_combined"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(got) > 1000


def test_two_way_similarity(spark):
    texts = [("Hello, World!", "hello world"), ("", "x"), ("a b c", "c b a"), ("Größe 12", "groesse 12"), ("你好 世界", "你好"), ("one two three", "two three four")]
    rows = spark.createDataFrame(texts, "a string, b string").select("a", "b", sim.text_sim2(F.col("a"), F.col("b")).alias("s")).collect()

    def loop(a, b):
        x, y = ("".join(c for c in t if c.isalnum() or c.isspace()).lower().strip() for t in (a, b))
        if not x or not y:
            return 0.0
        p, q = set(x.split()), set(y.split())
        return max(ratio(x, y), 0.8 * len(p & q) / len(p | q))

    assert [r.s for r in rows] == pytest.approx([loop(a, b) for a, b in texts])
