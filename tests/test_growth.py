"""Steps whose cost must grow with the input alone: plans and results on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from cueweave.functions import similarity as sim
from cueweave.operators import similarity_join as sj
from cueweave.operators.timing import even_sample


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cues(spark, rows):
    return spark.createDataFrame(rows, "media_id bigint, cue_idx int, start_ms bigint, end_ms bigint, text string")


@pytest.mark.parametrize("n", [1, 5, 19, 20, 41, 103])
def test_even_sample(spark, n):
    cues = _cues(spark, [(1, i, i, i, "x") for i in range(n)] + [(2, 0, 0, 0, "y"), (2, None, 0, 0, "y")])
    step = max(1, n // min(20, n))
    got = [r.cue_idx for r in even_sample(cues, 20).where("media_id = 1").orderBy("cue_idx").collect()]
    assert got == [i * step for i in range(20) if i * step < n]
    # A list of wanted indexes is longer than the counts that the planner sees.
    assert "Generate" not in _plan(even_sample(cues, 20))


def test_sampled_pairs_are_not_moved(spark, monkeypatch):
    seen = []
    cut = sj.cut_lineage
    monkeypatch.setattr(sj, "cut_lineage", lambda df, label="cut": seen.append(_plan(df)) or cut(df, label))
    text = "the quick brown fox number {} jumps over the lazy dog"
    cues = _cues(spark, [(1, i, i, i, text.format(i * 7919)) for i in range(150)])
    got = sj.similarity_sample(cues, cues)
    assert {(r.src_idx, r.ref_idx) for r in got.collect()} == {(7 * i, 7 * i) for i in range(20)}
    # Samples and references meet by runs of cues, not by one key per pair.
    assert "_run" in next(p for p in seen if "_p" in p)


def test_best_pair_keeps_ties_and_bonus(spark):
    left = spark.createDataFrame([(1, 3, "one two three"), (1, 0, "four five six"), (2, 0, "alpha beta gamma")], "media_id bigint, a_idx int, text string")
    right = spark.createDataFrame(
        [(1, 9, "one two three"), (1, 4, "four five six"), (1, 6, "four five six"), (2, 1, "alpha beta delta"), (2, 2, "alpha gamma")],
        "media_id bigint, b_idx int, text string",
    )
    got = sj.best_pair(left, right, 0.3, bonus=lambda i, j: F.greatest(F.lit(0.0), 0.1 - (i + j) * 0.005))
    assert {r.media_id: (r.a_idx, r.b_idx) for r in got.collect()} == {1: (0, 4), 2: (0, 2)}


def test_timeline_moves_each_cue_once(spark):
    from cueweave.operators.joins import timeline_segments

    # Buckets are 60 s: a span over three of them, marks on a border, an empty and a reversed span, times below 0, a null.
    a = [(1, 0, 0, 1_000, "a0"), (1, 1, 59_000, 185_000, "a1"), (1, 2, 60_000, 120_000, "a2"), (1, 3, 70_000, 70_000, "none"),
         (1, 4, 90_000, 80_000, "none"), (2, 0, -500, 700, "b0"), (3, 0, 5, None, "c0"), (None, 0, 0, 9, "lost")]
    b = [(1, 0, 500, 2_000, "z0"), (1, 1, 400_000, 401_000, ""), (1, 2, 61_000, 500_000, "z2"), (2, 0, None, 300, "y0"), (2, 1, -20, -10, "y1")]

    def loop(media):
        tracks = [[r for r in t if r[0] == media] for t in (a, b)]
        times = sorted({t for tr in tracks for r in tr for t in r[2:4] if t is not None})
        for t, after in zip(times, times[1:], strict=False):
            texts = [next((r[4] for r in sorted(tr, key=lambda r: r[1]) if max(r[2] or 0, 0) <= t < max(r[3] or 0, 0)), "") for tr in tracks]
            if t >= 0 and any(texts):
                yield media, t, after, "\n".join(x for x in texts if x)

    got = timeline_segments(_cues(spark, a), _cues(spark, b))
    assert sorted(map(tuple, got.collect())) == sorted(r for m in (1, 2, 3) for r in loop(m))
    # Texts pass one exchange; no join of segments with cues multiplies them.
    plan = _plan(got)
    assert "Join" not in plan and "segments" not in plan


def test_islands_write_each_text_once(spark, monkeypatch):
    from cueweave.operators.timing import anti_jitter
    from cueweave.plans import ordered

    seen = []
    cut = ordered.cut_lineage
    monkeypatch.setattr(ordered, "cut_lineage", lambda df, label="cut": seen.append((df.columns, _plan(df))) or cut(df, label))
    # Chunks are 600 s: an island over the border, one that ends there, equal texts after a gap.
    rows = [(1, 0, 0, 10, "x"), (1, 1, 50, 599_990, "x"), (1, 2, 600_000, 600_500, "x"), (1, 3, 600_700, 600_800, "x"), (1, 4, 600_800, 600_900, "y"),
            (2, 0, 599_000, 599_999, "y"), (2, 1, 600_000, 600_001, "z"), (2, 2, 600_001, 600_002, None), (2, 3, 600_002, 600_003, None)]
    got = anti_jitter(_cues(spark, rows)).collect()
    assert sorted((r.media_id, r.cue_idx, r.start_ms, r.end_ms, r.n_joined) for r in got) == [
        (1, 0, 0, 600_500, 3), (1, 3, 600_700, 600_800, 1), (1, 4, 600_800, 600_900, 1),
        (2, 0, 599_000, 599_999, 1), (2, 1, 600_000, 600_001, 1), (2, 2, 600_001, 600_002, 1), (2, 3, 600_002, 600_003, 1)]
    assert sorted(seen[0][0]) == ["_chunk", "_local", "cue_idx", "end_ms", "media_id", "start_ms", "text"]


def test_equal_texts_meet_alone(spark, monkeypatch):
    seen = []
    candidates = sj.candidate_pairs
    monkeypatch.setattr(sj, "candidate_pairs", lambda left, right, *rest: seen.append(left.count()) or candidates(left, right, *rest))
    src = _cues(spark, [(1, 0, 0, 0, "the red fox runs home"), (1, 1, 0, 0, "the red fox ran home"), (1, 2, 0, 0, "!!"), (1, 3, 0, 0, "the red fox runs home")])
    ref = _cues(spark, [(1, 0, 0, 0, "the red fox rans home"), (1, 1, 0, 0, "the red fox runs home"), (1, 2, 0, 0, "the red fox runs hom"), (1, 3, 0, 0, "the red fox runs home")])

    def best(**how):
        found = {}
        for r in sj.text_pairs(src, ref, 0.5, **how).collect():
            key = (r.similarity, -r.b_id, r._var)
            found[r.a_id] = max(found.get(r.a_id, key), key)
        return found

    whole = best()
    assert best(best=True) == whole and whole[0][1] == -1
    # The text that both tracks have isn't looked for among the others.
    assert seen[1] == seen[0] - 1


def test_scores_are_computed_once(spark):
    pairs = spark.createDataFrame([("a b c", "a b d")], "x string, y string")
    pairs = sj.profiled(sj.profiled(pairs, "x", "_p"), "y", "_q").localCheckpoint()
    plan = _plan(sj.prune_and_score(pairs, 0.6))
    assert plan.count("levenshtein") <= 2 and plan.count("array_intersect") <= 8


def test_sequence_ratio_is_computed_once(spark):
    pairs = spark.createDataFrame([("a b c", "a b d")], "x string, y string")
    pairs = sj.profiled(sj.profiled(pairs, "x", "_p"), "y", "_q").localCheckpoint()
    assert _plan(sj.prune_and_score(pairs, 0.6)).count("ArrowEvalPython") == 1


def test_words_of_a_text_are_not_moved(spark):
    """Prefix words come from the text's own row, by the order and the bound of the rule."""
    texts = spark.createDataFrame([(1, 0, "the the of zebra zebra yak"), (1, 1, "the"), (1, 2, "")], "media_id long, a_id int, a_norm string")
    w = {"jaccard": 0.2, "cosine": 0.2, "common": 0.1}
    found = sj._prefix_words(texts, "a", 0.25, w)
    assert "Exchange" not in _plan(found)
    # the, of: 0.1 + 0.2 * sqrt(0.5) = 0.241; with yak 0.15 + 0.2 * sqrt(0.6) + 0.05 = 0.355.
    assert sorted((r.a_id, r.word) for r in found.collect()) == [(0, "yak"), (0, "zebra"), (1, "the")]


def test_sketches_bound_the_scores(spark):
    rng = random.Random(3)
    words = "the a of to house mouse green river running x".split() + [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words[: rng.choice([6, 12, 400])], k=rng.choice([0, 1, 3, 8, 300]))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    p, q = F.col("_p"), F.col("_q")
    pairs = sj.profiled(rows, "x", "_p").drop("x").crossJoin(sj.profiled(rows, "x", "_q").drop("x"))
    known = {k.name: k for k in sim.scorers()}
    cols = [c for n in ("jaccard", "cosine", "common", "edit", "length") for c in (known[n].score(p, q).alias(n), (known[n].bound or known[n].score)(p, q).alias(f"{n}_u"))]
    found = pairs.select(*cols).collect()
    assert all(r[n] <= r[f"{n}_u"] + 1e-9 for r in found for n in ("jaccard", "cosine", "common", "edit", "length"))
    assert sum(r.jaccard_u <= r.jaccard + 0.1 for r in found) > len(found) / 2
    brief = sim.with_brief(rows, "x", "_p").join(sj.profiled(rows, "x", "_q"), "x").where("_p.sketch <> _q.sketch or _p.text <> _q.text")
    assert brief.isEmpty()
