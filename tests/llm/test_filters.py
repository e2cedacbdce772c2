"""Quality rules against plain loops; toxicity on held-out labels."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cueweave.llm import quality, toxicity

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "a b c d e f g h " * 5000), (6, "x" * 100_000), (7, "line one\nline one\n\nline one\n \n "),
    (7, "line one\nline one\n\nline one\n \n "), (None, "plain words " * 30), (8, "Home | About | News | Help | Login\n" + "Some real prose stands here. " * 9),
    (9, "WORD!! " * 40), (10, "All rights reserved.\nPrivacy policy\nclick here to win\nshort"), (11, "é\x1cü\x85ß　x " * 30),
]


def base_loop(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n, r = len(words), len(inside)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def rows_of(docs):
    return sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in quality.judge(docs).collect()), key=str)


def test_base_counts(make, real):
    assert rows_of(make(AWKWARD)) == sorted(((str(i), *base_loop(t)) for i, t in AWKWARD), key=str)
    pairs = [(r.doc_id, r.text) for r in real.collect()]
    assert rows_of(real) == sorted(((str(i), *base_loop(t)) for i, t in pairs), key=str)
    assert quality.judge(make([])).count() == 0
    assert quality.judge(make(AWKWARD).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0))).count() == len(AWKWARD)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=5))
def test_repeated_words(texts):
    joined = [" ".join(t) for t in texts]
    codes, offsets = quality.word_codes(pa.array(joined, pa.string()))
    assert quality.repeated_words(codes, offsets).tolist() == [base_loop(t)[4] for t in joined]


def test_line_rules(make):
    good = "\n".join(f"Line{n} says something{n} of its{n} own and that{n} is{n} fine." for n in range(9))
    menu = "Home | About | News | Help | Login | Contact | Search"
    cases = [
        (1, good, True, good), (2, good + "\n" + menu, True, good), (3, "\n".join([menu + f" | {n}" for n in range(40)]) + "\n" + good, False, good),
        (4, good + "\nAccept cookies to go on.", True, good), (5, "\n".join(["#### $$$$ %%%% word"] * 3 + [f"*** a{n} *** ### $$$ b" for n in range(90)]) + "\n" + good, False, good),
        (6, good + "\nLine0 says something0 of its0 own and that0 is0 fine.", True, good),
    ]
    got = {r.doc_id: (r.kept, r.cleaned) for r in quality.judge(make([(i, t) for i, t, _, _ in cases])).collect()}
    assert got == {i: (k, c) for i, _, k, c in cases}


def test_clean_documents_stay(spark, real):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    judged = quality.judge(docs).where("not base_failed")
    assert judged.where("not kept").count() == 0 and judged.count() > 100


# ---- toxicity --------------------------------------------------------------------

def test_held_out(make):
    rows = make([(i, "x") for i in range(300)]).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, machine = fitted
    rows = toxicity.score(docs, machine).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    toxic, clean = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= toxicity.THRESHOLD for s in clean]) < 0.01 and np.mean([s >= toxicity.THRESHOLD for s in toxic]) > 0.6


def test_scores_use_the_text_alone(fitted, make):
    docs, labels, machine = fitted
    base = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("score", F.lit(9)).withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in toxicity.score(other, machine).collect()} == base
    again = toxicity.fit(docs.repartition(7), labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert {r.doc_id: r.score for r in toxicity.score(docs, again).collect()} == pytest.approx(base)  # held-out labels don't matter


def test_toxicity_awkward(fitted, make, spark):
    docs, labels, machine = fitted
    rows = toxicity.score(make(AWKWARD), machine).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.drop_toxic(make(AWKWARD), machine).columns == docs.columns
    left = {r.doc_id for r in toxicity.drop_toxic(docs, machine).collect()}
    assert left == {r.doc_id for r in toxicity.score(docs, machine).collect() if r.score < toxicity.THRESHOLD}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    k = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    for some, share in ((none, 0), (spark.createDataFrame([(k, 1, 1), (k, 1, 0), (None, 1, 1), (30, 0, None)], none.schema), 1)):
        flat = toxicity.fit(make([(k, "a b"), (30, None)]), some)
        assert [r.score for r in toxicity.score(make([(k, "a b"), (30, None)]), flat).collect()] == pytest.approx([share, share])
    assert toxicity.score(make([]), machine).count() == 0


def score_loop(machine, text):
    """The machine's definition: every pair of occurrences, one by one."""
    words = re.findall(r"[^\W\d_]+|[^\x00-\x7F]+", text.lower()) if text.isascii() else None
    if words is None:
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()
    cells = [toxicity.BUCKETS + min(int(np.log2(len(words) + 1)), toxicity.LENGTHS - 1)]
    for word in sorted(set(words)):
        for level, least in enumerate(toxicity.LEVELS):
            if words.count(word) >= least:
                cells += toxicity.buckets(np.array(toxicity.word_terms(word), np.uint64), level).tolist()
    raw = machine.bias + sum(float(machine.weights[c]) for c in cells)
    for i, a in enumerate(cells):
        for b in cells[:i]:
            raw += float(machine.vectors[a].astype(float) @ machine.vectors[b].astype(float))
    return 1 / (1 + np.exp(-raw))


def test_scores_by_loop(fitted, spark, make):
    """The registered query's columns from plain loops over pairs of terms."""
    docs, labels, machine = fitted
    found = {r.doc_id: r for r in queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    rows = [r for r in docs.orderBy(F.length("text"), "doc_id").limit(60).collect()]
    assert len(found) == docs.count()
    for r in rows:
        got, want = found[r.doc_id], score_loop(machine, r.text or "")
        assert got.score == pytest.approx(want, abs=1e-5) and got.predicted == (got.score >= 0.7)
        assert got.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_pairs_of_neutral_terms(spark, make):
    """A label that no sum of weights can give (one of two words, not both) is learnt through ``fit``, among other words."""
    rng = np.random.default_rng(0)
    filler = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows, toxic = [], []
    for i in range(4000):
        a, b = rng.integers(0, 2, 2)
        words = [*rng.choice(filler, 12), *["mention"] * a, *["remark"] * b]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        toxic.append((i, 1, int(a ^ b)))
    docs = make(rows)
    labels = spark.createDataFrame(toxic, "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r.score >= 0.5) == r.toxic for r in found]) > 0.95


def test_fit_bounds(spark, make, monkeypatch):
    """An id that stands on many rows, and long texts, don't pass the bounds."""
    k = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = make([(k, f"bad word{i}") for i in range(300)] + [(i, "fine words here") for i in range(10, 60)])
    labels = spark.createDataFrame([(k, 1, 1)] + [(i, 1, 0) for i in range(10, 60)], "doc_id long, quality int, toxic int")
    seen = []
    fit_machine = toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda *a: seen.append((len(a[3]), len(a[1]))) or fit_machine(*a))
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 200)
    monkeypatch.setattr(toxicity, "TRAIN_TERMS", 500)
    toxicity.fit(docs, labels)
    assert 0 < seen[0][0] < 200 and seen[0][1] <= 500
