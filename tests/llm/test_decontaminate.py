"""Positional index against plain loops."""

import glob
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cueweave.llm import decontaminate as dc
from cueweave.plans.lineage import noted

DATA = "/root/testdata/sf0.001"
ITEMS = [
    (1, "the quick brown fox jumps over the lazy dog while it rains outside today"), (2, "Two Words"), (3, "one"), (4, ""), (5, None), (6, "... !"),
    (1, "the quick brown fox jumps over the lazy dog while it rains outside today"), (10, "été À la plage n'est pas sûr du tout mais on y va"),
    (None, "no id here"), (20, "a a a a a a a a a a a a"),
]
DOCS = [
    (1, "Say: THE quick, brown fox jumps over the lazy dog while it"), (2, "the quick brown fox jumps over the lazy cat while it rains"),
    (3, None), (4, ""), (5, "two words two words"), (6, "one one one"), (7, "été À la plage n'est pas sûr du tout mais on y va"), (None, "no id here"),
    (8, "a " * 30), (8, "a " * 30), (9, "the quick brown really fox jumps over the lazy dog while it rains outside"), (10, "zero " * 50_000 + "two words"),
    (11, "quick the brown fox jumps over the lazy dog it while rains outside today"), (12, "twowords two-words"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items):
    out = set()
    for name, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            out.add(("" if name is None else str(name), tuple(w[k : k + 10])))
    return out


def loop(docs, items):
    all_windows = windows(items)
    out = []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in all_windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
        out.append((name, len(w), len(hit), len(found), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def near_loop(docs, items, slack):
    out = []
    for name, text in docs:
        w, found = words(text), set()
        places = {}
        for k, x in enumerate(w):
            places.setdefault(x, []).append(k)
        for item, window in windows(items):
            if all(x in places for x in window) and any(
                all(any(abs(p - s - j) <= slack for p in places[x]) for j, x in enumerate(window))
                for s in {p + d for p in places[window[0]] for d in range(-slack, slack + 1)}
            ):
                found.add(item)
        out.append((name, tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("found", F.lit(1)).withColumn("doc_id", F.lit(2))


@pytest.mark.parametrize("block", [1_000_000, 12])
def test_phrases_and_proximity(make, items, block):
    docs = make(DOCS).withColumn("found", F.lit("x")).withColumn("term", F.lit("x")).withColumn("a.b", F.lit(3))
    rows = dc.report(dc.search(dc.index(docs), items, words=block)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in rows), key=str)
    assert got == loop(DOCS, ITEMS)
    assert sorted(((r.doc_id, tuple(r.near_items)) for r in rows), key=str) == near_loop(DOCS, ITEMS, dc.SLACK)
    assert any(set(r.near_items) - set(r["items"]) for r in rows)


def test_spans(make, items):
    found = dc.search(dc.index(make(DOCS[:1])), items, slack=0).first().found
    assert sorted((m.item, m.start, m.length, m.exact) for m in found) == [("1", 1, 10, True), ("1", 2, 10, True)]


def test_empty_tables(make, items, spark):
    assert dc.contamination(make([]), items).count() == 0
    rows = dc.contamination(make(DOCS), items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.n_hit or r.near_items for r in rows)
    with pytest.raises(ValueError):
        dc.search(dc.index(make([])), items, slack=20)


def test_frontier_does_not_matter(make, items, monkeypatch):
    """Candidates are looked through a few at a time."""
    found = dc.windows([str(i) for i, _ in ITEMS], pa.array([t or "" for _, t in ITEMS]))
    row = dc.index(make(DOCS).coalesce(1)).first()
    args = found, pa.array(row.term), np.array(row["first"], np.int64), np.array(row.position, np.int64), 2
    whole = sorted(zip(*(x.tolist() for x in dc.intersect(*args)), strict=True))
    monkeypatch.setattr(dc, "FRONTIER", 1)
    assert whole == sorted(zip(*(x.tolist() for x in dc.intersect(*args)), strict=True)) and whole


def test_query(spark):
    """The registered query against the loop over all documents."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {w: {i for i, x in windows(items) if x == w} for _, w in windows(items)}
    rows = {r.doc_id: r for r in queries()["op11_decontamination"](spark, DATA).collect()}
    assert len(rows) == len(docs)
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[tuple(w[k : k + size])]
        r = rows[name]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert any(r.contaminated for r in rows.values())


def test_large_index_rows_are_held_a_few_at_once(spark):
    """Writers and readers hold a row group: one of all rows of a task would grow with the input."""
    # Each text is longer than a slice, so it is a row of the index.
    docs = spark.createDataFrame([(k, f"w{k} " * 1_400_000) for k in range(5)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("7", "w3 " * 10)], "item_id string, text string")
    paths = []
    with noted(paths):
        rows = dc.contamination(docs, items).select("doc_id", "n_hit").collect()
    assert sorted(map(tuple, rows)) == [(k, 1_400_000 if k == 3 else 0) for k in range(5)]
    files = [pq.ParquetFile(f).metadata for path in paths if "postings" in path for f in glob.glob(f"{path}/*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 5 and max(groups) <= dc.INDEX_ROWS
