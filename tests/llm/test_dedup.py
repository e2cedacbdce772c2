"""Exact and near duplicates against plain loops."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cueweave.llm import exact_dedup, simhash
from cueweave.llm.components import components
from cueweave.llm.sql import ORACLE

AWKWARD = [
    (1, "a b c d"), (2, "a  b\tc d"), (3, None), (4, ""), (5, " "), (6, "  \n"), (7, "a b c d"), (7, "a b c d"), (8, "a b c e"),
    (9, "A B C D"), (10, "é" * 5), (11, "word"), (12, "two words"), (13, "x y z " * 30_000), (None, "a b c d"), (None, None),
    (14, "x y z " * 30_000), (15, "a b"),
]


def exact_loop(pairs):
    """A row per row; of each group the row with the smallest id (ids before none) is kept, once."""
    rows, held = [], {}
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0)):
        body = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        first = body not in held
        held.setdefault(body, []).append(i)
        rows.append((i, body, first))
    return [(i, held[b][0], len(held[b]), first, hashlib.sha256(b.encode()).hexdigest()) for i, b, first in rows]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(make, weak):
    """With a hash that nearly always collides, the bytes alone part the groups."""
    kind = {"content_hash": lambda c: F.substring(F.encode(c, "UTF-8"), 1, 1)} if weak else {}
    docs = make(AWKWARD)
    rows = exact_dedup.exact_duplicates(docs, **kind).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, exact_loop(AWKWARD)))
    kept = exact_dedup.drop_duplicates(docs, **kind)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in exact_loop(AWKWARD) if r[3])


def test_exact_dedup_as_sql(make, tmp_path):
    """Rows that repeat, and rows without an id, as the twin has them."""
    make(AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    twin = con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({ORACLE['op8_exact_dedup']})").fetchall()
    rows = exact_dedup.exact_duplicates(make(AWKWARD)).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, twin))


def test_exact_dedup_other_columns(make):
    docs = make(AWKWARD).withColumn("hash", F.lit(1)).withColumn("_body", F.lit("x")).withColumn("keep_id", F.lit(2)).withColumn("a.b", F.lit(3))
    assert exact_dedup.exact_duplicates(docs).count() == len(AWKWARD)
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns and exact_dedup.drop_duplicates(docs).dtypes == docs.dtypes
    assert exact_dedup.exact_duplicates(make([])).count() == 0 and exact_dedup.drop_duplicates(make([])).count() == 0


def fingerprint_loop(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_loop(pairs, bits=2):
    fps = [fingerprint_loop(t) for _, t in pairs]
    return component_of([i for i, _ in pairs], fps, bits)


def component_of(ids, fps, bits):
    group = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    known = {}
    for i, g in zip(ids, group, strict=True):
        if i is not None:
            known[g] = min(i, known.get(g, i))
    return sorted(((i, f"{f:016x}", known.get(g)) for i, f, g in zip(ids, fps, group, strict=True)), key=str)


def test_simhash_awkward(make):
    got = simhash.near_duplicates(make(AWKWARD)).select("doc_id", simhash.hex_digits(), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == component_loop(AWKWARD)
    assert simhash.near_duplicates(make([])).count() == 0


def test_simhash_real(real):
    pairs = [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(real).select("doc_id", simhash.hex_digits(), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == component_loop(pairs)
    stays = simhash.drop_near_duplicates(real)
    assert stays.columns == real.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(i for i, _, c in component_loop(pairs) if i == c)


def crowd(n, seed):
    """Codes in clusters around a few centres, among random ones."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    out = [rng.integers(0, 2**63, n // 2, dtype=np.uint64)]
    for _ in range(n // 2):
        c = centres[rng.integers(12)]
        for bit in rng.integers(0, 64, rng.integers(0, 5)):
            c ^= np.uint64(1) << np.uint64(bit)
        out.append(np.array([c], np.uint64))
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_index_finds_every_link(bits):
    index = simhash.GrayIndex(crowd(1500, bits))
    found = set()
    for i, j in index.search(bits):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    codes = index.codes
    near = np.argwhere(np.triu(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= bits, 1))
    assert found == set(map(tuple, near.tolist()))


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_keep_components(spark, bits):
    codes = crowd(400, 7)
    nodes = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long").repartition(5)
    roots = {r.node: r.root for r in components(simhash.links(nodes, bits)).collect()}
    got = {}
    for c in codes.view(np.int64).tolist():
        got.setdefault(roots.get(c, c), []).append(c)
    want = {}
    for c, _, g in component_of([int(c) for c in codes.view(np.int64)], [int(c) for c in codes], bits):
        want.setdefault(g, []).append(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_masks_miss_any_bits():
    rng = np.random.default_rng(1)
    for bits in (1, 2, 3):
        for _ in range(500):
            flip = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
            assert any(m & flip == 0 for m in simhash.masks(bits))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)], "src long, dst long")
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 301)} | {(1000 + i, 1000) for i in range(1, 200)}
