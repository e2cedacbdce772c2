"""The pipeline followed by plain loops; revisit resolution against a plain loop and its SQL twin."""

import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueweave.llm import pii, toxicity, warc
from cueweave.llm.sql import ORACLE
from tests.llm.test_near_copies import groups_loop

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_step_by_step(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    machine = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stage = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        stage = f(spark, stage, SF)
        if k == 4:
            break
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes, name
        # The same by loops.
        if name == "toxicity":
            score = machine.score(pa.array([r["text"] for r in rows], pa.string()))
            rows = [r for r, s in zip(rows, score, strict=True) if s < toxicity.THRESHOLD]
        elif name == "exact dedup":
            first = {}
            for r in sorted(rows, key=lambda r: r["doc_id"]):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r)
            rows = list(first.values())
        elif name == "near dedup":
            kept = {min(members)[1] for members in groups_loop([(r["doc_id"], r["text"]) for r in rows]).values()}
            rows = [r for r in rows if r["doc_id"] in kept]
        else:
            model = pii.fit(spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema))
            for r in rows:
                r["text"] = pii.redacted(r["text"], pii.find(r["text"], model)[1])
                r["n_chars"] = len(r["text"])
        assert sorted(map(tuple, stage.collect())) == sorted(tuple(r.values()) for r in rows), name
    got = stage.collect()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {}
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            want[r["doc_id"], p // 2048] = zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got} == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    again = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((d, p, c) for (d, p), c in want.items())


def test_stages_take_anything(spark, make):
    docs = make([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 4000), (4, "x " * 4000), (5, "mail a@b.cd")])
    docs = docs.withColumn("fp", F.lit(1)).withColumn("score", F.lit("s")).withColumn("hash", F.lit(None).cast("string"))
    for table in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, table, SF)
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()


# ---- revisits --------------------------------------------------------------------

URLS = [
    ("http://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top", "example.com/a?a=1&b=2"), ("https://example.com/a", "example.com/a"), ("//Example.com", "example.com"),
    ("example.com/A/", "example.com/A"), ("http://x.org:8080/?ref=1", "x.org:8080"), ("", ""), (None, None), ("http://x.org/refs?reference=1", "x.org/refs?reference=1"),
]


def test_canonical_url(spark):
    rows = spark.createDataFrame([(u,) for u, _ in URLS], "u string").select(warc.canonical_url(F.col("u")).alias("k")).collect()
    assert [r.k for r in rows] == [k for _, k in URLS]


def resolve_loop(records):
    canonical = dict(URLS) | {f"http://h.com/{k}": f"h.com/{k}" for k in range(5)}
    out = []
    for i, url, ts, status, headers, *_ in records:
        if status != 304:
            continue
        mine = {k.lower(): v for k, v in (headers or {}).items()}
        full = [r for r in records if r[3] == 200 and url is not None and r[1] is not None and None not in (ts, r[2]) and canonical[r[1]] == canonical[url] and r[2] < ts]
        if not full:
            out.append((i, "no_response", None, None, mine))
            continue
        r = max(full, key=lambda r: (r[2], r[0]))
        theirs = {k.lower(): v for k, v in (r[4] or {}).items()}
        strip = lambda e: None if e is None else e.removeprefix("W/")
        if mine.get("etag") is not None:
            good = strip(mine["etag"]) == strip(theirs.get("etag"))
        else:
            good = mine.get("last-modified") is None or mine["last-modified"] == theirs.get("last-modified")
        merged = theirs | {k: v for k, v in mine.items() if k in warc.UPDATES}
        out.append((i, "resolved", r[0], r[5], merged) if good else (i, "validator_mismatch", None, None, mine))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 10, 10**6])
def test_revisits(spark, span):
    rng = np.random.default_rng(4)
    records = [(1, None, 5, 304, None, None, None), (2, "http://h.com/0", None, 304, {"ETag": "a"}, None, None), (3, None, None, 200, None, "d", 1)]
    for i in range(10, 400):
        url = f"http://h.com/{rng.integers(5)}" if rng.random() < 0.9 else URLS[rng.integers(len(URLS))][0]
        status = int(rng.choice([200, 304, 304, 404]))
        headers = {}
        for name in ("ETag", "Last-Modified", "Content-Type", "Connection"):
            if rng.random() < 0.6:
                headers[name if rng.random() < 0.5 else name.lower()] = str(rng.choice(['"a"', 'W/"a"', '"b"']))
        records.append((i, url, int(rng.integers(0, 60)), status, headers, f"d{i}" if status == 200 else None, i))
    frame = spark.createDataFrame(records, "record_id long, url string, ts long, status int, headers map<string,string>, body_digest string, body_length long")
    rows = warc.resolve(frame.withColumn("span", F.lit(9)).withColumn("far", F.lit(1)), span).collect()
    assert sorted(((r.record_id, r.outcome, r.response_id, r.body_digest, r.headers) for r in rows), key=str) == resolve_loop(records)
    assert warc.resolve(frame.limit(0)).count() == 0


def test_revisits_as_sql(spark):
    from cueweave.llm.queries import QUERIES

    assert compare(QUERIES["op4_warc_revisits"](spark, SF), connect(SF), ORACLE["op4_warc_revisits"]).startswith("ok")
    assert compare(QUERIES["op8_exact_dedup"](spark, SF), connect(SF), ORACLE["op8_exact_dedup"]).startswith("ok")
    assert compare(QUERIES["op11_decontamination"](spark, SF), connect(SF), ORACLE["op11_decontamination"]).startswith("ok")


def test_bodies(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x"), (2, None, None)], "page_id long, url string, html string")
    resolved = warc.resolve(warc.archive(pages))
    bodies = pages.select((F.col("page_id") * 8 + 1).alias("record_id"), F.col("html").alias("body"))
    rows = {r.record_id: (r.outcome, r.body) for r in warc.attach_bodies(resolved, bodies).collect()}
    assert rows == {8: ("no_response", None), 10: ("resolved", "<p>x"), 12: ("resolved", "<p>x"), **{k: ("no_response", None) for k in (16, 18, 20)}}
