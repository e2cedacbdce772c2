"""Token counts, encoding and packing against the public libraries."""

import base64
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from cueweave.llm import byte_bpe, merge_matrix, packing, token_count

RANKS = P.path("byte_bpe_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  a  b ", "a\tb\r\nc", "it's don't ''s 's's we'll'll", "ｆｕｌｌ ﬁ é é", "<s> x </s><unk><0x0A>", "▁a▁▁ b", "x\x00y\x1c\x1d z",
    "a\n \nb", "a \n b", "a\n\n\nb   c", "trail ", " lead", "１２３ ४५ 12ab34", "word " * 3000, "x" * 1500, "ab" * 900, "é" * 700, "the the  the",
    "नमस्ते दुनिया", "漢字かな交じり文", "🙂🙂 👩‍👩‍👧", "\x85a\x85 b", "end\n", "foo_bar.baz(qux)!='x'", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ ẞ",
    "​   x", "K Å Ω é", "1 000 000,50 €", "'", "''", " 's", "\n's",
]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def encoded(texts):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    ids, at = bpe.encode_slice(pa.array(texts, pa.string()))
    data, ends = bpe.decode_slice(ids.astype(np.int64), at)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)], [data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def test_encoding_as_the_library(tik, real):
    texts = TEXTS + [r.text for r in real.select("text").collect()]
    ids, back = encoded(texts)
    assert ids == [tik.encode_ordinary(t) for t in texts]
    assert back == [t.encode() for t in texts]


def test_counts_as_the_library(sp, real):
    texts = TEXTS + [r.text for r in real.select("text").collect()]
    got = token_count.load(PIECES).counts(pa.array(texts, pa.string()))
    assert got.tolist() == [len(x) for x in sp.encode(texts)]


words = st.text(st.sampled_from(list("abet hésT'19 \n\t.,-#▁ 　中🙂")), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=8))
def test_any_text(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encoded(texts) == ([tik.encode_ordinary(t) for t in texts], [t.encode() for t in texts])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_count.load(PIECES).counts(pa.array(texts, pa.string())).tolist() == [len(model.encode(t)) for t in texts]


def test_whole_tokens_are_proved(sp):
    whole = token_count.load(PIECES).whole.to_pylist()
    assert len(whole) > 10_000
    assert all(len(x) == 1 for x in sp.encode([w.replace("▁", " ")[1:] for w in whole if w != "▁"]))


def test_matrix_and_heap_agree():
    table = byte_bpe.load(RANKS, P.PATTERN).table
    rng = np.random.default_rng(3)
    for _ in range(30):
        row = byte_bpe.load(RANKS, P.PATTERN).bytes_ids[np.frombuffer(bytes(rng.choice(list(b"ethanois "), 60)), np.uint8)]
        flat, _ = merge_matrix.merge_all(row, np.array([0, len(row)]), table)
        assert flat.tolist() == merge_matrix.merge_long(row.tolist(), table)


def test_frames(make, tik, sp):
    docs = make([(1, "it is  so"), (1, "it is  so"), (None, None), (2, "")])
    got = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == sorted(
        (str(i), tik.encode_ordinary(t), t.encode()) for i, t in [(1, "it is  so"), (1, "it is  so"), (None, ""), (2, "")])
    counts = token_count.count_tokens(docs, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == [("1", 9, 4), ("1", 9, 4), ("2", 0, 0), ("None", 0, 0)]
    empty = make([])
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    assert token_count.count_tokens(empty, PIECES).count() == 0


# ---- packing -------------------------------------------------------------------

WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def word_ids(texts):
    ids, at = packing.load(WORDS).encode_slice(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_words_as_the_library(hf, real):
    texts = TEXTS + [r.text for r in real.select("text").collect()]
    assert word_ids(texts) == [hf.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abetShÉsĳŉ'T19 \n\t.,<|>İΣ\x1c\x85中🙂ß")), max_size=30), max_size=8))
def test_any_words(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    assert word_ids(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_is_the_fullest(available, room):
    sums = {0}
    for length, n in available.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.fullest(available, room)
    assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
    assert all(n <= available[k] for k, n in chosen.items())


def check_packing(rows, ids_of, capacity):
    """Pieces cut as they must be, gapless sequences; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, ids in ids_of.items():
        ids = ids + [0]
        cut = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        want = [(p, p * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for p, c in enumerate(cut)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc.pop(doc)) == want
    assert not by_doc
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing(real, hf):
    rows = packing.pack_documents(real, WORDS).collect()
    ids = {r.doc_id: hf.encode(r.text, add_special_tokens=False).ids for r in real.collect()}
    n = check_packing(rows, ids, packing.CAPACITY)
    least = -(-sum(len(i) + 1 for i in ids.values()) // packing.CAPACITY)
    assert n <= least + 2
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_packing_awkward(make, hf):
    pairs = [(1, None), (2, ""), (3, "a " * 5000), (4, "b"), (5, "c d e f"), (6, "x" * 4000)]
    for capacity in (1, 3, 64):
        rows = packing.pack_documents(make(pairs).withColumn("length", F.lit(1)).withColumn("ids", F.lit("x")), WORDS, capacity).collect()
        check_packing(rows, {i: hf.encode(t or "", add_special_tokens=False).ids for i, t in pairs}, capacity)
    twice = packing.pack_documents(make([(None, "a b"), (None, "a b"), (1, "a b")]), WORDS, 8).collect()
    assert sorted((r.sequence_id, r.offset) for r in twice) == [(0, 0), (0, 3), (1, 0)]
    assert packing.pack_documents(make([]), WORDS).count() == 0


def test_packing_many_of_one_length(spark):
    """Ranks go on across blocks."""
    found = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).cast("long").alias("length"))
    rows = packing.pack(found).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000 and {r.sequence_id for r in rows} == set(range(2500))


def test_packing_takes_small_batches(spark, monkeypatch):
    """No task holds more texts than ``BATCH_ROWS`` at once; the session's setting comes back."""
    from cueweave.llm import packing as pk

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, held = spark.conf.get(key), []
    cut = pk.cut_lineage

    def noted(df, label):
        held.append(int(spark.conf.get(key)))
        return cut(df, label)

    monkeypatch.setattr(pk, "cut_lineage", noted)
    docs = spark.range(30).selectExpr("id AS doc_id", "repeat('some words ', cast(id AS int) * 40) AS text")
    rows = pk.pack_documents(docs, P.path("word_bpe_49k.json")).collect()
    assert held == [pk.BATCH_ROWS] and spark.conf.get(key) == before
    assert {r.doc_id for r in rows} == set(range(30))
