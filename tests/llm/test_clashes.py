"""Columns of the documents that bear the operators' own names change nothing."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cueweave.llm import byte_bpe, simhash, token_count

PAIRS = [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "x y z"), (4, "é " * 300)]
FILES = P.path("byte_bpe_50k.tiktoken"), P.PATTERN

OPERATORS = {
    "simhash": (lambda d: simhash.near_duplicates(d), ("fp", "first", "root", "mask", "bits", "node", "src", "dst", "component_id")),
    "token counts": (lambda d: token_count.count_tokens(d, P.path("piece_bpe_32k.model")), ("n_tokens", "n_bytes", "unit", "n")),
    "byte bpe": (lambda d: byte_bpe.decode(byte_bpe.encode(d, *FILES), *FILES), ("ids", "decoded", "rank", "piece")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(make, name):
    run, clashes = OPERATORS[name]
    docs = make(PAIRS)
    other = docs
    for c in clashes:
        other = other.withColumn(c, F.lit("x"))
    plain, clashing = run(docs), run(other.withColumn("a.b", F.lit(1)))
    names = [c for c in plain.columns if c in clashing.columns]
    assert names == plain.columns
    rows = lambda df: sorted(str(tuple(r)) for r in df.select(*names).collect())
    assert rows(plain) == rows(clashing) and len(rows(plain)) == len(PAIRS)
