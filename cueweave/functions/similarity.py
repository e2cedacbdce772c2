"""Pair similarity on normalised texts.

Everything but the sequence ratio is a built-in expression; the ratio has no
JVM counterpart and runs as one Arrow batch UDF on candidates that survived
the bounds of the cheaper scores. A ``Scorer`` is one score with its weight and the
upper bound that it declares, so a weighted sum of any scorers can be pruned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cueweave.functions import sequence
from cueweave.functions.text import alnum_text
from cueweave.plans.arrays import let

# Words ignored by the common-words score.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with "
    "i you we they this but or not have had do does did can could should would may might "
    "must shall"
).split()
# Weights of the combined score and of the anchor search score.
WEIGHTS = {
    "sequence": 0.25, "jaccard": 0.20, "cosine": 0.20,
    "edit": 0.15, "length": 0.10, "common": 0.10,
}
ANCHOR_WEIGHTS = {"sequence": 0.3, "jaccard": 0.2, "cosine": 0.3, "edit": 0.2}


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_ratios(a, b, None))


@F.pandas_udf(DoubleType())
def seq_ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio where it can be ``least`` or more by the characters in common, else null."""
    return pd.Series(_ratios(a, b, least.to_numpy()))


def _ratios(a: pd.Series, b: pd.Series, least: np.ndarray | None) -> np.ndarray:
    """Null texts (pairs that a guard has left out) give null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    x, y = a[known].tolist(), b[known].tolist()
    hopeful = np.ones(len(x), bool) if least is None else sequence.bounds(x, y) >= least[known] - 1e-9
    picked = np.flatnonzero(hopeful).tolist()
    out[np.flatnonzero(known)[hopeful]] = sequence.ratios([x[k] for k in picked], [y[k] for k in picked])
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


#: Words of 64 bits on which the words of a text are marked by their hashes.
MARKS = 3


def with_profile(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the struct ``out`` of a normalised text: distinct words, their counts, norm, non-stop words, and a ``sketch`` of them.

    Built in steps, so that no lambda re-evaluates the split of the text.
    """
    fields = [F.col(c).alias(n) for c, n in (("_d", "words"), ("_c", "counts"), ("_n", "norm"), ("_s", "solid"), ("_k", "sketch"))]
    return _with_words(df, text).withColumn(out, F.struct(F.col(text).alias("text"), *fields)).drop(*_STEPS)


def with_brief(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the struct ``out`` of a normalised text and its ``sketch``: enough for the bounds, and small where it is moved."""
    return _with_words(df, text).withColumn(out, F.struct(F.col(text).alias("text"), F.col("_k").alias("sketch"))).drop(*_STEPS)


_STEPS = ("_w", "_d", "_c", "_n", "_s", "_h", "_o", "_k")


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """Add the words ``_w`` of a text, its different ones ``_d`` and how often each of these occurs (``_c``)."""
    split = df.withColumn("_w", words(F.col(text))).withColumn("_d", F.array_distinct("_w"))
    # Only a text that repeats a word has to be searched for each of its words.
    once = F.size("_d") == F.size("_w")
    ones, searched = F.transform("_d", lambda w: F.lit(1).cast("bigint")), F.transform("_d", lambda w: (F.size("_w") - F.size(F.array_remove("_w", w))).cast("bigint"))
    return split.withColumn("_c", F.when(once, ones).otherwise(searched))


def _with_words(df: DataFrame, text: str) -> DataFrame:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    zero = F.lit(0).cast("bigint")
    norm = F.sqrt(F.aggregate("_c", zero, lambda s, c: s + c * c).cast("double"))
    counted = with_counts(df, text).withColumn("_n", norm).withColumn("_s", F.array_except("_d", stop))
    hashed = counted.withColumn("_h", F.transform("_s", lambda w: F.xxhash64(w))).withColumn("_o", F.array_intersect("_d", stop))

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))

    def marks(k: int) -> Column:
        mine = lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(MARKS)) == k
        return F.aggregate("_h", zero, lambda s, h: F.when(mine(h), s.bitwiseOR(bit(F.pmod(h, F.lit(64))))).otherwise(s))

    stops = F.aggregate("_o", zero, lambda s, w: s.bitwiseOR(bit(F.pmod(F.xxhash64(w), F.lit(64)))))
    most = F.coalesce(F.array_max("_c"), zero)
    return hashed.withColumn("_k", F.struct(
        F.length(text).alias("length"), F.size("_d").alias("n"), F.size("_s").alias("solid"), F.col("_n").alias("norm"), most.alias("most"), stops.alias("stops"),
        *[marks(k).alias(f"m{k}") for k in range(MARKS)],
    ))


def _set_ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def jaccard(p: Column, q: Column) -> Column:
    """Word-set Jaccard; two empty texts are equal."""
    w1, w2 = p["words"], q["words"]
    return F.when((F.size(w1) == 0) & (F.size(w2) == 0), 1.0).otherwise(_set_ratio(w1, w2))


def cosine(p: Column, q: Column) -> Column:
    """Cosine of word counts over the shared words."""
    def count(side: Column, w: Column) -> Column:
        return F.element_at(side["counts"], F.array_position(side["words"], w).cast("int"))

    # Only texts that repeat a word have to be searched for the counts.
    both, once = F.array_intersect(p["words"], q["words"]), (p["sketch"]["most"] <= 1) & (q["sketch"]["most"] <= 1)
    searched = F.aggregate(both, F.lit(0).cast("bigint"), lambda s, w: s + count(p, w) * count(q, w))
    dot = F.when(once, F.size(both).cast("bigint")).otherwise(searched)
    empty = (F.size(p["words"]) == 0) | (F.size(q["words"]) == 0)
    return F.when(empty, 0.0).otherwise(dot / (p["norm"] * q["norm"]))


#: Edits that are looked for first, in a band beside the diagonal of the table; the whole table is filled where there are more.
FEW_EDITS = 8


def edits(a: Column, b: Column) -> Column:
    """The Levenshtein distance; equal and near texts don't fill the whole table."""
    def whole(few: Column) -> Column:
        return F.when(few >= 0, few).otherwise(F.levenshtein(a, b))

    return F.when(a == b, 0).otherwise(let(F.levenshtein(a, b, FEW_EDITS), whole))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - edits(a, b) / longest)


def length_ratio(a: Column, b: Column) -> Column:
    return _ratio_of_lengths(F.length(a), F.length(b))


def _ratio_of_lengths(a: Column, b: Column) -> Column:
    longest = F.greatest(a, b)
    return F.when(longest == 0, 1.0).otherwise(F.least(a, b) / longest)


def common_words(p: Column, q: Column) -> Column:
    w1, w2 = p["solid"], q["solid"]
    return (
        F.when((F.size(w1) == 0) & (F.size(w2) == 0), 1.0)
        .when((F.size(w1) == 0) | (F.size(w2) == 0), 0.0)
        .otherwise(_set_ratio(w1, w2))
    )


def _shared(p: Column, q: Column, size: Callable[[Column], Column], marks: tuple[str, ...]) -> Column:
    """No more words are common: each mark that the other text lacks stands for a word that it lacks."""
    def left(one: Column, other: Column) -> Column:
        lone = [F.bit_count(one[m].bitwiseAND(F.bitwise_not(other[m]))) for m in marks]
        return size(one) - sum(lone[1:], lone[0])

    return F.least(left(p["sketch"], q["sketch"]), left(q["sketch"], p["sketch"]))


def _solid_shared(p: Column, q: Column) -> Column:
    return _shared(p, q, lambda x: x["solid"], tuple(f"m{k}" for k in range(MARKS)))


def _words_shared(p: Column, q: Column) -> Column:
    """Stop words and others are marked apart."""
    return _shared(p, q, lambda x: x["n"] - x["solid"], ("stops",)) + _solid_shared(p, q)


def jaccard_bound(p: Column, q: Column) -> Column:
    """Jaccard of as many common words as the sketches allow."""
    every = p["sketch"]["n"] + q["sketch"]["n"]
    return F.when(every == 0, 1.0).otherwise(let(_words_shared(p, q), lambda both: both / (every - both)))


def cosine_bound(p: Column, q: Column) -> Column:
    """Cosine if every word that can be common occurs most often."""
    x, y = p["sketch"], q["sketch"]
    empty = (x["n"] == 0) | (y["n"] == 0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), _words_shared(p, q) * x["most"] * y["most"] / (x["norm"] * y["norm"])))


def common_bound(p: Column, q: Column) -> Column:
    """Share of as many common non-stop words as the sketches allow."""
    x, y = p["sketch"]["solid"], q["sketch"]["solid"]
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(let(_solid_shared(p, q), lambda both: both / (x + y - both)))


def score(name: str, p: Column, q: Column) -> Column:
    """One of the six scores for two profile structs."""
    if name == "sequence":
        return seq_ratio(p["text"], q["text"])
    if name in ("edit", "length"):
        return {"edit": edit_similarity, "length": length_ratio}[name](p["text"], q["text"])
    return {"jaccard": jaccard, "cosine": cosine, "common": common_words}[name](p, q)


def weighted(cols: dict[str, Column], weights: dict[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        if name in cols:
            term = cols[name] * weight
            total = term if total is None else total + term
    return total


def ratio_bound(a: Column, b: Column) -> Column:
    """Largest sequence ratio two lengths allow: twice the shorter over the sum."""
    return _bound_of_lengths(F.length(a), F.length(b))


def _bound_of_lengths(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(2.0 * F.least(a, b) / (a + b))


@dataclass(frozen=True)
class Scorer:
    """A score from 0 to 1 of two profile structs, with its weight in the sum.

    ``bound`` is a cheaper column that the score never exceeds (1 if there is
    none); scorers of lower ``cost`` are computed first. ``above`` may compute the
    score given the least value that still matters, and give null below it.
    ``kind`` names one of the six scores, of which a join knows more than a bound.
    """

    name: str
    weight: float
    score: Callable[[Column, Column], Column]
    bound: Callable[[Column, Column], Column] | None = None
    cost: int = 1
    above: Callable[[Column, Column, Column], Column] | None = None
    kind: str | None = None


def _by_lengths(fn: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Lengths are counted once per text: a count looks at every byte."""
    return lambda p, q: fn(p["sketch"]["length"], q["sketch"]["length"])


def _by_texts(fn: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda p, q: fn(p["text"], q["text"])


def scorers(weights: dict[str, float] | None = None) -> tuple[Scorer, ...]:
    """The six scores with ``weights`` (the combined ones if None); those without a weight are left out."""
    known = {k.name: k for k in (
        Scorer("sequence", 0, _by_texts(seq_ratio), _by_lengths(_bound_of_lengths), 3, lambda p, q, least: seq_ratio_from(p["text"], q["text"], least)),
        Scorer("jaccard", 0, jaccard, jaccard_bound), Scorer("cosine", 0, cosine, cosine_bound), Scorer("edit", 0, _by_texts(edit_similarity), _by_lengths(_ratio_of_lengths), 2),
        Scorer("length", 0, _by_lengths(_ratio_of_lengths), cost=0), Scorer("common", 0, common_words, common_bound),
    )}
    return tuple(replace(known[n], weight=w, kind=n) for n, w in (WEIGHTS if weights is None else weights).items())


def position_penalty(src_idx: Column, ref_idx: Column, n_src: Column, n_ref: Column) -> Column:
    gap = F.abs(src_idx / F.greatest(F.lit(1), n_src - 1) - ref_idx / F.greatest(F.lit(1), n_ref - 1))
    return F.least(F.lit(0.3), gap * 0.5)


def variance_penalty(cols: list[Column]) -> Column:
    n = len(cols)
    mean = sum(cols[1:], cols[0]) / n
    squares = [(c - mean) * (c - mean) for c in cols]
    return F.least(F.lit(0.2), sum(squares[1:], squares[0]) / n * 2.0)


def confidence(combined: Column, position: Column, variance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), combined * (1 - position) * (1 - variance)))


def text_sim2(a: Column, b: Column) -> Column:
    """Sequence ratio of the letters-and-digits forms, or 0.8 of their word Jaccard if larger."""
    x, y = alnum_text(a), alnum_text(b)
    wx, wy = F.filter(F.split(x, r"\s+"), lambda w: w != ""), F.filter(F.split(y, r"\s+"), lambda w: w != "")
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.greatest(seq_ratio(x, y), _set_ratio(wx, wy) * 0.8))
