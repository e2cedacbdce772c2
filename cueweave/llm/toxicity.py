"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings (``PREFIXES`` characters), each at the
levels "once or more", "twice or more", ... (``LEVELS``), and the text's length
as a power of two. Every term is hashed into one of ``BUCKETS``; none is left out.
The machine adds a weight per term and the product of two terms' vectors for
every pair of terms, so it learns that an insult beside a group mention weighs
more than each on its own; that takes time linear in the terms.

Most of a text's terms say nothing of its label, and there are more of them than
labelled texts. So a bucket's input is scaled by the evidence that it matters,
alone or beside another frequent term (``evidence``): doubtful ones start small, and
the fit can still raise them.

Fitting reads at most ``TRAIN_ROWS`` labelled texts (the smallest hashes of their
ids, so the choice is stable) with ``TRAIN_TERMS`` terms in all and fits the machine
on the driver, whose input is bound by the two numbers. Scoring is one pass over
all whole texts; a word's terms are looked up once per slice.

Defined results: a null or empty text is scored by its length alone; a null id
is held out (never learnt from) and scored; several labels of one id count as
the largest, null labels as none; texts that repeat an id are rows of their own
(of more than ``TRAIN_ROWS`` equal rows none is read);
without a row of both classes every score is the share of toxic rows (0 without
any); rows that repeat come out as often as they stand; other columns of the
table are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import buffers, gather, give_back, slices, starts, string_array, strings, texts
from cueweave.plans.lineage import cut_lineage

#: Most labelled rows that fitting reads, most terms in them, and what terms are hashed to.
TRAIN_ROWS, TRAIN_TERMS, BUCKETS = 16_000, 8_000_000, 2**18
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4, 8)
#: Bytes of text that a task handles at once.
SLICE = 2_000_000
#: Size of the vectors, rows of a step, fewest steps and rounds over the rows, step size.
FACTORS, BATCH, STEPS, ROUNDS, RATE = 6, 256, 200, 3, 0.02
#: Standard deviations from its share of toxic rows that make a bucket clear, alone or in a pair; toxic rows that it needs; buckets looked at in pairs.
CLEAR, CLEAR_PAIR, LEAST_ROWS, PAIRED = 3.5, 7.0, 3, 1_024
#: Least input, and the power by which less than clear evidence shrinks it.
FLOOR, POWER = 0.005, 4
#: Shrinkage: the weight of the prior against one row.
SHRINK = 0.06
LENGTHS = 24
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


# ---- terms -----------------------------------------------------------------------

_LETTERS = bytes(b if chr(b).isalpha() or b > 0x7F else 32 for b in range(256))


def _words(array: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different lower-case words (letters between anything else in ASCII), each text's words, and offsets."""
    data, offsets = buffers(pc.utf8_lower(array.cast(pa.large_string())))
    spaced = np.frombuffer(data.tobytes().translate(_LETTERS), np.uint8)
    lists = pc.ascii_split_whitespace(string_array(spaced, offsets))
    parts = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = np.concatenate([[0], np.cumsum(real)])[parts]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets


def word_terms(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    parts = [f"{word}$", *(word[:n] for n in PREFIXES if n <= len(word))]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass"), 7) for p in parts]


def buckets(hashes: np.ndarray, level: int) -> np.ndarray:
    """The buckets of hashed terms at a level."""
    mixed = (hashes + np.uint64(level * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass
class Words:
    """Of a slice of texts: (text, word, times) triples, each different word's hashed terms and their offsets, words per text."""

    text: np.ndarray
    word: np.ndarray
    times: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    n_words: np.ndarray


def read_words(array: pa.Array) -> Words:
    words, codes, offsets = _words(array)
    of_word = [word_terms(w) for w in words.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key, times = np.unique(text << np.int64(32) | codes, return_counts=True) if len(codes) else (np.zeros(0, np.int64),) * 2
    hashes = np.array([t for ts in of_word for t in ts], np.uint64)
    return Words(key >> 32, key & 0xFFFFFFFF, times, hashes, starts(np.array([len(ts) for ts in of_word], np.int64)), np.diff(offsets))


def occurrences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every term of every different word of a text, at every level that it reaches; texts ascending."""
    rows, found = [], []
    for level, least in enumerate(LEVELS):
        enough = words.times >= least
        flat, ends = gather(buckets(words.hashes, level), words.at, words.word[enough])
        rows.append(np.repeat(words.text[enough], np.diff(ends)))
        found.append(flat)
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return rows[order], found[order]


def length_class(n_words: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n_words + 1).astype(np.int64), LENGTHS - 1)


# ---- the machine -------------------------------------------------------------------

@dataclass
class Machine:
    """Bias; weights and vectors of the buckets, then of the length classes."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, array: pa.Array) -> np.ndarray:
        """Probability for each text: sums per word first, then per text."""
        words = read_words(array)
        n, size = len(words.n_words), len(words.at) - 1
        last = BUCKETS + length_class(words.n_words)
        table = np.concatenate([self.weights[:, None], self.vectors, (self.vectors**2).sum(axis=1)[:, None]], axis=1)
        total = table[last].astype(np.float64)
        of = np.repeat(np.arange(size), np.diff(words.at))
        for level, least in enumerate(LEVELS):
            enough = words.times >= least
            if not enough.any():
                break
            found = table[buckets(words.hashes, level)]
            for c in range(table.shape[1]):
                per_word = np.bincount(of, found[:, c], size)
                total[:, c] += np.bincount(words.text[enough], per_word[words.word[enough]], n)
        raw = self.bias + total[:, 0] + 0.5 * ((total[:, 1:-1] ** 2).sum(axis=1) - total[:, -1])
        return 1 / (1 + np.exp(-np.clip(raw, -700, 700)))


def _once(at: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) pairs, each once, some rows at a time."""
    for start in range(0, len(at) - 1, 1_000):
        stop = min(start + 1_000, len(at) - 1)
        rows = np.repeat(np.arange(start, stop), np.diff(at[start : stop + 1]))
        key = np.unique(rows * BUCKETS + columns[at[start] : at[stop]])
        yield key // BUCKETS, key % BUCKETS


def evidence(at: np.ndarray, columns: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Input scale of every bucket, from ``FLOOR`` (relative to the clearest) to 1.

    A bucket is clear if its rows are toxic more or less often than all rows are,
    by ``CLEAR`` standard deviations. Of the ``PAIRED`` buckets that most rows have, two
    are clear together if rows with both are toxic more or less often than their
    separate odds would have it, by ``CLEAR_PAIR``: so terms that say nothing alone
    are found too.
    """
    n, share = len(labels), labels.mean()
    count, toxic = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    for rows, found in _once(at, columns):
        count += np.bincount(found, minlength=BUCKETS)
        toxic += np.bincount(found, labels[rows], BUCKETS)
    clear = np.abs(toxic - count * share) / np.sqrt(np.maximum(count, 1) * share * (1 - share))
    clear = np.where((toxic > count * share) & (toxic < LEAST_ROWS), np.minimum(clear, 1.0), clear) / CLEAR
    some = np.argsort(-count, kind="stable")[:PAIRED]
    some = some[(count[some] > 1) & (count[some] < n)]
    place = np.full(BUCKETS, -1)
    place[some] = np.arange(len(some))
    has = np.zeros((n, len(some)), np.float32)
    for rows, found in _once(at, columns):
        picked = place[found] >= 0
        has[rows[picked], place[found[picked]]] = 1
    both, bad = has.T @ has, (has * labels[:, None].astype(np.float32)).T @ has
    odds = lambda good, ill: np.log((ill + share) / (good + 1 - share))
    each = odds((count - toxic)[some], toxic[some])
    expected = 1 / (1 + np.exp(-(each[:, None] + each[None, :] - odds(n - labels.sum(), labels.sum()))))
    apart = np.abs(bad - both * expected) / np.sqrt(both * expected * (1 - expected) + 1)
    np.fill_diagonal(apart, 0)
    if len(some):
        clear[some] = np.maximum(clear[some], apart.max(axis=1) / CLEAR_PAIR)
    scale = np.maximum(np.minimum(clear, 1.0) ** POWER, FLOOR)
    return scale / scale.max()


def fit_machine(at: np.ndarray, columns: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Machine:
    """Logistic loss with shrinkage, small batches, Adam; starts from a fixed seed.

    ``columns``: the buckets of all rows, from offset ``at`` on; ``lengths``: the rows' length classes.
    """
    n, size = len(labels), BUCKETS + LENGTHS
    share = labels.mean() if n else 0.0
    if share in (0.0, 1.0):
        return Machine(40.0 if share else -40.0, np.zeros(size), np.zeros((size, FACTORS)))
    scale = np.concatenate([evidence(at, columns, labels), np.ones(LENGTHS)]).astype(np.float32)
    random = np.random.default_rng(5)
    # Column 0 holds the weights, the others the vectors; only buckets that rows have are fitted.
    marks = np.zeros(size, bool)
    marks[columns] = marks[BUCKETS + lengths] = True
    used, number = np.flatnonzero(marks), (np.cumsum(marks) - 1).astype(np.int32)
    columns, at = np.insert(number[columns], at[1:], number[BUCKETS + lengths]), at + np.arange(n + 1)
    theta = np.concatenate([np.zeros((len(used), 1)), random.normal(0, 0.05, (len(used), FACTORS))], axis=1).astype(np.float32)
    own, shrink = scale[used][:, None], SHRINK / n * np.array([1] + [5] * FACTORS, np.float32)
    bias, step = np.log(share / (1 - share)), 0
    mean, var, bias_mean, bias_var = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0
    for _ in range(max(ROUNDS, -(-STEPS * BATCH // n))):
        shuffled = random.permutation(n)
        for start in range(0, n, BATCH):
            batch = shuffled[start : start + BATCH]
            found, ends = gather(columns, at, batch)
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            part = (theta * own)[found]
            sums = np.stack([np.bincount(row, part[:, k], len(batch)) for k in range(FACTORS + 1)], axis=1)
            squares = np.bincount(row, (part[:, 1:] ** 2).sum(axis=1), len(batch))
            raw = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - labels[batch]) / len(batch)
            pull = error[row]
            grad = np.stack([np.bincount(found, pull * (sums[row, k] - part[:, k]) if k else pull, len(used)) for k in range(FACTORS + 1)], axis=1)
            grad = (grad * own).astype(np.float32) + shrink * theta
            step += 1
            mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
            bias_mean, bias_var = 0.9 * bias_mean + 0.1 * error.sum(), 0.999 * bias_var + 0.001 * error.sum() ** 2
            rise, spread = 1 - 0.9**step, 1 - 0.999**step
            theta -= RATE * (mean / rise) / (np.sqrt(var / spread) + 1e-8)
            bias -= RATE * (bias_mean / rise) / (np.sqrt(bias_var / spread) + 1e-8)
    whole = np.zeros((size, FACTORS + 1), np.float32)
    whole[used] = theta * own
    return Machine(float(bias), whole[:, 0].copy(), whole[:, 1:].copy())


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on the labelled texts that aren't held out."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    # An id may stand on many rows: rows are counted, by a hash of id and text.
    keyed = texts(docs).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")
    first = keyed.select("key").orderBy("key").limit(TRAIN_ROWS).toArrow().column("key")
    if len(first) == TRAIN_ROWS:
        keyed = keyed.where(F.col("key") < first[-1].as_py())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            words = read_words(strings(batch))
            text, found = occurrences(words)
            at = starts(np.bincount(text, minlength=batch.num_rows))
            yield pa.record_batch({
                "key": batch.column("key"), "toxic": pc.cast(batch.column("toxic"), pa.float64()), "length": length_class(words.n_words).astype(np.int32),
                "columns": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32))),
            })

    sample = cut_lineage(keyed.mapInArrow(read, "key long, toxic double, length int, columns array<int>"), "toxic-sample")
    sizes = sample.select("key", F.size("columns").alias("n")).toArrow().sort_by("key")
    within = np.cumsum(sizes.column("n").to_numpy()) <= TRAIN_TERMS
    if not within.all():
        sample = sample.where(F.col("key") < int(sizes.column("key")[int(np.argmin(within))].as_py()))
    machine = fit_machine(*_training(sample))
    give_back()
    return machine


def _training(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and buckets of the rows, in order of their keys, their length classes and labels."""
    found = sample.toArrow()
    order = np.argsort(found.column("key").to_numpy(), kind="stable")
    lists = found.column("columns").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), starts(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    flat, ends = gather(flat, ends, order)
    return ends, flat, found.column("length").to_numpy()[order].astype(np.int64), found.column("toxic").to_numpy()[order]


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            found = shared.value.score(strings(batch))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": found})

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below ``threshold``, with the columns of ``docs``; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            found = shared.value.score(pc.fill_null(strings(batch), ""))
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)
