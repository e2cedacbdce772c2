"""Packing documents into sequences by minimum bin slack.

What a packing needs to know of the corpus is how many pieces there are of each
length: at most ``capacity`` rows, whatever the corpus. On these the driver runs
minimum bin slack: the longest piece left opens a bin, a subset-sum dynamic
programme over bitsets finds the fullest combination of available lengths that
fits beside it, and the combination is taken out. The same combination stays the
fullest while its lengths last, so it is taken as often as they allow at once;
the number of different combinations is bound by the lengths, not by the pieces.

Spark does the rest: pieces get their rank among those of their length (counted
per block of ids first, so no length's pieces meet in one task) and look up bin
and place in the table of combinations, whose size is bound as above.

Defined results: a null text is empty (one end token); a null id is an id like
any other; rows that repeat are packed as often as they stand; an empty table
gives no sequences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cueweave.llm.byte_bpe import NUMBER, char_classes
from cueweave.llm.common import batches_of, buffers, code_points, gather, slices, starts, string_array, strings, texts
from cueweave.llm.merge_matrix import PairTable, merge_all
from cueweave.plans.lineage import cut_lineage

CAPACITY = 2048
END_ID = 0
#: Fewest rows of a length that are ranked together (else the square root of their number).
BLOCK = 128
#: Texts that a task is given at once.
BATCH_ROWS = 1_000


# ---- tokens ----------------------------------------------------------------------

class WordBpe:
    """A lower-casing word tokenizer file (``tokenizers`` library), merged on matrices.

    White space never stands in a token, so texts are cut at it and only the
    different words of a slice are encoded. Words with characters beyond
    ``PLAIN`` or with a possible special string go to the library itself.
    """

    #: Code points whose composed form and lower case need no look at their neighbours.
    PLAIN = 0x130

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([[vocabulary[a], vocabulary[b], vocabulary[a + b]] for a, b in merges], np.int64)
        # Several merges may repeat a pair; the last rank counts there, as in a map.
        last = {(int(a), int(b)): (r, int(c)) for r, (a, b, c) in enumerate(ids)}
        pairs = np.array(list(last), np.int64)
        values = np.array(list(last.values()), np.int32)
        self.table = PairTable(pairs[:, 0], pairs[:, 1], values[:, 0], values[:, 1])
        names = byte_names()
        self.inner = np.array([vocabulary[names[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[names[b] + end] for b in range(256)], np.int32)
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(self.PLAIN)], np.uint32)

    def _plain_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of plain characters: runs of letters, single digits, runs of the rest."""
        points = code_points(data)
        width = 1 + (points > 0x7F).astype(np.int64)
        first = np.searchsorted(starts(width), offsets)
        points = self.lower[points]
        kind = char_classes(points)
        new = np.ones(len(points) + 1, bool)
        if len(points):
            new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        new[first] = True
        cuts = np.flatnonzero(new)
        lowered = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        place = starts(1 + (points > 0x7F).astype(np.int64))
        coded = string_array(lowered, place[cuts]).dictionary_encode()
        data, at = buffers(coded.dictionary)
        symbols = self.inner[data]
        symbols[at[1:] - 1] = self.final[data[at[1:] - 1]]
        ids, id_at = merge_all(symbols, at, self.table)
        ids, each = gather(ids, id_at, coded.indices.to_numpy())
        return ids, each[np.searchsorted(cuts, first)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each (different) word and their offsets."""
        hard = pc.match_substring_regex(words, rf"[^\x{{00}}-\x{{{self.PLAIN - 1:X}}}]|'|<\|").to_numpy(zero_copy_only=False)
        if not hard.any():
            return self._plain_words(*buffers(words))
        plain, rest = np.flatnonzero(~hard), np.flatnonzero(hard)
        ids_a, at_a = self._plain_words(*buffers(words.take(pa.array(plain))))
        found = [e.ids for e in self.library.encode_batch(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        ids_b = np.array([i for f in found for i in f], np.int32)
        at_b = starts(np.array([len(f) for f in found], np.int64))
        order = np.argsort(np.concatenate([plain, rest]), kind="stable")
        return gather(np.concatenate([ids_a, ids_b]), np.concatenate([at_a, at_b[1:] + at_a[-1]]), order)

    def encode_slice(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text and their offsets."""
        array = array.cast(pa.large_string())
        # The library doesn't count these as white space, Arrow does; special strings may hold any character.
        odd = pc.match_substring_regex(array, r"[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        for s in self.special:
            if any(c.isspace() for c in s):
                odd |= pc.match_substring(array, s).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(odd), "", array))
        parts = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        ids, at = self._words(coded.dictionary)
        ids, each = gather(ids, at, coded.indices.to_numpy())
        at = each[parts]
        rest = np.flatnonzero(odd)
        if not len(rest):
            return ids, at
        found = [self.library.encode(t.as_py(), add_special_tokens=False).ids for t in array.take(pa.array(rest))]
        more = starts(np.array([len(f) for f in found], np.int64))
        order = np.arange(len(array))
        order[rest] = len(array) + np.arange(len(rest))
        return gather(np.concatenate([ids, np.array([i for f in found for i in f], np.int32)]), np.concatenate([at, more[1:] + at[-1]]), order)


def byte_names() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for what follows U+0100.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(2)
def load(tokenizer_file: str) -> WordBpe:
    """One tokenizer per worker process."""
    return WordBpe(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (little-endian 32-bit) of every whole text, ``END_ID`` behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_file)
        for batch in slices(batches):
            ids, at = bpe.encode_slice(strings(batch))
            ids = np.insert(ids, at[1:], END_ID)
            at = at + np.arange(len(at))
            count = -(-np.diff(at) // capacity)
            rows = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(rows)) - np.repeat(starts(count)[:-1], count)
            start = piece * capacity
            length = np.minimum(np.diff(at)[rows] - start, capacity)
            data = ids.astype("<u4").view(np.uint8)
            edges = np.append(at[:-1][rows] + start, at[-1]) * 4
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(rows)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
                "length": pa.array(length), "ids": string_array(data, edges).cast(pa.large_binary()).cast(pa.binary()),
            })

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


# ---- bins -------------------------------------------------------------------------

def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within ``room``.

    Bit s of ``reach`` tells whether the lengths looked at so far can add up to s;
    a step per copy of a length (no more than fit) keeps the bitset it began with
    for the way back. Longer lengths are looked at first, so ties use short ones
    as late as possible.
    """
    inside = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        for _ in range(min(available[length], room // length)):
            more = reach | (reach << length) & inside
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + 1
            total -= length
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, combination) until no piece is left; combinations map a length to its copies per bin."""
    left, plan = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest({k: n for k, n in left.items() if n}, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in combination.items())
        plan.append((bins, combination))
        for k, n in combination.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return plan


def layout(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, copies per bin, place): which ranks of a length a combination takes."""
    rows, taken, first_bin = [], {}, 0
    for bins, combination in plan:
        place = 0
        for length in sorted(combination, reverse=True):
            copies = combination[length]
            low = taken.get(length, 0)
            taken[length] = low + bins * copies
            rows.append((length, low, taken[length], first_bin, copies, place))
            place += length * copies
        first_bin += bins
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (any columns, with ``doc_id, piece, length``), ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    with batches_of(spark, BATCH_ROWS):
        found = cut_lineage(found.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 40))), "pieces")
    lengths = found.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # at most ``capacity`` rows
    if any(k > capacity for k in counts):
        raise ValueError("a piece is longer than a sequence")
    # A length's pieces are dealt over blocks, so that neither a block's rows nor a length's blocks are many.
    parts = spark.createDataFrame([(k, -(-n // max(BLOCK, isqrt(n)))) for k, n in counts.items()], "length long, _parts long")
    dealt = found.join(F.broadcast(parts), "length").withColumn("_block", F.col("_block") % F.col("_parts")).drop("_parts")
    sizes = dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    order = [F.col("doc_id"), F.col("piece")]
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy(*order)) - 1)
    ranked = ranked.join(sizes.select("length", "_block", before.alias("_before")), ["length", "_block"]).withColumn(
        "_rank", F.col("_rank") + F.col("_before"))
    slots = spark.createDataFrame(
        layout(minimum_slack(counts, capacity)), "_length long, _low long, _high long, _bin long, _copies long, _place long"
    )
    rank = F.col("_rank") - F.col("_low")
    return (
        ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")))
        .withColumn("sequence_id", F.col("_bin") + F.floor(rank / F.col("_copies")).cast("long"))
        .withColumn("offset", F.col("_place") + rank % F.col("_copies") * F.col("length"))
        .select(*found.drop("_block").columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces with their checksum, sequence and offset; with the ids themselves if wanted."""
    found = pieces(docs, tokenizer_file, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(found if with_ids else found.drop("ids"), capacity)
