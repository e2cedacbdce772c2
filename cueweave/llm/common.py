"""Small helpers shared by the operators: null-safe texts, bounded slices, ragged arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.plans.lineage import cut_lineage

#: Bytes of text that a task handles at once (a single longer text is handled alone).
SLICE_BYTES = 4_000_000


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns named, of a table that may have others."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until ``df`` has no such column (whatever its case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the keys of ``b`` go."""
    right = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [a[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    return a.join(right, on, how).drop(*[f"_r_{k}" for k in keys])


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a text (null: empty) in joins."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def one_per_group(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """The row of each group with the smallest id, then ``sha``, without an id last; the columns of ``docs``.

    ``rows``: ``doc_id, sha`` (``text_key``) and the group of every row of
    ``docs``. Of rows that repeat both id and text in a group one stays.
    """
    first = rows.groupBy(group).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("sha") == F.col("first.sha"))
    grouped = rows.join(first, group).groupBy("doc_id", "sha").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    sha = column_name(docs, "_sha")
    keyed = docs.withColumn(sha, text_key("text"))
    grouped = cut_lineage(grouped.where("not stays or n > 1").withColumnRenamed("sha", sha), "repeated")
    names = [F.col(f"`{c}`") for c in docs.columns]
    alone = null_safe(keyed, grouped.select("doc_id", sha), ["doc_id", sha], "left_anti").select(*names)
    again = null_safe(keyed, grouped.where("stays").select("doc_id", sha), ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha])
    return alone.unionByName(again.select(*names))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed meanwhile gets batches of at most so many rows: executor and worker hold a whole batch of texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system: idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most ``size`` bytes of text or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            give_back()
    give_back()


def strings(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column as plain strings (32-bit offsets would not hold more than 2 GB, so long ones keep 64)."""
    array = batch.column(column)
    return array if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array.cast(pa.large_string())


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string or binary array without nulls."""
    wide = array.cast(pa.large_binary())
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    offsets = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over UTF-8 bytes and int64 offsets."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points (uint32) of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets (one more than counts) of consecutive runs of these lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(flat: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``picks`` of a ragged array, one after another; their elements and offsets."""
    lengths = (offsets[1:] - offsets[:-1])[picks]
    out = starts(lengths)
    index = np.repeat(offsets[:-1][picks] - out[:-1], lengths) + np.arange(out[-1])
    return flat[index], out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of a ragged array."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lower_ascii(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
