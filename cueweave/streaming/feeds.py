"""Structured Streaming forms of the batch rules, for live caption feeds.

A feed is ``media_id, ts, start_ms, end_ms, text``. State is keyed by media and
bounded by a watermark; sinks write files below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.plans.lineage import scratch_path
from cueweave.sources.files import EXTENSIONS, decode, extension, parse_cues
from cueweave.sources.sink import BUNDLE


#: Event time and media of the row that ends a bounded feed (a null media would be filtered out before the watermark sees it).
END, END_MEDIA = "9000-01-01 00:00:00", -(2**62)


def _run(stream: DataFrame, base: str) -> None:
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def run_available(build: Callable[..., DataFrame], *feeds: DataFrame) -> DataFrame:
    """The whole answer of ``build(*feeds)`` over everything available, as a batch table.

    Append mode holds back what the watermark hasn't closed. So every feed is
    read together with a folder of its own that stays empty at first; when all
    there is has been processed, a row far in the future (``END``) of no real
    media goes into each folder and the query runs on from its checkpoint: the
    watermark passes the last event, and open windows, sessions and unmatched
    rows are written like all others. A live feed runs without the second step.
    """
    spark = feeds[0].sparkSession
    base = scratch_path(spark, "stream")
    folders = [f"{base}/end-{k}" for k in range(len(feeds))]
    for feed, folder in zip(feeds, folders, strict=True):
        spark.createDataFrame([], feed.schema).write.parquet(folder)

    def query() -> DataFrame:
        ends = [spark.readStream.schema(f.schema).parquet(folder) for f, folder in zip(feeds, folders, strict=True)]
        return build(*[f.unionByName(e) for f, e in zip(feeds, ends, strict=True)])

    _run(query(), base)
    for feed, folder in zip(feeds, folders, strict=True):
        last = {"ts": F.to_timestamp(F.lit(END)), "media_id": F.lit(END_MEDIA)}
        columns = [last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in feed.schema]
        spark.range(1).select(*columns).write.mode("append").parquet(folder)
    _run(query(), base)
    out = spark.read.schema(query().schema).parquet(f"{base}/out")
    return out.where(F.col("media_id") != END_MEDIA)


def ingest(spark: SparkSession, path: str, checkpoint: str, sink: str, bundled: bool = False) -> None:
    """Append the cues of files that are new since the last run to ``sink``; safe to rerun.

    ``path`` holds subtitle files (or, ``bundled``, those of
    :func:`cueweave.sources.sink.write_bundles`). Rows: ``path, format, cue_idx,
    start_ms, end_ms, text``.
    """
    if bundled:
        found = spark.readStream.schema(BUNDLE).parquet(path).select("path", "ext", "content")
    else:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        files = (
            spark.readStream.format("binaryFile").schema(schema)
            .option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").option("recursiveFileLookup", "true").load(path)
        )
        found = files.select("path", extension(F.col("path")).alias("ext"), "content")
    cues = parse_cues(decode(found.withColumnRenamed("path", "media_id"))).withColumnRenamed("media_id", "path")
    cues.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def dedup(feed: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated cues of a media within the watermark delay; later rows are dropped."""
    tick = [F.call_function("div", F.col(c) + 5, F.lit(10)).alias(f"{c}_tick") for c in ("start_ms", "end_ms")]
    return (
        feed.withWatermark("ts", delay).select("*", *tick)
        .dropDuplicatesWithinWatermark(["media_id", "start_ms_tick", "end_ms_tick", "text"])
        .drop("start_ms_tick", "end_ms_tick")
    )


def time_join(left: DataFrame, right: DataFrame, tolerance_ms: int = 500, delay: str = "10 minutes") -> DataFrame:
    """Candidates of two feeds whose events are at most the tolerance apart; unmatched left rows come with NULLs."""
    a = left.withWatermark("ts", delay).select(
        F.col("media_id"), F.col("ts").alias("ts_a"), F.col("text").alias("text_a")
    )
    b = right.withWatermark("ts", delay).select(
        F.col("media_id").alias("media_b"), F.col("ts").alias("ts_b"), F.col("text").alias("text_b")
    )
    span = f"interval {tolerance_ms} milliseconds"
    return a.join(
        b, F.expr(f"media_id = media_b and ts_b between ts_a - {span} and ts_a + {span}"), "left_outer"
    ).select("media_id", "ts_a", "text_a", "ts_b", "text_b")


def drift(diffs: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per media and tumbling window: number, largest and median of ``diff_ms``."""
    return (
        diffs.withWatermark("ts", delay).groupBy("media_id", F.window("ts", window).alias("w"))
        .agg(
            F.count("*").alias("n"), F.max("diff_ms").alias("max_ms"),
            F.approx_percentile("diff_ms", 0.5, 100_000).alias("median_ms"),
        )
        .select("media_id", F.col("w.start").alias("window_start"), "n", "max_ms", "median_ms")
    )


def bursts(feed: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of events of a media with gaps below ``gap``."""
    return (
        feed.withWatermark("ts", delay).groupBy("media_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_cues"), F.max("ts").alias("last_ts"))
        .select("media_id", F.col("w.start").alias("first_ts"), "last_ts", "n_cues")
    )
