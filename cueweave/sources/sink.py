"""Writing rendered files: bundles for a corpus, single files for chosen media."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE = "path string, ext string, media_id bigint, length bigint, content binary"


def file_rows(blocks: DataFrame, ext: str) -> DataFrame:
    """One row per media from ``media_id, seq, block``: ``path, ext, media_id, length, content``.

    A file is one row here as it is when it is read, so that is its bound.
    """
    ordered = F.sort_array(F.collect_list(F.struct("seq", "block")))
    whole = blocks.groupBy("media_id").agg(F.encode(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n"), "UTF-8").alias("content"))
    return whole.select(
        F.concat(F.col("media_id").cast("string"), F.lit(f".{ext}")).alias("path"), F.lit(ext).alias("ext"), "media_id",
        F.length("content").cast("bigint").alias("length"), "content",
    )


def write_bundles(blocks: DataFrame, path: str, ext: str) -> None:
    """Write files bundled by hash range of their media: few large Parquet files, whatever the number of media.

    :func:`cueweave.sources.files.scan_bundles` reads them as a scan of single files would.
    """
    file_rows(blocks, ext).write.mode("append").parquet(path)


def export_files(spark: SparkSession, bundles: DataFrame, path: str) -> int:
    """Write chosen media (``media_id, ext, content``) as single files ``<media_id>.<ext>`` below ``path``; returns their number.

    Meant for a selection: every file is one entry of the folder. Tasks write
    each media's text apart; the driver only renames the finished files.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    work, target = fs_path(f"{path}/_export-{uuid.uuid4().hex}"), fs_path(path)
    rows = bundles.select("media_id", "ext", F.col("content").cast("string").alias("value"))
    rows.repartition("media_id").write.partitionBy("media_id", "ext").text(work.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    count, listed = 0, fs.globStatus(fs_path(f"{work}/media_id=*/ext=*/part-*"))
    for status in listed:
        at = status.getPath()
        ext = at.getParent().getName().removeprefix("ext=")
        media = at.getParent().getParent().getName().removeprefix("media_id=")
        if not fs.rename(at, fs_path(f"{path}/{media}.{ext}")):
            raise OSError(f"{media}.{ext} is there already")
        count += 1
    fs.delete(work, True)
    return count
