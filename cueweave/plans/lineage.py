"""Reliable lineage cuts for iterative operators and streaming sinks."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a session inside one JVM
    (tests, bench; not ``local-cluster``) that names none gets a temporary folder,
    as the checkpoint folder of its context.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cueweave-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_folder(spark)}/cueweave-{spark.sparkContext.applicationId}"


#: Lists that note the paths of tables as they are written.
_notes: list[list[str]] = []


@contextlib.contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note in ``paths`` the tables that ``cut_lineage`` writes meanwhile, for ``drop_tables``."""
    _notes.append(paths)
    try:
        yield
    finally:
        _notes.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables noted; what was read from them must be written by now."""
    while paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's tables; call it when the results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, label: str = "cut", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and continue from the written table.

    Survives executor loss, and later readers get column pruning and real
    sizes for the join planner, which an RDD checkpoint would not give them.
    Writers hold a row group and readers decode one at once: ``group_rows``
    bounds its rows where each is large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in _notes:
        paths.append(path)
    options = {} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows)}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
