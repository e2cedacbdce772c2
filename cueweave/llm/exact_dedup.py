"""Exact duplicates: one grouping by content hash, with the bytes as part of the key.

Plan: the normalised text is hashed once (SHA-256, of which the first 128 bits
are the content hash) and grouped by ``(128-bit hash, SHA-256, text)``. Rows of one
hash meet in one place and the text in the key compares their bytes, so texts
that collide in the hash form groups of their own. Grouping combines inside each
map task first: a text that a third of all rows hold leaves a task once. The
second scan carries digests only and learns its group through a join, whose hot
keys Spark splits.

``drop_duplicates`` moves the rows once: hashes alone tell which rows can have a
copy, and only those are grouped by their bytes.

Defined results: a null text is empty; null ids come last (``keep_id`` is null
only if no row of the group has an id); every row comes out, and ``group_size``
counts all of them; ``kept`` is true for one row of a group, of rows that share its
smallest id for one of them (in ``drop_duplicates`` by a hash of the text as it stands);
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import column_name
from cueweave.plans.lineage import cut_lineage


def normalised(text: Column | str) -> Column:
    """White space runs as one space; null as empty."""
    text = F.col(text) if isinstance(text, str) else text
    # Runs that are one space already stay untouched.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def hash128(text: Column) -> Column:
    """The content hash: the first 128 bits of the SHA-256, which is computed once for both."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _digests(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    body = docs.select("doc_id", normalised("text").alias("body"))
    return body.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("sha"), content_hash(F.col("body")).alias("hash"))


def groups(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per different text: ``hash, sha, keep_id, group_size``."""
    return (
        _digests(docs, content_hash).groupBy("hash", "sha", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("body")
    )


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    rows = cut_lineage(_digests(docs, content_hash).drop("body").join(groups(docs, content_hash), ["hash", "sha"]), "copies")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # Only rows that hold the smallest id of a group of several are numbered.
    head = first & (F.col("group_size") > 1)
    one = Window.partitionBy("hash", "sha").orderBy(F.lit(1))
    heads = rows.where(head).withColumn("kept", F.row_number().over(one) == 1)
    return rows.where(~head).withColumn("kept", F.col("group_size") == 1).unionByName(heads).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """The rows that stay, with the columns of ``docs``.

    The join by digests is split where a text is hot; of its rows one per task
    goes on to the grouping.
    """
    digest, sha, n, whole, body = (column_name(docs, c) for c in ("_hash", "_sha", "_n", "_row", "_body"))
    marked = docs.withColumn(body, normalised("text")).withColumns({sha: F.unhex(F.sha2(body, 256)), digest: content_hash(F.col(body))}).drop(body)
    # Texts without a copy pass by a join that keeps all rows; others meet by their bytes.
    many = _digests(docs, content_hash).groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("hash").alias(digest), F.col("sha").alias(sha), F.col("n").alias(n)
    )
    names = [F.col(f"`{c}`") for c in docs.columns]
    joined = marked.join(many, [digest, sha], "left")
    alone = joined.where(F.col(n).isNull()).select(*names)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"))
    again = (
        joined.where(F.col(n).isNotNull()).select(digest, sha, normalised("text").alias(body), F.struct(*names).alias(whole), order.alias(n))
        .groupBy(digest, sha, body).agg(F.min_by(whole, n).alias(whole)).select(F.col(f"{whole}.*"))
    )
    return alone.unionByName(again)
