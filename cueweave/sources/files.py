"""Corpus scan, byte decoding, format dispatch, validation and the re-encode job."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cueweave.functions.text import CJK_CHINESE, clean_text, eol_norm
from cueweave.plans.arrays import rows_of
from cueweave.sources import ass, srt, vtt
from cueweave.sources.sink import BUNDLE

# Extensions and, after UTF-8 fails, the decoding order.
EXTENSIONS = ("srt", "ass", "ssa", "vtt")
CHINESE_ENCODINGS = ("gb18030", "gbk", "gb2312", "big5", "big5-hkscs", "cp950", "hz-gb-2312")
OTHER_ENCODINGS = ("utf-16", "latin-1", "cp1252", "shift-jis")

_DECODED = StructType([StructField("text", StringType()), StructField("encoding", StringType())])
_HAS_CHINESE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", CJK_CHINESE))


def scan_corpus(spark: SparkSession, path: str, recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path, stem, ext, format, length, content`` of every subtitle file below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        extension(F.col("path")).alias("ext"), format_of(F.col("path")).alias("format"),
        "length", "content",
    )


def scan_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The columns of :func:`scan_corpus`, and ``media_id``, of files written by :func:`cueweave.sources.sink.write_bundles`."""
    rows = spark.read.schema(BUNDLE).parquet(path)
    return rows.select("media_id", "path", F.regexp_replace("path", r"\.[^.]*$", "").alias("stem"), "ext", format_of(F.col("path")).alias("format"), "length", "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def format_of(path: Column) -> Column:
    """Format by extension, NULL if unsupported."""
    ext = extension(path)
    return F.when(ext.isin(*EXTENSIONS), ext)


@F.pandas_udf(_DECODED)
def decode_legacy(content: pd.Series) -> pd.DataFrame:
    """Decode bytes that are not UTF-8: Chinese encodings if CJK shows up, then the rest."""
    def ladder(data: bytes) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        for name in CHINESE_ENCODINGS + OTHER_ENCODINGS:
            if name == "utf-16" and data[:2] not in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
                continue
            try:
                text = data.decode(name)
            except (UnicodeError, LookupError):
                continue
            if name in OTHER_ENCODINGS or _HAS_CHINESE.search(text):
                return text, name
        return data.decode("utf-8", "replace"), "utf-8"

    return pd.DataFrame([ladder(x) for x in content], columns=["text", "encoding"])


def decode(files: DataFrame, column: str = "content") -> DataFrame:
    """Replace ``content`` bytes by ``text``, adding ``encoding`` and ``has_bom``.

    One pass over the files: the Arrow UDF gets the bytes that aren't valid UTF-8
    and nulls for the rest. Null bytes (an unreadable file) have no text.
    """
    has_bom = F.coalesce(F.substring(column, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.lit(False))
    marked = files.withColumn("has_bom", has_bom).withColumn("_utf8", F.is_valid_utf8(F.col(column).cast("string")))
    marked = marked.withColumn("_d", decode_legacy(F.when(~F.col("_utf8"), F.col(column))))
    plain = F.when(F.col("has_bom"), F.substring(column, 4, 2**31 - 1)).otherwise(F.col(column)).cast("string")
    return (
        marked.withColumn("text", eol_norm(F.when(F.col("_utf8"), plain).otherwise(F.col("_d.text"))))
        .withColumn("encoding", F.when(~F.col("_utf8"), F.col("_d.encoding")).when(F.col("has_bom"), "utf-8-sig").when(F.col("_utf8"), "utf-8"))
        .drop("_utf8", "_d", column)
    )


def is_valid_format(ext: Column, text: Column) -> Column:
    """SRT needs a numbered time line, ASS/SSA both section headers; anything else passes."""
    stamp = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
    return (
        F.when(ext == "srt", text.rlike(rf"(?m)^\d+\s*\n{stamp}\s*-->\s*{stamp}\s*\n"))
        .when(ext.isin("ass", "ssa"), F.contains(text, F.lit("[Script Info]")) & F.contains(text, F.lit("[Events]")))
        .otherwise(F.lit(True))
    )


def parse_cues(files: DataFrame) -> DataFrame:
    """``media_id, format, cue_idx, start_ms, end_ms, text`` of files with ``ext`` and ``text``.

    One pass: a file's cues are one array by its format. Unknown formats are
    reported by :func:`unsupported`.
    """
    kind = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"
    common = lambda cues, name="text": F.transform(cues, lambda c: F.struct(c["start_ms"], c["end_ms"], c[name])).cast(kind)
    ext, text = F.col("ext"), F.col("text")
    is_ass = ext.isin("ass", "ssa")
    cues = (
        F.when(ext == "srt", common(srt.cue_array(text))).when(ext == "vtt", common(vtt.cue_array(text)))
        .when(is_ass, common(ass.cue_array(text), "raw"))
    )
    out = F.when(is_ass, clean_text(F.col("c.text"))).otherwise(F.col("c.text"))
    return rows_of(files, ["media_id", "ext"], cues, "cue_idx", "c").select(
        "media_id", F.col("ext").alias("format"), "cue_idx", "c.start_ms", "c.end_ms", out.alias("text")
    )


def unsupported(files: DataFrame) -> DataFrame:
    return files.where(~F.col("ext").isin(*EXTENSIONS))


def reencode(files: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """The re-encode job: one row per file with the new text and what happened to it.

    ``status`` is ``failed`` (no text could be read), ``modified`` or ``unchanged``; ``encoding_changed`` tells why,
    ``format_ok`` is the validation result. With ``fonts`` (table of available
    ``fontname``) missing fonts of ASS/SSA styles are replaced on the way.
    """
    decoded = decode(files).withColumnRenamed("text", "_text")
    decoded = decoded.withColumn("format_ok", is_valid_format(F.col("ext"), F.col("_text")))
    if fonts is None:
        fixed = decoded.withColumn("new_text", F.col("_text")).withColumn("fonts_fixed", F.lit(0))
    else:
        fixed = ass.replace_fonts(decoded, "_text", fonts)
    changed = F.col("encoding") != "utf-8"
    modified = changed | ~F.col("format_ok") | (F.col("fonts_fixed") > 0)
    return fixed.select(
        "media_id", "ext", "encoding", "has_bom", "format_ok", "fonts_fixed",
        changed.alias("encoding_changed"),
        F.when(F.col("_text").isNull(), "failed").when(modified, "modified").otherwise("unchanged").alias("status"),
        F.col("new_text").alias("text"),
    )


def job_report(log: DataFrame, *by: str) -> DataFrame:
    """Totals of a job log by status."""
    return log.groupBy(*by, "status").agg(F.count("*").alias("n_files"))
