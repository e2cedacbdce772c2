"""SRT: text to cues and cues to text blocks.

A file is one row, so block splitting, rejection and cue numbering all happen
inside the row: parsing a corpus needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import clean_srt, strip_ws
from cueweave.functions.timecode import ms_to_time, stamp_to_ms
from cueweave.plans.arrays import rows_of
from cueweave.plans.ordered import number_rows

_GAP = r"[^\S\n]*"
_STAMP = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{3})"
# A stripped block: optional number line, time line, at least one more line.
BLOCK = rf"(?s)^(?:\d+{_GAP}\n)?{_GAP}{_STAMP}{_GAP}-->{_GAP}{_STAMP}[^\n]*\n(.*)$"


def blocks_of(text: Column) -> Column:
    return F.transform(F.split(strip_ws(text), r"\r?\n\s*\r?\n"), lambda x: strip_ws(x))


def _cue(block: Column) -> Column:
    return F.struct(
        stamp_to_ms(F.regexp_extract(block, BLOCK, 1)).alias("start_ms"),
        stamp_to_ms(F.regexp_extract(block, BLOCK, 2)).alias("end_ms"),
        strip_ws(F.regexp_extract(block, BLOCK, 3)).alias("text"),
    )


def cue_array(text: Column) -> Column:
    """``array<struct<start_ms, end_ms, text>>`` of a file's good blocks."""
    return F.transform(F.filter(blocks_of(text), lambda x: x.rlike(BLOCK)), _cue)


def parse(files: DataFrame) -> DataFrame:
    """``media_id, cue_idx, start_ms, end_ms, text`` of rows with ``media_id, text``."""
    good = F.filter(blocks_of(F.col("text")), lambda x: x.rlike(BLOCK))
    return rows_of(files, ["media_id"], good, "cue_idx", "b").withColumn("c", _cue(F.col("b"))).select(
        "media_id", "cue_idx", "c.start_ms", "c.end_ms", "c.text"
    )


def rejects(files: DataFrame) -> DataFrame:
    """The blocks :func:`parse` skips, for a quarantine table."""
    bad = F.filter(blocks_of(F.col("text")), lambda x: ~x.rlike(BLOCK))
    return rows_of(files, ["media_id"], bad, "_pos", "block").drop("_pos")


def first_starts(files: DataFrame, k: int = 15) -> DataFrame:
    """``media_id, ext_i, ext_ms``: the first ``k`` start times found anywhere in the text."""
    pattern = r"(\d{1,2}:\d{2}:\d{2}[,.]\d{3})\s*-->"
    found = F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), 1, k)
    return rows_of(files, ["media_id"], found, "ext_i", "t").select(
        "media_id", "ext_i", stamp_to_ms(F.col("t")).alias("ext_ms")
    )


def keep_printable(cues: DataFrame) -> DataFrame:
    """Cues the sink prints: cleaned, not empty, no drawing, at least 100 ms."""
    return cues.withColumn("text", clean_srt(F.col("text"))).where(
        (F.col("text") != "") & (F.col("end_ms") - F.col("start_ms") >= 100)
    )


def dedup(cues: DataFrame) -> DataFrame:
    """First cue of each (start, end at 10 ms, text).

    A grouped minimum, so copies collapse map-side before the shuffle.
    """
    tick = [F.call_function("div", F.col(c) + 5, F.lit(10)).alias(f"_{c}") for c in ("start_ms", "end_ms")]
    return (
        cues.groupBy("media_id", *tick, "text")
        .agg(F.min(F.struct("cue_idx", "start_ms", "end_ms")).alias("c"))
        .select("media_id", "c.cue_idx", "c.start_ms", "c.end_ms", "text")
    )


def block(seq: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(
        seq.cast("string"), F.lit("\n"), ms_to_time(start), F.lit(" --> "), ms_to_time(end), F.lit("\n"), text, F.lit("\n")
    )


def render(cues: DataFrame) -> DataFrame:
    """``media_id, seq, block``: one printed block per row, numbered from 1.

    A file stays a set of rows; :func:`cueweave.sources.sink.write_blocks`
    orders them when it writes.
    """
    kept = number_rows(dedup(keep_printable(cues)), ["media_id"], "cue_idx", [], "_pos", width=8192)
    seq = F.col("_pos") + 1
    return kept.select("media_id", seq.alias("seq"), block(seq, F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("block"))
