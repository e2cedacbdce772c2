"""WebVTT: text to cues and cues to text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import strip_ws
from cueweave.functions.timecode import ms_to_time, stamp_to_ms
from cueweave.plans.arrays import let, rows_of
from cueweave.sources.srt import blocks_of

_GAP = r"[^\S\n]*"
_STAMP = r"(\d{1,2}:\d{2}:\d{2}\.\d{3}|\d{2}:\d{2}\.\d{3})"
# Fixed grammar: the time line of a cue.
TIME_LINE = rf"^{_STAMP}{_GAP}-->{_GAP}{_STAMP}[^\n]*$"


def _cue(block: Column) -> Column:
    """The first line with an arrow must be a time line; what follows is the text."""
    def timed(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
        return F.struct(
            F.get(lines, at - 1).alias("time"), F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n").alias("text")
        )

    def cue(c: Column) -> Column:
        return F.when(c["time"].rlike(TIME_LINE), F.struct(
            stamp_to_ms(F.regexp_extract(c["time"], TIME_LINE, 1)).alias("start_ms"),
            stamp_to_ms(F.regexp_extract(c["time"], TIME_LINE, 2)).alias("end_ms"), strip_ws(c["text"]).alias("text"),
        ))

    return let(let(F.split(block, "\n"), timed), cue)


def cue_array(text: Column) -> Column:
    """``array<struct<start_ms, end_ms, text>>``; blocks without a time line are skipped."""
    body = F.regexp_replace(strip_ws(text), r"^WEBVTT[^\n]*(?:\n|$)", "")
    return F.filter(F.transform(blocks_of(body), _cue), lambda c: c.isNotNull())


def parse(files: DataFrame) -> DataFrame:
    """``media_id, cue_idx, start_ms, end_ms, text``."""
    return rows_of(files, ["media_id"], cue_array(F.col("text")), "cue_idx", "c").select(
        "media_id", "cue_idx", "c.start_ms", "c.end_ms", "c.text"
    )


def block(start: Column, end: Column, text: Column) -> Column:
    return F.concat(ms_to_time(start, "vtt"), F.lit(" --> "), ms_to_time(end, "vtt"), F.lit("\n"), text, F.lit("\n"))


def render(cues: DataFrame) -> DataFrame:
    """``media_id, seq, block``: header as seq 0, then every cue unfiltered in file order."""
    header = cues.select("media_id").distinct().select(
        "media_id", F.lit(0).alias("seq"), F.lit("WEBVTT\n").alias("block")
    )
    body = cues.select(
        "media_id", (F.col("cue_idx") + 1).alias("seq"),
        block(F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("block"),
    )
    return header.unionByName(body)
