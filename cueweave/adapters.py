"""Cue tables derived from the given parquet tables.

Every adapter is a narrow transformation of its source rows: one document is one
media, its sentences are the cues, and the cue index is the position inside the
row's own array. Rows are dealt out first only where the table has fewer files
than the session has cores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.timecode import ms_to_time
from cueweave.plans.arrays import rows_of

LATIN = "abcdefghijklmnopqrstuvwxyz"
HANZI = "的一是在不了有和人这中大为上个国我以要他时来用们生到"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media_id, lang, source, ls``: the trimmed, non-empty sentences of each document."""
    text = F.col("text")
    for mark in ".?!":
        text = F.replace(text, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    pieces = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    docs = table(spark, sf_dir, "documents")
    # A table of fewer files than cores (the small given ones are one file with one row group) would keep most cores idle.
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.select(
        F.col("doc_id").alias("media_id"), "lang", "source", pieces.alias("ls")
    )


_START = "1000 + 4000L * cue_idx + 100 * (length(txt) % 10)"
_END = f"{_START} + 800 + 40 * least(length(txt), 80)"


def track_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``media_id, lang, source, cue_idx, start_ms, end_ms, txt``."""
    return (
        rows_of(lines(spark, sf_dir), ["media_id", "lang", "source"], F.col("ls"), "cue_idx", "txt")
        .withColumn("start_ms", F.expr(_START))
        .withColumn("end_ms", F.expr(_END))
    )


def track_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second edition: shifted per media, jittered per cue, without one- and two-word cues.

    ``txt_zh`` is its cross-language text, ``txt_same`` its same-language text.
    """
    kept = F.filter(
        F.transform("ls", lambda x, i: F.struct(i.alias("cue_idx"), x.alias("txt"))),
        lambda s: F.length(s["txt"]) - F.length(F.replace(s["txt"], F.lit(" "), F.lit(""))) >= 2,
    )
    shift = "((media_id * 37) % 21 - 10) * 500 + ((media_id * 13 + cue_idx * 7) % 5 - 2) * 60"
    return (
        rows_of(lines(spark, sf_dir), ["media_id"], kept, "b_idx", "c")
        .select("media_id", "b_idx", "c.cue_idx", "c.txt")
        .withColumn("start_ms", F.expr(f"greatest(0L, {_START} + {shift})"))
        .withColumn("end_ms", F.expr(f"greatest(0L, {_END} + {shift})"))
        .select(
            "media_id", F.col("b_idx").alias("cue_idx"), "start_ms", "end_ms",
            F.translate(F.lower("txt"), LATIN, HANZI).alias("txt_zh"),
            F.when(F.col("cue_idx") % 4 == 1, F.replace("txt", F.lit("e"), F.lit("a")))
            .otherwise(F.col("txt")).alias("txt_same"),
        )
    )


def cues(track: DataFrame, text: str) -> DataFrame:
    """The engine's cue columns: ``media_id, cue_idx, start_ms, end_ms, text``."""
    return track.select("media_id", "cue_idx", "start_ms", "end_ms", F.col(text).alias("text"))


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``track_a`` with markup: override tags, HTML tags, drawings, bilingual cues and styles."""
    zh = F.translate(F.lower("txt"), LATIN, HANZI)
    kind = F.col("cue_idx") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("{\\an8}"), F.col("txt"), F.lit("\\N"), zh))
        .when(kind == 1, F.concat(F.lit("<i>"), F.col("txt"), F.lit("</i>")))
        .when((kind == 2) & (F.length("txt") < 20), F.lit("{\\p1}m 0 0 l 10 10{\\p0}"))
        .when(kind == 3, F.concat(F.col("txt"), F.lit("\n  "), zh, F.lit("\n12")))
        .when((kind == 4) & (F.length("txt") < 12), F.lit("{\\fad(100,200)}"))
        .otherwise(F.col("txt"))
    )
    style = (
        F.when(F.length("txt") % 7 == 0, "OP-Karaoke")
        .when(F.length("txt") % 7 == 1, "Signs").otherwise("Default")
    )
    return track_a(spark, sf_dir).select(
        "media_id", "cue_idx", "start_ms", "end_ms", text.alias("text"), style.alias("style")
    )


def conv_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as cues; the role is the track."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), F.col("role").alias("track"),
        F.col("turn").cast("int").alias("cue_idx"),
        (F.col("turn") * 3000).cast("bigint").alias("start_ms"),
        (F.col("turn") * 3000 + 2500).cast("bigint").alias("end_ms"), "text",
    )


TITLES = ("English", "Signs & Songs", "English dialogue", "", "Forced English", "Main", "SDH", "Chinese Simplified")
TAGS = ("eng", "chi", "", "en", "jpn", "zho", "fre", "English")
CODECS = ("subrip", "ass", "hdmv_pgs_subtitle", "webvtt", "mov_text")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three embedded tracks and one external track per document."""
    def pick(values: tuple[str, ...], seed: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast(({seed}) % {len(values)} as int) + 1"))

    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").alias("media_id"), "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rel_index"))
        .select(
            "media_id", "rel_index", (F.col("rel_index") + 2).cast("string").alias("track_id"),
            pick(CODECS, "media_id + rel_index * 3").alias("codec"),
            pick(TAGS, "media_id * 3 + rel_index * 5").alias("language"),
            pick(TITLES, "media_id + rel_index * 7").alias("title"),
            F.expr("(media_id + rel_index) % 3 = 0").alias("is_default"),
            F.expr("(media_id + rel_index) % 5 = 0").alias("is_forced"),
            F.when(F.col("rel_index") < 3, "embedded").otherwise("external").alias("source_type"),
            F.expr("cast((n_chars + rel_index * 70) % 400 as int)").alias("event_count"),
        )
    )


def media_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source type and language of both tracks of each media, as the merge jobs need them."""
    kind = F.col("doc_id") % 4
    docs = table(spark, sf_dir, "documents")
    # A table of fewer files than cores (the small given ones are one file with one row group) would keep most cores idle.
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.select(
        F.col("doc_id").alias("media_id"),
        F.when(kind < 2, "embedded").otherwise("external").alias("source1"),
        F.when((kind == 0) | (kind == 2), "embedded").otherwise("external").alias("source2"),
        F.when(F.col("doc_id") % 3 == 0, "english").otherwise("chinese").alias("language1"),
        F.when(F.col("doc_id") % 3 == 0, "chinese").otherwise("english").alias("language2"),
    )


EXTS = ("srt", "vtt", "ass", "ssa")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name per document: language tag from the table, extension by id."""
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), F.expr("cast(doc_id % 4 as int) + 1"))
    docs = table(spark, sf_dir, "documents")
    # A table of fewer files than cores (the small given ones are one file with one row group) would keep most cores idle.
    if len(docs.inputFiles()) < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.select(
        F.col("doc_id").alias("media_id"), "lang", "source", "text", ext.alias("ext"),
        F.concat(F.lit("Movie."), "source", F.lit("."), F.col("doc_id").cast("string")).alias("video_stem"),
        F.concat(F.lit("Movie."), "source", F.lit("."), F.col("doc_id").cast("string"), F.lit("."),
                 F.when(F.col("doc_id") % 5 == 0, F.concat("lang", F.lit("-en")))
                 .when(F.col("doc_id") % 5 == 1, F.upper("lang")).otherwise(F.col("lang"))).alias("stem"),
    )


def _timed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their cues as an array, from which file texts are printed inside the row."""
    timed = F.expr(
        f"transform(ls, (txt, cue_idx) -> named_struct('txt', txt, 'cue_idx', cue_idx, "
        f"'start_ms', {_START}, 'end_ms', {_END}))"
    )
    return lines(spark, sf_dir).withColumn("_timed", timed)


def _printed(block, head: str | Column, tail: str, sep: str) -> Column:
    return F.concat(F.lit(head) if isinstance(head, str) else head, F.array_join(F.transform("_timed", block), sep), F.lit(tail))


def _rendered(spark: SparkSession, sf_dir: str, fmt: Column, text: Column) -> DataFrame:
    return _timed_lines(spark, sf_dir).select("media_id", "lang", "source", fmt.alias("ext"), text.alias("text"))


def any_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of one of the four formats, by id; one pass."""
    kind = F.col("media_id") % 4
    ext = F.element_at(F.array(*[F.lit(e) for e in ("srt", "vtt", "ass", "ssa")]), kind.cast("int") + 1)
    text = F.when(kind == 0, _srt_text()).when(kind == 1, _vtt_text()).otherwise(_ass_text())
    return _rendered(spark, sf_dir, ext, text)


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SRT text per document, with an unnumbered block style, a one-line block and a bad time."""
    return _rendered(spark, sf_dir, F.lit("srt"), _srt_text())


def _srt_text() -> Column:
    def block(c):
        number = F.when(c["cue_idx"] % 3 == 2, F.lit("")).otherwise(F.concat((c["cue_idx"] + 1).cast("string"), F.lit("\n")))
        return F.concat(number, ms_to_time(c["start_ms"]), F.lit(" --> "), ms_to_time(c["end_ms"]), F.lit("\n"), c["txt"])

    return _printed(block, "just one line\n\n", "\n\n77\n00:99 --> nothing\nbad time\n\n", "\n \n")


def vtt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, F.lit("vtt"), _vtt_text())


def _vtt_text() -> Column:
    def block(c):
        stamp = F.concat(ms_to_time(c["start_ms"], "vtt"), F.lit(" --> "), ms_to_time(c["end_ms"], "vtt"), F.lit(" align:start"))
        name = F.when(c["cue_idx"] % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("id"), c["cue_idx"].cast("string"), F.lit("\n")))
        return F.concat(name, stamp, F.lit("\n"), c["txt"])

    return _printed(block, "WEBVTT - demo\n\nNOTE made from documents\n\n", "\n\nSTYLE\n::cue{}\n", "\n\n")


def ass_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASS texts with a shortened, reordered Format line, comments and a broken dialogue line."""
    return _rendered(spark, sf_dir, F.lit("ass"), _ass_text())


ASS_FONTS = ("AFRICA", "Arial", "AMERICA", "ASIA", "EUROPE")


def _ass_text() -> Column:
    def block(c):
        zh = F.translate(F.lower(c["txt"]), LATIN, HANZI)
        body = F.when(c["cue_idx"] % 4 == 1, F.concat(F.lit("{\\i1}"), c["txt"], F.lit("{\\i0}\\N"), zh)).otherwise(c["txt"])
        style = F.when(c["cue_idx"] % 5 == 4, "Sign").otherwise("Default")
        return F.concat(
            F.lit("Dialogue: 0, "), style, F.lit(","), ms_to_time(c["start_ms"], "ass"), F.lit(","),
            ms_to_time(c["end_ms"], "ass"), F.lit(",,0,0,0,,"), body,
        )

    # Height and font go by the document: three heights, fonts that the region table names and one that it doesn't.
    height = (720 + 360 * (F.col("media_id") % 3)).cast("string")
    font = F.element_at(F.array(*[F.lit(f) for f in ASS_FONTS]), (F.col("media_id") % len(ASS_FONTS)).cast("int") + 1)
    head = F.concat(
        F.lit("[Script Info]\nTitle: demo\nPlayResY: "), height,
        F.lit("\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, Encoding\nStyle: Default,"), font,
        F.lit(",48,1\nStyle: Sign,Gone Sans,40,134\n\n[Fonts]\nDialogue: 0,not,an,event\n\n[Events]\n"
              "Format: Layer, Style, Start, End, Name, MarginL, MarginR, MarginV, Effect, Text\n"),
    )
    return _printed(block, head, "\nComment: 0,x\nDialogue: 0,Default,bad,0:00:01.00,,0,0,0,,bad time\n", "\n")
