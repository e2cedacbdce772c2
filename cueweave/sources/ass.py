"""ASS/SSA: text to cues, dialogue rows, styles and header, and back.

Section and ``Format:`` state is looked up per line among the few header lines
of the same row, so a file is parsed in place without a window or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import (
    WS_CHARS, cjk_first, clean_ass, clean_text, has_cjk_font, has_cjk_style, strip_ws,
)
from cueweave.functions.timecode import ass_time_to_srt, ms_to_time, time_to_ms
from cueweave.plans.arrays import let, rows_of
from cueweave.plans.ordered import number_rows

# Column order without a Format line, and the default header.
DEFAULT_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")
EVENT_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"
STYLE_FORMAT = (
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, "
    "Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, "
    "Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
DEFAULT_INFO = (
    "[Script Info]\nTitle: Generated\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n"
    "WrapStyle: 0\nScaledBorderAndShadow: yes\n"
)
CJK_FONT, CJK_SIZE = "Microsoft YaHei", 56
LATIN_FONT, LATIN_SIZE = "Arial", 48


def _section(head: Column) -> Column:
    return (
        F.when(head.rlike(r"(?i)^\[Script Info\]"), "script_info")
        .when(head.rlike(r"(?i)^\[V4\+? Styles\]"), "styles")
        .when(head.rlike(r"(?i)^\[Events\]"), "events")
        .otherwise("unknown")
    )


def _numbered(text: Column) -> Column:
    """``array<struct<pos, line, key>>``; the key is what a line has before its first colon, in lower case."""
    def row(x: Column, i: Column) -> Column:
        key = F.when(F.contains(x, F.lit(":")), F.lower(F.ltrim(F.substring_index(x, ":", 1), F.lit(WS_CHARS))))
        return F.struct(i.alias("pos"), F.rtrim(x, F.lit("\r\n")).alias("line"), key.alias("key"))

    return F.transform(F.split(text, "\n"), row)


_HEAD = r"^\[.*\]"


def _heads(rows: Column) -> Column:
    return F.transform(
        F.filter(rows, lambda s: s["line"].rlike(_HEAD)), lambda s: F.struct(s["pos"].alias("pos"), _section(s["line"]).alias("section"))
    )


def _in_section(heads: Column, pos: Column, section: str) -> Column:
    last = F.element_at(F.filter(heads, lambda h: h["pos"] <= pos), -1)
    return F.coalesce(last["section"] == section, F.lit(False))


def _is(line: Column, word: str) -> Column:
    return F.lower(strip_ws(line)).startswith(word)


def _after_colon(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(":")), F.substring(line, F.instr(line, ":") + 1, F.length(line))).otherwise(line)


def _fields(line: Column) -> Column:
    return F.transform(F.split(_after_colon(line), ","), lambda x: F.lower(strip_ws(x)))


def _format(fields: Column, pos: Column) -> Column:
    """A Format line read once: its fields and where the cue columns stand among them."""
    known = F.array_contains(fields, "start") & F.array_contains(fields, "end") & F.array_contains(fields, "text")

    def at(name: str, fallback: int) -> Column:
        found = (F.array_position(fields, F.lit(name)) - 1).cast("int")
        return F.when(known & (found >= 0), found).otherwise(F.lit(fallback)).alias(name)

    # Where each of the ten columns stands, -1 for those the line doesn't name.
    places = F.transform(F.array(*[F.lit(f) for f in DEFAULT_FIELDS]), lambda name: (F.array_position(fields, name) - 1).cast("int"))
    return F.struct(
        pos.cast("int").alias("pos"), fields.alias("fields"), F.size(fields).alias("n"), at("start", 1), at("end", 2), at("style", 3), at("text", 9),
        places.alias("places"),
    )


def _formats(rows: Column, heads: Column, section: str) -> Column:
    """The section's Format lines behind the default one (position -1)."""
    lines = F.filter(rows, lambda s: (s["key"] == "format") & _in_section(heads, s["pos"], section))
    default = _format(F.array(*[F.lit(f) for f in DEFAULT_FIELDS]), F.lit(-1))
    return F.concat(F.array(default), F.transform(lines, lambda s: let(_fields(s["line"]), lambda f: _format(f, s["pos"]))))


def _listed(text: Column, section: str, word: str, row) -> Column:
    """``row(line, format)`` of every line of ``section`` with ``word`` before its colon, in file order.

    Lines, section heads and formats are each found once per file.
    """
    def one(s: Column, formats: Column) -> Column:
        return let(F.element_at(F.filter(formats, lambda f: f["pos"] < s["pos"]), -1), lambda f: row(s["line"], f))

    def listed(rows: Column, heads: Column, formats: Column) -> Column:
        chosen = F.filter(rows, lambda s: (s["key"] == word) & _in_section(heads, s["pos"], section))
        return F.transform(chosen, lambda s: one(s, formats))

    return let(_numbered(text), lambda rows: let(_heads(rows), lambda heads: let(
        _formats(rows, heads, section), lambda formats: listed(rows, heads, formats))))


def _dialogue(text: Column) -> Column:
    """``array<struct<format, parts>>`` of the dialogue lines."""
    return _listed(text, "events", "dialogue", lambda line, f: F.struct(
        f.alias("format"), F.split(_after_colon(line), ",", f["n"]).alias("parts")))


def _at(parts: Column, pos: Column, default: str) -> Column:
    return F.coalesce(F.get(parts, pos.cast("int")), F.lit(default))


def _clock(text: Column) -> Column:
    """Milliseconds of ``H:MM:SS.cc``: one check, then cut at the marks."""
    def sized(p: Column) -> Column:
        return let(F.split(F.get(p, F.lit(2)), r"\."), lambda s: (
            F.get(p, F.lit(0)).try_cast("bigint") * 3_600_000 + F.get(p, F.lit(1)).try_cast("bigint") * 60_000
            + F.get(s, F.lit(0)).try_cast("bigint") * 1_000 + F.coalesce(F.get(s, F.lit(1)).try_cast("bigint"), F.lit(0)) * 10
        ))

    return F.when(text.rlike(r"^\d+:\d+:\d+(\.\d+)?$"), let(F.split(text, ":"), sized))


def _cue(d: Column) -> Column:
    f, parts = d["format"], d["parts"]
    return F.struct(
        F.size(parts).alias("n"),
        _clock(strip_ws(_at(parts, f["start"], "0:00:00.00"))).alias("start_ms"),
        _clock(strip_ws(_at(parts, f["end"], "0:00:00.00"))).alias("end_ms"),
        _at(parts, f["style"], "Default").alias("style"), _at(parts, f["text"], "").alias("raw"),
    )


def cue_array(text: Column) -> Column:
    """``array<struct<n, start_ms, end_ms, style, raw>>`` of the dialogue lines with two fields and good times at least.

    Style and text are as they stand: cleaning them is cheaper in rows than in arrays.
    """
    return F.filter(
        F.transform(_dialogue(text), lambda d: _cue(d)),
        lambda c: (c["n"] >= 2) & c["start_ms"].isNotNull() & c["end_ms"].isNotNull(),
    )


def parse(files: DataFrame) -> DataFrame:
    """``media_id, cue_idx, start_ms, end_ms, text, style, raw``; short lines are tolerated."""
    return rows_of(files, ["media_id"], cue_array(F.col("text")), "cue_idx", "c").select(
        "media_id", "cue_idx", "c.start_ms", "c.end_ms", clean_text(F.col("c.raw")).alias("text"), strip_ws(F.col("c.style")).alias("style"), "c.raw"
    )


def parse_full(files: DataFrame) -> DataFrame:
    """All ten dialogue columns; lines with too few fields or bad integers are dropped.

    Only the integers, which decide about a line, are read in the array.
    """
    def field(values: Column, name: str, default: str) -> Column:
        # A whole line has all fields that its format names, so null stands for those it doesn't name.
        return strip_ws(F.coalesce(F.get(values, F.lit(DEFAULT_FIELDS.index(name))), F.lit(default)))

    def number(values: Column, name: str) -> Column:
        return let(field(values, name, "0"), lambda t: F.when(t == "", F.lit(0)).otherwise(t.try_cast("int")))

    def values(line: Column, f: Column) -> Column:
        return let(F.split(_after_colon(line), ",", f["n"]), lambda parts: F.when(
            F.size(parts) >= f["n"], F.transform(f["places"], lambda p: F.get(parts, p))))

    def row(v: Column) -> Column:
        return F.struct(
            v.alias("v"), field(v, "layer", "0").try_cast("int").alias("layer"), number(v, "marginl").alias("margin_l"),
            number(v, "marginr").alias("margin_r"), number(v, "marginv").alias("margin_v"),
        )

    whole = F.filter(_listed(F.col("text"), "events", "dialogue", values), lambda v: v.isNotNull())
    good = F.filter(
        F.transform(whole, row),
        lambda r: r["layer"].isNotNull() & r["margin_l"].isNotNull() & r["margin_r"].isNotNull() & r["margin_v"].isNotNull(),
    )

    def text(name: str, default: str) -> Column:
        return field(F.col("r.v"), name, default)

    return rows_of(files, ["media_id"], good, "cue_idx", "r").select(
        "media_id", "cue_idx", "r.layer", text("start", "0:00:00.00").alias("start"), text("end", "0:00:00.00").alias("end"),
        text("style", "Default").alias("style"), text("name", "").alias("name"), "r.margin_l", "r.margin_r", "r.margin_v",
        text("effect", "").alias("effect"), clean_ass(text("text", "")).alias("text"), text("text", "").alias("raw"),
    )


def styles(files: DataFrame, text: str = "text") -> DataFrame:
    """``media_id, style_idx, name, fontname, encoding, values``: the style rows of each file."""
    listed = _listed(F.col(text), "styles", "style", lambda line, f: F.struct(
        F.when(f["pos"] >= 0, f["fields"]).alias("fields"), F.transform(F.split(_after_colon(line), ","), strip_ws).alias("values")))

    def value(name: str) -> Column:
        pos = F.array_position("s.fields", F.lit(name)) - 1
        return F.when(pos >= 0, F.get("s.values", pos.cast("int")))

    return rows_of(files, ["media_id"], listed, "style_idx", "s").select(
        "media_id", "style_idx", F.get("s.values", F.lit(0)).alias("name"),
        value("fontname").alias("fontname"), value("encoding").alias("encoding"), F.col("s.values").alias("values"),
    )


def script_info(files: DataFrame) -> DataFrame:
    """``media_id, key, value`` rows of the script header (keys lower case)."""
    def info(rows: Column) -> Column:
        return let(_heads(rows), lambda heads: F.filter(rows, lambda s: F.contains(s["line"], F.lit(":")) & ~s["line"].rlike(_HEAD)
                                                        & _in_section(heads, s["pos"], "script_info")))

    return rows_of(files, ["media_id"], let(_numbered(F.col("text")), info), "_pos", "s").select(
        "media_id",
        F.lower(F.trim(F.regexp_extract("s.line", r"^([^:]*):", 1))).alias("key"),
        strip_ws(_after_colon(F.col("s.line"))).alias("value"),
    )


def header_parts(files: DataFrame) -> DataFrame:
    """``media_id, info, styles``: the lines of the script header and of the style section as they stand."""
    def of(section: str):
        def lines(rows: Column) -> Column:
            return let(_heads(rows), lambda heads: F.transform(
                F.filter(rows, lambda s: (s["line"] != "") & ~s["line"].rlike(_HEAD) & _in_section(heads, s["pos"], section)), lambda s: s["line"]))
        return lines

    return files.select("media_id", let(_numbered(F.col("text")), of("script_info")).alias("info"), let(_numbered(F.col("text")), of("styles")).alias("styles"))


def fix_fonts(style_rows: DataFrame, cjk_media: DataFrame, fonts: DataFrame) -> DataFrame:
    """Replacement per style: missing fonts by a CJK or Latin default, encoding 134 by 1.

    ``cjk_media`` is ``media_id, has_cjk``; ``fonts`` the available ``fontname``
    values. The font join key is a small dictionary joined to a large table, so
    the planner decides by its real size whether to broadcast it.
    """
    have = fonts.select(F.col("fontname"), F.lit(True).alias("_have")).dropDuplicates(["fontname"])
    joined = style_rows.join(cjk_media, "media_id", "left").join(have, "fontname", "left")
    missing = (F.coalesce(F.col("fontname"), F.lit("")) != "") & F.col("_have").isNull()
    new_font = F.when(missing, F.when(F.col("has_cjk"), CJK_FONT).otherwise(LATIN_FONT)).otherwise(F.col("fontname"))
    return joined.select(
        "media_id", "style_idx", "name", F.col("fontname").alias("old_font"), new_font.alias("new_font"),
        F.when(F.col("encoding") == "134", "1").otherwise(F.col("encoding")).alias("encoding"),
        missing.alias("replaced"),
    )


def replace_fonts(files: DataFrame, text: str, fonts: DataFrame) -> DataFrame:
    """Rewrite the style lines of ASS/SSA files in place; adds ``new_text, fonts_fixed``."""
    is_ass = files.ext.isin("ass", "ssa")
    ass_files = files.where(is_ass)
    rows = styles(ass_files, text)
    cjk = ass_files.select("media_id", has_cjk_style(F.col(text)).alias("has_cjk"))
    fixes = fix_fonts(rows, cjk, fonts).where("replaced").select("media_id", "old_font", "new_font")
    # Style sheets are short: the map per file holds one entry per missing font.
    per_file = fixes.distinct().groupBy("media_id").agg(
        F.map_from_entries(F.collect_list(F.struct("old_font", "new_font"))).alias("_map"),
    ).join(fixes.groupBy("media_id").agg(F.count("*").cast("int").alias("_n")), "media_id")
    joined = files.join(per_file, "media_id", "left")

    def rewrite(line: Column) -> Column:
        parts = F.transform(F.split(_after_colon(line), ","), strip_ws)
        # Font and encoding positions follow the common style layout (Name, Fontname, …, Encoding).
        new = F.transform(parts, lambda v, i: F.when((i == 1) & F.map_contains_key("_map", v), F.element_at("_map", v))
                          .when((i == F.size(parts) - 1) & (v == "134"), "1").otherwise(v))
        return F.when(_is(line, "style:"), F.concat(F.lit("Style: "), F.array_join(new, ", "))).otherwise(line)

    fixed = F.array_join(F.transform(F.split(text, "\n"), rewrite), "\n")
    return joined.withColumn(
        "new_text", F.when(F.col("_map").isNotNull(), fixed).otherwise(F.col(text))
    ).withColumn("fonts_fixed", F.coalesce(F.col("_n"), F.lit(0))).drop("_map", "_n")


def any_cjk(cues: DataFrame, first: int | None = None) -> DataFrame:
    """``media_id, has_cjk`` over all cues, or the ``first`` ones; a partial aggregate, no window."""
    found = has_cjk_font(F.col("text"))
    looked = found if first is None else F.when(F.col("cue_idx") < first, found)
    return cues.groupBy("media_id").agg(F.coalesce(F.bool_or(looked), F.lit(False)).alias("has_cjk"))


def dialogue_line(start: Column, end: Column, style: Column, body: Column) -> Column:
    return F.concat(
        F.lit("Dialogue: 0,"), ms_to_time(start, "ass"), F.lit(","), ms_to_time(end, "ass"), F.lit(","),
        F.coalesce(style, F.lit("Default")), F.lit(",,0,0,0,,"), body,
    )


def render(cues: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """``media_id, seq, block``: header rows (seq < 0), then one dialogue line per cue.

    ``cues`` may carry ``style`` and ``raw``; ``raw`` wins over ``text``.
    ``header`` (``media_id, block``) replaces the default header where given.
    """
    for name in ("style", "raw"):
        if name not in cues.columns:
            cues = cues.withColumn(name, F.lit(None).cast("string"))
    has_cjk = F.col("has_cjk")
    # The colours, scales and margins behind font and size.
    style = F.concat(
        F.lit(f"[V4+ Styles]\n{STYLE_FORMAT}\nStyle: Default,"),
        F.when(has_cjk, f"{CJK_FONT},{CJK_SIZE}").otherwise(f"{LATIN_FONT},{LATIN_SIZE}"),
        F.lit(",&H00FFFFFF,&H000000FF,&H00000000,&H00000000,-1,0,0,0,100,100,0,0,1,2.5,1,2,10,10,20,1\n"),
    )
    default = F.concat(F.lit(DEFAULT_INFO + "\n"), style, F.lit(f"\n[Events]\n{EVENT_FORMAT}"))
    head = any_cjk(cues).select("media_id", F.lit(0).alias("seq"), default.alias("block"))
    if header is not None:
        given = header.select("media_id", F.col("block").alias("_given"))
        head = head.join(given, "media_id", "left").select(
            "media_id", "seq", F.coalesce("_given", "block").alias("block")
        )
    raw = F.when(F.col("raw") != "", F.col("raw"))
    body = F.coalesce(raw, F.replace("text", F.lit("\n"), F.lit("\\N")))
    lines = cues.select(
        "media_id", (F.col("cue_idx") + 1).alias("seq"),
        dialogue_line(F.col("start_ms"), F.col("end_ms"), F.nullif(F.col("style"), F.lit("")), body).alias("block"),
    )
    return head.unionByName(lines)


def to_srt(files: DataFrame, preserve_bilingual: bool = True) -> DataFrame:
    """``media_id, seq, block`` of ASS files converted to SRT: cleaned, CJK lines first, by start time.

    Unlike the SRT sink nothing is dropped but empty cues.
    """
    # The text is cleaned once: a filter would be moved below the cleaning and do it again.
    filled = F.filter(F.array("text"), lambda t: strip_ws(t) != "")
    rows = rows_of(parse_full(files), ["media_id", "cue_idx", "start", "end"], filled, "_one", "text")
    text = cjk_first(F.col("text")) if preserve_bilingual else F.col("text")
    timed = rows.select(
        "media_id", "cue_idx", ass_time_to_srt(F.col("start")).alias("start"),
        ass_time_to_srt(F.col("end")).alias("end"), text.alias("text"),
    ).withColumn("start_ms", time_to_ms(F.col("start")))
    placed = number_rows(timed, ["media_id"], "start_ms", ["cue_idx"], "_pos")
    return placed.select(
        "media_id", (F.col("_pos") + 1).alias("seq"),
        F.concat((F.col("_pos") + 1).cast("string"), F.lit("\n"), "start", F.lit(" --> "), "end", F.lit("\n"), "text", F.lit("\n")).alias("block"),
    )
