"""Time codes as integer milliseconds. All functions are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings per format, and the length of one fraction unit in ms.
_PATTERNS = {
    "srt": (r"^\s*(\d+):(\d+):(\d+)(?:[.,](\d+))?\s*$", 1),
    "ass": (r"^\s*(\d+):(\d+):(\d+)(?:\.(\d+))?\s*$", 10),
    "vtt": (r"^\s*(?:(\d+):)?(\d+):(\d+)(?:\.(\d+))?\s*$", 1),
}


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found == "", F.lit(0)).otherwise(found.try_cast("bigint"))


def time_to_ms(text: Column, fmt: str = "srt") -> Column:
    """Milliseconds of a time code, NULL where the text is not one."""
    pattern, unit = _PATTERNS[fmt]
    h, m, s, frac = (_part(text, pattern, g) for g in (1, 2, 3, 4))
    return F.when(
        text.rlike(pattern), h * 3_600_000 + m * 60_000 + s * 1_000 + frac * unit
    ).cast("bigint")


def stamp_to_ms(stamp: Column) -> Column:
    """Milliseconds of a checked ``[H]H:MM:SS?mmm`` stamp (or ``MM:SS?mmm``), cut by position."""
    def piece(start: int, length: int) -> Column:
        return F.substring(stamp, start, length).try_cast("bigint")

    hours = F.regexp_extract(stamp, r"^(\d{1,2}):\d{2}:", 1)
    h = F.when(hours == "", F.lit(0)).otherwise(hours.try_cast("bigint"))
    return h * 3_600_000 + piece(-9, 2) * 60_000 + piece(-6, 2) * 1_000 + piece(-3, 3)


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n))


def ms_to_time(ms: Column, fmt: str = "srt") -> Column:
    """Render milliseconds; negatives become 0, ASS keeps centiseconds only."""
    t = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    h, m, s, r = _div(t, 3_600_000), _div(t, 60_000) % 60, _div(t, 1_000) % 60, t % 1_000
    if fmt == "ass":
        return F.format_string("%d:%02d:%02d.%02d", h, m, s, _div(r, 10))
    mark = "," if fmt == "srt" else "."
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", h, m, s, r)


def readable(ms: Column) -> Column:
    return ms_to_time(ms, "vtt")


def time_range(start: Column, end: Column, fmt: str = "vtt") -> Column:
    return F.concat(ms_to_time(start, fmt), F.lit(" --> "), ms_to_time(end, fmt))


def format_duration(ms: Column) -> Column:
    """``45.5s``, ``3m 5.0s`` or ``1h 3m 45.5s``; tenths round half up on the integer ms."""
    tenth = _div(ms % 60_000 + 50, 100)
    sec = F.format_string("%d.%ds", _div(tenth, 10), tenth % 10)
    return (
        F.when(ms < 60_000, sec)
        .when(ms < 3_600_000, F.concat(_div(ms, 60_000).cast("string"), F.lit("m "), sec))
        .otherwise(
            F.concat(
                _div(ms, 3_600_000).cast("string"), F.lit("h "),
                (_div(ms, 60_000) % 60).cast("string"), F.lit("m "), sec,
            )
        )
    )


def shift_time(text: Column, shift_ms: Column, fmt: str = "srt") -> Column:
    return ms_to_time(time_to_ms(text, fmt) + shift_ms, fmt)


def parse_offset(text: Column) -> Column:
    """Offset literal to ms: ``00:00:02,500``, ``-1500ms``, ``2.5s``, ``1500`` (ms), ``2.5`` (s)."""
    t = F.trim(text)
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    bare = F.regexp_replace(t, r"^[+-]", "")
    seconds = F.regexp_extract(t, r"^([+-]?(?:\d+\.?\d*|\.\d+))\s*[sS]?$", 1)
    as_seconds = (seconds.try_cast("decimal(20,6)") * 1_000).cast("bigint")
    return (
        F.when(F.instr(t, ":") > 0, sign * time_to_ms(bare, "srt"))
        .when(t.rlike(r"(?i)^[+-]?\d+\s*ms$"), F.regexp_extract(t, r"^([+-]?\d+)", 1).try_cast("bigint"))
        .when(t.rlike(r"(?i)s$"), as_seconds)
        .when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
        .otherwise(as_seconds)
    )


def ass_time_to_srt(text: Column) -> Column:
    """``H:MM:SS.c…`` to ``HH:MM:SS,mmm``: the fraction is padded or cut to two digits."""
    pattern = r"^\s*(\d+):(\d+):(\d+)(?:\.(\d*))?"
    frac = F.regexp_extract(text, pattern, 4)
    cs = F.substring(F.rpad(frac, 2, "0"), 1, 2).try_cast("bigint")
    h, m, s = (F.regexp_extract(text, pattern, g).try_cast("bigint") for g in (1, 2, 3))
    ms = F.when(frac == "", F.lit(0)).otherwise(cs * 10)
    return F.when(
        F.size(F.split(text, ":")) == 3, F.format_string("%02d:%02d:%02d,%03d", h, m, s, ms)
    ).otherwise(F.lit("00:00:00,000"))
