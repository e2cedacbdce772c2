"""Text clean-up, script tests and cue text composition, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.plans.arrays import let

# White space as a class that reads the same in Java and RE2 syntax.
WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Script ranges of the four CJK tests. They differ on purpose.
CJK_FONT = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
CJK_CHINESE = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
)
CJK_STYLE = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{309F}"
    r"\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"
)
CJK_LINE = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{3040}-\x{309F}"
    r"\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"
)
# Characters that count for the line class, complemented.
NOT_CJK_COUNTED = (
    r"[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2CEAF}\x{F900}-\x{FAFF}"
    r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
)
NOT_LATIN_COUNTED = (
    r"[^A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
)
# Style-name fragments of non-dialogue tracks.
NON_DIALOGUE_STYLES = (
    "op", "ed", "opening", "ending", "sign", "title", "name", "staff", "credit", "note",
    "comment", "insert", "karaoke", "internet", "screen", "jap", "jpn", "romaji", "song", "ep ",
)

DRAWING = r"\{[^}]*\\p[1-9][^}]*\}"
ASS_TAG = r"\{[^}]*\}"
ASS_TAG_FILLED = r"\{[^}]+\}"
HTML_TAG = r"<[^>]+>"

# The characters of ``WS``, one by one.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(text: Column) -> Column:
    """White space off both ends, in time linear in what goes."""
    return F.btrim(text, F.lit(WS_CHARS))


def ass_breaks(text: Column) -> Column:
    """``\\N`` and ``\\n`` escapes to line feeds."""
    return F.regexp_replace(text, r"\\[Nn]", "\n")


def clean_text(text: Column, remove_formatting: bool = False) -> Column:
    out = ass_breaks(text)
    if remove_formatting:
        out = F.regexp_replace(F.regexp_replace(out, ASS_TAG_FILLED, ""), HTML_TAG, "")
        out = strip_ws(out)
    return out


def _tidy_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip_ws)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_drawing(text: Column) -> Column:
    return text.rlike(DRAWING)


def clean_srt(text: Column) -> Column:
    """Text as the SRT sink prints it; drawings become empty."""
    tidy = _tidy_lines(ass_breaks(F.regexp_replace(text, ASS_TAG, "")))
    return F.when(is_drawing(text), F.lit("")).otherwise(tidy)


def clean_ass(text: Column, strip_effects: bool = True) -> Column:
    return _tidy_lines(ass_breaks(F.regexp_replace(text, ASS_TAG, "") if strip_effects else text))


def strip_formatting(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ASS_TAG, ""), HTML_TAG, "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def norm_text(text: Column) -> Column:
    """Similarity form: lower case, tags out, every run of other characters one space."""
    t = F.regexp_replace(F.lower(text), HTML_TAG, "")
    t = F.regexp_replace(t, ASS_TAG_FILLED, "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))


def alnum_text(text: Column) -> Column:
    """Letters, digits and white space only, lower case, trimmed."""
    kept = F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]", "")
    return strip_ws(F.lower(kept))


def display_text(text: Column, max_length: int = 80) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, HTML_TAG, ""), ASS_TAG_FILLED, "")
    t = strip_ws(F.regexp_replace(F.regexp_replace(t, r"\\[nN]", " "), rf"{WS}+", " "))
    cut = F.concat(F.substring(t, 1, max_length - 3), F.lit("..."))
    shown = F.when(F.length(t) > max_length, cut).otherwise(t)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("[empty]"))
        .when(t == "", F.lit("[formatting only]"))
        .otherwise(shown)
    )


def combine_texts(first: Column, second: Column, top: str = "first") -> Column:
    """Two cue texts on top of each other; an empty side leaves the other alone."""
    a, b = (first, second) if top == "first" else (second, first)
    return F.array_join(F.filter(F.array(a, b), lambda x: x.isNotNull() & (x != "")), "\n")


def eol_norm(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r", "\n")


def has_cjk_font(text: Column) -> Column:
    return text.rlike(CJK_FONT)


def has_cjk_chinese(text: Column) -> Column:
    return text.rlike(CJK_CHINESE)


def has_cjk_style(text: Column) -> Column:
    return text.rlike(CJK_STYLE)


def has_cjk_line(text: Column) -> Column:
    return text.rlike(CJK_LINE)


def cjk_first(text: Column) -> Column:
    """Lines with CJK characters first, order kept within both halves."""
    lines = F.split(text, "\n")
    top = F.filter(lines, has_cjk_line)
    rest = F.filter(lines, lambda x: ~has_cjk_line(x))
    return F.array_join(F.concat(top, rest), "\n")


def line_class(line: Column) -> Column:
    """``cjk`` if CJK characters occur and are not outnumbered by Latin letters."""
    # Runs go at once, and each count is taken once.
    cjk = F.length(F.regexp_replace(line, NOT_CJK_COUNTED + "+", ""))
    latin = F.length(F.regexp_replace(line, NOT_LATIN_COUNTED + "+", ""))
    return let(F.struct(cjk.alias("cjk"), latin.alias("latin")), lambda n: (
        F.when((n["cjk"] > 0) & (n["cjk"] >= n["latin"]), F.lit("cjk"))
        .when(n["latin"] > 0, F.lit("latin"))
        .otherwise(F.lit("other"))
    ))


def is_dialogue_style(style: Column) -> Column:
    name = F.trim(F.lower(F.coalesce(style, F.lit("Default"))))
    return ~name.rlike("|".join(NON_DIALOGUE_STYLES))
