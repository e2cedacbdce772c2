"""Language of a text, a file name, a language tag or a track sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.plans.arrays import let

# Words whose substrings vote for English.
ENGLISH_WORDS = (
    "the and you that was for are with his they have this will your from know want been "
    "good much some time very when come here how just like long make many over such take "
    "than them well were what where who would there could"
).split()

# Language families, most specific spelling irrelevant, order matters for names.
NAME_TAGS = {
    "zh": ("zh", "chi", "chs", "cht", "cn", "chinese"),
    "ja": ("ja", "jp", "jpn", "japanese"),
    "ko": ("ko", "kr", "kor", "korean"),
    "fr": ("fr", "fre", "fra", "french"),
    "de": ("de", "ger", "deu", "german"),
    "es": ("es", "spa", "spanish"),
    "en": ("en", "eng", "english"),
}
LANG_CODES = {
    "zh": ("chi", "zho", "chs", "cht", "zh", "chinese", "cn", "cmn", "yue", "hak", "nan"),
    "en": ("eng", "en", "english", "enm", "ang"),
    "ja": ("jpn", "ja", "japanese"),
    "ko": ("kor", "ko", "korean"),
    "fr": ("fre", "fr", "french", "fra"),
    "de": ("ger", "de", "german", "deu"),
    "es": ("spa", "es", "spanish"),
}
# File-name fragments that mark a Chinese or an English subtitle.
EXTERNAL_PATTERNS = {
    "chinese": (".zh", ".chi", ".chs", ".cht", ".cn", ".chinese",
                "_zh", "_chi", "_chs", "_cht", "_cn", "_chinese"),
    "english": (".en", ".eng", ".english", "_en", "_eng", "_english"),
}
# Suffixes removed before a bilingual name, a split name, a pair key is formed.
# Tried in this order; the first that fits is removed.
BILINGUAL_SUFFIXES = (
    "zh en chi eng chs cht cn chinese english ja jp jpn japanese ko kr kor korean "
    "fr fre fra french de ger deu german es spa spanish bilingual dual"
).split()
SPLIT_SUFFIXES = (
    "zh-en en-zh zh-ja ja-zh zh-ko ko-zh ja-en en-ja ko-en en-ko bilingual dual "
    "zh en chi eng chs cht cn chinese english ja jp jpn japanese ko kr kor korean "
    "fr fre fra french de ger deu german es spa spanish"
).split()
PAIR_SUFFIXES = "zh en chi eng chinese english".split()

_CJK_CLASSES = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
_HAN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
_LATIN1_LETTERS = r"[^A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"


def count_in(text: Column, complement: str) -> Column:
    """Characters left after deleting the complement class, a run of it at a time."""
    return F.length(F.regexp_replace(text, complement + "+", ""))


def detect_lang(text: Column) -> Column:
    """First CJK character decides; then English word votes; then the Latin-1 letter share."""
    first = F.regexp_extract(text, _CJK_CLASSES, 0)
    low = F.lower(text)
    hits = reduce(
        lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in ENGLISH_WORDS]
    )
    some = low.rlike("|".join(ENGLISH_WORDS))
    letters = count_in(text, r"[^\p{L}]")
    latin = count_in(text, _LATIN1_LETTERS)
    return (
        F.when(first.rlike(_HAN), "zh")
        .when(first.rlike(r"[\x{3040}-\x{30FF}]"), "ja")
        .when(first != "", "ko")
        # One hit is enough beyond 10 characters, so only short texts are counted word by word.
        .when(some & (F.length(text) > 10), "en")
        .when(some & (hits >= 2), "en")
        .when((letters > 5) & (latin / letters > 0.8), "en")
        .otherwise("unknown")
    )


def detect_lang_legacy(text: Column) -> Column:
    return F.when(text.rlike(_HAN), "chinese").otherwise("english")


def lang_from_name(name: Column) -> Column:
    low = F.lower(name)
    out = F
    for lang, tags in NAME_TAGS.items():
        out = out.when(low.rlike(rf"[._](?:{'|'.join(tags)})\."), lang)
    return out.otherwise("unknown")


def lang_codes_rows() -> list[tuple[str, str]]:
    return [(code, lang) for lang, codes in LANG_CODES.items() for code in codes]


def norm_lang(code: Column) -> Column:
    """Two-letter family of a track tag; unknown families keep their first two characters."""
    low = F.lower(F.coalesce(code, F.lit("")))
    out = F.when(low == "", "unknown")
    for lang, codes in LANG_CODES.items():
        out = out.when(low.isin(*codes), lang)
    return out.otherwise(F.substring(low, 1, 2))


def language_name(code: Column) -> Column:
    """``chinese``, ``english`` or NULL."""
    low = F.lower(code)
    return F.when(low.isin(*LANG_CODES["zh"]), "chinese").when(low.isin(*LANG_CODES["en"]), "english")


def detect_lang_counts(text: Column, head: int | None = None) -> Column:
    """Count rule: more than 10 CJK characters, then Hangul and kana shares.

    Reads the whole text, or its first ``head`` characters (the single-machine rule: 2000).
    """
    head = text if head is None else F.substring(text, 1, head)

    def shares(counted: Column) -> Column:
        # What is counted is among the counted characters, of which most texts have few or none.
        cjk, kana, hangul = F.length(counted), count_in(counted, r"[^\x{3040}-\x{30FF}]"), count_in(counted, r"[^\x{AC00}-\x{D7AF}]")
        return let(F.struct(cjk.alias("cjk"), kana.alias("kana"), hangul.alias("hangul")), lambda n: (
            F.when(~(n["cjk"] > 10), F.lit(None).cast("string"))
            .when((n["hangul"] > n["kana"]) & (n["hangul"] > n["cjk"] * 0.3), "ko")
            .when(n["kana"] > n["cjk"] * 0.1, "ja")
            .otherwise("zh")
        ))

    return let(F.regexp_replace(head, r"[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+", ""), shares)


def sync_lang(name: Column, content: Column) -> Column:
    """Language used to pick a sync track: name fragments first, then character counts."""
    low = F.lower(name)
    return (
        F.when(low.rlike(r"\.(?:zh|chi|chs|cht|chinese)\.|\.zh-"), "zh")
        .when(low.rlike(r"\.(?:ja|jpn|japanese)\."), "ja")
        .when(low.rlike(r"\.(?:ko|kor|korean)\."), "ko")
        .when(low.rlike(r"\.(?:en|eng|english)\."), "en")
        .otherwise(detect_lang_counts(content))
    )


def is_chinese_track(language: Column, sample: Column) -> Column:
    """Tag says Chinese, or more than 30 % Han among the letters and digits of the sample."""
    tag = F.lower(F.coalesce(language, F.lit(""))).isin("zh", "chi", "chinese", "zh-cn", "zh-tw")
    total = count_in(sample, r"[^\p{L}\p{N}]")
    return tag | F.coalesce((total > 0) & (count_in(sample, r"[^\x{4E00}-\x{9FFF}]") / total > 0.3), F.lit(False))


def is_english_track(language: Column, sample: Column) -> Column:
    tag = F.lower(F.coalesce(language, F.lit(""))).isin("en", "eng", "english")
    total = count_in(sample, r"[^\p{L}\p{N}]")
    return tag | F.coalesce((total > 0) & (count_in(sample, "[^A-Za-z]") / total > 0.7), F.lit(False))


def resolve_lang(name: Column, content: Column, head: int | None = None) -> Column:
    """File name first, then the content: all of it, or its first ``head`` characters (the single-machine rule: 4096)."""
    part = content if head is None else F.substring(content, 1, head)
    return F.coalesce(F.nullif(lang_from_name(name), F.lit("unknown")), detect_lang(part))


def strip_suffix(stem: Column, suffixes: list[str], ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.regexp_replace(stem, rf"{flag}\.(?:{'|'.join(suffixes)})$", "")


def base_name(stem: Column) -> Column:
    """Pair key: one of six language suffixes removed, case as written."""
    return strip_suffix(stem, PAIR_SUFFIXES, ignore_case=False)


def split_base_name(stem: Column) -> Column:
    return strip_suffix(stem, SPLIT_SUFFIXES)


def bilingual_name(stem: Column, lang1: Column, lang2: Column, ext: Column) -> Column:
    """Foreign language first, English second; otherwise alphabetical; unknown side gives ``bilingual``."""
    clean = strip_suffix(stem, BILINGUAL_SUFFIXES)
    pair = (
        F.when((lang1 == "en") & (lang2 != "en"), F.concat_ws("-", lang2, lang1))
        .when((lang2 == "en") & (lang1 != "en"), F.concat_ws("-", lang1, lang2))
        .otherwise(F.concat_ws("-", F.least(lang1, lang2), F.greatest(lang1, lang2)))
    )
    known = (lang1 != "unknown") & (lang2 != "unknown")
    return F.concat_ws(".", clean, F.when(known, pair).otherwise("bilingual"), ext)
