"""Hand-derived micro-cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from cueweave.functions import keywords as kw
from cueweave.functions import language as lg
from cueweave.functions import similarity as sim
from cueweave.functions import text as tx
from cueweave.functions import timecode as tc
from cueweave.operators import similarity_join as sj


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("text, fmt, ms", [
    ("01:23:45,678", "srt", 5025678), ("01:23:45.678", "srt", 5025678), ("0:01:30.94", "ass", 90940),
    ("01:02.003", "vtt", 62003), ("not a time", "srt", None),
])
def test_time_to_ms(spark, text, fmt, ms):
    assert one(spark, text, lambda c: tc.time_to_ms(c, fmt)) == ms


@pytest.mark.parametrize("ms, fmt, text", [
    (3825678, "srt", "01:03:45,678"), (3825678, "ass", "1:03:45.67"), (3825678, "vtt", "01:03:45.678"), (-5, "srt", "00:00:00,000"),
])
def test_ms_to_time(spark, ms, fmt, text):
    assert one(spark, str(ms), lambda c: tc.ms_to_time(c.cast("bigint"), fmt)) == text


@pytest.mark.parametrize("ms, text", [(3825500, "1h 3m 45.5s"), (45500, "45.5s"), (185000, "3m 5.0s")])
def test_duration(spark, ms, text):
    assert one(spark, str(ms), lambda c: tc.format_duration(c.cast("bigint"))) == text


@pytest.mark.parametrize("text, ms", [
    ("2.5s", 2500), ("-1500ms", -1500), ("00:00:02,500", 2500), ("1500", 1500), ("2.5", 2500),
    ("-00:00:02,500", -2500), ("-1.5S", -1500), ("soon", None),
])
def test_parse_offset(spark, text, ms):
    assert one(spark, text, tc.parse_offset) == ms


@pytest.mark.parametrize("text, out", [
    ("{\\i1}Hi\\N there ", "Hi\nthere"), ("{\\p1}m 0 0 l 10 10", ""), ("{\\fad(1,2)}", ""),
])
def test_clean_srt(spark, text, out):
    assert one(spark, text, tx.clean_srt) == out


@pytest.mark.parametrize("line, kind", [("你好 ab", "cjk"), ("你好 abc", "latin"), ("123", "other")])
def test_line_class(spark, line, kind):
    assert one(spark, line, tx.line_class) == kind


@pytest.mark.parametrize("text, lang", [("こんにちは", "ja"), ("日本語です", "zh"), ("Hello world", "en"), ("hi", "unknown")])
def test_detect_lang(spark, text, lang):
    assert one(spark, text, lg.detect_lang) == lang


@pytest.mark.parametrize("text, words", [
    ("I saw Matsumura at NASA in 1984", ["1984", "Matsumura", "NASA"]), ("Matsumura left", []), ("松村 Matsumura", ["Matsumura"]),
])
def test_keywords(spark, text, words):
    assert one(spark, text, kw.keywords) == words


def test_bilingual_name(spark):
    name = one(spark, "Planet.1968.Bluray.zh", lambda c: lg.bilingual_name(c, F.lit("zh"), F.lit("en"), F.lit("srt")))
    assert name == "Planet.1968.Bluray.zh-en.srt"


def test_similarity_scores(spark):
    df = spark.createDataFrame([("hello world", "hello there world")], "a string, b string")
    row = sj.pair_scores(sj.profiled(sj.profiled(df, "a", "p"), "b", "q"), "p", "q").select(
        "*", sj.total_score().alias("total"), sim.variance_penalty([F.col(f"s_{n}") for n in sim.WEIGHTS]).alias("var")
    ).first()
    want = {"s_sequence": .785714, "s_jaccard": .666667, "s_cosine": .816497, "s_edit": .647059,
            "s_length": .647059, "s_common": .666667, "total": .721493, "var": .009533}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6)


# The script ranges, stated apart from the library: each test at its borders and one beyond.
HAN = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)]
KANA, HANGUL, PUNCTUATION, WIDE = [(0x3040, 0x309F), (0x30A0, 0x30FF)], [(0xAC00, 0xD7AF)], [(0x3000, 0x303F)], [(0xFF00, 0xFFEF)]
RARE = [(0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF)]
SCRIPTS = {
    "has_cjk_font": HAN + KANA + HANGUL, "has_cjk_chinese": HAN + RARE + PUNCTUATION + WIDE, "has_cjk_style": HAN + PUNCTUATION + KANA + HANGUL,
    "has_cjk_line": HAN + RARE[:3] + [(0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x1100, 0x11FF)] + KANA + HANGUL,
}


@pytest.mark.parametrize("name", SCRIPTS)
def test_script_borders(spark, name):
    points = {c for ranges in SCRIPTS.values() for a, b in ranges for c in (a - 1, a, a + 1, b - 1, b, b + 1)} - set(range(0xD800, 0xE000))
    rows = spark.createDataFrame([(c, chr(c)) for c in sorted(points)], "c int, v string").select("c", getattr(tx, name)(F.col("v")).alias("o")).collect()
    assert {r.c for r in rows if r.o} == {c for c in points if any(a <= c <= b for a, b in SCRIPTS[name])}


def _plain_keywords(text):
    import re
    found = set()
    for line in re.split(r"\\[Nn]|\n", re.sub(r"<[^>]+>", "", re.sub(r"\{[^}]*\}", "", text))):
        cjk = re.search(r"[\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF]", line)
        for pos, w in enumerate(re.findall(r"[A-Za-z']+|[0-9]+", line)):
            proper = re.fullmatch("[A-Z][A-Za-z]*[a-z][A-Za-z]*", w) and (cjk or pos > 0)
            if (re.fullmatch("[0-9]{2,}|[A-Z]{2,}", w) or proper) and w.lower() not in kw.STOP_WORDS + kw.NOISE_WORDS:
                found.add(w)
    return sorted(found)


def test_keywords_by_one_pattern(spark):
    """Apostrophes, digits beside letters, first words with and without CJK, acronyms, stop words."""
    texts = [
        "Ab12 CD ab", "'Ab Cd's Ef'", "AB Cd", "  -- Hello World 5 55", "A Bb b\\NCc Dd 的 Ee\nFf Gg", "", "X", "XY'z Zz", "HELLO There", "12Ab",
        "Ab-Cd The THE", "Ab'", "'Ab", "1 Ab", "ABc dE", "a Ab 的", "Éa Bc", "{x}Ab <i>Cd", "Ab\tCd", "...Ab'Cd Ef", "7Seven Of Nine99 007",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", kw.keywords(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == {t: _plain_keywords(t) for t in texts}


def test_tokens_found_once_per_side(spark):
    from cueweave.operators import anchors

    cues = spark.createDataFrame([(1, 0, 0, "of Ann and 12"), (1, 1, 9, "nothing")], "media_id long, cue_idx int, start_ms long, text string")
    pairs = anchors.keyword_pairs(cues, cues)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2
    assert [(r.src_sig, r.n_shared, r.n_src, r.n_ref) for r in pairs.collect()] == [(["12", "ann"], 2, 1, 1)]


def test_edits(spark):
    """Few edits, many, different lengths, characters of several bytes, nulls."""
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = ["", "a", "kitten", "sitting", "的 of the long way home", "of the long way hoṁe 的", "x" * 20, "abcdefgh" * 4, "bcdefghi" * 4, "ABCDEFGH", "abcdefghi"]
    pairs = [(a, b) for a in texts for b in texts]
    rows = spark.createDataFrame([*pairs, (None, "a")], "a string, b string").select("a", "b", sim.edits(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.e for r in rows] == [*(plain(a, b) for a, b in pairs), None]


def test_profile_counts(spark):
    """Texts with and without a repeated word."""
    df = spark.createDataFrame([("a b c",), ("a b a c a b",), ("",)], "t string")
    assert [r.p.counts for r in sim.with_profile(df, "t", "p").collect()] == [[1, 1, 1], [3, 2, 1], []]
