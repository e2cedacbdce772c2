"""Texts are looked at and moved no more often than the job needs; results on rows that meet odd cases."""

from pyspark.sql import functions as F

from cueweave.functions import language as lg
from cueweave.functions import text as tx
from cueweave.operators.joins import merge_from_alignments
from cueweave.plans.ordered import number_rows
from cueweave.sources import ass


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_read_the_text_once(spark):
    counted = lg.detect_lang_counts(F.col("a_text"))
    assert str(counted).count("a_text") == 1
    rows = [("的" * 10,), ("的" * 11 + " abc",), ("的" * 9 + "かな" * 2,), ("가나다 라마바" * 3 + "的",), ("latin " * 50,), (None,), ("",)]
    found = spark.createDataFrame(rows, "a_text string").select(counted.alias("lang")).collect()
    assert [r.lang for r in found] == [None, "zh", "ja", "ko", None, "zh", None]  # a null text passes every test, as before


def test_line_class_counts_each_script_once(spark):
    kind = tx.line_class(F.col("line"))
    assert str(kind).count("regexp_replace") == 2
    rows = [("ab 的 c 的 的",), ("abc 的 的",), ("12 -",), ("",), (None,)]
    found = spark.createDataFrame(rows, "line string").select(kind.alias("k")).collect()
    assert [r.k for r in found] == ["cjk", "latin", "other", "other", "other"]


def test_full_ass_cleans_rows_not_arrays(spark):
    text = (
        "[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0, 0:00:01.00,0:00:02.00, {\\i1}a, b\nDialogue: x,0:00:01.00,0:00:02.00,c\n"
        "Dialogue: 0,0:00:01.00\nDialogue: ,0:00:03.00,0:00:04.00,d\nFormat: MarginL, Text\nDialogue: ,e\nDialogue: 7,f\nDialogue: y,g\n"
    )
    rows = ass.parse_full(spark.createDataFrame([(1, text)], "media_id long, text string"))
    whole = plan(rows)
    assert "regexp_replace" not in whole[whole.index("Generate"):]
    found = [tuple(r[c] for c in ("cue_idx", "layer", "start", "style", "name", "margin_l", "margin_r", "text", "raw")) for r in rows.orderBy("cue_idx").collect()]
    assert found == [
        (0, 0, "0:00:01.00", "Default", "", 0, 0, "a, b", "{\\i1}a, b"),
        (1, 0, "0:00:00.00", "Default", "", 0, 0, "e", "e"),
        (2, 0, "0:00:00.00", "Default", "", 7, 0, "f", "f"),
    ]


def test_numbered_rows_join_only_later_chunks(spark):
    rows = [(m, i, "x" * 50) for m in range(300) for i in (0, 3)] + [(300, i, "y") for i in (0, 9, 10, 25, 26)] + [(None, 1, "z"), (5, None, "z")]
    placed = number_rows(spark.createDataFrame(rows, "media_id long, cue_idx int, text string"), ["media_id"], "cue_idx", [], "at", width=10)
    # The two chunks of the last media with rows before them are written; nothing is counted again to be joined.
    assert "HashAggregate" not in plan(placed)
    found = {(r.media_id, r.cue_idx): r["at"] for r in placed.collect()}
    assert len(found) == 605 and found[300, 26] == 4 and found[300, 10] == 2 and found[7, 3] == 1


def test_alignments_move_each_text_once_or_twice(spark):
    def cues(*rows):
        return spark.createDataFrame([(m, i, s, s + 10, t) for m, i, s, t in rows], "media_id long, cue_idx int, start_ms long, end_ms long, text string")

    a = cues((1, 0, 100, "a0"), (1, 1, 200, "a1"), (1, 2, 300, "a2"), (2, 0, 400, "p"), (None, 0, 1, "n"), (1, None, 2, "m"))
    b = cues((1, 0, 150, "b0"), (1, 1, 250, "b1"), (1, 2, 350, "b2"), (2, 0, 450, "q"), (None, 0, 1, "k"))
    # One cue in two pairs, pairs whose other cue isn't there, a media without a reference, null keys.
    pairs = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 77), (1, 88, 2), (2, 0, 0), (1, None, 0), (None, 0, 0)], "media_id long, a_idx int, b_idx int")
    reference = spark.createDataFrame([(1, 2)], "media_id long, reference int")
    merged = merge_from_alignments(a, b, pairs, reference)
    assert sum("Join" in line for line in plan(merged).splitlines()) == 3
    got = sorted(((r.media_id, r.idx1, r.idx2, r.start_ms, r.text, r.kind) for r in merged.collect()), key=str)
    assert got == sorted([
        (1, 0, 0, 150, "a0\nb0", "both"), (1, 0, 1, 250, "a0\nb1", "both"), (1, 2, None, 300, "a2", "first"), (1, None, None, 2, "m", "first"),
        (None, 0, None, 1, "n", "first"), (None, None, 0, 1, "k", "second"),
    ], key=str)


def test_merge_deals_cues_out_once(spark):
    from cueweave.operators.merge import merge

    def cues(*rows):
        return spark.createDataFrame([(m, i, s, s + 1000, t) for m, i, s, t in rows], "media_id long, cue_idx int, start_ms long, end_ms long, text string")

    a, b = cues((1, 0, 0, "a"), (2, 0, 0, "c"), (3, 0, 0, "e"), (9, 0, 0, "x")), cues((1, 0, 10, "b"), (2, 0, 10, "d"), (4, 0, 0, "f"))
    kinds = {1: "embedded", 2: "external", 3: "external", 4: "external"}
    # The roles of one media stand twice and give no row twice; a media without roles isn't merged.
    roles = spark.createDataFrame(
        [(m, kinds[m], kinds[m], "english", "chinese") for m in (1, 2, 2, 3, 4)],
        "media_id long, source1 string, source2 string, language1 string, language2 string",
    )
    merged = merge(a, b, roles, align=False)
    # Only the roles of the one strategy that reads them are picked by a join.
    assert sum("LeftSemi" in line for line in plan(merged).splitlines()) <= 6
    got = sorted((r.media_id, r.text, r.strategy) for r in merged.collect())
    assert got == [(1, "b\na", "preserved"), (2, "d\nc", "comprehensive"), (3, "e", "copy_first"), (4, "f", "copy_second")]


def test_samples_move_references_once(spark):
    """The language is told once, and no text is moved to cut the references to the media of one language."""
    from cueweave.operators import anchors
    from cueweave.operators.summary import same_language

    rows = [(m, i, 4000 * i, 4000 * i + 900, f"line number {i} of film {m} is said") for m in range(3) for i in range(30)]
    a = spark.createDataFrame(rows, "media_id long, cue_idx int, start_ms long, end_ms long, text string")
    zh = a.withColumn("text", F.when(F.col("media_id") == 2, "的一是在不了有和人这").otherwise(F.col("text")))
    found = anchors.anchors_all(a, zh, same_language(a, zh))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert {r.media_id for r in found.where("method = 'similarity'").collect()} <= {0, 1}
    listed = spark.createDataFrame([(1,)], "media_id long")
    some, every = anchors.sample_anchors(a, zh, listed).collect(), anchors.sample_anchors(a, zh).where("media_id = 1").collect()
    assert len(some) == 20 and sorted(some) == sorted(every)


def test_keep_foreign_moves_overlay_texts_once(spark):
    """Pairs, leftovers of both sides and odd keys, out of one join."""
    from cueweave.operators.merge import merge_keep_foreign, merge_preserved

    def cues(*rows):
        return spark.createDataFrame([(m, i, s, s + 1000, t) for m, i, s, t in rows], "media_id long, cue_idx int, start_ms long, end_ms long, text string")

    english = cues((1, 0, 0, "one"), (1, 1, 20_000, "two"), (1, 0, 0, "again"), (2, 0, 0, "alone"), (None, 0, 0, "n"))
    foreign = cues((1, 0, 100, "un"), (1, 1, 90_000, "late"), (3, 0, 0, "seul"), (None, 0, 0, "n"))
    merged = merge_keep_foreign(english, foreign)
    assert "LeftAnti" not in plan(merged)
    rows = lambda df: sorted(((r.media_id, r.idx1, r.idx2, r.start_ms, r.text, r.kind) for r in df.collect()), key=str)
    assert rows(merged) == sorted([
        (1, 0, 0, 0, "un\none", "both"), (1, 0, 0, 0, "un\nagain", "both"), (1, 1, None, 20_000, "two", "first"), (1, None, 1, 90_000, "late", "second"),
        (2, 0, None, 0, "alone", "first"), (3, None, 0, 0, "seul", "second"),
    ], key=str)
    # A media whose reference is its second track, and which drops what its first track has left over.
    roles = spark.createDataFrame([(1, "external", "embedded", "english", "chinese")], "media_id long, source1 string, source2 string, language1 string, language2 string")
    assert rows(merge_preserved(foreign, english, roles)) == sorted([
        (1, 0, 0, 0, "one\nun", "both"), (1, 0, 0, 0, "again\nun", "both"), (1, None, 1, 20_000, "two", "second"),
    ], key=str)
