"""Parsers, ordered windows, merges and streaming on small fixtures."""

import pytest
from pyspark.sql import functions as F

from cueweave.functions import text as tx
from cueweave.operators import joins as jn
from cueweave.operators import merge as mg
from cueweave.operators import similarity_join as sj
from cueweave.operators import summary as sm
from cueweave.operators import sync as sy
from cueweave.operators import timing as tm
from cueweave.operators import tracks as tk
from cueweave.sources import ass, files, sink, srt, vtt
from cueweave.streaming import feeds

CUES = "media_id long, cue_idx int, start_ms long, end_ms long, text string"


def cues(spark, *rows):
    return spark.createDataFrame([(1, i, s, e, t) for i, (s, e, t) in enumerate(rows)], CUES)


def roles(spark, s1, s2, l1="chinese", l2="english"):
    return spark.createDataFrame([(1, s1, s2, l1, l2)], "media_id long, source1 string, source2 string, language1 string, language2 string")


def spans(df, *cols):
    return [tuple(r) for r in df.orderBy("start_ms", "end_ms").select(*(cols or ("start_ms", "end_ms", "text"))).collect()]


def text_file(spark, text, ext="srt"):
    return spark.createDataFrame([(1, ext, text)], "media_id long, ext string, text string")


def test_parse_srt_malformed(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\nOne\n\nnonsense\n\n00:00:03.000 --> 00:00:04.500\nTwo\nlines\n \n3\n00:xx --> 1\nbad\n"
    assert spans(srt.parse(text_file(spark, text))) == [(1000, 2000, "One"), (3000, 4500, "Two\nlines")]
    assert srt.rejects(text_file(spark, text)).count() == 2
    assert srt.parse(text_file(spark, "")).count() == 0


def test_parse_vtt(spark):
    text = "WEBVTT\n\nNOTE hi\n\nid\n00:01.000 --> 00:02.500 line:0\nA\n\n01:00:00.000 --> 01:00:01.000\nB\n"
    assert spans(vtt.parse(text_file(spark, text, "vtt"))) == [(1000, 2500, "A"), (3600000, 3601000, "B")]


def test_parse_ass_reordered(spark):
    text = (
        "[Script Info]\nPlayResY: 1080\n[Events]\nFormat: Start, End, Style, Text\n"
        "Dialogue: 0:00:01.50,0:00:02.00,Main,a, b\\Nc\nDialogue: 0:00:03.00\n"
    )
    row = ass.parse(text_file(spark, text, "ass")).first()
    assert (row.start_ms, row.end_ms, row.style, row.text) == (1500, 2000, "Main", "a, b\nc")
    info = ass.script_info(text_file(spark, text, "ass"))
    assert mg.bilingual_style(info).first().font_size == 51


def test_decode_ladder(spark):
    text = "你好，世界\r\nline"
    data = [
        (1, bytearray("﻿".encode() + text.encode())), (2, bytearray(text.encode())),
        (3, bytearray(text.encode("gb18030"))), (4, bytearray("caf\xe9 x".encode("latin-1"))),
    ]
    out = {r.media_id: (r.encoding, r.text) for r in files.decode(spark.createDataFrame(data, "media_id long, content binary")).collect()}
    want = "你好，世界\nline"
    assert out[1] == ("utf-8-sig", want) and out[2] == ("utf-8", want) and out[3] == ("gb18030", want)
    assert out[4][0] == "latin-1" and out[4][1] == "café x"


def test_render_round_trip(spark):
    df = cues(spark, (0, 1500, "A"), (2000, 2050, "too short"), (3000, 4000, "{\\b1}B"), (3000, 4004, "B"))
    blocks = [r.block for r in srt.render(df).orderBy("seq").collect()]
    assert spans(srt.parse(text_file(spark, "\n".join(blocks)))) == [(0, 1500, "A"), (3000, 4000, "B")]


def test_fix_fonts(spark):
    text = "[V4+ Styles]\nFormat: Name, Fontname, Encoding\nStyle: D,Gone,134\nStyle: E,Arial,1\n[Events]\n你"
    fonts = spark.createDataFrame([("Arial",)], "fontname string")
    row = ass.replace_fonts(text_file(spark, text, "ass"), "text", fonts).first()
    assert row.fonts_fixed == 1 and "Style: D, Microsoft YaHei, 1" in row.new_text


def test_shifts(spark):
    df = cues(spark, (1500, 3000, "x"))
    assert spans(tm.shift(df, -2000)) == [(0, 1500, "x")]
    assert spans(tm.apply_offset(df, -2000)) == [(0, 1000, "x")]


def test_anti_jitter_across_chunks(spark):
    df = cues(spark, (0, 1000, "A"), (1050, 2000, "A"), (2200, 3000, "A"), (599_950, 599_990, "B"), (600_010, 601_000, "B"))
    assert spans(tm.anti_jitter(df)) == [(0, 2000, "A"), (2200, 3000, "A"), (599_950, 601_000, "B")]


def test_timing_stats_and_level(spark):
    diffs = spark.createDataFrame([(1, d) for d in (100, 200, 300, 400, 5000)], "media_id long, diff_ms long")
    row = sm.timing_stats(diffs).withColumn("level", sm.sync_level(F.col("core_ms"), F.col("max_ms"))).first()
    assert (row.avg_ms, row.max_ms, row.core_ms, row.level) == (1200, 5000, 250, "MODERATE")


def test_robust_offset(spark):
    df = spark.createDataFrame([(1, o) for o in (5000, 5040, 5100, 30000)], "media_id long, time_offset_ms long")
    row = sm.robust_offset(df).first()
    assert (row.median_ms, row.mad_ms, row.confidence) == (5040, 40, 1.0)


def test_offset_vote(spark):
    ext = spark.createDataFrame([(1, i, t) for i, t in enumerate((1000, 4000, 9000))], "media_id long, ext_i int, ext_ms long")
    emb = spark.createDataFrame([(1, t) for t in (500, 3500, 8500, 12000)], "media_id long, emb_ms long")
    row = sy.offset_vote(ext, emb).first()
    assert (row.offset_ms, row.votes) == (500, 3)


def test_merge_comprehensive(spark):
    a = cues(spark, (0, 2000, "你好"), (5000, 6000, "再见"))
    b = cues(spark, (500, 2500, "Hello"), (5900, 7900, "Bye"))
    assert spans(mg.merge_comprehensive(a, b)) == [(0, 2500, "你好\nHello"), (5000, 6000, "再见"), (5900, 7900, "Bye")]


def test_merge_preserved_modes(spark):
    a, b = cues(spark, (0, 2000, "你好")), cues(spark, (1950, 4000, "Hello"))
    assert spans(mg.merge_preserved(a, b, roles(spark, "embedded", "embedded"))) == [(0, 2000, "你好")]
    assert spans(mg.merge_preserved(a, b, roles(spark, "embedded", "external"))) == [(0, 2000, "你好\nHello")]
    kept = mg.merge_preserved(cues(spark, (9000, 9500, "远"), (0, 1000, "你")), b, roles(spark, "external", "embedded"))
    assert spans(kept) == [(1950, 4000, "你\nHello"), (9000, 9500, "远")]


def test_merge_mixed_realigns(spark):
    """The external track is a minute late and has two cues before the first shared name."""
    b = cues(spark, *[(s * 1000, s * 1000 + 900, f"then Name{chr(65 + s)}x said so") for s in range(1, 8)])
    a = cues(spark, (1000, 2000, "序"), (3000, 4000, "幕"), *[(60_000 + s * 1000, 60_900 + s * 1000, f"他 Name{chr(65 + s)}x") for s in range(1, 8)])
    merged = mg.merge_mixed(a, b, roles(spark, "external", "embedded"))
    assert spans(merged, "start_ms", "end_ms") == [(s * 1000, s * 1000 + 900) for s in range(1, 8)]
    assert all("\n" in t for (t,) in spans(merged, "text"))


def test_merge_enhanced_keeps_all(spark):
    a = cues(spark, (1000, 2000, "one green house"), (20_000, 21_000, "the running river"))
    b = cues(spark, (1500, 2500, "one green house"), (40_000, 41_000, "the running river"))
    merged = mg.merge_enhanced(a, b, roles(spark, "external", "external"))
    assert spans(merged, "start_ms", "kind") == [(1000, "both"), (20_000, "both")]


@pytest.mark.parametrize("rows, bilingual", [([(0, 1, "你好\nHello there")], True), ([(0, 1, "你好"), (2, 3, "123")], False)])
def test_is_bilingual(spark, rows, bilingual):
    assert sm.is_bilingual(cues(spark, *rows)).first().bilingual is bilingual


@pytest.mark.parametrize("parse, text", [
    (vtt.parse, "WEBVTT\n\nNOTE\n" + "line\n" * 100_000 + "\n00:01.000 --> 00:02.000\nA\n"),
    (vtt.parse, "WEBVTT\n\n" + "line\n" * 100_000 + "00:01.000 --> 00:02.000\nA\n"),
    (srt.parse, "1\n00:00:01,000 --> 00:00:02,000\n" + " " * 1_000_000 + "A" + " " * 1_000_000),
])
def test_long_blocks(spark, parse, text):
    assert spans(parse(text_file(spark, text))) == [(1000, 2000, "A")]


def test_long_ass(spark):
    text = "[Events]\nFormat: Start, End, Text\n" + "Dialogue: 0:00:01.00,0:00:02.00,A\n" * 100_000
    assert ass.parse(text_file(spark, text, "ass")).agg(F.count("*"), F.max("end_ms"), F.max("cue_idx")).first()[:] == (100_000, 2000, 99_999)


def test_one_scan(spark):
    """Decoding and format dispatch read their files once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    data = docs.select(F.col("doc_id").alias("media_id"), F.lit("srt").alias("ext"), F.encode("text", "UTF-8").alias("content"))
    plan = files.parse_cues(files.decode(data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_unreadable_file(spark):
    rows = spark.createDataFrame([(1, "srt", None), (2, "srt", bytearray(b"x"))], "media_id long, ext string, content binary")
    assert {r.media_id: r.status for r in files.reencode(rows).collect()} == {1: "failed", 2: "modified"}


def test_white_space_ends(spark):
    """The class and the list of its characters agree."""
    chars = [chr(c) for c in range(0x3010) if c != 0xFEFF]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", tx.strip_ws(F.concat("c", F.lit("a"), "c")).alias("s"), F.col("c").rlike(f"^{tx.WS}$").alias("w"))
    assert all((r.s == "a") == r.w for r in rows.collect())


def test_files_out_and_in(spark, tmp_path):
    """Chosen media as single files, found again with the scan's defaults."""
    rows = [(m, i, 1000 * i, 1000 * i + 500, f"cue {i} of {m}") for m in (1, 2) for i in range(3)]
    wanted = sorted((str(m), i, s, e, t) for m, i, s, e, t in rows)
    frame = spark.createDataFrame(rows, CUES)
    for fmt, render in (("srt", srt.render), ("vtt", vtt.render), ("ass", ass.render)):
        path = str(tmp_path / fmt)
        sink.write_bundles(render(frame), f"{path}/bundles", fmt)
        assert sink.export_files(spark, files.scan_bundles(spark, f"{path}/bundles"), f"{path}/files") == 2
        found = files.scan_corpus(spark, f"{path}/files")
        assert found.count() == 2
        cues_back = files.parse_cues(files.decode(found.withColumn("media_id", F.col("stem"))))
        assert sorted((r.media_id, r.cue_idx, r.start_ms, r.end_ms, r.text) for r in cues_back.collect()) == wanted
        feeds.ingest(spark, f"{path}/files", f"{path}/check", f"{path}/cues")
        assert spark.read.parquet(f"{path}/cues").count() == 6


def test_pairs_stay_in_their_directory(spark):
    videos = spark.createDataFrame([(1, "x", "movie"), (2, "y", "movie")], "media_id long, directory string, stem string")
    subs = spark.createDataFrame(
        [("x", "movie.zh", "srt", "你好"), ("y", "movie.en", "srt", "hello"), ("z", "movie.zh", "srt", "你好")],
        "directory string, stem string, ext string, text string",
    )
    assert [tuple(r)[:4] for r in tk.pick_external(videos, subs, "chinese").collect()] == [(1, "x", "movie", "movie.zh.srt")]
    named = subs.withColumn("name", F.concat_ws(".", "stem", "ext"))
    assert sorted((r.media_id, r.subtitle) for r in tk.pair_prefix(videos, named).collect()) == [(1, "movie.zh.srt"), (2, "movie.en.srt")]
    assert sorted((r.media_id, r.name) for r in tk.external_subtitles(videos, subs).collect()) == [(1, "movie.zh.srt"), (2, "movie.en.srt")]
    both = subs.withColumn("path", F.concat("directory", F.lit("/"), "stem"))
    pairs = tk.pair_files(both, both.where("directory <> 'z'")).collect()
    assert sorted((r.source, r.reference) for r in pairs) == [("x/movie.zh", "x/movie.zh"), ("y/movie.en", "y/movie.en")]


def test_whole_ass_file(spark):
    english = text_file(spark, "[Script Info]\nTitle: T\nPlayResY: 1080\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: Main,Arial\n\n[Events]\n", "ass")
    merged = spark.createDataFrame(
        [(1, 0, 0, 2000, 3000, "a\nb", "Bilingual", None, "both"), (1, None, 1, 1000, 1500, "sign", "Sign", "{\\an8}sign", "second")],
        "media_id long, idx1 int, idx2 int, start_ms long, end_ms long, text string, style string, raw string, kind string",
    )
    text = "\n".join(r.block for r in mg.ass_file(merged, english).orderBy("seq").collect())
    assert text == (
        "[Script Info]\nTitle: T\nPlayResY: 1080\n\n[V4+ Styles]\nFormat: Name, Fontname\nStyle: Main,Arial\n"
        "Style: Bilingual,Microsoft YaHei,51,&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,15,15,50,1\n\n"
        f"[Events]\n{ass.EVENT_FORMAT}\nDialogue: 0,0:00:01.00,0:00:01.50,Sign,,0,0,0,,{{\\an8}}sign\n"
        "Dialogue: 0,0:00:02.00,0:00:03.00,Bilingual,,0,0,0,,a\\Nb"
    )


def test_aligned_pairs_keep_styles(spark):
    a = cues(spark, (0, 10, "x"), (20, 30, "y")).withColumn("style", F.lit("A")).withColumn("raw", F.concat(F.lit("r"), "text"))
    b = cues(spark, (1, 11, "u"), (50, 60, "v")).withColumn("style", F.lit("B")).withColumn("raw", F.concat(F.lit("r"), "text"))
    pairs = spark.createDataFrame([(1, 0, 0)], "media_id long, a_idx int, b_idx int")
    reference = spark.createDataFrame([(1, 2)], "media_id long, reference int")
    rows = jn.merge_from_alignments(a, b, pairs, reference).collect()
    assert {(r.kind, r.style, r.raw, r.start_ms) for r in rows} == {("both", "A", None, 1), ("first", "A", "ry", 20), ("second", "B", "rv", 50)}
    out = mg.merge_enhanced(a, b, roles(spark, "external", "external")).collect()
    assert {(r.style, r.raw) for r in out if r.kind != "both"} <= {("A", "ry"), ("B", "rv")}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 19, 20, 25])
def test_quartile_spots(spark, n):
    """Only the spots of a media's own scan are compared."""
    spots = {k for k in (0, min(20, n) // 4, min(20, n) // 2, 3 * min(20, n) // 4, min(20, n) - 1)}
    words = [chr(97 + i) * 9 for i in range(26)]
    src = cues(spark, *[(i, i + 1, words[i]) for i in range(n)])
    ref = cues(spark, *[(i, i + 1, words[i]) for i in range(n + 1)])
    for only in range(n):
        table = spark.createDataFrame([(words[only], words[only])], "text string, translated string")
        got = sj.anchor_quartiles(src, ref, table).collect()
        assert [(r.a_idx, r.b_idx) for r in got] == ([(only, only)] if only in spots else [])
        if only >= 3 and n > 4:
            break


def test_offset_vote_loops(spark):
    """Starts far apart, times on both sides of spans, repeated and null times, ties, another tolerance."""
    import random

    rng = random.Random(4)
    for tolerance in (0, 200, 50_000):
        ext, emb = [], []
        for media in range(12):
            apart = rng.choice((40, 4_000, 90_000))
            ext += [(media, i, rng.randrange(apart * 15)) for i in range(rng.randrange(1, 9))]
            emb += [(media, rng.randrange(-2_000, apart * 20)) for _ in range(rng.randrange(1, 30))]
        ext += [ext[0], (50, 0, 100), (51, 0, None)]
        emb += [emb[0], (52, 7), (51, 3), (0, None)]
        want = {}
        for media in {m for m, _, t in ext if t is not None} & {m for m, t in emb if t is not None}:
            starts = [(i, t) for m, i, t in ext if m == media and t is not None]
            times = [t for m, t in emb if m == media and t is not None]
            votes = lambda o: len({i for i, t in starts if any(abs(t - x - o) <= tolerance for x in times)})  # noqa: E731, B023
            best = min((-votes(t - x), i, x, t - x) for i, t in starts for x in times)
            want[media] = (best[3], -best[0], sum(m == media for m, _, _ in ext))
        found = sy.offset_vote(
            spark.createDataFrame(ext, "media_id long, ext_i int, ext_ms long"), spark.createDataFrame(emb, "media_id long, emb_ms long"), tolerance
        )
        assert found.dtypes == [("media_id", "bigint"), ("offset_ms", "bigint"), ("votes", "bigint"), ("n_ext", "bigint")]
        assert {r.media_id: (r.offset_ms, r.votes, r.n_ext) for r in found.collect()} == want


def test_offset_vote_gathers_times_alone(spark):
    """No operator sorts the differences: single times are gathered per span."""
    ext = spark.createDataFrame([(1, i, 4_000 * i) for i in range(15)], "media_id long, ext_i int, ext_ms long")
    emb = spark.createDataFrame([(1, 4_000 * i) for i in range(30)], "media_id long, emb_ms long")
    plan = sy.offset_vote(ext, emb)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate explode(sequence(") == 1
