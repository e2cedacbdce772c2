"""Registered queries: every operator run over the whole given tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``. Text and time
columns carry the names the SQL twins in ``catalog_sql`` use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave import adapters as ad
from cueweave.functions import keywords as kw
from cueweave.functions import language as lg
from cueweave.functions import similarity as sim
from cueweave.functions import text as tx
from cueweave.functions import timecode as tc
from cueweave.operators import anchors as an
from cueweave.operators import joins as jn
from cueweave.operators import matching as mt
from cueweave.operators import merge as mg
from cueweave.operators import similarity_join as sj
from cueweave.operators import split as sp
from cueweave.operators import summary as sm
from cueweave.operators import sync as sy
from cueweave.operators import timing as tm
from cueweave.operators import tracks as tk
from cueweave.plans.lineage import scratch_path
from cueweave.sources import ass, files, manifest, srt, vtt
from cueweave.sources.sink import write_bundles
from cueweave.streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def r6(col: Column | str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def cues_a(s: SparkSession, d: str) -> DataFrame:
    return ad.cues(ad.track_a(s, d), "txt")


def cues_same(s: SparkSession, d: str) -> DataFrame:
    return ad.cues(ad.track_b(s, d), "txt_same")


def cues_zh(s: SparkSession, d: str) -> DataFrame:
    return ad.cues(ad.track_b(s, d), "txt_zh")


def named_a(s: SparkSession, d: str) -> DataFrame:
    """Track a with a CJK mark per line, so its capitalised words count as names."""
    return cues_a(s, d).withColumn("text", F.concat("text", F.lit(" 的")))


def named_b(s: SparkSession, d: str) -> DataFrame:
    return cues_same(s, d).withColumn("text", F.concat("text", F.lit(" 的")))


# ---- scans, parsers, sinks ------------------------------------------------

def _written_corpus(s: SparkSession, d: str) -> str:
    """The documents as rendered VTT files, bundled below the shared folder."""
    path = scratch_path(s, "corpus")
    write_bundles(vtt.render(cues_a(s, d)), path, "vtt")
    return path


@query("scan_corpus")
def _(s, d):
    """Written, scanned, decoded and parsed again."""
    return files.parse_cues(files.decode(files.scan_bundles(s, _written_corpus(s, d))))


def _encoded(s: SparkSession, d: str) -> DataFrame:
    """Document texts as bytes: UTF-8 with and without byte order mark, Latin-1, UTF-16; each eleventh unreadable.

    The last letter of the Latin-1 texts fits none of the encodings tried before.
    """
    kind = F.col("doc_id") % 4
    text = F.col("text")
    latin = F.concat(F.regexp_replace(text, r"[^\x{00}-\x{FF}]", "?"), F.lit("ÿ"))
    content = (
        F.when(F.col("doc_id") % 11 == 10, F.lit(None).cast("binary"))
        .when(kind == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8")))
        .when(kind == 1, F.encode(latin, "ISO-8859-1"))
        .when(kind == 2, F.encode(text, "UTF-16")).otherwise(F.encode(text, "UTF-8"))
    )
    return ad.table(s, d, "documents").select(
        F.col("doc_id").alias("media_id"), F.when(F.col("doc_id") % 3 == 0, "vtt").otherwise("srt").alias("ext"), content.alias("content")
    )


@query("decode_corpus")
def _(s, d):
    return files.decode(_encoded(s, d)).select("media_id", "has_bom", "encoding", F.length("text").alias("n_chars"))


@query("parse_srt")
def _(s, d):
    return srt.parse(ad.srt_files(s, d))


@query("parse_vtt")
def _(s, d):
    return vtt.parse(ad.vtt_files(s, d))


@query("parse_ass")
def _(s, d):
    return ass.parse(ad.ass_files(s, d))


@query("parse_ass_full")
def _(s, d):
    return ass.parse_full(ad.ass_files(s, d))


@query("srt_rejects")
def _(s, d):
    return srt.rejects(ad.srt_files(s, d))


@query("ass_styles")
def _(s, d):
    return ass.styles(ad.ass_files(s, d)).drop("values")


@query("script_info")
def _(s, d):
    return ass.script_info(ad.ass_files(s, d))


@query("render_srt")
def _(s, d):
    return srt.render(ad.styled(s, d))


@query("render_vtt")
def _(s, d):
    return vtt.render(cues_a(s, d))


@query("render_ass")
def _(s, d):
    """Every third cue has a raw text, every fourth media a header of its own."""
    cues = ad.styled(s, d).withColumn("raw", F.when(F.col("cue_idx") % 3 == 0, F.concat(F.lit("{\\an2}"), "text")))
    header = cues.where(F.col("media_id") % 4 == 0).select("media_id", F.concat(F.lit("[Script Info] "), F.col("media_id").cast("string")).alias("block")).distinct()
    return ass.render(cues, header)


@query("format_dispatch")
def _(s, d):
    return files.parse_cues(ad.any_files(s, d)).groupBy("media_id", "format").agg(
        F.count("*").alias("n_cues"), F.sum("start_ms").alias("start_sum"), F.sum("end_ms").alias("end_sum"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query("validate_format")
def _(s, d):
    mixed = ad.any_files(s, d)
    raw = ad.file_names(s, d).select("media_id", "ext", "text")
    return mixed.select("media_id", "ext", "text", F.lit("rendered").alias("origin")).unionByName(
        raw.withColumn("origin", F.lit("prose"))
    ).select("media_id", "origin", "ext", files.is_valid_format(F.col("ext"), F.col("text")).alias("valid"))


@query("reencode_report")
def _(s, d):
    return files.job_report(files.reencode(_encoded(s, d)), "encoding")


@query("job_report")
def _(s, d):
    log = ad.tracks(s, d).select(
        "media_id", "codec",
        F.when(F.col("is_forced"), "failed").when(F.col("is_default"), "converted").otherwise("unchanged").alias("status"),
    )
    return files.job_report(log, "codec")


def _manifests(s: SparkSession, d: str) -> DataFrame:
    """Probe manifests as JSON, with tag keys in mixed case."""
    one = F.to_json(F.struct(
        (F.col("rel_index") + 2).alias("index"), F.col("codec").alias("codec_name"), F.lit("subtitle").alias("codec_type"),
        F.create_map(
            F.when(F.col("rel_index") % 2 == 0, "LANGUAGE").otherwise("language"), F.col("language"),
            F.lit("Title"), F.col("title"),
        ).alias("tags"),
        F.create_map(
            F.lit("default"), F.col("is_default").cast("int"), F.lit("forced"), F.col("is_forced").cast("int")
        ).alias("disposition"),
    ))
    streams = ad.tracks(s, d).select("media_id", "rel_index", one.alias("j")).groupBy("media_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_index", "j"))), lambda x: x["j"]), ",").alias("j")
    )
    return streams.select("media_id", F.concat(F.lit('{"streams":['), "j", F.lit("]}")).alias("manifest"))


@query("tracks_from_manifest")
def _(s, d):
    return manifest.tracks(_manifests(s, d)).withColumn(
        "label", manifest.track_label(F.col("rel_index"), F.col("language"), F.col("title"), F.col("codec"))
    ).withColumn(
        "shown", manifest.track_text(
            F.col("track_id"), F.col("language"), F.col("title"), F.col("codec"), F.col("is_default"), F.col("is_forced")
        )
    )


def _packets(s: SparkSession, d: str) -> DataFrame:
    """Packet manifests of track a, printed inside the document row; every packet twice."""
    stamp = "format_string('{\"pts_time\":\"%d.%03d000\"}', (1000 + 4000L * i + 100 * (length(x) % 10)) div 1000, (1000 + 4000L * i + 100 * (length(x) % 10)) % 1000)"
    return ad.lines(s, d).select("media_id", F.expr(f"array_join(transform(ls, (x, i) -> {stamp}), ',')").alias("p")).select(
        "media_id", F.concat(F.lit('{"packets":['), "p", F.lit(","), "p", F.lit(',{"pts_time":"N/A"},{}]}')).alias("manifest")
    )


@query("packet_times")
def _(s, d):
    return manifest.packet_times(_packets(s, d))


@query("first_k_starts")
def _(s, d):
    return srt.first_starts(ad.srt_files(s, d))


# ---- time functions ---------------------------------------------------------

@query("time_parse")
def _(s, d):
    t, e = F.col("start_ms"), F.col("end_ms")
    return ad.track_a(s, d).select(
        "media_id", "cue_idx", tc.time_to_ms(tc.ms_to_time(t, "srt"), "srt").alias("srt_ms"),
        tc.time_to_ms(F.translate(tc.ms_to_time(e, "srt"), ",", "."), "srt").alias("dot_ms"),
        tc.time_to_ms(tc.ms_to_time(t + 7, "ass"), "ass").alias("ass_ms"),
        tc.time_to_ms(F.regexp_replace(tc.ms_to_time(e, "vtt"), "^00:", ""), "vtt").alias("vtt_ms"),
        tc.time_to_ms(F.col("txt"), "srt").alias("bad_ms"),
    )


@query("time_format")
def _(s, d):
    t = F.col("start_ms") * 37 - 50_000
    return ad.track_a(s, d).select(
        "media_id", "cue_idx", tc.ms_to_time(t, "srt").alias("srt"), tc.ms_to_time(t, "ass").alias("ass"),
        tc.ms_to_time(t, "vtt").alias("vtt"), tc.time_range(F.col("start_ms"), F.col("end_ms")).alias("shown"),
    )


@query("duration_format")
def _(s, d):
    return ad.track_a(s, d).select("media_id", "cue_idx", tc.format_duration(F.col("end_ms") * 11 + F.col("cue_idx")).alias("shown"))


@query("time_shift")
def _(s, d):
    text = tc.ms_to_time(F.col("start_ms"))
    return ad.track_a(s, d).select(
        "media_id", "cue_idx", tc.shift_time(text, F.lit(-30_250)).alias("earlier"), tc.shift_time(text, F.lit(4_007)).alias("later")
    )


@query("offset_parse")
def _(s, d):
    ms = F.col("start_ms") - 20_000
    kind = F.col("cue_idx") % 5
    seconds = F.format_string("%s%d.%03d", F.when(ms < 0, "-").otherwise(""), F.floor(F.abs(ms) / 1000), F.abs(ms) % 1000)
    literal = (
        F.when(kind == 0, F.concat(ms.cast("string"), F.lit("ms"))).when(kind == 1, F.concat(seconds, F.lit("s")))
        .when(kind == 2, F.concat(F.when(ms < 0, "-").otherwise(""), tc.ms_to_time(F.abs(ms))))
        .when(kind == 3, ms.cast("string")).otherwise(seconds)
    )
    return ad.track_a(s, d).select("media_id", "cue_idx", tc.parse_offset(literal).alias("offset_ms"))


@query("ass_time")
def _(s, d):
    t = tc.ms_to_time(F.col("start_ms"), "ass")
    return ad.track_a(s, d).select(
        "media_id", "cue_idx", tc.ass_time_to_srt(t).alias("full"), tc.ass_time_to_srt(F.regexp_replace(t, r"\d$", "")).alias("tenths"),
        tc.ass_time_to_srt(F.regexp_replace(t, r"\..*$", "")).alias("whole"), tc.ass_time_to_srt(F.lit("1:2")).alias("bad"),
    )


# ---- text, script, language functions ----------------------------------------

def _styled_text(s: SparkSession, d: str, **cols: Column) -> DataFrame:
    return ad.styled(s, d).select("media_id", "cue_idx", *[c.alias(n) for n, c in cols.items()])


@query("clean_text")
def _(s, d):
    t = F.col("text")
    return _styled_text(s, d, plain=tx.clean_text(t), bare=tx.clean_text(t, True))


@query("clean_srt")
def _(s, d):
    return _styled_text(s, d, cleaned=tx.clean_srt(F.col("text")))


@query("clean_ass")
def _(s, d):
    t = F.col("text")
    return _styled_text(s, d, cleaned=tx.clean_ass(t), with_effects=tx.clean_ass(t, False))


@query("norm_text")
def _(s, d):
    return _styled_text(s, d, norm=tx.norm_text(F.col("text")))


@query("strip_fmt")
def _(s, d):
    t = F.col("text")
    return _styled_text(s, d, bare=tx.strip_formatting(t), no_html=tx.strip_html(t))


@query("page_text")
def _(s, d):
    return ad.table(s, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("bare"))


@query("display_text")
def _(s, d):
    t = F.col("text")
    return _styled_text(s, d, shown=tx.display_text(t), narrow=tx.display_text(t, 35))


@query("text_sim2")
def _(s, d):
    a = cues_a(s, d).select("media_id", "cue_idx", F.col("text").alias("_a"))
    b = cues_same(s, d).select("media_id", "cue_idx", F.col("text").alias("_b"))
    return a.join(b, ["media_id", "cue_idx"]).select("media_id", "cue_idx", r6(sim.text_sim2(F.col("_a"), F.col("_b"))).alias("similarity"))


@query("combine_texts")
def _(s, d):
    a = cues_a(s, d).select("media_id", "cue_idx", F.when(F.length("text") > 6, F.col("text")).otherwise("").alias("_a"))
    b = cues_zh(s, d).select("media_id", "cue_idx", F.col("text").alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    return a.join(b, ["media_id", "cue_idx"], "left").select(
        "media_id", "cue_idx", tx.combine_texts(x, y).alias("first_top"), tx.combine_texts(x, y, "second").alias("second_top")
    )


@query("cjk_first")
def _(s, d):
    return _styled_text(s, d, ordered=tx.cjk_first(F.col("text")))


@query("eol_norm")
def _(s, d):
    text = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\r"), "\n", "\r\n")
    return ad.table(s, d, "documents").select(F.col("doc_id").alias("media_id"), tx.eol_norm(text).alias("text"))


@query("has_cjk")
def _(s, d):
    t = F.col("text")
    return _styled_text(
        s, d, font=tx.has_cjk_font(t), chinese=tx.has_cjk_chinese(t), style_sheet=tx.has_cjk_style(t), line=tx.has_cjk_line(t)
    )


@query("line_class")
def _(s, d):
    return ad.styled(s, d).select(
        "media_id", "cue_idx", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).select("media_id", "cue_idx", "line_no", tx.line_class(F.col("line")).alias("class"))


@query("dialogue_style")
def _(s, d):
    return ad.styled(s, d).groupBy("style", tx.is_dialogue_style(F.col("style")).alias("dialogue")).agg(F.count("*").alias("n_cues"))


@query("detect_lang")
def _(s, d):
    docs = ad.table(s, d, "documents").select(F.col("doc_id").alias("media_id"), F.lit(-1).alias("cue_idx"), lg.detect_lang(F.col("text")).alias("lang"))
    return docs.unionByName(ad.styled(s, d).select("media_id", "cue_idx", lg.detect_lang(F.col("text")).alias("lang")))


@query("detect_lang_legacy")
def _(s, d):
    return _styled_text(s, d, lang=lg.detect_lang_legacy(F.col("text")))


@query("lang_from_name")
def _(s, d):
    name = F.concat_ws(".", "stem", "ext")
    pages = ad.table(s, d, "pages").select(F.col("page_id").alias("media_id"), F.col("url").alias("name"))
    return ad.file_names(s, d).select("media_id", name.alias("name")).unionByName(pages).select(
        "media_id", "name", lg.lang_from_name(F.col("name")).alias("lang")
    )


@query("norm_lang")
def _(s, d):
    return ad.tracks(s, d).select(
        "media_id", "rel_index", lg.norm_lang(F.col("language")).alias("lang"), lg.language_name(F.col("language")).alias("name")
    )


@query("lang_semi")
def _(s, d):
    codes = s.createDataFrame(lg.lang_codes_rows(), "code string, family string")
    # The code list is the fixed table above (38 rows), hence the broadcast.
    return ad.tracks(s, d).withColumn("code", F.lower("language")).join(
        F.broadcast(codes.where(F.col("family").isin("zh", "en"))), "code", "left_semi"
    ).select("media_id", "rel_index", "language")


@query("detect_lang_counts")
def _(s, d):
    docs = ad.table(s, d, "documents").select(
        F.col("doc_id").alias("media_id"), F.col("text"), F.translate(F.lower("text"), ad.LATIN, ad.HANZI).alias("zh")
    )
    return docs.select(
        "media_id", lg.detect_lang_counts(F.col("text")).alias("plain"), lg.detect_lang_counts(F.col("zh")).alias("hanzi"),
        lg.detect_lang_counts(F.translate("zh", "的一是", "かなカ")).alias("kana"),
        lg.detect_lang_counts(F.translate("zh", "的一是在不", "가나다라마")).alias("hangul"),
    )


def _languages(s: SparkSession, d: str) -> DataFrame:
    return ad.tracks(s, d).where("rel_index = 0").select("media_id", "language")


@query("track_is_lang")
def _(s, d):
    return sm.track_is_lang(cues_a(s, d), _languages(s, d))


@query("resolve_lang")
def _(s, d):
    name = F.concat_ws(".", "stem", "ext")
    return ad.file_names(s, d).select("media_id", lg.resolve_lang(name, F.col("text")).alias("lang"))


@query("bilingual_name")
def _(s, d):
    lang1 = F.when(F.col("media_id") % 3 == 0, "unknown").otherwise(F.col("lang"))
    other = F.when(F.col("media_id") % 2 == 0, "en").otherwise("zh")
    return ad.file_names(s, d).select("media_id", lg.bilingual_name(F.col("stem"), lang1, other, F.lit("srt")).alias("name"))


@query("base_name")
def _(s, d):
    return ad.file_names(s, d).select(
        "media_id", lg.base_name(F.col("stem")).alias("pair_base"), lg.split_base_name(F.col("stem")).alias("split_base")
    )


@query("keywords")
def _(s, d):
    return named_a(s, d).select("media_id", "cue_idx", F.array_join(kw.keywords(F.col("text")), "|").alias("keywords"))


@query("numbers")
def _(s, d):
    return cues_a(s, d).select("media_id", "cue_idx", F.array_join(kw.numbers(F.col("text")), "|").alias("numbers"))


# ---- similarity functions ------------------------------------------------------

def _near_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts of cue pairs whose starts are at most 500 ms apart."""
    a = cues_a(s, d).select("media_id", F.col("cue_idx").alias("a_idx"), F.col("text").alias("_a"))
    b = cues_same(s, d).select("media_id", F.col("cue_idx").alias("b_idx"), F.col("text").alias("_b"))
    pairs = jn.time_candidates(cues_a(s, d), cues_same(s, d)).drop("delta_ms")
    return pairs.join(a, ["media_id", "a_idx"]).join(b, ["media_id", "b_idx"])


#: Scorers of one's own: usual scores at other weights, and one more with a bound by lengths.
OWN_SCORERS = (
    *sim.scorers({"edit": 0.3, "jaccard": 0.2, "length": 0.2}),
    sim.Scorer("starts", 0.3, lambda p, q: (F.substring(p["text"], 1, 4) == F.substring(q["text"], 1, 4)).cast("double"),
               lambda p, q: F.when(F.least(F.length(p["text"]), F.lit(4)) == F.least(F.length(q["text"]), F.lit(4)), 1.0).otherwise(0.0)),
)


@query("similarity_own")
def _(s, d):
    pairs = sj.profiled(sj.profiled(_near_texts(s, d), "_a", "_p"), "_b", "_q")
    found = sj.prune_and_score(pairs, 0.551237, scorers=OWN_SCORERS)
    return found.select("media_id", "a_idx", "b_idx", r6("similarity").alias("similarity"))


@query("similarity_scores")
def _(s, d):
    pairs = _near_texts(s, d)
    names = ("jaccard", "cosine", "edit", "length", "common")
    scored = sj.pair_scores(sj.profiled(sj.profiled(pairs, "_a", "_p"), "_b", "_q"), "_p", "_q", names)
    cols = {n: F.col(f"s_{n}") for n in names}
    return scored.select(
        "media_id", "a_idx", "b_idx", *[r6(c).alias(n) for n, c in cols.items()],
        r6(sim.weighted(cols, sim.WEIGHTS)).alias("weighted"), r6(sim.variance_penalty(list(cols.values())) + 1e-12).alias("variance"),
        r6(sim.position_penalty(F.col("a_idx"), F.col("b_idx"), F.lit(40), F.lit(30))).alias("position"),
    )


@query("similarity_combined")
def _(s, d):
    pairs = sj.profiled(sj.profiled(_near_texts(s, d), "_a", "_p"), "_b", "_q")
    return sj.pair_scores(pairs, "_p", "_q").select("media_id", "a_idx", "b_idx", r6(sj.total_score()).alias("similarity"))


# ---- filters ---------------------------------------------------------------------

@query("clean_filter")
def _(s, d):
    return srt.keep_printable(ad.styled(s, d)).select("media_id", "cue_idx", "start_ms", "end_ms", "text")


@query("dedup_cues")
def _(s, d):
    doubled = cues_a(s, d).unionByName(cues_a(s, d).withColumn("cue_idx", F.col("cue_idx") + 100_000).withColumn("end_ms", F.col("end_ms") + 4))
    return srt.dedup(doubled)


@query("text_tracks")
def _(s, d):
    return tk.text_tracks(ad.tracks(s, d)).select("media_id", "rel_index", "codec")


@query("first_dialogue")
def _(s, d):
    a = cues_a(s, d).withColumn("text", F.concat("text", F.lit(" what?")))
    return an.first_dialogue(a, cues_zh(s, d).withColumn("text", F.concat("text", F.lit("？"))))


def _external(s: SparkSession, d: str) -> DataFrame:
    return ad.table(s, d, "documents").select(
        F.col("doc_id").alias("media_id"), (F.col("lang") == "fr").alias("has_chinese"), (F.col("lang") == "en").alias("has_english")
    )


@query("mixed_scenario")
def _(s, d):
    return tk.mixed_scenario(ad.tracks(s, d), _external(s, d))


# ---- joins ---------------------------------------------------------------------

@query("overlap_candidates")
def _(s, d):
    return jn.overlap_candidates(cues_a(s, d), cues_same(s, d)).withColumn("score", r6("score"))


@query("overlap_best_naive")
def _(s, d):
    return jn.overlap_best(cues_a(s, d), cues_same(s, d)).withColumn("score", r6("score"))


@query("time_candidates")
def _(s, d):
    return jn.time_candidates(cues_a(s, d), cues_same(s, d))


@query("time_align")
def _(s, d):
    return mg.time_align(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence"))


@query("match_serial")
def _(s, d):
    return mt.match_serial(mg.comprehensive_edges(cues_a(s, d), cues_same(s, d)))


@query("match_greedy")
def _(s, d):
    pairs = jn.overlap_candidates(cues_a(s, d), cues_same(s, d))
    edges = pairs.select("media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"), F.col("overlap_ms").alias("weight"))
    return mt.match_greedy(edges)


@query("merge_comprehensive")
def _(s, d):
    return mg.merge_comprehensive(cues_a(s, d), cues_zh(s, d)).drop("style", "raw")


@query("merged_order")
def _(s, d):
    return mg.merged_order(mg.merge_comprehensive(cues_a(s, d), cues_zh(s, d))).select("media_id", "seq", "start_ms", "idx1", "idx2")


@query("merge_preserved")
def _(s, d):
    return mg.merge_preserved(cues_a(s, d), cues_zh(s, d), ad.media_roles(s, d)).drop("style", "raw")


@query("merge_keep_foreign")
def _(s, d):
    return mg.merge_keep_foreign(cues_a(s, d), cues_zh(s, d)).drop("style", "raw")


@query("merge_stats")
def _(s, d):
    merged = mg.merge_comprehensive(cues_a(s, d), cues_zh(s, d))
    return sm.merge_stats(merged).withColumn("bilingual_share", r6("bilingual_share"))


def _joined_sigs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("src_sig", F.array_join("src_sig", "|")).withColumn("ref_sig", F.array_join("ref_sig", "|"))


@query("keyword_pairs")
def _(s, d):
    return _joined_sigs(an.keyword_pairs(named_a(s, d), named_b(s, d)))


@query("number_pairs")
def _(s, d):
    return _joined_sigs(an.number_pairs(cues_a(s, d), cues_same(s, d)))


def _flat_anchors(anchors: DataFrame) -> DataFrame:
    return anchors.withColumn("keywords", F.array_join("keywords", "|")).withColumn("confidence", r6("confidence"))


@query("keyword_anchors")
def _(s, d):
    return _flat_anchors(an.keyword_anchors(named_a(s, d), named_b(s, d)))


@query("number_anchors")
def _(s, d):
    return _flat_anchors(an.number_anchors(cues_a(s, d), cues_same(s, d)))


@query("similarity_sample")
def _(s, d):
    return sj.similarity_sample(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence"))


@query("similarity_align")
def _(s, d):
    return sj.similarity_align(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence")).withColumn("similarity", r6("similarity"))


@query("anchors_all")
def _(s, d):
    a, b = named_a(s, d), named_b(s, d)
    return _flat_anchors(an.anchors_all(a, b, sm.same_language(a, b)))


@query("auto_align")
def _(s, d):
    a, b = cues_a(s, d), cues_same(s, d)
    return an.auto_align(a, b, sm.same_language(a, b, sampled=False)).withColumn("confidence", r6("confidence"))


@query("robust_offset")
def _(s, d):
    zipped = cues_a(s, d).select("media_id", "cue_idx", F.col("start_ms").alias("_a")).join(
        cues_same(s, d).select("media_id", "cue_idx", F.col("start_ms").alias("_b")), ["media_id", "cue_idx"]
    )
    anchors = zipped.select("media_id", (F.col("_b") - F.col("_a")).alias("time_offset_ms"))
    return sm.robust_offset(anchors).withColumn("confidence", r6("confidence"))


def _packet_starts(s: SparkSession, d: str) -> DataFrame:
    return manifest.packet_times(_packets(s, d), sy.PACKET_WINDOW_MS)


def _ext_starts(s: SparkSession, d: str, k: int = 15) -> DataFrame:
    return ad.track_b(s, d).where(F.col("cue_idx") < k).select("media_id", F.col("cue_idx").alias("ext_i"), F.col("start_ms").alias("ext_ms"))


@query("offset_vote")
def _(s, d):
    return sy.offset_vote(_ext_starts(s, d), _packet_starts(s, d))


@query("anchor_first")
def _(s, d):
    return jn.anchor_first(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence"))


@query("anchor_scan")
def _(s, d):
    return jn.anchor_scan(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence"))


@query("anchor_scan60")
def _(s, d):
    return jn.anchor_scan(cues_a(s, d), cues_same(s, d), 30, 60_000, 0.3).withColumn("confidence", r6("confidence"))


@query("anchor_similarity")
def _(s, d):
    return sj.anchor_similarity(cues_a(s, d), cues_same(s, d)).withColumn("confidence", r6("confidence"))


@query("zip_diff")
def _(s, d):
    return sm.zip_diff(cues_a(s, d), cues_same(s, d))


@query("align_from_anchor")
def _(s, d):
    a, b = cues_a(s, d), cues_same(s, d)
    return jn.align_from_anchor(a, b, jn.anchor_scan(a, b)).withColumn("confidence", r6("confidence"))


def _translations(s: SparkSession, d: str) -> DataFrame:
    """The cross-language texts with their originals as translations."""
    b = ad.track_b(s, d)
    return b.groupBy(F.col("txt_zh").alias("text")).agg(F.min("txt_same").alias("translated"))


@query("anchor_translated")
def _(s, d):
    return sj.anchor_translated(cues_zh(s, d), cues_a(s, d), _translations(s, d)).withColumn("confidence", r6("confidence"))


@query("anchor_sampled")
def _(s, d):
    return sj.anchor_sampled(cues_zh(s, d), cues_a(s, d), _translations(s, d)).withColumn("confidence", r6("confidence"))


@query("anchor_quartiles")
def _(s, d):
    return sj.anchor_quartiles(cues_zh(s, d), cues_a(s, d), _translations(s, d)).withColumn("confidence", r6("confidence"))


@query("pair_files")
def _(s, d):
    names = ad.file_names(s, d)
    refs = names.select(F.concat("video_stem", F.lit(".en")).alias("stem")).withColumn("path", F.concat("stem", F.lit(".srt")))
    srcs = names.select("stem", F.concat_ws(".", "stem", "ext").alias("path"))
    return tk.pair_files(srcs, refs).drop("directory")


@query("pair_by_extension")
def _(s, d):
    names = ad.file_names(s, d)
    paths = names.select(F.concat("video_stem", F.lit(".en.srt")).alias("path")).unionByName(
        names.select(F.concat_ws(".", "stem", F.lit("srt")).alias("path"))
    )
    return tk.pair_by_extension(paths, ".fr.srt", ".en.srt")


def _videos(s: SparkSession, d: str) -> DataFrame:
    return ad.file_names(s, d).select("media_id", F.col("video_stem").alias("stem"))


@query("pair_prefix")
def _(s, d):
    subs = ad.file_names(s, d).select(F.concat_ws(".", "stem", "ext").alias("name"), "stem")
    return tk.pair_prefix(_videos(s, d), subs).drop("directory")


@query("pick_external")
def _(s, d):
    names = ad.file_names(s, d)
    subs = names.select("stem", "ext", "text").unionByName(names.select(F.col("video_stem").alias("stem"), F.lit("srt").alias("ext"), "text"))
    return tk.pick_external(_videos(s, d), subs, "english").drop("directory")


@query("external_subtitles")
def _(s, d):
    return tk.external_subtitles(_videos(s, d), ad.file_names(s, d).select("stem", "ext")).drop("directory")


def _fonts(s: SparkSession, d: str) -> DataFrame:
    """The region names serve as the fonts that are there."""
    return ad.table(s, d, "region").select(F.col("r_name").alias("fontname")).distinct()


@query("fix_fonts")
def _(s, d):
    docs = ad.ass_files(s, d)
    cjk = docs.select("media_id", tx.has_cjk_style(F.col("text")).alias("has_cjk"))
    return ass.fix_fonts(ass.styles(docs), cjk, _fonts(s, d))


@query("timeline_segments")
def _(s, d):
    return jn.timeline_segments(cues_a(s, d), cues_zh(s, d))


@query("merge_from_alignments")
def _(s, d):
    a, b = cues_a(s, d), cues_zh(s, d)
    return jn.merge_from_alignments(a, b, jn.overlap_best(a, b), sy.reference_track(a, b, ad.media_roles(s, d))).drop("style", "raw")


# ---- aggregates -------------------------------------------------------------------

@query("track_summary")
def _(s, d):
    return sm.track_summary(cues_a(s, d))


@query("conv_summary")
def _(s, d):
    turns = ad.conv_tracks(s, d)
    return turns.groupBy("media_id", "track").agg(
        F.count("*").alias("n_cues"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms")
    )


@query("timing_stats")
def _(s, d):
    out = sm.timing_stats(sm.zip_diff(cues_a(s, d), cues_same(s, d)))
    return out.withColumn("avg_ms", r6("avg_ms")).withColumn("core_ms", r6("core_ms"))


@query("sync_level")
def _(s, d):
    st = sm.timing_stats(sm.zip_diff(cues_a(s, d), cues_same(s, d)))
    return st.select("media_id", sm.sync_level(F.col("core_ms"), F.col("max_ms")).alias("level"))


@query("sync_ok")
def _(s, d):
    st = sm.timing_stats(sm.zip_diff(cues_a(s, d), cues_same(s, d)))
    return st.select("media_id", sm.sync_ok(F.col("core_ms"), F.col("max_ms")).alias("ok"), sm.sync_ok(F.col("core_ms"), F.col("max_ms"), 500).alias("ok_half"))


@query("misaligned")
def _(s, d):
    return sm.misaligned(cues_a(s, d), cues_same(s, d), ad.media_roles(s, d)).withColumn("avg_ms", r6("avg_ms"))


@query("forced_track")
def _(s, d):
    # Track a with every 15 cues joined: far fewer cues, all of the text.
    key = ["media_id", F.call_function("div", F.col("cue_idx"), F.lit(15)).alias("cue_idx")]
    few = cues_a(s, d).groupBy(*key).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(F.length("text")).alias("n_chars"))
    return sm.forced_track(few, cues_same(s, d))


@query("preservation")
def _(s, d):
    out = sm.preservation(cues_a(s, d), mg.merge_comprehensive(cues_a(s, d), cues_zh(s, d)))
    return out.withColumn("ratio", r6("ratio"))


@query("preservation_exact")
def _(s, d):
    out = sm.preservation(cues_a(s, d), tm.apply_offset(cues_a(s, d), F.when(F.col("media_id") % 2 == 0, 10).otherwise(0)), exact=True)
    return out.withColumn("ratio", r6("ratio"))


@query("track_score")
def _(s, d):
    sc = tk.track_scores(ad.tracks(s, d))
    return sc.select(
        "media_id", "rel_index", "event_count", r6("event_score").alias("event_score"), "title_score", "content_score",
        r6("total_score").alias("total_score"), "is_candidate", F.array_join("reasoning", "; ").alias("reasoning"),
    )


@query("track_rank")
def _(s, d):
    return tk.track_rank(tk.track_scores(ad.tracks(s, d))).withColumn("total_score", r6("total_score"))


@query("event_estimate")
def _(s, d):
    return ad.tracks(s, d).select("media_id", "rel_index", tk.event_estimate().alias("estimate"))


@query("event_estimate_sample")
def _(s, d):
    return tk.event_estimate_from_sample(cues_a(s, d))


@query("content_score")
def _(s, d):
    return sm.content_score(ad.styled(s, d)).withColumn("content_score", r6("content_score"))


@query("is_bilingual")
def _(s, d):
    return sm.is_bilingual(ad.styled(s, d))


@query("same_language")
def _(s, d):
    even = sm.same_language(cues_a(s, d), cues_zh(s, d)).withColumn("rule", F.lit("even"))
    first = sm.same_language(cues_a(s, d), cues_same(s, d), sampled=False).withColumn("rule", F.lit("first"))
    whole = sm.same_language(cues_a(s, d), cues_same(s, d), k=None).withColumn("rule", F.lit("all"))
    return even.unionByName(first).unionByName(whole)


@query("any_cjk")
def _(s, d):
    return ass.any_cjk(ad.styled(s, d))


@query("font_size")
def _(s, d):
    return mg.bilingual_style(ass.script_info(ad.ass_files(s, d)))


# ---- windows, order, set operations ------------------------------------------------

@query("renumber")
def _(s, d):
    shuffled = cues_a(s, d).withColumn("start_ms", (F.col("start_ms") * 7919) % 600_011)
    return tm.renumber(shuffled).select("media_id", "cue_idx", "start_ms", "seq")


@query("anti_jitter")
def _(s, d):
    # Cut every cue into two halves with the same text: most join again.
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("bigint")
    base = cues_a(s, d)
    left = base.withColumn("cue_idx", F.col("cue_idx") * 2).withColumn("end_ms", mid)
    right = base.withColumn("start_ms", mid + F.when(F.col("cue_idx") % 3 == 0, 150).otherwise(50)).withColumn("cue_idx", F.col("cue_idx") * 2 + 1)
    return tm.anti_jitter(left.unionByName(right))


@query("even_sample")
def _(s, d):
    return tm.even_sample(cues_a(s, d), 20).select("media_id", "cue_idx")


@query("rel_pos")
def _(s, d):
    return tm.rel_pos(cues_a(s, d)).select("media_id", "cue_idx", r6("pos").alias("pos"))


@query("preview")
def _(s, d):
    return tm.preview(cues_a(s, d)).select(
        "media_id", "cue_idx", tc.time_range(F.col("start_ms"), F.col("end_ms")).alias("time_range"), "text"
    )


# ---- jobs ------------------------------------------------------------------------

@query("shift")
def _(s, d):
    return tm.shift(cues_a(s, d), F.expr("(media_id % 7 - 3) * 2500L")).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("shift_by_media")
def _(s, d):
    offsets = ad.media_roles(s, d).where("source1 = 'embedded'").select("media_id", F.lit(-2_470).alias("offset_ms"))
    return tm.shift_by_media(cues_a(s, d), offsets).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("shift_first_to")
def _(s, d):
    return tm.shift_first_to(cues_same(s, d), 50_983).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("apply_offset")
def _(s, d):
    return tm.apply_offset(cues_a(s, d), F.expr("(media_id % 7 - 3) * 2500L")).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("realign")
def _(s, d):
    a, b = cues_same(s, d), cues_a(s, d)
    anchors = jn.anchor_scan(a, b).select("media_id", F.col("a_idx").alias("src_idx"), F.col("b_idx").alias("ref_idx"))
    return tm.realign(a, b, anchors).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("split_bilingual")
def _(s, d):
    return sp.split_bilingual(ad.styled(s, d), strip_formatting=True)


@query("reference_track")
def _(s, d):
    return sy.reference_track(cues_a(s, d), cues_zh(s, d), ad.media_roles(s, d), "chinese")


@query("merge_strategy")
def _(s, d):
    return mg.merge_strategy(cues_a(s, d), cues_zh(s, d), ad.media_roles(s, d), True)


@query("merge")
def _(s, d):
    return mg.merge(cues_a(s, d), cues_zh(s, d), ad.media_roles(s, d)).drop("style", "raw")


@query("merge_plain")
def _(s, d):
    return mg.merge(cues_a(s, d), cues_zh(s, d), ad.media_roles(s, d), align=False).drop("style", "raw")


@query("merge_ass")
def _(s, d):
    zh = cues_zh(s, d).withColumn("style", F.when(F.col("cue_idx") % 9 == 0, "Staff").otherwise("ZH")).withColumn("raw", F.col("text"))
    return mg.merge_ass(zh, ad.styled(s, d), ad.media_roles(s, d))


@query("semantic_anchor")
def _(s, d):
    return an.semantic_anchor(named_a(s, d), named_b(s, d)).withColumn("confidence", r6("confidence"))


@query("merge_mixed")
def _(s, d):
    """Mixed sources are realigned; the other media keep their timing."""
    roles, cols = ad.media_roles(s, d), ["media_id", "idx1", "idx2", "start_ms", "end_ms", "text", "kind"]
    mixed, rest = (roles.where(f"{test}(source1 <> source2)") for test in ("", "not "))

    def of(cues, some):
        return cues.join(some.select("media_id"), "media_id", "left_semi")

    a, b = named_a(s, d), named_b(s, d)
    return mg.merge_mixed(of(a, mixed), of(b, mixed), mixed).select(*cols).unionByName(
        mg.merge_preserved(of(a, rest), of(b, rest), rest).select(*cols)
    )


@query("merge_enhanced")
def _(s, d):
    return mg.merge_enhanced(cues_a(s, d), cues_same(s, d), ad.media_roles(s, d)).drop("style", "raw")


@query("global_sync")
def _(s, d):
    return sy.global_sync(cues_a(s, d), cues_same(s, d), ad.media_roles(s, d)).select("media_id", "track", "cue_idx", "start_ms", "end_ms")


@query("batch_align")
def _(s, d):
    return sy.batch_align(cues_same(s, d), cues_a(s, d)).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("manual_sync")
def _(s, d):
    manual = ad.media_roles(s, d).select(
        "media_id", F.expr("cast(media_id % 3 as int)").alias("a_idx"), F.expr("cast(media_id % 2 as int)").alias("b_idx"),
        F.expr("cast(media_id % 2 + 1 as int)").alias("reference"),
    )
    return sy.manual_sync(cues_a(s, d), cues_same(s, d), manual).select("media_id", "track", "cue_idx", "start_ms", "end_ms")


@query("pick_track")
def _(s, d):
    return tk.pick_track(ad.tracks(s, d), ["en", "eng", "english"], remap="jpn").select("media_id", "track_id")


@query("pick_dialogue")
def _(s, d):
    return tk.pick_dialogue(ad.tracks(s, d)).select("media_id", "track_id", r6("total_score").alias("total_score"))


def _sync_choice(s: SparkSession, d: str) -> DataFrame:
    subs = ad.file_names(s, d).select("media_id", F.concat_ws(".", "stem", "ext").alias("name"), "text")
    return tk.pick_sync_track(ad.tracks(s, d), subs)


@query("pick_sync_track")
def _(s, d):
    return _sync_choice(s, d).select("media_id", "rel_index", "subtitle_lang", "label")


@query("sync_report")
def _(s, d):
    return sy.sync_report(_ext_starts(s, d), _packet_starts(s, d), _sync_choice(s, d))


@query("sync_cues")
def _(s, d):
    report = sy.sync_report(_ext_starts(s, d), _packet_starts(s, d), _sync_choice(s, d))
    return sy.sync_cues(cues_same(s, d), report).select("media_id", "cue_idx", "start_ms", "end_ms")


@query("input_roles")
def _(s, d):
    names = ad.file_names(s, d)
    name = F.concat_ws(".", "stem", "ext")
    first = names.select("media_id", F.lit(0).alias("input_no"), name.alias("name"), tk.file_language(name, F.col("text")).alias("lang"))
    second_name = F.concat("video_stem", F.when(F.col("media_id") % 2 == 0, ".zh.srt").otherwise(".srt"))
    second = names.select("media_id", F.lit(1).alias("input_no"), second_name.alias("name"), tk.file_language(second_name, F.col("text")).alias("lang"))
    return sp.input_roles(first.unionByName(second))


@query("ass_to_srt")
def _(s, d):
    return ass.to_srt(ad.ass_files(s, d))


# ---- streaming --------------------------------------------------------------------

def _feed(s: SparkSession, d: str, stream: bool = True) -> DataFrame:
    """Events as a caption feed: user is the media, event type the text."""
    schema = ad.table(s, d, "events").schema
    src = (
        s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        if stream else ad.table(s, d, "events")
    )
    ts = F.col("ts").cast("timestamp")
    start = F.unix_millis(ts)
    return src.select(
        F.col("user_id").alias("media_id"), ts.alias("ts"), start.alias("start_ms"),
        (start + (F.col("value") * 10).cast("bigint")).alias("end_ms"), F.col("event_type").alias("text"), "value",
    )


@query("stream_ingest")
def _(s, d):
    base, path = scratch_path(s, "ingest"), _written_corpus(s, d)
    for _ in range(2):  # the second run finds nothing new
        feeds.ingest(s, path, f"{base}/checkpoint", f"{base}/cues", bundled=True)
    schema = "path string, format string, cue_idx int, start_ms bigint, end_ms bigint, text string"
    return s.read.schema(schema).parquet(f"{base}/cues")


@query("stream_dedup")
def _(s, d):
    # Every row arrives twice.
    twice = _feed(s, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = feeds.run_available(feeds.dedup, twice.drop("copy", "value"))
    return out.select("media_id", "start_ms", "end_ms", "text")


@query("stream_time_join")
def _(s, d):
    """Every event that isn't a purchase or an error, with those near it or alone."""
    late = "text in ('purchase', 'error')"
    out = feeds.run_available(lambda a, b: feeds.time_join(a, b, 600_000), _feed(s, d).where(f"not {late}"), _feed(s, d).where(late))
    return out.select("media_id", F.unix_millis("ts_a").alias("ms_a"), "text_a", F.unix_millis("ts_b").alias("ms_b"), "text_b")


@query("stream_drift")
def _(s, d):
    diffs = _feed(s, d).select("media_id", "ts", (F.col("value") * 10).cast("bigint").alias("diff_ms"))
    out = feeds.run_available(lambda x: feeds.drift(x, "1 hour"), diffs)
    return out.select("media_id", F.unix_millis("window_start").alias("window_ms"), "n", "max_ms", "median_ms")


@query("stream_sessions")
def _(s, d):
    out = feeds.run_available(lambda x: feeds.bursts(x, "2 hours"), _feed(s, d))
    return out.select("media_id", F.unix_millis("first_ts").alias("first_ms"), F.unix_millis("last_ts").alias("last_ms"), "n_cues")
