"""The SQL twins of the registered queries, for DuckDB on the same tables.

They are written from the rules, not from the Spark code: parsers are checked
against the cues their files were printed from, sequential matching is a
recursive walk over the sources.
"""

from __future__ import annotations

from cueweave import adapters as ad
from cueweave.functions import keywords as kw
from cueweave.functions import language as lg
from cueweave.functions import similarity as sim
from cueweave.functions import text as tx
from cueweave.operators import tracks as tk

ORACLE: dict[str, str] = {}


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{tx.WS}+|{tx.WS}+$', '', 'g')"


def _time(ms: str, fmt: str = "srt") -> str:
    t = f"greatest({ms}, 0)"
    if fmt == "ass":
        return f"printf('%d:%02d:%02d.%02d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000 // 10)"
    mark = "," if fmt == "srt" else "."
    return f"printf('%02d:%02d:%02d{mark}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


_NL = "chr(10)"
_START = "CAST(1000 + 4000 * cue_idx + 100 * (length(txt) % 10) AS BIGINT)"
_END = f"CAST({_START} + 800 + 40 * least(length(txt), 80) AS BIGINT)"
_MOVE = "((media_id * 37) % 21 - 10) * 500 + ((media_id * 13 + cue_idx * 7) % 5 - 2) * 60"
_ZH = f"translate(lower(txt), '{ad.LATIN}', '{ad.HANZI}')"

LINES = f"""cue_lines AS (SELECT doc_id AS media_id, lang, source,
  list_filter(list_transform(string_split(replace(replace(replace(text, '. ', '.' || {_NL}), '? ', '?' || {_NL}),
    '! ', '!' || {_NL}), {_NL}), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents),
lines AS (SELECT media_id, lang, source, unnest(ls) AS txt, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS cue_idx FROM cue_lines),
track_a AS (SELECT media_id, lang, source, cue_idx, {_START} AS start_ms, {_END} AS end_ms, txt, txt AS text FROM lines)"""

TRACK_B = f"""track_b AS (SELECT media_id,
  CAST(row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) - 1 AS INTEGER) AS cue_idx,
  CAST(greatest(0, {_START} + {_MOVE}) AS BIGINT) AS start_ms, CAST(greatest(0, {_END} + {_MOVE}) AS BIGINT) AS end_ms,
  {_ZH} AS txt_zh, CASE WHEN cue_idx % 4 = 1 THEN replace(txt, 'e', 'a') ELSE txt END AS txt_same
  FROM lines WHERE length(txt) - length(replace(txt, ' ', '')) >= 2),
a AS (SELECT media_id, cue_idx, start_ms, end_ms, txt AS text FROM track_a),
same AS (SELECT media_id, cue_idx, start_ms, end_ms, txt_same AS text FROM track_b),
zh AS (SELECT media_id, cue_idx, start_ms, end_ms, txt_zh AS text FROM track_b)"""

STYLED = f"""styled AS (SELECT media_id, cue_idx, start_ms, end_ms,
  CASE WHEN cue_idx % 6 = 0 THEN '{{\\an8}}' || txt || '\\N' || {_ZH}
       WHEN cue_idx % 6 = 1 THEN '<i>' || txt || '</i>'
       WHEN cue_idx % 6 = 2 AND length(txt) < 20 THEN '{{\\p1}}m 0 0 l 10 10{{\\p0}}'
       WHEN cue_idx % 6 = 3 THEN txt || {_NL} || '  ' || {_ZH} || {_NL} || '12'
       WHEN cue_idx % 6 = 4 AND length(txt) < 12 THEN '{{\\fad(100,200)}}' ELSE txt END AS text,
  CASE WHEN length(txt) % 7 = 0 THEN 'OP-Karaoke' WHEN length(txt) % 7 = 1 THEN 'Signs' ELSE 'Default' END AS style
  FROM track_a)"""


def _pick(values, seed: str) -> str:
    return f"{_list(values)}[CAST(({seed}) % {len(values)} AS INTEGER) + 1]"


TRACKS = f"""tracks AS (SELECT media_id, rel_index, CAST(rel_index + 2 AS VARCHAR) AS track_id,
  {_pick(ad.CODECS, 'media_id + rel_index * 3')} AS codec, {_pick(ad.TAGS, 'media_id * 3 + rel_index * 5')} AS language,
  {_pick(ad.TITLES, 'media_id + rel_index * 7')} AS title, (media_id + rel_index) % 3 = 0 AS is_default,
  (media_id + rel_index) % 5 = 0 AS is_forced, CASE WHEN rel_index < 3 THEN 'embedded' ELSE 'external' END AS source_type,
  CAST((n_chars + rel_index * 70) % 400 AS INTEGER) AS event_count
  FROM (SELECT doc_id AS media_id, n_chars, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS rel_index FROM documents))"""

ROLES = """roles AS (SELECT doc_id AS media_id,
  CASE WHEN doc_id % 4 < 2 THEN 'embedded' ELSE 'external' END AS source1,
  CASE WHEN doc_id % 4 IN (0, 2) THEN 'embedded' ELSE 'external' END AS source2,
  CASE WHEN doc_id % 3 = 0 THEN 'english' ELSE 'chinese' END AS language1,
  CASE WHEN doc_id % 3 = 0 THEN 'chinese' ELSE 'english' END AS language2 FROM documents)"""

FILES = f"""files AS (SELECT doc_id AS media_id, lang, source, text, {_list(ad.EXTS)}[CAST(doc_id % 4 AS INTEGER) + 1] AS ext,
  'Movie.' || source || '.' || doc_id AS video_stem,
  'Movie.' || source || '.' || doc_id || '.' || CASE WHEN doc_id % 5 = 0 THEN lang || '-en' WHEN doc_id % 5 = 1 THEN upper(lang) ELSE lang END AS stem
  FROM documents)"""


def sql(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    head = ", ".join(ctes)
    ORACLE[name] = (f"WITH {'RECURSIVE ' if recursive else ''}{head} " if head else "") + body


def on_a(name: str, cols: str) -> None:
    sql(name, f"SELECT media_id, cue_idx, {cols} FROM track_a", LINES)


def on_styled(name: str, cols: str) -> None:
    sql(name, f"SELECT media_id, cue_idx, {cols} FROM styled", LINES, STYLED)


# ---- files ----------------------------------------------------------------------
on_a("scan_corpus", "'vtt' AS format, start_ms, end_ms, text")
sql("stream_ingest", "SELECT media_id || '.vtt' AS path, 'vtt' AS format, cue_idx, start_ms, end_ms, text FROM track_a", LINES)
_ENCODED = """enc AS (SELECT doc_id AS media_id, doc_id % 11 = 10 AS failed, doc_id % 3 = 0 AS vtt,
  CASE WHEN doc_id % 11 = 10 THEN NULL ELSE ['utf-8-sig', 'latin-1', 'utf-16', 'utf-8'][doc_id % 4 + 1] END AS encoding,
  CASE WHEN doc_id % 11 = 10 THEN NULL ELSE length(regexp_replace(text, '\r\n|\r', chr(10), 'g')) + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END END AS n_chars FROM documents)"""
sql("decode_corpus", "SELECT media_id, coalesce(encoding = 'utf-8-sig', false) AS has_bom, encoding, n_chars FROM enc", _ENCODED)
# No text has the time line that a valid SRT file needs; VTT files always pass.
sql("reencode_report", """SELECT encoding, status, count(*) AS n_files FROM (SELECT encoding,
  CASE WHEN failed THEN 'failed' WHEN encoding = 'utf-8' AND vtt THEN 'unchanged' ELSE 'modified' END AS status FROM enc) GROUP BY 1, 2""", _ENCODED)

# ---- parsers and sinks ---------------------------------------------------------
for _name in ("parse_srt", "parse_vtt"):
    on_a(_name, "start_ms, end_ms, text")

ASS_TEXT = f"CASE WHEN cue_idx % 4 = 1 THEN '{{\\i1}}' || txt || '{{\\i0}}\\N' || {_ZH} ELSE txt END"
ASS = f"""ass AS (SELECT media_id, cue_idx, start_ms, end_ms, {ASS_TEXT} AS raw,
  CASE WHEN cue_idx % 5 = 4 THEN 'Sign' ELSE 'Default' END AS style FROM track_a)"""
sql("parse_ass", f"SELECT media_id, cue_idx, start_ms, end_ms, regexp_replace(raw, '\\\\[Nn]', {_NL}, 'g') AS text, style, raw FROM ass", LINES, ASS)
_ASSCLEAN = f"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(raw, '\\{{[^}}]*\\}}', '', 'g'), '\\\\[Nn]', {_NL}, 'g'), {_NL}), lambda x: {_strip('x')}), lambda x: x <> ''), {_NL})"
ASSFULL = f"""assfull AS (SELECT media_id, cue_idx, {_time('start_ms', 'ass')} AS s, {_time('end_ms', 'ass')} AS e, style, raw FROM ass
  UNION ALL SELECT media_id, CAST(count(*) AS INTEGER), 'bad', '0:00:01.00', 'Default', 'bad time' FROM ass GROUP BY media_id)"""
sql(
    "parse_ass_full",
    f"""SELECT media_id, cue_idx, 0 AS layer, s AS start, e AS "end", style, '' AS name, 0 AS margin_l, 0 AS margin_r, 0 AS margin_v,
  '' AS effect, {_ASSCLEAN} AS text, raw FROM assfull""",
    LINES, ASS, ASSFULL,
)
sql("srt_rejects", f"SELECT doc_id AS media_id, unnest(['just one line', '77' || {_NL} || '00:99 --> nothing' || {_NL} || 'bad time']) AS block FROM documents")
_FONT = f"{_list(ad.ASS_FONTS)}[doc_id % {len(ad.ASS_FONTS)} + 1]"
sql("ass_styles", f"""SELECT doc_id AS media_id, unnest([0, 1]) AS style_idx, unnest(['Default', 'Sign']) AS name,
  unnest([{_FONT}, 'Gone Sans']) AS fontname, unnest(['1', '134']) AS encoding FROM documents""")
sql("script_info", "SELECT doc_id AS media_id, unnest(['title', 'playresy']) AS key, unnest(['demo', CAST(720 + 360 * (doc_id % 3) AS VARCHAR)]) AS value FROM documents")

_CLEAN = f"""CASE WHEN regexp_matches(text, '\\{{[^}}]*\\\\p[1-9][^}}]*\\}}') THEN '' ELSE
  array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\{{[^}}]*\\}}', '', 'g'), '\\\\[Nn]', {_NL}, 'g'), {_NL}), lambda x: {_strip('x')}), lambda x: x <> ''), {_NL}) END"""
PRINTABLE = f"""printable AS (SELECT * FROM (SELECT media_id, cue_idx, start_ms, end_ms, {_CLEAN} AS text FROM styled)
  WHERE text <> '' AND end_ms - start_ms >= 100)"""
sql("clean_filter", "SELECT * FROM printable", LINES, STYLED, PRINTABLE)
DEDUP = """kept AS (SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY media_id, (start_ms + 5) // 10, (end_ms + 5) // 10, text ORDER BY cue_idx) = 1)"""
sql(
    "render_srt",
    f"""SELECT media_id, seq, seq || {_NL} || {_time('start_ms')} || ' --> ' || {_time('end_ms')} || {_NL} || text || {_NL} AS block
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) AS INTEGER) AS seq FROM kept)""",
    LINES, STYLED, PRINTABLE, DEDUP.format("printable"),
)
sql(
    "dedup_cues", "SELECT media_id, cue_idx, start_ms, end_ms, text FROM kept", LINES,
    "doubled AS (SELECT media_id, cue_idx, start_ms, end_ms, text FROM track_a UNION ALL SELECT media_id, cue_idx + 100000, start_ms, end_ms + 4, text FROM track_a)",
    DEDUP.format("doubled"),
)
sql(
    "render_vtt",
    f"""SELECT DISTINCT media_id, 0 AS seq, 'WEBVTT' || {_NL} AS block FROM track_a UNION ALL
  SELECT media_id, cue_idx + 1, {_time('start_ms', 'vtt')} || ' --> ' || {_time('end_ms', 'vtt')} || {_NL} || text || {_NL} FROM track_a""",
    LINES,
)
from cueweave.sources import ass as _ass  # noqa: E402

_HEAD = (
    f"{_ass.DEFAULT_INFO}\n[V4+ Styles]\n{_ass.STYLE_FORMAT}\nStyle: Default,%s,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,"
    f"-1,0,0,0,100,100,0,0,1,2.5,1,2,10,10,20,1\n\n[Events]\n{_ass.EVENT_FORMAT}"
)
sql(
    "render_ass",
    f"""SELECT media_id, 0 AS seq, CASE WHEN media_id % 4 = 0 THEN '[Script Info] ' || media_id WHEN bool_or(regexp_matches(text, '{tx.CJK_FONT}'))
    THEN '{_HEAD % 'Microsoft YaHei,56'}' ELSE '{_HEAD % 'Arial,48'}' END AS block FROM styled GROUP BY media_id UNION ALL
  SELECT media_id, cue_idx + 1, 'Dialogue: 0,' || {_time('start_ms', 'ass')} || ',' || {_time('end_ms', 'ass')} || ',' || style || ',,0,0,0,,' || CASE WHEN cue_idx % 3 = 0 THEN '{{\\an2}}' || text ELSE replace(text, {_NL}, '\\N') END FROM styled""",
    LINES, STYLED,
)
sql("any_cjk", f"SELECT media_id, bool_or(regexp_matches(text, '{tx.CJK_FONT}')) AS has_cjk FROM styled GROUP BY 1", LINES, STYLED)
sql(
    "format_dispatch",
    f"""SELECT media_id, ['srt', 'vtt', 'ass', 'ssa'][CAST(media_id % 4 AS INTEGER) + 1] AS format, count(*) AS n_cues,
  CAST(sum(start_ms) AS BIGINT) AS start_sum, CAST(sum(end_ms) AS BIGINT) AS end_sum,
  CAST(sum(length(CASE WHEN media_id % 4 < 2 THEN txt ELSE regexp_replace({ASS_TEXT}, '\\\\[Nn]', {_NL}, 'g') END)) AS BIGINT) AS n_chars
  FROM track_a GROUP BY media_id""",
    LINES,
)
_STAMP = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
sql(
    "validate_format",
    f"""SELECT media_id, 'rendered' AS origin, ['srt', 'vtt', 'ass', 'ssa'][CAST(media_id % 4 AS INTEGER) + 1] AS ext,
    media_id % 4 <> 0 OR max(CAST(cue_idx % 3 <> 2 AS INTEGER)) = 1 AS valid FROM track_a GROUP BY media_id
  UNION ALL SELECT media_id, 'prose', ext, CASE WHEN ext = 'srt' THEN regexp_matches(text, '(?m)^\\d+\\s*\\n{_STAMP}\\s*-->\\s*{_STAMP}\\s*\\n')
    WHEN ext IN ('ass', 'ssa') THEN contains(text, '[Script Info]') AND contains(text, '[Events]') ELSE true END FROM files""",
    LINES, FILES,
)
sql("job_report", "SELECT codec, CASE WHEN is_forced THEN 'failed' WHEN is_default THEN 'converted' ELSE 'unchanged' END AS status, count(*) AS n_files FROM tracks GROUP BY ALL", TRACKS)
_TEXTCODEC = "codec IN ('subrip', 'ass', 'ssa', 'webvtt', 'srt', 'mov_text')"
_LABEL = "concat_ws(' ', 's:' || rel_index, nullif(language, ''), nullif(title, ''), '(' || codec || ')')"
sql(
    "tracks_from_manifest",
    f"""SELECT media_id, rel_index, track_id, codec, language, title, is_default, is_forced, {_TEXTCODEC} AS is_text, {_LABEL} AS label,
  '<' || concat_ws(' ', 'Track ' || track_id, CASE WHEN language <> '' THEN 'lang=' || language END,
    CASE WHEN title <> '' THEN 'title=''' || title || '''' END, codec, CASE WHEN is_default THEN 'default' END,
    CASE WHEN is_forced THEN 'forced' END) || '>' AS shown FROM tracks""",
    TRACKS,
)
EMB = "emb AS (SELECT DISTINCT media_id, start_ms AS emb_ms FROM track_a WHERE start_ms < 120000)"
sql("packet_times", "SELECT DISTINCT media_id, start_ms AS emb_ms FROM track_a", LINES)
sql("first_k_starts", "SELECT media_id, cue_idx AS ext_i, start_ms AS ext_ms FROM track_a WHERE cue_idx < 15", LINES)

# ---- time functions -----------------------------------------------------------------
on_a("time_parse", """start_ms AS srt_ms, end_ms AS dot_ms, (start_ms + 7) // 10 * 10 AS ass_ms, end_ms AS vtt_ms,
  CASE WHEN regexp_matches(text, '^\\s*\\d+:\\d+:\\d+([.,]\\d+)?\\s*$') THEN -1 END::BIGINT AS bad_ms""")
_T = "(start_ms * 37 - 50000)"
on_a("time_format", f"{_time(_T)} AS srt, {_time(_T, 'ass')} AS ass, {_time(_T, 'vtt')} AS vtt, {_time('start_ms', 'vtt')} || ' --> ' || {_time('end_ms', 'vtt')} AS shown")
_D = "(end_ms * 11 + cue_idx)"
_SEC = f"printf('%d.%ds', ({_D} % 60000 + 50) // 100 // 10, ({_D} % 60000 + 50) // 100 % 10)"
on_a("duration_format", f"""CASE WHEN {_D} < 60000 THEN {_SEC} WHEN {_D} < 3600000 THEN {_D} // 60000 || 'm ' || {_SEC}
  ELSE {_D} // 3600000 || 'h ' || {_D} // 60000 % 60 || 'm ' || {_SEC} END AS shown""")
on_a("time_shift", f"{_time('(start_ms - 30250)')} AS earlier, {_time('(start_ms + 4007)')} AS later")
on_a("offset_parse", "start_ms - 20000 AS offset_ms")
on_a("ass_time", f"""{_time('(start_ms // 10 * 10)')} AS "full", {_time('(start_ms // 100 * 100)')} AS tenths, {_time('(start_ms // 1000 * 1000)')} AS whole, '00:00:00,000' AS bad""")

# ---- text -----------------------------------------------------------------------------
_BREAKS = f"regexp_replace(text, '\\\\[Nn]', {_NL}, 'g')"
_BARE = _strip(f"regexp_replace(regexp_replace({_BREAKS}, '\\{{[^}}]+\\}}', '', 'g'), '<[^>]+>', '', 'g')")
on_styled("clean_text", f"{_BREAKS} AS plain, {_BARE} AS bare")
on_styled("clean_srt", f"{_CLEAN} AS cleaned")


def _tidy(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(regexp_replace({x}, '\\\\[Nn]', {_NL}, 'g'), {_NL}), lambda x: {_strip('x')}), lambda x: x <> ''), {_NL})"


_NOTAG = "regexp_replace(text, '\\{[^}]*\\}', '', 'g')"
on_styled("clean_ass", f"{_tidy(_NOTAG)} AS cleaned, {_tidy('text')} AS with_effects")


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '<[^>]+>', '', 'g'), '\\{{[^}}]+\\}}', '', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"


on_styled("norm_text", f"{_norm('text')} AS norm")
_FMT = f"regexp_replace({_NOTAG}, '<[^>]+>', '', 'g')"
on_styled("strip_fmt", f"{_FMT} AS bare, regexp_replace(text, '<[^>]+>', '', 'g') AS no_html")
sql("page_text", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS bare FROM pages")
_SHOW = _strip(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\{{[^}}]+\\}}', '', 'g'), '\\\\[nN]', ' ', 'g'), '{tx.WS}+', ' ', 'g')")
on_styled("display_text", ", ".join(
    f"CASE WHEN text = '' THEN '[empty]' WHEN {_SHOW} = '' THEN '[formatting only]' WHEN length({_SHOW}) > {n} THEN {_SHOW}[:{n - 3}] || '...' ELSE {_SHOW} END AS {out}"
    for n, out in ((80, "shown"), (35, "narrow"))))
sql(
    "combine_texts",
    f"""SELECT media_id, cue_idx, concat_ws({_NL}, nullif(x, ''), nullif(y, '')) AS first_top, concat_ws({_NL}, nullif(y, ''), nullif(x, '')) AS second_top
  FROM (SELECT a.media_id, a.cue_idx, CASE WHEN length(a.text) > 6 THEN a.text ELSE '' END AS x, zh.text AS y FROM a LEFT JOIN zh USING (media_id, cue_idx))""",
    LINES, TRACK_B,
)
_LS = f"string_split(text, {_NL})"
on_styled("cjk_first", f"""array_to_string(list_concat(list_filter({_LS}, lambda x: regexp_matches(x, '{tx.CJK_LINE}')),
  list_filter({_LS}, lambda x: NOT regexp_matches(x, '{tx.CJK_LINE}'))), {_NL}) AS ordered""")
sql("eol_norm", f"SELECT doc_id AS media_id, replace(replace(replace(replace(replace(text, '. ', '.' || chr(13)), {_NL}, chr(13) || {_NL}), chr(13) || {_NL}, {_NL}), chr(13), {_NL}), chr(0), '') AS text FROM documents")
on_styled("has_cjk", ", ".join(f"regexp_matches(text, '{c}') AS {n}" for c, n in (
    (tx.CJK_FONT, "font"), (tx.CJK_CHINESE, "chinese"), (tx.CJK_STYLE, "style_sheet"), (tx.CJK_LINE, "line"))))


def _class(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '{tx.NOT_CJK_COUNTED}', '', 'g'))"
    latin = f"length(regexp_replace({x}, '{tx.NOT_LATIN_COUNTED}', '', 'g'))"
    return f"CASE WHEN {cjk} > 0 AND {cjk} >= {latin} THEN 'cjk' WHEN {latin} > 0 THEN 'latin' ELSE 'other' END"


sql("line_class", f"""SELECT media_id, cue_idx, line_no, {_class('line')} AS class FROM (SELECT media_id, cue_idx, unnest({_LS}) AS line,
  CAST(generate_subscripts({_LS}, 1) - 1 AS INTEGER) AS line_no FROM styled)""", LINES, STYLED)
_NONDIA = f"len(list_filter({_list(tx.NON_DIALOGUE_STYLES)}, lambda w: contains(trim(lower(coalesce(style, 'Default'))), w))) > 0"
sql("dialogue_style", f"SELECT style, NOT ({_NONDIA}) AS dialogue, count(*) AS n_cues FROM styled GROUP BY ALL", LINES, STYLED)


def _lang(x: str) -> str:
    cls = lg._CJK_CLASSES
    first = f"unicode(nullif(regexp_extract({x}, '{cls}'), ''))"
    hits = f"len(list_filter({_list(lg.ENGLISH_WORDS)}, lambda w: contains(lower({x}), w)))"
    letters = f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"
    latin = f"length(regexp_replace({x}, '{lg._LATIN1_LETTERS}', '', 'g'))"
    return f"""CASE WHEN {first} BETWEEN 13312 AND 40959 THEN 'zh' WHEN {first} BETWEEN 12352 AND 12543 THEN 'ja' WHEN {first} IS NOT NULL THEN 'ko'
  WHEN {hits} >= 2 OR ({hits} >= 1 AND length({x}) > 10) THEN 'en' WHEN {letters} > 5 AND {latin} / {letters} > 0.8 THEN 'en' ELSE 'unknown' END"""


sql("detect_lang", f"SELECT doc_id AS media_id, -1 AS cue_idx, {_lang('text')} AS lang FROM documents UNION ALL SELECT media_id, cue_idx, {_lang('text')} FROM styled", LINES, STYLED)
on_styled("detect_lang_legacy", "CASE WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]') THEN 'chinese' ELSE 'english' END AS lang")


def _from_name(x: str) -> str:
    rules = " ".join(
        f"WHEN len(list_filter({_list(['.' + t + '.' for t in tags] + ['_' + t + '.' for t in tags])}, lambda p: contains(lower({x}), p))) > 0 THEN '{code}'"
        for code, tags in lg.NAME_TAGS.items()
    )
    return f"CASE {rules} ELSE 'unknown' END"


sql("lang_from_name", f"SELECT media_id, name, {_from_name('name')} AS lang FROM (SELECT media_id, stem || '.' || ext AS name FROM files UNION ALL SELECT page_id, url FROM pages)", FILES)
_FAM = " ".join(f"WHEN list_contains({_list(c)}, lower(language)) THEN '{k}'" for k, c in lg.LANG_CODES.items())
sql("norm_lang", f"""SELECT media_id, rel_index, CASE WHEN language = '' THEN 'unknown' {_FAM} ELSE lower(language)[:2] END AS lang,
  CASE WHEN list_contains({_list(lg.LANG_CODES['zh'])}, lower(language)) THEN 'chinese' WHEN list_contains({_list(lg.LANG_CODES['en'])}, lower(language)) THEN 'english' END AS name FROM tracks""", TRACKS)
sql("lang_semi", f"SELECT media_id, rel_index, language FROM tracks WHERE list_contains({_list(lg.LANG_CODES['zh'] + lg.LANG_CODES['en'])}, lower(language))", TRACKS)


def _counts(x: str) -> str:
    def n(cls: str) -> str:
        return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"
    kana, hangul = n("\\x{3040}-\\x{30FF}"), n("\\x{AC00}-\\x{D7AF}")
    cjk = n("\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}")
    return f"CASE WHEN {cjk} > 10 THEN CASE WHEN {hangul} > {kana} AND {hangul} > {cjk} * 0.3 THEN 'ko' WHEN {kana} > {cjk} * 0.1 THEN 'ja' ELSE 'zh' END END"


sql("detect_lang_counts", f"""SELECT media_id, {_counts('text')} AS plain, {_counts('zh')} AS hanzi, {_counts("translate(zh, '的一是', 'かなカ')")} AS kana,
  {_counts("translate(zh, '的一是在不', '가나다라마')")} AS hangul FROM (SELECT doc_id AS media_id, text, translate(lower(text), '{ad.LATIN}', '{ad.HANZI}') AS zh FROM documents)""")


def _n(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


HEAD3 = """head3 AS (SELECT media_id, string_agg(text, ' ' ORDER BY cue_idx) AS sample FROM {0} WHERE cue_idx < 3 GROUP BY 1)"""


def _is_zh(lang: str, x: str) -> str:
    return f"coalesce(lower({lang}) IN ('zh', 'chi', 'chinese', 'zh-cn', 'zh-tw'), false) OR ({_n(x, chr(92) + 'p{L}' + chr(92) + 'p{N}')} > 0 AND {_n(x, chr(92) + 'x{4E00}-' + chr(92) + 'x{9FFF}')} > 0.3 * {_n(x, chr(92) + 'p{L}' + chr(92) + 'p{N}')})"


def _is_en(lang: str, x: str) -> str:
    return f"coalesce(lower({lang}) IN ('en', 'eng', 'english'), false) OR ({_n(x, chr(92) + 'p{L}' + chr(92) + 'p{N}')} > 0 AND {_n(x, 'A-Za-z')} / {_n(x, chr(92) + 'p{L}' + chr(92) + 'p{N}')} > 0.7)"


sql("track_is_lang", f"""SELECT media_id, {_is_zh('language', 'sample')} AS is_chinese, {_is_en('language', 'sample')} AS is_english
  FROM head3 JOIN tracks USING (media_id) WHERE rel_index = 0""", LINES, TRACK_B, HEAD3.format("a"), TRACKS)
_NAME = "stem || '.' || ext"
_RESOLVED = f"coalesce(nullif({_from_name('(' + _NAME + ')')}, 'unknown'), {_lang('text')})"
sql("resolve_lang", f"SELECT media_id, {_RESOLVED} AS lang FROM files", FILES)


def _cut(x: str, suffixes) -> str:
    rules = " ".join(f"WHEN ends_with(lower({x}), '.{s}') THEN {x}[:length({x}) - {len(s) + 1}]" for s in suffixes)
    return f"CASE {rules} ELSE {x} END"


sql("bilingual_name", f"""SELECT media_id, {_cut('stem', lg.BILINGUAL_SUFFIXES)} || '.' || CASE WHEN l1 = 'unknown' OR l2 = 'unknown' THEN 'bilingual'
  WHEN l1 = 'en' AND l2 <> 'en' THEN l2 || '-en' WHEN l2 = 'en' AND l1 <> 'en' THEN l1 || '-en' ELSE least(l1, l2) || '-' || greatest(l1, l2) END || '.srt' AS name
  FROM (SELECT *, CASE WHEN media_id % 3 = 0 THEN 'unknown' ELSE lang END AS l1, CASE WHEN media_id % 2 = 0 THEN 'en' ELSE 'zh' END AS l2 FROM files)""", FILES)


def _cut_exact(x: str) -> str:
    rules = " ".join(f"WHEN ends_with({x}, '.{s}') THEN {x}[:length({x}) - {len(s) + 1}]" for s in lg.PAIR_SUFFIXES)
    return f"CASE {rules} ELSE {x} END"


sql("base_name", f"SELECT media_id, {_cut_exact('stem')} AS pair_base, {_cut('stem', lg.SPLIT_SUFFIXES)} AS split_base FROM files", FILES)
_KW = f"""list_filter(regexp_extract_all(line, '[A-Za-z'']+|\\d+'), lambda w, i: NOT list_contains({_list(kw.STOP_WORDS + kw.NOISE_WORDS)}, lower(w)) AND (
  regexp_full_match(w, '\\d{{2,}}') OR regexp_full_match(w, '[A-Z]{{2,}}') OR (regexp_full_match(w, '[A-Z][A-Za-z]+') AND w <> upper(w) AND (i > 1 OR regexp_matches(line, '{kw._CJK}')))))"""


def _kw(src: str, out: str, fold: bool) -> str:
    word = "lower(w)" if fold else "w"
    return f"""{out} AS (SELECT media_id, cue_idx, start_ms, coalesce(list(DISTINCT {word} ORDER BY {word}) FILTER (w IS NOT NULL), []) AS tokens FROM (
  SELECT media_id, cue_idx, start_ms, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS w FROM (
    SELECT media_id, cue_idx, start_ms, flatten(list_transform(string_split(regexp_replace({_FMT}, '\\\\[Nn]', {_NL}, 'g'), {_NL}), lambda line: {_KW})) AS ws FROM {src})) GROUP BY ALL)"""


NAMED = "named_a AS (SELECT * REPLACE (text || ' 的' AS text) FROM a), named_b AS (SELECT * REPLACE (text || ' 的' AS text) FROM same)"
sql("keywords", "SELECT media_id, cue_idx, array_to_string(tokens, '|') AS keywords FROM k", LINES, TRACK_B, NAMED, _kw("named_a", "k", False))


def _nums(src: str, out: str) -> str:
    return f"{out} AS (SELECT media_id, cue_idx, start_ms, list_sort(list_distinct(regexp_extract_all({_FMT}, '\\d{{2,}}'))) AS tokens FROM {src})"


sql("numbers", "SELECT media_id, cue_idx, array_to_string(tokens, '|') AS numbers FROM n", LINES, TRACK_B, _nums("a", "n"))

# ---- similarity ---------------------------------------------------------------------------
TIMED = """timed AS (SELECT a.media_id, a.cue_idx AS a_idx, b.cue_idx AS b_idx, abs(a.start_ms - b.start_ms) AS delta_ms, a.text AS ta, b.text AS tb
  FROM a JOIN same b ON a.media_id = b.media_id AND abs(a.start_ms - b.start_ms) <= 500)"""
# levenshtein counts bytes here: the accented letters become capitals (the normal form has none), one byte each.
_ACCENTS = "àâäæçèéêëíîïñóôöœßúûüÿáìòù"


def _single(x: str) -> str:
    return f"translate({x}, '{_ACCENTS}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


_SC = f"""scored AS (SELECT *, CASE WHEN len(w1) = 0 AND len(w2) = 0 THEN 1.0 ELSE len(list_intersect(w1, w2)) / len(list_distinct(list_concat(w1, w2))) END AS jaccard,
  CASE WHEN len(w1) = 0 OR len(w2) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_intersect(w1, w2), lambda w: len(list_filter(w1, lambda x: x = w)) * len(list_filter(w2, lambda x: x = w)))), 0)
    / (sqrt(list_sum(list_transform(list_distinct(w1), lambda w: len(list_filter(w1, lambda x: x = w)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(w2), lambda w: len(list_filter(w2, lambda x: x = w)) ** 2)))) END AS cosine,
  CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1.0 - levenshtein({_single("x")}, {_single("y")}) / greatest(length(x), length(y)) END AS edit,
  CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE least(length(x), length(y)) / greatest(length(x), length(y)) END AS length,
  CASE WHEN len(s1) = 0 AND len(s2) = 0 THEN 1.0 WHEN len(s1) = 0 OR len(s2) = 0 THEN 0.0 ELSE len(list_intersect(s1, s2)) / len(list_distinct(list_concat(s1, s2))) END AS common
  FROM (SELECT *, list_filter(w1, lambda w: NOT list_contains({_list(sim.STOP_WORDS)}, w)) AS s1, list_filter(w2, lambda w: NOT list_contains({_list(sim.STOP_WORDS)}, w)) AS s2 FROM (
    SELECT *, list_filter(string_split(x, ' '), lambda w: w <> '') AS w1, list_filter(string_split(y, ' '), lambda w: w <> '') AS w2 FROM (
      SELECT media_id, a_idx, b_idx, {_norm("ta")} AS x, {_norm("tb")} AS y FROM timed))))"""
sql("similarity_own", """SELECT media_id, a_idx, b_idx, round(t, 6) AS similarity FROM (
  SELECT *, 0.3 * edit + 0.2 * jaccard + 0.2 * length + CASE WHEN left(x, 4) = left(y, 4) THEN 0.3 ELSE 0 END AS t FROM scored) WHERE t >= 0.551237""", LINES, TRACK_B, TIMED, _SC)
sql("similarity_scores", """SELECT media_id, a_idx, b_idx, round(jaccard, 6) AS jaccard, round(cosine, 6) AS cosine, round(edit, 6) AS edit, round(length, 6) AS length, round(common, 6) AS common,
  round(0.2 * jaccard + 0.2 * cosine + 0.15 * edit + 0.1 * length + 0.1 * common, 6) AS weighted,
  round(least(0.2, 2 * list_var_pop([jaccard, cosine, edit, length, common])) + 1e-12, 6) AS variance,
  round(least(0.3, 0.5 * abs(a_idx / 39 - b_idx / 29)), 6) AS position FROM scored""", LINES, TRACK_B, TIMED, _SC)

# ---- joins -----------------------------------------------------------------------------------
def overlaps(a: str, b: str, out: str = "ov") -> str:
    return f"""{out} AS (SELECT a.media_id, a.cue_idx AS a_idx, b.cue_idx AS b_idx, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms,
  2 * (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / (a.end_ms - a.start_ms + b.end_ms - b.start_ms) AS score
  FROM {a} a JOIN {b} b ON a.media_id = b.media_id AND least(a.end_ms, b.end_ms) > greatest(a.start_ms, b.start_ms))"""


OV = overlaps("a", "same")
sql("overlap_candidates", "SELECT media_id, a_idx, b_idx, overlap_ms, round(score, 6) AS score FROM ov", LINES, TRACK_B, OV)
BEST = "best AS (SELECT * FROM ov WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY media_id, a_idx ORDER BY score DESC, b_idx) = 1)"
sql("overlap_best_naive", "SELECT media_id, a_idx, b_idx, overlap_ms, round(score, 6) AS score FROM best", LINES, TRACK_B, OV, BEST)
sql("time_candidates", "SELECT media_id, a_idx, b_idx, delta_ms FROM timed", LINES, TRACK_B, TIMED)

# Sequential matching: one step per source, carrying the list of taken references.
WALK = """cand AS (SELECT media_id, src_idx, list({'r': ref_idx, 's': score, 'n': near} ORDER BY ref_idx) AS c,
  row_number() OVER (PARTITION BY media_id ORDER BY src_idx) AS k FROM edges GROUP BY media_id, src_idx),
walk(media_id, k, src_idx, pick, used) AS (
  SELECT DISTINCT media_id, CAST(0 AS BIGINT), -1, -1, CAST([] AS INTEGER[]) FROM cand
  UNION ALL
  SELECT media_id, k, src_idx, pick, CASE WHEN pick >= 0 THEN list_append(used, pick) ELSE used END FROM (
    SELECT media_id, k, src_idx, used, CASE WHEN len(free) = 0 THEN -1
      WHEN -best.a > (CASE WHEN free[1].s > 0 THEN free[1].s ELSE free[1].n END) THEN best.b ELSE free[1].r END AS pick FROM (
      SELECT *, list_sort(list_transform(free, lambda x: {'a': -x.s, 'b': x.r}))[1] AS best FROM (
        SELECT w.media_id, c.k, c.src_idx, w.used, list_filter(c.c, lambda x: NOT list_contains(w.used, x.r)) AS free
        FROM walk w JOIN cand c ON c.media_id = w.media_id AND c.k = w.k + 1)))),
picks AS (SELECT media_id, src_idx, pick AS ref_idx FROM walk WHERE pick >= 0)"""
COMP = "edges AS (SELECT media_id, a_idx AS src_idx, b_idx AS ref_idx, score, 0.0 AS near FROM ov WHERE score > 0.3)"
sql("match_serial", "SELECT * FROM picks", LINES, TRACK_B, OV, COMP, WALK, recursive=True)
TEDGE = "edges AS (SELECT media_id, a_idx AS src_idx, b_idx AS ref_idx, CAST(501 - delta_ms AS DOUBLE) AS score, 0.0 AS near FROM timed)"
sql("time_align", """SELECT p.media_id, src_idx AS a_idx, ref_idx AS b_idx, round(1.0 - delta_ms / 500, 6) AS confidence
  FROM picks p JOIN timed t ON p.media_id = t.media_id AND p.src_idx = t.a_idx AND p.ref_idx = t.b_idx""", LINES, TRACK_B, TIMED, TEDGE, WALK, recursive=True)
_OVZ = overlaps("a", "zh")
_HAN = "regexp_matches(a.text, '[\\x{4E00}-\\x{9FFF}]')"
MCOMP = f"""merged AS (SELECT p.media_id, src_idx AS idx1, ref_idx AS idx2, least(a.start_ms, b.start_ms) AS start_ms, greatest(a.end_ms, b.end_ms) AS end_ms,
    CASE WHEN {_HAN} THEN a.text || {_NL} || b.text ELSE b.text || {_NL} || a.text END AS text, 'both' AS kind
  FROM picks p JOIN a ON a.media_id = p.media_id AND a.cue_idx = src_idx JOIN zh b ON b.media_id = p.media_id AND b.cue_idx = ref_idx
  UNION ALL SELECT media_id, cue_idx, NULL, start_ms, end_ms, text, 'first' FROM a WHERE (media_id, cue_idx) NOT IN (SELECT media_id, src_idx FROM picks)
  UNION ALL SELECT media_id, NULL, cue_idx, start_ms, end_ms, text, 'second' FROM zh WHERE (media_id, cue_idx) NOT IN (SELECT media_id, ref_idx FROM picks))"""
_MC = (LINES, TRACK_B, _OVZ, COMP, WALK, MCOMP)
sql("merge_comprehensive", "SELECT media_id, idx1, idx2, start_ms, end_ms, text, kind FROM merged", *_MC, recursive=True)
sql("merged_order", """SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms,
  CASE kind WHEN 'both' THEN 0 WHEN 'first' THEN 1 ELSE 2 END, coalesce(idx1, idx2), coalesce(idx2, idx1)) AS INTEGER) AS seq, start_ms, idx1, idx2 FROM merged""", *_MC, recursive=True)
sql("merge_stats", f"""SELECT media_id, count(*) AS n_merged, count(*) FILTER (kind = 'both') AS n_both, count(*) FILTER (kind = 'first') AS n_first,
  count(*) FILTER (kind = 'second') AS n_second, round(count(*) FILTER (contains(text, {_NL})) / count(*), 6) AS bilingual_share FROM merged GROUP BY 1""", *_MC, recursive=True)
sql("preservation", """SELECT o.media_id, count(*) AS n_original, count(m.t) AS n_kept, round(count(m.t) / count(*), 6) AS ratio, count(m.t) / count(*) >= 0.8 AS preserved
  FROM (SELECT DISTINCT media_id, unnest([start_ms, end_ms]) AS t FROM a) o LEFT JOIN (SELECT DISTINCT media_id, unnest([start_ms, end_ms]) AS t FROM merged) m ON o.media_id = m.media_id AND o.t = m.t GROUP BY 1""", *_MC, recursive=True)
sql("preservation_exact", """SELECT media_id, count(*) AS n_original, CASE WHEN media_id % 2 = 0 THEN 0 ELSE count(*) END AS n_kept,
  CASE WHEN media_id % 2 = 0 THEN 0.0 ELSE 1.0 END AS ratio, media_id % 2 <> 0 AS preserved FROM a GROUP BY media_id""", LINES, TRACK_B)

PLAN = """plan AS (SELECT *, source1 = 'embedded' AND source2 = 'embedded' AS both_e, source2 = 'embedded' AND source1 <> 'embedded' AS second FROM roles),
plan2 AS (SELECT media_id, second, (CASE WHEN second THEN language2 ELSE language1 END) = 'chinese' AS zh_ref,
  (source1 = 'embedded') <> (source2 = 'embedded') AS mixed FROM plan),
rf AS (SELECT a.*, p.* EXCLUDE (media_id) FROM a JOIN plan2 p USING (media_id) WHERE NOT second UNION ALL SELECT z.*, p.* EXCLUDE (media_id) FROM zh z JOIN plan2 p USING (media_id) WHERE second),
ovl AS (SELECT z.*, p.* EXCLUDE (media_id) FROM zh z JOIN plan2 p USING (media_id) WHERE NOT second UNION ALL SELECT a.*, p.* EXCLUDE (media_id) FROM a JOIN plan2 p USING (media_id) WHERE second),
edges AS (SELECT * FROM (SELECT r.media_id, r.cue_idx AS src_idx, o.cue_idx AS ref_idx,
    CASE WHEN ov >= (CASE WHEN r.mixed THEN 1 ELSE 100 END) THEN ov / 100 ELSE 0.0 END AS score,
    CASE WHEN NOT r.mixed THEN 0.0 WHEN r.zh_ref THEN greatest(0.0, (2.0 - d2 / 2000) / 2.0) ELSE greatest(0.0, 5.0 - d2 / 2000) END AS near
  FROM (SELECT r.*, o.cue_idx AS oi, least(r.end_ms, o.end_ms) - greatest(r.start_ms, o.start_ms) AS ov, abs(r.start_ms + r.end_ms - o.start_ms - o.end_ms) AS d2
    FROM rf r JOIN ovl o ON o.media_id = r.media_id AND o.start_ms < r.end_ms + 30000 AND o.end_ms > r.start_ms - 30000) r JOIN ovl o ON o.media_id = r.media_id AND o.cue_idx = r.oi)
  WHERE score > 0 OR near > 0)"""
MPRES = f"""merged AS (SELECT r.media_id, CASE WHEN r.second THEN p.ref_idx ELSE r.cue_idx END AS idx1, CASE WHEN r.second THEN r.cue_idx ELSE p.ref_idx END AS idx2,
    r.start_ms, r.end_ms, CASE WHEN o.text IS NULL THEN r.text WHEN r.zh_ref THEN r.text || {_NL} || o.text ELSE o.text || {_NL} || r.text END AS text,
    CASE WHEN o.text IS NOT NULL THEN 'both' WHEN r.second THEN 'second' ELSE 'first' END AS kind
  FROM rf r LEFT JOIN picks p ON p.media_id = r.media_id AND p.src_idx = r.cue_idx LEFT JOIN ovl o ON o.media_id = p.media_id AND o.cue_idx = p.ref_idx
  UNION ALL SELECT media_id, CASE WHEN second THEN cue_idx END, CASE WHEN NOT second THEN cue_idx END, start_ms, end_ms, text, CASE WHEN second THEN 'first' ELSE 'second' END
  FROM ovl WHERE mixed AND NOT zh_ref AND (media_id, cue_idx) NOT IN (SELECT media_id, ref_idx FROM picks))"""
sql("merge_preserved", "SELECT * FROM merged", LINES, TRACK_B, ROLES, PLAN, WALK, MPRES, recursive=True)
ROLES_EN = ROLES.replace("CASE WHEN doc_id % 4 < 2 THEN 'embedded' ELSE 'external' END", "'embedded'").replace(
    "CASE WHEN doc_id % 4 IN (0, 2) THEN 'embedded' ELSE 'external' END", "'external'").replace(
    "CASE WHEN doc_id % 3 = 0 THEN 'english' ELSE 'chinese' END", "'english'").replace("CASE WHEN doc_id % 3 = 0 THEN 'chinese' ELSE 'english' END", "'chinese'")
sql("merge_keep_foreign", "SELECT * FROM merged", LINES, TRACK_B, ROLES_EN, PLAN, WALK, MPRES, recursive=True)

# merge without alignment: media of two external tracks by overlap, the others with preserved timing.
_EMBEDDED = "media_id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 3)"
_MERGED = "media_id, idx1, idx2, start_ms, end_ms, text, kind"


def _either(*base: str) -> str:
    """Both merges of the tracks ``a`` and ``zh``, each where its strategy holds."""
    pres = f"(WITH RECURSIVE {', '.join((*base, ROLES, PLAN, WALK, MPRES))} SELECT * FROM merged)"
    comp = f"(WITH RECURSIVE {', '.join((*base, _OVZ, COMP, WALK, MCOMP))} SELECT * FROM merged)"
    return f"""SELECT {_MERGED}, 'preserved' AS strategy FROM {pres} WHERE {_EMBEDDED}
  UNION ALL SELECT {_MERGED}, 'comprehensive' FROM {comp} WHERE NOT {_EMBEDDED}"""


_ONE_SIDED = f"""one_sided AS (SELECT {_MERGED}, 'copy_first' AS strategy FROM (SELECT media_id, cue_idx AS idx1, NULL AS idx2, start_ms, end_ms, text, 'first' AS kind FROM xa WHERE media_id NOT IN (SELECT media_id FROM xb))
  UNION ALL SELECT {_MERGED}, 'copy_second' FROM (SELECT media_id, NULL AS idx1, cue_idx AS idx2, start_ms, end_ms, text, 'second' AS kind FROM xb WHERE media_id NOT IN (SELECT media_id FROM xa)))"""
_TWO = "media_id IN (SELECT media_id FROM xa) AND media_id IN (SELECT media_id FROM xb)"
_XAB = ("a AS (SELECT * FROM xa)", "zh AS (SELECT * FROM xb)")
sql("merge_plain", f"SELECT * FROM ({_either(*_XAB)}) WHERE {_TWO} UNION ALL SELECT * FROM one_sided", LINES, TRACK_B,
    "xa AS (SELECT * FROM a)", "xb AS (SELECT * FROM zh)", _ONE_SIDED)
sql("merge_ass", f"""SELECT m.media_id, idx1, idx2, m.start_ms, m.end_ms, m.text, CASE WHEN english THEN 'Default' ELSE 'Bilingual' END AS style, CASE WHEN chinese THEN x.text END AS raw, kind FROM (
  SELECT *, kind = 'second' OR kind = 'both' AND strategy = 'preserved' AND second AS english, kind = 'first' OR kind = 'both' AND strategy = 'preserved' AND NOT second AS chinese FROM (
    SELECT * FROM ({_either(*_XAB)}) WHERE {_TWO} UNION ALL SELECT * FROM one_sided)
  JOIN (SELECT doc_id AS media_id, doc_id % 4 = 2 AS second FROM documents) USING (media_id)) m
  LEFT JOIN xa x ON x.media_id = m.media_id AND x.cue_idx = m.idx1
  UNION ALL SELECT media_id, NULL, cue_idx, start_ms, end_ms, text, style, NULL, 'second' FROM styled WHERE style <> 'Default'""", LINES, TRACK_B, STYLED,
    "xa AS (SELECT * FROM zh WHERE cue_idx % 9 <> 0)", "xb AS (SELECT media_id, cue_idx, start_ms, end_ms, text FROM styled WHERE style = 'Default')", _ONE_SIDED)

SIGS = """sg AS (SELECT x.media_id, array_to_string(x.tokens, '|') AS src_sig, array_to_string(y.tokens, '|') AS ref_sig, n_src, n_ref,
  CAST(len(list_intersect(x.tokens, y.tokens)) AS INTEGER) AS n_shared
  FROM (SELECT media_id, tokens, count(*) AS n_src FROM ka GROUP BY ALL) x JOIN (SELECT media_id, tokens, count(*) AS n_ref FROM kb GROUP BY ALL) y
  ON x.media_id = y.media_id AND list_has_any(x.tokens, y.tokens))"""
_KWAB = (LINES, TRACK_B, NAMED, _kw("named_a", "ka", True), _kw("named_b", "kb", True))
_NUMAB = (LINES, TRACK_B, _nums("a", "ka"), _nums("same", "kb"))
sql("keyword_pairs", "SELECT * FROM sg", *_KWAB, SIGS)
sql("number_pairs", "SELECT * FROM sg", *_NUMAB, SIGS)
TOKEDGE = """edges AS (SELECT ka.media_id, ka.cue_idx AS src_idx, kb.cue_idx AS ref_idx, CAST(len(list_intersect(ka.tokens, kb.tokens)) AS DOUBLE) AS score, 0.0 AS near
  FROM ka JOIN kb ON ka.media_id = kb.media_id AND list_has_any(ka.tokens, kb.tokens))"""


def _anchors(base: float, method: str) -> str:
    return f"""SELECT p.media_id, src_idx, ref_idx, kb.start_ms - ka.start_ms AS time_offset_ms, round(least(1.0, {base} + 0.2 * len(list_intersect(ka.tokens, kb.tokens))), 6) AS confidence,
  '{method}' AS method, array_to_string(list_sort(list_intersect(ka.tokens, kb.tokens)), '|') AS keywords
  FROM picks p JOIN ka ON ka.media_id = p.media_id AND ka.cue_idx = src_idx JOIN kb ON kb.media_id = p.media_id AND kb.cue_idx = ref_idx"""


sql("number_anchors", _anchors(0.4, "number"), *_NUMAB, TOKEDGE, WALK, recursive=True)
# Greedy by weight: one step per edge in (weight desc, source, reference) order.
GREEDY = """eo AS (SELECT media_id, src_idx, ref_idx, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, src_idx, ref_idx) AS k FROM edges),
walk(media_id, k, src_idx, ref_idx, won, us, ur) AS (
  SELECT DISTINCT media_id, CAST(0 AS BIGINT), -1, -1, false, CAST([] AS INTEGER[]), CAST([] AS INTEGER[]) FROM eo
  UNION ALL SELECT media_id, k, src_idx, ref_idx, won, CASE WHEN won THEN list_append(us, src_idx) ELSE us END, CASE WHEN won THEN list_append(ur, ref_idx) ELSE ur END FROM (
    SELECT w.media_id, e.k, e.src_idx, e.ref_idx, NOT list_contains(w.us, e.src_idx) AND NOT list_contains(w.ur, e.ref_idx) AS won, w.us, w.ur
    FROM walk w JOIN eo e ON e.media_id = w.media_id AND e.k = w.k + 1)),
picks AS (SELECT media_id, src_idx, ref_idx FROM walk WHERE won)"""
sql("keyword_anchors", _anchors(0.5, "keyword"), *_KWAB, TOKEDGE, GREEDY, recursive=True)
OVEDGE = "edges AS (SELECT media_id, a_idx AS src_idx, b_idx AS ref_idx, CAST(overlap_ms AS DOUBLE) AS score, 0.0 AS near FROM ov)"
sql("match_greedy", "SELECT p.media_id, p.src_idx, p.ref_idx, overlap_ms AS weight FROM picks p JOIN ov ON ov.media_id = p.media_id AND a_idx = src_idx AND b_idx = ref_idx", LINES, TRACK_B, OV, OVEDGE, GREEDY, recursive=True)

ZIP = "zipped AS (SELECT a.media_id, a.cue_idx, abs(a.start_ms - b.start_ms) AS diff_ms FROM a JOIN same b USING (media_id, cue_idx) WHERE cue_idx < 10)"
sql("zip_diff", "SELECT * FROM zipped", LINES, TRACK_B, ZIP)
STATS = """stats AS (SELECT media_id, CAST(count(*) AS INTEGER) AS n, avg(diff_ms) AS avg_ms, max(diff_ms) AS max_ms, coalesce(avg(diff_ms) FILTER (r <= m * 8 // 10), avg(diff_ms)) AS core_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY diff_ms) AS r, count(*) OVER (PARTITION BY media_id) AS m FROM zipped) GROUP BY 1)"""
sql("timing_stats", "SELECT media_id, n, round(avg_ms, 6) AS avg_ms, max_ms, round(core_ms, 6) AS core_ms FROM stats", LINES, TRACK_B, ZIP, STATS)
_LEVEL = "CASE WHEN core_ms < 500 AND max_ms < 2000 THEN 'EXCELLENT' WHEN core_ms < 1000 AND max_ms < 5000 THEN 'GOOD' WHEN core_ms < 3000 AND max_ms < 10000 THEN 'MODERATE' ELSE 'POOR' END"
sql("sync_level", f"SELECT media_id, {_LEVEL} AS level FROM stats", LINES, TRACK_B, ZIP, STATS)
sql("sync_ok", "SELECT media_id, core_ms < 1000 AND max_ms < 3000 AS ok, core_ms < 500 AND max_ms < 1500 AS ok_half FROM stats", LINES, TRACK_B, ZIP, STATS)
MIS = """mis AS (SELECT media_id, avg(diff_ms) AS avg_ms, max(diff_ms) AS max_ms, source1 <> source2 AND (avg(diff_ms) > 5000 OR max(diff_ms) > 7500) AS misaligned
  FROM zipped JOIN roles USING (media_id) WHERE cue_idx < 5 GROUP BY media_id, source1, source2)"""
sql("misaligned", "SELECT media_id, round(avg_ms, 6) AS avg_ms, max_ms, misaligned FROM mis", LINES, TRACK_B, ZIP, ROLES, MIS)
sql("merge_strategy", f"""SELECT r.media_id, CASE WHEN n1 IS NULL AND n2 IS NULL THEN 'empty' WHEN n1 IS NULL THEN 'copy_second' WHEN n2 IS NULL THEN 'copy_first'
  WHEN source1 = 'embedded' AND source2 = 'embedded' THEN 'preserved' WHEN (source1 = 'embedded' OR source2 = 'embedded') THEN CASE WHEN misaligned THEN 'mixed' ELSE 'preserved' END
  WHEN {_LEVEL} IN ('MODERATE', 'POOR') THEN 'enhanced' ELSE 'comprehensive' END AS strategy
  FROM roles r LEFT JOIN (SELECT media_id, count(*) AS n1 FROM a GROUP BY 1) USING (media_id) LEFT JOIN (SELECT media_id, count(*) AS n2 FROM zh GROUP BY 1) USING (media_id)
  LEFT JOIN mis USING (media_id) LEFT JOIN (SELECT media_id, core_ms, max_ms FROM stats) st USING (media_id)""".replace("max_ms", "st.max_ms").replace("SELECT media_id, core_ms, st.max_ms", "SELECT media_id, core_ms, max_ms"),
    LINES, TRACK_B, ZIP, STATS, ROLES, MIS)

ROB = """off AS (SELECT media_id, b.start_ms - a.start_ms AS o FROM a JOIN same b USING (media_id, cue_idx)),
m0 AS (SELECT media_id, median(o) AS m0, count(*) AS n FROM off GROUP BY 1),
mk AS (SELECT off.*, n, abs(o - m0) < 5000 AS near, bool_or(abs(o - m0) < 5000) OVER (PARTITION BY off.media_id) AS any_near FROM off JOIN m0 ON off.media_id = m0.media_id),
kp AS (SELECT * FROM mk WHERE n < 3 OR near OR NOT any_near),
m1 AS (SELECT media_id, median(o) AS median_ms, count(*) AS n_inliers, min(n) AS n_anchors FROM kp GROUP BY 1),
md AS (SELECT m1.*, (SELECT median(abs(kp.o - m1.median_ms)) FROM kp WHERE kp.media_id = m1.media_id) AS mad FROM m1)"""
sql("robust_offset", """SELECT media_id, median_ms, CASE WHEN n_inliers >= 2 THEN mad ELSE 0.0 END AS mad_ms, n_anchors, n_inliers,
  round((CASE WHEN n_inliers < 2 OR mad < 100 THEN 1.0 WHEN mad < 500 THEN 0.9 WHEN mad < 1000 THEN 0.7 WHEN mad < 2000 THEN 0.5 ELSE 0.3 END) * (0.5 + 0.5 * least(1.0, n_inliers / 3.0)), 6) AS confidence FROM md""", LINES, TRACK_B, ROB)
VOTE = """ext AS (SELECT media_id, cue_idx AS ext_i, start_ms AS ext_ms FROM track_b WHERE cue_idx < 15),
cnd AS (SELECT media_id, ext_ms - emb_ms AS offset_ms, min({'i': ext_i, 'e': emb_ms}) AS f FROM ext JOIN emb USING (media_id) GROUP BY ALL),
vt AS (SELECT c.media_id, c.offset_ms, c.f, count(DISTINCT ext_i) AS votes FROM cnd c JOIN ext x ON x.media_id = c.media_id JOIN emb m ON m.media_id = c.media_id AND abs(x.ext_ms - c.offset_ms - m.emb_ms) <= 200 GROUP BY ALL),
ne AS (SELECT media_id, count(*) AS n_ext FROM ext GROUP BY 1),
vote AS (SELECT media_id, offset_ms, votes, n_ext FROM vt JOIN ne USING (media_id) QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY votes DESC, f) = 1)"""
sql("offset_vote", "SELECT * FROM vote", LINES, TRACK_B, EMB, VOTE)
FIRST = """fl AS (SELECT a.media_id, 0 AS a_idx, 0 AS b_idx, abs(a.start_ms - b.start_ms) AS delta_ms, a.start_ms - b.start_ms AS d FROM a JOIN same b USING (media_id, cue_idx)
  WHERE cue_idx = 0 AND abs(a.start_ms - b.start_ms) <= 2000)"""
sql("anchor_first", "SELECT media_id, a_idx, b_idx, delta_ms, round(1.0 - delta_ms / 2000, 6) AS confidence FROM fl", LINES, TRACK_B, FIRST)


def _scan(k: int, tol: int, a: str = "a", b: str = "same") -> str:
    return f"""scan AS (SELECT a.media_id, a.cue_idx AS a_idx, b.cue_idx AS b_idx, abs(a.start_ms - b.start_ms) AS delta_ms, a.start_ms AS sa, b.start_ms AS sb
  FROM {a} a JOIN {b} b ON a.media_id = b.media_id JOIN (SELECT media_id, least({k}, na, nb) AS k FROM (SELECT media_id, count(*) AS na FROM {a} GROUP BY 1) JOIN (SELECT media_id, count(*) AS nb FROM {b} GROUP BY 1) USING (media_id)) l
  ON l.media_id = a.media_id WHERE a.cue_idx < k AND b.cue_idx < k AND abs(a.start_ms - b.start_ms) <= {tol}
  QUALIFY row_number() OVER (PARTITION BY a.media_id ORDER BY abs(a.start_ms - b.start_ms), a.cue_idx, b.cue_idx) = 1)"""


sql("anchor_scan", "SELECT media_id, a_idx, b_idx, delta_ms, round(1.0 - delta_ms / 2000, 6) AS confidence FROM scan", LINES, TRACK_B, _scan(10, 2000))
sql("anchor_scan60", "SELECT media_id, a_idx, b_idx, delta_ms, round(greatest(0.3, 1.0 - delta_ms / 60000), 6) AS confidence FROM scan", LINES, TRACK_B, _scan(30, 60000))
sql("align_from_anchor", """SELECT media_id, a_idx, b_idx, delta_ms, round(greatest(0.5, c * (1.0 - delta_ms / 2000)), 6) AS confidence FROM (
  SELECT a.media_id, a.cue_idx AS a_idx, b.cue_idx AS b_idx, abs(a.start_ms + sb - sa - b.start_ms) AS delta_ms, 1.0 - s.delta_ms / 2000 AS c
  FROM scan s JOIN a ON a.media_id = s.media_id JOIN same b ON b.media_id = s.media_id AND sign(a.cue_idx - s.a_idx) = sign(b.cue_idx - s.b_idx) AND a.cue_idx <> s.a_idx
  WHERE abs(a.start_ms + sb - sa - b.start_ms) <= 2000
  QUALIFY row_number() OVER (PARTITION BY a.media_id, a.cue_idx ORDER BY abs(a.start_ms + sb - sa - b.start_ms), b.cue_idx * sign(a.cue_idx - s.a_idx)) = 1)""", LINES, TRACK_B, _scan(10, 2000))
sql("pair_files", f"""SELECT base, source, reference FROM (SELECT {_cut_exact('stem')} AS base, stem || '.' || ext AS source FROM files)
  JOIN (SELECT video_stem AS base, max(video_stem || '.en.srt') AS reference FROM files GROUP BY 1) USING (base)""", FILES)
sql("pair_by_extension", "SELECT stem || '.srt' AS source, video_stem || '.en.srt' AS reference FROM files WHERE ends_with(stem, '.fr') ", FILES)
sql("pair_prefix", "SELECT v.media_id, v.video_stem AS stem, min(f.stem || '.' || f.ext) AS subtitle FROM files v JOIN files f ON lower(f.stem) = lower(v.video_stem) OR starts_with(lower(f.stem), lower(v.video_stem) || '.') GROUP BY 1, 2", FILES)
_FRAG = f"len(list_filter({_list(lg.EXTERNAL_PATTERNS['english'])}, lambda p: contains(lower(name), p))) > 0"
sql("pick_external", f"""SELECT media_id, stem, subtitle, lvl > 0 AS by_content FROM (
  SELECT v.media_id, v.video_stem AS stem, n.name AS subtitle, CASE WHEN {_FRAG} THEN 0 ELSE 1 END AS lvl
  FROM files v JOIN subs n ON starts_with(n.name, v.video_stem) AND (({_FRAG}) OR (n.stem = v.video_stem AND {_lang('n.text')} = 'en'))
  QUALIFY row_number() OVER (PARTITION BY v.media_id ORDER BY CASE WHEN {_FRAG} THEN 0 ELSE 1 END, length(n.name), n.name) = 1)""",
    FILES, "subs AS (SELECT stem, stem || '.' || ext AS name, text FROM files UNION ALL SELECT video_stem, video_stem || '.srt', text FROM files)")
sql("external_subtitles", """SELECT DISTINCT v.media_id, n.name FROM files v JOIN (SELECT stem || '.' || ext AS name FROM files) n ON starts_with(n.name, v.video_stem || '.')
  AND (substr(n.name, length(v.video_stem) + 2) IN ('srt', 'ass', 'ssa', 'vtt') OR regexp_full_match(substr(n.name, length(v.video_stem) + 2), '(zh|chi|en|eng|ja|jpn|ko|kor)\\.(srt|ass)'))""", FILES)
sql("fix_fonts", f"""SELECT media_id, style_idx, name, old_font, CASE WHEN NOT replaced THEN old_font WHEN z THEN 'Microsoft YaHei' ELSE 'Arial' END AS new_font, '1' AS encoding, replaced FROM (
  SELECT *, old_font NOT IN (SELECT r_name FROM region) AS replaced FROM (
    SELECT doc_id AS media_id, z, unnest([0, 1]) AS style_idx, unnest(['Default', 'Sign']) AS name, unnest([{_FONT}, 'Gone Sans']) AS old_font
    FROM documents JOIN (SELECT media_id AS doc_id, bool_or(regexp_matches(raw, '{tx.CJK_STYLE}')) AS z FROM ass GROUP BY 1) USING (doc_id)))""", LINES, ASS)
sql("timeline_segments", f"""SELECT media_id, start_ms, end_ms, concat_ws({_NL}, t1, t2) AS text FROM (
  SELECT s.media_id, s.t AS start_ms, s.e AS end_ms, (SELECT arg_min(text, cue_idx) FROM a WHERE a.media_id = s.media_id AND a.start_ms <= s.t AND s.t < a.end_ms) AS t1,
    (SELECT arg_min(text, cue_idx) FROM zh z WHERE z.media_id = s.media_id AND z.start_ms <= s.t AND s.t < z.end_ms) AS t2
  FROM (SELECT media_id, t, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS e FROM (
    SELECT DISTINCT media_id, unnest([start_ms, end_ms]) AS t FROM (SELECT media_id, start_ms, end_ms FROM a UNION ALL SELECT media_id, start_ms, end_ms FROM zh))) s WHERE s.e IS NOT NULL)
  WHERE t1 IS NOT NULL OR t2 IS NOT NULL""", LINES, TRACK_B)


def _ref(a: str = "a", b: str = "zh", pref: bool = False) -> str:
    rule = f"WHEN {_is_zh('language1', 'h1.sample')} THEN 1 WHEN {_is_zh('language2', 'h2.sample')} THEN 2" if pref else ""
    joins = "LEFT JOIN head3 h1 USING (media_id) LEFT JOIN head3b h2 USING (media_id)" if pref else ""
    return f"""refs AS (SELECT media_id, CAST(CASE WHEN source1 = 'embedded' AND source2 = 'external' THEN 1 WHEN source2 = 'embedded' AND source1 = 'external' THEN 2 {rule}
  WHEN fa.s > fb.s THEN 2 ELSE 1 END AS INTEGER) AS reference FROM roles {joins}
  LEFT JOIN (SELECT media_id, start_ms AS s FROM {a} WHERE cue_idx = 0) fa USING (media_id) LEFT JOIN (SELECT media_id, start_ms AS s FROM {b} WHERE cue_idx = 0) fb USING (media_id))"""


sql("reference_track", "SELECT * FROM refs", LINES, TRACK_B, ROLES, HEAD3.format("a"), HEAD3.format("zh").replace("head3 AS", "head3b AS"), _ref(pref=True))
sql("merge_from_alignments", f"""SELECT p.media_id, a_idx AS idx1, b_idx AS idx2, CASE reference WHEN 1 THEN a.start_ms ELSE b.start_ms END AS start_ms, CASE reference WHEN 1 THEN a.end_ms ELSE b.end_ms END AS end_ms,
    a.text || {_NL} || b.text AS text, 'both' AS kind FROM best p JOIN a ON a.media_id = p.media_id AND a.cue_idx = a_idx JOIN zh b ON b.media_id = p.media_id AND b.cue_idx = b_idx JOIN refs r ON r.media_id = p.media_id
  UNION ALL SELECT media_id, cue_idx, NULL, start_ms, end_ms, text, 'first' FROM a WHERE (media_id, cue_idx) NOT IN (SELECT media_id, a_idx FROM best)
  UNION ALL SELECT media_id, NULL, cue_idx, start_ms, end_ms, text, 'second' FROM zh WHERE (media_id, cue_idx) NOT IN (SELECT media_id, b_idx FROM best)""", LINES, TRACK_B, _OVZ, BEST, ROLES, _ref())

# ---- filters, aggregates ------------------------------------------------------------------------
sql("text_tracks", f"SELECT media_id, rel_index, codec FROM tracks WHERE {_TEXTCODEC}", TRACKS)
sql("first_dialogue", """SELECT e.media_id, e.cue_idx AS src_idx, x.cue_idx AS ref_idx, e.start_ms - x.start_ms AS offset_ms, 0.8 AS confidence FROM
  (SELECT * FROM a WHERE cue_idx < 5 AND length(trim(text || ' what?')) > 20 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) = 1) e JOIN
  (SELECT * FROM zh WHERE cue_idx < 5 AND length(trim(text || '？')) > 5 QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY cue_idx) = 1) x ON e.media_id = x.media_id""", LINES, TRACK_B)
sql("mixed_scenario", """SELECT media_id, emb_zh, emb_en, CASE WHEN emb_en AND lang = 'fr' THEN 'english_embedded' WHEN emb_zh AND lang = 'en' THEN 'chinese_embedded' END AS scenario FROM (
  SELECT media_id, bool_or(contains(lower(language), 'chi') OR contains(lower(language), 'zh')) AS emb_zh, bool_or(contains(lower(language), 'eng') OR contains(lower(language), 'en')) AS emb_en
  FROM tracks WHERE source_type = 'embedded' GROUP BY 1) JOIN (SELECT doc_id AS media_id, lang FROM documents) USING (media_id)""", TRACKS)
sql("track_summary", """SELECT media_id, count(*) AS n_cues, min(start_ms) AS first_ms, max(end_ms) AS last_ms, max(end_ms) - min(start_ms) AS span_ms,
  arg_max(end_ms, cue_idx) AS final_end_ms, CAST(sum(end_ms - start_ms) AS BIGINT) AS shown_ms FROM track_a GROUP BY 1""", LINES)
sql("conv_summary", "SELECT conv_id AS media_id, role AS track, count(*) AS n_cues, min(turn) * 3000 AS first_ms, max(turn) * 3000 + 2500 AS last_ms FROM conversations GROUP BY 1, 2")
sql("forced_track", """SELECT media_id, n1, n2, CASE WHEN n1 / n2 < 0.1 THEN 'first' WHEN n2 / n1 < 0.1 THEN 'second' END AS forced
  FROM (SELECT media_id, count(DISTINCT cue_idx // 15) AS n1 FROM a GROUP BY 1) JOIN (SELECT media_id, count(*) AS n2 FROM same GROUP BY 1) USING (media_id)""", LINES, TRACK_B)


def _hit(words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(lower(title), w)))"


_F, _N, _P = _hit(tk.FORCED), _hit(tk.NEGATIVE), _hit(tk.POSITIVE)
sql("event_estimate", f"""SELECT media_id, rel_index, CAST(CASE WHEN is_forced THEN 25 WHEN {_F} > 0 THEN greatest(10, 30 - {_F} * 5) WHEN {_N} > 0 THEN greatest(15, 50 - {_N} * 10)
  WHEN {_P} > 0 THEN 450 WHEN is_default THEN 400 ELSE 350 END AS INTEGER) AS estimate FROM tracks""", TRACKS)
SCORED = f"""sc AS (SELECT *, event_score * 0.40 + title_score * 0.35 + content_score * 0.25 AS total_score FROM (SELECT *,
  CASE WHEN event_count <= 0 THEN 0.0 WHEN event_count < 80 THEN -0.8 WHEN event_count < 100 THEN -0.3 WHEN event_count >= 300 THEN 1.0 ELSE (event_count - 100) / 200 END::DOUBLE AS event_score,
  CASE WHEN title = '' THEN 0.0 WHEN {_F} + {_N} > 0 THEN -1.0 WHEN {_P} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS title_score,
  CASE WHEN is_forced THEN -0.8 WHEN {_F} > 0 THEN -0.9 WHEN {_hit(('full', 'complete', 'dialogue', 'dialog', 'main', 'primary'))} > 0 THEN 0.6
    WHEN {_hit(('signs', 'songs', 'karaoke', 'lyrics'))} > 0 THEN -0.7 ELSE 0.0 END::DOUBLE AS content_score FROM tracks)),
sd AS (SELECT *, total_score > 0.5 AND event_count >= 100 AND title_score >= -0.5 AS is_candidate FROM sc)"""
sql("track_score", """SELECT media_id, rel_index, event_count, round(event_score, 6) AS event_score, title_score, content_score, round(total_score, 6) AS total_score, is_candidate,
  CASE WHEN event_count <= 0 THEN 'no event count' WHEN event_count < 80 THEN 'few events' WHEN event_count < 100 THEN 'below dialogue minimum' WHEN event_count >= 300 THEN 'many events' ELSE 'moderate events' END || '; ' ||
  CASE WHEN title = '' THEN 'no title' WHEN title_score < 0 THEN 'negative title' WHEN title_score > 0 THEN 'positive title' ELSE 'neutral title' END AS reasoning FROM sd""", TRACKS, SCORED)
sql("track_rank", "SELECT media_id, rel_index, track_id, round(total_score, 6) AS total_score, CAST(row_number() OVER (PARTITION BY media_id ORDER BY total_score DESC, rel_index) AS INTEGER) AS rank FROM sd", TRACKS, SCORED)
_EN = "(lower(language) IN ('en', 'eng', 'english') OR contains(lower(title), 'en') OR (language = '' AND title = ''))"
sql("pick_dialogue", f"""SELECT media_id, track_id, round(total_score, 6) AS total_score FROM sd WHERE {_EN}
  QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY is_candidate DESC, CASE WHEN is_candidate THEN total_score ELSE event_count END DESC, total_score DESC, rel_index) = 1""", TRACKS, SCORED)
sql("pick_track", """SELECT media_id, track_id FROM (SELECT *, CASE WHEN lower(language) = 'jpn' THEN 1 WHEN lower(language) IN ('en', 'eng', 'english') OR contains(lower(title), 'en') THEN 2 END AS lvl FROM tracks)
  WHERE lvl IS NOT NULL QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY lvl, CASE WHEN lvl = 2 THEN is_forced END, CASE WHEN lvl = 2 THEN NOT is_default END, rel_index) = 1""", TRACKS)
_SL = f"""CASE WHEN regexp_matches(lower({_NAME}), '\\.(zh|chi|chs|cht|chinese)\\.|\\.zh-') THEN 'zh' WHEN regexp_matches(lower({_NAME}), '\\.(ja|jpn|japanese)\\.') THEN 'ja'
  WHEN regexp_matches(lower({_NAME}), '\\.(ko|kor|korean)\\.') THEN 'ko' WHEN regexp_matches(lower({_NAME}), '\\.(en|eng|english)\\.') THEN 'en' ELSE {_counts('text')} END"""
CHOICE = f"""choice AS (SELECT media_id, rel_index, sl AS subtitle_lang, {_LABEL} AS label FROM tracks JOIN (SELECT media_id, {_SL} AS sl FROM files) USING (media_id) WHERE {_TEXTCODEC}
  QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY coalesce((sl = 'zh' AND regexp_matches(lower(language), '^(chi|zho|zh)')) OR (sl = 'ja' AND regexp_matches(lower(language), '^(jpn|ja)'))
    OR (sl = 'ko' AND regexp_matches(lower(language), '^(kor|ko)')) OR (sl = 'en' AND regexp_matches(lower(language), '^(eng|en)')), false) DESC, rel_index) = 1)"""
sql("pick_sync_track", "SELECT * FROM choice", TRACKS, FILES, CHOICE)
REPORT = """rep AS (SELECT c.media_id, label AS track_used, coalesce(offset_ms, 0) AS offset_ms, -coalesce(offset_ms, 0) AS shift_ms, coalesce(votes, 0) AS match_count, coalesce(ne.n_ext, 0) AS total_compared,
  he.media_id IS NOT NULL AND ne.n_ext IS NOT NULL AS success, CASE WHEN he.media_id IS NULL THEN 'no embedded timestamps' WHEN ne.n_ext IS NULL THEN 'no external timestamps' WHEN coalesce(offset_ms, 0) = 0 THEN 'in sync' ELSE 'shift' END AS message
  FROM choice c LEFT JOIN vote v ON v.media_id = c.media_id LEFT JOIN ne ON ne.media_id = c.media_id LEFT JOIN (SELECT DISTINCT media_id FROM emb) he ON he.media_id = c.media_id)"""
_REP = (LINES, TRACK_B, EMB, VOTE, TRACKS, FILES, CHOICE, REPORT)
sql("sync_report", "SELECT * FROM rep", *_REP)


def _shifted(off: str) -> str:
    return f"greatest(start_ms + {off}, 0) AS start_ms, CASE WHEN start_ms + {off} < 0 THEN greatest(end_ms - start_ms, 0) ELSE end_ms + {off} END AS end_ms"


def _moved(off: str) -> str:
    return f"greatest(start_ms + {off}, 0) AS start_ms, greatest(end_ms + {off}, 0) AS end_ms"


sql("sync_cues", f"SELECT media_id, cue_idx, {_shifted('o')} FROM (SELECT s.*, coalesce(CASE WHEN success THEN shift_ms END, 0) AS o FROM same s LEFT JOIN rep USING (media_id))", *_REP)
sql("event_estimate_sample", "SELECT media_id, count(*) * 9 AS estimated_events FROM track_a WHERE start_ms < 600000 GROUP BY 1", LINES)
_S = _strip("text")


def _ind(*rules) -> str:
    return " + ".join(f"CASE WHEN {r} THEN {n} ELSE 0 END" for r, n in rules)


_DIA = _ind(("regexp_matches(t, '[.,!?]')", 2), ("len(list_filter(['i', 'you', 'we', 'they', 'he', 'she'], lambda w: contains(lower(t), w))) > 0", 1), ("nw > 5", 1), ("contains(t, '\"') OR contains(t, '''')", 2))
_FOR = _ind(("starts_with(t, '(') AND ends_with(t, ')')", 3), ("len(list_filter(['speaking', 'in ', 'language'], lambda w: contains(lower(t), w))) > 0", 2), ("nw <= 4", 1),
            ("len(list_filter(['alien', 'foreign', 'untranslated'], lambda w: contains(lower(t), w))) > 0", 2))
_SIG = _ind(("t = upper(t) AND t <> lower(t) AND length(t) > 3", 2), ("regexp_matches(t, '[♪♫♬]')", 3), ("starts_with(t, '[') AND ends_with(t, ']')", 2), ("nw <= 2 AND length(t) < 15", 1))
sql("content_score", f"""SELECT media_id, n, dialogue, signs, forced, round(CASE WHEN chars = 0 THEN 0.0 WHEN forced / n > 0.3 THEN -0.8 ELSE greatest(-1.0, least(1.0, (dialogue / n - signs / n - forced / n * 0.5) / 5.0)) END, 6) AS content_score FROM (
  SELECT media_id, count(*) AS n, sum(length(t)) AS chars, CAST(sum({_DIA}) AS BIGINT) AS dialogue, CAST(sum({_SIG}) AS BIGINT) AS signs, CAST(sum({_FOR}) AS BIGINT) AS forced FROM (
    SELECT media_id, t, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS nw FROM (SELECT media_id, {_S} AS t FROM styled)) GROUP BY 1)""", LINES, STYLED)
sql("is_bilingual", f"""SELECT media_id, bool_or(k = 'cjk') AS has_cjk, bool_or(k = 'latin') AS has_latin, bool_or(k = 'cjk') AND bool_or(k = 'latin') AS bilingual
  FROM (SELECT media_id, {_class('line')} AS k FROM (SELECT media_id, unnest({_LS}) AS line FROM styled)) GROUP BY 1""", LINES, STYLED)


def _sampled(src: str, out: str, even: bool | None) -> str:
    cond = "true" if even is None else "cue_idx % greatest(1, n // 10) = 0 AND cue_idx // greatest(1, n // 10) < 10" if even else "cue_idx < 10"
    return f"{out} AS (SELECT media_id, string_agg(text, ' ' ORDER BY cue_idx) AS smp FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM {src}) WHERE {cond} GROUP BY 1)"


sql("same_language", f"""SELECT media_id, {_lang('x.smp')} AS lang_a, {_lang('y.smp')} AS lang_b, ({_lang('x.smp')}) = ({_lang('y.smp')}) AND ({_lang('x.smp')}) <> 'unknown' AS same, 'even' AS rule FROM e1 x JOIN e2 y USING (media_id)
  UNION ALL SELECT media_id, {_lang('x.smp')}, {_lang('y.smp')}, ({_lang('x.smp')}) = ({_lang('y.smp')}) AND ({_lang('x.smp')}) <> 'unknown', 'first' FROM f1 x JOIN f2 y USING (media_id)
  UNION ALL SELECT media_id, {_lang('x.smp')}, {_lang('y.smp')}, ({_lang('x.smp')}) = ({_lang('y.smp')}) AND ({_lang('x.smp')}) <> 'unknown', 'all' FROM g1 x JOIN g2 y USING (media_id)""",
    LINES, TRACK_B, _sampled("a", "e1", True), _sampled("zh", "e2", True), _sampled("a", "f1", False), _sampled("same", "f2", False), _sampled("a", "g1", None), _sampled("same", "g2", None))
sql("font_size", """SELECT media_id, font_size, 'Style: Bilingual,Microsoft YaHei,' || font_size || ',&H00FFFFFF,&H000000FF,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,15,15,50,1' AS style_line
  FROM (SELECT doc_id AS media_id, CAST(greatest(40, (720 + 360 * (doc_id % 3)) * 48 // 1000) AS INTEGER) AS font_size FROM documents)""")

# ---- windows and order ---------------------------------------------------------------------------
sql("renumber", """SELECT media_id, cue_idx, s AS start_ms, CAST(row_number() OVER (PARTITION BY media_id ORDER BY s, cue_idx) AS INTEGER) AS seq
  FROM (SELECT media_id, cue_idx, (start_ms * 7919) % 600011 AS s FROM track_a)""", LINES)
sql("anti_jitter", """SELECT media_id, arg_min(cue_idx, r) AS cue_idx, arg_min(start_ms, r) AS start_ms, arg_max(end_ms, r) AS end_ms, arg_min(text, r) AS text, count(*) AS n_joined FROM (
  SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY r) AS g FROM (
    SELECT *, row_number() OVER w AS r, CASE WHEN text = lag(text) OVER w AND start_ms - lag(end_ms) OVER w <= 100 THEN 0 ELSE 1 END AS f FROM halves WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_idx))) GROUP BY media_id, g""", LINES,
    """halves AS (SELECT media_id, cue_idx * 2 AS cue_idx, start_ms, (start_ms + end_ms) // 2 AS end_ms, text FROM track_a UNION ALL
  SELECT media_id, cue_idx * 2 + 1, (start_ms + end_ms) // 2 + CASE WHEN cue_idx % 3 = 0 THEN 150 ELSE 50 END, end_ms, text FROM track_a)""")
sql("even_sample", "SELECT media_id, cue_idx FROM (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM track_a) WHERE cue_idx % greatest(1, n // least(20, n)) = 0 AND cue_idx // greatest(1, n // least(20, n)) < 20", LINES)
sql("rel_pos", "SELECT media_id, cue_idx, round(cue_idx / greatest(1, max(cue_idx) OVER (PARTITION BY media_id)), 6) AS pos FROM track_a", LINES)
sql("preview", f"SELECT media_id, cue_idx, {_time('start_ms', 'vtt')} || ' --> ' || {_time('end_ms', 'vtt')} AS time_range, CASE WHEN length(text) > 100 THEN text[:100] || '...' ELSE text END AS text FROM track_a WHERE cue_idx < 5", LINES)

# ---- jobs ---------------------------------------------------------------------------------------
on_a("shift", _shifted("(media_id % 7 - 3) * 2500"))
on_a("shift_by_media", _shifted("(CASE WHEN media_id % 4 < 2 THEN -2470 ELSE 0 END)"))
on_a("apply_offset", _moved("(media_id % 7 - 3) * 2500"))
sql("shift_first_to", f"SELECT media_id, cue_idx, {_shifted('o')} FROM (SELECT *, 50983 - first_value(start_ms) OVER (PARTITION BY media_id ORDER BY cue_idx) AS o FROM same)", LINES, TRACK_B)
sql("realign", f"SELECT media_id, cue_idx, {_moved('o')} FROM (SELECT b.*, sb - sa AS o FROM same b JOIN scan s ON s.media_id = b.media_id AND b.cue_idx >= s.a_idx)", LINES, TRACK_B, _scan(10, 2000, "same", "a"))
sql("batch_align", f"SELECT media_id, cue_idx, {_moved('o')} FROM (SELECT b.*, f.start_ms - g.start_ms AS o FROM same b JOIN a f ON f.media_id = b.media_id AND f.cue_idx = 0 JOIN same g ON g.media_id = b.media_id AND g.cue_idx = 0)", LINES, TRACK_B)
sql("manual_sync", f"""SELECT media_id, track, cue_idx, {_moved('o')} FROM (SELECT a.*, 1 AS track, CASE WHEN ref = 2 THEN bs - sa ELSE 0 END AS o FROM a JOIN mp USING (media_id) WHERE cue_idx >= ai
  UNION ALL SELECT s.*, 2, CASE WHEN ref = 1 THEN sa - bs ELSE 0 END FROM same s JOIN mp USING (media_id) WHERE cue_idx >= bi)""", LINES, TRACK_B,
    """mp AS (SELECT d.doc_id AS media_id, d.doc_id % 3 AS ai, d.doc_id % 2 AS bi, d.doc_id % 2 + 1 AS ref, a.start_ms AS sa, b.start_ms AS bs FROM documents d
  JOIN a ON a.media_id = d.doc_id AND a.cue_idx = d.doc_id % 3 JOIN same b ON b.media_id = d.doc_id AND b.cue_idx = d.doc_id % 2)""")
sql("global_sync", f"""SELECT media_id, track, cue_idx, {_moved('o')} FROM (
  SELECT a.*, 1 AS track, CASE WHEN reference = 2 AND abs(d) > 100 THEN -d ELSE 0 END AS o FROM a LEFT JOIN gp USING (media_id) UNION ALL
  SELECT s.*, 2, CASE WHEN reference = 1 AND abs(d) > 100 THEN d ELSE 0 END FROM same s LEFT JOIN gp USING (media_id))""", LINES, TRACK_B, ROLES, _ref("a", "same"), FIRST,
    "gp AS (SELECT r.media_id, r.reference, coalesce(d, 0) AS d FROM refs r LEFT JOIN fl USING (media_id))")
sql("split_bilingual", f"""SELECT media_id, side, cue_idx, start_ms, end_ms, string_agg(line, {_NL} ORDER BY i) AS text FROM (
  SELECT *, {_class('line')} AS k FROM (SELECT media_id, cue_idx, start_ms, end_ms, i, regexp_replace({_strip('l')}, '<[^>]+>', '', 'g') AS line FROM (
    SELECT media_id, cue_idx, start_ms, end_ms, unnest({_LS}) AS l, generate_subscripts({_LS}, 1) AS i FROM styled)) WHERE {_strip('line')} <> '')
  JOIN (SELECT unnest(['cjk', 'latin']) AS side) ON k = side OR k = 'other' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY media_id, side, cue_idx, start_ms, end_ms"), LINES, STYLED)
sql("input_roles", f"""SELECT media_id, CASE WHEN s0 = 'f' THEN n0 ELSE n1 END AS foreign_input, CASE WHEN s0 = 'f' THEN n1 ELSE n0 END AS english_input FROM (
  SELECT media_id, {_NAME} AS n0, video_stem || CASE WHEN media_id % 2 = 0 THEN '.zh.srt' ELSE '.srt' END AS n1, CASE WHEN {_RESOLVED} = 'en' THEN 'e' ELSE 'f' END AS s0 FROM files)""", FILES)
sql("ass_to_srt", f"""SELECT media_id, seq, seq || {_NL} || s || ' --> ' || e || {_NL} || text || {_NL} AS block FROM (SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY o, cue_idx) AS INTEGER) AS seq FROM (
  SELECT media_id, cue_idx, start_ms AS o, {_time('start_ms')} AS s, {_time('end_ms')} AS e, array_to_string(list_concat(list_filter(string_split(c, {_NL}), lambda x: regexp_matches(x, '{tx.CJK_LINE}')),
    list_filter(string_split(c, {_NL}), lambda x: NOT regexp_matches(x, '{tx.CJK_LINE}'))), {_NL}) AS text FROM (SELECT *, {_ASSCLEAN} AS c FROM ass) WHERE c <> ''
  UNION ALL SELECT media_id, count(*), 0, '00:00:00,000', '00:00:01,000', 'bad time' FROM ass GROUP BY media_id))""", LINES, ASS)

# ---- streaming ------------------------------------------------------------------------------------
FEED = "feed AS (SELECT user_id AS media_id, ts, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + CAST(trunc(value * 10) AS BIGINT) AS end_ms, event_type AS text, value FROM events)"
sql("stream_dedup", "SELECT DISTINCT media_id, start_ms, end_ms, text FROM feed QUALIFY row_number() OVER (PARTITION BY media_id, (start_ms + 5) // 10, (end_ms + 5) // 10, text ORDER BY start_ms) = 1", FEED)
sql("stream_time_join", """SELECT a.media_id, a.start_ms AS ms_a, a.text AS text_a, b.start_ms AS ms_b, b.text AS text_b FROM (SELECT * FROM feed WHERE text NOT IN ('purchase', 'error')) a
  LEFT JOIN feed b ON a.media_id = b.media_id AND b.text IN ('purchase', 'error') AND b.ts BETWEEN a.ts - INTERVAL 600000 MILLISECONDS AND a.ts + INTERVAL 600000 MILLISECONDS""", FEED)
sql("stream_drift", """SELECT media_id, epoch_us(h) // 1000 AS window_ms, count(*) AS n, max(v) AS max_ms, quantile_disc(v, 0.5) AS median_ms
  FROM (SELECT *, date_trunc('hour', ts) AS h, CAST(trunc(value * 10) AS BIGINT) AS v FROM feed) GROUP BY media_id, h""", FEED)
sql("stream_sessions", """SELECT media_id, epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n_cues FROM (
  SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY ts) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY media_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM feed))
  GROUP BY media_id, g""", FEED)
