"""Scoring and choosing tracks, pairing files, mixed-source tests.

The tracks and files of one media are few; every choice is a grouped
``min_by`` / ``max_by`` on a total order, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.language import (
    EXTERNAL_PATTERNS, base_name, detect_lang, lang_from_name, sync_lang,
)
from cueweave.sources.manifest import is_text_codec, track_label

# Title fragments by meaning, and the event-count thresholds.
NEGATIVE = (
    "signs", "songs", "commentary", "sdh", "cc", "closed caption", "hearing impaired", "full",
    "complete", "director", "cast", "crew", "karaoke", "lyrics", "opening", "ending", "op", "ed",
    "insert", "background", "bgm", "sfx", "sound effects", "narrator",
)
FORCED = (
    "forced", "forced english", "forced eng", "foreign", "foreign only", "foreign dialogue",
    "foreign parts", "non-english", "alien language", "foreign language", "parts only", "foreign parts only",
)
POSITIVE = (
    "dialogue", "dialog", "main", "primary", "default", "regular", "standard", "normal",
    "full dialogue", "conversation", "english dialogue", "eng dialogue", "full english", "complete english",
)
MIN_DIALOGUE, TYPICAL_DIALOGUE, SIGNS_MAX = 100, 300, 80


def _hits(title: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(title, F.lit(w)).cast("int")
    return total


def _lower(col: str) -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit("")))


def event_estimate() -> Column:
    """Expected number of events from title and flags alone."""
    title = _lower("title")
    forced, negative = _hits(title, FORCED), _hits(title, NEGATIVE)
    return (
        F.when(F.col("is_forced"), 25)
        .when(forced > 0, F.greatest(F.lit(10), 30 - forced * 5))
        .when(negative > 0, F.greatest(F.lit(15), 50 - negative * 10))
        .when(_hits(title, POSITIVE) > 0, 450)
        .when(F.col("is_default"), 400).otherwise(350)
    )


def event_estimate_from_sample(cues: DataFrame, sample_ms: int = 600_000) -> DataFrame:
    """Nine times the cues that start in the first ten minutes."""
    return cues.where(F.col("start_ms") < sample_ms).groupBy("media_id").agg(
        (F.count("*") * 9).alias("estimated_events")
    )


def event_score(count: Column) -> Column:
    return (
        F.when(count <= 0, 0.0).when(count < SIGNS_MAX, -0.8).when(count < MIN_DIALOGUE, -0.3)
        .when(count >= TYPICAL_DIALOGUE, 1.0)
        .otherwise((count - MIN_DIALOGUE) / float(TYPICAL_DIALOGUE - MIN_DIALOGUE))
    )


def title_score() -> Column:
    title = _lower("title")
    return (
        F.when(title == "", 0.0)
        .when((_hits(title, FORCED) > 0) | (_hits(title, NEGATIVE) > 0), -1.0)
        .when(_hits(title, POSITIVE) > 0, 1.0).otherwise(0.0)
    )


def metadata_content_score() -> Column:
    title = _lower("title")
    return (
        F.when(F.col("is_forced"), -0.8).when(_hits(title, FORCED) > 0, -0.9)
        .when(_hits(title, ("full", "complete", "dialogue", "dialog", "main", "primary")) > 0, 0.6)
        .when(_hits(title, ("signs", "songs", "karaoke", "lyrics")) > 0, -0.7).otherwise(0.0)
    )


def track_scores(tracks: DataFrame) -> DataFrame:
    """Score every track; ``event_count`` and ``content_score`` columns are used where present."""
    counted = "event_count" in tracks.columns
    measured = "content_score" in tracks.columns
    count = F.coalesce(F.col("event_count"), event_estimate()) if counted else event_estimate()
    content = F.coalesce(F.col("content_score"), metadata_content_score()) if measured else metadata_content_score()
    scored = tracks.withColumn("event_count", count).withColumns({
        "event_score": event_score(F.col("event_count")), "title_score": title_score(), "content_score": content,
    })
    total = F.col("event_score") * 0.40 + F.col("title_score") * 0.35 + F.col("content_score") * 0.25
    scored = scored.withColumn("total_score", total)
    candidate = (F.col("total_score") > 0.5) & (F.col("event_count") >= MIN_DIALOGUE) & (F.col("title_score") >= -0.5)
    reason_events = (
        F.when(F.col("event_count") <= 0, "no event count").when(F.col("event_count") < SIGNS_MAX, "few events")
        .when(F.col("event_count") < MIN_DIALOGUE, "below dialogue minimum")
        .when(F.col("event_count") >= TYPICAL_DIALOGUE, "many events").otherwise("moderate events")
    )
    reason_title = (
        F.when(_lower("title") == "", "no title").when(F.col("title_score") < 0, "negative title")
        .when(F.col("title_score") > 0, "positive title").otherwise("neutral title")
    )
    return scored.withColumn("is_candidate", candidate).withColumn("reasoning", F.array(reason_events, reason_title))


def track_rank(scored: DataFrame) -> DataFrame:
    """``rank`` within the media by total score, ties in track order.

    Computed inside an array of the media's few tracks.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("total_score")).alias("s"), "rel_index", "track_id", "total_score")))
    return scored.groupBy("media_id").agg(order.alias("o")).select(
        "media_id", F.posexplode("o").alias("p", "t")
    ).select("media_id", "t.rel_index", "t.track_id", "t.total_score", (F.col("p") + 1).alias("rank"))


def _first(tracks: DataFrame, *order: Column) -> DataFrame:
    """The first track of each media by the given order, then by position."""
    rest = [c for c in tracks.columns if c != "media_id"]
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.col("rel_index"))
    return tracks.groupBy("media_id").agg(F.min_by(F.struct(*rest), key).alias("t")).select("media_id", "t.*")


def text_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.where(is_text_codec(F.col("codec")))


def pick_track(tracks: DataFrame, codes: list[str], prefer: str | None = None, remap: str | None = None) -> DataFrame:
    """Requested id, else remapped language, else language match (code or title), non-forced and default first."""
    lang = _lower("language")
    hit = lang.isin(*codes) | (_hits(_lower("title"), tuple(codes)) > 0)
    asked = F.col("track_id") == F.lit(prefer) if prefer is not None else F.lit(False)
    mapped = lang == remap.lower() if remap else F.lit(False)
    level = F.when(asked, 0).when(mapped, 1).when(hit, 2)
    marked = tracks.withColumn("_level", level).where("_level is not null")
    by_rule = F.col("_level") == 2
    forced = F.when(by_rule & F.col("is_forced"), 1).otherwise(0)
    default = F.when(by_rule & ~F.col("is_default"), 1).otherwise(0)
    return _first(marked, F.col("_level"), forced, default).drop("_level")


def pick_dialogue(tracks: DataFrame, prefer: str | None = None) -> DataFrame:
    """Best English dialogue track: candidates by score, else the track with most events."""
    codes = ("en", "eng", "english")
    untagged = (_lower("language") == "") & (_lower("title") == "")
    english = _lower("language").isin(*codes) | (_hits(_lower("title"), codes) > 0) | untagged
    asked = F.col("track_id") == F.lit(prefer) if prefer is not None else F.lit(False)
    scored = track_scores(tracks).where(english | asked)
    level = F.when(asked, 0).when(F.col("is_candidate"), 1).otherwise(2)
    by_score = F.when(F.col("is_candidate"), -F.col("total_score")).otherwise(-F.col("event_count"))
    # Equal event counts fall back to the better score, the order the candidates were listed in.
    return _first(scored, level, by_score, -F.col("total_score"))


def pick_sync_track(tracks: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Text track in the language of the external subtitle, else the first text track.

    ``subtitles`` is ``media_id, name, text``.
    """
    lang = subtitles.select("media_id", sync_lang(F.col("name"), F.col("text")).alias("_lang"))
    tag = _lower("language")
    # Tag prefixes per detected language.
    prefixes = {"zh": "^(?:chi|zho|zh)", "ja": "^(?:jpn|ja)", "ko": "^(?:kor|ko)", "en": "^(?:eng|en)"}
    hit = F.lit(False)
    for code, pattern in prefixes.items():
        hit = hit | ((F.col("_lang") == code) & tag.rlike(pattern))
    joined = text_tracks(tracks).join(lang, "media_id").withColumn("_hit", F.coalesce(hit, F.lit(False)))
    out = _first(joined, F.when(F.col("_hit"), 0).otherwise(1))
    return out.withColumn(
        "label", track_label(F.col("rel_index"), F.col("language"), F.col("title"), F.col("codec"))
    ).withColumnRenamed("_lang", "subtitle_lang").drop("_hit")


def mixed_scenario(tracks: DataFrame, external: DataFrame) -> DataFrame:
    """``media_id, mixed``: an embedded English (Chinese) track meets an external file of the other language.

    ``external`` is ``media_id, has_chinese, has_english``.
    """
    lang = _lower("language")
    embedded = tracks.where("source_type = 'embedded'").groupBy("media_id").agg(
        F.bool_or(F.contains(lang, F.lit("chi")) | F.contains(lang, F.lit("zh"))).alias("emb_zh"),
        F.bool_or(F.contains(lang, F.lit("eng")) | F.contains(lang, F.lit("en"))).alias("emb_en"),
    )
    kind = F.when(F.col("emb_en") & F.col("has_chinese"), "english_embedded").when(
        F.col("emb_zh") & F.col("has_english"), "chinese_embedded"
    )
    return embedded.join(external, "media_id").select("media_id", "emb_zh", "emb_en", kind.alias("scenario"))


def in_directory(files: DataFrame) -> DataFrame:
    """Files pair inside their ``directory``; a table without that column is one directory."""
    return files if "directory" in files.columns else files.withColumn("directory", F.lit(""))


def pair_files(sources: DataFrame, references: DataFrame) -> DataFrame:
    """``directory, base, source, reference`` on the suffix-stripped stem; the last reference of a base wins.

    Both inputs have ``stem, path`` and ``directory`` where files lie in
    several. References are reduced to one per base before the join, so no base
    multiplies rows.
    """
    key = ["directory", "base"]
    refs = in_directory(references).groupBy("directory", base_name(F.col("stem")).alias("base")).agg(F.max("path").alias("reference"))
    return in_directory(sources).select("directory", base_name(F.col("stem")).alias("base"), F.col("path").alias("source")).join(refs, key)


def pair_by_extension(files: DataFrame, source_ext: str, reference_ext: str) -> DataFrame:
    """``source, reference`` where replacing one ending of the path by the other gives an existing file."""
    left = files.where(F.col("path").endswith(source_ext)).select(
        F.col("path").alias("source"),
        F.concat(F.expr(f"left(path, length(path) - {len(source_ext)})"), F.lit(reference_ext)).alias("reference"),
    )
    return left.join(files.select(F.col("path").alias("reference")).distinct(), "reference", "left_semi").select("source", "reference")


def pair_prefix(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """First subtitle (by name) of the directory whose stem is the video stem or starts with it and a dot.

    ``videos`` has ``media_id, stem``, ``subtitles`` ``name, stem``, both
    ``directory`` where files lie in several. A subtitle stem is expanded to its
    own dot-separated prefixes, which makes the prefix test an equi-join.
    """
    parts = F.split(F.lower("stem"), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )
    expanded = in_directory(subtitles).select("directory", "name", F.explode(prefixes).alias("_stem"))
    first = expanded.groupBy("directory", "_stem").agg(F.min("name").alias("subtitle"))
    return in_directory(videos).withColumn("_stem", F.lower("stem")).join(first, ["directory", "_stem"]).select(
        "media_id", "directory", "stem", "subtitle"
    )


def pick_external(videos: DataFrame, subtitles: DataFrame, language: str, head: int | None = None) -> DataFrame:
    """Shortest subtitle name of the directory that starts with the video stem and carries a language fragment.

    Without one, the plain ``stem.ext`` file if its content is in the
    language. ``videos``: ``media_id, stem``; ``subtitles``: ``stem, ext, text``;
    both ``directory`` where files lie in several. ``head`` limits the
    characters that the language is read from (the single-machine rule: 4096).

    A file name is cut to the lengths that video stems of its directory have
    (at most 255), which makes the prefix test an equi-join that no popular
    prefix can skew: each prefix is reduced to its best file before the join.
    """
    code = {"chinese": "zh", "english": "en"}[language]
    name = F.concat_ws(".", "stem", "ext")
    fragment = _hits(F.lower(F.col("name")), EXTERNAL_PATTERNS[language]) > 0
    videos = in_directory(videos)
    lengths = videos.groupBy("directory").agg(F.collect_set(F.length("stem")).alias("_lengths"))
    by_ext = F.array_position(F.array(*[F.lit(e) for e in ("srt", "ass", "ssa", "vtt")]), F.col("ext"))
    listed = in_directory(subtitles).where(F.col("ext").isin("srt", "ass", "ssa", "vtt")).withColumn("name", name)
    fits = F.filter("_lengths", lambda n: n <= F.length("name"))
    tagged = listed.where(fragment).select("directory", "name", "ext").join(lengths, "directory").select(
        "directory", "name", "ext", F.explode(F.transform(fits, lambda n: F.left(F.col("name"), n))).alias("_stem"), F.lit(0).cast("bigint").alias("_level")
    )
    # The text is only read for files that are candidates by name.
    stems = videos.select("directory", "stem").distinct()
    text = F.col("text") if head is None else F.substring("text", 1, head)
    plain = listed.join(stems, ["directory", "stem"], "left_semi").where(detect_lang(text) == code).select(
        "directory", "name", "ext", F.col("stem").alias("_stem"), by_ext.alias("_level")
    )
    order = F.struct("_level", F.length("name").alias("n"), "name")
    best = tagged.unionByName(plain).groupBy("directory", "_stem").agg(F.min_by(F.struct("name", "_level"), order).alias("p"))
    return videos.withColumn("_stem", F.col("stem")).join(best, ["directory", "_stem"]).select(
        "media_id", "directory", "stem", F.col("p.name").alias("subtitle"), (F.col("p._level") > 0).alias("by_content")
    )


def external_subtitles(videos: DataFrame, subtitles: DataFrame) -> DataFrame:
    """Files of the video's directory named its stem plus one of the known endings: ``media_id, directory, name``."""
    # Endings looked for next to a video.
    plain = ["srt", "ass", "ssa", "vtt"]
    tagged = [f"{t}.{e}" for t in ("zh", "chi", "en", "eng", "ja", "jpn", "ko", "kor") for e in ("srt", "ass")]
    wanted = in_directory(videos).select("media_id", "directory", "stem", F.explode(F.array(*[F.lit(x) for x in plain + tagged])).alias("_e")).select(
        "media_id", "directory", F.concat_ws(".", "stem", "_e").alias("name")
    )
    have = in_directory(subtitles).select("directory", F.concat_ws(".", "stem", "ext").alias("name")).distinct()
    return wanted.join(have, ["directory", "name"], "left_semi")


def file_language(name: Column, text: Column, head: int | None = None) -> Column:
    """Name first, then content (its first ``head`` characters, or all); used for input roles."""
    part = text if head is None else F.substring(text, 1, head)
    return F.coalesce(F.nullif(lang_from_name(name), F.lit("unknown")), detect_lang(part))
