"""Probe manifests (JSON) as track rows and packet times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codecs whose packets are text cues.
TEXT_CODECS = ("subrip", "ass", "ssa", "webvtt", "srt", "mov_text")

_STREAMS = (
    "streams array<struct<index:int,codec_name:string,codec_type:string,"
    "tags:map<string,string>,disposition:map<string,int>>>"
)
_PACKETS = "packets array<struct<pts_time:string>>"


def is_text_codec(codec: Column) -> Column:
    return F.lower(codec).isin(*TEXT_CODECS)


def _tag(name: str) -> Column:
    """Value of a tag whose key matches in any case; the last one wins."""
    found = F.filter(F.map_entries("s.tags"), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def tracks(manifests: DataFrame) -> DataFrame:
    """One row per subtitle stream of ``media_id, manifest`` rows."""
    subs = F.filter(
        F.from_json("manifest", _STREAMS)["streams"],
        lambda s: F.coalesce(s["codec_type"], F.lit("subtitle")) == "subtitle",
    )

    def flag(name: str) -> Column:
        return F.coalesce(F.try_element_at("s.disposition", F.lit(name)) == 1, F.lit(False))

    return manifests.select("media_id", F.posexplode(subs).alias("rel_index", "s")).select(
        "media_id", "rel_index", F.coalesce("s.index", "rel_index").cast("string").alias("track_id"),
        F.coalesce("s.codec_name", F.lit("unknown")).alias("codec"),
        _tag("language").alias("language"), _tag("title").alias("title"),
        flag("default").alias("is_default"), flag("forced").alias("is_forced"),
        F.coalesce(is_text_codec(F.col("s.codec_name")), F.lit(False)).alias("is_text"),
    )


def packet_times(manifests: DataFrame, window_ms: int | None = None) -> DataFrame:
    """``media_id, emb_ms``: distinct packet times (before ``window_ms``, where given)."""
    packets = F.from_json("manifest", _PACKETS)["packets"]
    ms = (F.col("p.pts_time").try_cast("decimal(20,6)") * 1000).cast("bigint")
    return (
        manifests.select("media_id", F.explode(packets).alias("p"))
        .select("media_id", ms.alias("emb_ms"))
        .where(F.col("emb_ms").isNotNull() if window_ms is None else F.col("emb_ms") < window_ms)
        .dropDuplicates()
    )


def track_label(rel_index: Column, language: Column, title: Column, codec: Column) -> Column:
    """``s:5 chi Chinese (ass)``; empty parts are left out."""
    return F.concat_ws(
        " ", F.concat(F.lit("s:"), rel_index.cast("string")), F.nullif(language, F.lit("")),
        F.nullif(title, F.lit("")), F.concat(F.lit("("), codec, F.lit(")")),
    )


def track_text(track_id: Column, language: Column, title: Column, codec: Column, default: Column, forced: Column) -> Column:
    """``<Track 3 lang=eng title='Main' subrip default>``."""
    body = F.concat_ws(
        " ", F.concat(F.lit("Track "), track_id),
        F.when(language != "", F.concat(F.lit("lang="), language)),
        F.when(title != "", F.concat(F.lit("title='"), title, F.lit("'"))),
        F.nullif(codec, F.lit("")), F.when(default, "default"), F.when(forced, "forced"),
    )
    return F.concat(F.lit("<"), body, F.lit(">"))
