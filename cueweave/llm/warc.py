"""Not-modified revisits of a crawl archive, resolved to the responses they stand for.

A revisit (status 304) belongs to the latest earlier full response of the same
canonical URL. That is an as-of join: responses and revisits are put in one time
order per URL and the last response is carried on. URLs are cut into time spans
(``SPAN_SECONDS``); a window runs inside a span, and one summary row per span
(its last response) is carried across, so a URL that owns a large share of the
archive is spread over its spans. Only keys, validators and headers are moved,
never bodies; ``attach_bodies`` joins those by record id where they are wanted.

Validators: a revisit with an ETag must agree with the response's (weak
comparison); one without, with a Last-Modified, must agree on that; one with
neither is taken. The header fields that a 304 may update (``UPDATES``) replace
the stored ones, all others stay as the response had them.

Records: ``record_id, url, ts`` (seconds), ``status, headers`` (map, names in
any case), ``body_digest, body_length``.

Defined results: one row per revisit. A null URL or time is never resolved
(``no_response``); a response at the very same second isn't earlier; of
responses in one second the largest record id counts; null headers are none;
rows that repeat come out as often as they stand; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_SECONDS = 86_400
#: Header fields that a 304 may update, and query parameters that don't name a page.
UPDATES = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"
_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"


def canonical_url(url: Column) -> Column:
    """Host (lower case, no ``www.``, no default port), path without a slash at its end, sorted parameters; no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), _SCHEME, "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case alone the last."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    last = F.aggregate(
        entries, F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )
    return last


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, span: int = SPAN_SECONDS) -> DataFrame:
    """``record_id, url_key, ts, outcome, response_id, body_digest, body_length, headers`` of every revisit.

    ``outcome``: ``resolved``, ``no_response`` or ``validator_mismatch`` (then the rest is null but for the revisit's own headers).
    """
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("status") == 200).alias("full"),
        lower_names(F.col("headers")).alias("headers"), "body_digest", "body_length",
    )
    can = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    stored = F.struct("ts", "record_id", "headers", "body_digest", "body_length")
    known = rows.where(can).withColumn("span", F.floor(F.col("ts") / span)).withColumn("stored", F.when(F.col("full"), stored))
    # Revisits of a second come before its responses, so "before this row" means earlier.
    inside = Window.partitionBy("url_key", "span").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last("stored", ignorenulls=True).over(inside)).where(~F.col("full")).drop("stored", "full")
    order = F.struct("ts", "record_id")
    spans = known.groupBy("url_key", "span").agg(F.max_by("stored", F.when(F.col("full"), order)).alias("stored"))
    across = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("far", F.last("stored", ignorenulls=True).over(across)).drop("stored")
    nothing = F.lit(None).cast(known.schema["stored"].dataType)
    found = near.join(carried, ["url_key", "span"]).withColumn("from", F.coalesce("near", "far")).drop("near", "far", "span")
    rest = rows.where(~can & ~F.col("full")).drop("full").withColumn("from", nothing)
    every = found.unionByName(rest)
    mine, theirs = F.col("headers"), F.col("from.headers")
    agrees = (
        F.when(mine["etag"].isNotNull(), F.coalesce(_weak(mine["etag"]) == _weak(theirs["etag"]), F.lit(False)))
        .when(mine["last-modified"].isNotNull(), F.coalesce(mine["last-modified"] == theirs["last-modified"], F.lit(False)))
        .otherwise(F.lit(True))
    )
    outcome = F.when(F.col("from").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(mine, lambda k, _: k.isin(*UPDATES))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    done = every.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return done.select(
        "record_id", "url_key", "ts", "outcome", F.when(good, F.col("from.record_id")).alias("response_id"),
        F.when(good, F.col("from.body_digest")).alias("body_digest"), F.when(good, F.col("from.body_length")).alias("body_length"),
        F.when(good, merged).otherwise(mine).alias("headers"),
    )


def attach_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the ``body`` of its response; ``bodies``: ``record_id, body``."""
    return resolved.join(bodies.select(F.col("record_id").alias("response_id"), "body"), "response_id", "left")


def header_lines(headers: Column) -> Column:
    """``name: value`` lines, sorted."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")


# ---- an archive from the pages table ------------------------------------------------

#: A page is fetched again and again, some ten hours apart.
STEP = 36_000


def archive(pages: DataFrame) -> DataFrame:
    """Records of a crawl over ``pages``.

    Every page has a response, a revisit before it, and two after it under an
    equivalent URL; every third page has changed between those two. Of the last
    revisits, each fifth has an ETag of another version and each seventh no ETag.
    """
    page, url = F.col("page_id"), F.col("url")
    version = lambda text: F.concat(F.lit('"'), F.md5(text), F.lit('"'))
    html = F.coalesce(F.col("html"), F.lit(""))
    changed = F.concat(html, F.lit("<!-- changed -->"))
    start = page * 60
    day = F.concat(F.lit("day "), start.cast("string"))
    third = page % 3 == 0

    def record(number, ts, status, address, headers, text=None):
        return F.struct(
            (page * 8 + number).alias("record_id"), address.alias("url"), ts.alias("ts"), F.lit(status).alias("status"),
            F.map_from_arrays(F.array(*[F.lit(k) for k in headers]), F.array(*headers.values())).alias("headers"),
            (F.md5(text) if text is not None else F.lit(None).cast("string")).alias("body_digest"),
            (F.octet_length(text) if text is not None else F.lit(None)).cast("long").alias("body_length"),
        )

    def response(number, ts, text):
        return record(number, ts, 200, url, {
            "Content-Type": F.lit("text/html"), "Content-Length": F.octet_length(text).cast("string"), "Date": ts.cast("string"),
            "ETag": version(text), "Last-Modified": day,
        }, text)

    def revisit(number, ts, address, etag):
        return record(number, ts, 304, address, {
            "Date": ts.cast("string"), "ETag": etag, "Last-Modified": day, "Cache-Control": F.lit("max-age=60"), "Content-Length": F.lit("0"),
        })

    other = F.concat(F.regexp_replace(url, "#.*$", ""), F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_medium=x#part"))
    last = (
        F.when(page % 5 == 0, F.lit('"other"')).when(page % 7 == 0, F.lit(None).cast("string"))
        .when(third, version(changed)).otherwise(F.concat(F.lit("W/"), version(html)))
    )
    records = F.array(
        revisit(0, start - 1, url, version(html)), response(1, start, html), revisit(2, start + STEP, other, version(html)),
        F.when(third, response(3, start + 2 * STEP, changed)), revisit(4, start + 3 * STEP, other, last),
    )
    rows = pages.select(F.explode(records).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return rows.withColumn("headers", F.map_filter("headers", lambda _, v: v.isNotNull()))
