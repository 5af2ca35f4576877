"""Not-modified revisits of a web archive, resolved to the response they stand for.

A capture is a full response or a revisit that a server answered with 304.  A revisit belongs to the latest
earlier full response of the same canonical URL: an as-of join.  Captures are dealt in ranges of (URL, time,
kind, id), so each range is a chunk of about equal size and a URL with a third of all captures, even within
one second, is spread over a third of the chunks.  The last response of each chunk, a narrow row per (URL,
chunk) made by partial aggregates, is carried to the head of the URL's next chunks, so a chunk is complete
by itself: an ordered window over it finds the response of every revisit.  No join by URL takes place.

A resolved revisit is ``verified`` if its validators (entity tag, compared weakly; last modification; payload
digest) that both captures have agree and there is one at least, ``conflict`` if any disagrees,
``unverified`` if there is none; without an earlier response it is ``orphan``.  Conflicts keep the id of the
response they were compared with, but take nothing from it.  Of the headers, those that a 304 may bring
anew replace the response's; others of the revisit are dropped.

Canonical URLs: lower-case host without ``www.`` and default port, no fragment, no tracking parameters,
parameters sorted, no index page, no closing slash; http and https are one.

Defined cases: a null or empty URL is the empty one and never resolves; a null time is before all others; of
captures of one time the response comes first, then the lesser id; repeated rows resolve alike; null headers
are empty; names of headers are lower-cased and the last of equal names counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolwise.llm.staging import stage

#: Headers that a not-modified answer may update (HTTP caching), and parameters that only track.
UPDATABLE = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary", "via", "warning")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "sessionid", "phpsessid")
#: Columns of captures.
CAPTURE = "record_id long, url string, at timestamp, status int, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    part = lambda k: F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_replace(part(2), r"/(index|default)\.(html?|php|aspx?)$", "/"), r"/+$", "")
    kept = F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host == "", "").otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _folded(headers: Column) -> Column:
    """Names in lower case, as a map; the last of equal names counts."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), last(n).alias("value"))))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.try_element_at(headers, F.lit("etag"))), "^[wW]/", "")


def _same(a: Column, b: Column) -> Column:
    """True, false, or null where either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def resolve_revisits(captures: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row per revisit (status 304): ``record_id, canonical, response_id, response_at, state, headers, digest``.

    ``headers`` are the response's with what the revisit may update, ``digest`` is the response's.  ``chunks``
    fixes the number of ranges; by default it follows the session's shuffle partitions and the data's size.
    """
    folded = _folded(F.col("headers"))
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "at", (F.col("status") == 304).alias("revisit"), folded.alias("headers"), "digest",
    ).where(F.col("revisit") | F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    rows = rows.withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    # captures without a URL stand alone
    key = F.when(F.col("canonical") == "", F.concat(F.lit("\x00"), F.coalesce(F.col("record_id").cast("string"), F.lit("")))).otherwise(F.col("canonical"))
    keyed = rows.withColumn("key", key)
    place = ("key", "at", "revisit", "record_id")
    ranges = keyed.repartitionByRange(*place) if chunks is None else keyed.repartitionByRange(chunks, *place)
    rows = stage(ranges.withColumn("chunk", F.spark_partition_id()), "captures")
    order = F.struct(F.col("at").alias("at"), F.col("record_id").alias("id"))
    response = F.struct(order.alias("order"), F.col("record_id").alias("id"), F.col("at").alias("at"), "headers", "digest")
    # one row for each chunk that a URL lies in, also where none of its captures there is a response
    is_response = ~F.col("revisit")
    heads = rows.groupBy("key", "chunk").agg(F.max_by(F.when(is_response, response), F.when(is_response, order)).alias("head"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("head", F.last("head", ignorenulls=True).over(earlier)).where("head IS NOT NULL")
    carried = carried.select("key", "chunk", F.lit(-1).alias("turn"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("record_id"), F.lit(False).alias("revisit"), "head", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("digest"))
    own = rows.select("key", "chunk", F.when(F.col("revisit"), 1).otherwise(0).alias("turn"), "at", "record_id", "revisit", F.when(~F.col("revisit"), response).alias("head"), "canonical", "headers", "digest")
    every = own.unionByName(carried)
    within = Window.partitionBy("key", "chunk").orderBy(F.expr("turn <> -1"), "at", "turn", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("of", F.last("head", ignorenulls=True).over(within)).where("revisit AND canonical IS NOT NULL")
    of = F.col("of")
    checks = F.array(
        _same(_tag(F.col("headers")), _tag(of["headers"])),
        _same(F.try_element_at("headers", F.lit("last-modified")), F.try_element_at(of["headers"], F.lit("last-modified"))),
        _same(F.col("digest"), of["digest"]),
    )
    state = F.when(of.isNull() | (F.col("canonical") == ""), "orphan").when(F.exists(checks, lambda c: F.coalesce(~c, F.lit(False))), "conflict")
    state = state.when(F.exists(checks, lambda c: F.coalesce(c, F.lit(False))), "verified").otherwise("unverified")
    found = found.withColumn("state", state)
    uses = F.col("state").isin("verified", "unverified")
    anew = F.map_filter("headers", lambda k, _: k.isin(*UPDATABLE))
    kept = F.map_filter(of["headers"], lambda k, _: ~F.array_contains(F.map_keys(anew), k))
    tied = F.col("state") != "orphan"
    return found.select(
        "record_id", "canonical", F.when(tied, of["id"]).alias("response_id"), F.when(tied, of["at"]).alias("response_at"), "state",
        F.when(uses, F.map_concat(kept, anew)).otherwise(F.col("headers")).alias("headers"), F.when(uses, of["digest"]).alias("digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures by rule from ``pages``: each page is a response, fetched again twice with 304.

    Days, entity tags and headers follow from the page's number; every eleventh revisit has another tag and
    every thirteenth no validator at all.  Pages that share a canonical URL share its history.
    """
    day = lambda k: (F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("page_id") * 7919 % 365 + k) * 86_400 + F.col("page_id") % 86_400))
    n = F.col("page_id")
    sha = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    tag = F.concat(F.lit('"'), F.substring(F.sha2(canonical_url(F.col("url")), 256), 1, 12), F.lit('"'))
    full = pages.select(
        (n * 3).alias("record_id"), "url", day(0).alias("at"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (n % 100).cast("string"))).alias("headers"), sha.alias("digest"),
    )

    def again(k: int) -> DataFrame:
        own = F.when((n + k) % 13 == 0, F.lit(None).cast("string")).when((n + k) % 11 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
        head = F.map_filter(F.create_map(F.lit("etag"), own, F.lit("Date"), F.concat(F.lit("day "), (n % 365 + k).cast("string")), F.lit("Content-Length"), F.lit("0")), lambda _, v: v.isNotNull())
        return pages.select((n * 3 + k).alias("record_id"), "url", day(k * 20 - 25).alias("at"), F.lit(304).alias("status"), head.alias("headers"), F.lit(None).cast("string").alias("digest"))

    return full.unionByName(again(1)).unionByName(again(2))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    names = F.array_sort(F.map_keys("headers"))
    merged = F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), ";")
    return found.select((F.expr("record_id div 3")).alias("page_id"), "record_id", "canonical", "response_id", "state", merged.alias("headers"), "digest")


_PART = r"regexp_extract(trim(coalesce(url, '')), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', {})"
_TRACK = ", ".join(f"'{t}'" for t in TRACKING)
ORACLE = rf"""
WITH p AS (
  SELECT page_id AS n, sha256(coalesce(html, '')) AS sha,
    regexp_replace(regexp_replace(lower({_PART.format(1)}), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_replace({_PART.format(2)}, '/(index|default)\.(html?|php|aspx?)$', '/'), '/+$', '') AS path,
    array_to_string(list_sort([q for q in string_split({_PART.format(3)}, '&') if q <> '' AND lower(split_part(q, '=', 1)) NOT IN ({_TRACK})]), '&') AS query FROM pages),
u AS (SELECT *, CASE WHEN host = '' THEN '' ELSE host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM p),
c AS (SELECT *, '"' || substr(sha256(canonical), 1, 12) || '"' AS tag, 1700000000 + n % 86400 + (n * 7919 % 365) * 86400 AS at0 FROM u),
f AS (SELECT n * 3 AS id, canonical, at0 AS at, tag, sha, 'max-age=' || (n % 100) AS cache FROM c),
r AS (SELECT n * 3 + k AS record_id, n, canonical, at0 + (k * 20 - 25) * 86400 AS at, 'day ' || (n % 365 + k) AS date,
    CASE WHEN (n + k) % 13 = 0 THEN NULL WHEN (n + k) % 11 = 0 THEN '"other"' ELSE 'W/' || tag END AS own FROM c, (VALUES (1), (2)) v(k)),
j AS (SELECT r.*, f.id, f.tag, f.sha, f.cache FROM r LEFT JOIN f ON f.canonical = r.canonical AND r.canonical <> '' AND f.at <= r.at
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.at DESC NULLS LAST, f.id DESC) = 1),
s AS (SELECT *, CASE WHEN id IS NULL THEN 'orphan' WHEN own IS NULL THEN 'unverified' WHEN regexp_replace(own, '^[wW]/', '') = tag THEN 'verified' ELSE 'conflict' END AS state FROM j)
SELECT record_id // 3 AS page_id, record_id, canonical, id AS response_id, state,
  CASE WHEN state IN ('verified', 'unverified') THEN 'cache-control=' || cache || ';content-type=text/html;date=' || date || ';etag=' || coalesce(own, tag)
    ELSE 'content-length=0;date=' || date || coalesce(';etag=' || own, '') END AS headers,
  CASE WHEN state IN ('verified', 'unverified') THEN sha END AS digest
FROM s
"""
