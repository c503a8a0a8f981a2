"""Operator 2, resolution of not-modified revisits in web archives.

Each revisit takes the latest earlier full response of its canonical URL, an as-of join that
is one ordered window over the captures of a URL. The captures of a URL that has very many are
cut into spans at quantiles of its own times, so that it is spread over many tasks however its
captures cluster: within a span the latest response comes from the window, and before the
span's first one from the latest of the spans before. Where the cuts lie changes no result.
Validators are checked, and headers that a 304 may change are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import table
from pagequarry.session import settle

#: Headers that describe the stored body or the connection; a 304 doesn't change them.
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"
]
#: Query parameters that say where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)="
#: A URL of more captures is cut into spans, and into so many at most.
SPAN_ROWS, SPANS = 4096, 256
#: URLs that are cut at most; their cuts are broadcast (8 MB).
HOT_URLS = 4096


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. or m., no scheme, user, default port or fragment, no trailing slash or .html, query parameters sorted and without tracking. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(
        F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), "^.*@", "")), ":(80|443)$", ""),
        r"^(www|m)\.", ""
    )
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", ""), r"\.html$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def weak(tag: Column) -> Column:
    """An entity tag without its weakness mark, as revisits compare them."""
    return F.regexp_replace(tag, "^W/", "")


def crowded_urls(usable: DataFrame, span_rows: int) -> DataFrame:
    """(url_key, n) of the URLs with more captures than a span should have, written; the HOT_URLS largest, as no other can have more than its share."""
    counts = usable.groupBy("url_key").agg(F.count("*").alias("n")).where(F.col("n") > span_rows)
    return settle(counts.orderBy(F.desc("n"), "url_key").limit(HOT_URLS), "warc-urls")


def span_cuts(usable: DataFrame, urls: DataFrame, spans: int) -> DataFrame:
    """(url_key, cuts): of each of the URLs the times at which its spans begin."""
    shares = [i / spans for i in range(1, spans)]
    times = usable.select("url_key", "ts").join(F.broadcast(urls.select("url_key")), "url_key", "left_semi")
    return times.groupBy("url_key").agg(F.array_distinct(F.percentile_approx("ts", shares, 10 * spans)).alias("cuts"))


def resolve_revisits(captures: DataFrame, span_rows: int = SPAN_ROWS, spans: int = SPANS) -> DataFrame:
    """Each revisit with the response that it stands for.

    ``captures`` has record_id (long), url, ts (long), kind ('response', 'revisit', others
    are left out), etag, last_modified and headers (map of lower-case names). Returns one row
    per revisit: record_id, url_key, response_id, status and headers. Status is 'resolved';
    'no_earlier_response' (response_id and headers null; a null url or ts included);
    'no_validator' if no validator is on both sides; or 'validator_mismatch': entity tags,
    weakly compared, decide where both have one, else the modification dates. A response of
    the same ts is not earlier; of several at one ts the largest record_id counts. Headers
    are the response's, overridden by those of the revisit that a 304 may change, and only
    when resolved, else the response's own; null headers count as none. Records that repeat
    are each resolved; an empty table gives no rows. Other columns are not read.
    """
    none = F.create_map().cast("map<string,string>")
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"),
        F.struct(F.col("etag"), F.col("last_modified"), F.coalesce(F.col("headers"), none).alias("headers")).alias("r"),
    )
    usable = rows.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    stored = F.when(F.col("full"), F.struct("ts", "record_id", "r"))
    latest = F.max_by(stored, F.when(F.col("full"), F.struct("ts", "record_id")))
    within = Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    urls = crowded_urls(usable, span_rows)
    if urls.isEmpty():
        found = usable.withColumn("span", F.lit(0)).withColumn("s", latest.over(within)).where("NOT full")
    else:
        # the span of a capture is how many of its URL's cuts are not after it
        cuts = F.broadcast(settle(span_cuts(usable, urls, spans), "warc-cuts"))
        span = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("ts"))))
        placed = usable.join(cuts, "url_key", "left").withColumn("span", span)
        # one row for each span of a URL that is cut: its latest response, null if it has none
        ends = placed.where("cuts IS NOT NULL").groupBy("url_key", "span").agg(latest.alias("own"))
        before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("carried", F.last("own", ignorenulls=True).over(before)).select("url_key", "span", "carried")
        in_span = placed.drop("cuts").withColumn("near", latest.over(within)).where("NOT full")
        # written, so that the join is dealt by URL and span as the window is
        carried = settle(carried, "warc-carried")
        found = in_span.join(carried, ["url_key", "span"], "left").withColumn("s", F.coalesce("near", "carried"))
    lost = rows.where("NOT full AND (url_key IS NULL OR ts IS NULL)").withColumn("s", F.lit(None).cast(found.schema["s"].dataType))
    both = found.select("record_id", "url_key", "r", "s").unionByName(lost.select("record_id", "url_key", "r", "s"))
    tags, dates = F.col("r.etag").isNotNull() & F.col("s.r.etag").isNotNull(), F.col("r.last_modified").isNotNull() & F.col("s.r.last_modified").isNotNull()
    agrees = F.when(tags, weak(F.col("r.etag")) == weak(F.col("s.r.etag"))).when(dates, F.col("r.last_modified") == F.col("s.r.last_modified"))
    status = F.when(
        F.col("s").isNull(), "no_earlier_response"
    ).when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch")
    new = F.map_filter("r.headers", lambda k, _: ~F.lower(k).isin(FIXED_HEADERS))
    old = F.map_filter("s.r.headers", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return both.withColumn("status", status).select(
        "record_id", "url_key", F.col("s.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", F.map_concat(old, new)).otherwise(F.col("s.r.headers")).alias("headers")
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """An archive's records from pages: each page is fetched twice, and then the front page of its section.

    The first fetch of page i is record 3i at ts 3i, a full response with an entity tag of its
    content, but where the page's digest has a second digit of 0 to 3 a revisit, which only
    an earlier page of the same canonical URL can resolve. The second, 3i + 1, goes by https
    and without the fragment and is a revisit; its tag is weak where the digest starts with 0
    to 7, and another page's (the digest's own digest) where it starts with f. The front page
    is the URL's host and first path segment; its fetch, 3i + 2, is a full response where the
    digest's third digit is 0 or 1, else a revisit, often many captures later. Its tag changes
    every 64 pages and its modification date every 256; where the third digit is e a
    revisit sends the date alone, and where it is f nothing.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    nothing = F.lit(None).cast("string")
    base = pages.select("page_id", "url", digest.alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    first, second, third = (F.substring("digest", k, 1) for k in (1, 2, 3))
    tag = quoted(F.col("digest"))
    i = F.col("page_id")

    def record(n: int, url, full, etag, modified, size):
        at = 3 * i + n
        response = F.create_map(F.lit("content-length"), size, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string"))
        revisit = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), at.cast("string"))
        return base.select(
            at.alias("record_id"), url.alias("url"), at.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
            etag.alias("etag"), modified.alias("last_modified"), F.when(full, response).otherwise(revisit).alias("headers"),
        )

    sent = F.when(first == "f", quoted(F.md5("digest"))).when(first < "8", F.concat(F.lit("W/"), tag)).otherwise(tag)
    secure = F.regexp_replace(F.regexp_replace("url", "^http:", "https:"), "#.*$", "")
    front = F.regexp_replace("url", "^([a-z]+://[^/?#]*/[^/?#]*).*$", "$1/")
    whole = third < "2"
    version = quoted(F.floor(i / 64).cast("string"))
    fetched = record(0, F.col("url"), second > "3", tag, nothing, F.col("size"))
    again = record(1, secure, F.lit(False), sent, nothing, F.col("size"))
    section = record(2, front, whole, F.when(third < "e", version), F.when(third < "f", F.floor(i / 256).cast("string")), F.lit("7"))
    return fetched.unionByName(again).unionByName(section)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All revisits among the captures of all pages; see captures_of() and resolve_revisits()."""
    found = resolve_revisits(captures_of(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("record_id", "url_key", "response_id", "status", F.array_join(pairs, ";").alias("headers"))


ORACLE_SQL = r"""
WITH base AS (SELECT page_id AS i, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, ''))::VARCHAR AS size FROM pages),
captures AS (
  SELECT 3 * i AS id, url, left(substr(digest, 2), 1) > '3' AS whole, digest AS tag, NULL AS modified, size FROM base
  UNION ALL SELECT 3 * i + 1, regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', ''), false, CASE WHEN left(digest, 1) = 'f' THEN md5(digest) ELSE digest END, NULL, size FROM base
  UNION ALL SELECT 3 * i + 2, regexp_replace(url, '^([a-z]+://[^/?#]*/[^/?#]*).*$', '\1/'), substr(digest, 3, 1) < '2', CASE WHEN substr(digest, 3, 1) < 'e' THEN (i // 64)::VARCHAR END, CASE WHEN substr(digest, 3, 1) < 'f' THEN (i // 256)::VARCHAR END, '7' FROM base),
bare AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM captures),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(u, '^[^/?]*'), '^.*@', '')), ':(80|443)$', ''), '^(www|m)\.', '')
    || regexp_replace(regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', ''), '\.html$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))) AS q FROM bare),
k AS (SELECT id, whole, tag, modified, size, place || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key FROM keyed),
runs AS (SELECT *, max(CASE WHEN whole THEN id END) OVER (PARTITION BY url_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sid FROM k),
j AS (
  SELECT v.*, s.size AS s_size, CASE WHEN v.tag IS NOT NULL AND s.tag IS NOT NULL THEN v.tag = s.tag WHEN v.modified IS NOT NULL AND s.modified IS NOT NULL THEN v.modified = s.modified END AS agrees
  FROM runs v LEFT JOIN k s ON s.id = v.sid WHERE NOT v.whole)
SELECT id AS record_id, url_key, sid AS response_id,
  CASE WHEN sid IS NULL THEN 'no_earlier_response' WHEN agrees IS NULL THEN 'no_validator' WHEN agrees THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN sid IS NULL THEN NULL
    WHEN agrees THEN 'cache-control=max-age=60;content-length=' || s_size || ';content-type=text/html;date=' || id
    ELSE 'content-length=' || s_size || ';content-type=text/html;date=' || sid END AS headers
FROM j
"""
