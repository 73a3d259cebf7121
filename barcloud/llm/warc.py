"""Resolution of not-modified revisits in web archives.

A revisit with status 304 says that a page was as before and carries no payload.  It is resolved by an as-of join:
the latest full response captured *earlier* under the same canonical URL.  The revisit's validators must agree
with that response (entity tags by weak comparison; without one on both sides, the modification time);
then the response's headers are updated with those of the revisit that a 304 may change.

Captures of one URL may be a third of all rows, so the as-of join never sorts a URL in one task: instants
are cut into buckets at quantiles, each (URL, bucket) finds its latest response by itself, and what a bucket hands
on to later ones is one row.  Rows of the same URL and instant are one event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barcloud.llm.common import attach_facts, table
from barcloud.session import write_table

#: Events of all URLs per time bucket.
BUCKET_EVENTS = 100_000
MAX_BUCKETS = 4_000

# Fixed values (HTTP caching): hop-by-hop fields and fields that describe the stored payload; a 304 doesn't change them.
NOT_MERGED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that tell where a visitor came from, not what is shown.
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port, path without a closing slash, query without tracking; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^https?://(www\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?(.*)$", 1), TRACKING, "")
    query = F.regexp_replace(F.regexp_replace(query, r"&&+", "&"), r"^&|&$", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def latest_before(events: DataFrame, buckets: int) -> DataFrame:
    """``events`` (url, ts, response; one row per url and ts) with ``before``, the response of the latest earlier one that has any."""
    cuts = sorted(set(events.approxQuantile("ts", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    bucket = F.lit(0)
    if cuts:
        edges = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(edges, lambda c: c < F.col("ts")))
    placed = events.withColumn("bucket", bucket)
    inside = Window.partitionBy("url", "bucket").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.last("response", ignorenulls=True).over(inside))
    handed = placed.where("response is not null").groupBy("url", "bucket").agg(F.max_by("response", "ts").alias("last"))
    # a bucket without a response still needs what earlier ones hand on
    asked = placed.select("url", "bucket").distinct().join(handed, ["url", "bucket"], "left")
    earlier = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    joined = placed.join(carried, ["url", "bucket"], "left")
    return joined.withColumn("before", F.coalesce("before", "carried")).drop("bucket", "carried")


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(headers["etag"]), "^W/", "")


def validated(revisit: Column, response: Column) -> Column:
    """Whether the validators agree: entity tags if both have one, else modification times if both have one, else yes."""
    return F.coalesce(_tag(revisit) == _tag(response), revisit["last-modified"] == response["last-modified"], F.lit(True))


def merged(revisit: Column, response: Column) -> Column:
    """The response's headers, updated by the revisit's that may be."""
    hops = F.split(F.lower(F.coalesce(revisit["connection"], F.lit(""))), r"\s*,\s*")
    news = F.map_filter(revisit, lambda k, v: ~k.isin(*NOT_MERGED) & ~F.array_contains(hops, k) & v.isNotNull())
    kept = F.map_filter(response, lambda k, v: ~F.map_contains_key(news, k))
    return F.map_concat(kept, news)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records`` (record_id, url, ts, status, headers with lower-case names, digest).

    Revisits have status 304, full responses 200; other records take no part.  Columns: record_id, canonical,
    ts, state, refers_to, headers, digest.  The state is ``resolved``; ``mismatch`` if the validators differ; or ``orphan`` if no
    earlier full response is known, which holds too if URL or time is null.  Headers are merged if resolved and the
    revisit's own otherwise.  Several responses of one URL and instant: the largest record_id.  Repeated revisits
    give a row each, repeated record ids of responses count once; an empty table gives no row.
    """
    known = records.withColumn("canonical", canonical_url(F.col("url"))).withColumn(
        "headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))
    )
    responses = known.where("status = 200 and canonical is not null and ts is not null and record_id is not null")
    revisits = known.where("status = 304").select("record_id", "canonical", "ts", "headers")
    events = responses.select("canonical", "ts", F.col("record_id").alias("response"), F.lit(0).alias("asks")).unionByName(
        revisits.where("canonical is not null and ts is not null").select(
            "canonical", "ts", F.lit(None).cast("long").alias("response"), F.lit(1).alias("asks")
        )
    )
    events = write_table(events.groupBy(F.col("canonical").alias("url"), "ts").agg(
        F.max("response").alias("response"), F.sum("asks").alias("n")
    ), "warc-events")
    buckets = max(1, min(MAX_BUCKETS, events.count() // BUCKET_EVENTS))
    found = write_table(latest_before(events, buckets).where("n > 0").select(
        F.col("url").alias("canonical"), "ts", "n", F.col("before").alias("refers_to")
    ), "warc-found")
    asked = attach_facts(revisits, found, ["canonical", "ts"], "n", ["record_id"]).drop("n")
    asked = write_table(asked, "warc-asked")
    # many revisits may refer to one response, and those without one have no key: both are dealt over all tasks
    asks = asked.where("refers_to is not null").groupBy("refers_to").agg(F.count("*").alias("n"))
    stored = responses.select(F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), "digest").dropDuplicates(["refers_to"])
    stored = write_table(stored.join(asks, "refers_to"), "warc-stored")
    joined = attach_facts(asked, stored, ["refers_to"], "n", ["record_id", "ts"]).drop("n")
    ok = validated(F.col("headers"), F.col("stored"))
    state = F.when(F.col("stored").isNull(), "orphan").when(ok, "resolved").otherwise("mismatch")
    resolved = F.col("state") == "resolved"
    return joined.withColumn("state", state).select(
        "record_id", "canonical", "ts", "state", F.when(resolved, F.col("refers_to")).alias("refers_to"),
        F.when(resolved, merged(F.col("headers"), F.col("stored"))).otherwise(F.col("headers")).alias("headers"),
        F.when(resolved, F.col("digest")).alias("digest"),
    )


def with_payload(resolved: DataFrame, records: DataFrame, payload: str) -> DataFrame:
    """``resolved`` with the payload column of the responses referred to; null where there is none."""
    stored = records.where("status = 200").select(F.col("record_id").alias("refers_to"), payload).dropDuplicates(["refers_to"])
    return resolved.join(stored, "refers_to", "left")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records derived from ``pages``: the front of each site and language, captured over and over.

    Page p is a full response at second 100 p; a revisit 50 seconds later, whose tag is another's for every seventh page
    and missing for every third; and for every fifth page a revisit 20 seconds before, so that the first of a URL has no response.
    """
    front = F.concat(F.regexp_extract("url", r"^https?://[^/]+/[a-z]+", 0), F.regexp_extract("url", r"[?#].*$", 0))
    base = pages.select("page_id", front.alias("url"), F.md5("html").alias("digest"), F.length("html").alias("size"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 30).cast("string"))
    full = base.select(
        (F.col("page_id") * 3).alias("record_id"), "url", (F.col("page_id") * 100).alias("ts"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"),
            F.lit("content-length"), F.col("size").cast("string"), F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"), "digest",
    )
    later = base.select(
        (F.col("page_id") * 3 + 1).alias("record_id"), "url", (F.col("page_id") * 100 + 50).alias("ts"), F.lit(304).alias("status"),
        F.map_filter(F.create_map(
            F.lit("etag"), F.when(F.col("page_id") % 3 != 0, F.when(F.col("page_id") % 7 == 0, '"other"').otherwise(F.concat(F.lit("W/"), tag))),
            F.lit("last-modified"), day, F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close, x-hop"),
            F.lit("x-hop"), F.lit("1"), F.lit("cache-control"), F.lit("max-age=90"),
        ), lambda k, v: v.isNotNull()).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    sooner = base.where(F.col("page_id") % 5 == 0).select(
        (F.col("page_id") * 3 + 2).alias("record_id"), "url", (F.col("page_id") * 100 - 20).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("date"), day).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(later).unionByName(sooner)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(write_table(captures(table(spark, sf_dir, "pages")), "warc-captures"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id", F.col("canonical").alias("canonical_url"), "ts", "state", "refers_to", F.array_join(lines, "\n").alias("headers"), "digest"
    )


OP5_SQL = r"""
WITH base AS (
  SELECT page_id, concat(regexp_extract(url, '^https?://[^/]+/[a-z]+'), regexp_extract(url, '[?#].*$')) AS url,
         md5(html) AS digest, length(html) AS size, '"' || substr(md5(html), 1, 12) || '"' AS tag,
         concat('day ', page_id % 30) AS day
  FROM pages
), named AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://(www\.)?', '', 'i') AS rest FROM base
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1),
           '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '&&+', '&', 'g'), '^&|&$', '', 'g') AS query
  FROM named
), pages_c AS (
  SELECT page_id, place || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical, digest, size, tag, day FROM parts
), revisits AS (
  SELECT page_id * 3 + 1 AS record_id, canonical, page_id * 100 + 50 AS ts, 1 AS later,
         CASE WHEN page_id % 3 <> 0 THEN CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/' || tag END END AS etag, day
  FROM pages_c
  UNION ALL
  SELECT page_id * 3 + 2, canonical, page_id * 100 - 20, 0, NULL, day FROM pages_c WHERE page_id % 5 = 0
), responses AS (
  SELECT page_id * 3 AS rid, canonical AS c, page_id * 100 AS t, tag AS r_tag, day AS r_day, size, digest AS d FROM pages_c
), asof_rows AS (
  SELECT v.*, r.* FROM revisits v ASOF LEFT JOIN responses r ON v.canonical = r.c AND v.ts > r.t
), judged AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'orphan'
    WHEN coalesce(replace(etag, 'W/', '') = r_tag, CASE WHEN later = 1 THEN day = r_day END, TRUE) THEN 'resolved'
    ELSE 'mismatch' END AS state
  FROM asof_rows
)
SELECT record_id, canonical AS canonical_url, ts, state, CASE WHEN state = 'resolved' THEN rid END AS refers_to,
  CASE
    WHEN state = 'resolved' AND later = 1 THEN concat('cache-control: max-age=90', chr(10), 'content-length: ', size, chr(10),
      'content-type: text/html', chr(10), 'etag: ', coalesce(etag, r_tag), chr(10), 'last-modified: ', day)
    WHEN state = 'resolved' THEN concat('cache-control: max-age=60', chr(10), 'content-length: ', size, chr(10),
      'content-type: text/html', chr(10), 'date: ', day, chr(10), 'etag: ', r_tag, chr(10), 'last-modified: ', r_day)
    WHEN later = 1 THEN concat('cache-control: max-age=90', chr(10), 'connection: close, x-hop', chr(10), 'content-length: 0', chr(10),
      CASE WHEN etag IS NULL THEN '' ELSE concat('etag: ', etag, chr(10)) END, 'last-modified: ', day, chr(10), 'x-hop: 1')
    ELSE concat('date: ', day) END AS headers,
  CASE WHEN state = 'resolved' THEN d END AS digest
FROM judged
"""
