"""WARC revisit records: the earlier full response that a not-modified record stands for.

Records of one canonical URL are ordered by time. A revisit is matched as of its time
to the latest strictly earlier full response (status 200; of the same second, the
highest record number). It is resolved if the validators agree: a strong entity tag
must be equal, a weak one equal but for the weakness mark, without a tag the
Last-Modified values must be equal, and without any validator the response must have
none either. The headers of a resolved revisit are the response's, overwritten by
those of the revisit that a 304 may update (RFC 9111, 3.2).

A URL with very many records is not gathered in one task: the latest response is
found within (URL, hour), then carried over the hours of a URL, one row each.

Null URLs and times: never matched ("unmatched"). Null headers are empty. Header names
are compared in lower case; of names that differ in case only, the first counts.
Repeated rows give repeated results. Empty tables give no rows. Extra columns of the
records are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 3600
# fixed values: header fields that a 304 must not change (message framing and hop-by-hop fields)
KEPT_FIELDS = (
    "connection content-encoding content-length content-range content-type keep-alive proxy-authenticate "
    "proxy-authentication-info proxy-authorization proxy-connection te trailer transfer-encoding upgrade"
).split()


def canonical(url: Column) -> Column:
    """Host without www, port and scheme, path without a closing slash, query without utm_ parameters."""
    rest = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lowered(headers: Column) -> Column:
    """Header map with names in lower case."""
    entries = F.map_entries(F.coalesce(headers, F.expr("cast(map() as map<string, string>)")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    first = F.transform(
        names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), 1)["value"]
    )
    return F.map_from_arrays(names, first)


def agreeing(revisit: Column, response: Column) -> Column:
    """Whether a 304's validators select the stored response."""
    tag, held = F.try_element_at(revisit, F.lit("etag")), F.try_element_at(response, F.lit("etag"))
    changed = F.try_element_at(revisit, F.lit("last-modified"))
    stored = F.try_element_at(response, F.lit("last-modified"))
    weak = F.regexp_replace(tag, "^W/", "") == F.regexp_replace(held, "^W/", "")
    by_tag = F.when(tag.startswith("W/"), weak).otherwise(tag == held)
    by_time = F.when(changed.isNotNull(), changed == stored).otherwise(held.isNull() & stored.isNull())
    return F.coalesce(F.when(tag.isNotNull(), by_tag).otherwise(by_time), F.lit(False))


def merged(response: Column, revisit: Column) -> Column:
    allowed = F.map_filter(revisit, lambda k, _: ~k.isin(*KEPT_FIELDS))
    return F.map_zip_with(response, allowed, lambda _, old, new: F.coalesce(new, old))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """record_id, url (canonical), response_id, outcome and headers, one row per revisit.

    records: record_id, uri, time (seconds), kind (response or revisit), status, headers (map).
    outcome: resolved, mismatch (validators differ) or unmatched (no earlier full response).
    """
    placed = records.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        canonical(F.col("uri")).alias("url"),
        F.col("time").cast("bigint").alias("time"),
        F.col("kind"),
        ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
        lowered(F.col("headers")).alias("headers"),
    ).withColumn("hour", F.expr(f"time div {BUCKET_SECONDS}"))
    # maps have no order: the entries travel along, the pair of time and number decides
    stamp = F.when(F.col("full"), F.struct("time", "record_id", F.map_entries("headers").alias("entries")))
    keyed = F.col("url").isNotNull() & F.col("time").isNotNull()
    earlier = Window.partitionBy("url", "hour").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    near = placed.where(keyed).withColumn("near", F.max(stamp).over(earlier))
    latest = placed.where(keyed).groupBy("url", "hour").agg(F.max(stamp).alias("latest"))
    hours = Window.partitionBy("url").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url", "hour", F.max("latest").over(hours).alias("far")).where("far IS NOT NULL")
    matched = (
        near.where("kind = 'revisit'")
        .join(carried, ["url", "hour"], "left")
        .select("record_id", "url", "headers", F.coalesce("near", "far").alias("match"))
    )
    lost = placed.where(~keyed & (F.col("kind") == "revisit")).select(
        "record_id", "url", "headers", F.lit(None).cast(matched.schema["match"].dataType).alias("match")
    )
    every = matched.unionByName(lost)
    held = F.map_from_entries("match.entries")
    outcome = (
        F.when(F.col("match").isNull(), "unmatched")
        .when(agreeing(F.col("headers"), held), "resolved")
        .otherwise("mismatch")
    )
    resolved = every.select(
        "record_id", "url", "headers", held.alias("held"), F.col("match.record_id").alias("candidate"), outcome.alias("outcome")
    )
    good = F.col("outcome") == "resolved"
    return resolved.select(
        "record_id",
        "url",
        F.when(good, F.col("candidate")).alias("response_id"),
        "outcome",
        F.when(good, merged(F.col("held"), F.col("headers"))).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """A capture series per page: a response, two revisits, and for every sixth page a later response."""
    return pages.sparkSession.sql(RECORDS, pages=pages)


# the same derivation for both engines: plain columns first, header maps in the query
FIELDS = """
SELECT page_id * 4 + k AS record_id, url AS uri, (page_id * 7919) % 1000003 + k * 5000 - CASE k WHEN 3 THEN 8000 ELSE 0 END AS time,
       CASE WHEN k IN (0, 3) THEN 'response' ELSE 'revisit' END AS kind,
       CASE WHEN k IN (1, 2) THEN 304 WHEN page_id % 11 = 5 THEN 404 ELSE 200 END AS status,
       CASE WHEN k = 2 THEN CASE WHEN page_id % 2 = 1 THEN CONCAT('"', h, '"') END
            WHEN page_id % 5 = 4 THEN NULL
            WHEN k = 1 AND page_id % 7 = 2 THEN '"stale"'
            WHEN page_id % 5 = 3 THEN CONCAT('W/"', h, '"')
            ELSE CONCAT('"', h, '"') END AS etag,
       CASE WHEN page_id % 3 <> 0 THEN CONCAT('day-', CASE WHEN k = 2 AND page_id % 4 = 1 THEN 'other' ELSE CAST(page_id % 9 AS STRING) END) END AS modified,
       CASE WHEN k IN (0, 3) THEN 'text/html' ELSE 'text/plain' END AS content_type,
       CASE WHEN k IN (0, 3) THEN 'max-age=60' WHEN k = 2 THEN 'max-age=600' END AS caching,
       CASE WHEN k = 1 THEN 'HIT' END AS cache_state,
       CASE WHEN k IN (1, 2) THEN 'close' END AS connection
FROM (SELECT page_id, url, {md5} AS h, k FROM {pages} {series}) p
WHERE k < 3 OR page_id % 6 = 0"""
RECORDS = (
    "SELECT record_id, uri, time, kind, status, map_filter(map('ETag', etag, 'Last-Modified', modified, "
    "'Content-Type', content_type, 'Cache-Control', caching, 'X-Cache', cache_state, 'Connection', connection), "
    "(k, v) -> v IS NOT NULL) AS headers FROM ("
    + FIELDS.replace("{md5}", "md5(html)").replace("{series}", "LATERAL VIEW explode(sequence(0, 3)) s AS k")
    + ")"
)


def op2_revisits(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    found = resolve_revisits(records_of(pages))
    listing = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return found.select("record_id", "url", "response_id", "outcome", F.array_join(listing, "; ").alias("headers"))


TWIN = (
    r"""WITH fields AS ("""
    + FIELDS.replace("{series}", "CROSS JOIN range(4) s(k)").replace("{md5}", "md5(html)").replace("{pages}", "pages").replace("AS STRING", "AS VARCHAR")
    + r"""),
parts AS (SELECT *, regexp_replace(regexp_replace(uri, '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM fields),
cut AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        regexp_replace(regexp_replace(regexp_extract(rest, '(?s)^[^?]*\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM parts),
records AS (SELECT *, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url FROM cut),
full_ones AS (SELECT url, time, record_id, etag, modified, content_type, caching FROM records WHERE kind = 'response' AND status = 200),
pairs AS (SELECT v.record_id, v.url, f.record_id AS candidate, v.etag, v.modified, v.caching, v.cache_state,
          f.etag AS held, f.modified AS stored, f.content_type, f.caching AS old_caching,
          ROW_NUMBER() OVER (PARTITION BY v.record_id ORDER BY f.time DESC NULLS LAST, f.record_id DESC NULLS LAST) AS rn
   FROM records v LEFT JOIN full_ones f ON v.url = f.url AND f.time < v.time WHERE v.kind = 'revisit'),
judged AS (SELECT *, CASE WHEN candidate IS NULL THEN 'unmatched'
   WHEN COALESCE(CASE WHEN etag IS NOT NULL THEN CASE WHEN etag LIKE 'W/%' THEN replace(etag, 'W/', '') = replace(held, 'W/', '') ELSE etag = held END
        WHEN modified IS NOT NULL THEN modified = stored ELSE held IS NULL AND stored IS NULL END, FALSE) THEN 'resolved'
   ELSE 'mismatch' END AS outcome FROM pairs WHERE rn = 1)
SELECT record_id, url, CASE WHEN outcome = 'resolved' THEN candidate END AS response_id, outcome,
   CASE WHEN outcome = 'resolved' THEN concat_ws('; ', 'cache-control: ' || COALESCE(caching, old_caching), 'content-type: ' || content_type,
        'etag: ' || COALESCE(etag, held), 'last-modified: ' || COALESCE(modified, stored), 'x-cache: ' || cache_state) END AS headers
FROM judged"""
)
