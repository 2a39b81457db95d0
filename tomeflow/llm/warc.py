"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record says that a server answered "not modified". It is resolved to
the latest earlier full response of the same canonical URL, if validators agree:
the entity tags (weak comparison) where the revisit has one, else the
Last-Modified dates, however spelled, where it has one. The stored headers are kept and the
revisit's fields that a 304 response may update replace them.

The as-of join is a last-value carry over time and not a join of pairs. To let
one URL hold any share of the records, times are cut into spans of
``span_seconds``: within a span a window runs over the records of one URL; across
spans the last response of each span is carried over one row per URL and span.

``status`` is ``resolved``, ``no_earlier_response``, ``validator_mismatch`` or
``no_validator`` (the revisit names none, so the earlier response is only
reported as candidate and not merged).

Nulls and edges: records with a null URL or time are never resolved and never
serve others; responses at the very time of the revisit are not earlier; of
responses at one time the one with the largest record id is the latest; repeated
records come back as often as they came in; header names compare without case;
null headers are an empty map; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fields of a stored response that a not-modified answer may update.
MERGED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
SPAN_SECONDS = 86_400
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """Scheme and ``www.``/``m.`` dropped, host in lower case, default port, fragment, tracking parameters and a final slash removed, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "^[^/?]*", ""), "[?].*$", ""), "/+$", "")
    query = F.when(bare.contains("?"), F.regexp_replace(bare, "^[^?]*[?]", "")).otherwise(F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _lower_keys(headers: Column) -> Column:
    pairs = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    low = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(low, lambda e, i: ~F.exists(F.slice(low, i + 2, F.size(low)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def _tag(column: str) -> Column:
    return F.regexp_replace(F.col(column).getItem("etag"), "^W/", "")


def http_date(text: Column) -> Column:
    """A date of any of HTTP's three spellings as a timestamp, null for others; two-digit years are 1970 to 2069."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), "^[A-Za-z]+,? ", ""), " (GMT|UTC)$", "")
    short = F.try_to_timestamp(bare, F.lit("d-MMM-yy HH:mm:ss"))
    old = F.make_timestamp(F.year(short) - 100, F.month(short), F.dayofmonth(short), F.hour(short), F.minute(short), F.second(short))
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")), F.when(F.year(short) > 2069, old).otherwise(short), F.try_to_timestamp(bare, F.lit("MMM d HH:mm:ss yyyy")))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored fields, replaced or joined by the update's fields that may be merged; sorted by name."""
    allowed = F.map_filter(update, lambda k, _: k.isin(*MERGED))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, allowed))))


def resolve(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """One row per revisit of ``records (record_id, url, at, kind, headers, payload)``.

    ``kind`` is ``response`` or ``revisit``; ``at`` a timestamp; ``payload`` the
    digest of a response's body. Returns ``record_id, canonical, at, status,
    resolved_id, resolved_at, payload, headers``.
    """
    rows = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("canonical"), F.col("at").cast("timestamp").alias("at"), "kind", _lower_keys(F.col("headers")).alias("headers"), F.col("payload").cast("string").alias("payload"))
    rows = rows.withColumn("span", F.floor(F.unix_micros("at") / F.lit(span_seconds * 1_000_000)).cast("long"))
    usable = rows.where("canonical is not null and at is not null")
    unusable = rows.where("kind = 'revisit' and (canonical is null or at is null)")
    full = F.struct("at", "record_id", "payload", "headers")
    is_full = F.col("kind") == "response"

    spans = usable.groupBy("canonical", "span").agg(F.max(F.when(is_full, F.struct("at", "record_id"))).alias("k"), F.max_by(full, F.when(is_full, F.struct("at", "record_id"))).alias("last_full"))
    by_span = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("canonical", "span", F.last(F.when(F.col("k").isNotNull(), F.col("last_full")), ignorenulls=True).over(by_span).alias("carried"))

    # At one time revisits sort before responses, so that these are not earlier.
    within = Window.partitionBy("canonical", "span").orderBy("at", F.when(is_full, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = usable.withColumn("near", F.last(F.when(is_full, full), ignorenulls=True).over(within)).where("kind = 'revisit'")
    found = seen.join(carried, ["canonical", "span"], "left").withColumn("full", F.coalesce("near", "carried")).drop("near", "carried")
    none = F.lit(None).cast(found.schema["full"].dataType)
    found = found.unionByName(unusable.withColumn("full", none))

    found = found.withColumn("stored", F.col("full.headers"))
    tag, stored_tag = _tag("headers"), _tag("stored")
    date, stored_date = F.col("headers").getItem("last-modified"), F.col("stored").getItem("last-modified")
    agree = F.when(tag.isNotNull(), tag.eqNullSafe(stored_tag)).when(date.isNotNull(), F.coalesce(http_date(date) == http_date(stored_date), date.eqNullSafe(stored_date)))
    status = F.when(F.col("full").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    done = F.col("status") == "resolved"
    return found.withColumn("status", status).select(
        "record_id", "canonical", "at", "status",
        F.when(F.col("status") != "validator_mismatch", F.col("full.record_id")).alias("resolved_id"),
        F.when(F.col("status") != "validator_mismatch", F.col("full.at")).alias("resolved_at"),
        F.when(done, F.col("full.payload")).alias("payload"),
        F.when(done, merged_headers(F.col("stored"), F.col("headers"))).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of every page: each is fetched in full, and fetched twice more, where the server says "not modified".

    The tables hold no archive, so fetch times and validators follow from the id
    and the page: fetch ``n`` of a page is ``n`` days and ``page_id`` seconds after
    2024-01-01. The entity tag is the MD5 of the page, but every fifth second
    fetch names another one and every seventh names none.
    """
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.md5(text.cast("binary")).alias("digest"), F.length(text).cast("string").alias("size"))
    fetches = base.withColumn("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") * 86_400 + F.col("page_id"))
    page = F.col("page_id")
    tag = F.when((F.col("n") == 1) & (page % 5 == 0), F.lit('"changed"')).when((F.col("n") == 1) & (page % 7 == 0), F.lit(None)).otherwise(F.concat(F.lit('"'), F.col("digest"), F.lit('"')))
    fields = F.map_filter(F.create_map(F.lit("ETag"), tag, F.lit("Date"), at.cast("string"), F.lit("Content-Length"), F.when(F.col("n") == 0, F.col("size")).otherwise(F.lit("0"))), lambda k, v: v.isNotNull())
    return fetches.select((page * 3 + F.col("n")).alias("record_id"), "url", at.alias("at"), F.when(F.col("n") == 0, "response").otherwise("revisit").alias("kind"), fields.alias("headers"), F.when(F.col("n") == 0, F.col("digest")).alias("payload"))


def oracle(pages: str = "pages") -> str:
    """Resolved revisits of ``records_of_pages`` as DuckDB SQL."""
    return f"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, ''))::VARCHAR AS size, unnest([0, 1, 2]) AS n FROM {pages}),
c0 AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM base),
c1 AS (SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)[.]', '') AS host,
    regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''), '[?].*$', ''), '/+$', '') AS path,
    list_sort(list_filter(string_split(CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*[?]', '') ELSE '' END, '&'),
      lambda p: p <> '' AND NOT regexp_matches(lower(p), '{TRACKING}'))) AS params FROM c0),
rec AS (SELECT page_id * 3 + n AS record_id, n, digest, size,
    host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical,
    TIMESTAMP '2024-01-01' + to_seconds((n * 86400 + page_id)::BIGINT) AS "at",
    CASE WHEN n = 1 AND page_id % 5 = 0 THEN '"changed"' WHEN n = 1 AND page_id % 7 = 0 THEN NULL ELSE '"' || digest || '"' END AS tag FROM c1),
ranked AS (SELECT r.record_id, r.canonical, r."at", r.tag, f.record_id AS full_id, f."at" AS full_at, f.digest, f.size, f.tag AS full_tag,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f."at" DESC, f.record_id DESC) AS nth
  FROM rec r LEFT JOIN rec f ON f.n = 0 AND f.canonical = r.canonical AND f."at" < r."at" WHERE r.n > 0),
s AS (SELECT *, CASE WHEN full_id IS NULL THEN 'no_earlier_response' WHEN tag IS NULL THEN 'no_validator' WHEN tag = full_tag THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM ranked WHERE nth = 1)
SELECT record_id, canonical, strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", status,
  CASE WHEN status <> 'validator_mismatch' THEN full_id END AS resolved_id,
  CASE WHEN status <> 'validator_mismatch' THEN strftime(full_at, '%Y-%m-%d %H:%M:%S') END AS resolved_at,
  CASE WHEN status = 'resolved' THEN digest END AS payload,
  CASE WHEN status = 'resolved' THEN 'content-length=' || size || ';date=' || strftime("at", '%Y-%m-%d %H:%M:%S') || ';etag=' || tag END AS headers
FROM s
"""
