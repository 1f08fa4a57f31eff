"""Revisit records resolved to the captures they stand for.

A revisit says that a page had not changed; its body is that of the latest full response of the same canonical URL
captured before it. The two must not contradict each other: where both carry an entity tag, the tags are compared
weakly, else where both carry a modification time the times must be equal. From the revisit, only headers that may
change without the body replace those of the response.

The as-of join sorts nothing by URL alone: captures are dealt to time ranges, each (URL, range) keeps its last full
response, those are carried forward over the ranges of a URL, and inside a range the carried response stands before
the first capture. A URL with a third of all captures is spread over as many tasks as it has ranges.

Defined cases: a null URL is never resolved ("no original"); a null or unknown record type counts as a full response
when it has a body digest and as "no original" otherwise; captures of the same URL and time are ordered by id, so a
response resolves revisits of its own second only if its id is smaller. Rows that repeat an id resolve alike. Null
headers count as none; where nothing is resolved they stay null. A null time comes before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import id_ranges

#: Headers that a not-modified answer may bring up to date.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Scheme, www. and m. hosts, default ports, fragments, tracking parameters, index files and a last slash go; the host is lower-cased, parameters are sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "(/index)?([.]html?)?/*$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """records: record_id, at (long: time), url, kind, digest, headers (map of lower-case names), and any other columns.

    Adds url_key, original_id, status (full, resolved, mismatch, no original), body_digest and merged_headers, in place
    of columns of these names; all other columns come out as they are.
    """
    ranges = id_ranges(records.select(F.col("at").cast("long").alias("at")), "at")
    added = {"url_key", "original_id", "status", "body_digest", "merged_headers"}
    kept = [c for c in records.columns if c.lower() not in added]
    # the input's columns travel as one, so none of them can be taken for one of ours
    own = {"id": "record_id", "at": "at", "kind": "kind", "digest": "digest", "headers": "headers"}
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), canonical(F.col("url")).alias("url_key"), *[F.col(c).alias(k) for k, c in own.items()])
    rows = rows.withColumn("range", ranges.of("at"))
    full = (F.col("kind") == "response") | (F.coalesce(F.col("kind"), F.lit("")).isin("revisit", "response") == F.lit(False)) & F.col("digest").isNotNull()
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)) & F.col("url_key").isNotNull())
    etag, changed = F.element_at("headers", "etag"), F.element_at("headers", "last-modified")
    capture = F.struct("at", "id", "digest", etag.alias("etag"), changed.alias("changed"), "headers")
    # the last full response of each (URL, range), then of all ranges before it
    last = rows.filter("full").groupBy("url_key", "range").agg(F.max_by(capture, F.struct("at", "id")).alias("last"))
    ordered = Window.partitionBy("url_key").orderBy("range")
    keys = rows.filter("url_key IS NOT NULL AND NOT full").select("url_key", "range").distinct()
    carried = keys.join(last, ["url_key", "range"], "full").withColumn("carried", F.last("last", True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    carried = carried.filter("carried IS NOT NULL").select("url_key", "range", "carried")
    inside = Window.partitionBy("url_key", "range").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("near", F.last(F.when(F.col("full"), capture), True).over(inside)).join(carried, ["url_key", "range"], "left")
    found = found.withColumn("from", F.when(~F.col("full") & F.col("url_key").isNotNull(), F.coalesce("near", "carried")))
    agrees = F.coalesce(_strong(etag) == _strong(F.col("from.etag")), changed == F.col("from.changed"), F.lit(True))
    status = F.when(F.col("full"), "full").when(F.col("from").isNull(), "no original").when(agrees, "resolved").otherwise("mismatch")
    none = F.expr("cast(map() AS map<string, string>)")
    allowed = F.map_filter(F.coalesce("headers", none), lambda k, v: k.isin(*PERMITTED))
    before = F.map_filter(F.coalesce(F.col("from.headers"), none), lambda k, v: ~F.map_contains_key(allowed, k))
    found = found.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return found.select(
        *[F.col("row")[c].alias(c) for c in kept],
        "url_key",
        F.when(F.col("full"), F.col("id")).when(resolved, F.col("from.id")).alias("original_id"),
        "status",
        F.when(F.col("full"), F.col("digest")).when(resolved, F.col("from.digest")).alias("body_digest"),
        F.when(resolved, F.map_concat(before, allowed)).otherwise(F.col("headers")).alias("merged_headers"),
    )
