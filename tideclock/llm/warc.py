"""Not-modified revisits of a crawl archive, resolved to the responses they stand for.

A revisit is joined as of its date to the latest earlier full response of the
same canonical URL. Where their validators agree, the record gets that
response's body and its headers, updated by those that a 304 answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tideclock.llm import scratch
from tideclock.operators.ranges import quantile_bounds, range_of

# Query parameters that do not change a page, and headers that a 304 may update.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Parts of about equally many records into which time is cut; the last response of each part of a URL is carried on.
PARTS = 1024


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and port, path without last slashes, sorted query without tracking, no scheme or fragment."""
    base = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, base + r"([^/?#]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, base + r"[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))
    joined = F.array_join(F.array_sort(query), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def _folded(headers: Column) -> Column:
    """Headers that have a value, with names in lower case; of names equal but for case the last in byte order counts."""
    given = F.filter(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    entries = F.array_sort(given)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])))


def _merged(stored: Column, sent: Column) -> Column:
    """Stored headers with the permitted ones of the revisit over them; names in lower case."""
    fresh = F.map_filter(_folded(sent), lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(_folded(stored), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(kept, fresh)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, status, response_id, headers, body.

    ``records``: record_id (unique), kind ('response' or 'revisit'), url, date
    (a number), http_status, etag, last_modified, headers (map), body. Only
    responses of status 200 count as full. Earlier means a smaller date, or the
    same date and a smaller record_id. status is ``resolved``, ``no_response``,
    ``no_validator`` (the revisit names neither etag nor last_modified) or
    ``mismatch``; entity tags are compared weakly and go before dates. All but
    resolved records have null headers and body. A null url or date has no
    response. Header names are folded; of names equal but for case the one that
    is last in byte order counts, and headers without a value are left out.
    Rows of one record_id are taken as separate records. An empty table gives no
    rows; other columns are not read.

    Bodies do not take part in the as-of join; they are fetched by record_id.
    A URL with very many records is cut into parts of time, each a group of its
    own, and only the last response of each part is carried to later parts.
    """
    narrow = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical_url"), "date", "http_status", "etag", "last_modified", "headers")
    narrow = scratch.materialize(narrow, "captures")
    bounds = quantile_bounds(narrow, "date", PARTS)
    full = (F.col("kind") == "response") & (F.col("http_status") == 200) & F.col("date").isNotNull()
    found = F.struct("record_id", "etag", "last_modified", "headers")
    cut = narrow.withColumn("part", range_of(F.col("date"), bounds, dict(narrow.dtypes)["date"]))
    timed = cut.filter(F.col("canonical_url").isNotNull() & F.col("date").isNotNull())
    inner = W.partitionBy("canonical_url", "part").orderBy("date", "record_id").rowsBetween(W.unboundedPreceding, -1)
    timed = timed.withColumn("near", F.last(F.when(full, found), ignorenulls=True).over(inner))
    ends = cut.filter(full & F.col("canonical_url").isNotNull()).groupBy("canonical_url", "part").agg(F.max_by(found, F.struct("date", "record_id")).alias("end"))
    here = cut.filter("kind = 'revisit'").select("canonical_url", "part").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    parts = ends.unionByName(here).groupBy("canonical_url", "part").agg(F.first("end", ignorenulls=True).alias("end"))
    before = W.partitionBy("canonical_url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most PARTS rows of a URL
    carried = parts.select("canonical_url", "part", F.last("end", ignorenulls=True).over(before).alias("far"))
    revisits = timed.filter("kind = 'revisit'").join(carried.hint("merge"), ["canonical_url", "part"], "left")
    revisits = revisits.withColumn("r", F.coalesce("near", "far")).select("record_id", "canonical_url", "etag", "last_modified", "headers", "r")
    loose = cut.filter((F.col("kind") == "revisit") & (F.col("canonical_url").isNull() | F.col("date").isNull())).select("record_id", "canonical_url", "etag", "last_modified", "headers")
    revisits = revisits.unionByName(loose, allowMissingColumns=True)
    agrees = F.when(F.col("etag").isNotNull(), _weak(F.col("etag")) == _weak(F.col("r.etag"))).otherwise(F.col("last_modified") == F.col("r.last_modified"))
    status = F.when(F.col("r").isNull(), "no_response").when(F.col("etag").isNull() & F.col("last_modified").isNull(), "no_validator").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    judged = revisits.withColumn("status", status)
    good = F.col("status") == "resolved"
    judged = judged.select("record_id", "canonical_url", "status", F.col("r.record_id").alias("response_id"), F.when(good, _merged(F.col("r.headers"), F.col("headers"))).alias("headers"), F.when(good, F.col("r.record_id")).alias("body_id"))
    bodies = records.filter("kind = 'response'").select(F.col("record_id").alias("body_id"), "body")
    return judged.join(bodies.hint("merge"), "body_id", "left").drop("body_id")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: each is fetched in full once, and asked for again a day later.

    Some of the later answers bear another entity tag, some a date only, some
    no validator at all.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    header = lambda **kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for k, v in kv.items() for x in (k.replace("_", "-"), v)))
    modified = (page * 60 - 30).cast("string")
    response = pages.select(
        (page * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (page * 60).alias("date"), F.when(page % 17 == 0, 404).otherwise(200).alias("http_status"),
        tag.alias("etag"), modified.alias("last_modified"),
        header(Content_Type="text/html", ETag=tag, Last_Modified=modified, Cache_Control="max-age=60", Date=(page * 60).cast("string")).alias("headers"), F.col("html").alias("body"),
    )
    seen = F.when(page % 5 == 0, '"other"').when(page % 5 == 1, F.concat(F.lit("W/"), tag)).when(page % 5 < 4, tag)
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (page * 60 + 86400).alias("date"), F.lit(304).alias("http_status"),
        seen.alias("etag"), F.when((page % 5 == 4) & (page % 2 == 0), modified).alias("last_modified"),
        header(Date=(page * 60 + 86400).cast("string"), Cache_Control="max-age=90", Content_Length="0", Set_Cookie="a=b").alias("headers"), F.lit(None).cast("string").alias("body"),
    )
    return response.unionByName(revisit)
