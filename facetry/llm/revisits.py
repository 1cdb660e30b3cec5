"""Not-modified revisits of web archives, resolved to the response they stand for.

Input records: ``record_id long, url string, ts timestamp, kind string ('response' or
'revisit'), headers map<string,string>``.  A revisit stands for the latest response of
its canonical URL with a strictly earlier time; of several responses at that time the
one with the smallest id.  Validators are then checked: entity tags (weakly, that is
without "W/") when both sides have one, otherwise the last-modified dates.  The resolved
headers are the response's, updated by the revisit's where a 304 answer may do so.

``status``: ``resolved``; ``unchecked`` (no validator on both sides; headers merged);
``mismatch`` (headers null); ``no_response`` (nothing earlier); ``incomplete`` (null url,
time or empty canonical URL).  Null ids are allowed for revisits, not for responses
(such responses are ignored), as are unknown kinds.  Of several responses with one id
the earliest counts.  Repeated revisits are answered one by one.

The as-of join runs on distinct (URL, time) pairs.  A URL's timeline is cut into slices
at quantiles of all times, so one URL with a third of all records spreads over the
slices; between slices only the last response per (URL, slice) is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.joins import lookup_join

SLICES = 64
# Headers of a stored response that a 304 answer must not replace.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host without "www." and default port, path without closing slashes, query without
    ``utm_`` parameters; no scheme, user or fragment.  Host in lower case."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    plain = F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1)
    query = F.regexp_replace(query, r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lower_keys(headers: Column) -> Column:
    """A header map with lower-case names; of names that fall together the first in order."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    first = F.transform(names, lambda n: F.filter(entries, lambda e: F.lower(e["key"]) == n)[0]["value"])
    return F.map_from_arrays(names, first)


def merged(stored: Column, update: Column) -> Column:
    """Stored headers, updated where permitted."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*KEPT_HEADERS) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(rest, permitted)


def latest_earlier(events: DataFrame, slices: int = SLICES) -> DataFrame:
    """``c, ts, earlier``: id of the latest response before ``ts``, for asked events.

    ``events``: one row per (c, ts) with ``rid`` (a response's id or null) and ``asked``.
    """
    cuts = sorted(set(
        events.select(F.unix_micros("ts").alias("t"))
        .approxQuantile("t", [i / slices for i in range(1, slices)], 0.001)
    ))
    place = F.unix_micros("ts")
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= place)) if cuts else F.lit(0)
    rows = events.withColumn("part", part)
    inside = Window.partitionBy("c", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.last("rid", ignorenulls=True).over(inside))
    ends = rows.where(F.col("rid").isNotNull()).groupBy("c", "part").agg(F.max_by("rid", "ts").alias("end"))
    # At most ``slices`` rows per URL.
    carried = rows.where("asked").select("c", "part").distinct().join(ends, ["c", "part"], "full").withColumn(
        "carry", F.last("end", ignorenulls=True).over(
            Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ).select("c", "part", "carry")
    return rows.where("asked").join(carried, ["c", "part"], "left").select(
        "c", "ts", F.coalesce("inner", "carry").alias("earlier")
    )


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """``revisit_id, url, ts, status, response_id, headers`` for every revisit."""
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("c"), "ts", F.lower("kind").alias("kind"),
        lower_keys(F.col("headers")).alias("headers"),
    )
    known = F.col("ts").isNotNull() & (F.coalesce(F.col("c"), F.lit("")) != "")
    answers = rows.where((F.col("kind") == "response") & F.col("record_id").isNotNull() & known)
    revisits = rows.where(F.col("kind") == "revisit")
    response = F.when((F.col("kind") == "response"), F.col("record_id"))
    events = rows.where(known & F.col("kind").isin("response", "revisit")).groupBy("c", "ts").agg(
        F.min(response).alias("rid"), F.max(F.col("kind") == "revisit").alias("asked")
    )
    found = latest_earlier(events, slices)
    stored = answers.groupBy("record_id").agg(
        F.min(F.struct("ts", "c", F.array_sort(F.map_entries("headers")).alias("h"))).alias("r")
    ).select(F.col("record_id").alias("response_id"), F.map_from_entries("r.h").alias("stored"))
    # One response may answer most revisits: its key is dealt over several tasks.
    joined = lookup_join(
        revisits.join(found, ["c", "ts"], "left").withColumnRenamed("earlier", "response_id"), stored, "response_id"
    )
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), r"^W/", "")
    date = lambda h: F.element_at(h, "last-modified")
    by_tag = tag(F.col("stored")) == tag(F.col("headers"))
    by_date = date(F.col("stored")) == date(F.col("headers"))
    same = F.coalesce(by_tag, by_date)
    status = (
        F.when(~known, "incomplete").when(F.col("response_id").isNull(), "no_response")
        .when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    )
    return joined.select(
        F.col("record_id").alias("revisit_id"), F.col("c").alias("url"), "ts", status.alias("status"),
        "response_id", merged(F.col("stored"), F.col("headers")).alias("_merged"),
    ).withColumn(
        "headers", F.when(F.col("status").isin("resolved", "unchecked"), F.col("_merged"))
    ).drop("_merged")


def header_text(headers: Column) -> Column:
    """``name: value`` lines by name; null for null."""
    lines = F.transform(
        F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.when(headers.isNotNull(), F.array_join(lines, "\n"))
