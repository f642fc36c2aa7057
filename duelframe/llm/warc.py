"""Not-modified revisits of a web archive, resolved to the full response that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from duelframe.llm.staging import stage

# Header fields that a 304 response may update, and query parameters that only track visitors.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, www. and default port; no fragment, tracking parameters or final slash; other parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "(?i)^https?://", ""), "#.*$", "")
    path = F.regexp_replace(bare, "[?].*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, "^[^/]*", 0)), "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(path, "^[^/]*", ""), "/+$", "")
    query = F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, "^[^?]*[?]", "")).otherwise(F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.concat(host, rest, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, permitted: tuple[str, ...] = PERMITTED) -> DataFrame:
    """One row per revisit: revisit_id, url, response_id, status, headers.

    ``records`` has record_id, url, ts, kind ("response" or "revisit"), code, headers (map with lower-case names); other
    columns are ignored. A revisit refers to the latest full response (kind response, code 200) of its canonical URL
    that comes before it in (ts, record_id). Status: "resolved" when the entity tags agree (weak comparison), or, where
    the revisit has none, the modification dates; "mismatch" when a validator differs or neither is there; "missing"
    without an earlier response, URL or time. Resolved rows carry the response's headers, those that a 304 may update
    replaced by the revisit's. Repeated rows each give their row; an empty table gives none.

    The as-of join is one ordered scan. Rows are range-partitioned by (url, ts, id), so a URL with a third of all
    records is many chunks; each chunk looks back within itself, and starts from the last response of the chunks before.
    """
    order = ["url", "ts", "record_id"]
    events = records.select(
        canonical_url(F.col("url")).alias("url"), F.col("ts"), F.col("record_id").cast("long").alias("record_id"), "kind", "code",
        F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")).alias("headers")).where("kind IN ('response', 'revisit')")
    usable = events.where("url IS NOT NULL AND ts IS NOT NULL AND record_id IS NOT NULL")
    full = (F.col("kind") == "response") & (F.col("code") == 200)
    chunked = stage(usable.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()).withColumn(
        "response", F.when(full, F.struct(F.col("record_id").alias("id"), "headers"))), "warc-records")
    inside = W.partitionBy("chunk", "url").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    near = chunked.withColumn("near", F.last("response", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    ends = chunked.where("response IS NOT NULL").groupBy("chunk", "url").agg(F.max_by("response", F.struct("ts", "record_id")).alias("end"))
    spans = chunked.groupBy("chunk", "url").agg(F.count(F.lit(1)).alias("n")).join(ends, ["chunk", "url"], "left")
    before = W.partitionBy("url").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where("carried IS NOT NULL").select("chunk", "url", "carried")
    found = near.join(carried, ["chunk", "url"], "left").select("record_id", "url", "headers", F.coalesce("near", "carried").alias("response"))
    lost = events.where("kind = 'revisit' AND (url IS NULL OR ts IS NULL OR record_id IS NULL)").select(
        "record_id", "url", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response"))
    both = found.unionByName(lost)
    tag, old_tag = F.col("headers")["etag"], F.col("response.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("response.headers")["last-modified"]
    agree = F.coalesce(F.when(tag.isNotNull(), _opaque(tag) == _opaque(old_tag)).otherwise(date == old_date), F.lit(False))
    update = F.map_filter("headers", lambda k, v: k.isin(*permitted) & v.isNotNull())
    merged = F.map_concat(F.map_filter("response.headers", lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    return both.select(
        F.col("record_id").alias("revisit_id"), "url", F.col("response.id").alias("response_id"),
        F.when(F.col("response").isNull(), "missing").when(agree, "resolved").otherwise("mismatch").alias("status"),
        F.when(F.col("response").isNotNull() & agree, merged).alias("headers"))
