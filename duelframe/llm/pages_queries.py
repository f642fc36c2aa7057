"""Queries over ``pages``, taken as a crawl: each page gives a full response and three later or earlier revisits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from duelframe.llm import warc
from duelframe.llm.catalog import register, table


def archive(pages: DataFrame) -> DataFrame:
    """Records of a crawl in page order: a response per page; a revisit with its entity tag, one with a weak or foreign
    tag a while later, and one with a modification date that may come before any response."""
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    foreign = F.concat(F.lit('"'), F.md5("url"), F.lit('"'))
    pairs = lambda *kv: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kv]), F.array(*[v for _, v in kv])), lambda k, v: v.isNotNull())
    size = F.octet_length("html").cast("string")
    records = [
        (0, F.col("page_id"), "response", 200, pairs(("etag", tag), ("last-modified", date), ("content-length", size), ("content-type", F.lit("text/html")), ("cache-control", F.lit("max-age=60")))),
        (1, F.col("page_id") + 1, "revisit", 304, pairs(("etag", tag), ("cache-control", F.lit("max-age=120")), ("content-length", F.lit("0")))),
        (2, F.col("page_id") + 500, "revisit", 304, pairs(("etag", F.when(F.col("page_id") % 7 == 0, foreign).otherwise(F.concat(F.lit("W/"), tag))), ("vary", F.lit("accept")))),
        (3, F.col("page_id") * 2 - 100, "revisit", 304, pairs(("last-modified", date), ("set-cookie", F.lit("no")))),
    ]
    each = F.explode(F.array(*[
        F.struct((F.col("page_id") * 4 + n).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("kind"), F.lit(code).alias("code"), headers.alias("headers"))
        for n, ts, kind, code, headers in records]))
    return pages.select("url", each.alias("r")).select("url", "r.*")


ARCHIVE_SQL = r"""
WITH parts AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '(?i)^https?://', ''), '#.*$', '') AS bare FROM pages
),
pieces AS (
  SELECT *, regexp_replace(bare, '[?].*$', '') AS path,
         CASE WHEN strpos(bare, '?') > 0 THEN regexp_replace(bare, '^[^?]*[?]', '') ELSE '' END AS query FROM parts
),
urls AS (
  SELECT page_id, html, md5(url) AS url_hash,
    regexp_replace(regexp_replace(lower(regexp_extract(path, '^[^/]*')), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '^[^/]*', ''), '/+$', '')
      || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS url
  FROM (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=')) AS kept FROM pieces)
),
records AS (
  SELECT page_id * 4 AS id, url, page_id AS ts, 1 AS full_one, '"' || md5(html) || '"' AS etag, 'day ' || (page_id % 28)::VARCHAR AS modified,
         strlen(html)::VARCHAR AS size, 'max-age=60' AS cache, CAST(NULL AS VARCHAR) AS vary FROM urls
  UNION ALL SELECT page_id * 4 + 1, url, page_id + 1, 0, '"' || md5(html) || '"', NULL, '0', 'max-age=120', NULL FROM urls
  UNION ALL SELECT page_id * 4 + 2, url, page_id + 500, 0, CASE WHEN page_id % 7 = 0 THEN '"' || url_hash || '"' ELSE 'W/"' || md5(html) || '"' END, NULL, NULL, NULL, 'accept' FROM urls
  UNION ALL SELECT page_id * 4 + 3, url, page_id * 2 - 100, 0, NULL, 'day ' || (page_id % 28)::VARCHAR, NULL, NULL, NULL FROM urls
),
matched AS (
  SELECT v.*, last_value(CASE WHEN v.full_one = 1 THEN v.id END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS response_id FROM records v
),
checked AS (
  SELECT m.id AS revisit_id, m.url, m.response_id, m.vary, m.cache, m.etag, r.etag AS old_etag, r.modified AS old_modified, m.modified, r.size, r.cache AS old_cache,
    CASE WHEN m.response_id IS NULL THEN 'missing'
         WHEN coalesce(CASE WHEN m.etag IS NOT NULL THEN regexp_replace(m.etag, '^W/', '') = r.etag ELSE m.modified = r.modified END, false) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM matched m LEFT JOIN records r ON r.id = m.response_id AND r.full_one = 1 WHERE m.full_one = 0
)
SELECT revisit_id, url, response_id, status,
  CASE WHEN status = 'resolved' THEN coalesce(etag, old_etag) END AS etag, CASE WHEN status = 'resolved' THEN coalesce(modified, old_modified) END AS last_modified,
  CASE WHEN status = 'resolved' THEN size END AS content_length, CASE WHEN status = 'resolved' THEN coalesce(cache, old_cache) END AS cache_control,
  CASE WHEN status = 'resolved' THEN vary END AS vary, CASE WHEN status = 'resolved' THEN 5 + CASE WHEN vary IS NULL THEN 0 ELSE 1 END END AS n_headers
FROM checked
"""


@register("op2_warc_revisits", ARCHIVE_SQL)
def op2(spark, folder):
    found = warc.resolve_revisits(archive(table(spark, folder, "pages")))
    h = F.col("headers")
    return found.select(
        "revisit_id", "url", "response_id", "status", h["etag"].alias("etag"), h["last-modified"].alias("last_modified"), h["content-length"].alias("content_length"),
        h["cache-control"].alias("cache_control"), h["vary"].alias("vary"), F.when(h.isNotNull(), F.size(h)).alias("n_headers"))
