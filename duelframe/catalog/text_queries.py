"""Text cells, dates and stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import CATALOG, query, r
from duelframe.functions import numbers as nf, ratings as rf, text as tx
from duelframe.operators import clean, pairs
from duelframe.sources import page_nodes, pages as pg


@query("parse_cells", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS acc, CAST(l_quantity AS INT) + l_linenumber AS att,
  CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber * 60 + CAST(l_quantity AS INT) END AS ctrl,
  CAST(((l_linenumber - 1) * 300 + (l_linenumber % 5) * 60 + 10 + CAST(l_quantity AS INT) % 50) // 60 AS INT) AS minutes,
  (5 + l_linenumber % 2) * 12.0::DOUBLE + CAST(l_quantity AS INT) % 12 AS height, CASE WHEN l_returnflag <> 'A' THEN 100.0::DOUBLE + CAST(l_quantity AS INT) END AS weight,
  CASE WHEN l_returnflag <> 'A' THEN 60.0::DOUBLE + l_linenumber END AS reach
FROM lineitem""")
def parse_cells(t):
    q, n, known = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_returnflag") != "A"
    cells = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(q, F.lit(" of "), q + n).alias("cell"),
        F.when(~known, "--").otherwise(F.concat(n, F.lit(":"), q)).alias("clock"), n.cast("string").alias("round"),
        F.concat(n % 5, F.lit(":"), 10 + q % 50).alias("time"), F.concat(5 + n % 2, F.lit("' "), q % 12, F.lit('"')).alias("h"),
        F.when(known, F.concat(100 + q, F.lit(" lbs."))).otherwise("--").alias("w"), F.when(known, F.concat(60 + n, F.lit('"'))).otherwise("--").alias("rch"),
    )
    return cells.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tx.landed("cell").alias("acc"), tx.attempted("cell").alias("att"), tx.clock_seconds("clock").alias("ctrl"),
        tx.elapsed_minutes("round", "time").alias("minutes"), tx.height_inches("h").alias("height"), tx.weight_pounds("w").alias("weight"), tx.reach_inches("rch").alias("reach"),
    )


@query("parse_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS long_form, CAST(o_orderdate AS DATE) AS short_form, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS lenient,
  r4(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-06-15') / 365.25::DOUBLE) AS age,
  CAST(2002 - year(o_orderdate) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) <= 615 THEN 0 ELSE 1 END AS INT) AS whole_age,
  strftime(o_orderdate, '%Y-%m') AS ym, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders""")
def parse_dates(t):
    d = F.col("o_orderdate").cast("date")
    on = F.lit("2002-06-15").cast("date")
    o = t.orders.select("o_orderkey", d.alias("d"), F.date_format(d, "MMMM d, yyyy").alias("a"), F.date_format(d, "MMM d, yyyy").alias("b"),
                        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd")).otherwise("Date of birth not found").alias("c"))
    return o.select(
        "o_orderkey", tx.long_date("a").alias("long_form"), tx.any_date("b", ["yyyy/MM/dd", "MMM d, yyyy"]).alias("short_form"), tx.any_date("c", ["yyyy-MM-dd"]).alias("lenient"),
        r(nf.age_years(on, "d")).alias("age"), nf.whole_years(on, "d").alias("whole_age"), F.date_format("d", "yyyy-MM").alias("ym"), F.date_trunc("month", "d").cast("date").alias("month"),
    )


@query("name_helpers", """
SELECT c_custkey, replace(c_name, ' ', '') AS key, regexp_replace(lower(c_name), '\\W+', '', 'g') AS normal, CASE WHEN c_mktsegment NOT IN ('MACHINERY') THEN c_mktsegment END AS known,
  contains(lower(c_name), 'r#0') AS has, trim(regexp_replace('Label: ' || c_name, '^(.+?): ?', '')) AS value, 'A ' || c_custkey AS a, 'B ' || c_nationkey AS b,
  r4(1 - levenshtein(c_name, 'Customer#000000500') / 18.0::DOUBLE) AS similarity FROM customer""")
def name_helpers(t):
    bout = F.concat(F.lit("A "), "c_custkey", F.lit(" vs. B "), "c_nationkey")
    mark = F.when(F.col("c_mktsegment") == "MACHINERY", "--").otherwise(F.col("c_mktsegment"))
    return t.customer.select(
        "c_custkey", tx.join_key("c_name").alias("key"), tx.normal_name("c_name").alias("normal"), tx.unknown_to_null(mark).alias("known"),
        tx.contains_ci("c_name", F.lit("R#0")).alias("has"), F.trim(tx.strip_label(F.concat(F.lit("Label: "), "c_name"))).alias("value"),
        tx.left_side(bout).alias("a"), tx.right_side(bout).alias("b"), r(tx.edit_ratio("c_name", F.lit("Customer#000000500"))).alias("similarity"),
    )


@query("block_similarity", None)
def block_similarity(t):
    """Matching-block ratio of every part name to its brand's smallest name; tested against the standard library."""
    first = t.part.groupBy("p_brand").agg(F.min("p_name").alias("first_name"))
    return t.part.join(first, "p_brand").select("p_partkey", "p_name", "first_name", tx.block_ratio("p_name", "first_name").alias("similarity"))


K_SQL = """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 1 + l_linenumber % 3 AS rnd, CASE WHEN l_returnflag = 'A' THEN '3 Rnd (5-5-5)' WHEN l_returnflag = 'N' THEN '5 Rnd (5-5-5-5-5)' ELSE '1 Rnd (10)' END AS fmt, CAST(floor(l_quantity / 10) AS INT) AS nat FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN rnd = 1 THEN 1.15::DOUBLE * 1.15::DOUBLE ELSE 1 END AS first_bonus,
  r4(CASE WHEN rnd > CAST(substr(fmt, 1, 1) AS INT) THEN 1.0::DOUBLE ELSE 1 + (1 - rnd / CAST(substr(fmt, 1, 1) AS DOUBLE)) * 0.25 END) AS round_mod,
  r4(CASE WHEN rnd > CASE WHEN contains(fmt, '5') THEN 5 ELSE 1 END THEN 1.0::DOUBLE ELSE 1 + (1 - rnd / CASE WHEN contains(fmt, '5') THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END) * 0.25 END) AS round_mod_legacy,
  r4(CASE WHEN abs(nat - 3) < 1 THEN 1.0::DOUBLE ELSE greatest(0.75::DOUBLE, 1 - 0.08 * abs(nat - 3)) END) AS class_mod FROM m"""


@query("k_factor_inputs", K_SQL)
def k_factor_inputs(t):
    fmt = F.when(F.col("l_returnflag") == "A", "3 Rnd (5-5-5)").when(F.col("l_returnflag") == "N", "5 Rnd (5-5-5-5-5)").otherwise("1 Rnd (10)")
    m = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (1 + F.col("l_linenumber") % 3).alias("rnd"), fmt.alias("fmt"), F.floor(F.col("l_quantity") / 10).cast("int").alias("nat"))
    return m.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", rf.first_round_bonus("rnd").alias("first_bonus"), r(rf.round_modifier("rnd", "fmt")).alias("round_mod"),
                    r(rf.round_modifier("rnd", "fmt", legacy=True)).alias("round_mod_legacy"), r(rf.weight_modifier("nat", F.lit(3), F.lit(1))).alias("class_mod"))


@query("irregular_formats", """
WITH f AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '3 Rnd (5-5-5)' WHEN '2-HIGH' THEN '1 Rnd (20)' ELSE '5 Rnd (5-5-5-5-5)' END AS fmt, CAST(1 + o_orderkey % 2 AS VARCHAR) AS rnd FROM orders)
SELECT * FROM f WHERE NOT (fmt NOT IN ('3 Rnd (5-5-5)', '5 Rnd (5-5-5-5-5)', '2 Rnd (5-5)', '3 Rnd + OT (5-5-5-5)') AND rnd <> '1')""")
def irregular_formats(t):
    fmt = F.when(F.col("o_orderpriority") == "1-URGENT", "3 Rnd (5-5-5)").when(F.col("o_orderpriority") == "2-HIGH", "1 Rnd (20)").otherwise("5 Rnd (5-5-5-5-5)")
    return clean.drop_irregular(t.orders.select("o_orderkey", fmt.alias("fmt"), (1 + F.col("o_orderkey") % 2).cast("string").alias("rnd")), "fmt", "rnd")


# ---------------------------------------------------------------- pages

@query("page_heads", """
SELECT page_id, regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title>', 1) AS title, regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1) AS lang,
  regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1) AS heading FROM pages""")
def page_heads(t):
    return t.pages.select("page_id", pg.tag_text("html", "title").alias("title"), pg.attribute("html", "html", "lang").alias("lang"), pg.tag_text("html", "h1").alias("heading"))


@query("page_links", """
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\\s[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1) AS h, regexp_extract_all(html, '(?s)<a\\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS s FROM pages)
SELECT page_id, CAST(place - 1 AS INT) AS place, h[place] AS href, trim(regexp_replace(regexp_replace(s[place], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text
FROM (SELECT *, unnest(range(1, len(h) + 1)) AS place FROM x)""")
def page_links(t):
    return pg.links(t.pages, ["page_id"])


@query("page_node_links", CATALOG["page_links"].sql)
def page_node_links(t):
    """The same links from the table of nodes, which also stands scripts, comments and tags that are never closed."""
    return page_nodes.node_links(page_nodes.page_nodes(t.pages, ["page_id"]), ["page_id"])


@query("page_elements", """
WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>|<style[^>]*>).*?(</script>|</style>)', '\\1\\2', 'g') AS html FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM c)
SELECT page_id, tag, count(*) AS elements FROM e GROUP BY ALL""")
def page_elements(t):
    """Elements of every page by tag."""
    nodes = page_nodes.page_nodes(t.pages, ["page_id"]).where("node > 0")
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


@query("page_paragraph_cells", """
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1) AS c FROM pages),
y AS (SELECT page_id, unnest(range(1, len(c) + 1)) AS i, c FROM x)
SELECT page_id, CAST((i - 1) % 2 AS INT) AS side, CAST(count(*) AS BIGINT) AS cells, CAST(sum(length(trim(regexp_replace(regexp_replace(c[i], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')))) AS BIGINT) AS chars FROM y GROUP BY 1, 2""")
def page_paragraph_cells(t):
    """Alternating lines of a page belong to side A and B: lines and characters per side, over whole pages."""
    wrapped = t.pages.withColumn("html", F.concat(F.lit("<td>"), F.regexp_replace("html", "</?td[^>]*>", ""), F.lit("</td>")))
    cells = pg.stat_cells(wrapped, ["page_id"])
    return cells.groupBy("page_id", "side").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.length("value")).alias("chars"))


@query("page_label_values", """
WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1)) AS raw FROM (SELECT page_id, replace(html, '</a></li>', ': ' || page_id || '</a></li>') AS html FROM pages)),
y AS (SELECT page_id, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS s FROM x)
SELECT page_id, trim(split_part(s, ':', 1)) AS label, trim(regexp_replace(s, '^(.+?): ?', '')) AS value FROM y WHERE contains(s, ':')""")
def page_label_values(t):
    html = F.replace(F.col("html"), F.lit("</a></li>"), F.concat(F.lit(": "), F.col("page_id").cast("string"), F.lit("</a></li>")))
    return pg.label_values(t.pages.select("page_id", html.alias("html")), ["page_id"]).select("page_id", "label", "value")


@query("page_link_records", """
WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\\s[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS s FROM pages),
y AS (SELECT page_id, unnest(range(len(s))) AS i, s FROM x),
z AS (SELECT page_id, i % 2 AS side, i // 2 AS pair, trim(regexp_replace(regexp_replace(s[i + 1], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS value FROM y),
f AS (SELECT *, first_value(value) OVER (PARTITION BY page_id, side ORDER BY pair) AS name FROM z),
g AS (SELECT *, sum(CASE WHEN value = name THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, side ORDER BY pair ROWS UNBOUNDED PRECEDING) - 1 AS record FROM f)
SELECT page_id, CAST(side AS INT) AS side, name, CAST(record AS BIGINT) AS record, CAST(row_number() OVER (PARTITION BY page_id, side, record ORDER BY pair) - 1 AS INT) AS place, value FROM g""")
def page_link_records(t):
    """Cells in page order split into records whenever a side's first cell repeats."""
    cells = pg.links(t.pages, ["page_id"]).select("page_id", F.lit(0).alias("cell"), (F.col("place") % 2).alias("side"), F.floor(F.col("place") / 2).cast("int").alias("pair"), F.col("text").alias("value"))
    return pg.stat_records(cells, ["page_id"])


@query("document_language_groups", """
SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(length(text)) AS BIGINT) AS measured FROM documents GROUP BY 1, 2""")
def document_language_groups(t):
    from duelframe.operators.profile import roll_up

    return roll_up(t.documents, ["lang", "source"], {"chars": F.col("n_chars"), "measured": F.length("text")}, count="n")


@query("first_document_per_text", """
SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1""")
def first_document_per_text(t):
    """Keep-first de-duplication by key, over a digest of the whole text so the key stays small."""
    d = t.documents.select("doc_id", "lang", F.md5("text").alias("digest"))
    return clean.first_per_key(d, ["digest"], ["doc_id"]).select("doc_id", "lang")


@query("labelled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def labelled_documents(t):
    return pairs.keep_known(t.documents.select("doc_id", "lang"), t.labels.select("doc_id"), ["doc_id"])


@query("column_surgery", """
SELECT o_orderkey, o_custkey AS entity, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS win, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS result, o_totalprice AS precomp_price, round_even(o_totalprice / 7, 2) AS precomp_share FROM orders""")
def column_surgery(t):
    """Quoted names, stray columns, moved blocks, renamed and rounded columns."""
    o = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("'entity'"), F.lit(1).alias("Unnamed: 0"), (F.col("o_totalprice") > 250000).cast("int").alias("win"),
        F.col("o_totalprice").alias("precomp_price"), (F.col("o_totalprice") / 7).alias("share"),
    )
    o = clean.result_column(clean.drop_prefixed(clean.strip_quotes_from_names(o)), "win", {"share": "precomp_share"})
    o = clean.insert_after_twins(clean.move_columns(o, ["result"], "win", "before"), {"entity": clean.prefixed(o, "precomp_")})
    return nf.round_doubles(o)


@query("number_helpers", """
SELECT o_orderkey, r6((o_orderkey % 50 + 20) / (o_orderkey % 31 + 20)::DOUBLE - 1) AS age_ratio,
  r6(((o_orderkey % 97) / 97.0::DOUBLE + 1 - (o_orderkey % 89) / 89.0::DOUBLE) / 2) AS both_ways, CAST(1 + (o_orderstatus <> 'F')::INT AS INT) AS present
FROM orders WHERE (o_orderstatus <> 'F')::INT + 1 >= 1""")
def number_helpers(t):
    k = F.col("o_orderkey")
    o = t.orders.select("o_orderkey", (k % 50 + 20).cast("double").alias("a"), (k % 31 + 20).cast("double").alias("b"), (k % 97 / F.lit(97.0)).alias("p"), (k % 89 / F.lit(89.0)).alias("q"),
                        F.when(F.col("o_orderstatus") != "F", 1).alias("x"), F.lit(1).alias("y"))
    o = clean.keep_with_any(o, ["x", "y"], 1)
    return o.select("o_orderkey", r(nf.ratio_difference("a", "b"), 6).alias("age_ratio"), r(nf.symmetric_probability("p", "q"), 6).alias("both_ways"),
                    (F.lit(2) - nf.missing_count(["x", "y"])).alias("present"))


@query("clean_texts", """
SELECT conv_id, turn, role, md5(trim(replace(replace(text, chr(10), ''), '  ', ''))) AS digest, length(trim(replace(replace(text, chr(10), ''), '  ', ''))) AS chars FROM conversations""")
def clean_texts(t):
    c = tx.clean_space("text")
    return t.conversations.select("conv_id", "turn", "role", F.md5(c).alias("digest"), F.length(c).cast("bigint").alias("chars"))
