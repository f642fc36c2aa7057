"""Joins, lookups, as-of, de-duplication, name matching and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import MATCHES_SQL, matches, query, rounded
from duelframe.operators import clean, pairs, quality
from duelframe.sources import tables as src


def _phrases(t):
    """Keyword table drawn from the data: the distinct colour words in front of part names."""
    return t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")).distinct().withColumn("size", F.length("word"))


@query("category_contains", """
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part)
SELECT p_partkey, word, CAST(length(word) AS INT) AS size FROM part JOIN w ON contains(lower(p_name), lower(word))""")
def category_contains(t):
    return pairs.contains_join(t.part.select("p_partkey", "p_name"), "p_name", _phrases(t), "word").select("p_partkey", "word", "size")


@query("category_contains_by_substring", """
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part)
SELECT p_partkey, word FROM part JOIN w ON contains(lower(p_name), lower(word))""")
def category_contains_by_substring(t):
    """Phrases beyond one automaton: several parts, one pass over the texts for each."""
    words = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return pairs.contains_join(t.part.select("p_partkey", "p_name"), "p_name", words, "word", part_bytes=64).select("p_partkey", "word")


@query("category_in_documents", """
WITH w AS (SELECT DISTINCT substr(split_part(p_name, ' ', 2), 1, 3) AS word FROM part)
SELECT doc_id, word FROM documents JOIN w ON contains(lower(text), lower(word))""")
def category_in_documents(t):
    """Whole texts of any length, each read once for all phrases."""
    words = _phrases(t).select(F.substring("word", 1, 3).alias("word")).distinct()
    return pairs.contains_join(t.documents.select("doc_id", "text"), "text", words, "word").select("doc_id", "word")


@query("category_longest", """
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part UNION SELECT DISTINCT substr(split_part(p_name, ' ', 2), 1, 3) FROM part),
m AS (SELECT p_name, word, row_number() OVER (PARTITION BY p_name ORDER BY length(word) DESC, word DESC) AS n FROM (SELECT DISTINCT p_name FROM part) JOIN w ON contains(lower(p_name), lower(word)))
SELECT p_name, word FROM m WHERE n = 1""")
def category_longest(t):
    full = _phrases(t).select("word")
    short = full.select(F.substring("word", 1, 3).alias("word"))
    hits = pairs.contains_join(t.part.select("p_name").distinct(), "p_name", full.unionByName(short).distinct(), "word")
    return pairs.longest_phrase(hits, ["p_name"], "word")


NEAREST_SQL = """
WITH lk AS (SELECT n_regionkey AS grp, n_nationkey * 2 AS size, n_name FROM nation),
p AS (SELECT p_partkey, p_size % 5 AS grp, p_size FROM part),
j AS (SELECT p_partkey, p_size, size, n_name, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(size - p_size), size - p_size DESC) AS n FROM p JOIN lk USING (grp))
SELECT p_partkey, p_size, size, n_name FROM j WHERE n = 1"""


def _nearest(t, limit):
    table = t.nation.select(F.col("n_regionkey").alias("grp"), (F.col("n_nationkey") * 2).alias("size"), "n_name")
    parts = t.part.select("p_partkey", (F.col("p_size") % 5).alias("grp"), "p_size")
    return pairs.nearest_value(parts, "grp", "p_size", table, "size", ["n_name"], ["p_partkey"], limit).select("p_partkey", "p_size", "size", "n_name")


@query("nearest_category", NEAREST_SQL)
def nearest_category(t):
    return _nearest(t, 1_000)


@query("nearest_category_two_pass", NEAREST_SQL)
def nearest_category_two_pass(t):
    """The path for tables too large to broadcast."""
    return _nearest(t, 1)


@query("asof_latest_view", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts > v.ts""")
def asof_latest_view(t):
    ev = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    probes = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = ev.where("event_type = 'view'").select("user_id", "ts", F.struct("event_id", "value").alias("snap"))
    out = pairs.asof_latest(probes, views, ["user_id"], "ts", "snap", "_s", tie=["event_id"])
    return out.select("event_id", "user_id", F.col("_s.event_id").alias("view_id"), F.col("_s.value").alias("view_value"))


@query("side_join", "WITH " + MATCHES_SQL + """
, s AS (SELECT match_id, ts, a AS entity, landed, absorbed, 0 AS side FROM matches UNION ALL SELECT match_id, ts, b, opp_landed, opp_absorbed, 1 FROM matches)
SELECT x.match_id, x.entity, x.landed, y.entity AS opp_entity, y.landed AS opp_landed FROM s x JOIN s y ON x.match_id = y.match_id AND x.side = 0 AND y.side = 1""")
def side_join(t):
    m = matches(t)
    left = m.select("match_id", F.col("a").alias("entity"), "landed")
    right = m.select("match_id", F.col("b").alias("entity"), F.col("opp_landed").alias("landed"))
    return pairs.side_join(left, right, ["match_id"])


@query("left_and_right_views", """
WITH l AS (SELECT o_orderkey, 'c' || o_custkey || 'vs.' || 'k' || o_orderkey AS label, 'c' || o_custkey AS lname, 'k' || o_orderkey AS rname FROM orders)
SELECT o_orderkey, lname AS name, 'left' AS side FROM l WHERE instr(label, lname) = 1
UNION ALL SELECT o_orderkey, rname, 'right' FROM l WHERE instr(label, rname) > 1""")
def left_and_right_views(t):
    o = t.orders.select("o_orderkey", F.concat(F.lit("c"), "o_custkey", F.lit(" vs. "), F.lit("k"), "o_orderkey").alias("bout"))
    from duelframe.functions.text import join_key, left_side, right_side

    rows = o.select("o_orderkey", join_key("bout").alias("label"), F.explode(F.array(left_side("bout"), right_side("bout"))).alias("name"))
    left = pairs.left_view(rows, "label", "name").select("o_orderkey", "name", F.lit("left").alias("side"))
    return left.unionByName(pairs.right_view(rows, "label", "name").select("o_orderkey", "name", F.lit("right").alias("side")))


@query("winners_and_losers", "WITH " + MATCHES_SQL + """
SELECT match_id, CASE WHEN score = 1 THEN a ELSE b END AS winner, CASE WHEN score = 1 THEN b ELSE a END AS loser FROM matches""")
def winners_and_losers(t):
    m = matches(t).select("match_id", F.explode(F.array(
        F.struct(F.col("a").alias("entity"), F.col("score").cast("int").alias("won")), F.struct(F.col("b").alias("entity"), (1 - F.col("score")).cast("int").alias("won")),
    )).alias("_s")).select("match_id", "_s.*")
    return pairs.winners_and_losers(m, ["match_id"], "entity", "won")


@query("winner_loser_columns", "WITH " + MATCHES_SQL + """
SELECT match_id, CASE WHEN score = 1 THEN a ELSE b END AS winner, CASE WHEN score = 1 THEN b ELSE a END AS loser, CAST(score AS INT) AS result FROM matches""")
def winner_loser_columns(t):
    m = clean.result_column(matches(t).withColumn("win", F.col("score")), "win")
    return clean.winner_loser(m, "result", "a", "b").select("match_id", "winner", "loser", "result")


@query("lookup_left", """
SELECT o_orderkey, min(l_shipdate)::DATE AS first_ship, count(l_orderkey) > 0 AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey * 3 = o_orderkey GROUP BY 1""")
def lookup_left(t):
    table = t.lineitem.select((F.col("l_orderkey") * 3).alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("ship"))
    out = pairs.lookup_left(t.orders.select("o_orderkey"), table, ["o_orderkey"], {"ship": "first_ship"})
    return out.withColumn("shipped", F.col("first_ship").isNotNull())


@query("overwrite_where_exists", """
SELECT c_custkey, CASE WHEN s.s_suppkey IS NOT NULL THEN s.s_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey""")
def overwrite_where_exists(t):
    updates = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return pairs.overwrite_from(t.customer.select("c_custkey", "c_acctbal"), updates, ["c_custkey"], ["c_acctbal"])


@query("attribute_of_named", """
WITH r AS (SELECT split_part(c_name, '#', 1) || ' ' || c_custkey AS a, 'Other ' || c_custkey AS b, c_nationkey FROM customer),
n AS (SELECT name, min(c_nationkey) AS v FROM (SELECT a AS name, c_nationkey FROM r UNION ALL SELECT b, c_nationkey FROM r) GROUP BY 1)
SELECT o_orderkey, 'Customer ' || o_custkey AS name, v AS nation FROM orders LEFT JOIN n ON n.name = 'Customer ' || o_custkey""")
def attribute_of_named(t):
    results = t.customer.select(
        F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit(" "), "c_custkey", F.lit(" vs. Other "), "c_custkey").alias("bout"),
        F.col("c_nationkey").alias("nation"),
    )
    ents = t.orders.select("o_orderkey", F.concat(F.lit("Customer "), "o_custkey").alias("name"))
    return pairs.attribute_of_named(ents, "name", results, "bout", "nation").select("o_orderkey", "name", "nation")


@query("first_and_last_per_key", """
SELECT o_custkey, o_orderkey, 'first' AS kept FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1
UNION ALL
SELECT o_custkey, o_orderkey, 'last' FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""")
def first_and_last_per_key(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    first = clean.first_per_key(o, ["o_custkey"], ["o_totalprice", "o_orderkey"]).withColumn("kept", F.lit("first"))
    last = clean.last_per_key(o, ["o_custkey"], ["o_totalprice", "o_orderkey"]).withColumn("kept", F.lit("last"))
    return first.unionByName(last).select("o_custkey", "o_orderkey", "kept")


@query("semi_and_anti", """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey * 2 = c_custkey) THEN 'kept' ELSE 'removed' END AS state FROM customer""")
def semi_and_anti(t):
    big = t.orders.select((F.col("o_custkey") * 2).alias("c_custkey"))
    kept = pairs.keep_known(t.customer.select("c_custkey"), big, ["c_custkey"])
    removed = clean.rows_removed(t.customer.select("c_custkey"), kept, ["c_custkey"])
    return kept.withColumn("state", F.lit("kept")).unionByName(removed.withColumn("state", F.lit("removed")))


@query("full_name_members", """
SELECT c_custkey, 'Customer ' || c_mktsegment AS name FROM customer WHERE 'Customer ' || c_mktsegment IN (SELECT 'Customer ' || o_orderpriority FROM orders UNION ALL SELECT 'Customer ' || c_mktsegment FROM customer JOIN supplier ON s_suppkey = c_custkey)""")
def full_name_members(t):
    people = t.customer.select("c_custkey", F.lit("Customer ").alias("first"), "c_mktsegment")
    sold = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey")).select(F.concat(F.lit("Customer "), "c_mktsegment").alias("name"))
    wanted = t.orders.select(F.concat(F.lit("Customer "), "o_orderpriority").alias("name")).unionByName(sold)
    return pairs.full_name_members(people, "first", "c_mktsegment", wanted, "name").select("c_custkey", "name")


@query("tiered_names", """
WITH q AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN 'CUSTOMER#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')
            ELSE 'r#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') END AS asked FROM supplier),
m AS (SELECT asked, c_name AS name, CASE WHEN asked = c_name THEN 1 WHEN lower(asked) = lower(c_name) THEN 2 ELSE 3 END AS tier FROM q JOIN customer ON contains(lower(c_name), lower(asked)))
SELECT asked, tier, name FROM q LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY asked ORDER BY tier, name) = 1) USING (asked)""")
def tiered_names(t):
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    asked = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Customer#"), key)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("CUSTOMER#"), key)).otherwise(F.concat(F.lit("r#"), key))
    requests = t.supplier.select(asked.alias("asked")).distinct()
    return pairs.tiered_names(requests, "asked", t.customer.select(F.col("c_name").alias("name")), "name")


@query("tiered_names_of_opponents", """
WITH q AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') WHEN 1 THEN 'SUPPLIER#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'nobody' || s_suppkey END AS asked FROM supplier),
m AS (SELECT asked, c_name AS name, CASE WHEN asked = c_name THEN 1 WHEN lower(asked) = lower(c_name) THEN 2 ELSE 3 END AS tier FROM q JOIN customer ON contains(lower(c_name), lower(asked))
  UNION ALL SELECT asked, s_name, 4 FROM q JOIN supplier ON contains(lower(s_name), lower(asked)))
SELECT asked, tier, name FROM q LEFT JOIN (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY asked ORDER BY tier, name) = 1) USING (asked)""")
def tiered_names_of_opponents(t):
    """Names that only the opponents have come last."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    asked = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Customer#"), key)).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("SUPPLIER#"), key)).otherwise(F.concat(F.lit("nobody"), F.col("s_suppkey").cast("string")))
    requests = t.supplier.select(asked.alias("asked")).distinct()
    return pairs.tiered_names(requests, "asked", t.customer.select(F.col("c_name").alias("name")), "name", opponents=t.supplier.select(F.col("s_name").alias("name")))


@query("composite_key_lookup", """
WITH x AS (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS returned_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, returned_price FROM lineitem LEFT JOIN x USING (l_partkey, l_suppkey)""")
def composite_key_lookup(t):
    """A left join on two keys: the least price at which the same part of the same supplier came back."""
    returned = t.lineitem.where("l_returnflag = 'R'")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return pairs.lookup_left(rows, returned, ["l_partkey", "l_suppkey"], {"l_extendedprice": "returned_price"})


@query("similar_names", """
WITH n AS (SELECT DISTINCT p_brand, p_name FROM part)
SELECT l.p_brand, l.p_name AS name_a, r.p_name AS name_b, r4(1 - levenshtein(l.p_name, r.p_name) / greatest(length(l.p_name), length(r.p_name))::DOUBLE) AS similarity
FROM n l JOIN n r ON l.p_brand = r.p_brand WHERE 1 - levenshtein(l.p_name, r.p_name) / greatest(length(l.p_name), length(r.p_name))::DOUBLE >= 0.7 AND l.p_name < r.p_name""")
def similar_names(t):
    """Pairs of part names of one brand with edit similarity of at least 0.7."""
    n = t.part.select("p_brand", "p_name")
    out = pairs.similar_texts(n.withColumnRenamed("p_name", "name_a"), "name_a", n.withColumnRenamed("p_name", "name_b"), "name_b", ["p_brand"], 0.7)
    return rounded(out.where("name_a < name_b"), "similarity")


NAMED_SQL = """
WITH m AS (SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS day, substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12) AS fa, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12) AS fb FROM orders),
e AS (SELECT match_id AS event_id, CAST(day + CAST(match_id % 3 - 1 AS INT) AS DATE) AS eday, fb || CASE WHEN match_id % 2 = 0 THEN '' ELSE 'z' END AS home, fa AS away FROM m),
"""


def _named(t):
    """Matches with name-like texts, and market events that shift the day and misspell every other name."""
    k = F.col("o_orderkey")
    name = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 12)
    m = t.orders.select(k.alias("match_id"), F.col("o_orderdate").cast("date").alias("day"), name("o_custkey").alias("fa"), name("o_orderkey").alias("fb"))
    e = m.select(
        F.col("match_id").alias("event_id"), F.date_add("day", (F.col("match_id") % 3 - 1).cast("int")).alias("eday"),
        F.concat("fb", F.when(F.col("match_id") % 2 == 0, "").otherwise("z")).alias("home"), F.col("fa").alias("away"),
    )
    return m, e, dict(day="day", a="fa", b="fb", event_day="eday", home="home", away="away", event_id="event_id")


@query("market_event_match", NAMED_SQL + """
s AS (SELECT match_id, event_id, CASE WHEN (fa = home AND fb = away) OR (fa = away AND fb = home) THEN 1 ELSE 0 END AS same,
  greatest((1 - levenshtein(fa, home) / greatest(length(fa), length(home))::DOUBLE + 1 - levenshtein(fb, away) / greatest(length(fb), length(away))::DOUBLE) / 2,
           (1 - levenshtein(fa, away) / greatest(length(fa), length(away))::DOUBLE + 1 - levenshtein(fb, home) / greatest(length(fb), length(home))::DOUBLE) / 2) AS sim
  FROM m JOIN (SELECT *, unnest([-1, 0, 1]) AS d FROM e) e ON m.day = e.eday + e.d)
SELECT match_id, event_id, r4(CASE WHEN same = 1 THEN 1.0::DOUBLE ELSE sim END) AS similarity FROM s WHERE sim >= 0.8
QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY same DESC, r6(CASE WHEN same = 1 THEN 1.0::DOUBLE ELSE sim END) DESC, event_id DESC) = 1""")
def market_event_match(t):
    """Best market event within a day per match, exact pair first, else mean name similarity of at least 0.8."""
    m, e, names = _named(t)
    return rounded(pairs.match_market_events(m, e, match_id="match_id", **names), "similarity")


@query("exact_pair_within_a_day", NAMED_SQL + """
x AS (SELECT 1) SELECT m.match_id, e.event_id FROM m JOIN e ON ((fa = home AND fb = away) OR (fa = away AND fb = home)) AND abs(date_diff('day', day, eday)) <= 1""")
def exact_pair_within_a_day(t):
    m, e, names = _named(t)
    return pairs.market_event_candidates(m, e, **names).select("match_id", "event_id")


@query("matchup_expansion", """
WITH l AS (SELECT o_custkey, o_totalprice AS price, o_orderkey AS last_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1)
SELECT c_custkey AS a, c_custkey + 1 AS b, x.price, x.last_order, y.price AS opp_price, y.last_order AS opp_last_order
FROM customer LEFT JOIN l x ON x.o_custkey = c_custkey LEFT JOIN l y ON y.o_custkey = c_custkey + 1""")
def matchup_expansion(t):
    from duelframe.operators.sequence import latest_row

    o = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("ts"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("price"))
    latest = latest_row(o, "o_custkey", ["ts", "last_order"]).drop("ts")
    requests = t.customer.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return pairs.expand_matchups(requests, latest, "a", "b", "o_custkey")


@query("version_at_date", """
WITH req AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS ts FROM orders WHERE o_orderstatus = 'F')
SELECT o.o_custkey, CAST(o.o_orderdate AS DATE) AS ts, o.o_orderkey, o.o_totalprice AS price FROM orders o JOIN req r ON r.o_custkey = o.o_custkey AND r.ts = CAST(o.o_orderdate AS DATE)""")
def version_at_date(t):
    o = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("ts"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    req = o.where("o_orderstatus = 'F'").select("o_custkey", "ts").distinct()
    return pairs.version_at(req, o.drop("o_orderstatus"), ["o_custkey", "ts"])


@query("rating_or_default", """
WITH s AS (SELECT l_suppkey * 2 AS l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT s_suppkey, coalesce(q, 1500) AS rating FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey""")
def rating_or_default(t):
    known = t.lineitem.groupBy((F.col("l_suppkey") * 2).alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    return pairs.rating_or_default(t.supplier.select("s_suppkey"), known, "s_suppkey", "q", "rating")


@query("mirror_consistency", "WITH " + MATCHES_SQL + """
SELECT 'landed' AS "column", CAST(0 AS BIGINT) AS mismatches UNION ALL SELECT 'absorbed', CAST(sum(CASE WHEN match_id % 10 = 0 AND absorbed <> absorbed + 1 THEN 1 ELSE 0 END) AS BIGINT) FROM matches""")
def mirror_consistency(t):
    """Both views of a match agree, except where one view was altered on purpose."""
    m = matches(t).select("match_id", F.col("a").alias("entity"), F.col("b").alias("opp_entity"), "landed", "opp_landed", "absorbed", "opp_absorbed")
    rows = pairs.mirror_rows(m)
    bad = (F.col("match_id") % 10 == 0) & (F.col("entity") < F.col("opp_entity"))
    rows = rows.withColumn("opp_absorbed", F.when(bad, F.col("opp_absorbed") + 1).otherwise(F.col("opp_absorbed")))
    return quality.mirror_report(rows, ["match_id"], "entity", ["landed", "absorbed"])


@query("union_of_categories", """
SELECT DISTINCT p_brand AS label, 'brand' AS kind FROM part UNION SELECT DISTINCT p_type, 'type' FROM part""")
def union_of_categories(t):
    a = t.part.select(F.col("p_brand").alias("label"), F.lit("brand").alias("kind"))
    b = t.part.select(F.col("p_type").alias("label"), F.lit("type").alias("kind"))
    return src.concat_frames([a, b]).distinct()


@query("experience_filters", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS appearances, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS before FROM orders)
SELECT o_orderkey, appearances, CAST(before AS BIGINT) AS before FROM c WHERE appearances >= 8 AND before >= 2 AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND o_orderstatus = 'F'""")
def experience_filters(t):
    from duelframe.operators.sequence import matches_before

    o = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ts"), "o_orderstatus")
    o = clean.with_appearances(clean.appears_at_least(o, "o_custkey", 8), "o_custkey")
    o = matches_before(o, "o_custkey", ["ts", "o_orderkey"], "before").withColumn("opp_before", F.col("before"))
    return clean.since(clean.experienced(o, "before", "opp_before", 2), "ts", "1996-01-01", "o_orderstatus", "F").select("o_orderkey", "appearances", "before")


@query("sampled_entities", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('42:' || o_custkey), o_custkey LIMIT 20")
def sampled_entities(t):
    """The sample is the feature."""
    return clean.sample_entities(t.orders, "o_custkey", 20)


@query("bounds_nulling", """
SELECT o_orderkey, CASE WHEN abs(o_totalprice - 250000) <= 150000 THEN o_totalprice - 250000 END AS fanduel_odds FROM orders""")
def bounds_nulling(t):
    o = t.orders.select("o_orderkey", (F.col("o_totalprice") - 250000).alias("fanduel_odds"))
    return clean.null_out_of_bounds(o, {"fanduel_odds": 150000})


@query("bounds_report", """
SELECT 'fanduel_odds' AS "column", count(*) FILTER (WHERE abs(o_totalprice - 250000) > 150000) AS removed FROM orders
UNION ALL SELECT 'betmgm_odds', count(*) FILTER (WHERE o_totalprice > 400000) FROM orders""")
def bounds_report(t):
    o = t.orders.select((F.col("o_totalprice") - 250000).alias("fanduel_odds"), F.col("o_totalprice").alias("betmgm_odds"))
    return clean.bounds_report(o, {"fanduel_odds": 150000, "betmgm_odds": 400000})


@query("missingness", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, nullif(l_discount, 0) AS d, nullif(l_tax, 0) AS x, nullif(l_quantity, 1) AS q, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST((d IS NULL)::INT + (x IS NULL)::INT + (q IS NULL)::INT + (p IS NULL)::INT AS INT) AS missing
FROM n WHERE (d IS NULL)::INT + (x IS NULL)::INT + (q IS NULL)::INT + (p IS NULL)::INT < 2""")
def missingness(t):
    from duelframe.functions.numbers import missing_count

    cols = ["d", "x", "q", "p"]
    n = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("d"), F.nullif("l_tax", F.lit(0.0)).alias("x"),
        F.nullif("l_quantity", F.lit(1.0)).alias("q"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("p"))
    return clean.keep_complete_enough(n, cols, 0.7).withColumn("missing", missing_count(cols)).drop(*cols)


@query("coerced_numbers", """
SELECT event_id, TRY_CAST(replace(props, '{"k": ', '') AS DOUBLE) AS bad, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS good, CAST(NULL AS DOUBLE) AS absent FROM events""")
def coerced_numbers(t):
    e = t.events.select("event_id", F.replace("props", F.lit('{"k": '), F.lit("")).alias("bad"), F.regexp_extract("props", "([0-9]+)", 1).alias("good"))
    return clean.coerce_numeric(e, ["bad", "good", "absent"])
