"""Aggregations, distributions, market columns, return on investment."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import MATCHES_SQL, matches, query, r, rounded
from duelframe.functions import numbers as nf, odds as of
from duelframe.operators import clean, evaluate, market, profile, sequence
from duelframe.plans.sizing import cut
from duelframe.sources import odds_documents as od


@query("row_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(t):
    one = lambda n: getattr(t, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return one("orders").unionByName(one("lineitem")).unionByName(one("events"))


@query("career_record", """
SELECT user_id, count(*) AS matches, count(*) FILTER (WHERE event_type = 'purchase') AS wins, count(*) FILTER (WHERE event_type <> 'purchase') AS losses,
  r4(count(*) FILTER (WHERE event_type = 'purchase') / count(*)::DOUBLE) AS win_rate, max_by(event_type, ts) AS latest_event_type, max_by(value, ts) AS latest_value
FROM events GROUP BY 1""")
def career_record(t):
    out = profile.career_record(t.events, ["user_id"], F.col("event_type") == "purchase", ["event_type", "value"], ["ts", "event_id"])
    return rounded(out, "win_rate")


@query("distinct_entities", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def distinct_entities(t):
    users = profile.distinct_entities(t.events, "user_id").agg(F.count(F.lit(1)).alias("users"))
    kinds = t.events.agg(F.count_distinct("event_type").alias("kinds"))
    return users.withColumn("k", F.lit(1)).join(kinds.withColumn("k", F.lit(1)), "k").drop("k")


@query("category_counts", """
SELECT c_nationkey, count(*) AS n, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS name FROM customer LEFT JOIN nation ON n_nationkey + 5 = c_nationkey GROUP BY 1, 3""")
def category_counts(t):
    names = t.nation.select((F.col("n_nationkey") + 5).alias("c_nationkey"), F.col("n_name").alias("name"))
    return profile.category_counts(t.customer, "c_nationkey", names, "name")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("pivot_prices", "SELECT user_id, " + ", ".join(f"r4(avg(value) FILTER (WHERE event_type = '{k}')) AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def pivot_prices(t):
    return rounded(profile.pivot_mean(t.events, ["user_id"], "event_type", "value", KINDS), *KINDS)


def _describe_sql(col):
    return f"""SELECT '{col}' AS "column", count({col}) AS count, r4(avg({col})) AS mean, r4(stddev_samp({col})) AS std, min({col})::DOUBLE AS min,
  r4(quantile_cont({col}, 0.25)) AS q25, r4(quantile_cont({col}, 0.5)) AS median, r4(quantile_cont({col}, 0.75)) AS q75, max({col})::DOUBLE AS max FROM lineitem"""


@query("describe_columns", " UNION ALL ".join(_describe_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_columns(t):
    return rounded(profile.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), "mean", "std", "q25", "median", "q75")


@query("medians", "SELECT r4(quantile_cont(o_totalprice, 0.5)) AS o_totalprice FROM orders")
def medians(t):
    from duelframe.operators.learn import medians as med

    m = med(t.orders, ["o_totalprice"])
    return rounded(t.spark.createDataFrame([(m["o_totalprice"],)], "o_totalprice double"), "o_totalprice")


@query("correlations", "SELECT feature, r6(corr) AS corr FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}::DOUBLE, l_extendedprice) AS corr FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")) + ")")
def correlations(t):
    return rounded(profile.correlations(t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice"), "corr", digits=6)


@query("group_size_on_rows", "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS appearances FROM events")
def group_size_on_rows(t):
    return profile.with_group_size(t.events.select("event_id", "user_id"), "user_id", "appearances").drop("user_id")


@query("interval_stats", """
WITH g AS (SELECT o_custkey, o_orderstatus = 'F' AS flag, date_diff('day', lag(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey), CAST(o_orderdate AS DATE)) AS gap FROM orders)
SELECT o_custkey, r4(avg(gap)) AS avg_days, CAST(max(gap) AS INT) AS max_days, r4(avg(gap) FILTER (WHERE flag)) AS avg_days_flagged, r4(avg(gap) FILTER (WHERE NOT flag)) AS avg_days_other FROM g GROUP BY 1""")
def interval_stats(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("ts"))
    out = profile.interval_stats(o, "o_custkey", ["ts", "o_orderkey"], "ts", F.col("o_orderstatus") == "F")
    return rounded(out, "avg_days", "avg_days_flagged", "avg_days_other")


@query("normal_equation", """
SELECT count(*)::DOUBLE AS xx_0_0, r2(sum(l_quantity)) AS xx_0_1, r2(sum(l_tax)) AS xx_0_2, r2(sum(l_quantity * l_quantity)) AS xx_1_1, r2(sum(l_quantity * l_tax)) AS xx_1_2,
  r2(sum(l_tax * l_tax)) AS xx_2_2, r2(sum(l_extendedprice)) AS xy_0, r2(sum(l_quantity * l_extendedprice)) AS xy_1, r2(sum(l_tax * l_extendedprice)) AS xy_2 FROM lineitem""")
def normal_equation(t):
    out = profile.normal_equation_sums(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice").drop("yy")
    return rounded(out, *[c for c in out.columns if c != "xx_0_0"], digits=2)


@query("snapshot_coverage", "WITH " + MATCHES_SQL + """
, k AS (SELECT DISTINCT a AS e FROM matches WHERE ts < DATE '1995-03-01' UNION SELECT DISTINCT b FROM matches WHERE ts < DATE '1995-03-01')
SELECT count(*) AS matches, r4(avg(CASE WHEN x.e IS NOT NULL AND y.e IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)) AS "both", r4(avg(CASE WHEN x.e IS NOT NULL OR y.e IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)) AS "any"
FROM matches m LEFT JOIN k x ON x.e = m.a LEFT JOIN k y ON y.e = m.b WHERE ts >= DATE '1995-03-01'""")
def snapshot_coverage(t):
    m = cut(matches(t).select("ts", "a", "b"))
    early = m.where("ts < DATE '1995-03-01'")
    known = early.select(F.col("a").alias("e")).unionByName(early.select(F.col("b").alias("e")))
    return rounded(profile.snapshot_coverage(m.where("ts >= DATE '1995-03-01'"), known, "a", "b", "e"), "both", "any")


@query("dataset_totals", """
SELECT count(DISTINCT o_custkey) AS entities, count(DISTINCT o_orderpriority) AS categories, count(DISTINCT o_orderkey) AS matches,
  count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01') AS train_rows, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS test_rows FROM orders""")
def dataset_totals(t):
    return profile.dataset_totals(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderdate").cast("date") >= F.lit("2000-01-01").cast("date"))


# ---------------------------------------------------------------- market

P_SQL = "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (abs(l_discount) * 5 + l_quantity / 100) AS p FROM lineitem) "
AMER = "CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN {p} >= 0.5 THEN -round_even({p} / (1 - {p}) * 100, 0) ELSE round_even((1 - {p}) / {p} * 100, 0) END END"
CLAMP = "CASE WHEN {o} > 0 AND {o} < 100 THEN 100 WHEN {o} < 0 AND {o} > -100 THEN -100 ELSE {o} END"


@query("odds_columns", P_SQL + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r4(p) AS p, {AMER.format(p='p')}::DOUBLE AS odds, ({CLAMP.format(o=AMER.format(p='p'))})::DOUBLE AS clamped,
  r4(1 / (1 + exp(-(l_quantity - 25) / 170.0::DOUBLE))) AS logistic, r4(exp(p / 0.5::DOUBLE) / (exp(p / 0.5::DOUBLE) + exp((1 - p) / 0.5::DOUBLE))) AS soft,
  least(greatest(r4(p), 0.15::DOUBLE), 0.85::DOUBLE) AS clipped,
  CASE WHEN p >= 0.8 THEN 'very high' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.5 THEN 'moderate' ELSE 'low' END AS confidence,
  round_even(trunc(l_extendedprice / 7 * 10000) / 10000.0::DOUBLE, 2) AS cut FROM p""")
def odds_columns(t):
    p = F.col("p")
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.abs("l_discount") * 5 + F.col("l_quantity") / 100).alias("p"))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(p).alias("p"), of.american_from_probability(p).alias("odds"),
        of.clamp_odds(of.american_from_probability(p)).alias("clamped"), r(nf.logistic_gap(F.col("l_quantity") - 25)).alias("logistic"),
        r(nf.softmax_pair(p, 1 - p)).alias("soft"), nf.clip(r(p), 0.15, 0.85).alias("clipped"), nf.confidence_label(p).alias("confidence"),
        nf.truncate_round(F.col("l_extendedprice") / 7).alias("cut"),
    )


@query("consistent_odds", "WITH " + MATCHES_SQL + f"""
, s AS (SELECT match_id, a AS entity, landed / 60 + 0.05::DOUBLE AS p FROM matches UNION ALL SELECT match_id, b, opp_landed / 60 + 0.05::DOUBLE FROM matches),
n AS (SELECT match_id, entity, p / sum(p) OVER (PARTITION BY match_id) AS q FROM s)
SELECT match_id, entity, r6(q) AS prob_norm, ({CLAMP.format(o=AMER.format(p='r6(q)'))})::DOUBLE AS odds FROM n""")
def consistent_odds(t):
    m = matches(t)
    s = m.select("match_id", F.explode(F.array(
        F.struct(F.col("a").alias("entity"), (F.col("landed") / 60 + 0.05).alias("p")), F.struct(F.col("b").alias("entity"), (F.col("opp_landed") / 60 + 0.05).alias("p")),
    )).alias("_s")).select("match_id", "_s.*")
    out = rounded(market.consistent_odds(s, ["match_id"], "p").drop("p", "odds"), "prob_norm", digits=6)
    return out.withColumn("odds", of.clamp_odds(of.american_from_probability("prob_norm")))


OUT_SQL = """WITH b AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) """


@query("outlier_iqr", OUT_SQL + "SELECT o_orderkey FROM orders, b WHERE o_totalprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)")
def outlier_iqr(t):
    return market.filter_outliers(t.orders, "o_totalprice", "iqr", 0.4).select("o_orderkey")


@query("outlier_zscore", OUT_SQL + "SELECT o_orderkey FROM orders, b WHERE abs((o_totalprice - m) / s) < 1.5")
def outlier_zscore(t):
    return market.filter_outliers(t.orders, "o_totalprice", "zscore", 1.5).select("o_orderkey")


@query("row_mean_of_books", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, r4(list_avg(list_filter([nullif(l_discount, 0) * 100, nullif(l_tax, 0) * 100, CASE WHEN l_returnflag = 'A' THEN l_quantity END], lambda v: v IS NOT NULL))) AS avg_odds FROM lineitem""")
def row_mean_of_books(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.nullif("l_discount", F.lit(0.0)) * 100).alias("x"),
                           (F.nullif("l_tax", F.lit(0.0)) * 100).alias("y"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("z"))
    return rounded(df.withColumn("avg_odds", nf.row_mean(["x", "y", "z"])).drop("x", "y", "z"), "avg_odds")


def _roi_frames(t):
    """Model odds and four books per side of every match, all derived from the two lines."""
    m = matches(t)
    side = lambda e, won, own, other: F.struct(
        F.col(e).alias("FIGHTER"), won.cast("int").alias("win"),
        F.round(F.col(f"{own}absorbed") - F.col(f"{other}absorbed")).alias("_edge"), F.col(f"{own}landed").alias("_l"), F.col(f"{other}landed").alias("_o"))
    s = m.select(F.col("ts").alias("DATE"), F.col("league").alias("EVENT"), F.col("match_id").alias("BOUT"), F.explode(F.array(
        side("a", F.col("score"), "", "opp_"), side("b", 1 - F.col("score"), "opp_", ""))).alias("_s")).select("DATE", "EVENT", "BOUT", "_s.*")
    model = s.select("DATE", "EVENT", "BOUT", "FIGHTER", (F.col("_edge") * 10 - F.col("_l")).alias("odds"))
    base = (F.col("_o") - F.col("_l")) * 30
    vegas = s.select("DATE", "EVENT", "BOUT", "FIGHTER", "win", (base + 110).alias("draftkings_odds"), (base - 120).alias("fanduel_odds"),
                     F.when(F.col("_l") > 5, base + 40).otherwise(F.lit(0.0)).alias("betmgm_odds"), base.alias("bovada_odds"))
    return model, vegas


ROI_SQL = "WITH " + MATCHES_SQL + f""",
s AS (SELECT ts AS "DATE", match_id AS "BOUT", a AS "FIGHTER", CAST(score AS INT) AS win, round(absorbed - opp_absorbed) AS edge, landed AS l, opp_landed AS o FROM matches
      UNION ALL SELECT ts, match_id, b, CAST(1 - score AS INT), round(opp_absorbed - absorbed), opp_landed, landed FROM matches),
v AS (SELECT *, edge * 10 - l AS odds, (o - l) * 30 + 110 AS dk, (o - l) * 30 - 120 AS fd, CASE WHEN l > 5 THEN (o - l) * 30 + 40 ELSE 0 END AS bm, (o - l) * 30 AS bv FROM s),
h AS (SELECT *, (dk + fd + bm + bv) / 4 AS av FROM v WHERE greatest(dk, fd, bm, bv) <= 1300 AND least(dk, fd, bm, bv) >= -1650),
b AS (SELECT quantile_cont(av, 0.25) AS q1, quantile_cont(av, 0.75) AS q3 FROM h),
f AS (SELECT h.* FROM h, b WHERE av BETWEEN q1 - 2 * (q3 - q1) AND q3 + 2 * (q3 - q1)),
picks0 AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY "DATE", "BOUT" ORDER BY odds, "FIGHTER") = 1),
picks AS (SELECT *, ({CLAMP.format(o='av')})::DOUBLE AS ml FROM picks0),
priced AS (SELECT *, CASE WHEN win = 1 THEN CASE WHEN ml > 0 THEN ml ELSE 100 * 100 / abs(ml) END ELSE -100 END AS profit FROM picks WHERE ml <> 0 OR win = 0),
cum AS (SELECT *, sum(profit) OVER (ORDER BY "DATE", "BOUT" ROWS UNBOUNDED PRECEDING) AS cp, 100 * row_number() OVER (ORDER BY "DATE", "BOUT") AS cs FROM priced)
"""


def _picks(t):
    model, vegas = _roi_frames(t)
    return market.roi_picks(model, vegas).where("profit IS NOT NULL")


@query("roi_running", ROI_SQL + """SELECT "DATE", "BOUT", "FIGHTER", r2(profit) AS profit, r2(cp) AS cum_profit, r6(cp / cs) AS cum_roi FROM cum""")
def roi_running(t):
    out = market.cumulative_roi(_picks(t), ["DATE", "BOUT"]).select("DATE", "BOUT", "FIGHTER", "profit", "cum_profit", "cum_roi")
    return rounded(rounded(out, "cum_roi", digits=6), "profit", "cum_profit", digits=2)


@query("roi_volatility", ROI_SQL + """, d AS (SELECT *, cp / cs AS roi, abs(cp / cs - lag(cp / cs) OVER (ORDER BY "DATE", "BOUT")) AS step FROM cum)
SELECT r6(max_by(roi, cs)) AS final_roi, r6(avg(step)) AS volatility FROM d""")
def roi_volatility(t):
    cum = market.cumulative_roi(_picks(t), ["DATE", "BOUT"])
    return rounded(market.roi_volatility(cum, ["DATE", "BOUT"]), "final_roi", "volatility", digits=6)


@query("best_night_and_month", ROI_SQL + """, n AS (SELECT "DATE" AS period, sum(profit) AS profit, count(*) AS bets FROM priced GROUP BY 1), m AS (SELECT CAST(date_trunc('month', "DATE") AS DATE) AS period, sum(profit) AS profit, count(*) AS bets FROM priced GROUP BY 1)
(SELECT 'night' AS kind, period, r2(profit) AS profit, bets FROM n ORDER BY n.profit DESC, period DESC LIMIT 1) UNION ALL (SELECT 'month', period, r2(profit), bets FROM m ORDER BY m.profit DESC, period DESC LIMIT 1)""")
def best_night_and_month(t):
    picks = _picks(t)
    night = market.best_period(picks, F.col("DATE"), "period").withColumn("kind", F.lit("night"))
    month = market.best_period(picks, F.date_trunc("month", "DATE").cast("date"), "period").withColumn("kind", F.lit("month"))
    return rounded(night.unionByName(month), "profit", digits=2)


@query("profit_by_month", ROI_SQL + """SELECT CAST(date_trunc('month', "DATE") AS DATE) AS month, r2(sum(profit)) AS profit, count(*) AS bets FROM priced GROUP BY 1""")
def profit_by_month(t):
    return rounded(market.profit_by(_picks(t), F.date_trunc("month", "DATE").cast("date"), "month"), "profit", digits=2)


# ---------------------------------------------------------------- nested documents

@query("json_unnest", "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS DOUBLE) AS k FROM events")
def json_unnest(t):
    return t.events.select("event_id", od.json_number("props", "$.k").alias("k"))


@query("odds_document_long_and_wide", """
WITH x AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS book, avg(value) AS price FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY ALL)
SELECT d AS date, user_id, r4(max(price) FILTER (WHERE book = 'click')) AS click, r4(max(price) FILTER (WHERE book = 'purchase')) AS purchase, r4(max(price) FILTER (WHERE book = 'view')) AS view FROM x GROUP BY ALL""")
def odds_document_long_and_wide(t):
    """Events folded into nested odds documents (an outcome list per book and day), then unnested and pivoted again."""
    day = F.col("ts").cast("date")
    outcomes = t.events.groupBy("user_id", day.alias("d"), "event_type").agg(F.avg("value").alias("price"))
    docs = outcomes.groupBy("user_id", "d").agg(F.collect_list(F.struct(
        F.col("event_type").alias("key"),
        F.array(
            F.struct(F.lit("h2h").alias("key"), F.array(F.struct(F.col("user_id").cast("string").alias("name"), F.col("price"))).alias("outcomes")),
            F.struct(F.lit("spreads").alias("key"), F.array(F.struct(F.lit("x").alias("name"), F.lit(0.0).alias("price"))).alias("outcomes")),
        ).alias("markets"),
    )).alias("bookmakers")).select(
        F.concat_ws("-", "user_id", "d").alias("id"), F.concat(F.col("d").cast("string"), F.lit("T12:00:00Z")).alias("commence_time"),
        F.col("user_id").cast("string").alias("home_team"), F.lit("field").alias("away_team"), "bookmakers",
    )
    wide = od.wide_odds(od.long_odds(docs), ["click", "purchase", "view"])
    wide = wide.where(F.coalesce("click", "purchase", "view").isNotNull())
    return rounded(wide.select("date", F.col("home_team").cast("bigint").alias("user_id"), "click", "purchase", "view"), "click", "purchase", "view")


@query("edge_document", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'A ' || o_custkey AS a, 'B ' || o_orderkey AS b, CAST(CAST(round(o_totalprice) AS INT) % 400 AS INT) AS odds_a FROM orders""")
def edge_document(t):
    text = F.format_string(
        '{"edges": [{"node": {"id": "%s", "fighter1": {"firstName": "A", "lastName": "%s"}, "fighter2": {"firstName": "B", "lastName": "%s"}, "odds": [{"book": "x", "odds1": %s, "odds2": 0}]}}]}',
        F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), (F.round("o_totalprice").cast("int") % 400).cast("string"))
    docs = od.parsed_json(t.orders.select(text.alias("json")), "json", od.EDGE_SCHEMA)
    return od.edge_rows(docs).select("id", "a", "b", "odds_a")


@query("latest_snapshot_per_event", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(t):
    return clean.last_per_key(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("running_value_total", "SELECT event_id, r2(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS cum_value FROM events")
def running_value_total(t):
    return rounded(sequence.running_totals(t.events, ["ts", "event_id"], ["value"]).select("event_id", "cum_value"), "cum_value", digits=2)


# ---------------------------------------------------------------- scores

SCORED = "WITH s AS (SELECT l.doc_id, quality, toxic, n_chars, 1 / (1 + exp(-(ln(n_chars + 1) - 6))) AS p, lang FROM labels l JOIN documents d USING (doc_id)) "


def _scored(t):
    d = t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id")
    return d.withColumn("p", 1 / (1 + F.exp(-(F.ln(F.col("n_chars") + 1) - 6))))


AUC_SQL = """(SELECT (sum(rk) FILTER (WHERE quality = 1) - {pos} * ({pos} + 1) / 2.0::DOUBLE) / ({pos} * {neg}) FROM (SELECT quality, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE) AS rk FROM s))"""


@query("probability_scores", SCORED + "SELECT count(*) AS n, r4(avg(CASE WHEN (p > 0.5) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy, "
       "r4(avg(-(quality * ln(p) + (1 - quality) * ln(1 - p)))) AS log_loss, r4(avg(greatest(p, 1 - p))) AS avg_confidence, r4("
       + AUC_SQL.format(pos="(SELECT count(*) FROM s WHERE quality = 1)", neg="(SELECT count(*) FROM s WHERE quality = 0)") + ") AS auc FROM s")
def probability_scores(t):
    return rounded(evaluate.probability_scores(_scored(t), "quality", "p"), "accuracy", "log_loss", "avg_confidence", "auc")


@query("class_scores", SCORED + """, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND p > 0.5) AS tp, count(*) FILTER (WHERE quality = 0 AND p > 0.5) AS fp, count(*) FILTER (WHERE quality = 0 AND p <= 0.5) AS tn, count(*) FILTER (WHERE quality = 1 AND p <= 0.5) AS fn, count(*)::DOUBLE AS n FROM s)
SELECT tp, fp, tn, fn, r4((tp + tn) / n) AS accuracy, r4(tp / (tp + fp)::DOUBLE) AS "precision", r4(tp / (tp + fn)::DOUBLE) AS recall, r4(2 * tp / (2 * tp + fp + fn)::DOUBLE) AS f1, r4(tn / (tn + fn)::DOUBLE) AS npv,
  r4(tp / (tp + fp)::DOUBLE) AS ppv,
  r4(((tp + tn) / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((tp + tn) / n * (1 - (tp + tn) / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)) AS wilson_low,
  r4(((tp + tn) / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt((tp + tn) / n * (1 - (tp + tn) / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n)) AS wilson_high FROM c""")
def class_scores(t):
    out = evaluate.class_scores(_scored(t), "quality", F.col("p") > 0.5)
    return rounded(out, "accuracy", "precision", "recall", "f1", "npv", "ppv", "wilson_low", "wilson_high")


@query("roc_points", SCORED + """, g AS (SELECT p, sum(quality) AS pos, sum(1 - quality) AS neg FROM s GROUP BY 1), tot AS (SELECT sum(pos) AS tp, sum(neg) AS tn FROM g)
SELECT r6(p) AS threshold, r4(sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / tp::DOUBLE) AS tpr, r4(sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) / tn::DOUBLE) AS fpr FROM g, tot""")
def roc_points(t):
    return rounded(rounded(evaluate.roc_points(_scored(t), "quality", "p"), "tpr", "fpr"), "threshold", digits=6)


@query("monthly_scores", """
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, (o_orderkey % 101) / 101.0::DOUBLE AS p FROM orders),
k AS (SELECT *, rank() OVER (PARTITION BY month ORDER BY p) + (count(*) OVER (PARTITION BY month, p) - 1) / 2.0::DOUBLE AS rk FROM s),
c AS (SELECT month, count(*) FILTER (WHERE y = 1 AND p > 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p > 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p <= 0.5) AS fn,
  sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg, sum(rk) FILTER (WHERE y = 1) AS rs FROM k GROUP BY 1)
SELECT month, tp, fp, fn, r4(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)) AS "precision", r4(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)) AS recall, r4(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)) AS f1,
  r4((rs - pos * (pos + 1) / 2) / nullif(pos * neg, 0)) AS auc FROM c""")
def monthly_scores(t):
    s = t.orders.select("o_orderdate", (F.col("o_orderstatus") == "F").cast("int").alias("y"), ((F.col("o_orderkey") % 101) / 101).alias("p"))
    out = evaluate.monthly_scores(s, "o_orderdate", "y", "p")
    return rounded(out.select("month", "tp", "fp", "fn", "precision", "recall", "f1", "auc"), "precision", "recall", "f1", "auc")


@query("feature_parity", SCORED + """, m AS (SELECT avg(CASE WHEN (p > 0.5) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc, avg(-(quality * ln(p) + (1 - quality) * ln(1 - p))) AS ll,
  avg(CASE WHEN (p * 0.9 > 0.5) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END) AS acc2, avg(-(quality * ln(p * 0.9) + (1 - quality) * ln(1 - p * 0.9))) AS ll2 FROM s)
SELECT 'accuracy' AS metric, r4(acc) AS actual, r4(acc2) AS inferred, abs(acc - acc2) <= 0.000001 AS agree FROM m UNION ALL SELECT 'log_loss', r4(ll), r4(ll2), abs(ll - ll2) <= 0.000001 FROM m""")
def feature_parity(t):
    s = _scored(t)
    return rounded(evaluate.parity(s, s.withColumn("p", F.col("p") * 0.9), "quality", "p"), "actual", "inferred")


@query("confident_slice", SCORED + "SELECT doc_id, r4(p) AS p FROM s WHERE greatest(p, 1 - p) >= 0.7")
def confident_slice(t):
    return rounded(evaluate.confident_slice(_scored(t), "p").select("doc_id", "p"), "p")


@query("best_group", "SELECT o_orderpriority, o_totalprice, n FROM (SELECT o_orderpriority, sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS o_totalprice, count(*) AS n FROM orders GROUP BY 1) ORDER BY o_totalprice DESC, o_orderpriority DESC LIMIT 1")
def best_group(t):
    """The group with the largest sum; the one later in the alphabet among equals."""
    return profile.best_group(t.orders.select("o_orderpriority", F.round("o_totalprice").cast("bigint").alias("o_totalprice")), "o_orderpriority", "o_totalprice")
