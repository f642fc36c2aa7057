"""Roll-ups, opponents, history features and per-entity sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import MATCHES_SQL, SIDES_SQL, matches, query, r, rounded, written_sides
from duelframe.operators import clean, pairs, profile, sequence
from duelframe.plans.sizing import oversized_groups
from duelframe.operators.history import FRAMES, MATCH_METRICS, Metric, feature_names, history_features


@query("match_rollup", """
SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(count(*) AS BIGINT) AS rounds,
       r2(sum(l_extendedprice)) AS price, r4(sum(l_quantity * l_discount)) AS discounted
FROM lineitem GROUP BY 1, 2
""")
def match_rollup(t):
    return profile.roll_up(
        t.lineitem, ["l_orderkey", "l_suppkey"],
        {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discounted": F.col("l_quantity") * F.col("l_discount")},
        count="rounds",
    ).select("l_orderkey", "l_suppkey", F.col("quantity").cast("bigint").alias("quantity"), "rounds",
             r("price", 2).alias("price"), r("discounted", 4).alias("discounted"))


@query("round_cells_rollup", """
WITH cells AS (
  SELECT l_orderkey, l_suppkey, CAST(l_quantity AS INT) AS acc, CAST(l_quantity AS INT) + l_linenumber AS att,
         CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber * 60 + CAST(l_quantity AS INT) END AS ctrl
  FROM lineitem)
SELECT l_orderkey, l_suppkey, CAST(sum(acc) AS BIGINT) AS sigstracc, CAST(sum(att) AS BIGINT) AS sigstratt, CAST(sum(ctrl) AS BIGINT) AS ctrl
FROM cells GROUP BY 1, 2
""")
def round_cells_rollup(t):
    """Per-round text cells ("17 of 37", "1:05", "--") parsed and summed per match and entity."""
    cells = t.lineitem.select(
        "l_orderkey", "l_suppkey",
        F.concat(F.col("l_quantity").cast("int"), F.lit(" of "), F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("SIG.STR."),
        F.when(F.col("l_returnflag") == "A", "--").otherwise(F.concat("l_linenumber", F.lit(":"), F.col("l_quantity").cast("int"))).alias("CTRL"),
    )
    return profile.roll_up_cells(cells, ["l_orderkey", "l_suppkey"], pairs={"sigstr": "SIG.STR."}, clocks={"ctrl": "CTRL"})


@query("opponent_stats", """
WITH r AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT f.l_orderkey, f.l_suppkey, CAST(f.quantity AS BIGINT) AS quantity,
       CAST(coalesce((SELECT sum(o.quantity) FROM r o WHERE o.l_orderkey = f.l_orderkey AND o.l_suppkey <> f.l_suppkey), 0) AS BIGINT) AS opp_quantity
FROM r f
""")
def opponent_stats(t):
    mine = profile.roll_up(t.lineitem, ["l_orderkey", "l_suppkey"], {"quantity": F.col("l_quantity").cast("bigint")})
    return pairs.others_total(mine, ["l_orderkey"], {"quantity": "opp_quantity"})


@query("two_sided_opponent", """
WITH r AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
     n AS (SELECT l_orderkey, count(*) AS n FROM r GROUP BY 1)
SELECT f.l_orderkey, f.l_suppkey, CAST(f.quantity AS BIGINT) AS quantity, CAST(n.n AS BIGINT) AS n_sides,
       o.l_suppkey AS opp_suppkey, CAST(o.quantity AS BIGINT) AS opp_quantity
FROM r f JOIN n ON n.l_orderkey = f.l_orderkey
LEFT JOIN r o ON n.n = 2 AND o.l_orderkey = f.l_orderkey AND o.l_suppkey <> f.l_suppkey
""")
def two_sided_opponent(t):
    mine = profile.roll_up(t.lineitem, ["l_orderkey", "l_suppkey"], {"quantity": F.col("l_quantity").cast("bigint")})
    return pairs.opponent_rows(
        mine.withColumn("_name", F.col("l_suppkey").cast("string")), ["l_orderkey"], "_name",
        {"l_suppkey": "opp_suppkey", "quantity": "opp_quantity"},
    ).drop("_name")


ORDER_METRICS = (
    Metric("price", "sum", "price"), Metric("priceavg", "avg", "price"), Metric("perday", "rate", "price", "days", scale=15),
    Metric("share", "rate", "urgent", "one"), Metric("calm", "one_minus_ratio", "urgent", "days"), Metric("matches", "count"),
    Metric("weight_avg", "avg", "urgent", frames=("3",), post_default=1.0),
)


def _frame_sql(i):
    f = FRAMES[i]
    start = "UNBOUNDED PRECEDING" if f.start is None else f"{-f.start} PRECEDING"
    end = "CURRENT ROW" if f.end == 0 else "1 PRECEDING"
    return f"f{i} AS (PARTITION BY @k ORDER BY @o ROWS BETWEEN {start} AND {end})"


def _features_sql(metrics, source, keep, keys, order) -> str:
    """Named-window SQL for a metric list, one window per frame."""
    cols = []
    for m in metrics:
        for i, f in enumerate(FRAMES):
            if not m.wanted(f):
                continue
            num, den = f"coalesce(sum({m.num}) OVER f{i}, 0)", f"coalesce(sum({m.den}) OVER f{i}, 0)"
            if m.kind == "sum":
                e = f"CAST({num} AS BIGINT)"
            elif m.kind == "count":
                e = f"count(*) OVER f{i}"
            elif m.kind == "avg":
                d = m.post_default if f.prefix == "postcomp_" else 0
                e = f"r4(coalesce(avg({m.num}) OVER f{i}, {d}))"
            elif m.kind == "rate":
                e = f"r4(CASE WHEN {den} = 0 THEN 0 ELSE CAST({num} AS DOUBLE) * {m.scale} / {den} END)"
            else:
                e = f"r4(CASE WHEN {den} = 0 THEN 0 ELSE 1 - CAST({num} AS DOUBLE) / {den} END)"
            cols.append(f"{e} AS {m.column(f)}")
    windows = ", ".join(_frame_sql(i) for i in range(len(FRAMES))).replace("@k", keys).replace("@o", order)
    return f"SELECT {keep}, {', '.join(cols)} FROM {source} WINDOW {windows}"


def _rounded_features(df, metrics, keep):
    doubles = [m.column(f) for m in metrics for f in FRAMES if m.wanted(f) and m.kind in ("avg", "rate", "one_minus_ratio")]
    return rounded(df.select(*keep, *feature_names(metrics)), *doubles)


@query("history_features", "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS ts, CAST(round(o_totalprice) AS BIGINT) AS price, "
       "o_orderkey % 4 AS days, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent, 1 AS one FROM orders) "
       + _features_sql(ORDER_METRICS, "o", "o_custkey, o_orderkey, ts", "o_custkey", "ts, o_orderkey"))
def history_over_orders(t):
    o = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ts"),
        F.round("o_totalprice").cast("bigint").alias("price"), (F.col("o_orderkey") % 4).alias("days"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("urgent"), F.lit(1).alias("one"),
    )
    feats = history_features(o, "o_custkey", ["ts", "o_orderkey"], ORDER_METRICS)
    return _rounded_features(feats, ORDER_METRICS, ["o_custkey", "o_orderkey", "ts"])


SIDE_COLUMNS = {"sigstracc", "sigstrabs", "sigstratt", "sigstrattfromopp", "tdacc", "tdatt", "tdabs", "tdattfromopp", "subatt",
                "fight_time_minutes", "weight_of_fight", "win", "loss", "kd", "kdd", "ko", "kod", "subw", "subwd",
                "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd", ""}
SIDE_METRICS = tuple(m for m in MATCH_METRICS if {m.num, m.den} <= SIDE_COLUMNS)


@query("match_history_features", "WITH " + SIDES_SQL + _features_sql(SIDE_METRICS, "sides", "entity, match_id, ts", "entity", "ts, match_id"))
def match_history_features(t):
    """The full feature families over both sides of every match."""
    feats = history_features(written_sides(t), "entity", ["ts", "match_id"], SIDE_METRICS)
    return _rounded_features(feats, SIDE_METRICS, ["entity", "match_id", "ts"])


@query("outcome_flags", """
WITH r AS (
  SELECT o_orderkey AS match_id, CASE WHEN o_totalprice > 200000 THEN 'W/L' WHEN o_orderkey % 97 = 0 THEN 'NC/NC' ELSE 'L/W' END AS outcome,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'KO/TKO ' WHEN '2-HIGH' THEN 'Submission ' WHEN '3-MEDIUM' THEN 'Decision - Unanimous '
              WHEN '4-NOT SPECIFIED' THEN 'Decision - Split ' ELSE 'Decision - Majority ' END AS method,
         1 + o_orderkey % 3 AS rnd, o_orderkey % 5 AS mm, 10 + o_orderkey % 50 AS ss
  FROM orders),
v AS (SELECT * FROM r WHERE NOT (outcome = 'NC/NC' OR method = 'Overturned'))
SELECT DISTINCT match_id, 'A ' || match_id AS fighter, CASE WHEN outcome = 'W/L' THEN 1 ELSE 0 END AS win, CASE WHEN outcome = 'L/W' THEN 1 ELSE 0 END AS loss,
  CASE WHEN method = 'KO/TKO ' AND outcome = 'W/L' THEN 1 ELSE 0 END AS ko, CASE WHEN method = 'KO/TKO ' AND outcome = 'L/W' THEN 1 ELSE 0 END AS kod,
  CASE WHEN method = 'Submission ' AND outcome = 'W/L' THEN 1 ELSE 0 END AS subw, CASE WHEN method = 'Submission ' AND outcome = 'L/W' THEN 1 ELSE 0 END AS subwd,
  CASE WHEN method = 'Decision - Unanimous ' AND outcome = 'W/L' THEN 1 ELSE 0 END AS udec, CASE WHEN method = 'Decision - Split ' AND outcome = 'L/W' THEN 1 ELSE 0 END AS sdecd,
  CAST(((rnd - 1) * 300 + mm * 60 + ss) // 60 AS INT) AS fight_time_minutes FROM v
UNION
SELECT DISTINCT match_id, 'B ' || match_id AS fighter, CASE WHEN outcome = 'L/W' THEN 1 ELSE 0 END, CASE WHEN outcome = 'W/L' THEN 1 ELSE 0 END,
  CASE WHEN method = 'KO/TKO ' AND outcome = 'L/W' THEN 1 ELSE 0 END, CASE WHEN method = 'KO/TKO ' AND outcome = 'W/L' THEN 1 ELSE 0 END,
  CASE WHEN method = 'Submission ' AND outcome = 'L/W' THEN 1 ELSE 0 END, CASE WHEN method = 'Submission ' AND outcome = 'W/L' THEN 1 ELSE 0 END,
  CASE WHEN method = 'Decision - Unanimous ' AND outcome = 'L/W' THEN 1 ELSE 0 END, CASE WHEN method = 'Decision - Split ' AND outcome = 'W/L' THEN 1 ELSE 0 END,
  CAST(((rnd - 1) * 300 + mm * 60 + ss) // 60 AS INT) FROM v
""")
def outcome_flags(t):
    k = F.col("o_orderkey")
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "KO/TKO ").when(F.col("o_orderpriority") == "2-HIGH", "Submission ")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Decision - Unanimous ").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Decision - Split ")
        .otherwise("Decision - Majority ")
    )
    results = t.orders.select(
        k.alias("match_id"), F.concat(F.lit("A "), k, F.lit(" vs. B "), k).alias("BOUT"),
        F.when(F.col("o_totalprice") > 200000, "W/L").when(k % 97 == 0, "NC/NC").otherwise("L/W").alias("OUTCOME"),
        method.alias("METHOD"), (1 + k % 3).cast("string").alias("ROUND"), F.concat(k % 5, F.lit(":"), 10 + k % 50).alias("TIME"),
    )
    return clean.match_sides(results, keep=["match_id"]).select(
        F.col("match_id").cast("bigint").alias("match_id"), "fighter", "win", "loss", "ko", "kod", "subw", "subwd", "udec", "sdecd", "fight_time_minutes"
    )


SEQ_SQL = """
WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price FROM orders),
d AS (SELECT *, lag(price) OVER w AS prev, lag(ts) OVER w AS prev_ts, row_number() OVER w - 1 AS before,
             coalesce(price - lag(price) OVER w, 0) AS diff, coalesce(price > lag(price) OVER w, false) AS up FROM o
      WINDOW w AS (PARTITION BY o_custkey ORDER BY ts, o_orderkey)),
i AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM d),
s AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, island ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM i)
"""


def _orders_seq(t):
    return t.orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ts"), F.col("o_totalprice").alias("price"))


@query("deltas_and_rolling", SEQ_SQL + """
SELECT o_custkey, o_orderkey, r2(diff) AS diff,
  r2(sum(diff) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS diff_change_3,
  r2(sum(diff) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS diff_change_5
FROM s""")
def deltas_and_rolling(t):
    keys, order = "o_custkey", ["ts", "o_orderkey"]
    rows = _orders_seq(t)
    hot = oversized_groups(rows, [keys])
    d = sequence.first_difference(rows, keys, order, "price", "diff", hot=hot)
    d = sequence.rolling_sums(d, keys, order, "diff", hot=hot)
    return rounded(d, "diff", "diff_change_3", "diff_change_5", digits=2).select("o_custkey", "o_orderkey", "diff", "diff_change_3", "diff_change_5")


@query("streak_and_count", SEQ_SQL + """
SELECT o_custkey, o_orderkey, CAST(before AS BIGINT) AS matches_before,
  CAST(coalesce(lag(run) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey), 0) AS BIGINT) AS streak_before
FROM s""")
def streak_and_count(t):
    """Orders before, and consecutive price rises immediately before, each order."""
    keys, order = "o_custkey", ["ts", "o_orderkey"]
    rows = _orders_seq(t)
    hot = oversized_groups(rows, [keys])  # counted once for the three scans
    d = sequence.previous_row(rows, keys, order, ["price"], hot=hot)
    d = d.withColumn("up", F.coalesce(F.col("price") > F.col("prev.price"), F.lit(False)))
    d = sequence.matches_before(d, keys, order, hot=hot)
    d = sequence.win_streak_before(d, keys, order, F.col("up"), hot=hot)
    return d.select("o_custkey", "o_orderkey", "matches_before", "streak_before")


@query("gap_and_decay", SEQ_SQL + """
SELECT o_custkey, o_orderkey, CAST(date_diff('day', prev_ts, ts) AS INT) AS gap_days,
  r4(CASE WHEN date_diff('day', prev_ts, ts) > 365 THEN 1500 * 0.978::DOUBLE ELSE 1500 END) AS flat,
  r4(CASE WHEN date_diff('day', prev_ts, ts) > 365 THEN 1500 * pow(0.978::DOUBLE, date_diff('day', prev_ts, ts) / 365.0::DOUBLE) ELSE 1500 END) AS power_decay,
  r2(CASE WHEN date_diff('day', prev_ts, ts) >= 365 THEN 1500 * 0.978::DOUBLE ELSE 1500 END) AS inclusive
FROM s""")
def gap_and_decay(t):
    from duelframe.functions.numbers import truncate_round
    from duelframe.functions.ratings import layoff_decay

    d = sequence.days_since_previous(_orders_seq(t), "o_custkey", ["ts", "o_orderkey"], "ts")
    base = F.lit(1500.0)
    return d.select(
        "o_custkey", "o_orderkey", "gap_days",
        r(layoff_decay(base, "gap_days")).alias("flat"),
        r(layoff_decay(base, "gap_days", mode="power")).alias("power_decay"),
        truncate_round(layoff_decay(base, "gap_days", inclusive=True)).alias("inclusive"),
    )


@query("carry_forward", SEQ_SQL + """
, p AS (SELECT o_custkey, o_orderkey, ts, round(price * 2, 2) AS post, lag(round(price * 2, 2)) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS prev_post FROM o)
SELECT o_custkey, o_orderkey, CASE WHEN ts >= DATE '1999-01-01' AND prev_post IS NOT NULL THEN prev_post ELSE 0 END AS pre, post FROM p""")
def carry_forward(t):
    d = _orders_seq(t).withColumns({"pre": F.lit(0.0), "post": F.round(F.col("price") * 2, 2)})
    out = sequence.carry_forward(d, "o_custkey", ["ts", "o_orderkey"], {"pre": "post"}, F.col("ts") >= F.lit("1999-01-01").cast("date"))
    return out.select("o_custkey", "o_orderkey", "pre", "post")


@query("last_five_per_customer", """
SELECT o_custkey, o_orderkey, CAST(n AS INT) AS recency FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 5
""")
def last_five(t):
    return sequence.last_n(_orders_seq(t), "o_custkey", ["ts", "o_orderkey"], 5).select("o_custkey", "o_orderkey", "recency")


@query("latest_per_customer", """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS ts, o_totalprice AS price FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1
""")
def latest_per_customer(t):
    return sequence.latest_row(_orders_seq(t), "o_custkey", ["ts", "o_orderkey"])


@query("previous_order_link", """
SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS prev_orderkey, lag(o_totalprice) OVER w AS prev_price
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
""")
def previous_order_link(t):
    d = sequence.previous_row(_orders_seq(t), "o_custkey", ["ts", "o_orderkey"], ["o_orderkey", "price"])
    return d.select("o_custkey", "o_orderkey", F.col("prev.o_orderkey").alias("prev_orderkey"), F.col("prev.price").alias("prev_price"))


@query("history_pages", """
WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) - 1 AS i FROM orders)
SELECT o_custkey, CAST(i // 4 AS INT) AS page, CAST(count(*) AS INT) AS n_versions, min_by(o_orderkey, i) AS first_order, max_by(o_orderkey, i) AS last_order
FROM n GROUP BY 1, 2
""")
def history_pages(t):
    """Version arrays of four rows, so an entity of any size fits; every page is summarised."""
    p = sequence.history_pages(_orders_seq(t), "o_custkey", ["ts", "o_orderkey"], ["price"], page_rows=4)
    return p.select(
        "o_custkey", "page", F.size("versions").alias("n_versions"),
        F.element_at("versions", 1)["o_orderkey"].alias("first_order"), F.element_at("versions", -1)["o_orderkey"].alias("last_order"),
    )


@query("mirror_rows", "WITH " + MATCHES_SQL + """
SELECT match_id, a AS entity, b AS opp_entity, CAST(score AS INT) AS win, CAST(1 - score AS INT) AS opp_win, landed, opp_landed, CAST(score AS INT) AS result FROM matches
UNION ALL
SELECT match_id, b, a, CAST(1 - score AS INT), CAST(score AS INT), opp_landed, landed, CAST(1 - score AS INT) FROM matches
""")
def mirror_rows(t):
    m = matches(t).select("match_id", F.col("a").alias("entity"), F.col("b").alias("opp_entity"), F.col("score").cast("int").alias("win"),
                          (1 - F.col("score")).cast("int").alias("opp_win"), "landed", "opp_landed")
    return pairs.mirror_rows(m.withColumn("result", F.col("win")), recompute="result")


@query("either_role_history", "WITH " + MATCHES_SQL + """
, r AS (SELECT match_id, a AS entity, b AS opp_entity, landed, opp_landed FROM matches)
SELECT match_id, entity, opp_entity, landed, opp_landed FROM r WHERE entity = 7
UNION ALL SELECT match_id, opp_entity, entity, opp_landed, landed FROM r WHERE opp_entity = 7
""")
def either_role_history(t):
    m = matches(t).select("match_id", F.col("a").alias("entity"), F.col("b").alias("opp_entity"), "landed", "opp_landed")
    return sequence.either_role(m, "entity", "opp_entity", F.lit(7))
