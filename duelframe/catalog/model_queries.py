"""Fits, splits, imputation, votes and learned strengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import MATCHES_SQL, SIDES_SQL, matches, query, r, rounded, sides, written_sides
from duelframe.catalog.history_queries import _features_sql
from duelframe.functions.odds import flat_profit
from duelframe.operators import evaluate, learn, newton, pairs, quality
from duelframe.operators.history import Metric, history_features
from duelframe.operators.sequence import latest_row
from duelframe.plans.sizing import cut


@query("linear_fit", """
SELECT r4(regr_slope(l_extendedprice, l_quantity)) AS slope, r2(regr_intercept(l_extendedprice, l_quantity)) AS intercept, r6(regr_r2(l_extendedprice, l_quantity)) AS r2 FROM lineitem""")
def linear_fit(t):
    fit = learn.linear_fit(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(fit["weights"][0], fit["intercept"], fit["r2"])], "slope double, intercept double, r2 double").select(
        r("slope").alias("slope"), r("intercept", 2).alias("intercept"), r("r2", 6).alias("r2"))


@query("linear_imputation", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS price FROM lineitem),
f AS (SELECT regr_slope(price, l_quantity) AS b, regr_intercept(price, l_quantity) AS a FROM n WHERE price IS NOT NULL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(coalesce(price, a + b * l_quantity), 0) AS price FROM n, f""")
def linear_imputation(t):
    n = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("price"))
    fit = learn.linear_fit(n, ["l_quantity"], "price")
    return learn.impute_linear(n, fit, "price", digits=6).withColumn("price", F.round("price", 0))


@query("linear_fit_two_features", """
WITH c AS (SELECT covar_pop(l_extendedprice, l_quantity) AS cqy, covar_pop(l_extendedprice, l_tax) AS cty, covar_pop(l_quantity, l_tax) AS cqt, var_pop(l_quantity) AS vq, var_pop(l_tax) AS vt,
  var_pop(l_extendedprice) AS vy, avg(l_extendedprice) AS my, avg(l_quantity) AS mq, avg(l_tax) AS mt FROM lineitem),
b AS (SELECT *, (cqy * vt - cty * cqt) / (vq * vt - cqt * cqt) AS wq, (cty * vq - cqy * cqt) / (vq * vt - cqt * cqt) AS wt FROM c)
SELECT r2(my - wq * mq - wt * mt) AS intercept, r4(wq) AS w_quantity, r2(wt) AS w_tax, r6((wq * cqy + wt * cty) / vy) AS r2 FROM b""")
def linear_fit_two_features(t):
    """Normal-equation solver against the closed form of two features."""
    fit = learn.linear_fit(t.lineitem.select("l_quantity", "l_tax", "l_extendedprice"), ["l_quantity", "l_tax"], "l_extendedprice")
    row = t.spark.createDataFrame([(fit["intercept"], *fit["weights"], fit["r2"])], "intercept double, w_quantity double, w_tax double, r2 double")
    return row.select(r("intercept", 2).alias("intercept"), r("w_quantity").alias("w_quantity"), r("w_tax", 2).alias("w_tax"), r("r2", 6).alias("r2"))


@query("fill_median_mean_zero", """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS x FROM orders)
SELECT o_orderkey, r2(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM n))) AS med, r2(coalesce(x, (SELECT avg(x) FROM n))) AS mean, coalesce(x, 0) AS zero FROM n""")
def fill_median_mean_zero(t):
    x = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    n = t.orders.select("o_orderkey", x.alias("med"), x.alias("mean"), x.alias("zero"))
    n = learn.fill_zero(learn.fill_mean(learn.fill_with(n, learn.medians(n, ["med"])), ["mean"]), ["zero"])
    return rounded(n, "med", "mean", digits=2)


@query("split_recent_year", """
SELECT CASE WHEN CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 365 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def split_recent_year(t):
    o = t.orders.select(F.col("o_orderdate").cast("date").alias("ts"))
    train, test = learn.split_recent(o, "ts", 365)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("split_fixed_date", """
SELECT CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def split_fixed_date(t):
    train, test = learn.split_at(t.orders.select(F.col("o_orderdate").cast("date").alias("ts")), "ts", "2000-01-01")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("split_random", """
SELECT CASE WHEN substr(md5('42:' || o_orderkey), 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def split_random(t):
    train, test = learn.split_random(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("time_folds", """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS i, count(*) OVER () AS c FROM orders)
SELECT o_orderkey, CAST(CASE WHEN i <= c - 5 * (c // 6) THEN 0 ELSE ceil((i - (c - 5 * (c // 6))) / (c // 6)::DOUBLE) END AS INT) AS fold FROM n""")
def time_folds(t):
    return learn.time_folds(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("ts")), ["ts", "o_orderkey"]).select("o_orderkey", "fold")


VOTE_SQL = """WITH p AS (SELECT o_orderkey, (o_orderkey % 7) / 7.0::DOUBLE AS a, (o_orderkey % 11) / 11.0::DOUBLE AS b, (o_orderkey % 13) / 13.0::DOUBLE AS c FROM orders) """


def _votes(t):
    k = F.col("o_orderkey")
    return {n: t.orders.select("o_orderkey", (k % m / F.lit(float(m))).alias("p")) for n, m in (("a", 7), ("b", 11), ("c", 13))}


@query("soft_vote", VOTE_SQL + "SELECT o_orderkey, r4((a + b + c) / 3) AS p, CASE WHEN (a + b + c) / 3 > 0.5 THEN 1 ELSE 0 END AS vote FROM p")
def soft_vote(t):
    return rounded(learn.soft_vote(_votes(t), ["o_orderkey"]), "p")


@query("hard_vote", VOTE_SQL + "SELECT o_orderkey, CASE WHEN (a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT >= 2 THEN 1 ELSE 0 END AS vote FROM p")
def hard_vote(t):
    return learn.hard_vote(_votes(t), ["o_orderkey"])


@query("balanced_weights", "SELECT doc_id, r4(CASE WHEN quality = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END) AS weight FROM labels, (SELECT count(*) AS n, sum(quality) AS p FROM labels)")
def balanced_weights(t):
    return rounded(learn.balanced_weights(t.labels, "quality").select("doc_id", "weight"), "weight")


def _strength_sql(steps: int) -> str:
    ctes = ["o AS (SELECT a AS e, b AS f, score AS w FROM matches UNION ALL SELECT b, a, 1 - score FROM matches)",
            "p AS (SELECT e, f, sum(w) AS w, count(*) AS n FROM o GROUP BY 1, 2)", "w AS (SELECT e, sum(w) + 1 AS w FROM p GROUP BY 1)", "g0 AS (SELECT e, 1.0::DOUBLE AS g FROM w)"]
    for i in range(steps):
        ctes.append(f"g{i + 1} AS (SELECT p.e, max(w.w) / (sum(p.n / (x.g + y.g)) + 2 / (max(x.g) + 1)) AS g FROM p JOIN g{i} x ON x.e = p.e JOIN g{i} y ON y.e = p.f JOIN w ON w.e = p.e GROUP BY p.e)")
    return "WITH " + MATCHES_SQL + ", " + ", ".join(ctes) + f" SELECT e AS entity, r4(ln(g)) AS strength FROM g{steps}"


@query("learned_strengths", _strength_sql(4))
def learned_strengths(t):
    return rounded(learn.strengths(matches(t), iterations=4), "strength")


CONT_METRICS = (Metric("win", "sum", "win"), Metric("sigstr_pm", "rate", "sigstracc", "fight_time_minutes"), Metric("boutcount", "count"))


@query("feature_continuity", "WITH " + SIDES_SQL + ", f AS (" + _features_sql(CONT_METRICS, "sides", "entity, match_id, ts", "entity", "ts, match_id") + """),
l AS (SELECT *, lag(struct_pack(w := postcomp_win, s := postcomp_sigstr_pm, n := postcomp_boutcount)) OVER (PARTITION BY entity ORDER BY ts, match_id) AS q FROM f)
SELECT 'precomp_win' AS metric, count(*) AS compared, count(*) FILTER (WHERE abs(precomp_win - q.w) > 0.01) AS mismatches, avg(CASE WHEN abs(precomp_win - q.w) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) AS match_rate FROM l WHERE q IS NOT NULL
UNION ALL SELECT 'precomp_sigstr_pm', count(*), count(*) FILTER (WHERE abs(precomp_sigstr_pm - q.s) > 0.01), avg(CASE WHEN abs(precomp_sigstr_pm - q.s) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) FROM l WHERE q IS NOT NULL
UNION ALL SELECT 'precomp_boutcount', count(*), count(*) FILTER (WHERE abs(precomp_boutcount - q.n) > 0.01), avg(CASE WHEN abs(precomp_boutcount - q.n) <= 0.01 THEN 1.0::DOUBLE ELSE 0 END) FROM l WHERE q IS NOT NULL""")
def feature_continuity(t):
    """pre(n+1) = post(n) holds for every feature by construction."""
    f = history_features(written_sides(t), "entity", ["ts", "match_id"], CONT_METRICS)
    names = {f"precomp_{n}": f"postcomp_{n}" for n in ("win", "sigstr_pm", "boutcount")}
    return quality.continuity_report(quality.continuity_rows(f, "entity", ["ts", "match_id"], names))


@query("matchup_vectors", "WITH " + SIDES_SQL + """,
l AS (SELECT entity, ts, win, sigstracc FROM sides QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, match_id DESC) = 1)
SELECT s_suppkey AS a, s_suppkey + 1 AS b, coalesce(x.win, 0.5)::DOUBLE AS x_win, coalesce(y.win, 0.5)::DOUBLE AS opp_x_win, coalesce(x.sigstracc, 10)::DOUBLE AS x_sig, coalesce(y.sigstracc, 10)::DOUBLE AS opp_x_sig,
  coalesce(x.sigstracc, 10)::DOUBLE - coalesce(y.sigstracc, 10)::DOUBLE AS diff_x_sig
FROM supplier LEFT JOIN l x ON x.entity = s_suppkey LEFT JOIN l y ON y.entity = s_suppkey + 1""")
def matchup_vectors(t):
    s = sides(t).select("entity", "ts", "match_id", F.col("win").alias("postcomp_win"), F.col("sigstracc").alias("postcomp_sig"))
    latest = latest_row(s, "entity", ["ts", "match_id"]).drop("ts", "match_id")
    requests = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    v = learn.matchup_vector(pairs.expand_matchups(requests, latest, "a", "b", "entity"), {"win": 0.5, "sig": 10.0})
    return learn.differences(v, ["x_sig"]).select("a", "b", "x_win", "opp_x_win", "x_sig", "opp_x_sig", "diff_x_sig")


MODEL_FEATURES = ["precomp_winavg", "precomp_sigstr_pm", "precomp_tdavg", "precomp_winavg3", "opp_precomp_winavg", "opp_precomp_sigstr_pm", "opp_precomp_tdavg", "opp_precomp_winavg3"]


MODEL_METRICS = (Metric("winavg", "avg", "win"), Metric("sigstr_pm", "rate", "sigstracc", "fight_time_minutes"), Metric("tdavg", "rate", "tdacc", "fight_time_minutes", scale=15), Metric("boutcount", "count", frames=("",)))


def model_rows(t):
    f = history_features(written_sides(t), "entity", ["ts", "match_id"], MODEL_METRICS)
    pre = [c for c in f.columns if c.startswith("precomp_")]
    f = rounded(f.select("match_id", "ts", "entity", "opp_entity", "win", *pre), *[c for c in pre if "boutcount" not in c])
    left = f.where(F.col("entity") < F.col("opp_entity")).drop("opp_entity")
    right = f.where(F.col("entity") > F.col("opp_entity")).select("match_id", "entity", *pre)
    # Fits, imputers and scalers each read the table, so it is built once.
    return cut(pairs.side_join(left, right, ["match_id"]).withColumn("win", F.col("win").cast("double")))


BARE = [f.removeprefix("precomp_") for f in MODEL_FEATURES[:4]]
MODEL_ROWS_SQL = SIDES_SQL + ", f AS (" + _features_sql(MODEL_METRICS, "sides", "entity, match_id, ts", "entity", "ts, match_id") + """),
model_rows AS (
  SELECT l.match_id, l.ts, s.win::DOUBLE AS y, """ + ", ".join([f"l.precomp_{c}::DOUBLE AS x{i + 1}" for i, c in enumerate(BARE)] + [f"o.precomp_{c}::DOUBLE AS x{i + 5}" for i, c in enumerate(BARE)]) + """
  FROM f l JOIN sides s ON s.match_id = l.match_id AND s.entity = l.entity JOIN f o ON o.match_id = l.match_id AND l.entity < o.entity
)"""


def newton_sql(train: str, balanced: bool, p: int = len(MODEL_FEATURES), steps: int = 7, l2: float = 1.0) -> str:
    """CTEs that fit by unrolled Newton steps: ``ws`` has weight w of input i (1 is the bias), ``norm`` the means and deviations."""
    norm = ", ".join(f"avg(x{i}) AS m{i}, coalesce(nullif(stddev_pop(x{i}), 0), 1) AS d{i}, quantile_cont(x{i}, 0.5) AS q{i}" for i in range(1, p + 1))
    inputs = ", ".join(f"(x{i} - m{i}) / d{i}" for i in range(1, p + 1))
    weight = "CASE WHEN y = 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END" if balanced else "1.0::DOUBLE"
    ctes = [f"norm AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(y) AS pos, {norm} FROM {train})",
            f"z AS MATERIALIZED (SELECT y, {weight} AS s, [1.0::DOUBLE, {inputs}] AS x FROM {train}, norm)",
            f"w0 AS (SELECT i, 0.0::DOUBLE AS w FROM range(1, {p + 2}) t(i))"]
    for k in range(steps):
        ctes.append(f"q{k} AS MATERIALIZED (SELECT y, s, x, 1 / (1 + exp(-list_dot_product(x, (SELECT list(w ORDER BY i) FROM w{k})))) AS q FROM z)")
        ctes.append(f"""e{k}_0 AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = 1 THEN 0 WHEN j = {p + 2} THEN {l2} * w WHEN i = j THEN {l2} ELSE 0 END AS v FROM (
          SELECT i, j, sum(CASE WHEN j = {p + 2} THEN s * (q - y) * x[i] ELSE s * q * (1 - q) * x[i] * x[j] END) AS v FROM q{k}, range(1, {p + 2}) a(i), range(1, {p + 3}) b(j) GROUP BY i, j) JOIN w{k} USING (i))""")
        for c in range(1, p + 2):
            ctes.append(f"""e{k}_{c} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {c} THEN a.v / d.v ELSE a.v - f.v * r.v / d.v END AS v FROM e{k}_{c - 1} a
              JOIN e{k}_{c - 1} f ON f.i = a.i AND f.j = {c} JOIN e{k}_{c - 1} r ON r.i = {c} AND r.j = a.j JOIN e{k}_{c - 1} d ON d.i = {c} AND d.j = {c})""")
        ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT i, w - v AS w FROM w{k} JOIN e{k}_{p + 1} e USING (i) WHERE e.j = {p + 2})")
    return ",\n".join([*ctes, f"ws AS (SELECT * FROM w{steps})"])


def _margin_sql(columns) -> str:
    """The margin of a row in terms of ``ws`` and ``norm``; missing inputs take the median."""
    inputs = ", ".join(f"(coalesce({c}, q{i}) - m{i}) / d{i}" for i, c in enumerate(columns, 1))
    return f"list_dot_product([1.0::DOUBLE, {inputs}], (SELECT list(w ORDER BY i) FROM ws))"


XS = [f"x{i}" for i in range(1, 9)]
LAST_YEAR_SQL = "WITH " + MODEL_ROWS_SQL + """, past AS (SELECT * FROM model_rows WHERE ts < (SELECT max(ts) FROM model_rows) - 365),
""" + newton_sql("past", True)


@query("logistic_weights", LAST_YEAR_SQL + " SELECT CASE i WHEN 1 THEN 'bias' " + " ".join(f"WHEN {i + 2} THEN '{f}'" for i, f in enumerate(MODEL_FEATURES)) + " END AS feature, r4(w) AS weight FROM ws")
def logistic_weights(t):
    """Weights of a fit with balanced classes and a ridge, against Newton steps unrolled in SQL."""
    past, _ = learn.split_recent(model_rows(t), "ts", 365)
    fit = newton.fit_logistic(past, MODEL_FEATURES, "win", balanced=True)
    rows = t.spark.createDataFrame([("bias", fit.bias), *zip(fit.features, fit.weights)], "feature string, weight double")
    return rounded(rows, "weight")


@query("model_backtest", LAST_YEAR_SQL + """, s AS (SELECT y AS quality, 1 / (1 + exp(-""" + _margin_sql(XS) + """)) AS p FROM model_rows, norm WHERE ts >= (SELECT max(ts) FROM model_rows) - 365)
SELECT count(*) AS n, r4(avg(CASE WHEN (p > 0.5) = (quality = 1) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy, r4(avg(-(quality * ln(p) + (1 - quality) * ln(1 - p)))) AS log_loss, r4(avg(greatest(p, 1 - p))) AS avg_confidence,
  r4((SELECT sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) / (count(*)) FROM s a JOIN s b ON a.quality = 1 AND b.quality = 0)) AS auc FROM s""")
def model_backtest(t):
    """Train before the last year with balanced classes, score within it: accuracy, log loss, confidence and AUC."""
    past, last = learn.split_recent(model_rows(t), "ts", 365)
    scored = learn.score(newton.fit_logistic(past, MODEL_FEATURES, "win", balanced=True), last)
    return rounded(evaluate.probability_scores(scored, "win", "p"), "accuracy", "log_loss", "avg_confidence", "auc")


def _eliminate(name: str, first: str, p: int) -> list[str]:
    """CTEs that turn the first p columns of a matrix (i, j, v) into the identity; the last one is called ``name``."""
    steps = [first, *[f"{name}_{c}" for c in range(1, p)], name]
    return [f"""{after} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {c} THEN a.v / d.v ELSE a.v - f.v * r.v / d.v END AS v FROM {before} a
      JOIN {before} f ON f.i = a.i AND f.j = {c} JOIN {before} r ON r.i = {c} AND r.j = a.j JOIN {before} d ON d.i = {c} AND d.j = {c})""" for c, (before, after) in enumerate(zip(steps, steps[1:]), 1)]


SEARCHED = [MODEL_FEATURES[i] for i in (1, 2, 3, 5, 6, 7)]
RANKING_SQL = "WITH " + MODEL_ROWS_SQL + ", base AS (SELECT y, x1, x5 AS x2, x2 AS c1, x3 AS c2, x4 AS c3, x6 AS c4, x7 AS c5, x8 AS c6 FROM model_rows),\n" + newton_sql("base", True, p=2) + """,
cn AS (SELECT """ + ", ".join(f"avg(c{k}) AS mc{k}, stddev_pop(c{k}) AS dc{k}" for k in range(1, 7)) + """ FROM base),
r AS MATERIALIZED (SELECT s * (y - q) AS g, s * q * (1 - q) AS v, x, c FROM (
  SELECT y, CASE WHEN y = 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END AS s, [1.0::DOUBLE, (x1 - m1) / d1, (x2 - m2) / d2] AS x, [""" + ", ".join(f"(c{k} - mc{k}) / dc{k}" for k in range(1, 7)) + """] AS c,
    1 / (1 + exp(-list_dot_product([1.0::DOUBLE, (x1 - m1) / d1, (x2 - m2) / d2], (SELECT list(w ORDER BY i) FROM ws)))) AS q FROM base, norm, cn)),
inf0 AS MATERIALIZED (SELECT i, j, sum(CASE WHEN j > 3 THEN v * x[i] * c[j - 3] ELSE v * x[i] * x[j] END) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END AS v FROM r, range(1, 4) a(i), range(1, 10) b(j) GROUP BY i, j),
""" + ",\n".join(_eliminate("inf", "inf0", 3)) + """,
own AS (SELECT k, sum(g * c[k]) AS u, sum(v * c[k] * c[k]) AS w FROM r, range(1, 7) t(k) GROUP BY k),
across AS (SELECT o.j - 3 AS k, sum(o.v * e.v) AS known FROM inf0 o JOIN inf e ON e.i = o.i AND e.j = o.j WHERE o.j > 3 GROUP BY 1)
SELECT CASE k """ + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(SEARCHED, 1)) + """ END AS feature, CAST(row_number() OVER (ORDER BY u * u / (w - known) DESC) AS INT) AS place, r2(u * u / (w - known)) AS statistic FROM own JOIN across USING (k)"""


@query("feature_ranking", RANKING_SQL)
def feature_ranking(t):
    """Which feature would improve a fit of two most: score tests of all others in one pass."""
    rows = model_rows(t)
    fit = newton.fit_logistic(rows, [MODEL_FEATURES[0], MODEL_FEATURES[4]], "win", balanced=True)
    ranked = newton.score_tests(rows, fit, MODEL_FEATURES, "win", balanced=True)
    out = t.spark.createDataFrame([(name, n + 1, value) for n, (name, value) in enumerate(ranked)], "feature string, place int, statistic double")
    return rounded(out, "statistic", digits=2)


WALK_FOLD = "(year(ts) * 4 + quarter(ts))"
WALK_SQL = "WITH " + MODEL_ROWS_SQL + f""",
g AS (SELECT *, {WALK_FOLD} AS fold FROM model_rows), folds AS (SELECT DISTINCT fold FROM g),
st AS (SELECT f.fold, y, count(*) AS n, """ + ", ".join(f"avg({x}) AS m_{x}, avg({x} * {x}) - avg({x}) * avg({x}) AS v_{x}" for x in ("x1", "x2", "x5", "x6")) + """ FROM folds f JOIN g ON g.fold < f.fold GROUP BY ALL),
p AS (SELECT g.match_id, g.fold, g.y, CASE WHEN a.n >= 30 AND b.n >= 30 THEN 1 / (1 + exp(-(ln(b.n) - ln(a.n)""" + "".join(
    f" + coalesce(CASE WHEN b.v_{x} > 1e-9 THEN -0.5 * (ln(b.v_{x}) + (g.{x} - b.m_{x}) * (g.{x} - b.m_{x}) / b.v_{x}) END - CASE WHEN a.v_{x} > 1e-9 THEN -0.5 * (ln(a.v_{x}) + (g.{x} - a.m_{x}) * (g.{x} - a.m_{x}) / a.v_{x}) END, 0)"
    for x in ("x1", "x2", "x5", "x6")) + """))) END AS p FROM g LEFT JOIN st a ON a.fold = g.fold AND a.y = 0 LEFT JOIN st b ON b.fold = g.fold AND b.y = 1),
odds AS (SELECT p.*, (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = y AS hit, CASE WHEN (match_id * 7) % 400 >= 200 THEN (match_id * 7) % 400 - 100 ELSE -100 - (match_id * 7) % 400 END AS price FROM p WHERE p IS NOT NULL),
priced AS (SELECT *, CASE WHEN hit THEN CASE WHEN price > 0 THEN price::DOUBLE ELSE 100 * 100 / abs(price)::DOUBLE END ELSE -100.0::DOUBLE END AS profit FROM odds)
"""


@query("walk_forward_backtest", WALK_SQL + """SELECT fold, count(*) AS n, r4(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy, count(*) FILTER (WHERE greatest(p, 1 - p) >= 0.7) AS n_sure,
  r4(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE greatest(p, 1 - p) >= 0.7)) AS sure_accuracy, r2(sum(profit)) AS profit, r4(sum(profit) / (100.0::DOUBLE * count(*))) AS roi FROM priced GROUP BY fold""")
def walk_forward_backtest(t):
    """Every quarter scored by a model of the quarters before it: accuracy, the slice of sure picks, and the return at the odds."""
    rows = model_rows(t).withColumn("fold", F.year("ts") * 4 + F.quarter("ts"))
    scored = newton.walk_forward_bayes(rows, [MODEL_FEATURES[i] for i in (0, 1, 4, 5)], "win", "fold").where("p IS NOT NULL")
    m = F.col("match_id") * 7 % 400
    priced = scored.withColumn("hit", (F.col("p") > 0.5).cast("int") == F.col("win").cast("int")).withColumn("price", F.when(m >= 200, m - 100).otherwise(-100 - m))
    priced = priced.withColumn("profit", flat_profit(F.col("hit").cast("int"), F.col("price"), 100.0))
    sure = F.greatest(F.col("p"), 1 - F.col("p")) >= 0.7
    out = priced.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count_if(sure).alias("n_sure"), F.avg(F.when(sure, F.col("hit").cast("double"))).alias("sure_accuracy"),
        F.sum("profit").alias("profit"), (F.sum("profit") / (100.0 * F.count(F.lit(1)))).alias("roi"))
    return rounded(rounded(out, "accuracy", "sure_accuracy", "roi"), "profit", digits=2)


@query("model_votes", None)
def model_votes(t):
    """Logistic, boosted and Bayes models vote on the last year's matches."""
    rows = model_rows(t)
    train, test = learn.split_recent(rows, "ts", 365)
    models = {
        "logistic": learn.train(train, MODEL_FEATURES, "logistic", c=1.0, rows=train.count()),
        "boosted": learn.train(train, MODEL_FEATURES, "boosted", maxIter=5, maxDepth=3),
        "bayes": learn.train(train, MODEL_FEATURES, "bayes"),
    }
    return learn.soft_vote({n: learn.score(m, test) for n, m in models.items()}, ["match_id"])


MATCHUP_METRICS = MODEL_METRICS[:3]


@query("matchup_scores", "WITH " + MODEL_ROWS_SQL + ", " + newton_sql("model_rows", False) + """,
l AS (SELECT entity, """ + ", ".join(f"postcomp_{c} AS {c}" for c in BARE) + """ FROM f QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, match_id DESC) = 1),
asked AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier),
two_way AS (SELECT a, b, 1 / (1 + exp(-""" + _margin_sql([f"x.{c}" for c in BARE] + [f"y.{c}" for c in BARE]) + """)) AS p, 1 / (1 + exp(-""" + _margin_sql([f"y.{c}" for c in BARE] + [f"x.{c}" for c in BARE]) + """)) AS q
  FROM asked LEFT JOIN l x ON x.entity = a LEFT JOIN l y ON y.entity = b, norm)
SELECT a, b, r4((p + 1 - q) / 2) AS p FROM two_way""")
def matchup_scores(t):
    """Bulk scoring of one pairing per supplier in both orientations; the two probabilities add up to 1."""
    model = newton.fit_logistic(model_rows(t), MODEL_FEATURES, "win")
    f = history_features(written_sides(t), "entity", ["ts", "match_id"], MATCHUP_METRICS)
    named = rounded(f.select("entity", "ts", "match_id", *[F.col(f"postcomp_{n}").alias(f"precomp_{n}") for n in BARE]), *[f"precomp_{n}" for n in BARE])
    latest = latest_row(named, "entity", ["ts", "match_id"]).drop("ts", "match_id")
    here = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    one = pairs.expand_matchups(here, latest, "a", "b", "entity")
    two = pairs.expand_matchups(here, latest, "b", "a", "entity")
    return rounded(learn.score_matchups(model, one, two, ["a", "b"]).select("a", "b", "p"), "p")


@query("asof_training_rows", "WITH " + SIDES_SQL + ", f AS (" + _features_sql((Metric("winavg", "avg", "win"), Metric("boutcount", "count", frames=("",))), "sides", "entity, match_id, ts", "entity", "ts, match_id") + """),
d AS (SELECT entity, ts, postcomp_winavg, postcomp_boutcount FROM f QUALIFY row_number() OVER (PARTITION BY entity, ts ORDER BY match_id DESC) = 1)
SELECT m.match_id, x.postcomp_winavg AS postcomp_winavg, x.postcomp_boutcount AS postcomp_boutcount, y.postcomp_winavg AS opp_postcomp_winavg, y.postcomp_boutcount AS opp_postcomp_boutcount
FROM matches m ASOF LEFT JOIN d x ON x.entity = m.a AND m.ts > x.ts ASOF LEFT JOIN d y ON y.entity = m.b AND m.ts > y.ts""")
def asof_training_rows(t):
    """What was known of both sides before the day of each match: the training rows of an as-of model."""
    f = history_features(written_sides(t), "entity", ["ts", "match_id"], (Metric("winavg", "avg", "win"), Metric("boutcount", "count", frames=("",))))
    f = rounded(f.select("entity", "ts", "match_id", "postcomp_winavg", "postcomp_boutcount"), "postcomp_winavg")
    daily = latest_row(f, ["entity", "ts"], ["match_id"])
    out = pairs.asof_sides(matches(t).select("match_id", "ts", "a", "b"), daily, match_id="match_id", ts="ts", a="a", b="b", entity="entity",
                           columns=["postcomp_winavg", "postcomp_boutcount"])
    return out.drop("ts", "a", "b")


@query("standardised_features", """
WITH f AS (SELECT o_orderkey, o_totalprice AS x, (o_orderkey % 17)::DOUBLE AS y FROM orders), s AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy FROM f)
SELECT o_orderkey, r4((x - mx) / sx) AS x, r4((y - my) / sy) AS y FROM f, s""")
def standardised_features(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    f = t.orders.select("o_orderkey", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 17).cast("double").alias("y"))
    out = Pipeline(stages=learn.preprocessing(["x", "y"], impute=None)).fit(f).transform(f)
    v = vector_to_array("features")
    return out.select("o_orderkey", r(v[0]).alias("x"), r(v[1]).alias("y"))


@query("principal_components", """
WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS tight, abs(corr(l_quantity, l_tax)) AS loose FROM lineitem)
SELECT CASE WHEN (1 + tight) / 2 >= 0.95 THEN 1 ELSE 2 END AS tight, CASE WHEN (1 + loose) / 2 >= 0.95 THEN 1 ELSE 2 END AS loose, CASE WHEN (1 + loose) / 2 >= 0.5 THEN 1 ELSE 2 END AS half FROM c""")
def principal_components(t):
    """How many components explain a share of variance; of two standardised columns the first explains (1 + |r|) / 2."""
    from pyspark.ml import Pipeline

    counts = []
    for other, share in (("l_extendedprice", 0.95), ("l_tax", 0.95), ("l_tax", 0.5)):
        rows = t.lineitem.select(F.col("l_quantity").alias("x"), F.col(other).alias("y"))
        counts.append(learn.components_for(Pipeline(stages=learn.preprocessing(["x", "y"], impute=None)).fit(rows).transform(rows), "features", share))
    return t.spark.createDataFrame([tuple(counts)], "tight int, loose int, half int")


@query("bayes_scores", """
WITH f AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS win, o_totalprice / 1000 AS x, (o_orderkey % 17)::DOUBLE AS y FROM orders),
cut AS (SELECT CAST(max(o_orderdate) AS DATE) - 365 AS edge FROM f),
s AS (SELECT win, ln(count(*)) AS n, avg(x) AS mx, var_pop(x) AS vx, avg(y) AS my, var_pop(y) AS vy FROM f, cut WHERE o_orderdate < edge GROUP BY win),
l AS (SELECT o_orderkey, s.win, n - 0.5 * (ln(vx) + (x - mx) * (x - mx) / vx + ln(vy) + (y - my) * (y - my) / vy) AS l FROM f, cut, s WHERE o_orderdate >= edge)
SELECT o_orderkey, r2(1 / (1 + exp(max(l) FILTER (WHERE win = 0) - max(l) FILTER (WHERE win = 1)))) AS p FROM l GROUP BY 1""")
def bayes_scores(t):
    """Gaussian Bayes trained before the last year and scored on it: a model whose probabilities have a closed form."""
    rows = t.orders.select(
        "o_orderkey", "o_orderdate", (F.col("o_orderstatus") == "F").cast("double").alias("win"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 17).cast("double").alias("y"))
    train, test = learn.split_recent(rows, "o_orderdate", 365)
    model = learn.train(train, ["x", "y"], "bayes", pre={"impute": None, "scale": None})
    return rounded(learn.score(model, test).select("o_orderkey", "p"), "p", digits=2)


@query("votes_of_stored_models", """
WITH p AS (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS p1, (o_custkey % 7) / 6.0::DOUBLE AS p2, (o_orderkey % 3) / 2.0::DOUBLE AS p3 FROM orders)
SELECT o_orderkey, r4((p1 + p2 + p3) / 3) AS p, CASE WHEN (CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN p2 > 0.5 THEN 1 ELSE 0 END) + (CASE WHEN p3 > 0.5 THEN 1 ELSE 0 END) >= 2 THEN 1 ELSE 0 END AS hard FROM p""")
def votes_of_stored_models(t):
    """Soft and hard votes over probabilities that three models have stored."""
    p = {"one": (F.col("o_orderkey") % 11) / F.lit(10.0), "two": (F.col("o_custkey") % 7) / F.lit(6.0), "three": (F.col("o_orderkey") % 3) / F.lit(2.0)}
    stored = {n: t.orders.select("o_orderkey", c.alias("p")) for n, c in p.items()}
    soft = learn.soft_vote(stored, ["o_orderkey"]).select("o_orderkey", "p")
    hard = learn.hard_vote(stored, ["o_orderkey"]).select("o_orderkey", F.col("vote").alias("hard"))
    return rounded(soft.join(hard, "o_orderkey"), "p")


@query("matchup_symmetry", """
WITH r AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier) SELECT a, b, n, true AS one FROM r, (VALUES (1), (2)) AS twice(n)""")
def matchup_symmetry(t):
    """Every pairing is asked twice and in both orders: each request has its row, and the two orders add up to 1."""
    rows = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 5).cast("double").alias("opp_x"))
    games = t.customer.select((F.col("c_acctbal")).alias("x"), (F.col("c_custkey") % 5).cast("double").alias("opp_x"), (F.col("c_nationkey") % 2).cast("double").alias("win"))
    model = learn.train(games, ["x", "opp_x"], "logistic", c=1.0, rows=games.count())
    twice = rows.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    swap = lambda d: d.withColumns({"x": F.col("opp_x"), "opp_x": F.col("x")})
    here = learn.score_matchups(model, twice, swap(twice), ["a", "b", "n"]).select("a", "b", "n", "p")
    there = learn.score_matchups(model, swap(twice), twice, ["a", "b", "n"]).select("a", "b", "n", F.col("p").alias("q"))
    return here.join(there, ["a", "b", "n"]).select("a", "b", "n", (F.abs(F.col("p") + F.col("q") - 1) < 1e-9).alias("one"))
