"""Every rating system over all matches, checked against a recursive SQL replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.catalog.base import MATCHES_SQL, matches, query, r, rounded
from duelframe.operators import evaluate, profile, quality, ratings as R
from duelframe.plans.sizing import cut
from duelframe.operators.rating_rules import RATINGS, WEIGHTS_ACCURACY, WEIGHTS_LIVE, WEIGHTS_TUNED

AS_OF = "2002-01-01"


def _weight(w) -> str:
    return (
        f"(CASE WHEN kind = 'ko' AND score = 1 THEN {w['ko']} WHEN kind = 'ko' THEN 1.0 WHEN kind = 'subw' THEN {w['sub']} "
        f"WHEN kind = 'udec' THEN {w['udec']} WHEN kind = 'sdec' THEN {w['sdec']} ELSE {w['mdec']} END)::DOUBLE"
    )


CLASS = "(CASE WHEN abs(natural_class - opp_natural_class) < 1 THEN 1.0::DOUBLE ELSE greatest(0.75::DOUBLE, 1 - 0.08::DOUBLE * abs(natural_class - opp_natural_class)) END)"
ROUND = "(CASE WHEN round = 1 THEN (1.15::DOUBLE * 1.15::DOUBLE) ELSE 1.0::DOUBLE END) * (1 + (1 - round / 3.0::DOUBLE) * 0.25::DOUBLE)"


def _e(x, y, scale) -> str:
    return f"(1 / (1 + pow(10::DOUBLE, (({y}) - ({x})) / {scale}::DOUBLE)))"


def _flat(side, factor=0.978) -> str:
    return f"CASE WHEN gap_{side} > 365 THEN s{side} * {factor}::DOUBLE ELSE s{side} END"


def _elo(k, scale, ka="1", kb="1", ra=None, rb=None):
    return dict(
        ra=ra or "sa", rb=rb or "sb",
        na=f"ra + {k} * {ka} * (score - {_e('ra', 'rb', scale)})", nb=f"rb + {k} * {kb} * ((1 - score) - {_e('rb', 'ra', scale)})",
    )


def _streaks(gain):
    return f"(1 + {gain}::DOUBLE * streak_a)", f"(1 + {gain}::DOUBLE * streak_b)"


_fin = lambda side, own: (
    f"CASE WHEN {own} AND kind IN ('ko', 'subw') THEN least(1.5::DOUBLE, x{side} + 0.05::DOUBLE) "
    f"WHEN NOT {own} AND kind IN ('ko', 'subw') THEN greatest(0.7::DOUBLE, x{side} - 0.1::DOUBLE) "
    f"WHEN x{side} > 1 THEN greatest(1.0::DOUBLE, x{side} - 0.01::DOUBLE) WHEN x{side} < 1 THEN least(1.0::DOUBLE, x{side} + 0.02::DOUBLE) ELSE 1.0::DOUBLE END"
)
_drift = "CASE WHEN xb > 1 THEN greatest(1.0::DOUBLE, xb - 0.01::DOUBLE) WHEN xb < 1 THEN least(1.0::DOUBLE, xb + 0.02::DOUBLE) ELSE 1.0::DOUBLE END"
_hyb = lambda s: (
    f"CASE WHEN gap_{s} > 365 THEN s{s} * (0.978::DOUBLE - (0.978::DOUBLE - 0.95::DOUBLE) * ((least(gap_{s}, 730) - 365) / 365.0::DOUBLE)) ELSE s{s} END"
)
_act = lambda s: f"greatest(1 - least(coalesce(gap_{s}, 0) / 30.0::DOUBLE * 2, 50::DOUBLE) / 1000, 0.95::DOUBLE)"
_sim = lambda s: f"CASE WHEN gap_{s} > 0 THEN greatest(s{s} - least(2 * gap_{s} / 30.0::DOUBLE, 50::DOUBLE), 1200::DOUBLE) ELSE s{s} END"
_g = lambda rd: f"(1 / sqrt(1 + 3 * {rd} * {rd} / (pi() * pi() * 160000.0::DOUBLE)))"


def _sql_rules() -> dict[str, dict]:
    s15, s10, s05 = _streaks(0.15), _streaks(0.1), _streaks(0.05)
    live = f"40 * {_weight(WEIGHTS_LIVE)} * {ROUND} * {CLASS}"
    tuned = f"40 * {_weight(WEIGHTS_TUNED)} * {ROUND} * {CLASS}"
    acc = f"40 * {_weight(WEIGHTS_ACCURACY)}"
    rules = {
        "time_finish": _elo(live, 220, *s15, _flat("a"), _flat("b")),
        "tuned": _elo(tuned, 220, s10[0] + " * (1 + 0.01::DOUBLE * n_a)", s10[1] + " * (1 + 0.01::DOUBLE * n_b)", _flat("a"), _flat("b")),
        "accuracy": _elo(acc, 220, *s05, _flat("a"), _flat("b")),
        "learned_decay": _elo(acc, 220, *s05, _flat("a", 0.975), _flat("b", 0.975)),
        "log_loss": _elo(acc, 220, *s05, _hyb("a"), _hyb("b")),
        "weight_class": _elo(f"{acc} * {CLASS}", 220, *s05, _flat("a"), _flat("b")),
        "finish_factor": {**_elo("32", 220, "xna", "xnb"), "xna": _fin("a", "score = 1"), "xnb": _drift, "x0": "1"},
        "mean_reverting": _elo(
            f"{acc} * (CASE WHEN title_fight = 1 THEN 2 ELSE 1 END)", 400, s05[0] + " / sqrt(greatest(1, n_a))", "1 / sqrt(greatest(1, n_b))",
            "1500 + (sa - 1500) * pow(0.9995::DOUBLE, coalesce(gap_a, 0))", "1500 + (sb - 1500) * pow(0.9995::DOUBLE, coalesce(gap_b, 0))"),
        "activity": _elo(
            "40 * (CASE WHEN title_fight = 1 THEN 1.15::DOUBLE ELSE 1 END) * (CASE WHEN (CASE WHEN score = 1 THEN ra - rb ELSE rb - ra END) < -50 THEN 1.1::DOUBLE ELSE 1 END)",
            400, _act("a"), _act("b")),
        "linear": _elo("25", 400),
    }
    k = "(32 * (CASE WHEN title_fight = 1 THEN 1.15::DOUBLE ELSE 1 END))"
    ea, eb = _e("ra", "rb", 400), _e("rb", "ra", 400)
    gain = f"greatest({k} * (1 - {ea}) * (CASE WHEN (score = 1 AND {ea} < 0.5) OR (score = 0 AND {ea} > 0.5) THEN 1.1::DOUBLE ELSE 1 END), 16::DOUBLE)"
    loss = f"greatest({k} * {eb}, 16::DOUBLE)"
    raw_a, raw_b = f"greatest(CASE WHEN score = 1 THEN ra + {gain} ELSE ra - {loss} END, 1200::DOUBLE)", f"greatest(CASE WHEN score = 1 THEN rb - {loss} ELSE rb + {gain} END, 1200::DOUBLE)"
    rules["simple"] = dict(
        ra=_sim("a"), rb=_sim("b"),
        na=f"CASE WHEN score = 1 AND {raw_a} <= ra THEN ra + 16 WHEN score = 0 AND {raw_a} >= ra THEN ra - 16 ELSE {raw_a} END",
        nb=f"CASE WHEN score = 1 AND {raw_b} >= rb THEN rb - 16 WHEN score = 0 AND {raw_b} <= rb THEN rb + 16 ELSE {raw_b} END",
    )
    margin = "(CASE WHEN landed - absorbed = opp_landed - opp_absorbed THEN 0.5::DOUBLE WHEN landed - absorbed > opp_landed - opp_absorbed THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    rules["striking"] = dict(ra="sa", rb="sb", na=f"ra + 20 * ({margin} - {ea})", nb=f"rb + 20 * ((1 - {margin}) - {eb})")
    grap = "(CASE WHEN tdavg + subavg + tddef / 100 = opp_tdavg + opp_subavg + opp_tddef / 100 THEN 0.5::DOUBLE WHEN tdavg + subavg + tddef / 100 > opp_tdavg + opp_subavg + opp_tddef / 100 THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    rules["grappling"] = dict(ra="sa", rb="sb", na=f"ra + 20 * ({grap} - {ea})", nb=f"rb + 20 * ((1 - {grap}) - {eb})")
    rec = f"exp(-date_diff('day', ts, DATE '{AS_OF}') / 1000.0::DOUBLE)"
    st = "(1 + (rb - 1500) / 1000.0::DOUBLE)"
    fa, fb = f"((landed - absorbed) * {st})", f"((opp_landed - opp_absorbed) * {st})"
    perf = f"(CASE WHEN {fa} = {fb} THEN 0.5::DOUBLE WHEN {fa} > {fb} THEN 1::DOUBLE ELSE 0::DOUBLE END)"
    rules["striking_recent"] = dict(ra="sa", rb="sb", na=f"ra + 20 * ({rec} * {perf} - {ea})", nb=f"rb + 20 * ({rec} * (1 - {perf}) - (1 - {ea}))")
    rules["offence_defence"] = dict(
        ra="sa", rb="sb", x0="1500",
        na=f"sa + 20 * (landed / 50 - {_e('sa', 'xb', 400)})", nb=f"sb + 20 * (opp_landed / 50 - {_e('sb', 'xa', 400)})",
        xna=f"xa + 20 * ((1 - opp_landed / 50) - {_e('xa', 'sb', 400)})", xnb=f"xb + 20 * ((1 - landed / 50) - {_e('xb', 'sa', 400)})",
    )
    wa, wb = (f"least(sqrt(x{s} * x{s} + 0.25::DOUBLE * coalesce(gap_{s}, 0)), 350::DOUBLE)" for s in "ab")
    e1 = f"(1 / (1 + pow(10::DOUBLE, -{_g('wb')} * (ra - rb) / 400.0::DOUBLE)))"
    e2 = f"(1 / (1 + pow(10::DOUBLE, -{_g('wa')} * (rb - na) / 400.0::DOUBLE)))"
    v1, v2 = f"(1 / ({_g('wb')} * {_g('wb')} * {e1} * (1 - {e1})))", f"(1 / ({_g('wa')} * {_g('wa')} * {e2} * (1 - {e2})))"
    rules["glicko"] = dict(
        ra="sa", rb="sb", x0="350", wa=wa, wb=wb, sequential=True,
        na=f"ra + {v1} * {_g('wb')} * (score - {e1})", nb=f"rb + {v2} * {_g('wa')} * ((1 - score) - {e2})",
        xna=f"greatest(30::DOUBLE, 1 / sqrt(1 / (xa * xa) + 1 / {v1}))", xnb=f"greatest(30::DOUBLE, 1 / sqrt(1 / (xb * xb) + 1 / {v2}))",
    )
    return rules


SQL_RULES = _sql_rules()


def replay_ctes(name: str, source: str = "matches") -> str:
    """CTEs ending in ``rated``: one recursion step per match of a league, carrying all ratings in a list."""
    q = SQL_RULES[name]
    x0 = q.get("x0", "0")
    early = ", ".join(f"{q[c]} AS {c}" for c in ("ra", "rb", "wa", "wb") if c in q)
    mid = ", ".join(f"{q.get(c, 'x' + c[-1])} AS {c}" for c in ("xna", "xnb")) if not q.get("sequential") else "0 AS nothing"
    last = f"{q['na']} AS na, {q['nb']} AS nb"
    if q.get("sequential"):
        inner = f"SELECT *, {q['nb']} AS nb, {q['xna']} AS xna, {q['xnb']} AS xnb FROM (SELECT *, {q['na']} AS na FROM (SELECT *, {early} FROM (@step)))"
    else:
        inner = f"SELECT *, {last} FROM (SELECT *, {mid} FROM (SELECT *, {early} FROM (@step)))"
    inner = inner.replace("@step", "SELECT g.*, f.s, f.x, f.s[g.ia] AS sa, f.s[g.ib] AS sb, f.x[g.ia] AS xa, f.x[g.ib] AS xb FROM fold f JOIN g ON g.league = f.league AND g.i = f.i + 1")
    return MATCHES_SQL + f""",
long AS (SELECT league, match_id, ts, a AS e, score = 1 AS won FROM {source} UNION ALL SELECT league, match_id, ts, b, score <> 1 FROM {source}),
h0 AS (SELECT *, lag(ts) OVER w AS prev_ts, row_number() OVER w - 1 AS n,
         coalesce(sum(CASE WHEN won THEN 0 ELSE 1 END) OVER (PARTITION BY league, e ORDER BY ts, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS losses
       FROM long WINDOW w AS (PARTITION BY league, e ORDER BY ts, match_id)),
h AS (SELECT *, row_number() OVER (PARTITION BY league, e, losses ORDER BY ts, match_id) - 1 AS streak, date_diff('day', prev_ts, ts) AS gap FROM h0),
ents AS (SELECT league, e, row_number() OVER (PARTITION BY league ORDER BY e) AS pos FROM (SELECT DISTINCT league, e FROM long)),
g AS MATERIALIZED (SELECT m.*, row_number() OVER (PARTITION BY m.league ORDER BY m.ts, m.match_id) AS i, pa.pos AS ia, pb.pos AS ib,
         ha.gap AS gap_a, hb.gap AS gap_b, ha.streak AS streak_a, hb.streak AS streak_b, ha.n AS n_a, hb.n AS n_b
      FROM {source} m JOIN h ha ON ha.match_id = m.match_id AND ha.e = m.a JOIN h hb ON hb.match_id = m.match_id AND hb.e = m.b
      JOIN ents pa ON pa.league = m.league AND pa.e = m.a JOIN ents pb ON pb.league = m.league AND pb.e = m.b),
fold AS (
  SELECT league, 0::BIGINT AS i, list_transform(range(max(pos)), lambda z: 1500::DOUBLE) AS s, list_transform(range(max(pos)), lambda z: {x0}::DOUBLE) AS x,
         NULL::BIGINT AS match_id, NULL::DATE AS ts, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS score,
         NULL::DOUBLE AS ra, NULL::DOUBLE AS rb, NULL::DOUBLE AS na, NULL::DOUBLE AS nb, NULL::DOUBLE AS xa, NULL::DOUBLE AS xb, NULL::DOUBLE AS xna, NULL::DOUBLE AS xnb
  FROM ents GROUP BY league
  UNION ALL
  SELECT league, i, list_transform(s, lambda z, j: CASE WHEN j = ia THEN na WHEN j = ib THEN nb ELSE z END),
         list_transform(x, lambda z, j: CASE WHEN j = ia THEN xna WHEN j = ib THEN xnb ELSE z END),
         match_id, ts, a, b, score, ra, rb, na, nb, xa, xb, xna, xnb
  FROM ({inner})
),
rated AS (SELECT league, match_id, ts, a, b, score, ra AS pre, rb AS opp_pre, na AS post, nb AS opp_post, xna AS post_x, xnb AS opp_post_x FROM fold WHERE match_id IS NOT NULL)
"""


def _inputs(t, name):
    m = matches(t)
    if name == "finish_factor":
        m = R.finish_inputs(m)
    elif name == "striking":
        m = R.strike_inputs(m)
    elif name == "striking_recent":
        m = R.recent_strike_inputs(m, AS_OF)
    elif name == "offence_defence":
        m = R.two_sided_inputs(m)
    elif name == "grappling":
        m = R.grapple_inputs(m)
    return R.rating_inputs(m, name)


def _rated(t, name, **kw):
    return R.rate(_inputs(t, name), name, **kw)


def _register(name):
    extra = ["post_x", "opp_post_x"] if RATINGS[name].rule in ("two_sided", "glicko", "finish") else []
    cols = ["pre", "opp_pre", "post", "opp_post", *extra]
    sql = "WITH RECURSIVE " + replay_ctes(name) + "SELECT match_id, a, b, " + ", ".join(f"r2({c}) AS {c}" for c in cols) + " FROM rated"

    @query(f"rating_{name}", sql)
    def run(t):
        return rounded(_rated(t, name).select("match_id", "a", "b", *cols), *cols, digits=2)


for _name in SQL_RULES:
    _register(_name)


FINAL = ", last_row AS (SELECT league, e AS entity, ts, match_id, post FROM (SELECT league, a AS e, ts, match_id, post FROM rated UNION ALL SELECT league, b, ts, match_id, opp_post FROM rated) QUALIFY row_number() OVER (PARTITION BY league, e ORDER BY ts DESC, match_id DESC) = 1) "


@query("top_rated", "WITH RECURSIVE " + replay_ctes("linear") + FINAL + "SELECT league, entity, r2(post) AS rating FROM last_row ORDER BY post DESC, league, entity LIMIT 10")
def top_rated(t):
    top = R.top_rated(R.current_state(_rated(t, "linear")), 10)
    return top.select("league", "entity", r("r", 2).alias("rating"))


@query("rating_history", "WITH RECURSIVE " + replay_ctes("linear") + """, wanted AS (SELECT s_suppkey AS entity FROM supplier WHERE s_acctbal > 5000)
SELECT league, match_id, entity, r2(pre) AS pre, r2(post) AS post FROM
 (SELECT league, match_id, a AS entity, pre, post FROM rated UNION ALL SELECT league, match_id, b, opp_pre, opp_post FROM rated) WHERE entity IN (SELECT entity FROM wanted)""")
def rating_history(t):
    wanted = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("entity"))
    h = R.rating_history(_rated(t, "linear"), wanted)
    return rounded(h.select("league", "match_id", "entity", "pre", "post"), "pre", "post", digits=2)


@query("peak_rating", "WITH RECURSIVE " + replay_ctes("linear") + """
SELECT entity, r2(max(post)) AS peak_post FROM (SELECT a AS entity, post FROM rated UNION ALL SELECT b, opp_post FROM rated) GROUP BY 1""")
def peak_rating(t):
    return rounded(profile.peak_per_entity(R.by_entity(_rated(t, "linear")), "entity", "post"), "peak_post", digits=2)


@query("rating_summary", "WITH RECURSIVE " + replay_ctes("time_finish") + """
SELECT r4(avg(post - pre)) AS mean_change, r4(avg(abs(post - pre))) AS mean_abs_change, r2(min(post)) AS min_rating, r2(max(post)) AS max_rating, count(*) AS n
FROM (SELECT pre, post FROM rated UNION ALL SELECT opp_pre, opp_post FROM rated)""")
def rating_summary(t):
    s = profile.rating_summary(R.by_entity(_rated(t, "time_finish")), "pre", "post")
    return rounded(rounded(s, "mean_change", "mean_abs_change"), "min_rating", "max_rating", digits=2)


@query("accuracy_by_month", "WITH RECURSIVE " + replay_ctes("linear") + """
SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS total,
  CAST(sum(CASE WHEN (pre > opp_pre AND score = 1) OR (pre < opp_pre AND score = 0) THEN 1 ELSE 0 END) AS BIGINT) AS correct,
  r4(avg(CASE WHEN (pre > opp_pre AND score = 1) OR (pre < opp_pre AND score = 0) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy,
  r2(avg(pre - opp_pre)) AS avg_gap, r2(stddev_samp(pre - opp_pre)) AS std_gap
FROM rated GROUP BY 1""")
def accuracy_by_month(t):
    rated = _rated(t, "linear").withColumn("month", F.date_trunc("month", "ts").cast("date"))
    out = profile.accuracy_by(rated, ["month"], evaluate.rating_hit("pre", "opp_pre", "score"), F.col("pre") - F.col("opp_pre"))
    return rounded(rounded(out, "accuracy"), "avg_gap", "std_gap", digits=2)


@query("best_and_worst_days", "WITH RECURSIVE " + replay_ctes("linear") + """,
d AS (SELECT ts, league, count(*) AS total, r6(avg(CASE WHEN (pre > opp_pre AND score = 1) OR (pre < opp_pre AND score = 0) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy FROM rated GROUP BY 1, 2)
(SELECT ts, league, total, accuracy, 'top' AS "end" FROM d WHERE total >= 3 ORDER BY accuracy DESC, ts, league LIMIT 5)
UNION ALL (SELECT ts, league, total, accuracy, 'bottom' FROM d WHERE total >= 3 ORDER BY accuracy, ts, league LIMIT 5)""")
def best_and_worst_days(t):
    d = profile.accuracy_by(_rated(t, "linear"), ["ts", "league"], evaluate.rating_hit("pre", "opp_pre", "score")).drop("correct")
    return profile.best_and_worst(cut(rounded(d, "accuracy", digits=6)), "accuracy", "total", 3, 5, ["ts", "league"])


@query("rating_baseline", "WITH RECURSIVE " + replay_ctes("linear") + """,
p AS (SELECT *, 1 / (1 + exp(-(pre - opp_pre) / 170.0::DOUBLE)) AS p FROM rated)
SELECT count(*) AS n, r4(avg(CASE WHEN (pre > opp_pre AND score = 1) OR (pre < opp_pre AND score = 0) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy,
  r4(avg(-(score * ln(p) + (1 - score) * ln(1 - p)))) AS log_loss, r4(avg(greatest(p, 1 - p))) AS avg_confidence FROM p""")
def rating_baseline(t):
    out = evaluate.rating_baseline(_rated(t, "linear"), "pre", "opp_pre", "score")
    return rounded(out, "accuracy", "log_loss", "avg_confidence")


@query("recent_rating_score", "WITH RECURSIVE " + replay_ctes("time_finish") + """,
p AS (SELECT *, 1 / (1 + exp(-(pre - opp_pre) / 170.0::DOUBLE)) AS p FROM rated WHERE ts >= (SELECT max(ts) FROM rated) - INTERVAL 548 DAY)
SELECT count(*) AS n, r4(avg(CASE WHEN (pre > opp_pre AND score = 1) OR (pre < opp_pre AND score = 0) THEN 1.0::DOUBLE ELSE 0 END)) AS accuracy,
  r4(avg(-(score * ln(p) + (1 - score) * ln(1 - p)))) AS log_loss, r4(avg(greatest(p, 1 - p))) AS avg_confidence FROM p""")
def recent_rating_score(t):
    return rounded(evaluate.recent_rating_score(_rated(t, "time_finish")), "accuracy", "log_loss", "avg_confidence")


@query("rating_increment", "WITH RECURSIVE " + replay_ctes("time_finish") + "SELECT match_id, r2(pre) AS pre, r2(opp_pre) AS opp_pre, r2(post) AS post, r2(opp_post) AS opp_post FROM rated")
def rating_increment(t):
    """Earlier matches first, the later ones on top of the stored state: equal to one run."""
    inputs = _inputs(t, "time_finish")
    early, late = (inputs.where(F.col("ts") < "2000-01-01"), inputs.where(F.coalesce(F.col("ts") >= "2000-01-01", F.lit(True))))
    first = cut(R.rate(early, "time_finish"))
    second, _ = R.update_with_late_results(late, "time_finish", R.current_state(first))
    out = first.unionByName(second).select("match_id", "pre", "opp_pre", "post", "opp_post")
    return rounded(out, "pre", "opp_pre", "post", "opp_post", digits=2)


@query("rating_features", "WITH RECURSIVE " + replay_ctes("linear") + """,
l AS (SELECT league, match_id, ts, a AS entity, pre, post FROM rated UNION ALL SELECT league, match_id, ts, b, opp_pre, opp_post FROM rated),
d AS (SELECT *, post - pre AS change, coalesce(pre - lag(pre) OVER (PARTITION BY league, entity ORDER BY ts, match_id), 0) AS pre_prev FROM l)
SELECT league, entity, match_id, r2(change) AS change, r2(pre_prev) AS pre_prev,
  r2(sum(pre_prev) OVER (PARTITION BY league, entity ORDER BY ts, match_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) AS pre_prev_change_3,
  r2(sum(change) OVER (PARTITION BY league, entity ORDER BY ts, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) AS post_change_5 FROM d""")
def rating_features(t):
    cols = ["change", "pre_prev", "pre_prev_change_3", "post_change_5"]
    out = R.rating_features(_rated(t, "linear"))
    return rounded(out.select("league", "entity", "match_id", *cols), *cols, digits=2)


CONT = "WITH RECURSIVE " + replay_ctes("time_finish") + """,
l AS (SELECT league, match_id, ts, a AS entity, pre, post FROM rated UNION ALL SELECT league, match_id, ts, b, opp_pre, opp_post FROM rated),
c AS (SELECT *, lag(post) OVER (PARTITION BY league, entity ORDER BY ts, match_id) AS prev FROM l)
"""


@query("rating_continuity", CONT + """
SELECT league, entity, count(*) AS compared, CAST(sum(CASE WHEN abs(pre - prev) <= 1 THEN 0 ELSE 1 END) AS BIGINT) AS mismatches,
  r4(avg(CASE WHEN abs(pre - prev) <= 1 THEN 1.0::DOUBLE ELSE 0 END)) AS match_rate FROM c WHERE prev IS NOT NULL GROUP BY 1, 2""")
def rating_continuity(t):
    """Layoff decay breaks continuity: per entity the share of matches whose pre equals the previous post."""
    rows = quality.continuity_rows(cut(R.by_entity(_rated(t, "time_finish"))), ["league", "entity"], ["ts", "match_id"], {"pre": "post"}, tolerance=1.0)
    return rounded(quality.continuity_report(rows, ["league", "entity"]), "match_rate")


@query("continuity_repair", CONT + """
SELECT league, entity, match_id, r2(CASE WHEN abs(pre - prev) > 1 THEN prev ELSE pre END) AS pre, r2(post) AS post FROM c""")
def continuity_repair(t):
    fixed = quality.repair_continuity(cut(R.by_entity(_rated(t, "time_finish"))), ["league", "entity"], ["ts", "match_id"], "pre", "post")
    return rounded(fixed.select("league", "entity", "match_id", "pre", "post"), "pre", "post", digits=2)


@query("corrected_latest", CONT + """
SELECT league, entity, match_id, r2(CASE WHEN abs(pre - prev) > 1 THEN prev ELSE pre END) AS pre, r2(post) AS post FROM c
QUALIFY row_number() OVER (PARTITION BY league, entity ORDER BY ts DESC, match_id DESC) = 1""")
def corrected_latest(t):
    rows = cut(R.by_entity(_rated(t, "time_finish")))
    last = quality.corrected_latest(rows, ["league", "entity"], ["ts", "match_id"], "pre", "post")
    return rounded(last.select("league", "entity", "match_id", "pre", "post"), "pre", "post", digits=2)
