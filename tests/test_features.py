"""Raw tables to features, on a tiny hand-made season."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from duelframe.catalog.base import matches, sides, written_sides
from duelframe.catalog.history_queries import match_history_features
from duelframe.catalog.raw_queries import raw_to_features
from duelframe.operators.history import MATCH_METRICS, Metric, feature_names, history_features, model_features
from duelframe.plans.match_features import match_features, match_views, two_views
from duelframe.sources import tables as src


@pytest.fixture(scope="module")
def raw(spark):
    events = [("E 1", "u", "March 1, 2020", "x"), ("E  2 ", "u", "May 1, 2020", "x"), ("E 3", "u", "June 1, 2021", "x")]
    results = [
        ("E 1", "Al One vs. Bo Two", "W/L", "Lightweight Bout", "KO/TKO ", "1", "4:30", "3 Rnd (5-5-5)"),
        ("E 1", "Cy Three vs. Di Four", "W/L", "Women's Flyweight Bout", "Submission ", "2", "1:00", "3 Rnd (5-5-5)"),
        ("E 2", "Al One vs. Bo Two", "L/W", "Lightweight Bout", "Decision - Unanimous ", "3", "5:00", "3 Rnd (5-5-5)"),
        ("E 3", "Bo Two vs. Al One", "NC/NC", "Lightweight Bout", "Overturned ", "1", "1:00", "3 Rnd (5-5-5)"),
    ]
    rounds = []
    for ev, bout, *_ in results:
        a, b = bout.split(" vs. ")
        for who, sig, td in ((a, "10 of 20", "1 of 2"), (b, "5 of 30", "0 of 1")):
            for rnd in ("Round 1", "Round 2"):
                rounds.append((ev, bout, rnd, who, "1", sig, "50%", sig, td, "50%", "1", "0", "1:05", sig, sig, sig, sig, sig, sig))
    people = [
        ("Al One", "5' 11\"", "155 lbs.", '72"', "Orthodox", "Jul 22, 1989"), ("Bo Two", "5' 9\"", "150 lbs.", "--", "Southpaw", "--"),
        ("Cy Three", "5' 5\"", "125 lbs.", '65"', "", "Jan 1, 1990"), ("Di Four", "5' 6\"", "130 lbs.", '66"', "Orthodox", "Jan 2, 1991"),
        ("No Match", "6' 0\"", "200 lbs.", "--", "", "--"),
    ]
    mk = lambda rows, schema: spark.createDataFrame([r + (None,) * (len(schema) - len(r)) for r in rows], schema)
    return {"events": mk(events, src.EVENTS), "results": mk(results, src.RESULTS), "round_stats": mk(rounds, src.ROUND_STATS), "attributes": mk(people, src.ATTRIBUTES)}


def test_end_to_end(spark, raw):
    out = match_features(raw, src.category_lookup(spark)).cache()
    rows = {(str(r.DATE), r.FIGHTER): r for r in out.collect()}
    assert len(rows) == 3  # the voided match is gone
    first, second = rows[("2020-03-01", "Al One")], rows[("2020-05-01", "Al One")]
    assert first.precomp_boutcount == 0 and first.postcomp_boutcount == 1 and first.precomp_sigstr_pm == 0
    assert first.sigstracc == 20 and first.sigstratt == 40 and first.sigstrabs == 10 and first.ctrl == 130
    assert first.fight_time_minutes == 4 and first.ko == 1 and first.opp_kod == 1
    assert second.precomp_winsum == 1 and second.result == 0 and second.opp_udec == 1 and second.precomp_sigstr_pm == 20 / 4
    assert second.weight_of_fight == 8 and second.sex == 2 and second.weightindex == 8 and second.opp_weightindex == 8
    assert rows[("2020-03-01", "Cy Three")].weight_of_fight == 2
    assert first.precomp_weight_avg3 == 0 and round(first.age, 2) == 30.61 and first.opp_age is None
    both = two_views(out)
    assert both.count() == 6
    turned = both.where("FIGHTER = 'Bo Two' AND DATE = '2020-03-01'").first()
    assert (turned.win, turned.result, turned.opp_ko, turned.opp_FIGHTER) == (0, 0, 1, "Al One")


def test_views_with_few_opponent_columns_equal_mirrored_matches(spark, raw):
    of_match = ["EVENT", "result", "fight_time_minutes"]
    twice = {"results": raw["results"].unionByName(raw["results"].where("EVENT = 'E 1'").withColumn("TIME", F.lit("2:30")))}
    # two outcomes of one match pair up every side with every side; which of the two is the earlier is open
    for tables, of_opponent in ((raw, ["sigstracc", "precomp_winsum"]), (raw | twice, ["sigstracc"])):
        got = match_views(tables, src.category_lookup(spark), of_match, of_opponent)
        wide = two_views(match_features(tables, src.category_lookup(spark)))
        columns = [*of_match, *[f"opp_{c}" for c in of_opponent], "FIGHTER", "ctrl", "totalatt", "postcomp_kosum", "precomp_winsum"]
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, wide.select(*columns).collect()))
        assert set(feature_names()) <= set(got.columns)


def test_wide_features_do_not_travel_by_match(spark):
    lines = [(o, o + n, (o + n) % 4, n, float(o % 7 + n), 10.0 * n + o, 0.01 * n, 0.02, "ANR"[o % 3]) for o in range(30) for n in (1, 2, 3)]
    orders = [(o, f"2020-01-{o % 28 + 1:02d}", "1-URGENT", "FOP"[o % 3], 1000.0 * o) for o in range(30)]
    t = SimpleNamespace(
        spark=spark, supplier=spark.createDataFrame([(k,) for k in range(4)], "s_suppkey long"),
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                       "l_extendedprice double, l_discount double, l_tax double, l_returnflag string"),
        orders=spark.createDataFrame(orders, "o_orderkey long, o_orderdate string, o_orderpriority string, o_orderstatus string, o_totalprice double"))
    out = raw_to_features(t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")  # the sides have met before their features are computed
    counted = sum(o % 23 != 0 and (o % 29 != 0 or r == 1) for o, r in matches(t).select("match_id", "round").collect())
    assert out.count() == 2 * counted > 0


def test_feature_family_size():
    names = feature_names()
    assert len(names) == len(set(names)) == 271
    assert "precomp_sigstr_pm5" in names and "postcomp_tot_time_in_cage_3" in names and "precomp_ostrabssum" not in names


def test_hot_entity_features_equal_plain(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, F.lit("rare")).otherwise("hot").alias("e"), (F.col("id") * 13 % 101).alias("ts"), F.col("id").alias("m"),
        *[((F.col("id") * k) % 7).cast("int").alias(c) for k, c in enumerate(sorted({c for x in MATCH_METRICS for c in (x.num, x.den) if c}), 3)],
    )
    few = MATCH_METRICS[:8] + MATCH_METRICS[19:24]
    plain = history_features(df, "e", ["ts", "m"], few)
    split = history_features(df, "e", ["ts", "m"], few, limit=40)
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(*plain.columns).collect()))


def test_missing_values_count_for_neither_way(spark):
    rows = [("hot" if i % 4 else "rare", i, None if i % 3 == 0 else i % 5, None if i % 7 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "e string, ts int, v int, x double")
    metrics = (Metric("v", "sum", "v"), Metric("vavg", "avg", "v", post_default=1.0), Metric("xavg", "avg", "x"), Metric("n", "count"))
    for limit in (1_000, 9):
        for r in history_features(df, "e", ["ts"], metrics, limit=limit).collect():
            past = [x for x in rows if x[0] == r.e and x[1] <= r.ts]
            for name, seen, none in (("postcomp_{}", past, 1.0), ("postcomp_{}3", past[-3:], 1.0), ("precomp_{}5", past[:-1][-5:], 0.0)):
                v, x = [y[2] for y in seen if y[2] is not None], [y[3] for y in seen if y[3] is not None]
                want = (sum(v), sum(v) / len(v) if v else none, sum(x) / len(x) if x else 0.0, len(seen))
                assert tuple(r[name.format(m)] for m in ("v", "vavg", "xavg", "n")) == pytest.approx(want)


def test_matches_are_built_once_for_features(spark):
    lines = [(o, o * 10 + n, (o + n) % 4, n, float(o % 7 + n), 10.0 * n + o, 0.01 * n, 0.02, "ANR"[o % 3]) for o in range(30) for n in (1, 2, 3)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                  "l_extendedprice double, l_discount double, l_tax double, l_returnflag string")
    orders = [(o, f"2020-01-{o % 28 + 1:02d}", "1-URGENT", "FOP"[o % 3], 1000.0 * o) for o in range(30)]
    orders = spark.createDataFrame(orders, "o_orderkey long, o_orderdate string, o_orderpriority string, o_orderstatus string, o_totalprice double")
    t = SimpleNamespace(spark=spark, lineitem=lines, orders=orders)
    assert written_sides(t).schema.simpleString() == sides(t).schema.simpleString()
    assert sorted(map(str, written_sides(t).collect())) == sorted(map(str, sides(t).collect()))
    out = match_history_features(t)
    assert "l_linenumber" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == sides(t).count() > 0


def test_post_match_features_are_refused():
    with pytest.raises(ValueError):
        model_features(["precomp_elo", "opp_postcomp_elo"])
