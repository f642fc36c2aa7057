"""Join operators against brute force on small fixtures."""

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe.operators import clean, learn, market, pairs, quality, sequence
from duelframe.operators.phrases import phrases_in
from duelframe.plans.quantiles import exact_quantiles, exact_quantiles_of


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def noisy(rng, word):
    chars = list(word)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(chars)) if chars else 0
        op = rng.choice("sid")
        if op == "s" and chars:
            chars[at] = rng.choice("abcd")
        elif op == "i":
            chars.insert(at, rng.choice("abcd"))
        elif chars:
            chars.pop(at)
    return "".join(chars)


def test_similar_texts_finds_every_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(40)]
    left = [(rng.randint(0, 2), noisy(rng, w)) for w in base for _ in range(3)]
    right = [(rng.randint(0, 2), noisy(rng, w)) for w in base for _ in range(3)]
    left, right = [x for x in left if x[1]], [x for x in right if x[1]]
    l, r = spark.createDataFrame(left, "g int, a string"), spark.createDataFrame(right, "g int, b string")
    for sim in (0.8, 0.6):
        got = {(x.g, x.a, x.b) for x in pairs.similar_texts(l, "a", r, "b", ["g"], sim).collect()}
        want = {(g, a, b) for g, a in left for h, b in right if g == h and 1 - lev(a, b) / max(len(a), len(b)) >= sim}
        assert got == want


def test_pieces_travel_as_hashes_and_events_once_a_span(spark):
    m = spark.createDataFrame([(1, dt.date(2024, 1, 5), "abcdabcdabcd", "xyxyxyxyxy")], "m int, day date, fa string, fb string")
    e = spark.createDataFrame([(7, dt.date(2024, 1, 6), "abcdabcdabcx", "xyxyxyxyxyx")], "e int, eday date, home string, away string")
    out = pairs.match_market_events(m, e, match_id="m", day="day", a="fa", b="fb", event_day="eday", home="home", away="away", event_id="e")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x and "_key" in x]
    assert len(joins) == 2 and all("levenshtein" in x and "_piece" not in x for x in joins)
    assert not [x for x in plan.splitlines() if "Generate explode(array(date_add" in x]
    assert [tuple(r) for r in out.select("m", "e").collect()] == [(1, 7)]


def test_market_match_equals_all_pairs_within_the_days(spark):
    rng = random.Random(8)
    day = lambda n: dt.date(1969, 12, 20) + dt.timedelta(n)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 14))) for _ in range(6)]
    m = [(i, day(rng.randint(0, 40)), rng.choice(base), rng.choice(base)) for i in range(60)] + [(60, None, base[0], base[1])]
    e = [(i, day(rng.randint(0, 40)), noisy(rng, rng.choice(base)), noisy(rng, rng.choice(base))) for i in range(90)] + [(90, None, base[0], base[1])]
    ms, es = spark.createDataFrame(m, "m int, day date, fa string, fb string"), spark.createDataFrame(e, "e int, eday date, home string, away string")
    names = dict(match_id="m", day="day", a="fa", b="fb", event_day="eday", home="home", away="away", event_id="e")
    ratio = lambda a, b: 1 - lev(a, b) / max(len(a), len(b))
    for slack in (0, 1, 3):
        want = {}
        for i, d, a, b in m:
            for k, ed, h, w in e:
                if d and ed and abs((d - ed).days) <= slack:
                    same = sorted((a, b)) == sorted((h, w))
                    sim = 1.0 if same else max((ratio(a, h) + ratio(b, w)) / 2, (ratio(a, w) + ratio(b, h)) / 2)
                    if sim >= 0.8:
                        want[i] = max(want.get(i, (0, 0, 0)), (int(same), round(sim, 9), k))
        got = {r.m: (round(r.similarity, 9), r.e) for r in pairs.match_market_events(ms, es, slack=slack, **names).collect()}
        assert got == {i: x[1:] for i, x in want.items()} and got


def test_market_match_prefers_the_exact_pair(spark):
    d = dt.date(2024, 1, 5)
    m = spark.createDataFrame([(1, d, "jonsmith", "bobjones"), (2, d, "alphaone", "betatwo"), (3, d, "nobody", "nowhere")], "m int, day date, fa string, fb string")
    e = spark.createDataFrame([
        (10, d + dt.timedelta(1), "bobjones", "jonsmith"), (11, d, "jonsmitt", "bobjones"), (12, d, "betatwo", "alphaonee"), (13, d + dt.timedelta(3), "nobody", "nowhere"),
    ], "e int, eday date, home string, away string")
    names = dict(match_id="m", day="day", a="fa", b="fb", event_day="eday", home="home", away="away", event_id="e")
    for exact_ratio in (False, True):
        got = {r.m: r.e for r in pairs.match_market_events(m, e, exact_ratio=exact_ratio, **names).collect()}
        assert got == {1: 10, 2: 12}


def test_exploded_names_are_never_broadcast(spark, capsys):
    """Days, pieces and places multiply rows behind the planner's back, so small tables must not plan a broadcast either."""
    d = dt.date(2024, 1, 5)
    m = spark.createDataFrame([(1, d, "jonsmith", "bobjones")], "m int, day date, fa string, fb string")
    e = spark.createDataFrame([(10, d, "bobjones", "jonsmith")], "e int, eday date, home string, away string")
    names = dict(day="day", a="fa", b="fb", event_day="eday", home="home", away="away", event_id="e")
    for found in (pairs.match_market_events(m, e, match_id="m", **names), pairs.market_event_candidates(m, e, **names)):
        assert [r.e for r in found.collect()] == [10]
        found.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_contains_join_paths_agree(spark):
    texts = spark.createDataFrame([("Women's Flyweight Bout",), ("Light Heavyweight Bout",), ("Catch Weight",), ("Flyweight Title Bout",)], "t string")
    phrases = spark.createDataFrame([("Flyweight",), ("Women's Flyweight",), ("Heavyweight",), ("Light Heavyweight",)], "p string")
    small = pairs.contains_join(texts, "t", phrases, "p")
    large = pairs.contains_join(texts, "t", phrases, "p", part_bytes=12)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    best = {r.t: r.p for r in pairs.longest_phrase(small, ["t"], "p").collect()}
    assert best == {"Women's Flyweight Bout": "Women's Flyweight", "Light Heavyweight Bout": "Light Heavyweight", "Flyweight Title Bout": "Flyweight"}


def test_phrases_in_texts_equal_plain_search(spark):
    """Phrases inside, at the end of and overlapping each other, in texts of any length, with one automaton and with many."""
    r = random.Random(1)
    phrases = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(60)})
    texts = ["".join(r.choice("abéx") for _ in range(r.randint(0, 60))) for _ in range(80)] + ["", None, "ab" * 5000, "日本ab"]
    want = sorted({(t, p) for t in texts if t is not None for p in phrases if p in t})
    tables = spark.createDataFrame([(t,) for t in texts * 2], "t string"), spark.createDataFrame([(p,) for p in [*phrases, "", None, phrases[0]]], "p string")
    for size in (1 << 17, 30):
        assert sorted(map(tuple, phrases_in(tables[0], "t", tables[1], "p", part_bytes=size).collect())) == want
    assert phrases_in(tables[0], "t", tables[1].limit(0), "p").count() == 0 and phrases_in(tables[0].limit(0), "t", tables[1], "p").count() == 0


def test_nearest_value_ties_go_to_the_larger(spark):
    people = spark.createDataFrame([("x", 1, 130.0), ("y", 1, 100.0), ("z", 2, 300.0)], "n string, sex int, w double")
    table = spark.createDataFrame([(1, 125.0, 2), (1, 135.0, 3), (2, 205.0, 11)], "sex int, limit double, idx int")
    for limit in (100, 1):
        got = {r.n: r.idx for r in pairs.nearest_value(people, "sex", "w", table, "limit", ["idx"], ["n"], limit).collect()}
        assert got == {"x": 3, "y": 2, "z": 11}


def test_opponents_of_irregular_matches_are_kept(spark):
    df = spark.createDataFrame([("m", "A", 1), ("m", "B", 2), ("n", "A", 3), ("k", "A", 4), ("k", "B", 5), ("k", "C", 6)], "m string, e string, x int")
    got = {(r.m, r.e): (r.n_sides, r.ox) for r in pairs.opponent_rows(df, ["m"], "e", {"x": "ox"}).collect()}
    assert got == {("m", "A"): (2, 2), ("m", "B"): (2, 1), ("n", "A"): (1, None), ("k", "A"): (3, None), ("k", "B"): (3, None), ("k", "C"): (3, None)}
    total = {(r.m, r.e): r.ox for r in pairs.others_total(df, ["m"], {"x": "ox"}).collect()}
    assert total[("k", "A")] == 11 and total[("n", "A")] == 0


def test_asof_strict_and_inclusive(spark):
    probes = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 1, 3)], "k string, ts int, id int")
    snaps = spark.createDataFrame([("a", 5, "s5"), ("a", 6, "s6")], "k string, ts int, snap string")
    strict = pairs.asof_latest(probes, snaps, ["k"], "ts", "snap", "out", tie=["id"])
    assert {r.id: r.out for r in strict.collect()} == {1: None, 2: "s6", 3: None}
    loose = pairs.asof_latest(probes, snaps, ["k"], "ts", "snap", "out", strict=False, tie=["id"], limit=2)
    assert {r.id: r.out for r in loose.collect()} == {1: "s5", 2: "s6", 3: None}


def test_quantiles_match_pandas(spark):
    rng = random.Random(5)
    values = [float(rng.randint(0, 40)) if rng.random() < 0.5 else 7.0 for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    import pandas as pd

    want = pd.Series(values).quantile([0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]).tolist()
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    assert exact_quantiles(df, "v", probs) == want
    assert exact_quantiles(df, "v", probs, limit=20) == want


def test_planted_outliers_are_removed(spark):
    import numpy as np

    odds = np.clip(np.random.default_rng(42).normal(0, 150, 997), -400, 400).tolist() + [3000.0, -2500.0, 2000.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odds)], "i int, avg_market_odds double")
    for method, threshold in (("iqr", 2.0), ("zscore", 3.0)):
        kept = market.filter_outliers(df, "avg_market_odds", method, threshold)
        removed = {r.i for r in clean.rows_removed(df, kept, ["i"]).collect()}
        assert {997, 998, 999} <= removed


def test_streaks_and_carry_forward_on_a_hot_entity(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 4 else "cold", i, rng.random() < 0.7) for i in range(120)]
    df = spark.createDataFrame(rows, "e string, ts int, won boolean").withColumns({"pre": F.lit(0), "post": F.col("ts")})
    small = sequence.win_streak_before(df, "e", ["ts"], F.col("won"), limit=10)
    plain = sequence.win_streak_before(df, "e", ["ts"], F.col("won"))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, plain.collect()))
    run, want = {}, {}
    for e, ts, won in rows:
        want[ts] = run.get(e, 0)
        run[e] = run.get(e, 0) + 1 if won else 0
    assert {r.ts: r.streak_before for r in small.collect()} == want
    carried = sequence.carry_forward(df, "e", ["ts"], {"pre": "post"}, F.col("ts") >= 50, limit=10)
    assert {r.ts: r.pre for r in carried.where("e = 'hot'").collect()} == {
        ts: (0 if ts < 50 else max(t for e, t, _ in rows if e == "hot" and t < ts)) for e, ts, _ in rows if e == "hot"}


def test_time_folds_match_expanding_split(spark):
    df = spark.range(20).select(F.col("id").alias("ts"))
    got = {r.ts: r.fold for r in learn.time_folds(df, ["ts"], 5).collect()}
    assert [sum(1 for f in got.values() if f == k) for k in range(6)] == [5, 3, 3, 3, 3, 3]
    assert all(got[t] <= got[t + 1] for t in range(19))


def test_mirror_symmetry_and_repair(spark):
    df = spark.createDataFrame([("m1", 1, "a", "b", 10, 20, 1, 0)], "m string, ts int, e string, opp_e string, x int, opp_x int, win int, opp_win int").withColumn("result", F.col("win"))
    both = pairs.mirror_rows(df, recompute="result")
    assert {(r.e, r.x, r.opp_x, r.win, r.result) for r in both.collect()} == {("a", 10, 20, 1, 1), ("b", 20, 10, 0, 0)}
    assert all(r.mismatches == 0 for r in quality.mirror_report(both, ["m"], "e", ["x"]).collect())
    hist = spark.createDataFrame([("a", 1, 1500.0, 1510.0), ("a", 2, 1490.0, 1520.0), ("a", 3, 1520.5, 1530.0)], "e string, ts int, pre double, post double")
    fixed = [r.pre for r in quality.repair_continuity(hist, "e", ["ts"], "pre", "post").orderBy("ts").collect()]
    assert fixed == [1500.0, 1510.0, 1520.5]
    latest = quality.corrected_latest(hist, "e", ["ts"], "pre", "post").first()
    assert (latest.ts, latest.pre) == (3, 1520.5)
    rows = quality.continuity_rows(hist, "e", ["ts"], {"pre": "post"}, tolerance=0.01, min_matches=3)
    rep = quality.continuity_report(rows).first()
    assert (rep.compared, rep.mismatches) == (2, 2)


def test_nearest_value_ways_agree_on_nulls_and_ties(spark):
    people = spark.createDataFrame([(1, "m", 5.0), (2, "m", None), (3, "w", 1.0), (4, None, 1.0), (5, "m", 7.5)], "n int, sex string, w double")
    table = spark.createDataFrame([("m", 4.0, "a"), ("m", 4.0, "b"), ("m", 8.0, "c"), ("m", 7.0, "d"), ("m", None, "z")], "sex string, at double, idx string")
    ways = [sorted((r.n, r.idx) for r in pairs.nearest_value(people, "sex", "w", table, "at", ["idx"], ["n"], limit).collect()) for limit in (100, 1)]
    assert ways[0] == ways[1] == [(1, "b"), (5, "c")]


def test_asof_takes_the_largest_of_equal_instants(spark):
    probes = spark.createDataFrame([("a", 5), ("a", 9)], "k string, t int")
    rows = [("a", 3, 2), ("a", 3, 7), ("a", 3, 1), ("a", 8, 4)]
    for order in (rows, rows[::-1]):
        snaps = spark.createDataFrame(order, "k string, t int, v int")
        got = {r.t: r.found for r in pairs.asof_latest(probes, snaps, ["k"], "t", "v", "found").collect()}
        assert got == {5: 7, 9: 4}


def test_low_thresholds_are_refused(spark):
    m = spark.createDataFrame([(1, dt.date(2024, 1, 1), "a", "b")], "m int, d date, a string, b string")
    with pytest.raises(ValueError):
        pairs.match_market_events(m, m.toDF("e", "d", "h", "w"), match_id="m", day="d", a="a", b="b", event_day="d", home="h", away="w", event_id="e", threshold=0.5, exact_ratio=True)


def test_quantiles_share_their_passes(spark):
    """Many ranks of several columns, far over the limit, in a handful of jobs."""
    df = spark.range(5000).selectExpr("id % 977 AS a", "CAST(id * id % 1009 AS double) AS b", "CASE WHEN id % 3 = 0 THEN 1.0 END AS c").cache()
    df.count()
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    got = exact_quantiles_of(df, {c: probs for c in "abc"}, limit=300)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("quantiles"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plain = df.toPandas()
    for c in "abc":
        assert got[c] == pytest.approx(list(plain[c].astype(float).quantile(probs)))
    assert jobs < 10
