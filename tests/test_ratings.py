"""Rating systems against hand values, a plain-Python replay, and each other's execution modes."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import ratings as R
from duelframe.operators.rating_rules import RATINGS

FLAGS = ["ko", "kod", "subw", "subwd", "udec", "udecd", "sdec", "sdecd", "mdec", "mdecd"]


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        a, b = rng.sample(range(14), 2)
        won = rng.random() < 0.5
        kind = rng.choice([("ko", "kod"), ("subw", "subwd"), ("udec", "udecd"), ("sdec", "sdecd"), ("mdec", "mdecd")])
        flag = kind[0] if won else kind[1]
        rows.append({
            "match_id": i, "league": rng.choice(["x", "y"]), "ts": dt.date(2015, 1, 1) + dt.timedelta(days=9 * i),
            "a": a, "b": b, "score": None if i % 23 == 5 else float(won), **{f: int(f == flag) for f in FLAGS},
            "round": rng.choice([1, 2, 3]), "time_format": "3 Rnd (5-5-5)",
            "natural_class": rng.choice([5.0, 6.0, 8.0]), "opp_natural_class": 6.0, "fought_class": 6.0,
            "title_fight": int(i % 10 == 0), "label": "title" if i % 10 == 0 else "bout",
            "landed": rng.randint(0, 40), "absorbed": rng.randint(0, 40), "opp_landed": rng.randint(0, 40),
            "opp_absorbed": rng.randint(0, 40), "attempts": rng.randint(0, 60), "opp_attempts": rng.randint(1, 60),
        })
    schema = (
        "match_id int, league string, ts date, a int, b int, score double, "
        + ", ".join(f"{f} int" for f in FLAGS)
        + ", round int, time_format string, natural_class double, opp_natural_class double, fought_class double,"
        " title_fight int, label string, landed int, absorbed int, opp_landed int, opp_absorbed int, attempts int, opp_attempts int"
    )
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def prepared(matches, name):
    if name == "finish_factor":
        matches = R.finish_inputs(matches)
    if name == "striking":
        matches = R.strike_inputs(matches)
    if name == "striking_recent":
        matches = R.recent_strike_inputs(matches, "2020-01-01")
    if name == "offence_defence":
        matches = R.two_sided_inputs(matches)
    return R.rating_inputs(matches, name)


def as_dict(df):
    return {r.match_id: tuple(None if r[c] is None else round(r[c], 6) for c in R.OUT) for r in df.collect()}


WAVES = {"time_finish": 3, "offence_defence": 2, "mean_reverting": 1, "log_loss": 1, "finish_factor": 1, "activity": 1, "simple": 1,
         "striking_recent": 1, "glicko": 2}


@pytest.mark.parametrize("name", sorted(WAVES))
def test_blocks_equal_fold(spark, matches, name):
    """Blocks of matches with states passed on, and array updates: the same ratings as one fold, match by match."""
    inputs = prepared(matches, name).cache()
    want = as_dict(R.rate(inputs, name, mode="fold"))
    assert as_dict(R.rate(inputs, name, mode="blocks", limit=inputs.count() // (3 * WAVES[name]) + 1)) == want


@pytest.mark.parametrize("name", sorted(WAVES))
@pytest.mark.parametrize("wide", [0, 10**9])
def test_array_updates_equal_single_ones(spark, matches, monkeypatch, name, wide):
    """Both ways through a task with all leagues in it give the same ratings, skipped matches and stored states included."""
    inputs = prepared(matches, name)
    early, late = inputs.where("match_id < 40"), inputs.where("match_id >= 40")
    want = as_dict(R.rate(inputs, name, mode="fold"))
    monkeypatch.setattr(R, "WIDE", wide)
    assert as_dict(R.rate(inputs, name, mode="fold")) == want
    state = R.current_state(R.rate(early, name, mode="fold"))
    assert as_dict(R.rate(late, name, state=state, mode="blocks", limit=30)) == {k: v for k, v in want.items() if k >= 40}


def test_hot_entity_and_components(spark):
    """One entity in a third of all matches, and leagues of small components: no group over the limit is folded whole."""
    r = random.Random(11)
    hot = [(i, "one", dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(400)), f"p{r.randrange(12)}" if i % 3 else "hub", f"q{r.randrange(12)}", float(r.random() < 0.5)) for i in range(45)]
    apart = [(100 + i, "two", dt.date(2020, 1, 1) + dt.timedelta(days=i), f"a{i % 9}", f"b{i % 9}", float(i % 2)) for i in range(36)]
    df = spark.createDataFrame(hot + apart, "match_id int, league string, ts date, a string, b string, score double")
    inputs = R.rating_inputs(df, "linear")
    whole = as_dict(R.rate(inputs, "linear", mode="fold"))
    assert as_dict(R.rate(inputs, "linear", limit=30)) == whole
    two = R.rating_inputs(df.where("league = 'two'"), "linear")
    assert as_dict(R.rate(two, "linear", limit=5)) == {k: v for k, v in whole.items() if k >= 100}


def test_components_are_named_by_their_smallest_entity(spark):
    r = random.Random(4)
    rows = [(r.choice(["x", "y", None]), r.randrange(60), r.randrange(60)) for _ in range(70)]
    rows += [("chain", n, n + 1) for n in r.sample(range(100), 40)] + [("star", 50, n) for n in range(100)] + [("x", None, 3), ("x", 70, None), ("y", 71, 71)]
    best = {(k, v): v for k, *ab in rows for v in ab if v is not None}
    for _ in range(100):
        for k, a, b in rows:
            if None not in (k, a, b):
                best[k, a] = best[k, b] = min(best[k, a], best[k, b])
    got = R.components(spark.createDataFrame(rows, "league string, a int, b int")).where("entity IS NOT NULL").collect()
    assert {(x.league, x.entity): x.component for x in got} == best and len(got) == len(best)


def test_nothing_to_rate(spark, matches):
    inputs = prepared(matches, "linear").where("score IS NULL")
    for mode in ("fold", "blocks"):
        assert all(r.post is None for r in R.rate(inputs, "linear", mode=mode, limit=1).collect())


def test_every_rule_is_covered():
    assert {RATINGS[n].rule for n in WAVES} == {s.rule for s in RATINGS.values()}


def test_even_ratings_move_by_half_k(spark):
    one = spark.createDataFrame([(1, "l", dt.date(2020, 1, 1), "a", "b", 1.0)], "match_id int, league string, ts date, a string, b string, score double")
    got = R.rate(R.rating_inputs(one, "linear"), RATINGS["linear"].with_(k=32.0)).first()
    assert (got.pre, got.post, got.opp_post) == (1500.0, 1516.0, 1484.0)


def test_layoff_needs_more_than_a_year(spark):
    rows = [(1, "l", dt.date(2020, 1, 1), "a", "b", 1.0), (2, "l", dt.date(2020, 12, 31), "a", "c", 1.0), (3, "l", dt.date(2021, 1, 1), "b", "d", 1.0)]
    df = spark.createDataFrame(rows, "match_id int, league string, ts date, a string, b string, score double")
    df = df.withColumns({f: F.lit(0) for f in FLAGS})
    got = {r.match_id: r for r in R.rate(R.rating_inputs(df, "accuracy"), "accuracy").collect()}
    assert got[2].pre == got[1].post  # 365 days
    assert math.isclose(got[3].pre, got[1].opp_post * 0.978)  # 366 days


def test_time_finish_replay(spark, matches):
    rows = sorted((r.asDict() for r in matches.collect()), key=lambda r: (r["league"], r["ts"], r["match_id"]))
    rating, streak, last, want = {}, {}, {}, {}
    for r in rows:
        if r["score"] is None:
            continue
        ka, kb = (r["league"], r["a"]), (r["league"], r["b"])
        ra, rb = rating.get(ka, 1500.0), rating.get(kb, 1500.0)
        if ka in last and (r["ts"] - last[ka]).days > 365:
            ra *= 0.978
        if kb in last and (r["ts"] - last[kb]).days > 365:
            rb *= 0.978
        w = 1.3 if r["ko"] else 1.6 if r["subw"] or r["subwd"] else 1.0 if r["udec"] or r["udecd"] else 0.6 if r["sdec"] or r["sdecd"] else 0.8 if r["mdec"] or r["mdecd"] else 1.0
        if r["round"] == 1:
            w *= 1.15 * 1.15
        gap = abs(r["natural_class"] - r["opp_natural_class"])
        w *= max(0.75, 1 - 0.08 * gap) if gap >= 1 else 1.0
        w *= 1 + (1 - r["round"] / 3) * 0.25
        e = 1 / (1 + 10 ** ((rb - ra) / 220))
        s = r["score"]
        na = ra + 40 * w * (1 + 0.15 * streak.get(ka, 0)) * (s - e)
        nb = rb + 40 * w * (1 + 0.15 * streak.get(kb, 0)) * ((1 - s) - (1 - e))
        want[r["match_id"]] = tuple(round(x, 6) for x in (ra, rb, na, nb))
        rating[ka], rating[kb] = na, nb
        streak[ka], streak[kb] = (streak.get(ka, 0) + 1, 0) if s == 1 else (0, streak.get(kb, 0) + 1)
        last[ka] = last[kb] = r["ts"]
    got = {k: v[:4] for k, v in as_dict(R.rate(R.rating_inputs(matches, "time_finish"), "time_finish")).items() if v[0] is not None}
    assert got == want


def test_continuing_from_state_equals_one_run(spark, matches):
    inputs = prepared(matches, "time_finish")
    whole = as_dict(R.rate(inputs, "time_finish"))
    early, late = inputs.where("match_id < 90"), inputs.where("match_id >= 90")
    first = R.rate(early, "time_finish")
    state = R.current_state(first)
    second, new_state = R.update_with_late_results(late, "time_finish", state)
    assert {**as_dict(first), **as_dict(second)} == whole
    key = lambda df: {(r.league, r.entity): (round(r.r, 6), r.n, r.streak, r.day) for r in df.collect()}
    assert key(new_state) == key(R.current_state(R.rate(inputs, "time_finish")))


def test_stored_states_travel_with_the_matches(spark, matches):
    """States come as rows of their group, so that continuing joins nothing; any number of Arrow batches gives the same ratings."""
    inputs = prepared(matches, "time_finish")
    early, late = inputs.where("match_id < 90"), inputs.where("match_id >= 90")
    whole = as_dict(R.rate(inputs, "time_finish", mode="fold"))
    state = R.current_state(R.rate(early, "time_finish", mode="fold")).cache()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rated = R.fold(late, RATINGS["time_finish"], ["league"], state)
        assert as_dict(rated) == {k: v for k, v in whole.items() if k >= 90}
        assert as_dict(R.rate(inputs, "time_finish", mode="fold")) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
