"""Hand-checked cells, dates, odds and roundings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe.functions import numbers as nf, odds as of, text as tx
from duelframe.operators import evaluate, market


def one(spark, value, kind, *exprs):
    return tuple(spark.createDataFrame([(value,)], f"c {kind}").select(*[e.alias(f"e{i}") for i, e in enumerate(exprs)]).first())


def test_landed_of_attempted(spark):
    assert one(spark, "17 of 37", "string", tx.landed("c"), tx.attempted("c")) == (17, 37)
    assert one(spark, "junk", "string", tx.landed("c"), tx.attempted("c")) == (0, 0)


@pytest.mark.parametrize("cell,seconds", [("1:05", 65), ("--", 0), ("", 0)])
def test_clock(spark, cell, seconds):
    assert one(spark, cell, "string", tx.clock_seconds("c")) == (seconds,)


def test_elapsed(spark):
    assert one(spark, "4:30", "string", tx.elapsed_seconds(F.lit("2"), "c"), tx.elapsed_minutes(F.lit("2"), "c")) == (570, 9)
    assert one(spark, "0:40", "string", tx.elapsed_minutes(F.lit(1), "c")) == (0,)


def test_sides(spark):
    assert one(spark, "A. One vs. B. Two", "string", tx.left_side("c"), tx.right_side("c")) == ("A. One", "B. Two")


def test_attributes(spark):
    assert one(spark, "5' 11\"", "string", tx.height_inches("c")) == (71.0,)
    assert one(spark, "6'", "string", tx.height_inches("c")) == (72.0,)
    assert one(spark, "185 lbs.", "string", tx.weight_pounds("c")) == (185.0,)
    assert one(spark, '75"', "string", tx.reach_inches("c")) == (75.0,)
    assert one(spark, "--", "string", tx.height_inches("c"), tx.weight_pounds("c"), tx.reach_inches("c")) == (None, None, None)


def test_dates(spark):
    assert one(spark, "March 16, 2024", "string", tx.long_date("c")) == (dt.date(2024, 3, 16),)
    assert one(spark, "Jul 22, 1989", "string", tx.long_date("c")) == (dt.date(1989, 7, 22),)
    assert one(spark, "--", "string", tx.long_date("c")) == (None,)
    assert one(spark, dt.date(2000, 6, 15), "date", nf.whole_years(F.lit("2020-06-14").cast("date"), "c")) == (19,)


@pytest.mark.parametrize("p,odds", [(0.6, -150.0), (0.4, 150.0), (0.5, -100.0), (1.0, None), (0.0, None)])
def test_american(spark, p, odds):
    assert one(spark, p, "double", of.american_from_probability("c")) == (odds,)


@pytest.mark.parametrize("odds,win,profit", [(150.0, 1, 150.0), (-200.0, 1, 50.0), (150.0, 0, -100.0), (-200.0, 0, -100.0)])
def test_profit(spark, odds, win, profit):
    assert one(spark, odds, "double", of.flat_profit(F.lit(win), "c")) == (profit,)


@pytest.mark.parametrize("odds,want", [(-110.0, -110.0), (40.0, 100.0), (-40.0, -100.0), (0.0, 0.0)])
def test_clamp(spark, odds, want):
    assert one(spark, odds, "double", of.clamp_odds("c")) == (want,)


@pytest.mark.parametrize("x,want", [(1.23459, 1.23), (1.2399, 1.24), (0.125, 0.12), (-1.23459, -1.23)])
def test_truncate_round(spark, x, want):
    assert one(spark, x, "double", nf.truncate_round("c")) == (want,)


def test_normalised_pair(spark):
    df = spark.createDataFrame([("m", "a", 0.7), ("m", "b", 0.5), ("n", "a", 0.3)], "m string, e string, p double")
    got = {(r.m, r.e): round(r.prob_norm, 4) for r in market.consistent_odds(df, ["m"], "p").collect()}
    assert got == {("m", "a"): 0.5833, ("m", "b"): 0.4167, ("n", "a"): 0.3}


def test_block_ratio_is_the_library_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("kitten", "sitting"), ("abc", "abc"), ("", ""), ("jose aldo", "josé aldo jr")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.s for r in df.select(tx.block_ratio("a", "b").alias("s")).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_probability_helpers(spark):
    got = one(spark, 0.7, "double", nf.symmetric_probability("c", F.lit(0.4)), nf.clip("c", 0.15, 0.6), nf.confidence_label("c"), nf.softmax_pair("c", F.lit(0.7)))
    assert (round(got[0], 6), *got[1:]) == (0.65, 0.6, "high", 0.5)


def test_wilson(spark):
    df = spark.createDataFrame([(1, 1)] * 8 + [(1, 0)] * 2, "y int, h int")
    r = evaluate.class_scores(df, "y", "h").first()
    assert (round(r.wilson_low, 4), round(r.wilson_high, 4)) == (0.4902, 0.9433)
    assert (r.tp, r.fn, r.precision, r.recall) == (8, 2, 1.0, 0.8)
