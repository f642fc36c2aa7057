"""Fits, searches and scores on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import evaluate, learn, newton


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(240):
        x, y, z = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        win = float(x - y + rng.gauss(0, 0.5) > 0)
        data.append((i, i // 2, "ab"[i % 2], x, y if i % 17 else None, z, win, 120.0 if i % 2 else -140.0, 110.0 if i % 2 else -130.0))
    df = spark.createDataFrame(data, "id int, day int, side string, x double, y double, z double, win double, b1 double, b2 double")
    return df.withColumn("DATE", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day"))).cache()


def test_linear_fits(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 2))
    y = 3 + X @ [2.0, -1.0] + rng.normal(scale=0.1, size=60)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(X, y)] + [(1.0, 1.0, None)], "a double, b double, t double")
    want = np.linalg.lstsq(np.c_[np.ones(60), X], y, rcond=None)[0]
    fit = learn.linear_fit(df, ["a", "b"], "t")
    assert np.allclose([fit["intercept"], *fit["weights"]], want, atol=1e-6)
    one = learn.linear_fit(df, ["a"], "t")
    w = np.polyfit(X[:, 0], y, 1)
    assert np.allclose([one["weights"][0], one["intercept"]], w)
    assert np.isclose(one["mse"], np.mean((y - np.polyval(w, X[:, 0])) ** 2))
    filled = learn.impute_linear(df, fit, "t").where("a = 1.0 AND b = 1.0").first()
    assert filled.t == round(float(want.sum()), 1)


def test_pipelines_learn_the_signal(rows):
    train, test = learn.split_at(rows, "DATE", "2020-04-01")
    for kind, extra in (("logistic", dict(c=1.0, rows=180)), ("boosted", dict(maxIter=3, maxDepth=2)), ("bayes", {}), ("network", dict(layers=(3, 4, 2), maxIter=30))):
        scored = learn.score(learn.train(train, ["x", "y", "z"], kind, **extra), test)
        assert evaluate.probability_scores(scored, "win", "p").first().auc > 0.8, kind
    model = learn.train(train, ["x", "y", "z"], "logistic")
    ranked = learn.ranked_weights(model, ["x", "y", "z"])
    assert {ranked[0][0], ranked[1][0]} == {"x", "y"}
    top = learn.key_factors(test.fillna(0.0), ranked, ["id"], 2).groupBy("id").count().agg(F.max("count")).first()[0]
    assert top == 2


def test_pca_onehot_and_robust_pipeline(rows):
    from pyspark.ml import Pipeline

    stages = learn.preprocessing(["x", "y", "z"], scale="robust", categories=["side"], pca=2)
    out = Pipeline(stages=stages).fit(rows).transform(rows)
    assert out.select("features").first().features.size == 2 + 2
    plain = Pipeline(stages=learn.preprocessing(["x", "y", "z"])).fit(rows).transform(rows)
    assert learn.components_for(plain, "features", share=0.95, most=3) == learn.components_for(plain, "features") == 3
    assert learn.components_for(plain, "features", share=0.99, most=1) == 1


def test_searches(rows):
    train, test = learn.split_at(rows, "DATE", "2020-04-01")
    ev = learn.log_loss_evaluator(train, test)
    first = learn.add_one_search([], ["x", "y", "z"], ev)
    assert first[-1]["feature_added"] == "z"
    steps = learn.forward_selection(["x", "y", "z"], ev, most=2)
    assert set(steps[-1]["features"]) == {"x", "y"}
    scores = {"x": 3.0, "y": 2.0, "z": -1.0}
    up = learn.forward_selection(["z", "y", "x"], lambda fs: {"score": sum(scores[f] for f in fs)}, rank="score", descending=True)
    assert [s["features"] for s in up] == [["x"], ["x", "y"]]
    best = learn.grid_search(train, ["x", "y"], "win", {"regParam": [0.01, 10.0]}, folds=2, parallelism=2)
    assert len(best.avgMetrics) == 2 and min(best.avgMetrics) > 0.8
    folds = learn.expanding_scores(rows, ["x", "y"], ["DATE", "id"], splits=2)
    assert [f["fold"] for f in folds] == [1, 2] and all(f["accuracy"] > 0.6 for f in folds)


def test_roi_search(rows):
    train, test = learn.split_at(rows, "DATE", "2020-04-01")
    ev = learn.roi_evaluator(train, test.withColumn("BOUT", F.col("day")), ["DATE", "BOUT"], ["DATE", "BOUT", "side"], ["b1", "b2"], ["DATE", "BOUT"])
    got = ev(["x", "y"])
    assert set(got) == {"final_roi", "roi_volatility", "score"} and got["score"] <= got["final_roi"]


def test_votes_and_random_split(spark, rows):
    train, test = learn.split_random(rows, "id", 0.2)
    assert train.count() + test.count() == 240 and 20 < test.count() < 80
    p = {n: rows.select("id", F.lit(v).alias("p")) for n, v in (("a", 0.9), ("b", 0.4), ("c", 0.45))}
    assert learn.soft_vote(p, ["id"]).first().vote == 1 and learn.hard_vote(p, ["id"]).first().vote == 0


def test_strengths_order_entities(spark):
    df = spark.createDataFrame([("a", "b", 1.0)] * 3 + [("b", "c", 1.0)] * 3 + [("a", "c", 1.0)], "a string, b string, score double")
    got = {r.entity: r.strength for r in learn.strengths(df, iterations=6, checkpoint_every=3).collect()}
    assert got["a"] > got["b"] > got["c"]


def plain_logistic(x, y, s, l2, steps=200):
    """Gradient descent with halving, slow and plain: least of sum(s * loss) + l2 / 2 |w|^2 over standardised inputs."""
    z = np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)]
    ridge = np.r_[0.0, np.full(x.shape[1], l2)]
    value = lambda w: float(s @ (np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * ridge @ (w * w))
    w, rate = np.zeros(z.shape[1]), 1.0
    for _ in range(steps * 100):
        g = z.T @ (s * (1 / (1 + np.exp(-z @ w)) - y)) + ridge * w
        while rate > 1e-14 and value(w - rate * g) > value(w):
            rate /= 2
        w, rate = w - rate * g, rate * 1.3
        if np.abs(g).max() < 1e-9:
            break
    return w


@pytest.mark.parametrize("balanced,l2", [(False, 1.0), (True, 0.1), (True, 25.0)])
def test_newton_fit_is_the_least_of_its_objective(spark, balanced, l2):
    r = np.random.default_rng(2)
    x = np.c_[r.normal(size=300), r.exponential(size=300) * 40, r.integers(0, 3, 300).astype(float)]
    y = (x[:, 0] - x[:, 1] / 30 + r.normal(size=300) > 0.3).astype(float)
    rows = [(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)]
    df = spark.createDataFrame(rows + [(1.0, 2.0, 3.0, None)], "a double, b double, c double, win double")
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    fit = newton.fit_logistic(df, ["a", "b", "c"], "win", balanced=balanced, l2=l2)
    assert np.allclose([fit.bias, *fit.weights], plain_logistic(x, y, s, l2), atol=1e-5) and fit.steps < 20
    p = np.array([q[0] for q in df.where("win IS NOT NULL").select(fit.probability()).collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)] @ [fit.bias, *fit.weights])))


def test_newton_fit_of_separable_missing_and_constant_inputs(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else float(i), 7.0, float(i > 20)) for i in range(40)], "a double, b double, c double, win double")
    fit = newton.fit_logistic(df, ["a", "b", "c"], "win")
    assert all(np.isfinite(fit.weights)) and abs(fit.weights[2]) < 1e-9 and fit.fills["b"] == 19.5
    with pytest.raises(ValueError):
        newton.fit_logistic(df.where("win = 1"), ["a"], "win")


def test_score_tests_find_the_missing_features(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(500, 5))
    y = (x[:, 0] + 2 * x[:, 3] - 0.7 * x[:, 1] + r.normal(size=500) > 0).astype(float)
    names = list("abcde")
    df = spark.createDataFrame([(*map(float, row), float(t)) for row, t in zip(x, y)], ", ".join(f"{n} double" for n in names) + ", win double").withColumn("copy", F.col("a"))
    fit = newton.fit_logistic(df, ["a"], "win")
    ranked = newton.score_tests(df, fit, [*names, "copy"], "win")
    assert [n for n, _ in ranked][:2] == ["d", "b"] and dict(ranked)["copy"] < 1.0 and "a" not in dict(ranked)
    steps = newton.stepwise(df.limit(400), df.subtract(df.limit(400)), ["a"], names, "win", refit=2)
    assert [s["features"] for s in steps][1:3] == [["a", "d"], ["a", "d", "b"]]
    assert all(b["log_loss"] < a["log_loss"] for a, b in zip(steps, steps[1:]))


def test_walk_forward_knows_only_earlier_folds(spark):
    r = random.Random(3)
    rows = [(i, i // 40, r.gauss(0, 1) + (i % 2), None if i % 11 == 0 else r.gauss(0, 2), 5.0, float(i % 2) if i % 13 else None) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, fold int, x double, y double, same double, win double")
    got = {q.id: q.p for q in newton.walk_forward_bayes(df, ["x", "y", "same"], "win", "fold", least=25).collect()}
    for i, fold, x, y, _, _ in rows:
        past = [q for q in rows if q[1] < fold and q[5] is not None]
        classes = [[q for q in past if q[5] == c] for c in (0, 1)]
        if min(map(len, classes)) < 25:
            assert got[i] is None
            continue
        odds = np.log(len(classes[1]) / len(classes[0]))
        for at, v in ((2, x), (3, y)):
            if v is not None:
                for sign, rows_of in ((-1, classes[0]), (1, classes[1])):
                    w = [q[at] for q in rows_of if q[at] is not None]
                    odds += sign * -0.5 * (np.log(np.var(w)) + (v - np.mean(w)) ** 2 / np.var(w))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-9)


def test_grid_over_time_scores_later_folds(rows):
    full = rows.withColumn("y", F.coalesce("y", F.lit(0.0)))
    ranked = learn.grid_over_time(full, ["x", "y"], ["day", "id"], splits=2, l2=(1.0, 1e6), balanced=(False, True))
    assert len(ranked) == 4 and ranked[0]["accuracy"] > 0.85 and [r["accuracy"] for r in ranked] == sorted((r["accuracy"] for r in ranked), reverse=True)
    folded = learn.time_folds(full, ["day", "id"], 2).toPandas()
    for r in ranked:
        got = []
        for i in (1, 2):
            past, now = folded[folded.fold < i], folded[folded.fold == i]
            s = np.where(past.win == 1, len(past) / (2 * past.win.sum()), len(past) / (2 * (1 - past.win).sum())) if r["balanced"] else np.ones(len(past))
            x = past[["x", "y"]].to_numpy()
            w = plain_logistic(x, past.win.to_numpy(), s, r["l2"])
            p = np.c_[np.ones(len(now)), (now[["x", "y"]].to_numpy() - x.mean(0)) / x.std(0)] @ w > 0
            got.append((p == (now.win.to_numpy() == 1)).mean())
        assert r["accuracy"] == pytest.approx(np.mean(got))


def test_training_on_a_share_of_variance(rows):
    full = rows.withColumns({"y": F.coalesce("y", F.lit(0.0)), "twin": F.col("x") * 2 + 1})
    model = learn.train(full, ["x", "twin", "y", "z"], "logistic", pre={"pca": 0.95})
    assert [s.getK() for s in model.stages if hasattr(s, "getK")] == [3]
    assert learn.score(model, full).where("(p > 0.5) = (win = 1)").count() > 200
