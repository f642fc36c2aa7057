"""Training, splitting, searching and scoring win models on tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from duelframe.operators.evaluate import log_loss_term
from duelframe.operators.history import model_features
from duelframe.operators.newton import LogisticFit, fit_logistic
from duelframe.operators.sequence import numbered
from duelframe.plans.quantiles import exact_quantiles_of
from duelframe.plans.sizing import cut


# ---------------------------------------------------------------- regression imputation

def linear_fit(df: DataFrame, features: Sequence[str], target: str) -> dict:
    """Least squares on complete rows: intercept, weights, mean squared error and R2.

    One feature is closed form in one aggregate; more go through the
    normal-equation solver, which also aggregates on the executors.
    """
    full = df.dropna(subset=[*features, target])
    if len(features) == 1:
        x, y = F.col(features[0]).cast("double"), F.col(target).cast("double")
        s = full.agg(
            F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"),
            F.regr_syy(y, x).alias("syy"), F.count(F.lit(1)).alias("n"),
        ).first()
        mse = None if not s.n else s.syy * (1 - s.r2) / s.n
        return {"intercept": s.a, "weights": [s.b], "mse": mse, "r2": s.r2, "features": list(features)}
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(full)
    model = LinearRegression(featuresCol="_x", labelCol=target, solver="normal", regParam=0.0).fit(vectors)
    return {
        "intercept": float(model.intercept), "weights": [float(w) for w in model.coefficients],
        "mse": model.summary.meanSquaredError, "r2": model.summary.r2, "features": list(features),
    }


def impute_linear(df: DataFrame, fit: Mapping, target: str, digits: int = 1) -> DataFrame:
    """Fill missing targets from the fit where every feature is known."""
    predicted = reduce(lambda a, b: a + b, [F.col(f) * w for f, w in zip(fit["features"], fit["weights"])], F.lit(fit["intercept"]))
    return df.withColumn(target, F.coalesce(F.col(target), F.bround(predicted, digits)))


# ---------------------------------------------------------------- imputation by column statistics

def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles_of(df, {c: [0.5] for c in columns}).items()}


def fill_with(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items() if v is not None})


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fill_with(df, df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict())


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(columns))


# ---------------------------------------------------------------- splits

def split_recent(df: DataFrame, ts: str, days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Train before and test within the last ``days`` before the newest row."""
    newest = df.agg(F.max(ts).alias("t")).first().t
    at = F.date_sub(F.lit(newest).cast("date"), days)
    return df.where(F.col(ts) < at), df.where(F.col(ts) >= at)


def split_at(df: DataFrame, ts: str, date: str) -> tuple[DataFrame, DataFrame]:
    at = F.lit(date).cast("date")
    return df.where(F.col(ts) < at), df.where(F.col(ts) >= at)


def split_random(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a digest of (seed, key), independent of partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    test = digest < F.lit(format(int(test_share * 16**8), "08x"))
    return df.where(~test), df.where(test)


def time_folds(df: DataFrame, order: Sequence[str], splits: int = 5, out: str = "fold", **kw) -> DataFrame:
    """Equal blocks 0 .. splits in time order: split i trains on blocks < i and tests on block i.

    The leading block takes the remainder, as in expanding-window splitting.
    """
    rows = df.count()
    test = rows // (splits + 1)
    lead = rows - test * splits
    seq = numbered(df, [], list(order), "_n", **kw)
    block = F.when(F.col("_n") <= lead, 0).otherwise(F.ceil((F.col("_n") - lead) / F.lit(max(test, 1))))
    return seq.withColumn(out, block.cast("int")).drop("_n")


# ---------------------------------------------------------------- pipelines

def preprocessing(features: Sequence[str], *, impute: str | None = "median", scale: str | None = "standard",
                  categories: Sequence[str] = (), pca: int | None = None, fills: Mapping[str, float] | None = None) -> list:
    """Imputer, assembler, scaler, one-hot and PCA stages; features known only after the match are refused.

    ``fills`` are values for missing inputs that the caller has worked out, such as exact medians of the training rows;
    without them Spark's imputer fits approximate ones.
    """
    features = model_features(features)
    stages, numeric = [], list(features)
    if impute:
        numeric = [f"{f}__f" for f in features]
        known = fills and [f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), NULL), {float(fills[f] or 0.0)!r}D) AS `{n}`" for f, n in zip(features, numeric)]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(known)} FROM __THIS__") if known else Imputer(strategy=impute, inputCols=list(features), outputCols=numeric, relativeError=0.001))
    stages.append(VectorAssembler(inputCols=numeric, outputCol="_raw", handleInvalid="keep"))
    last = "_raw"
    if scale:
        scaler = StandardScaler(withMean=True, inputCol="_raw", outputCol="_scaled") if scale == "standard" else RobustScaler(
            withCentering=True, inputCol="_raw", outputCol="_scaled")
        stages.append(scaler)
        last = "_scaled"
    if pca:
        stages.append(PCA(k=pca, inputCol=last, outputCol="_pca"))
        last = "_pca"
    parts = [last]
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v")]
        parts.append(f"_{c}_v")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def components_for(df: DataFrame, column: str, share: float = 0.95, most: int | None = None) -> int:
    """Smallest number of principal components explaining the share of variance, at most ``most`` and the number of inputs."""
    inputs = len(df.select(column).first()[0])
    k = min(inputs, most or inputs)
    total = 0.0
    for i, v in enumerate(PCA(k=k, inputCol=column, outputCol="_p").fit(df).explainedVariance.toArray(), 1):
        total += v
        if total >= share:
            return i
    return k


def classifier(kind: str, label: str = "win", *, rows: int | None = None, c: float = 1.0, layers: Sequence[int] = (8, 2),
               weight: str | None = None, seed: int = 42, **params):
    """Logistic regression, boosted trees, Gaussian naive Bayes or a small network."""
    common = dict(featuresCol="features", labelCol=label)
    if kind == "logistic":
        reg = 1.0 / (c * rows) if rows else 0.0
        extra = {"weightCol": weight} if weight else {}
        return LogisticRegression(**common, regParam=reg, elasticNetParam=0.0, maxIter=params.pop("maxIter", 100), **extra, **params)
    if kind == "boosted":
        return GBTClassifier(**common, seed=seed, **params)
    if kind == "bayes":
        return NaiveBayes(**common, modelType="gaussian", **params)
    if kind == "network":
        return MultilayerPerceptronClassifier(**common, layers=list(layers), seed=seed, **params)
    raise ValueError(kind)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * class size) per row."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return df.withColumn(out, F.when(F.col(label) == 1, n.n / (2.0 * max(n.p, 1))).otherwise(n.n / (2.0 * max(n.n - n.p, 1))))


def train(df: DataFrame, features: Sequence[str], kind: str = "logistic", label: str = "win", pre: dict | None = None, **params) -> PipelineModel:
    """Fit preprocessing and classifier; a ``pca`` below 1 is a share of variance, from which the number of components follows."""
    pre = dict(pre or {})
    if pre.get("impute", "median") == "median":
        pre.setdefault("fills", medians(df, model_features(features)))
    if isinstance(pre.get("pca"), float):
        pre["pca"] = components_for(Pipeline(stages=preprocessing(features, **pre | {"pca": None})).fit(df).transform(df), "features", pre["pca"])
    return Pipeline(stages=[*preprocessing(features, **pre), classifier(kind, label, **params)]).fit(df)


def score(model: PipelineModel | LogisticFit, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the win probability; helper columns of the pipeline are dropped."""
    if isinstance(model, LogisticFit):
        return df.withColumn(out, model.probability())
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def grid_search(df: DataFrame, features: Sequence[str], label: str, grid: Mapping[str, Sequence], kind: str = "logistic",
                folds: int = 3, parallelism: int = 4, **params):
    stages = preprocessing(features)
    est = classifier(kind, label, **params)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    cv = CrossValidator(
        estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=builder.build(), numFolds=folds, parallelism=parallelism,
        evaluator=BinaryClassificationEvaluator(labelCol=label), seed=42,
    )
    return cv.fit(df)


def expanding_scores(df: DataFrame, features: Sequence[str], order: Sequence[str], label: str = "win", splits: int = 5,
                     kind: str = "logistic", **params) -> list[dict]:
    """Accuracy and log loss of every expanding-window split."""
    folded = cut(time_folds(df, order, splits))
    results = []
    for i in range(1, splits + 1):
        model = train(folded.where(F.col("fold") < i), features, kind, label, **params)
        results.append({"fold": i, **_quick(score(model, folded.where(F.col("fold") == i)), label)})
    return results


def grid_over_time(df: DataFrame, features: Sequence[str], order: Sequence[str], label: str = "win", splits: int = 3,
                   l2: Sequence[float] = (0.1, 1.0, 10.0), balanced: Sequence[bool] = (False, True)) -> list[dict]:
    """Ridge and class weights of the logistic fit by mean accuracy over expanding time folds, best first.

    A fold is scored by fits of the folds before it only. Ties: the stronger ridge, then equal weights.
    """
    folded = cut(time_folds(df, order, splits))
    results = []
    for strength in l2:
        for even in balanced:
            got = []
            for i in range(1, splits + 1):
                fit = fit_logistic(folded.where(F.col("fold") < i), features, label, l2=strength, balanced=even)
                got.append(_quick(score(fit, folded.where(F.col("fold") == i)), label)["accuracy"])
            results.append({"l2": strength, "balanced": even, "accuracy": sum(got) / len(got)})
    return sorted(results, key=lambda r: (-r["accuracy"], -r["l2"], r["balanced"]))


def _quick(df: DataFrame, label: str) -> dict:
    hit = ((F.col("p") > 0.5).cast("int") == F.col(label).cast("int")).cast("double")
    s = df.agg(F.avg(hit).alias("accuracy"), F.avg(log_loss_term(label, "p")).alias("log_loss"), F.count(F.lit(1)).alias("n")).first()
    return s.asDict()


# ---------------------------------------------------------------- ensembles

def soft_vote(predictions: Mapping[str, DataFrame], key: Sequence[str], p: str = "p") -> DataFrame:
    """Mean probability of several models per row, and the vote at 0.5."""
    long = _stack(predictions, key, p)
    out = long.groupBy(*key).agg(F.avg(p).alias(p))
    return out.withColumn("vote", (F.col(p) > 0.5).cast("int"))


def hard_vote(predictions: Mapping[str, DataFrame], key: Sequence[str], p: str = "p") -> DataFrame:
    """Majority of the single votes; an even split counts as a loss."""
    long = _stack(predictions, key, p)
    return long.groupBy(*key).agg((F.avg((F.col(p) > 0.5).cast("int")) > 0.5).cast("int").alias("vote"))


def _stack(predictions, key, p):
    return reduce(lambda a, b: a.unionByName(b), [d.select(*key, p, F.lit(n).alias("model")) for n, d in predictions.items()])


# ---------------------------------------------------------------- feature search

def add_one_search(base: Sequence[str], candidates: Sequence[str], evaluate: Callable[[list[str]], dict], rank: str = "log_loss",
                   descending: bool = False, threads: int = 4) -> list[dict]:
    """Score base + one candidate for every candidate, best first.

    Each evaluation is a distributed fit; a few run side by side on the driver.
    """
    def one(c):
        return {"feature_added": c, **evaluate([*base, c])}

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, [c for c in candidates if c not in base]))
    return sorted(rows, key=lambda r: (r[rank] is None, -r[rank] if descending else r[rank], r["feature_added"]))


def log_loss_evaluator(train_df: DataFrame, test_df: DataFrame, label: str = "win", kind: str = "logistic", **params):
    def evaluate(features: list[str]) -> dict:
        return _quick(score(train(train_df, features, kind, label, **params), test_df), label)

    return evaluate


def roi_evaluator(train_df: DataFrame, test_df: DataFrame, match: Sequence[str], keys: Sequence[str], books: Sequence[str],
                  order: Sequence[str], label: str = "win", volatility_weight: float = 1.0, **params):
    """Return minus weighted volatility of the model's picks."""
    from duelframe.operators.market import consistent_odds, cumulative_roi, roi_picks, roi_volatility

    def evaluate(features: list[str]) -> dict:
        scored = score(train(train_df, features, label=label, **params), test_df)
        model = consistent_odds(scored.select(*keys, "p"), match, "p")
        picks = roi_picks(model, test_df.select(*keys, label, *books), keys=keys, match=match, books=books, win=label, side=keys[-1])
        s = roi_volatility(cumulative_roi(picks, order), order).first()
        final = s.final_roi or 0.0
        return {"final_roi": final, "roi_volatility": s.volatility, "score": final - volatility_weight * s.volatility}

    return evaluate


def forward_selection(candidates: Sequence[str], evaluate: Callable[[list[str]], dict], *, rank: str = "log_loss",
                      batch: int = 1, most: int | None = None, min_gain: float = 0.0, start: Sequence[str] = (), descending: bool = False) -> list[dict]:
    """Greedy selection, ``batch`` best candidates per step, until nothing improves by ``min_gain``.

    ``rank`` is minimised, or maximised with ``descending``; ``most`` limits the number of features, by default nothing does.
    """
    chosen, history, best = list(start), [], float("-inf" if descending else "inf")
    most = most or len(set(candidates) | set(start))
    while len(chosen) < most:
        ranked = add_one_search(chosen, [c for c in candidates if c not in chosen], evaluate, rank, descending)
        if not ranked:
            break
        step = [r["feature_added"] for r in ranked[: min(batch, most - len(chosen))]]
        value = ranked[0][rank] if len(step) == 1 else evaluate([*chosen, *step])[rank]
        if value is None or (value - best if descending else best - value) <= min_gain:
            break
        chosen, best = [*chosen, *step], value
        history.append({"features": list(chosen), rank: value})
    return history


def ranked_weights(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Coefficients or importances, strongest first."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(features, map(float, values.toArray())), key=lambda t: (-abs(t[1]), t[0]))


def key_factors(df: DataFrame, weights: Sequence[tuple[str, float]], key: Sequence[str], n: int = 5) -> DataFrame:
    """Per row the n features contributing most to the score (weight times value)."""
    items = F.array(*[F.struct(F.abs(F.col(f) * w).alias("size"), F.lit(f).alias("feature"), (F.col(f) * w).alias("contribution")) for f, w in weights])
    top = F.slice(F.reverse(F.array_sort(F.filter(items, lambda x: x["size"].isNotNull()))), 1, n)
    return df.select(*key, F.posexplode(top).alias("place", "_f")).select(*key, (F.col("place") + 1).alias("place"), "_f.feature", "_f.contribution")


# ---------------------------------------------------------------- matchups

def matchup_vector(df: DataFrame, stats: Mapping[str, float], *, pre: str = "precomp_", post: str = "postcomp_", prefix: str = "opp_") -> DataFrame:
    """Features of an announced match from each side's latest snapshot: post value, else pre value, else the default."""
    def value(side, stat, default):
        named = [F.col(side + p + stat).cast("double") for p in (post, pre) if side + p + stat in df.columns]
        return F.coalesce(*named, F.lit(float(default))) if named else F.lit(float(default))

    return df.withColumns({f"{side}x_{s}": value(side, s, d) for s, d in stats.items() for side in ("", prefix)})


def differences(df: DataFrame, stats: Sequence[str], prefix: str = "opp_") -> DataFrame:
    return df.withColumns({f"diff_{s}": F.col(s) - F.col(prefix + s) for s in stats})


def score_matchups(model: PipelineModel, matchups: DataFrame, mirrored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bulk scoring in both orientations, averaged and normalised; a request made twice gets two equal rows."""
    from duelframe.functions.numbers import symmetric_probability

    here = score(model, matchups)
    there = score(model, mirrored).groupBy(*key).agg(F.max("p").alias("_q"))
    return here.join(there, list(key)).withColumn("p", symmetric_probability("p", "_q")).drop("_q")


# ---------------------------------------------------------------- learned strengths

def strengths(matches: DataFrame, a: str = "a", b: str = "b", score: str = "score", iterations: int | None = None,
              checkpoint_every: int = 5, prior: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Paired-comparison strengths (Bradley-Terry) by minorise-maximise steps.

    Matches are first summed per pair of entities. A step is one join of pairs
    and strengths and one sum per entity, so neither the entities nor their
    strengths ever sit on the driver. ``prior`` virtual wins and losses against a
    strength of 1 keep undefeated entities finite. Result: log strength.

    Without ``iterations`` the steps go on until no log strength moves by more than ``tolerance``, asked at every checkpoint.
    """
    oriented = matches.where(F.col(score).isNotNull()).select(F.explode(F.array(
        F.struct(F.col(a).alias("entity"), F.col(b).alias("other"), F.col(score).cast("double").alias("won")),
        F.struct(F.col(b).alias("entity"), F.col(a).alias("other"), (1 - F.col(score)).cast("double").alias("won")),
    )).alias("_m")).select("_m.*")
    pairs = cut(oriented.groupBy("entity", "other").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("n")))
    wins = pairs.groupBy("entity").agg((F.sum("wins") + prior).alias("wins"))
    current = wins.select("entity", F.lit(1.0).alias("g"))
    i, settled = 0, False
    while not settled and i != iterations:
        other = current.select(F.col("entity").alias("other"), F.col("g").alias("g_other"))
        load = (
            pairs.join(current, "entity").join(other, "other")
            .groupBy("entity").agg(F.sum(F.col("n") / (F.col("g") + F.col("g_other"))).alias("load"), F.max("g").alias("_g"))
        )
        current = wins.join(load, "entity").select(
            "entity", (F.col("wins") / (F.col("load") + 2 * prior / (F.col("_g") + 1))).alias("g"), "_g"
        )
        i += 1
        if i % checkpoint_every == 0:
            current = cut(current.withColumn("_moved", F.abs(F.ln("g") - F.ln("_g")))) if iterations is None else cut(current)
            settled = iterations is None and (current.agg(F.max("_moved")).first()[0] or 0.0) <= tolerance
        current = current.select("entity", "g")
    return current.select("entity", F.ln("g").alias("strength"))


def threshold(df: DataFrame, p: Column | str, at: float = 0.5, out: str = "predicted") -> DataFrame:
    c = F.col(p) if isinstance(p, str) else p
    return df.withColumn(out, (c > at).cast("int"))
