"""Fits that need the rows themselves, model ranking, persistence and batch scoring."""

from __future__ import annotations

import dataclasses
import datetime
import json
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackish.functions.energy import clip
from brackish.operators import evaluate, linear, series, trees
from brackish.operators.blocks import day_slot
from brackish.operators.evaluate import Scheme
from brackish.operators.neighbours import PIECE, nearest, nearest_of_points
from brackish.operators.trees import Folds
from brackish.session import part_of_job, settle

Predictor = Callable[[DataFrame], DataFrame]
Fitter = Callable[[DataFrame, Sequence[str], str], Predictor]
Model = linear.LinearModel | trees.TreeModel

FAMILIES = {
    "ols": "linear",
    "ridge": "linear",
    "elastic": "linear",
    "pls": "linear",
    "huber": "linear",
    "knn": "instance",
    "extra": "tree ensemble",
    "forest": "tree ensemble",
    "boosted": "tree ensemble",
}


def ml_fitter(estimator, weight: str | None = None) -> Fitter:
    """A Spark ML regressor as a fitter on plain columns."""

    def fit(train: DataFrame, features: Sequence[str], target: str) -> Predictor:
        stage = estimator.copy().setFeaturesCol("_x").setLabelCol(target).setPredictionCol("pred")
        if weight:
            stage = stage.setWeightCol(weight)
        model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), stage]).fit(train)

        def predict(df: DataFrame) -> DataFrame:
            return model.transform(df).drop("_x")

        predict.model = model
        return predict

    return fit


def forest(trees: int = 100, depth: int = 12, seed: int = 0, subset: str = "0.5", weight: str | None = None) -> Fitter:
    """Random forest of Spark ML, one fit a fold; `trees.forest` grows those of all folds together."""
    return ml_fitter(
        RandomForestRegressor(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy=subset, seed=seed
        ),
        weight,
    )


def boosted(rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 0) -> Fitter:
    return ml_fitter(GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed))


def huber(epsilon: float = 1.35) -> Fitter:
    return ml_fitter(LinearRegression(loss="huber", epsilon=epsilon, standardization=True))


def knn(k: int = 10, weights: str = "distance", block_rows: int = PIECE) -> Fitter:
    """Exact nearest neighbours on features standardised over the training rows (`neighbours.nearest`).

    Cells of more than `block_rows` training rows are read in pieces.
    """

    def fit(train: DataFrame, features: Sequence[str], target: str) -> Predictor:
        features = list(features)
        rows = train.dropna(subset=[*features, target])
        scaled = _scaled(rows, features)
        known = rows.select(*scaled, F.col(target).cast("double").alias("_y"), F.lit(0).alias("_scope"), F.lit(0).alias("_fold"))

        def predict(df: DataFrame) -> DataFrame:
            numbered = settle(df.dropna(subset=features).withColumn("_row", F.monotonically_increasing_id()))
            near = nearest(known, numbered.select("_row", *scaled, F.lit(0).alias("_scope"), F.lit(1).alias("_fold")), features, k, piece=block_rows)
            return numbered.join(near, "_row").select(*df.columns, _neighbour_mean(weights).alias("pred"))

        return predict

    return fit


def _scaled(rows: DataFrame, features: Sequence[str]) -> list[Column]:
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return [((F.col(f).cast("double") - F.lit(stats[f"m_{f}"])) / F.lit(stats[f"s_{f}"] or 1.0)).alias(f) for f in features]


def cross_validate_knn(df: DataFrame, features: Sequence[str], target: str, schemes: Sequence[Scheme], k: int = 10, weights: str = "distance", name: str = "knn") -> DataFrame:
    """Held-out predictions of nearest neighbours under every scheme, one search a scheme.

    Features are standardised once, over all rows, so that the folds of a scheme share their cells; only the
    rows that train a fold are neighbours of its rows. Searches come one after the other, and what one settles but its
    predictions is removed before the next, so that disk holds the tables of one.
    """
    rows = df.dropna(subset=[*features, target])
    folds = Folds(rows, schemes)
    scaled = _scaled(rows, features)
    points = [f"_x{i}" for i in range(len(scaled))]
    rows = settle(folds.number(rows).withColumns(dict(zip(points, scaled))), compression="zstd")
    fits = F.array(*[F.lit(bool(x)) for x in folds.fits])
    scopes = F.array(*[F.lit(int(x)) for _, x in folds.scope])
    out = []
    for s, scheme in enumerate(schemes):
        own = rows.withColumn("_fold", F.col("_folds")[s].cast("int"))
        with part_of_job(df.sparkSession) as kept:
            keyed = own.select("_fold", *points, F.col(target).cast("double").alias("_y"), F.get(scopes, "_fold").alias("_scope"), F.get(fits, "_fold").alias("_fits"))
            near = nearest_of_points(keyed, keyed.where("_fits"), points, k, outcome=_neighbour_mean(weights))
            pred = kept(near.select("_fold", *points, F.col("_out").alias("pred")))
        out.append(own.join(pred, ["_fold", *points]).select(*df.columns, "pred").withColumns({"model": F.lit(name), "scheme": F.lit(scheme.name)}))
    return reduce(DataFrame.unionByName, out)


def _neighbour_mean(weights: str) -> Column:
    """Weighted mean of the neighbours; with distance weights an exact hit outweighs everything."""
    near = F.col("_near")

    def total(value) -> Column:
        return F.aggregate(near, F.lit(0.0), lambda acc, z: acc + value(z))

    plain = total(lambda z: z["y"]) / F.size(near)
    if weights == "uniform":
        return plain
    hits = total(lambda z: F.when(z["d"] == 0, 1.0).otherwise(0.0))
    hit_mean = total(lambda z: F.when(z["d"] == 0, z["y"]).otherwise(0.0)) / F.nullif(hits, F.lit(0.0))
    inverse = total(lambda z: F.try_divide(z["y"], z["d"])) / total(lambda z: F.try_divide(F.lit(1.0), z["d"]))
    return F.when(hits > 0, hit_mean).otherwise(inverse)


def cross_validate_rows(
    df: DataFrame, features: Sequence[str], target: str, scheme: Scheme, fit: Fitter, name: str
) -> DataFrame:
    """Held-out predictions of a model that must be refitted on the rows of every fold.

    One fit per fold is what such a model costs; each fit is a distributed
    job over the table, which is written once. Linear models do not come
    here: `linear.cross_validate` fits all their folds together.
    """
    rows = settle(df.dropna(subset=[*features, target]))
    own = rows.groupBy(*scheme.fold).agg(F.count(F.lit(1)).alias("n")).collect()
    totals: dict[tuple, int] = {}
    for f in own:
        scope = tuple(f[c] for c in scheme.scope)
        totals[scope] = totals.get(scope, 0) + f["n"]
    parts = []
    for f in sorted(own, key=lambda r: tuple(str(r[c]) for c in scheme.fold)):
        n_train = totals[tuple(f[c] for c in scheme.scope)] - f["n"]
        if f["n"] < scheme.min_test or n_train < max(scheme.min_train, 1):
            continue
        held = reduce(lambda a, b: a & b, [F.col(c) == F.lit(f[c]) for c in scheme.fold])
        scope = reduce(lambda a, b: a & b, [F.col(c) == F.lit(f[c]) for c in scheme.scope], F.lit(True))
        parts.append(fit(rows.where(scope & ~held), features, target)(rows.where(held)))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("model", F.lit(name)).withColumn("scheme", F.lit(scheme.name))


def fold_mean(df: DataFrame, value: str, scheme: Scheme, name: str) -> DataFrame:
    """Each row with the mean of `value` over its training rows, from one aggregation."""
    own = df.where(F.col(value).isNotNull()).groupBy(*scheme.fold).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s")
    )
    own = own.withColumn("_all", F.lit(1))
    total = own.groupBy("_all", *scheme.scope).agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    means = own.join(total, ["_all", *scheme.scope])
    means = means.where(
        (F.col("_n") >= scheme.min_test) & (F.col("_tn") - F.col("_n") >= max(scheme.min_train, 1))
    ).select(*scheme.fold, ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias(name))
    return df.join(settle(means), list(scheme.fold))


def priestley_taylor(df: DataFrame, scheme: Scheme, alpha: float | None = None) -> DataFrame:
    """Physics baseline: a coefficient (fixed, or the training mean of `alpha`) times `ET_eq`."""
    if alpha is not None:
        return df.withColumn("pred", F.col("ET_eq") * alpha)
    return fold_mean(df, "alpha", scheme, "_a").withColumn("pred", F.col("_a") * F.col("ET_eq")).drop("_a")


def cross_validate(df: DataFrame, features: Sequence[str], target: str, schemes: Sequence[Scheme], models: Sequence[Model]) -> DataFrame:
    """Held-out predictions of linear models and trees under every scheme: the columns of `df`, `model`, `scheme` and `pred`."""
    lines = [m for m in models if isinstance(m, linear.LinearModel)]
    ensembles = [m for m in models if isinstance(m, trees.TreeModel)]
    parts = [linear.cross_validate(df, features, target, s, lines) for s in schemes] if lines else []
    if ensembles:
        parts.append(trees.cross_validate(df, features, target, schemes, ensembles))
    kept = [*df.columns, "model", "scheme", "pred"]
    return reduce(DataFrame.unionByName, [p.select(*kept) for p in parts])


def cross_validate_ratio(
    df: DataFrame,
    features: Sequence[str],
    ratio: str,
    energy: str,
    scheme: Scheme,
    models: Sequence[Model],
    hi: float = 1.2,
) -> DataFrame:
    """Learn a ratio, score ET: held-out ratios are clipped and multiplied by their energy term."""
    oof = cross_validate(df, features, ratio, [scheme], models)
    return oof.withColumn("pred", evaluate.et_from_fraction(F.col("pred"), F.col(energy), hi))


def cross_validate_kc(
    df: DataFrame,
    features: Sequence[str],
    et: str,
    eto: str,
    scheme: Scheme,
    models: Sequence[Model],
    floor: float = 0.3,
) -> DataFrame:
    """Learn the crop coefficient, score ET."""
    rows = df.withColumn("_kc", F.col(et) / clip(F.col(eto), floor))
    oof = cross_validate(rows, features, "_kc", [scheme], models)
    return oof.withColumn("pred", evaluate.et_from_crop_coefficient(F.col("pred"), F.col(eto), floor)).drop("_kc")


def ridge_search(
    df: DataFrame, features: Sequence[str], target: str, scheme: Scheme, alphas: Sequence[float]
) -> DataFrame:
    """Pooled held-out scores of every penalty, best first; all of them from the same two passes."""
    models = [linear.LinearModel(f"{a:g}", tuple(features), "ridge", a) for a in alphas]
    oof = linear.cross_validate(df, features, target, scheme, models)
    scored = evaluate.metrics(oof, ["model"], y=target).withColumn("alpha", F.col("model").cast("double"))
    return scored.drop("model").orderBy(F.desc("r2"), "alpha")


def grid_search(
    df: DataFrame, features: Sequence[str], target: str, scheme: Scheme, fitters: dict[str, Fitter]
) -> DataFrame:
    """Pooled held-out scores of row-based settings, best first."""
    scored = [
        evaluate.metrics(cross_validate_rows(df, features, target, scheme, fit, name), ["model"], y=target)
        for name, fit in fitters.items()
    ]
    return reduce(DataFrame.unionByName, scored).orderBy(F.desc("r2"), "model")


def score_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    schemes: Sequence[Scheme],
    linear_models: Sequence[linear.LinearModel],
    fitters: dict[str, tuple[str, Fitter]],
) -> DataFrame:
    """Scores of all models under all schemes with their family. A model that fails leaves its reason.

    `fitters` maps a model name to (kind, fitter).
    """
    out = []
    labels = {m.name: FAMILIES[m.kind] for m in linear_models} | {n: FAMILIES[k] for n, (k, _) in fitters.items()}
    spark = df.sparkSession
    for scheme in schemes:
        if linear_models:
            oof = linear.cross_validate(df, features, target, scheme, linear_models)
            out.append(evaluate.metrics(oof, ["model", "scheme"], y=target).withColumn("error", F.lit(None).cast("string")))
        for name, (_, fit) in fitters.items():
            try:
                oof = cross_validate_rows(df, features, target, scheme, fit, name)
                scored = evaluate.metrics(oof, ["model", "scheme"], y=target).withColumn(
                    "error", F.lit(None).cast("string")
                )
                out.append(settle(scored))
            except Exception as failure:  # one model must not take the table with it
                out.append(
                    spark.createDataFrame(
                        [(name, scheme.name, f"{type(failure).__name__}: {failure}"[:500])],
                        "model string, scheme string, error string",
                    )
                )
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
    family = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return table.withColumn("family", family[F.col("model")])


def rank_models(scores: DataFrame, scheme: str = "leave_site") -> DataFrame:
    """One row per model with its R2 under each scheme, best under `scheme` first."""
    wide = scores.groupBy("model", "family").pivot("scheme", ["kfold", "leave_year", "leave_site"]).agg(
        F.first("r2").alias("r2")
    )
    return wide.orderBy(F.desc_nulls_last(scheme), "model")


def selection_table(
    df: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    target: str,
    schemes: Sequence[Scheme],
    linear_models: Sequence[linear.LinearModel] = (),
    tree_models: Sequence[trees.TreeModel] = (),
    neighbours: Sequence[int] = (),
) -> DataFrame:
    """R2, RMSE, MAE and bias of every model on every feature set under every scheme; settled.

    Linear models share two passes a scheme, all trees of all folds grow together, neighbours take one search a
    scheme: the number of jobs does not follow the number of folds. All sets are scored on the same rows.
    """
    every = list(dict.fromkeys(f for s in feature_sets.values() for f in s))
    rows = settle(df.dropna(subset=[*every, target]))
    family = {m.name: FAMILIES[m.kind] for m in linear_models} | {m.name: FAMILIES[m.kind] for m in tree_models} | {f"knn{k}": FAMILIES["knn"] for k in neighbours}
    out = []
    for label, features in feature_sets.items():
        parts = []
        if linear_models:
            own = [dataclasses.replace(m, features=tuple(features)) for m in linear_models]
            parts += [linear.cross_validate(rows, features, target, scheme, own) for scheme in schemes]
        if tree_models:
            parts.append(trees.cross_validate(rows, features, target, schemes, tree_models))
        parts += [cross_validate_knn(rows, features, target, schemes, k, name=f"knn{k}") for k in neighbours]
        for oof in parts:
            scored = evaluate.metrics(oof, ["model", "scheme"], y=target)
            out.append(scored.withColumns({"feature_set": F.lit(label), "n_features": F.lit(len(features))}))
    named = F.create_map(*[F.lit(x) for pair in family.items() for x in pair])
    return settle(reduce(DataFrame.unionByName, out).withColumn("family", named[F.col("model")]))


def rank_selection(scores: DataFrame, schemes: Sequence[str], headline: str = "leave_site") -> DataFrame:
    """One row per model and feature set: R2 and MAE under every scheme, best R2 under `headline` first within a set."""
    wide = scores.groupBy("feature_set", "n_features", "model", "family").pivot("scheme", list(schemes)).agg(F.first("r2").alias("r2"), F.first("mae").alias("mae"))
    place = Window.partitionBy("feature_set").orderBy(F.desc_nulls_last(f"{headline}_r2"), "model")
    return wide.withColumn("place", F.row_number().over(place))


def refit(df: DataFrame, features: Sequence[str], target: str, model: linear.LinearModel | trees.TreeModel | int) -> tuple[Predictor, dict]:
    """A model fitted on all rows, as a predictor and as plain numbers that `restore` reads."""
    features = list(features)
    rows = df.dropna(subset=[*features, target])
    if isinstance(model, trees.TreeModel):
        state = trees.fit(rows, features, target, model)
        record = {
            "kind": "trees",
            "model": dataclasses.asdict(model),
            "feature": state.feature[0].tolist(),
            "cut": state.cut[0].tolist(),
            "value": state.value[0].tolist(),
        }
    elif isinstance(model, linear.LinearModel):
        own = dataclasses.replace(model, features=tuple(features))
        fits, _ = linear.fit_by_key(rows, features, target, [], [own])
        row = fits.first()
        record = {"kind": "linear", "beta": list(row["beta"]), "intercept": row["intercept"]}
    else:
        return knn(model)(rows, features, target), {"kind": "knn", "k": model}
    return restore(record, features), record


def restore(record: dict, features: Sequence[str]) -> Predictor:
    """The predictor of a record that `refit` made; neighbours have none, they are their rows."""
    features = list(features)
    if record["kind"] == "linear":
        total = F.lit(record["intercept"])
        for b, f in zip(record["beta"], features):
            total = total + F.lit(b) * F.col(f)
        return lambda df: df.dropna(subset=features).withColumn("pred", total)
    model = trees.TreeModel(**record["model"])
    arrays = [np.array(record[c])[None] for c in ("feature", "cut", "value")]
    state = trees.Trees(model, tuple(features), [], *arrays, np.zeros((1, len(features))))
    return lambda df: trees.predict(df.dropna(subset=features), [("pred", state, 0)], features)


def select_model(
    df: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    target: str,
    schemes: Sequence[Scheme],
    linear_models: Sequence[linear.LinearModel],
    tree_models: Sequence[trees.TreeModel],
    neighbours: Sequence[int] = (),
    path: str | None = None,
    headline: str = "leave_site",
    group: str = "site",
) -> tuple[DataFrame, dict, Predictor]:
    """The whole selection: (ranking, metadata of the winner, predictor fitted on all rows).

    The winner is best under `headline` on the last feature set. With a `path`, the fitted numbers and the metadata
    (model, features, rows, groups, scores) are saved there as JSON lines; `load_selection` reads them.
    """
    names = [s.name for s in schemes]
    ranking = settle(rank_selection(selection_table(df, feature_sets, target, schemes, linear_models, tree_models, neighbours), names, headline))
    label, features = list(feature_sets.items())[-1]
    best = ranking.where((F.col("feature_set") == label) & (F.col("place") == 1)).first()
    models = {m.name: m for m in [*linear_models, *tree_models]} | {f"knn{k}": k for k in neighbours}
    complete = df.dropna(subset=[*dict.fromkeys(f for s in feature_sets.values() for f in s), target])
    predict, record = refit(complete, features, target, models[best["model"]])
    counts = complete.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups")).first()
    meta = {"model": best["model"], "features": list(features), "n_train": counts["n"], f"n_{group}": counts["groups"]}
    meta |= {f"{n}_{m}": best[f"{n}_{m}"] for n in names for m in ("r2", "mae")}
    if path:
        lines = [(json.dumps({"meta": meta}),), (json.dumps({"record": record}),)]
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
    return ranking, meta, predict


def load_selection(spark: SparkSession, path: str) -> tuple[dict, Predictor]:
    """Metadata and predictor of a saved selection."""
    found: dict = {}
    for row in spark.read.text(path, wholetext=False).collect():
        found |= json.loads(row["value"])
    return found["meta"], restore(found["record"], found["meta"]["features"])


def save_model(predict: Predictor, path: str, meta: dict) -> None:
    """A fitted Spark ML pipeline with its metadata (features, scores, row counts) as JSON beside it."""
    model: PipelineModel = predict.model
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    record = meta | {"saved": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")}
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/meta")


def load_model(spark: SparkSession, path: str, fallback: Callable[[], tuple[Predictor, dict]]) -> tuple[Predictor, dict]:
    """The saved model and its metadata, or whatever `fallback` trains when nothing is saved."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return fallback()
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])

    def predict(df: DataFrame) -> DataFrame:
        return model.transform(df).drop("_x")

    predict.model = model
    return predict, meta


def score_pixels(
    pixels: DataFrame, met: DataFrame, keys: Sequence[str], features: Sequence[str], predict: Predictor
) -> DataFrame:
    """Predict every pixel whose own features and scene meteorology are complete."""
    rows = pixels.join(met, list(keys)).dropna(subset=list(features))
    return predict(rows)


def gapfill_model(
    et: DataFrame,
    drivers: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    col: str = "ET",
    date: str = "date",
    limit: int = 30,
    model: linear.LinearModel | None = None,
) -> DataFrame:
    """A continuous series per site: measured where there is a measurement, modelled elsewhere.

    The model of a site is fitted on its measured days only. Drivers are
    interpolated over short gaps for prediction, never for fitting.
    """
    model = model or linear.LinearModel("fill", tuple(features), "ridge", 1.0)
    joined = settle(et.select(*keys, date, col).join(drivers.select(*keys, date, *features), [*keys, date], "full"))
    measured = joined.where(F.col(col).isNotNull())
    fits, grams = linear.fit_by_key(measured, features, col, keys, [model])
    slotted = joined.withColumn("_slot", day_slot(date)).drop(date)
    filled = series.fill_dense(slotted, keys, "_slot", features, limit)
    ready = filled.select(
        *keys,
        F.date_from_unix_date(F.col("_slot").cast("int")).alias(date),
        col,
        *[F.col(f"{f}_int").alias(f) for f in features],
    )
    return linear.apply_fits(ready, fits, grams, keys, "left").select(
        *keys,
        date,
        F.col(col).alias(f"{col}_measured"),
        F.col("pred").alias(f"{col}_predicted"),
        F.coalesce(F.col(col), F.col("pred")).alias(f"{col}_final"),
        (F.col(col).isNull() & F.col("pred").isNotNull()).alias("is_filled"),
    )
