"""Regression models on tables (ML-01 to ML-11, TOP-06).

Fitting, scoring and evaluation run on the executors; only model parameters and one row of
error figures per model reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.learning import binned
from gaugeframe.operators.aggregation import grouped
from gaugeframe.operators.cleaning import medians, numeric_columns
from gaugeframe.session import cut_lineage

PREDICTION = "prediction"
VECTOR = "_vector"
BUCKETS = 10_000
PARTITIONS = 16
#: Rows up to which trees are fitted on the rows themselves, and bytes of such rows per partition.
ROWS_AT_ONCE, PARTITION_BYTES = 1_000_000, 1 << 26


def feature_columns(df: DataFrame, target: str, features: Sequence[str] | None = None) -> list[str]:
    """The given features, or all numeric columns but the target."""
    return list(features) if features else [c for c in numeric_columns(df) if c != target]


def row_bucket(keys: Sequence[str], seed: int = 42) -> Column:
    """A bucket from the row's key: the same for any partitioning and after a lost executor."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(BUCKETS))


def modulus_bucket(keys: Sequence[str]) -> Column:
    """A bucket that plain SQL can compute as well, from integer keys."""
    total = F.lit(0)
    for k in keys:
        total = total + F.col(k)
    return F.pmod(total, F.lit(100)) * F.lit(BUCKETS // 100)


def with_test_flag(df: DataFrame, bucket: Column, fraction: float = 0.2) -> DataFrame:
    """Mark the given share of rows as test rows."""
    if not 0.05 <= fraction <= 0.5:
        raise ValueError("the test share lies between 0.05 and 0.5")
    return df.withColumn("is_test", bucket < F.lit(round(fraction * BUCKETS)))


def linear_fit(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least squares with one feature as plain aggregates, per key if keys are given."""
    return grouped(df, keys, F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def regressor(kind: str, trees: int = 100, depth: int = 8, rate: float = 0.1, bins: int = 64, seed: int = 42):
    """``linear``, ``forest`` or ``boosted``; forests look at all features in every split."""
    columns = {"featuresCol": VECTOR, "predictionCol": PREDICTION}
    if kind == "linear":
        return LinearRegression(**columns)
    if kind == "forest":
        return RandomForestRegressor(
            numTrees=trees, maxDepth=depth, maxBins=bins, seed=seed, featureSubsetStrategy="all", **columns
        )
    if kind == "boosted":
        return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed, **columns)
    raise ValueError(f"unknown model kind {kind!r}")


def _spread(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt by a hash of their values and sorted, so that a fit is the same for any source and cluster."""
    return rows.repartition(partitions, *rows.columns).sortWithinPartitions(*rows.columns)


def _partitions(n: int, trees: int, least: int) -> int:
    """Partitions for ``n`` rows: Spark keeps some 200 bytes of a row, and a number for each tree that draws rows."""
    return max(least, math.ceil(n * (200 + 4 * trees) / PARTITION_BYTES))


def fit(
    df: DataFrame, target: str, features: Sequence[str], kind: str, partitions: int = PARTITIONS, rows_at_once: int = ROWS_AT_ONCE, **params
) -> PipelineModel:
    """Fit on the rows with a known target; missing features have to be filled before.

    Tree models pass over their rows many times. Up to ``rows_at_once`` rows are spread over ``partitions`` and kept for the fit; more are
    aggregated to cells of binned features first. If that leaves too many cells, the rows themselves are spread, over
    as many partitions as their number needs. Bagging depends on the partitions: give the same number for the same model.
    """
    learner = regressor(kind, **params).setLabelCol(target)
    assembler = VectorAssembler(inputCols=list(features), outputCol=VECTOR)
    rows = df.select(*features, F.col(target).cast("double").alias(target)).dropna(subset=[target])
    pipeline = Pipeline(stages=[assembler, learner])
    if kind == "linear":
        return pipeline.fit(rows)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        if n > rows_at_once:
            model = binned.fit(rows, n, target, features, learner)
            if model is not None:
                return model
            partitions = _partitions(n, learner.getNumTrees() if kind == "forest" else 0, partitions)
        kept = _spread(rows, partitions).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return pipeline.fit(kept)
        finally:
            kept.unpersist()
    finally:
        rows.unpersist()


def inputs_of(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(df: DataFrame, model: PipelineModel, name: str = PREDICTION) -> DataFrame:
    out = model.transform(df).drop(VECTOR, *[binned.bin_name(c) for c in inputs_of(model)])
    return out if name == PREDICTION else out.withColumnRenamed(PREDICTION, name)


def fill_features(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in known.items()})


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Append ``prediction``; missing features take the median of the scored table.

    The input columns themselves stay as they were.
    """
    used = inputs_of(model)
    kept = {c: f"_in_{c}" for c in used}
    filled = fill_features(df.withColumns({k: F.col(c) for c, k in kept.items()}), medians(df, used))
    return predict(filled, model).withColumns({c: F.col(k) for c, k in kept.items()}).drop(*kept.values())


def error_figures(df: DataFrame, target: str, predictions: Mapping[str, str]) -> DataFrame:
    """(model, MAE, RMSE, R2) from one pass over the rows; names map to prediction columns."""
    y = F.col(target).cast("double")
    aggregates, cells = [F.var_pop(y).alias("spread")], []
    for i, (model, column) in enumerate(predictions.items()):
        error = y - F.col(f"`{column}`")
        aggregates += [F.avg(F.abs(error)).alias(f"mae{i}"), F.avg(error * error).alias(f"mse{i}")]
        cells.append(F.struct(
            F.lit(model).alias("model"),
            F.col(f"mae{i}").alias("MAE"),
            F.sqrt(f"mse{i}").alias("RMSE"),
            (F.lit(1.0) - F.try_divide(F.col(f"mse{i}"), F.col("spread"))).alias("R2"),
        ))
    return df.where(y.isNotNull()).agg(*aggregates).select(F.inline(F.array(*cells)))


@dataclass
class Comparison:
    models: dict[str, PipelineModel]
    scored: DataFrame
    figures: DataFrame
    skipped: list[str]


def compare_models(
    df: DataFrame,
    target: str,
    bucket: Column,
    features: Sequence[str] | None = None,
    fraction: float = 0.2,
    saved: Mapping[str, PipelineModel] | None = None,
    forest: Mapping[str, int] | None = None,
    medians_of_all_rows: bool = False,
) -> Comparison:
    """Fit the linear and forest baselines, add saved models, evaluate all on the same test rows.

    Saved models needing other columns are skipped. Medians come from the training rows, or
    from all rows if asked for. Figures are ordered by RMSE.
    """
    features = feature_columns(df, target, features)
    # Written once: the medians, every fit and the evaluation read the few columns they share.
    used = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target])]
    flagged = cut_lineage(with_test_flag(df, bucket, fraction).select(*used, "is_test"))
    train = flagged.where(~F.col("is_test"))
    filled = fill_features(flagged, medians(flagged if medians_of_all_rows else train, features))
    train, test = filled.where(~F.col("is_test")), filled.where("is_test")

    models = {
        "LinearRegression": fit(train, target, features, "linear"),
        "RandomForest": fit(train, target, features, "forest", **(forest or {})),
    }
    skipped = []
    for name, model in (saved or {}).items():
        if set(inputs_of(model)) <= set(features):
            models[name] = model
        else:
            skipped.append(name)

    scored, columns = test, {}
    for i, (name, model) in enumerate(models.items()):
        columns[name] = f"prediction_{i}"
        scored = predict(scored, model, columns[name])
    scored = cut_lineage(scored)  # each row is predicted once
    figures = error_figures(scored, target, columns).orderBy("RMSE", "model")
    return Comparison(models, scored, figures, skipped)


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance) of a tree model, highest first; empty for other models."""
    learner = model.stages[-1]
    weights = learner.featureImportances.toArray() if hasattr(learner, "featureImportances") else []
    rows = [(f, float(w)) for f, w in zip(inputs_of(model), weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, folder: str, name: str) -> None:
    """Write a model under its name to a folder all executors share."""
    model.write().overwrite().save(f"{folder}/{name}")


def saved_model_names(spark: SparkSession, folder: str, containing: Sequence[str] = ()) -> list[str]:
    """Names of the models in a folder, optionally only those containing one of the words."""
    files = spark.read.text(f"{folder}/*/metadata/part-*").select(F.col("_metadata.file_path").alias("path"))
    found = files.select(F.regexp_extract("path", r"([^/]+)/metadata/[^/]+$", 1).alias("name")).distinct()
    names = sorted(r["name"] for r in found.collect())  # one row per saved model
    return [n for n in names if not containing or any(w in n.lower() for w in containing)]


def load_model(folder: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{folder}/{name}")
