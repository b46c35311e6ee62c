"""Tree models of many rows, fitted on cells of binned features.

A tree sees no more of a row than the bins of its features. Rows that agree in all of them are a cell, and a cell's number of rows and mean
target give the same splits as the rows themselves: what varies within a cell is in every sum of squares alike. One aggregation turns the
table into cells; a hot cell is one row per task there.

Boosted trees are fitted on the cells, weighted by their rows: the residuals of a cell differ by a constant from their mean. A forest is
bagged row by row: every tree takes every row as often as a Poisson draw says, and the draws and drawn targets are summed per tree and cell.
Equal rows are counted first and drawn together. Spark's trees are then grown on these sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task draws for.
ROWS_PER_TASK = 2_000_000
#: Sums of trees and cells up to which cells are used, and the least number of rows per cell.
MOST_SUMS, LEAST_ROWS = 8_000_000, 8
#: Sums that one task reads.
SUMS_PER_TASK = 1_000_000
#: Trees grown at a time: they are many small jobs.
AT_ONCE = 8
#: A quantile is off by one part of a bin at most, unless this many passes do not part the values.
PARTS_PER_BIN, CUTS, MOST_PASSES = 8, 32, 12


def bin_name(feature: str) -> str:
    return f"_bin_{feature}"


def quantile_bounds(rows: DataFrame, feature: str, bins: int) -> list[float]:
    """Bounds between values that part the rows into about ``bins`` equal shares (at most twice as many), from counts alone: the same for any partitioning.

    Intervals that hold much of the rows are cut into equal parts and counted again, until each is small or a single value.
    """
    x = rows.select(F.col(f"`{feature}`").cast("double").alias("x")).where(F.abs("x") < float("inf"))
    edges: list[float] = []
    for _ in range(MOST_PASSES):
        cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="x", outputCol="part").transform(x) if edges else x.withColumn("part", F.lit(0.0))
        parts = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("part").collect()
        whole = sum(p["n"] for p in parts)
        large = [(p["low"], p["high"]) for p in parts if p["n"] * PARTS_PER_BIN * bins > whole and p["low"] < p["high"]]
        if not large:
            break
        inner = {low * (1 - k / CUTS) + high * (k / CUTS) for low, high in large for k in range(1, CUTS)}
        edges = sorted({*edges, *inner, *(high for _, high in large)})
    found, before = set(), 0
    for last, this in zip(parts, parts[1:]):
        share = before * bins // whole
        before += last["n"]
        if before * bins // whole > share or this["n"] * bins >= whole:  # a frequent value has a bin of its own
            found.add(_between(last["high"], this["low"]))
    return sorted(found)


def _between(a: float, b: float) -> float:
    """A number above ``a``, and not above ``b``."""
    middle = a / 2 + b / 2
    return middle if a < middle <= b else b


def bounds(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Inner bounds of each feature's bins: between neighbouring values if there are at most ``bins``, else at quantiles."""
    found = []
    near = rows.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"n{i}") for i, c in enumerate(features)]).first()
    for i, c in enumerate(features):
        if near[f"n{i}"] <= 2 * bins:
            values = sorted(r[0] for r in rows.select(F.col(f"`{c}`").cast("double")).dropna().distinct().limit(bins + 1).collect())
            if len(values) <= bins and all(map(math.isfinite, values)):
                found.append([_between(a, b) for a, b in zip(values, values[1:])])
                continue
        found.append(quantile_bounds(rows, c, bins))
    return found


def _draw(trees: int, seed: int, names: Sequence[str]):
    """For batches of (bins, target, times) in order of the bins: (bins, weights, totals), with one weight and total per tree."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if batch.empty:
                continue
            cells = batch[list(names)].to_numpy()
            starts = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)])
            drawn = rng.poisson(batch["_times"].to_numpy(np.float64)[:, None], (len(batch), trees)).astype(np.float64)
            out = batch.iloc[starts][list(names)].reset_index(drop=True)
            out["_weights"] = list(np.add.reduceat(drawn, starts, axis=0))
            drawn *= batch["_target"].to_numpy(np.float64)[:, None]
            out["_totals"] = list(np.add.reduceat(drawn, starts, axis=0))
            yield out

    return draw


def bags(binned: DataFrame, names: Sequence[str], trees: int, seed: int, tasks: int) -> DataFrame:
    """(tree, bins, _weight, _total): how many rows each tree takes from a cell, and the sum of their targets.

    Rows are dealt by a hash of their values and sorted, so that the draws depend on neither the source nor the cluster.
    """
    counted = binned.groupBy(*names, "_target").agg(F.count(F.lit(1)).alias("_times"))
    dealt = counted.repartition(tasks, *names, "_target").sortWithinPartitions(*names, "_target")
    schema = ", ".join([*[f"`{n}` double" for n in names], "_weights array<double>", "_totals array<double>"])
    drawn = dealt.mapInPandas(_draw(trees, seed, names), schema)
    each = drawn.select(*names, F.posexplode(F.arrays_zip("_weights", "_totals")).alias("tree", "_sums")).where("_sums._weights > 0")
    return each.groupBy("tree", *names).agg(F.sum("_sums._weights").alias("_weight"), F.sum("_sums._totals").alias("_total"))


def _forest(sums: DataFrame, assembler: VectorAssembler, learner: RandomForestRegressor, bins: int) -> RandomForestRegressionModel:
    """The learner's forest from the sums of its trees and cells."""
    vector, prediction = learner.getFeaturesCol(), learner.getPredictionCol()
    sums = assembler.transform(sums).select("tree", vector, (F.col("_total") / F.col("_weight")).alias("_label"), "_weight")
    one = DecisionTreeRegressor(
        featuresCol=vector, predictionCol=prediction, labelCol="_label", weightCol="_weight", maxDepth=learner.getMaxDepth(), maxBins=bins, seed=learner.getSeed()
    )

    def grown(tree: int):
        return one.fit(sums.where(F.col("tree") == tree))

    pool = ThreadPool(AT_ONCE)
    try:
        models = pool.map(inheritable_thread_target(sums.sparkSession)(grown), range(learner.getNumTrees()))
    finally:
        pool.close()
    # Spark offers no other way to a forest of trees that were fitted before.
    jvm, gateway = sums.sparkSession.sparkContext._jvm, sums.sparkSession.sparkContext._gateway
    array = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(models))
    for i, model in enumerate(models):
        array[i] = model._java_obj
    java = jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(array, len(assembler.getInputCols()))
    return learner._copyValues(learner._create_model(java))


def fit(rows: DataFrame, n: int, target: str, features: Sequence[str], learner: RandomForestRegressor | GBTRegressor) -> PipelineModel | None:
    """Fit a forest or boosted trees on the cells of ``n`` rows; None if there are too many cells for that to pay.

    The stages of the model are bins, vector and trees, and its inputs the plain features.
    """
    forest = isinstance(learner, RandomForestRegressor)
    bins, trees = learner.getMaxBins(), learner.getNumTrees() if forest else 1
    inf = float("inf")
    edges = [[-inf, *inner, inf] if inner else [-inf, 0.0, inf] for inner in bounds(rows, features, bins)]
    names = [bin_name(c) for c in features]
    bucketizer = Bucketizer(splitsArray=edges, inputCols=list(features), outputCols=names)
    # The sum leaves behind the mark of a category that a bin bears: trees take its number.
    binned = bucketizer.transform(rows).select(*[(F.col(f"`{b}`") + 0.0).alias(b) for b in names], F.col(f"`{target}`").alias("_target"))
    with ExitStack() as kept:

        def keep(df: DataFrame) -> DataFrame:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            kept.callback(df.unpersist)
            return df

        cells = keep(binned.groupBy(*names).agg(F.avg("_target").alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight")))
        size = cells.count()
        if size * trees > MOST_SUMS or size * LEAST_ROWS > n:
            return None
        assembler = VectorAssembler(inputCols=names, outputCol=learner.getFeaturesCol())
        # All bins are seen, not a sample of them, with this number of them.
        most = max(bins, math.isqrt(size) + 1, *[len(e) for e in edges])
        if forest:
            sums = bags(binned, names, trees, learner.getSeed(), max(1, math.ceil(n / ROWS_PER_TASK)))
            # Few partitions: each tree reads them once a level.
            model = _forest(keep(sums.repartition(math.ceil(size * trees / SUMS_PER_TASK))), assembler, learner, most)
        else:
            model = learner.copy({learner.labelCol: "_label", learner.weightCol: "_weight", learner.maxBins: most}).fit(assembler.transform(cells))
        return PipelineModel([bucketizer, assembler, model])
