"""Tree price curves of all products at once (PO-01, PO-02).

A regression tree on one feature needs nothing but the number of rows and the sum of profits per price bin. One aggregation turns the table
into these sums, per product and tree; a product with a third of all rows is a few dozen rows per task there. All trees of all products
are then grown together, level by level: each level finds the best split of every node by running sums over its bins. The bins of one
tree lie in one task, so levels need no further shuffle, and no row is looked at again.

Several trees are a forest of bagged trees: each takes every row as often as a Poisson draw says, which is a hash of the row's key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.learning.pricing import GRID_POINTS, grid

BINS = 64
#: A split has to gain this share of the node's squared sum over its rows: less is rounding.
LEAST_GAIN = 1e-9


def _bin(price: Column, bins: int) -> Column:
    """Number of the equal-width bin between a product's lowest and highest price; the last one is closed."""
    share = F.try_divide(price - F.col("_low"), F.col("_high") - F.col("_low"))
    return F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def _draws(row_key: Sequence[str], seed: int) -> Column:
    """How often a tree takes a row: Poisson with mean 1, from a hash of key, tree and seed."""
    uniform = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in row_key], F.col("tree"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    total, times = 0.0, F.lit(0)
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        times = times + F.when(uniform >= F.lit(total), 1).otherwise(0)
    return times


def price_bins(
    df: DataFrame, product: str, price: str, profit: str, bins: int = BINS, trees: int = 1, row_key: Sequence[str] = (), seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(product, tree, bin, n, total): rows and profits per price bin, bins without rows included; and (product, _low, _high).

    Rows without product, price or profit are left out.
    """
    if trees > 1 and not row_key:
        raise ValueError("a forest needs the key of a row")
    known = df.dropna(subset=[product, price, profit])
    bounds = known.groupBy(product).agg(F.min(price).alias("_low"), F.max(price).alias("_high"))
    rows = known.select(product, F.col(price).cast("double").alias("_price"), F.col(profit).cast("double").alias("_profit"), *row_key).join(bounds, product)
    rows = rows.withColumn("bin", _bin(F.col("_price"), bins))
    if trees > 1:
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("_times", _draws(row_key, seed)).where("_times > 0")
    else:
        rows = rows.withColumn("tree", F.lit(1)).withColumn("_times", F.lit(1))
    sums = rows.groupBy(product, "tree", "bin").agg(F.sum("_times").alias("n"), F.sum(F.col("_times") * F.col("_profit")).alias("total"))
    every = bounds.select(product, F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    whole = every.join(sums, [product, "tree", "bin"], "left").fillna({"n": 0, "total": 0.0})
    return whole, bounds


def grow(sums: DataFrame, product: str, depth: int, least_rows: int = 1) -> DataFrame:
    """(product, tree, bin, node, value): the leaf of every bin and its mean profit, after ``depth`` levels.

    A node is split after the bin that lowers the squared error most (ties: the lowest one) if both sides keep ``least_rows`` rows. A tree
    without rows has null values.
    """
    table = sums.repartition(product, "tree").withColumn("node", F.lit(0).cast("long"))
    node = Window.partitionBy(product, "tree", "node")
    upto = node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(depth):
        left, left_total = F.sum("n").over(upto), F.sum("total").over(upto)
        table = table.select("*", left.alias("_n"), left_total.alias("_t"), F.sum("n").over(node).alias("_all"), F.sum("total").over(node).alias("_sum"))
        right, right_total = F.col("_all") - F.col("_n"), F.col("_sum") - F.col("_t")
        whole = F.try_divide(F.col("_sum") * F.col("_sum"), F.col("_all"))
        gain = F.try_divide(F.col("_t") * F.col("_t"), F.col("_n")) + F.try_divide(right_total * right_total, right) - whole
        allowed = (F.col("n") > 0) & (F.col("_n") >= least_rows) & (right >= least_rows) & (gain > LEAST_GAIN * whole)
        best = F.max(F.when(allowed, F.struct(gain.alias("gain"), (-F.col("bin")).alias("at")))).over(node)
        table = table.withColumn("_at", -best["at"]).select(
            product, "tree", "bin", "n", "total", (2 * F.col("node") + F.coalesce((F.col("bin") > F.col("_at")).cast("int"), F.lit(0))).alias("node"))
    return table.select(product, "tree", "bin", "node", F.try_divide(F.sum("total").over(node), F.sum("n").over(node)).alias("value"))


def tree_curves(
    df: DataFrame, product: str, price: str, profit: str, bins: int = BINS, depth: int = 4, least_rows: int = 1,
    trees: int = 1, row_key: Sequence[str] = (), seed: int = 0, points: int = GRID_POINTS,
) -> DataFrame:
    """(product, point, price, pred_profit): predicted profit over each product's range of prices, the mean over its trees."""
    sums, bounds = price_bins(df, product, price, profit, bins, trees, row_key, seed)
    values = grow(sums, product, depth, least_rows).groupBy(product, "bin").agg(F.avg("value").alias("pred_profit"))
    prices = grid(bounds, "_low", "_high", price, points).withColumn("bin", _bin(F.col(price), bins))
    return prices.join(values, [product, "bin"]).select(product, "point", price, "pred_profit")
