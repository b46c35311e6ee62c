"""Moments of all pairs of columns in one pass (AGG-22).

Each task keeps, for all pairs of columns, matrices over the rows where both are known: number of rows, means, centred squares and
products, and the extent. A batch's matrices come from three matrix products of its shifted values and its mask; batches, and then
tasks, are united by Chan's update, which loses nothing where means are large and spreads small. A task sends one row per column, so
neither rows nor expressions grow with the square of the columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Per pair (i, j), over rows known in both: rows (n), mean of i, sum of its squared deviations (squares), sum of products of deviations, least
#: and largest i.
Moments = dict[str, np.ndarray]


def of_batch(x: np.ndarray) -> Moments:
    """Moments of a batch (rows by columns, missing values as NaN)."""
    known = ~np.isnan(x)
    first = x[known.argmax(axis=0), np.arange(x.shape[1])]
    first = np.where(np.isfinite(first), first, 0.0)
    d, m = np.where(known, x - first, 0.0), known.astype(np.float64)
    n, sums = m.T @ m, d.T @ m
    share = np.maximum(n, 1)
    least, most = (np.broadcast_to(f(np.where(known, x, empty), axis=0)[:, None], n.shape).copy() for f, empty in ((np.min, np.inf), (np.max, -np.inf)))
    for j in np.flatnonzero(~known.all(axis=0)):
        rows = x[known[:, j]]
        inner = known[known[:, j]]
        least[:, j] = np.where(inner, rows, np.inf).min(axis=0, initial=np.inf)
        most[:, j] = np.where(inner, rows, -np.inf).max(axis=0, initial=-np.inf)
    return {
        "n": n, "mean": np.where(n > 0, first[:, None] + sums / share, 0.0), "squares": (d * d).T @ m - sums * sums / share,
        "products": d.T @ d - sums * sums.T / share, "least": least, "most": most,
    }


def united(a: Moments, b: Moments) -> Moments:
    """Chan's update of whole matrices."""
    n = a["n"] + b["n"]
    share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    delta = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
    weight = a["n"] * share
    return {
        "n": n, "mean": np.where(a["n"] > 0, a["mean"] + delta * share, b["mean"]), "squares": a["squares"] + b["squares"] + delta * delta * weight,
        "products": a["products"] + b["products"] + delta * delta.T * weight, "least": np.minimum(a["least"], b["least"]), "most": np.maximum(a["most"], b["most"]),
    }


def _rows_united(a: Moments, b: Moments) -> Moments:
    """The same for rows of the matrices with the other column's figures (``other_...``) beside the own ones."""
    n = a["n"] + b["n"]
    share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    weight, both, out = a["n"] * share, (a["n"] > 0) & (b["n"] > 0), {"n": n}
    delta = {side: np.where(both, b[f"{side}mean"] - a[f"{side}mean"], 0.0) for side in SIDES}
    for side, d in delta.items():
        out[f"{side}mean"] = np.where(a["n"] > 0, a[f"{side}mean"] + d * share, b[f"{side}mean"])
        out[f"{side}squares"] = a[f"{side}squares"] + b[f"{side}squares"] + d * d * weight
        out[f"{side}least"], out[f"{side}most"] = np.minimum(a[f"{side}least"], b[f"{side}least"]), np.maximum(a[f"{side}most"], b[f"{side}most"])
    return out | {"products": a["products"] + b["products"] + delta[""] * delta["other_"] * weight}


SIDES = ("", "other_")
FIGURES = ("n", "products", *(f"{side}{k}" for side in SIDES for k in ("mean", "squares", "least", "most")))


def _per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, FIGURES as arrays over the other column): one row per column, for an empty table as well."""
    size = len(columns)
    values = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)]
    schema = "i int, " + ", ".join(f"{k} array<double>" for k in FIGURES)

    def packed(rows: dict[int, Moments]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32())] + [pa.array([r[k].tolist() for r in rows.values()], pa.list_(pa.float64())) for k in FIGURES], ["i", *FIGURES])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = of_batch(np.full((1, size), np.nan))
        for batch in batches:
            if batch.num_rows:
                total = united(total, of_batch(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
        yield packed({i: {k: total[k.removeprefix("other_")][:, i] if k.startswith("other_") else total[k][i] for k in FIGURES} for i in range(size)})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = {k: np.array(row[k], np.float64) for k in FIGURES}
                total[row["i"]] = _rows_united(total[row["i"]], new) if row["i"] in total else new
        if total:
            yield packed(total)

    nothing = of_batch(np.full((1, size), np.nan))
    empty = [(i, *([float(v) for v in nothing[k.removeprefix("other_")][i]] for k in FIGURES)) for i in range(size)]
    found = df.select(*values).mapInArrow(each, schema).unionAll(df.sparkSession.createDataFrame(empty, schema))
    return found.repartition("i").mapInArrow(together, schema)


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(first, second, n, products, mean, squares, least, most, other_...): for every pair of columns, in both orders and each with itself,
    over the rows known in both; ``other_`` figures are of the second column. NaN counts as missing."""
    names = F.array(*[F.lit(c) for c in columns])
    pairs = _per_column(df, list(columns)).select("i", F.posexplode(F.arrays_zip(*FIGURES)).alias("j", "m"))
    return pairs.select(names[F.col("i")].alias("first"), names[F.col("j")].alias("second"), "m.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, other, correlation) for all pairs; null where a side does not vary over the rows known on both."""
    varies = (F.col("least") < F.col("most")) & (F.col("other_least") < F.col("other_most"))
    value = F.try_divide(F.col("products"), F.sqrt("squares") * F.sqrt("other_squares"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return pair_moments(df, columns).select(F.col("first").alias("variable"), F.col("second").alias("other"), F.when(varies & ~F.isnan(value), bounded).alias("correlation"))
