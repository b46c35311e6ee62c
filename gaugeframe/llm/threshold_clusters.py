"""Centroid clustering (operator 11) by the threshold algorithm.

Vectors and centroids hold integers, so all distances and means are exact and every run gives the same clusters.

To find a vector's nearest centroid, each dimension has the centroids sorted by their value. From the vector's own value the lists are
walked outwards, one centroid per step and dimension, the nearer side first. A centroid met for the first time gets its exact distance. One
that has not been met is, in each dimension, at least as far as the next one of that list: once the sum of these squared gaps (the frontier)
strictly exceeds the best exact distance, no other centroid can be nearer or as near, and the walk stops. All vectors of a batch are
walked at once.

A round is one pass over the written vectors: each task adds up its vectors per centroid, so a centroid that takes a third of all rows, or
a vector that a third of them hold, costs one row a task. The driver holds the centroids (``k`` vectors) and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm.common import Scratch

FAR = np.iinfo(np.int64).max
#: Components are at most this large, so that a squared distance fits in 64 bits (the gap has one bit more, dimensions take some).
BITS = 62
BATCH = 4_096


def whole(df: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): vectors with exactly ``dimensions`` components, none null or non-finite, as bytes of integers floor(scale * x).

    Squared distances must fit in 64 bits: with 64 dimensions, components from 2**27 on stop the job with a message. Null ids are kept.
    """
    kind = df.schema[key].dataType.simpleString()
    most = 2 ** ((BITS - (dimensions - 1).bit_length()) // 2 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            if not len(x):
                continue
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dimensions)
            good = np.isfinite(flat).all(axis=1)  # nulls are NaN
            scaled = np.floor(flat[good] * scale)
            if len(scaled) and np.abs(scaled).max() >= most:
                raise ValueError(f"components of {most} or more: squared distances would not fit in 64 bits")
            rows = scaled.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(good)), pa.array([r.tobytes() for r in rows], pa.binary())], ["id", "v"])

    wanted = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    return wanted.where(F.coalesce(F.size("x") == dimensions, F.lit(False))).mapInArrow(run, f"id {kind}, v binary")


class Lists:
    """Per dimension, the centroids sorted by their value."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid (ties: the smaller number), and how many distances were computed."""
        k, dims = self.centroids.shape
        best, number = np.full(len(x), FAR), np.full(len(x), k)
        seen, computed = np.zeros((len(x), k), bool), 0
        # after[i, d]: first place of list d whose value is not below the row's; places before it are walked downwards
        after = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in range(dims)], axis=1) if len(x) else np.zeros((0, dims), np.int64)
        before, rows, dim = after - 1, np.arange(len(x)), np.arange(dims)
        while len(rows):
            here = x[rows]
            low = np.where(before >= 0, here - self.values[dim, np.maximum(before, 0)], FAR)
            high = np.where(after < k, self.values[dim, np.minimum(after, k - 1)] - here, FAR)
            # the frontier: nothing unmet is nearer than the next place in any dimension; an exhausted list has met all
            gap = np.minimum(low, high)
            open_ = ~(gap == FAR).any(axis=1)
            frontier = np.where(open_, (np.where(open_[:, None], gap, 0) ** 2).sum(axis=1), FAR)
            on = open_ & (frontier <= best[rows])
            if not on.all():
                rows, after, before, low, high, here = rows[on], after[on], before[on], low[on], high[on], here[on]
                if not len(rows):
                    break
            down = low <= high
            met = self.order[dim, np.where(down, before, after)]
            before, after = before - down, after + ~down
            new = np.zeros((len(rows), k), bool)
            new[np.arange(len(rows))[:, None], met] = True
            new &= ~seen[rows]
            seen[rows] |= new
            for c in range(k):
                hit = np.flatnonzero(new[:, c])
                if len(hit):
                    gaps = here[hit] - self.centroids[c]
                    exact, row = (gaps * gaps).sum(axis=1), rows[hit]
                    computed += len(hit)
                    closer = (exact < best[row]) | ((exact == best[row]) & (c < number[row]))
                    best[row[closer]], number[row[closer]] = exact[closer], c
        return number, best, computed


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int64).reshape(len(values), -1)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid with vectors, their number and componentwise sums: k rows reach the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, count, total = Lists(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = _vectors(batch.column("v").slice(at, BATCH))
                number = lists.nearest(x)[0]
                count += np.bincount(number, minlength=k)
                order = np.argsort(number, kind="stable")
                some, first = np.unique(number[order], return_index=True)
                total[some] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(count)
        if len(some):
            cells = np.repeat(some, dims + 1), np.tile(np.arange(-1, dims), len(some)), np.concatenate([count[some, None], total[some]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cells], ["cluster", "dim", "value"])

    cells = rows.select("v").mapInArrow(run, "cluster long, dim long, value long").groupBy("cluster", "dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found: dict[int, dict[int, int]] = {}
    for cluster, dim, value in cells.collect():  # k * (dimensions + 1) numbers
        found.setdefault(cluster, {})[dim] = int(value)
    return {c: (cell[-1], [cell[d] for d in range(dims)]) for c, cell in found.items()}


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    Vectors that are null, of another length, or hold null or non-finite components take no part. The first centroids are the vectors with the
    smallest sha256 of ``1:<key>``; rows with one id come in the order of their vectors, null ids last. With fewer vectors than ``k``
    there are as many centroids as vectors. Ties go to the smaller number, empty centroids stay. Repeated rows are vectors of their own.
    Other columns are not read. An empty table gives an empty table. Counts of a round, not vectors, reach the driver.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.written(whole(df, key, vector, dimensions, scale), "vectors")
    kind = rows.schema["id"].dataType.simpleString()
    mark = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = [r[0] for r in rows.orderBy(mark.asc_nulls_last(), "v").select("v").limit(k).collect()]
    centroids = np.array([np.frombuffer(bytes(v), np.int64) for v in first], np.int64).reshape(len(first), dimensions)
    if len(centroids):
        for _ in range(rounds):
            for c, (count, total) in _sums(rows, centroids).items():
                centroids[c] = [t // count for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(centroids)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                number, distance, _ = lists.nearest(_vectors(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    found = scratch.written(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    scratch.drop(rows)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    digests = df.sparkSession.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")
    within = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("within"))
    total = within.agg(F.sum("within").cast("long")).scalar()
    # one row a centroid
    per = within.join(F.broadcast(digests), "cluster").select("cluster", F.col("within").cast("long").alias("cluster_inertia"), total.alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
