"""What both vector searches share: equal vectors as one entry, and results per entry as results per query row.

An entry is a distinct vector with the ``most`` smallest ids that hold it. A list of k nearest rows without the query's own
never needs more than k + 1 ids of one vector, so this loses nothing, and a vector that a third of the rows hold is one entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, change: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = False) -> DataFrame:
    """(id, v): distinct rows with a usable vector, as bytes of doubles. Null vectors, null or non-finite components
    and null ids are left out, zero vectors as well unless ``zero``. ``change`` is applied to the flat components."""
    kind = df.schema[key].dataType.simpleString()
    wanted = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            if not len(x):
                continue
            at = x.offsets.to_numpy().astype(np.int64)
            flat = x.values.to_numpy(zero_copy_only=False)[: at[-1]] + 0.0  # nulls are NaN, and -0.0 is 0.0
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            good = np.flatnonzero((bad[at[1:]] == bad[at[:-1]]) & ((some[at[1:]] > some[at[:-1]]) | zero))
            flat = change(flat) + 0.0 if change else flat
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in good], pa.binary())], ["id", "v"])

    return wanted.mapInArrow(run, f"id {kind}, v binary").distinct()


def entries(rows: DataFrame, most: int) -> DataFrame:
    """(entry, v, ids): each distinct vector, named by its smallest id, with its ``most`` smallest ids.

    The ranking cuts every vector to ``most`` rows in each task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), F.crc32("v").alias("mark"), "v", "ids")


def matrix(column: Iterator[bytes]) -> np.ndarray:
    values = list(column)
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best rows (query, score, entry) of every query, ties to the smaller entry."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entry"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k + 1).drop("_rank")


def ranked(found: DataFrame, index: DataFrame, rows: DataFrame, asked: F.Column, k: int, key: str) -> DataFrame:
    """(query_id, rank, key, score) of all rows that are asked for, from (query, score, entry) of their entries."""
    each = best(found, k).join(index.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("id"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    lists = each.withColumn("_rank", order).where(F.col("_rank") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_rank", "id", "score"))).alias("list"))
    mine = rows.where(asked).join(index.select("v", F.col("entry").alias("query")), "v").select(F.col("id").alias("query_id"), "query")
    # an id may come from several vectors of repeated rows: the nearest counts
    without = mine.join(lists, "query").select("query_id", F.posexplode(F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k)))
    return without.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["id"].alias(key), F.col("col")["score"].alias("score"))
