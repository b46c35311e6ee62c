"""Helpers of several operators: lists as Arrow columns, written intermediate tables, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.session import cut_lineage, shared_folder


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: survives lost executors."""
    return Scratch(df.sparkSession).written(df, purpose)


class Scratch:
    """Tables written below the shared checkpoint folder, dropped as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, shared_folder(spark, "llm"), 0
        self.paths: dict[int, str] = {}

    def written(self, df: DataFrame, purpose: str) -> DataFrame:
        self.number += 1
        path = f"{self.folder}/{self.number}-{purpose}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables. What was computed from them must have been written before."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(ids: DataFrame, most: int = 500_000) -> DataFrame:
    """``ids`` (a few numbers a row), to be broadcast if there are at most ``most``; a larger table is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[offsets[i]:offsets[i+1]] as list i."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values).cast(kind))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for all ends of the edges (a, b); the component is its smallest id.

    Every round a node takes the smallest label among itself and its neighbours, then the label's own label (halving
    the distance to the smallest id). Rounds end when no label changes. Work and rows per round follow the edges; a node
    with very many neighbours is a minimum over its edges, combined in each task before the shuffle. Edges with a null end
    are ignored.
    """
    both = cut_lineage(
        edges.where("a is not null and b is not null").select("a", "b")
        .union(edges.where("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("n"))
        hooked = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "n").alias("l"))
        # the label's own label: the smallest that any node with this label has got
        jumps = hooked.groupBy("old").agg(F.min("l").alias("j"))
        found = cut_lineage(hooked.join(jumps, "old").select("id", "old", F.least("l", "j").alias("component")))
        labels = found.select("id", "component")
        if found.where("component < old").isEmpty():
            return labels


#: A table of fixed size travels in so many pieces.
CHUNKS = 16


def one_table(df: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, kind: type, join: np.ufunc) -> np.ndarray:
    """One array of ``size`` numbers: each task fills one of its own, and ``join`` unites them in pieces on the executors.

    What reaches the driver is the united array, whose size doesn't depend on the data.
    """
    per, wide = size // CHUNKS, np.dtype(kind)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, wide)
        fill(batches, table)
        if table.any():
            yield rows({i: table[i * per : (i + 1) * per] for i in range(CHUNKS)})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(values.as_py()), wide)
                total[chunk] = join(total[chunk], part) if chunk in total else part
        if total:
            yield rows(total)

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        packed = pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), packed], ["chunk", "part"])

    schema, table = "chunk int, part binary", np.zeros(size, wide)
    for chunk, part in df.mapInArrow(each, schema).repartition("chunk").mapInArrow(together, schema).collect():  # CHUNKS rows
        table[chunk * per : (chunk + 1) * per] = np.frombuffer(zlib.decompress(bytes(part)), wide)
    return table
