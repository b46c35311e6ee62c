"""Mixing sources to target weights (operator 8) by Efraimidis-Spirakis sampling.

Each source gets a token budget: shares by weight, at most ``epochs`` times its own size, the excess shared again by
weight. It is filled with whole epochs first; for the rest, documents are ordered by the exponential key -ln(u) / w (u from
a hash of id and content, w the document's quality weight) and taken while their prefix sum is within the budget. Documents are
never cut: where the sum would pass the budget, later documents that still fit fill it up.

Rows of one id with different content have different keys. Rows that agree in id, source and content are counted, and walk in
blocks of at most ``BLOCK_ROWS``, each with a key of its own: no id, null or repeated, gathers in one bucket.

The prefix sums run over key buckets first (one row per source and bucket; their number follows the rows of the source) and
over documents only from the bucket in which the budget ends. From there on, documents no larger than what is left are
streamed, some ``BUCKET_ROWS`` at a time, until none fits any more, so no task ever sorts a whole source, however large its
share of the rows, and the result is that of one walk over the source, whatever the buckets are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.common import written

#: Documents per key bucket, about, and documents that one round tries when it fills a budget up.
BUCKET_ROWS = 10_000
LEAST_WEIGHT = 0.05
#: Rows that agree in all that is read walk together, at most so many.
BLOCK_ROWS = 1_000


def measured(df: DataFrame, key: str, text: str, source: str, weight: str | None = None, apart: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, weight, digest) of every row: number of words, quality weight, digest of the text and the columns ``apart``.

    The weight is that of the column ``weight``, or the share of letters among all but white space; missing, NaN and smaller weights
    count as ``LEAST_WEIGHT``.
    """
    kind, source_kind = df.schema[key].dataType.simpleString(), df.schema[source].dataType.simpleString()
    letter, space = np.zeros(256, np.int64), np.zeros(256, np.int64)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    space[[0x20, *range(9, 14)]] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            raw, at = W.flat(batch.column("text"))
            _, _, first = W.words(raw, at)
            if weight is None:
                letters, spaces = (np.concatenate([[0], np.cumsum(x[raw])])[at] for x in (letter, space))
                solid = np.diff(at) - np.diff(spaces)
                given = pa.array(np.maximum(np.diff(letters) / np.maximum(solid, 1), LEAST_WEIGHT))
            else:
                given = batch.column("weight")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(np.diff(first)), given, batch.column("digest")], ["id", "source", "size", "weight", "digest"])

    share = F.lit(LEAST_WEIGHT) if weight is None else F.greatest(F.nanvl(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), share.alias("weight"), digest(text, apart).alias("digest"))
    return rows.mapInArrow(run, f"id {kind}, source {source_kind}, size long, weight double, digest long")


def digest(text: str, apart: Sequence[str]) -> Column:
    """Hash of the text and further columns of a row; a null is told from a value."""
    columns = [F.col(f"`{c}`") for c in dict.fromkeys([text, *apart])]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def targets(sizes: DataFrame, weights: Sequence[float], epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating. With caps sorted by cap / weight, those up to
    some place stand at their cap and the others share what remains by weight; the place is where the next cap holds it.
    Windows here run over the table of sources, not over documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int")))
    order = [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.lit(float(epochs)) * F.col("source_size")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(onwards)
    # once a source stays below its cap, all later ones do, at the same level
    free = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("w") <= cap, F.col("level")))
    first = F.first("level", ignorenulls=True).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return free.withColumn("level", first).select("source", "source_size", F.coalesce(F.col("level") * F.col("w"), cap).alias("target"))


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None) -> DataFrame:
    """(key, size, source, source_size, target, taken, copies) of every row; ``taken`` = copies * size.

    ``weight`` names a column of quality weights, such as a classifier's scores; without it the share of letters is the weight.
    Null and empty texts have size 0 and are in whole epochs only. A null source is a source, and a null id an id. Ties in the
    key go to the smaller id, then size, then digest; of rows that agree in all that is read any may be the one taken once
    more. A rerun gives the same result, also on other partitions. Very long texts are measured whole and are never cut; other
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    found = decide(df, weights, epochs, seed, key, text, source, weight)
    each = found.select("*", F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    copies = F.col("epochs") + (F.col("number") <= F.col("more")).cast("long")
    return each.select(F.col("id").alias(key), "size", F.col("source").alias(source), "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def decide(df: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, apart: Sequence[str] = ()) -> DataFrame:
    """(id, source, size, digest, n, source_size, target, epochs, more): ``n`` rows that agree in id, source and :func:`digest` (text and
    columns ``apart``) are taken ``epochs`` times each, and ``more`` of them once more. ``n`` is at most ``BLOCK_ROWS``."""
    block = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK_ROWS))
    counted = measured(df, key, text, source, weight, apart).groupBy("id", "source", "size", "weight", "digest").agg(F.count("*").alias("n"))
    blocks = counted.select("*", F.explode(block).alias("block")).withColumn("n", F.least(F.lit(BLOCK_ROWS).cast("long"), F.col("n") - F.col("block") * BLOCK_ROWS))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "id", F.col("id").isNull(), "digest", "block"), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    docs = written(blocks.withColumn("e", -F.log(uniform) / F.col("weight")).drop("weight", "block"), "sizes")
    named = F.struct("source").alias("s")  # a struct is never null, so a null source joins as well
    sources = written(docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (1 + F.floor(F.sum("n") / BUCKET_ROWS)).alias("buckets")), "sources")
    plan = targets(sources.select("source", "source_size"), weights, epochs)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size") + F.lit(1e-12)), F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select(named, "source_size", "target", "epochs", "rest")
    plan = written(plan.join(sources.select(named, "buckets"), "s"), "targets")
    rows = docs.select("*", named).join(plan, "s").withColumn("b", F.floor(F.col("buckets") * F.col("e") / (1 + F.col("e")))).drop("buckets")
    rows = written(rows, "buckets")

    up_to = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("s", "b").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.first("rest").alias("rest"))
    fills = sums.withColumn("before", F.coalesce(F.sum("size").over(up_to), F.lit(0)))
    ends = fills.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    ends = written(ends.select("s", F.col("b").alias("end"), (F.col("rest") - F.col("before")).alias("left")), "ends")
    edges, tried = _filled_up(rows, ends)
    limits = ends.select("s", "end").join(tried, "s", "left")
    sure = rows.join(limits, "s", "left")
    again = F.exists("tried", lambda t: (F.col("b") >= t["b_from"]) & (F.col("b") <= t["b_to"]) & (F.col("size") <= t["left"]))
    sure = sure.where((F.col("size") == 0) | F.col("tried").isNull() | ~again)
    more = F.when(F.col("end").isNull(), F.col("rest") >= F.col("source_size")).otherwise(F.col("b") < F.col("end"))
    found = sure.withColumn("more", F.when((F.col("size") > 0) & more, F.col("n")).otherwise(F.lit(0).cast("long")))
    for edge in edges:
        found = found.select(*edge.columns).unionByName(edge)
    return found.select("id", "source", "size", "digest", "n", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "more")


def _filled_up(rows: DataFrame, ends: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The documents tried one by one from the buckets in which budgets end, with ``more``, a table for each round; and which these are,
    as (s, tried): from bucket ``b_from`` to ``b_to``, those with words and not larger than ``left``.

    A round takes the next buckets in which some ``BUCKET_ROWS`` documents are not larger than what is left. All that it leaves
    out are larger than what is left then, so the next rounds have few to try, and the last finds none.
    """
    state, edges = ends.select("s", F.col("end").alias("b_from"), "left"), []
    tried = ends.select("s", F.lit(None).cast("array<struct<b_from: long, b_to: long, left: double>>").alias("tried"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        fit = rows.join(state, "s").where((F.col("size") > 0) & (F.col("b") >= F.col("b_from")) & (F.col("size") <= F.col("left")))
        counts = fit.groupBy("s", "b").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ranges = written(state.join(counts.where(F.col("before") < BUCKET_ROWS).groupBy("s").agg(F.max("b").alias("b_to")), "s"), "ranges")
        if ranges.isEmpty():
            return edges, written(tried, "tried")
        now = fit.join(ranges.select("s", "b_to"), "s").where("b <= b_to")
        edges.append(written(_filled(now).select("id", "size", "source", "digest", "n", "s", "source_size", "target", "epochs", "more"), "edge"))
        used = edges[-1].groupBy("s").agg(F.sum(F.col("size") * F.col("more")).alias("used"))
        left = F.col("left") - F.coalesce("used", F.lit(0))
        state = written(ranges.join(used, "s", "left").select("s", (F.col("b_to") + 1).alias("b_from"), left.alias("left")), "left")
        this = ranges.select("s", F.array(F.struct("b_from", "b_to", "left")).alias("this"))
        joined = F.concat(F.coalesce("tried", F.expr("cast(array() as array<struct<b_from: long, b_to: long, left: double>>)")), F.col("this"))
        tried = written(tried.join(this, "s", "left").select("s", F.coalesce(joined, F.col("tried")).alias("tried")), "tried")


def _filled(edge: DataFrame) -> DataFrame:
    """The rows with ``more``: how many of the ``n`` documents that a row stands for are taken once more.

    In the order of the keys, each document that still fits into ``left`` is taken. One task streams the rows of a source in
    order and keeps the remaining budget only.
    """
    names = [f.name for f in edge.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, 0.0
        for batch in batches:
            more = []
            for name, size, n, budget in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "n", "left"))):
                if at != (name,):
                    at, left = (name,), budget
                more.append(min(n, int(left // size)))
                left -= size * more[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(more, pa.int64())], [*names, "more"])

    schema = edge.withColumn("more", F.lit(0).cast("long")).schema
    return edge.repartition("source").sortWithinPartitions("source", "e", "id", "size", "digest").mapInArrow(run, schema)
