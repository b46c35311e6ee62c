"""Row order over tables of any size (CLN-05, DER-19, WIN-04, WIN-05).

A window over a whole table, or over a group holding a large part of it, runs in one task.
Here rows are numbered by range chunks of (keys, order), so that a large group spreads over many
chunks. Each chunk is worked on alone, and one small row per chunk and key carries what the
next chunk has to know.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
#: Rows per chunk, about: what one task sorts.
CHUNK_ROWS = 2_000_000
MOST_CHUNKS = 4_096
_SAMPLED = 16  # rows looked at per chunk


def in_chunks(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the number of its range chunk; numbers rise with (keys, order).

    The points between chunks are literals, from the rows with the smallest hashes of (keys, order): the same for every
    evaluation of the plan, so nothing has to be written down. Two small jobs over the keys and the order find them.
    """
    names = [*keys, *order_by]
    total = df.count()
    chunks = min(MOST_CHUNKS, -(-total // chunk_rows))
    if chunks < 2:
        return df.withColumn(CHUNK, F.lit(0))
    by = [F.col(c) for c in names]
    drawn = df.select(*by).orderBy(F.xxhash64(*by)).limit(_SAMPLED * chunks).orderBy(*by).collect()
    points = list(dict.fromkeys(drawn[len(drawn) * i // chunks] for i in range(1, chunks)))
    kinds = [df.schema[c].dataType for c in names]

    def literal(row: Sequence[object]) -> Column:
        return F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(names, row, kinds)])

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda p: p <= F.struct(*by)))

    # two steps: which group of points, which point within it
    width = max(1, int(len(points) ** 0.5))
    groups = [points[i : i + width] for i in range(0, len(points), width)]
    group = passed(F.array(*[literal(g[0]) for g in groups]))
    inner = F.array(*[F.array(*[literal(p) for p in g]) for g in groups])
    number = F.when(group > 0, (group - 1) * width + passed(F.element_at(inner, F.greatest(group, F.lit(1))))).otherwise(F.lit(0))
    return df.withColumn(CHUNK, number)


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal chunk and keys, a missing key being equal to a missing key."""
    condition = F.col(f"{left}.{CHUNK}") == F.col(f"{right}.{CHUNK}")
    for k in keys:
        condition = condition & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return condition


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], add: Sequence[str]) -> DataFrame:
    joined = rows.alias("r").join(carry.alias("c"), _same("r", "c", keys), "left")
    return joined.select("r.*", *[F.col(f"c.{a}") for a in add])


def fill_from_neighbours(
    df: DataFrame, column: str, order_by: Sequence[str], keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Missing values take the last known value before them, else the first known one after.

    Only rows before a key's first known value lack an earlier one, and all of them take that
    value; so the backward step needs one value per key and no window of its own.
    """
    keys, order_by = list(keys), list(order_by)
    rows = in_chunks(df, keys, order_by, chunk_rows)
    value, order = F.col(column), F.struct(*order_by)
    known_at = F.when(value.isNotNull(), order)

    edges = rows.groupBy(*keys, CHUNK).agg(
        F.max_by(value, known_at).alias("_last"), F.min_by(value, known_at).alias("_first")
    )
    # At most one row per key and chunk: keys + chunks rows in all.
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    carry = edges.select(
        *keys,
        CHUNK,
        F.last("_last", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_before"),
        F.first("_first", ignorenulls=True)
        .over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias("_start"),
    )

    within = Window.partitionBy(*keys, CHUNK).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_before"), F.col("_start"))
    return (
        _join_carry(rows, carry, keys, ["_before", "_start"])
        .withColumn(column, filled)
        .drop("_before", "_start", CHUNK)
    )


def fill_regular_series(df: DataFrame, column: str, order_by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same for series that the calendar bounds (one row per key and period): one window per key."""
    rows = Window.partitionBy(*keys).orderBy(*order_by)
    before = F.last(column, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(column, ignorenulls=True).over(rows.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(column, F.coalesce(before, after))


def with_ordinal(
    df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = (), name: str = "ordinal", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Position of each row in the order, from 0, counted per key if keys are given."""
    keys, order_by = list(keys), list(order_by)
    rows = in_chunks(df, keys, order_by, chunk_rows)
    sizes = rows.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, CHUNK, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*keys, CHUNK).orderBy(*order_by)
    return (
        _join_carry(rows, offsets, keys, ["_offset"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(within) - 1).cast("bigint"))
        .drop("_offset", CHUNK)
    )


def with_overlap(
    df: DataFrame, ordinal: str, reach: int, block_size: int = 1_000_000
) -> DataFrame:
    """Cut an ordered table into blocks that also hold the ``reach`` rows before them.

    Adds ``_block`` and ``_halo``: halo rows repeat the end of the preceding block, so that a
    frame of up to ``reach`` preceding rows can be evaluated inside one block. The caller
    drops halo rows afterwards.
    """
    if reach > block_size:
        raise ValueError("the frame reaches over more than one block")
    block = F.floor(F.col(ordinal) / F.lit(block_size))
    at_end = F.col(ordinal) % F.lit(block_size) >= F.lit(block_size - reach)
    copies = F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))
    return (
        df.withColumn("_own", block)
        .withColumn("_block", F.explode(copies))
        .withColumn("_halo", F.col("_block") != F.col("_own"))
        .drop("_own")
    )
