"""Exact percentiles with linear interpolation (PRF-02, CLN-04) by bracketed selection.

A wanted rank is looked for in an interval of values. One aggregation over the table counts what lies below and inside the interval and
keeps a mergeable quantile sketch (KLL) of the inside; two of the sketch's quantiles around the rank bracket it. When a bracket holds few
values they are kept: one counted pass over the table sends only those through the shuffle, everything below a bracket being a single
row per task. Larger brackets are the next intervals. A sketch may be wrong, the counts are not: a rank outside its bracket is looked for
on the side where the counts place it, so results are exact whatever the sketch says.

Two passes do for some ten million values; each further one narrows the interval several hundredfold. No pass shuffles or writes the values of a
column, and no task sorts them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Size of the sketches (some 0.1 % of the ranks as error) and steps of the quantiles taken from them.
SKETCH, STEPS = 4_096, 1_024
#: Values kept of all brackets together.
KEEP = 1_000_000


@dataclass(frozen=True)
class Interval:
    """Values of a column strictly between two bounds; without a bound, all on that side."""

    column: str
    low: float | None = None
    high: float | None = None

    def holds(self, x: Column) -> Column:
        inside = x.isNotNull()
        if self.low is not None:
            inside = inside & (x > F.lit(self.low))
        return inside if self.high is None else inside & (x < F.lit(self.high))


@dataclass(frozen=True)
class Found:
    """How many values lie below an interval, at its low bound, inside and at its high bound, and quantiles of the inside."""

    below: int
    at_low: int
    inside: int
    at_high: int
    quantiles: list[float] | None


def known(df: DataFrame, column: str) -> Column:
    """The column as double; NaN is missing."""
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


def look(df: DataFrame, intervals: Iterable[Interval], extra: Sequence[Column] = ()) -> tuple[dict[Interval, Found], Row]:
    """Counts and quantiles of the intervals, and further aggregates, in one pass; one row reaches the driver."""
    intervals = list(dict.fromkeys(intervals))
    values = {c: f"value{i}" for i, c in enumerate(dict.fromkeys(interval.column for interval in intervals))}
    df = df.select("*", *[known(df, c).alias(name) for c, name in values.items()])
    aggregates: list[Column] = []
    for i, interval in enumerate(intervals):
        x = F.col(values[interval.column])
        inside = interval.holds(x)

        def count(condition: Column | None) -> Column:
            return F.lit(0) if condition is None else F.count_if(condition)

        low = None if interval.low is None else F.lit(interval.low)
        high = None if interval.high is None else F.lit(interval.high)
        aggregates += [
            count(None if low is None else x < low).alias(f"below{i}"), count(None if low is None else x == low).alias(f"at_low{i}"),
            count(inside).alias(f"inside{i}"), count(None if high is None else x == high).alias(f"at_high{i}"),
            F.kll_sketch_agg_double(F.when(inside, x), F.lit(SKETCH)).alias(f"sketch{i}"),
        ]
    grid = F.expr("array(" + ",".join(f"{j / STEPS}D" for j in range(STEPS + 1)) + ")")
    kept = [f"{name}{i}" for i in range(len(intervals)) for name in ("below", "at_low", "inside", "at_high")]
    marks = [F.when(F.col(f"inside{i}") > 0, F.kll_sketch_get_quantile_double(f"sketch{i}", grid)).alias(f"grid{i}") for i in range(len(intervals))]
    more = [c.alias(f"extra{j}") for j, c in enumerate(extra)]
    row = df.agg(*aggregates, *more).select(*kept, *marks, *[f"extra{j}" for j in range(len(extra))]).first()
    return {
        interval: Found(row[f"below{i}"], row[f"at_low{i}"], row[f"inside{i}"], row[f"at_high{i}"], row[f"grid{i}"])
        for i, interval in enumerate(intervals)
    }, row


def _merged(spans: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    out: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def count_inside(df: DataFrame, spans: dict[str, list[tuple[float, float]]], most: int) -> dict[tuple[str, int], list[tuple[float | None, int]]] | None:
    """(column, part) -> values with their numbers of rows. Even parts lie between the closed spans (which must not overlap) and
    are one number each, without a value; odd parts are the spans. None if there are more than ``most`` rows."""
    df = df.select(*[known(df, c).alias(f"value{i}") for i, c in enumerate(spans)])
    cells = []
    for i, (column, of_column) in enumerate(spans.items()):
        x = F.col(f"value{i}")
        part = F.lit(2 * len(of_column))
        for j in range(len(of_column) - 1, -1, -1):
            low, high = of_column[j]
            part = F.when(x < F.lit(low), 2 * j).when(x <= F.lit(high), 2 * j + 1).otherwise(part)
        cells.append(F.struct(F.lit(i).alias("column"), F.when(x.isNotNull(), part).alias("part"), x.alias("value")))
    kept = df.select(F.inline(F.array(*cells))).where("part is not null").select("column", "part", F.when(F.col("part") % 2 == 1, F.col("value")).alias("value"))
    rows = kept.groupBy("column", "part", "value").agg(F.count(F.lit(1)).alias("n")).limit(most + 1).toArrow().to_pydict()
    if len(rows["n"]) > most:
        return None
    names = list(spans)
    found: dict[tuple[str, int], list[tuple[float | None, int]]] = {}
    for i, part, value, n in zip(rows["column"], rows["part"], rows["value"], rows["n"]):
        found.setdefault((names[i], part), []).append((value, n))
    for values in found.values():
        values.sort(key=lambda v: (v[0] is not None, v[0]))
    return found


def _bracket(found: Found, rank: int) -> tuple[float, float]:
    """Two quantiles of the inside around its ``rank``-th value."""
    at = rank / max(found.inside - 1, 1) * STEPS
    return found.quantiles[max(math.floor(at) - 2, 0)], found.quantiles[min(math.ceil(at) + 2, STEPS)]


def select_ranks(df: DataFrame, wanted: dict[str, set[int]], first: dict[str, Found], keep: int = KEEP) -> dict[tuple[str, int], float]:
    """(column, rank) -> value at this place of the column's sorted known values, counted from 0.

    ``first`` holds what ``look`` found over whole columns.
    """
    values: dict[tuple[str, int], float] = {}
    # the open interval of each rank that is still looked for
    search = {(c, r): (Interval(c), first[c]) for c, ranks in wanted.items() for r in ranks}
    narrow_all = False
    while search:
        room = max(keep // len(search), 1)
        few: dict[tuple[str, int], tuple[float, float]] = {}
        look_at: dict[tuple[str, int], Interval] = {}
        for key, (interval, found) in search.items():
            if found is None:
                look_at[key] = interval
                continue
            low, high = _bracket(found, key[1] - found.below - found.at_low)
            if narrow_all or (low < high and 6 / STEPS * found.inside > room):
                look_at[key] = Interval(key[0], low, high)
            else:
                few[key] = low, high
        narrow_all = False
        after: dict[tuple[str, int], tuple[Interval, Found | None]] = {}
        if few:
            spans = {c: _merged(s for (d, _), s in few.items() if d == c) for c in {c for c, _ in few}}
            parts = count_inside(df, spans, 2 * keep + 2 * len(few) + len(spans))
            if parts is None:  # the sketch was wrong: go on with its brackets as intervals
                narrow_all = True
                after.update({key: search[key] for key in few})
            else:
                for (column, rank), _ in few.items():
                    after.update(_located(parts, column, rank, spans[column], search[column, rank][0], values))
        if look_at:
            seen, _ = look(df, look_at.values())
            for key, interval in look_at.items():
                found, (outer, _) = seen[interval], search[key]
                rank = key[1] - found.below
                if interval.low is not None and rank < 0:
                    after[key] = Interval(key[0], outer.low, interval.low), None
                elif rank < found.at_low:
                    values[key] = interval.low
                elif rank < found.at_low + found.inside:
                    after[key] = interval, found
                elif rank < found.at_low + found.inside + found.at_high:
                    values[key] = interval.high
                else:
                    after[key] = Interval(key[0], interval.high, outer.high), None
        search = after
    return values


def _located(parts: dict, column: str, rank: int, spans: list[tuple[float, float]], outer: Interval, values: dict) -> dict:
    """Put the value at ``rank`` into ``values``, or return the interval between spans that holds it."""
    before = 0
    for part in range(2 * len(spans) + 1):
        cells = parts.get((column, part), [])
        if rank < before + sum(n for _, n in cells):
            if part % 2 == 0:
                low = spans[part // 2 - 1][1] if part else outer.low
                high = spans[part // 2][0] if part < 2 * len(spans) else outer.high
                return {(column, rank): (Interval(column, low, high), None)}
            for value, n in cells:
                before += n
                if rank < before:
                    values[column, rank] = value
                    return {}
        before += sum(n for _, n in cells)
    raise ValueError(f"{column} has no rank {rank}: the table changes between passes")


def percentile_values(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], extra: Sequence[Column] = (), keep: int = KEEP
) -> tuple[dict[tuple[str, float], float | None], Row]:
    """(column, probability) -> percentile, None for a column without known values; and the row with the ``extra`` aggregates."""
    whole = {c: Interval(c) for c in dict.fromkeys(columns)}
    seen, row = look(df, whole.values(), extra)
    first = {c: seen[interval] for c, interval in whole.items()}
    positions = {(c, p): p * (first[c].inside - 1) for c in whole for p in probabilities if first[c].inside}
    wanted = {c: {r for (d, _), at in positions.items() if d == c for r in (math.floor(at), math.ceil(at))} for c in whole}
    at_rank = select_ranks(df, wanted, first, keep)
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in whole for p in probabilities}
    for (c, p), position in positions.items():
        low, high = at_rank[c, math.floor(position)], at_rank[c, math.ceil(position)]
        out[c, p] = low if low == high else low + (high - low) * (position - math.floor(position))
    return out, row


def exact_percentiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keep: int = KEEP) -> DataFrame:
    """(column, probability, value) with one row for each pair; null for an empty column."""
    found, _ = percentile_values(df, columns, probabilities, keep=keep)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("probability"), F.lit(found[c, p]).cast("double").alias("value")) for c in columns for p in probabilities]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))
