"""Exact top-k by inner product (operator 2) with M-trees and best-first search.

Inner products become distances: with one more component sqrt(M^2 - |x|^2), M the largest norm, all rows lie on a sphere around the
origin, and a row is the nearer to a query (with 0 there) the larger the product is: d^2 = |q|^2 + M^2 - 2 q.x.

Rows go to the nearest of some pivots, and each pivot's rows, split into shards of bounded size, become an M-tree: pages of
objects with covering radii and distances to the parent object. A search takes pages in the order of their lower bounds and
ends when the next bound is beyond the k-th distance; an object whose distance to the parent alone, by the triangle inequality,
puts it beyond is passed over without computing its distance.

Every query first searches the shards of its nearest pivot, which bounds its k-th distance; then those of all other pivots whose
balls reach within it. Bounds are loosened by far more than rounding can amount to, and scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import vectors as V
from gaugeframe.llm.common import written

SCALE = 1024
PIVOT_ROWS = 4_096
MOST_PIVOTS = 256
SAMPLE = 2_048
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096
PAGE = 512
FAN = 16
SLACK = 1e-7


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that puts them on the sphere of squared radius ``top``."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """From each row of x to each row of c."""
    square = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    return np.sqrt(np.maximum(square, 0))


def products(x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of integers held as doubles, none in x beyond ``largest``; results beyond 64 bits stand at the limits."""
    if largest * max(np.abs(q).max(), 1.0) * x.shape[1] >= 2.0**53:
        whole = [int(b) for b in q]
        return np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(row, whole)))) for row in x], np.int64)
    return (x @ q).astype(np.int64)


class Tree:
    """Pages of an M-tree: page 0 is the root. Of a leaf page, ``child`` is None and radii are 0."""

    def __init__(self, names: np.ndarray, x: np.ndarray, top: float):
        self.names, self.x, self.high = names, x, lifted(x, top)
        self.largest = float(np.abs(x).max(initial=0))
        self.pages: list[tuple] = []
        self._page(np.arange(len(x)), None)
        # a page has its own names and rows, one after another
        self.pages = [(names[rows], x[rows], *rest) for rows, *rest in self.pages]
        del self.names, self.x, self.high

    def _page(self, rows: np.ndarray, parent: int | None) -> tuple[int, float]:
        """Add the page of ``rows`` below the object ``parent``; its number and covering radius."""
        number = len(self.pages)
        self.pages.append(())
        to_parent = np.zeros(len(rows)) if parent is None else distances(self.high[rows], self.high[[parent]])[:, 0]
        if len(rows) <= PAGE:
            self.pages[number] = (rows, np.zeros(len(rows)), to_parent, None)
            return number, float(to_parent.max(initial=0))
        # objects far from each other first, then each row below the nearest
        chosen, gap = [0], distances(self.high[rows], self.high[rows[:1]])[:, 0]
        fan = min(FAN, -(-2 * len(rows) // PAGE))
        while len(chosen) < fan and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(self.high[rows], self.high[rows[chosen[-1:]]])[:, 0])
        near = distances(self.high[rows], self.high[rows[chosen]]).argmin(axis=1)
        if len(chosen) == 1 or np.bincount(near).max() > 0.9 * len(rows):  # no way to tell them apart: even slices
            near = np.arange(len(rows)) * fan // len(rows)
        objects, radii, child = [], [], []
        for g in np.unique(near):
            own = rows[near == g]
            middle = int(own[distances(self.high[own], self.high[own].mean(axis=0, keepdims=True))[:, 0].argmin()])
            page, radius = self._page(own, middle)
            objects.append(middle)
            radii.append(radius)
            child.append(page)
        objects = np.array(objects)
        away = np.zeros(len(objects)) if parent is None else distances(self.high[objects], self.high[[parent]])[:, 0]
        self.pages[number] = (objects, np.array(radii), away, child)
        return number, float(to_parent.max(initial=0))

    def search(self, q: np.ndarray, k: int, square: float, bound: float) -> list[tuple[int, object]]:
        """The k best (score, name), ties to the smaller name, among those no farther than ``bound``.

        ``square`` is |q|^2 + M^2. Distances are computed for the objects that the parent's distance doesn't rule out.
        """
        best: list[tuple[int, object]] = []  # a heap: the worst first
        slack = SLACK * (1 + math.sqrt(square))
        queue = [(0.0, 0, 0.0)]
        while queue:
            low, number, from_parent = heapq.heappop(queue)
            if low > bound + slack:
                break
            names, x, radii, to_parent, child = self.pages[number]
            if number:
                kept = np.abs(from_parent - to_parent) - radii <= bound + slack
                if not kept.all():
                    names, x, radii = names[kept], x[kept], radii[kept]
                    child = [c for c, keep in zip(child, kept) if keep] if child else child
            if not len(x):
                continue
            scores = products(x, q, self.largest)
            if child is None:
                # only rows that reach the worst of the best, at first the k-th of the page
                least = best[0][0] if len(best) == k else np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else scores.min()
                reach = np.flatnonzero(scores >= least)
                for score, name in zip(scores[reach].tolist(), names[reach].tolist()):
                    item = (score, _Last(name))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif best[0] < item:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    bound = min(bound, math.sqrt(max(0.0, square - 2.0 * best[0][0])))
                continue
            away = np.sqrt(np.maximum(square - 2 * scores.astype(float), 0))
            for page, d, r in zip(child, away.tolist(), radii.tolist()):
                if d - r <= bound + slack:
                    heapq.heappush(queue, (max(low, d - r), page, d))
        return [(s, n.name) for s, n in sorted(best, reverse=True)]


class _Last:
    """A name that counts as less the larger it is: of equal scores the larger name is the worse."""

    __slots__ = ("name",)

    def __init__(self, name: object):
        self.name = name

    def __lt__(self, other: "_Last") -> bool:
        return self.name > other.name

    def __eq__(self, other: object) -> bool:
        return self.name == other.name


def search(df: DataFrame, asked: F.Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(query_id, rank, key, score): the k largest integer inner products of floor(scale * x) for each row for which ``asked``
    (a condition on ``id``) holds, exactly.

    Vectors that are null or hold null or non-finite components take no part (zero vectors do); repeated rows count once; all
    vectors must be of one length. Products beyond 64 bits stand at the limits of a long. An empty table gives an empty result. Other columns are not read.
    """
    rows = written(V.usable(df, key, vector, lambda x: np.floor(scale * x), zero=True), "rows")
    kind = rows.schema["id"].dataType.simpleString()
    empty = rows.selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "cast(0 as long) as score").limit(0)
    index = written(V.entries(rows, k + 1), "entries")

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"top": [(V.matrix(b["v"]) ** 2).sum(axis=1).max()], "n": [len(b)]})

    total = index.select("v").mapInPandas(norms, "top double, n long").agg(F.max("top").alias("top"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return empty
    top = float(total["top"])
    count = int(min(MOST_PIVOTS, max(1, total["n"] // pivot_rows)))
    sample = V.matrix([bytes(r["v"]) for r in index.select("entry", "v").orderBy(F.xxhash64("v"), "entry").limit(SAMPLE).select("v").collect()])
    high = lifted(sample, top)
    chosen, gap = [0], distances(high, high[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:  # the first that lies beyond the middle of the gaps: far, but no outlier
        chosen.append(int(np.argsort(gap, kind="stable")[len(gap) * 3 // 4]))
        gap = np.minimum(gap, distances(high, high[chosen[-1:]])[:, 0])
    pivots = df.sparkSession.sparkContext.broadcast(high[chosen])  # at most MOST_PIVOTS vectors

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = distances(lifted(V.matrix(b["v"]), top), pivots.value)
                yield b.assign(pivot=d.argmin(axis=1), away=d.min(axis=1))

    base = written(index.select("entry", "v", "mark").mapInPandas(placed, f"entry {kind}, v binary, mark long, pivot long, away double"), "base")
    about = {r["pivot"]: (r["n"], r["reach"]) for r in base.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("reach")).collect()}
    shards = {p: -(-n // shard_rows) for p, (n, _) in about.items()}
    reach = np.array([about[p][1] if p in about else -np.inf for p in range(len(chosen))])

    def by_pivot(counts: dict[int, int]) -> F.Column:
        return F.create_map(*[F.lit(x).cast("long") for p, n in counts.items() for x in (p, n)])[F.col("pivot")]

    place = ["pivot", "shard"]

    def built(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("entry")
        tree = Tree(rows["entry"].to_numpy(), V.matrix(rows["v"]), top)
        return pd.DataFrame({"pivot": [rows["pivot"].iloc[0]], "shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    trees = base.withColumn("shard", F.pmod("mark", by_pivot(shards)).cast("long")).groupBy(*place).applyInPandas(built, "pivot long, shard long, tree binary")
    trees = written(trees, "trees")
    queries = rows.where(asked).join(index.select("v", F.col("entry").alias("query")), "v").select("query", "v").distinct()

    def routed(bounds: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = V.matrix(b["v"])
                d = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots.value)
                d[:, ~np.isfinite(reach)] = np.inf
                home = d.argmin(axis=1)
                if bounds:  # all others whose balls reach within the k-th distance so far
                    bound = b["bound"].to_numpy(float)
                    square = (x * x).sum(axis=1) + top
                    go = d - reach[None, :] <= (bound + SLACK * (1 + np.sqrt(square)))[:, None]
                    go[np.arange(len(x)), home] = False
                    go[:, ~np.isfinite(reach)] = False
                    q, p = np.nonzero(go)
                else:
                    q, p = np.arange(len(x)), home
                    bound = np.full(len(x), np.inf)
                yield pd.DataFrame({"query": b["query"].to_numpy()[q], "v": b["v"].to_numpy()[q], "bound": bound[q], "pivot": p})

        return run

    def searched(asked_for: DataFrame, routing) -> DataFrame:
        """(query, score, entry) of the best in each shard that a query goes to."""
        go = asked_for.mapInPandas(routing, f"query {kind}, v binary, bound double, pivot long")
        go = written(go, "routes")
        turns = {r["pivot"]: -(-r["count"] // BLOCK_QUERIES) for r in go.groupBy("pivot").count().collect()}
        if not turns:
            return rows.selectExpr("id as query", "cast(0 as long) as score", "id as entry").limit(0)
        left = trees.where(by_pivot(turns).isNotNull()).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), by_pivot(turns) - 1)))
        right = go.withColumn("turn", F.pmod(F.xxhash64("query"), by_pivot(turns)).cast("long")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), by_pivot(shards) - 1)))

        def run(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found: list[tuple] = []
            if len(t) and len(q):
                tree = pickle.loads(t["tree"].iloc[0])
                for name, v, bound in zip(q["query"].tolist(), V.matrix(q["v"]), q["bound"].tolist()):
                    found += [(name, s, e) for s, e in tree.search(v, k + 1, float(v @ v) + top, bound)]
            return pd.DataFrame(found, columns=["query", "score", "entry"])

        where = [*place, "turn"]
        return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInPandas(run, f"query {kind}, score long, entry {kind}")

    first = written(searched(queries, routed(False)), "first")
    # the distance of the k+1st so far, or none if there are fewer
    bounds = V.best(first, k).groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") > k)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                square = (V.matrix(b["v"]) ** 2).sum(axis=1) + top
                reached = np.sqrt(np.maximum(square - 2 * b["least"].to_numpy(float), 0))
                yield pd.DataFrame({"query": b["query"], "v": b["v"], "bound": np.where(np.isnan(reached), np.inf, reached)})

    bounded = queries.join(bounds.select("query", "least"), "query", "left").select("query", "v", "least").mapInPandas(near, f"query {kind}, v binary, bound double")
    rest = searched(bounded, routed(True))
    return V.ranked(written(first.unionByName(rest), "found"), index, rows, asked, k, key)
