"""Approximate nearest neighbours by inner product (operator 1) with learned partitions.

On a bounded sample, the graph of each vector's nearest neighbours is cut into balanced parts with few edges between them,
and a softmax classifier learns to tell from a vector the parts of its neighbours. Every row is indexed under its most
probable part. A query is routed to its most probable parts, as many as give the wanted recall on sample vectors that
the classifier has not seen, and to further ones until they hold as many vectors as are asked for; all vectors there are
ranked by the exact product.

Parts are dealt out in blocks of bounded numbers of rows and queries, so neither an uneven part nor a common vector makes
a task large (equal vectors are one entry).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import vectors as V
from gaugeframe.llm.common import written

SAMPLE = 4_096
#: Parts: so many times the cube root of the number of vectors, so that both the parts and what is found in them grow slowly.
PARTS = 0.75
MOST_PARTS = SAMPLE // 32
NEIGHBOURS = 10
RECALL = 0.96
BLOCK_ROWS = 65_536
BLOCK_QUERIES = 8_192


@dataclass(frozen=True)
class Router:
    weights: np.ndarray  # dimensions + 1 by parts
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        return np.argsort(-(_unit(x) @ self.weights), axis=1, kind="stable")


def _unit(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])


def neighbours(x: np.ndarray, y: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Rows of y with the largest products with each row of x."""
    out = []
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ y.T
        if skip_self:
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.vstack(out)


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each vertex of the neighbour graph: halves along main directions to start with, then moves that gain edges
    within parts, as long as no part grows over 105 % of its share."""
    part = np.zeros(len(x), np.int64)
    number = 1
    while number < parts:
        for p in range(min(number, parts - number)):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            part[own[np.argsort(centred @ direction, kind="stable")[len(own) // 2 :]]] = number + p
        number += min(number, parts - number)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    cap = int(np.ceil(1.05 * len(x) / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        edges = np.zeros((len(x), parts))
        np.add.at(edges, (a, part[b]), 1)
        np.add.at(edges, (b, part[a]), 1)
        gain = edges.max(axis=1) - edges[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            for p in np.argsort(-edges[i], kind="stable"):
                if edges[i, p] <= edges[i, part[i]]:
                    break
                if sizes[p] < cap:
                    sizes[part[i]] -= 1
                    sizes[p] += 1
                    part[i] = p
                    moved += 1
                    break
        if not moved:
            break
    return part


def fit(x: np.ndarray, parts: int, k: int, recall: float = RECALL, seed: int = 3) -> Router:
    """Router from the sample; a fifth of it is kept to choose the number of probes."""
    width = x.shape[1] + 1
    if parts < 2 or len(x) < 10 * parts:
        return Router(np.zeros((width, 1)), 1)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, x_fit = x[order[: len(x) // 5]], x[order[len(x) // 5 :]]
    near = neighbours(x_fit, x_fit, NEIGHBOURS, True)
    part = balanced_parts(x_fit, near, parts)
    wanted = np.zeros((len(x_fit), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x_fit)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    wanted = (wanted + np.eye(parts)[part]) / 2
    features, weights = _unit(x_fit), np.zeros((width, parts))
    for epoch in range(30):
        for rows in np.array_split(rng.permutation(len(x_fit)), max(1, len(x_fit) // 128)):
            z = features[rows] @ weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            weights -= (8.0 / (1 + epoch)) * features[rows].T @ (p - wanted[rows]) / len(rows)
    router = Router(weights, parts)
    # where the true neighbours of unseen vectors are indexed, in the order in which a query would visit parts
    home = router.order(x)[:, 0]
    true = neighbours(kept, x, min(k + 1, len(x)), False)
    place = np.argsort(router.order(kept), axis=1)
    visits = np.sort(place[np.arange(len(kept))[:, None], home[true]].ravel())
    probes = int(visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))))]) + 1
    return Router(weights, probes)


def search(df: DataFrame, asked: F.Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, parts: int | None = None, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, key, score): the k nearest rows found for each row for which ``asked`` (a condition on ``id``) holds.

    Vectors that are null, zero or hold null or non-finite components take no part; repeated rows count once; all vectors must be
    of one length. An empty table gives an empty result. Other columns are not read.
    """
    rows = written(V.usable(df, key, vector), "rows")
    index = written(V.entries(rows, k + 1), "entries")
    parts = parts or int(min(MOST_PARTS, max(1, PARTS * index.count() ** (1 / 3))))
    chosen = [bytes(r["v"]) for r in index.select("mark", "entry", "v").orderBy(F.xxhash64("v"), "entry").limit(sample).select("v").collect()]
    if not chosen:
        return rows.selectExpr("id as query_id", "0 as rank", f"id as `{key}`", "cast(0 as double) as score").limit(0)
    router = fit(V.matrix(chosen), parts, k, recall)
    shared = df.sparkSession.sparkContext.broadcast(router)
    kind = rows.schema["id"].dataType.simpleString()

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=shared.value.order(V.matrix(b["v"]))[:, 0])

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                go = shared.value.order(V.matrix(b["v"]))
                # a part is visited if those before it are too few or hold too little (one entry may be the query's own)
                visited = (np.arange(go.shape[1]) < shared.value.probes) | (np.cumsum(held[go], axis=1) - held[go] < k + 1)
                times = visited.sum(axis=1)
                yield pd.DataFrame({"query": np.repeat(b["query"].to_numpy(), times), "v": np.repeat(b["v"].to_numpy(), times), "part": go[visited]})

    base = written(index.select("entry", "v", "mark").mapInPandas(indexed, f"entry {kind}, v binary, mark long, part long"), "base")
    # at most MOST_PARTS rows: entries by part
    sizes = {r["part"]: r["count"] for r in base.groupBy("part").count().collect()}
    held = np.array([sizes.get(p, 0) for p in range(router.weights.shape[1])], np.int64)
    queries = rows.where(asked).join(index.select("v", F.col("entry").alias("query")), "v").select("query", "v").distinct()
    queries = written(queries.mapInPandas(routed, f"query {kind}, v binary, part long"), "queries")
    # how many blocks a part takes; turns are at most MOST_PARTS rows as well
    blocks = {p: -(-n // BLOCK_ROWS) for p, n in sizes.items()}
    turns = {r["part"]: -(-r["count"] // BLOCK_QUERIES) for r in queries.groupBy("part").count().collect()}

    def number(counts: dict[int, int]) -> F.Column:
        known = F.create_map(*[F.lit(x).cast("long") for p, n in counts.items() for x in (p, n)])[F.col("part")] if counts else F.lit(None)
        return F.coalesce(known, F.lit(0)).cast("long")

    left = base.withColumn("block", F.pmod("mark", number(blocks))).where(number(turns) > 0).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), number(turns) - 1)))
    right = queries.withColumn("turn", F.pmod(F.xxhash64("query"), number(turns))).where(number(blocks) > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), number(blocks) - 1)))

    def nearest(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query": [], "score": [], "entry": []})
        x = x.sort_values("entry")
        names, data, asked_for = x["entry"].to_numpy(), V.matrix(x["v"]), V.matrix(q["v"])
        take, out = min(k + 1, len(names)), []
        for a in range(0, len(q), 64):
            s = asked_for[a : a + 64] @ data.T
            for i, line in enumerate(s):
                # all that reach the k+1st score, then by score and entry
                at = np.flatnonzero(line >= np.partition(line, len(line) - take)[len(line) - take])
                at = at[np.argsort(-line[at], kind="stable")][:take]
                out.append((a + i, at, line[at]))
        query = q["query"].to_numpy()
        return pd.DataFrame({"query": np.repeat(query[[i for i, _, _ in out]], [len(at) for _, at, _ in out]), "score": np.concatenate([s for *_, s in out]), "entry": names[np.concatenate([at for _, at, _ in out])]})

    place = ["part", "block", "turn"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(nearest, f"query {kind}, score double, entry {kind}")
    return V.ranked(written(found, "found"), index, rows, asked, k, key)
