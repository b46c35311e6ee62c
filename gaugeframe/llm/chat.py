"""Chat formatting (operator 9) as a prefix tree.

A node of the tree is a turn together with all turns before it, named by a chained hash. Conversations with the same first
turns share nodes, and each node is emitted once, in the segment of its owner: the smallest conversation through it.
A segment is therefore the part of a conversation that no smaller one has. ``nodes`` holds the emitted text of every node with its
position ids (they go on from the parent's, whatever segment that is in) and its loss mask; ``paths`` holds, for each
conversation, the intervals of positions in its own segment and in its ancestors' that it may attend to.

Template: <|role|>text<|end|>, where role and text are escaped: a backslash is doubled, and after each of < [ | one is
put. So no control string with any of these characters appears in a text, and reading left to right undoes it.

Turns of one conversation pass through one task in order, as a stream that keeps a hash and a position only: the chained hash
(and the digests asked for) of a conversation are sequential by nature, but need no memory for its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm.common import written

END = "<|end|>"
_ESCAPED = re.compile(r"([\\<\[|])\\")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\").replace("|", "|\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_in_order(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text), sorted within each partition; all turns of a conversation are in one partition.

    Null roles and texts are empty; rows without a conversation belong to none and are left out; equal or null turn numbers
    (null first) are ordered by role and text, so repeated rows are repeated turns.
    """
    rows = df.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.where("conv is not null").repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def prefix_tree(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """``nodes`` (segment, idx, formatted, position_from, position_to, loss_from, loss_to) and ``paths`` (conv, segment, depth,
    idx_from, idx_to, position_from, position_to).

    Positions count code points of the formatted text. The loss mask is an interval within ``formatted`` (null without loss).
    An empty table gives two empty tables.
    """
    rows = turns_in_order(df, conversation, turn, role, text)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, idx, name, at = None, 0, b"", 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("conv", "idx", "node", "formatted", "position_from", "position_to", "loss_from", "loss_to")}
            for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    conv, idx, name, at = c, 0, b"", 0
                h = hashlib.blake2b(name, digest_size=16)
                for part in (r, t):
                    raw = part.encode()
                    h.update(len(raw).to_bytes(8, "big") + raw)
                name = h.digest()
                head, body = f"<|{escape(r)}|>", escape(t)
                size = len(head) + len(body) + len(END)
                loss = r == learned
                for column, value in zip(out.values(), (c, idx, name, head + body + END, at, at + size, len(head) if loss else None, len(head) + len(body) if loss else None)):
                    column.append(value)
                idx, at = idx + 1, at + size
            types = [batch.schema.field("conv").type, pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), types)], list(out))

    steps = written(rows.mapInArrow(run, f"conv {kind}, idx long, node binary, formatted string, position_from long, position_to long, loss_from long, loss_to long"), "turns")
    owners = steps.groupBy("node").agg(F.min("conv").alias("segment"))
    owned = written(steps.select("node", "conv", "idx", "position_from", "position_to").join(owners, "node"), "owned")
    mine = owned.where("conv = segment").select("conv", "idx")
    nodes = steps.join(mine, ["conv", "idx"]).select(F.col("conv").alias("segment"), "idx", "formatted", "position_from", "position_to", "loss_from", "loss_to")
    paths = owned.groupBy("conv", "segment").agg(F.min("idx").alias("idx_from"), F.max("idx").alias("idx_to"), F.min("position_from").alias("position_from"), F.max("position_to").alias("position_to"))
    depth = F.row_number().over(Window.partitionBy("conv").orderBy("idx_from")) - 1
    return nodes, paths.withColumn("depth", depth)


def depth_first(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes in the order in which a depth-first walk emits them, each with ``attends``: the intervals of its ancestors and of its
    own segment up to itself, as (segment, idx_from, idx_to, position_from, position_to).

    A walk follows a segment to its end, then visits what branches off, from the deepest branch up. Equal conversations and those
    that end within another one have no nodes of their own; their ends are in :func:`ends`. A null role or text is an empty one
    by then, a very long text is one row, and empty tables give an empty one.
    """
    steps = F.sort_array(F.collect_list(F.struct("depth", "idx_from", "segment", "idx_to", "position_from", "position_to")))
    routes = paths.groupBy("conv").agg(steps.alias("steps"), F.max(F.struct("depth", "segment"))["segment"].alias("last")).where("conv = last")
    key = F.transform("steps", lambda s: F.struct((-s["idx_from"]).alias("up"), s["segment"].alias("segment")))
    before = F.transform(F.slice("steps", 1, F.size("steps") - 1), lambda s: F.struct(s["segment"], s["idx_from"], s["idx_to"], s["position_from"], s["position_to"]))
    own = F.element_at("steps", -1)
    routes = routes.select(F.col("conv").alias("segment"), key.alias("route"), before.alias("before"), own["idx_from"].alias("first"), own["position_from"].alias("start"))
    here = F.struct("segment", F.col("first").alias("idx_from"), F.col("idx").alias("idx_to"), F.col("start").alias("position_from"), "position_to")
    emitted = nodes.join(routes, "segment").withColumn("attends", F.concat("before", F.array(here))).drop("before", "first", "start")
    return emitted.orderBy(F.col("route")[0]["segment"], "route", "idx")


def ends(paths: DataFrame) -> DataFrame:
    """(conv, segment, idx): the node with which each conversation ends."""
    last = F.max(F.struct("depth", "segment", "idx_to")).alias("last")
    return paths.groupBy("conv").agg(last).select("conv", F.col("last.segment").alias("segment"), F.col("last.idx_to").alias("idx"))


def attended(emitted: DataFrame, last: DataFrame) -> DataFrame:
    """(conv, segment, idx_from, idx_to): the turns of each conversation, as the intervals that its last node attends to.

    ``emitted`` is the result of :func:`depth_first`, ``last`` that of :func:`ends`.
    """
    found = last.join(emitted.select("segment", "idx", "attends"), ["segment", "idx"])
    return found.select("conv", F.explode("attends").alias("a")).select("conv", "a.segment", "a.idx_from", "a.idx_to")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per conversation, from the emitted nodes: number of turns, digests of the turns and of the text under the loss mask.

    ``paths`` is that of the tree or :func:`attended`. Turns pass in order, one at a time; empty tables give an empty result.
    """
    wanted = paths.select("conv", "segment", F.explode(F.sequence("idx_from", "idx_to")).alias("idx"))
    text = wanted.join(nodes.select("segment", "idx", "formatted", "loss_from", "loss_to"), ["segment", "idx"])
    ordered = text.select("conv", "idx", "formatted", "loss_from", "loss_to").repartition("conv").sortWithinPartitions("conv", "idx")
    kind = ordered.schema["conv"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        conv_type = pa.int64()

        def result(done: list[list]) -> pa.RecordBatch:
            cells = [[s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]] for s in done]
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate(types)], names)

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            done = []
            for c, f, a, b in zip(*(batch.column(x).to_pylist() for x in ("conv", "formatted", "loss_from", "loss_to"))):
                if not state or state[0] != c:
                    if state:
                        done.append(state)
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                cut = f.index("|>", 2)
                role, body = unescape(f[2:cut]), unescape(f[cut + 2 : -len(END)])
                state[1] += 1
                state[2].update(f"{role}\n{body}\n".encode())
                state[5] += len(f)
                if a is not None:
                    loss = unescape(f[a:b])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
            if done:
                yield result(done)
        if state:
            yield result([state])

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
