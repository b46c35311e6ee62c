"""N-gram Jaccard join (operator 10) with token-combination prefixes.

A text's set holds the hashes of its distinct word n-grams; two texts link when intersection / union >= num / den.

1. Texts with equal sets are one node: of every text only its set's size and digest are written, and the steps below work on one text a
   set, so copies cost one small row each.
2. Counts of all n-grams over all texts go into a table (2**20 counters, up to 2**22 for a larger corpus, shared by n-grams that
   collide). It only orders n-grams, rare ones first, and marks those of more than FREQUENT texts: any order the same for all texts finds
   all links. A rare n-gram that shares a counter may count as frequent, never the other way round.
3. Of a set of n n-grams a link may miss at most n - ceil(t n). The prefix of rare n-grams is extended until its
   signatures survive that many misses: a rare n-gram is a signature alone, frequent ones are combined in pairs within
   their subclass (the first of a subclass gives no pair, so it lengthens the prefix by one). Two linked sets share a signature.
   There are as many subclasses as the set's size has sixteens, to a power of two, so a subclass has a few members and the number
   of pairs grows with the text, not with its square. Sizes of linked sets may lie on either side of such a power: a set also has the
   signatures of the next one where a set that links with it may be so large. A set that can link with equal ones only has no signatures.
4. Nodes with a common signature are compared with one of them: first by parities (the bits in which they differ number
   at most the n-grams that only one set has, so pairs with too many cannot link), then on the whole sets. Where nodes of a
   signature are then still in several components, the pairs across components are verified as well, but for those that have
   too many n-grams before the common one. Pairs
   within one component need no check: they change no component. So a group of near copies costs a few comparisons a
   member and no link that matters is lost.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.common import Scratch, components, lists, one_table, sent

TABLE_BITS = 20, 22
#: Sets of up to so many n-grams have single signatures only; larger ones have a subclass for each MEMBERS n-grams, to a power of two.
SMALL, MEMBERS = 16, 16
PARITY_WORDS = 8
#: An n-gram alone is a signature of at most so many texts.
FREQUENT = 512
_FIRST, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def sets(texts: pa.Array, size: int, lowercase: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, flat, with offsets. Fewer than ``size`` words are one n-gram."""
    raw, at = W.flat(texts)
    raw = W.lower(raw) if lowercase else raw
    starts, ends, first = W.words(raw, at)
    hashes = W.word_hashes(raw, starts, ends)
    grams, _, own = W.windows(hashes, first, size)
    counts = np.diff(first)
    found = []
    for i, (a, b) in enumerate(zip(own[:-1], own[1:])):
        if b > a:
            x = np.sort(grams[a:b])
            found.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif counts[i]:
            short = hashes[first[i] : first[i + 1]] * W.powers(W._BASE, int(counts[i]))
            found.append(W.mix(np.add.reduce(short, keepdims=True) ^ np.uint64(counts[i])))
        else:
            found.append(grams[:0])
    return np.concatenate(found) if found else grams, np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def count_table(df: DataFrame, text: str, size: int, lowercase: bool, bits: int) -> np.ndarray:
    """Counts of all n-grams by the leading bits of their hash. Beyond 2**31 a counter wraps: it only orders."""

    def count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in W.pieces(batches, text):
            grams, _ = sets(batch.column(text), size, lowercase)
            table += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=len(table)).astype(np.int32)

    return one_table(df.select(F.col(f"`{text}`")), count, 1 << bits, np.int32, np.add)


def levels(n: int, num: int, den: int) -> list[int]:
    """Logarithms of the numbers of subclasses under which a set of n n-grams has signatures: that of its own size, up to that of the
    largest set it can link with. Two linked sets have that of the larger one in common."""

    def level(size: int) -> int:
        return max(size // MEMBERS, 1).bit_length() - 1

    return list(range(level(n), level(n * den // num) + 1))


def signatures(grams: np.ndarray, counts: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, and how many n-grams before each are certainly not common: two sets that link and differ have
    a signature in common for which that holds in both.

    For a single n-gram these are all before it: take the first common one. Frequent n-grams come last, so if the first common
    one is frequent, all are. Take then the first to be the second of its subclass: before it at most one of each subclass is
    common, and no rare one."""
    n = len(grams)
    if n * den < num * (n + 1):  # not even a set with one n-gram more links
        return grams[:0], np.zeros(0, np.int64)
    need = n - -(-num * n // den) + 1
    order = np.lexsort((grams, counts))
    grams, often = grams[order], counts[order] > frequent
    single = np.arange(need)
    if n <= SMALL:
        return grams[single], single
    rare = np.flatnonzero(~often[:need])
    out, before = [grams[rare]], [rare]
    if len(rare) < need:
        for level in levels(n, num, den):
            more, ahead = _pairs(grams, often, need, level)
            out.append(more)
            before.append(ahead)
        # may link with a small set, which has single signatures only
        if num * n <= SMALL * den:
            some = np.flatnonzero(often[:need])
            out.append(grams[some])
            before.append(some)
    return np.concatenate(out), np.concatenate(before)


def _pairs(grams: np.ndarray, often: np.ndarray, need: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of frequent n-grams of one of 2**level subclasses within the prefix that is long enough."""
    subclass = np.where(often, (grams % np.uint64(1 << level)).astype(np.int64), -1)
    gain = np.ones(len(grams), np.int64)
    members, first = np.unique(subclass, return_index=True)
    gain[first[members >= 0]] = 0
    end = int(np.searchsorted(np.cumsum(gain), need)) + 1
    rare = np.cumsum(~often[:end])
    at = np.flatnonzero(often[:end])
    at = at[np.argsort(subclass[at], kind="stable")]  # by subclass, then by place
    _, sizes = np.unique(subclass[at], return_counts=True)
    earlier = W.within(sizes)  # members of the subclass before each
    b = np.repeat(at, earlier)
    a = at[np.repeat(np.arange(len(at)) - earlier, earlier) + W.within(earlier)]
    return W.mix(W.mix(grams[a]) + grams[b] + np.uint64(level)), rare[b] + np.maximum(b - rare[b] - (1 << level), 0)


def _digests(grams: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Two 64-bit digests of each set, the same whatever it is worked on with."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(grams ^ c), dtype=np.uint64)]) for c in (_FIRST, _SECOND)]
    return [pa.array((t[at[1:]] - t[at[:-1]]).view(np.int64)) for t in total]


def _trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives memory that it no longer uses back to the system: workers are used again by later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def _described(df: DataFrame, key: str, text: str, size: int, lowercase: bool) -> DataFrame:
    """(id, n, h1, h2) of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            grams, at = sets(batch.column(text), size, lowercase)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(at)), *_digests(grams, at)], ["id", "n", "h1", "h2"])

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(_trimmed(run), f"id {kind}, n long, h1 long, h2 long")


def _signed(rows: DataFrame, table: np.ndarray, size: int, lowercase: bool, num: int, den: int) -> DataFrame:
    """(id, n, h1, h2, parity, signatures, before) of rows (id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    bits, frequent = len(table).bit_length() - 1, FREQUENT
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            grams, at = sets(batch.column("text"), size, lowercase)
            counts = shared.value[(grams >> np.uint64(64 - bits)).astype(np.int64)]
            own = [signatures(grams[a:b], counts[a:b], frequent, num, den) for a, b in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x, _ in own])])
            # bit i of a text's parity tells whether an odd number of its n-grams hash to i
            hit = (grams % np.uint64(64 * PARITY_WORDS)).astype(np.int64) + np.repeat(np.arange(batch.num_rows), np.diff(at)) * (64 * PARITY_WORDS)
            odd = (np.bincount(hit, minlength=batch.num_rows * 64 * PARITY_WORDS) & 1).astype(np.uint8)
            parity = np.packbits(odd, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.diff(at)), *_digests(grams, at), lists(parity, np.arange(batch.num_rows + 1) * PARITY_WORDS, pa.int64()),
                 lists(np.concatenate([x for x, _ in own]).view(np.int64), ends, pa.int64()), lists(np.concatenate([x for _, x in own]), ends, pa.int32())],
                ["id", "n", "h1", "h2", "parity", "signatures", "before"])

    return rows.mapInArrow(_trimmed(run), f"id {kind}, n long, h1 long, h2 long, parity array<long>, signatures array<long>, before array<int>")


def _sets_of(df: DataFrame, ids: DataFrame, scratch: Scratch, key: str, text: str, size: int, lowercase: bool) -> DataFrame:
    """(id, grams) of the given distinct ids."""
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    chosen = rows.join(sent(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            grams, at = sets(batch.column("text"), size, lowercase)
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(grams.view(np.int64), at, pa.int64())], ["id", "grams"])

    kind = rows.schema["id"].dataType.simpleString()
    return scratch.written(chosen.mapInArrow(_trimmed(run), f"id {kind}, grams array<long>"), "grams")


def _reachable(n: str, before: str, m: str, ahead: str, num: int, den: int) -> F.Column:
    """Whether sets of n and m n-grams can link if what comes before a common one in either is not common."""
    least = F.least(F.col(n) - F.col(before), F.col(m) - F.col(ahead)).cast("long")
    return (num + den) * least >= num * (F.col(n).cast("long") + F.col(m))


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and parities don't rule out."""
    each = nodes.select("rep", "n", "parity")
    both = pairs.join(each.toDF("a", "na", "pa"), "a").join(each.toDF("b", "nb", "pb"), "b")
    only_one = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    near = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    return both.where(near & ((num + den) * only_one <= (den - num) * (F.col("na") + F.col("nb")))).select("a", "b")


def _verified(df: DataFrame, pairs: DataFrame, num: int, den: int, scratch: Scratch, *how) -> DataFrame:
    """The pairs (a, b) that link by their whole sets."""
    pairs = scratch.written(pairs, "pairs")
    ids = scratch.written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    grams = _sets_of(df, ids, scratch, *how)
    joined = pairs.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").join(grams.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    links = scratch.written(joined.where((num + den) * common >= num * (F.size("ga") + F.size("gb"))).select("a", "b"), "links")
    scratch.drop(pairs, ids, grams)
    return links


def linked_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, num: int = 90, den: int = 100, lowercase: bool = True) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key that links reach, itself included.

    Null, empty and blank texts have no n-grams and link with nothing. Rows with a null key keep their count, take no part
    in links and get a null component. Repeated rows give repeated results. Other columns are not read.
    """
    scratch, how = Scratch(df.sparkSession), (key, text, size, lowercase)
    docs = scratch.written(_described(df, *how), "sets")
    some = docs.where("n > 0 and id is not null")
    reps = scratch.written(some.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "reps")
    members = scratch.written(docs.select("id", "n", "h1", "h2").join(reps, ["n", "h1", "h2"], "left").select("id", "n", "rep"), "members")
    grams = docs.agg(F.sum("n")).first()[0] or 0
    table = count_table(df, text, size, lowercase, min(max(int(grams // 64).bit_length(), TABLE_BITS[0]), TABLE_BITS[1]))
    chosen = reps.select("n", "h1", "h2", F.col("rep").alias("id"))
    texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(sent(chosen.select("id").distinct()), "id", "left_semi")
    # a node is a rep with its own set: ids of repeated rows with other texts are told apart by the set
    signed = _signed(texts, table, size, lowercase, num, den).join(sent(chosen), ["id", "n", "h1", "h2"], "left_semi")
    own = scratch.written(signed.withColumnRenamed("id", "rep"), "signatures")
    nodes = own.select("rep", "n", "parity")
    each = F.explode(F.arrays_zip("signatures", "before")).alias("s")
    rows = own.select("rep", "n", each).select(F.col("s.signatures").alias("sig"), "rep", F.col("n").cast("int").alias("n"), F.col("s.before").alias("before"))
    often = rows.groupBy("sig").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("sig")
    shared = scratch.written(rows.join(often, "sig"), "shared")
    scratch.drop(docs, reps)
    # the node with the most shared signatures has the fewest n-grams of its own: it is near the middle of its group
    weight = shared.groupBy("rep").agg(F.count("*").alias("weight"))
    heads = shared.join(weight, "rep").groupBy("sig").agg(F.max_by(F.struct("rep", "n", "before"), F.struct("weight", (-F.col("rep")).alias("low"))).alias("head"))
    led = scratch.written(shared.join(heads, "sig").where("rep != head.rep"), "led")
    scratch.drop(shared)
    star = led.where(_reachable("n", "before", "head.n", "head.before", num, den)).select(F.least("rep", "head.rep").alias("a"), F.greatest("rep", "head.rep").alias("b")).distinct()
    links = _verified(df, _possible(star, nodes, num, den), num, den, scratch, *how)
    # where the nodes of a signature, the middle one left aside, are in several components: pairs across those
    placed = led.drop("head").join(components(links).withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
    mixed = placed.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig")
    # sizes of linked sets differ by the ratio at most: they are in the same or in neighbouring bands
    band = F.floor(F.log(F.col("n")) / math.log(den / num) + F.lit(1e-9)).cast("long")
    open_ = scratch.written(placed.join(mixed, "sig").withColumn("band", band), "open")
    scratch.drop(led)
    right = open_.toDF(*[c if c in ("sig", "band") else f"{c}_" for c in open_.columns])
    left = open_.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    across = left.join(right, ["sig", "band"]).where((F.col("rep") < F.col("rep_")) & (F.col("c") != F.col("c_")) & _reachable("n", "before", "n_", "before_", num, den))
    more = _verified(df, _possible(across.select(F.col("rep").alias("a"), F.col("rep_").alias("b")).distinct(), nodes, num, den), num, den, scratch, *how)
    last = components(links.union(more)).withColumnRenamed("id", "rep")
    # the set of a repeated id joins what its other sets link with
    named = members.where("rep is not null").select("id", "rep").distinct().join(last, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    result = members.join(named, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    result = scratch.written(result, "groups")
    scratch.drop(own, open_, links, more, members)
    return result
