"""Substring dedup (operator 4) with repeated-phrase automata.

1. The anchor of a window of words is the rarest of the short phrases in it, by a table of counts of fixed size. Equal windows
   have equal anchors. Windows of a text with the same anchor form a piece (at most 2 * size - phrase words). As the rarest
   phrase anchors, a piece around a very common phrase has only words that are as common.
2. Anchors that occur once cannot be in a repeated window. Those that occur more often are kept in a bit table of fixed size;
   bits shared by chance only add candidates.
3. The candidate pieces, without places, go to shards by anchor, so all equal windows meet in one shard. There, the repeated
   windows are confirmed on the words themselves; maximal runs of them are the recurring passages.
4. Texts with a candidate anchor (no other can hold a passage) are dealt into blocks by their digest. A block gets the passages
   of its texts' pieces, compiles them to an Aho-Corasick automaton over words and streams its whole texts through it. Only
   these occurrences say which words go; they come back to the documents by the digest of the text.

A piece is shuffled once for each batch of rows that has it and kept once in a shard, however many copies there are; a text
streams once for each task that read a copy, a passage once for each block that needs it. Shards follow the number of pieces
and blocks the bytes of text, so neither's memory grows with the data.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.common import Scratch, one_table

PHRASE = 8
TABLE_BITS = 20
FILTER_BITS = 26
SHARD_PIECES = 15_000
BLOCK_BYTES = 1 << 20
_SLICE = 1 << 16


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, at = W.flat(texts)
    starts, ends, first = W.words(raw, at)
    return raw, starts, ends, first, W.word_hashes(raw, starts, ends)


def anchors(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of ``size`` words, text by text: hash of the anchor, its first word and the window's first word."""
    grams, gram_at, _ = W.windows(hashes, first, PHRASE)
    rare = counts[_slot(grams, len(counts))].astype(np.uint64)
    order = (np.minimum(rare, np.uint64(2**20 - 1)) << np.uint64(44)) | (grams >> np.uint64(20))
    span = size - PHRASE + 1
    own = np.maximum(np.diff(first) - PHRASE + 1, 0)
    windows = np.maximum(own - span + 1, 0)
    begin = W.within(windows) + np.repeat(np.cumsum(own) - own, windows)  # number of the window's first phrase
    best = np.empty(len(begin), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(order, span) if len(order) >= span else np.zeros((0, span), np.uint64)
    for a in range(0, len(begin), _SLICE):
        best[a : a + _SLICE] = view[begin[a : a + _SLICE]].argmin(axis=1)
    best += begin
    return grams[best], gram_at[best], gram_at[begin]


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in a table of a power of two of entries."""
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _filter_places(marks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both bits of each mark in a table of bytes."""
    mask = np.uint64(8 * len(table) - 1)
    return (marks & mask).astype(np.int64), ((marks >> np.uint64(32)) & mask).astype(np.int64)


def phrase_counts(df: DataFrame, text: str) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in W.pieces(batches, text):
            *_, first, hashes = _words_of(batch.column(text))
            grams, _, _ = W.windows(hashes, first, PHRASE)
            table += np.bincount(_slot(grams, len(table)), minlength=len(table)).astype(np.int32)

    return np.maximum(one_table(df, count, 1 << TABLE_BITS, np.int32, np.add), 0)


def repeated_anchors(df: DataFrame, text: str, counts, size: int, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, with those of the anchors that occur at least twice set."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            *_, first, hashes = _words_of(batch.column(text))
            marks, place, _ = anchors(hashes, first, counts.value, size)
            if len(marks):
                new = np.concatenate([[True], place[1:] != place[:-1]])  # one occurrence anchors many windows
                mark, times = np.unique(marks[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int32))], ["mark", "times"])

    def fill(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> None:
        for batch in batches:
            for place in _filter_places(batch.column(0).to_numpy().view(np.uint64), table):
                np.bitwise_or.at(table, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))

    often = df.mapInArrow(found, "mark long, times int").groupBy("mark").agg(F.sum("times").alias("times")).where("times > 1").select("mark")
    return one_table(often, fill, 1 << (bits - 3), np.uint8, np.bitwise_or)


def candidates(df: DataFrame, text: str, counts, bits, size: int) -> DataFrame:
    """(name, mark, words, n, homes): pieces with a repeated anchor, once for each batch of rows, with the number of their
    occurrences there and the first eight bytes of the digests of the texts they are in; and with a null mark and its number
    of bytes each text that has one, once for each task unless a task has very many."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in W.pieces(batches, text):
            raw, starts, ends, first, hashes = _words_of(batch.column(text))
            marks, place, window = anchors(hashes, first, counts.value, size)
            if not len(marks):
                continue
            table = bits.value
            one, two = _filter_places(marks, table)
            often = ((table[one >> 3] >> (one & 7)) & (table[two >> 3] >> (two & 7)) & 1).astype(bool)
            change = np.concatenate([[True], place[1:] != place[:-1]])
            begin = np.flatnonzero(change)
            end = np.append(begin[1:], len(marks)) - 1
            keep = often[begin]
            begin, end = begin[keep], end[keep]
            whole, digests = raw.tobytes(), {}
            row = np.searchsorted(first, window[begin], "right") - 1
            entries: dict[bytes, list] = {}
            column = batch.column(text)
            low, high = starts[window[begin]].tolist(), ends[window[end] + size - 1].tolist()
            for i, r in enumerate(row.tolist()):
                words = b" ".join(whole[low[i] : high[i]].split())
                name = hashlib.blake2b(words, digest_size=16).digest()
                if r not in digests:
                    digests[r] = hashlib.md5(column[r].as_py().encode()).digest()
                entry = entries.setdefault(name, [int(marks[begin[i]].view(np.int64)), words.decode(), 0, set()])
                entry[2] += 1
                entry[3].add(_home(digests[r]))
            rows = [(name, mark, words, n, list(homes)) for name, (mark, words, n, homes) in entries.items()]
            for r, digest in digests.items():
                if digest not in sent:
                    if len(sent) >= _SLICE:
                        sent.clear()
                    sent.add(digest)
                    whole_text = column[r].as_py()
                    rows.append((digest, None, whole_text, len(whole_text), [_home(digest)]))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], ["name", "mark", "words", "n", "homes"])

    return df.mapInArrow(found, "name binary, mark long, words string, n long, homes array<long>")


def _home(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def passages(pieces: list[list[int]], times: list[int], size: int) -> list[list[tuple[int, int]]]:
    """Confirmed recurring passages of each piece: maximal runs of windows that occur twice or more, as word intervals."""
    seen: Counter = Counter()
    keys = [[tuple(p[i : i + size]) for i in range(len(p) - size + 1)] for p in pieces]
    for own, n in zip(keys, times):
        for k in own:
            seen[k] += n
    out = []
    for own in keys:
        runs, start = [], None
        for i, k in enumerate([*own, None]):
            if k is not None and seen[k] > 1:
                start = i if start is None else start
            elif start is not None:
                runs.append((start, i - 1 + size))
                start = None
        out.append(runs)
    return out


def confirmed(pieces: DataFrame, shards: int, size: int) -> DataFrame:
    """(name, passages) of the pieces that hold recurring passages, as words joined by spaces."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        known: dict[bytes, int] = {}
        rows: list[list[int]] = []
        times: list[int] = []
        for batch in batches:
            for name, words, n in zip(*(batch.column(c).to_pylist() for c in ("name", "words", "n"))):
                if name in known:
                    times[known[name]] += n
                else:
                    known[name] = len(rows)
                    rows.append([number.setdefault(w, len(number)) for w in words.split(" ")])
                    times.append(n)
        spelled = list(number)
        some = [(name, row, runs) for name, row, runs in zip(known, rows, passages(rows, times, size)) if runs]
        for a in range(0, len(some), 1_000):
            part = some[a : a + 1_000]
            texts = [[" ".join(spelled[w] for w in row[low:high]) for low, high in runs] for _, row, runs in part]
            yield pa.RecordBatch.from_arrays([pa.array([name for name, *_ in part], pa.binary()), pa.array(texts, pa.list_(pa.string()))], ["name", "passages"])

    return pieces.select("name", "mark", "words", "n").repartition(shards, "mark").mapInArrow(shard, "name binary, passages array<string>")


class Phrases:
    """An Aho-Corasick automaton over the words of passages."""

    def __init__(self, passages: Iterable[str]):
        self.number: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for passage in passages:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in passage.encode().split())
            self.automaton.add_word(words, len(words))
        if self.number:
            self.automaton.make_automaton()

    def located(self, text: str) -> list[tuple[int, int]]:
        """Word intervals that occurrences of the passages cover, united where they meet."""
        if not self.number:
            return []
        spans: list[tuple[int, int]] = []
        for end, length in self.automaton.iter(tuple(self.number.get(w, 0) for w in text.encode().split())):
            a, b = end - length + 1, end + 1
            while spans and a <= spans[-1][1]:  # by end: earlier spans may lie inside
                a = min(a, spans.pop()[0])
            spans.append((a, b))
        return spans


def occurrences(blocks: DataFrame) -> DataFrame:
    """(digest, gone) of the texts in which passages were located. ``blocks`` has (block, digest, words), every block in one
    partition and in order, its passages (null digest) before its texts; a block's passages are all that a task keeps."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, phrases, found = None, None, set(), None
        for batch in batches:
            out = []
            for own, digest, words in zip(*(batch.column(c).to_pylist() for c in ("block", "digest", "words"))):
                if own != block:
                    block, last, phrases, found = own, None, set(), None
                if digest is None:
                    phrases.add(words)
                elif digest != last:
                    found = found or Phrases(phrases)
                    phrases, last = set(), digest
                    if spans := found.located(words):
                        out.append((digest, spans))
            if out:
                spans = pa.array([[{"low": a, "high": b} for a, b in s] for _, s in out], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), spans], ["digest", "gone"])

    return blocks.mapInArrow(stream, "digest binary, gone array<struct<low: int, high: int>>")


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 35, filter_bits: int = FILTER_BITS, shard_pieces: int = SHARD_PIECES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row: the words that no repeated window of ``size`` words covers, joined by spaces.

    Windows are judged on the input: of a passage that repeats, no occurrence stays, nor of a repeated row. Null and empty texts
    and those with fewer words than a window lose nothing; an empty table gives an empty result. A very long text streams whole
    through its block's automaton. Other columns are not read.
    """
    if size < 2 * PHRASE:
        raise ValueError(f"windows have at least {2 * PHRASE} words")
    only = df.select(F.col(f"`{text}`").alias("text"))
    share = df.sparkSession.sparkContext.broadcast
    counts = share(phrase_counts(only, "text"))
    bits = share(repeated_anchors(only, "text", counts, size, filter_bits))
    scratch = Scratch(df.sparkSession)
    found = scratch.written(candidates(only, "text", counts, bits, size), "candidates")
    pieces, texts = found.where("mark is not null"), found.where("mark is null")
    passage = scratch.written(confirmed(pieces, 1 + pieces.count() // shard_pieces, size), "passages")
    blocks = 1 + (texts.agg(F.sum("n")).first()[0] or 0) // block_bytes
    block = F.pmod("home", F.lit(blocks)).alias("block")
    needed = pieces.select("name", F.explode("homes").alias("home")).select("name", block).distinct().join(passage, "name")
    stream = needed.select("block", F.lit(None).cast("binary").alias("digest"), F.explode("passages").alias("words")).union(
        texts.select(F.pmod(F.col("homes")[0], F.lit(blocks)), "name", "words"))
    # nulls, the passages, come first; equal texts follow one another
    gone = scratch.written(occurrences(stream.repartition(blocks, "block").sortWithinPartitions("block", "digest")), "gone")
    scratch.drop(found, passage)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            out: list[tuple[int, int, str]] = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                words = (t or "").encode().split()
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["low"] : s["high"]] = False
                kept = words if not spans else [w for w, k in zip(words, keep.tolist()) if k]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], [key, "n_words", "n_removed", "kept"])

    joined = rows.join(gone, "digest", "left").select("id", "text", "gone")
    return joined.mapInArrow(cut, f"`{key}` {kind}, n_words long, n_removed long, kept string")
