"""SentencePiece encoding and decoding (operator 3) by vectorised merge rounds.

The merges of byte-pair encoding never cross the start of a run of spaces, so a text is cut into words there, every
different word of a batch is encoded once, and all of them together as flat numpy arrays of symbols. Each round takes
the smallest pair rank of every word (a segmented minimum), merges all its occurrences from the left at once and drops
words without any pair left. Where merging several occurrences at once could differ from merging one after another
(equal ranks, or a piece that can join a neighbour at no higher rank than its own), only the leftmost is merged in a
round. Words of over LONG_WORD symbols, whose rounds would be quadratic, follow the same order of merges with a heap.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.common import lists

MARK = "▁"
NONE = np.int64(2**62)
LONG_WORD = 1_000
CACHE_WORDS = 250_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """Vocabulary, merge table and word cache of one model."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor  # reads the vocabulary; encodes nothing

        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        kind = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0 for i in range(n)])
        if any(sp.is_unused(i) for i in range(n)) or sp.normalize("Ａ ﬁ́  a ") not in ("Ａ ﬁ́  a ", MARK + "Ａ" + MARK + "ﬁ́" + MARK * 2 + "a" + MARK):
            raise ValueError("only models without unused pieces and with the identity normaliser are supported")
        own = {p: i for i, p in enumerate(names) if kind[i] == 0}
        self.prefix = sp.encode("a", out_type=str)[:1] != ["a"]
        self.unknown = int(sp.unk_id())
        self.size = n
        self.bytes = np.full(256, -1, np.int64)
        for i in np.flatnonzero(kind == 1):
            self.bytes[int(names[i][3:5], 16)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = -np.unique(-scores)  # descending
        rank = np.searchsorted(-order, -scores).astype(np.int64)
        self.symbol = np.arange(0x110000, dtype=np.int64) + n  # characters without a piece
        for p, i in own.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[0x20] = self.symbol[ord(MARK)]
        self.span = n + 0x110000

        def part(p: str) -> int | None:
            return own.get(p, int(self.symbol[ord(p)]) if len(p) == 1 else None)

        keys, made = [], []
        for p, i in own.items():
            for cut in range(1, len(p)):
                a, b = part(p[:cut]), part(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    made.append(i)
        sort = np.argsort(keys)
        self.keys, self.made = np.array(keys)[sort], np.array(made)[sort]
        self.rank = rank
        shared = np.bincount(rank[list(own.values())], minlength=len(order)) > 1
        self.single = shared[rank]
        for side in (self.keys // self.span, self.keys % self.span):
            inner = side < n
            early = inner & (rank[self.made] <= rank[np.where(inner, side, 0)])
            self.single[side[early]] = True

        long = "".join(p for p in own if len(p) > 1)
        stops = "".join(c for c in "\t\n\r" if c not in long)
        crossing = any(MARK in p.lstrip(MARK) for p in own)
        self.pattern = re.compile(r"(?s).+" if crossing else rf" *[^ {stops}]+|[{stops}]| +" if stops else r" *[^ ]+| +")
        surface = [b"" if kind[i] == 2 else " ⁇ ".encode() if kind[i] == 3 else bytes([int(p[3:5], 16)]) if kind[i] == 1 else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.text = np.frombuffer(b"".join(surface), np.uint8)
        self.text_size = np.array([len(s) for s in surface])
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.spaced = np.array([kind[i] == 0 and p.startswith(MARK) for i, p in enumerate(names)])
        self.silent = kind == 2
        self.only = np.array([kind[i] == 0 and p == MARK for i, p in enumerate(names)])
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NONE if there is no such piece."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[at]
        return np.where(self.keys[at] == key, self.rank[made], NONE), made

    def _rounds(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words of ``counts`` symbols; the merged symbols and counts in the same order."""
        number = np.arange(len(counts))
        done_symbols, done_word = [], []
        word = np.repeat(number, counts)
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], made[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.minimum.reduceat(rank, starts)
            go = np.repeat(least < NONE, sizes)
            if not go.all():
                done_symbols.append(symbols[~go])
                done_word.append(word[~go])
                symbols, word, rank, made = symbols[go], word[go], rank[go], made[go]
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(least, sizes)
            at = np.flatnonzero(hit)
            # of pairs that overlap, every other one, counted from the left
            new_run = np.concatenate([[True], np.diff(at) != 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            at = at[np.where(self.single[made[at]], first, (np.arange(len(at)) - run_start) % 2 == 0)]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            changed = np.zeros(len(symbols) + 1, bool)
            changed[moved] = changed[moved - 1] = True  # at -1: the spare place
            touched = np.flatnonzero(changed[:-1])
            rank[touched] = NONE
            if touched[-1] == len(word) - 1:
                touched = touched[:-1]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched], made[touched] = self._pairs(symbols[touched], symbols[touched + 1])
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_word)
        sort = np.argsort(word, kind="stable")
        return symbols[sort], np.bincount(word, minlength=len(counts))

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """The same merges one after another, for one long word."""
        sym, size = symbols.tolist(), len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank, made = self._pairs(symbols[:-1], symbols[1:])
        queue = [(r, i, m, a, b) for i, (r, m, a, b) in enumerate(zip(rank.tolist(), made.tolist(), sym, sym[1:])) if r < NONE]
        heapq.heapify(queue)
        while queue:
            _, i, m, a, b = heapq.heappop(queue)
            j = after[i] if sym[i] >= 0 else size
            if j >= size or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else size
                if y < size:
                    at = int(np.searchsorted(self.keys, sym[x] * self.span + sym[y]))
                    if at < len(self.keys) and self.keys[at] == sym[x] * self.span + sym[y]:
                        heapq.heappush(queue, (int(self.rank[self.made[at]]), x, int(self.made[at]), sym[x], sym[y]))
        return np.array([s for s in sym if s >= 0], np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encode words and keep their ids."""
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        counts = np.fromiter(map(len, new), np.int64, len(new))
        symbols = self.symbol[points]
        long = counts > LONG_WORD
        if long.any():
            starts = np.cumsum(counts) - counts
            short, short_counts = self._rounds(symbols[np.repeat(~long, counts)], counts[~long])
            found, at = [None] * len(new), 0
            for i, size in zip(np.flatnonzero(~long), short_counts):
                found[i] = short[at : at + size]
                at += size
            for i in np.flatnonzero(long):
                found[i] = self._heap(symbols[starts[i] : starts[i] + counts[i]])
            symbols, counts = np.concatenate(found), np.array([len(f) for f in found])
        else:
            symbols, counts = self._rounds(symbols, counts)
        odd = symbols >= self.size
        if odd.any():
            point = symbols[odd] - self.size
            if self.bytes[0] < 0:
                symbols = np.where(odd, self.unknown, symbols)
            else:
                width = np.ones(len(symbols), np.int64)
                width[odd] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
                raw = np.frombuffer("".join(map(chr, point.tolist())).encode(), np.uint8)
                word = np.repeat(np.repeat(np.arange(len(counts)), counts), width)
                symbols = np.repeat(symbols, width)
                symbols[np.repeat(odd, width)] = self.bytes[raw]
                counts = np.bincount(word, minlength=len(counts))
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(new))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, symbols.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and where each text's begin (with the end of the last). Null counts as empty."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        lead = " " if self.prefix else ""
        found = [self.pattern.findall(lead + t.replace(MARK, " ")) if t else [] for t in texts]
        new = set().union(*found).difference(self.known)
        if new:
            self._learn(list(new))
        known = self.known
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        word = np.array(list(map(known.__getitem__, chain.from_iterable(found))), np.int64)
        counts = self.counts[word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return W.gather(self.ids, self.starts[word], counts), ends[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids: pieces joined, marks as spaces, the one added in front taken away again."""
        size = self.text_size[ids]
        raw = W.gather(self.text, self.text_start[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            at, last = int(offsets[i]), int(offsets[i + 1])
            while at < last and self.silent[ids[at]]:
                at += 1
            cut = 1 if self.prefix and at < last and self.spaced[ids[at]] else 0
            out.append(raw[a + cut : b].decode("utf-8", "each_byte"))
        return out


_loaded: dict[bytes, Pieces] = {}


def pieces_of(proto: bytes) -> Pieces:
    """The model, loaded once in each Python process."""
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    """A model file of some 0.5 MB, read on the driver and sent to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def _others(df: DataFrame, *without: str) -> list:
    return [f for f in df.schema.fields if f.name not in without]


def encode(df: DataFrame, proto: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids`` array<int>; a column of that name is replaced. Null and empty texts have no ids."""
    kept = [f.name for f in _others(df, ids)]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(proto)
        for batch in W.pieces(batches, text):
            flat, offsets = model.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists(flat, offsets, pa.int32())], [*kept, ids])

    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, schema)


def decode(df: DataFrame, proto: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and the ``decoded`` text; a column of that name is replaced. Null ids count as none."""
    kept = [f.name for f in _others(df, decoded)]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(decoded, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(proto)
        for batch in batches:
            rows = [x or [] for x in batch.column(ids).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            texts = model.decode(np.array([i for x in rows for i in x], np.int64), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], [*kept, decoded])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def round_trip(df: DataFrame, proto: bytes, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Key, number of ids, digest of the ids and digest of the text decoded from them, in one pass without a shuffle; the
    ids themselves as well if asked for.

    Repeated rows give repeated results; null and empty texts have no ids and an empty decoded text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces_of(proto)
        names = [str(i) for i in range(model.size)]
        for batch in W.pieces(batches, text):
            ids, offsets = model.encode(batch.column(text).to_pylist())
            decimal, at = [names[i] for i in ids.tolist()], offsets.tolist()
            own = [hashlib.sha256(",".join(decimal[a:b]).encode()).hexdigest() for a, b in zip(at[:-1], at[1:])]
            back = [hashlib.sha256(t.encode()).hexdigest() for t in model.decode(ids, offsets)]
            columns = {key: batch.column(key), "n_tokens": pa.array(np.diff(offsets)), "ids_sha256": pa.array(own), "decoded_sha256": pa.array(back)}
            if with_ids:
                columns["ids"] = lists(ids, offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
