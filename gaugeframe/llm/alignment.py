"""Cross-tokenizer alignment (operator 12) by products of token-byte incidence matrices.

Two tokenizers cut the same bytes of a text into tokens. The incidence matrix of each has a row per token and a column per byte, in
compressed sparse rows built by hand. The row products A * B' (Gustavson: for every byte of an A row, the row of B' with the B token
that holds it, equal columns added up) have one entry per pair of tokens that overlap: a link, whose value is the number of shared bytes. Bytes where
tokens of both end cut a text into groups; the group incidences of both sides multiply to the pairs that share a group. Only the
sizes of those rows are needed for their number (the symbolic phase of the product); ``shared_group_links`` emits the pairs themselves.

Long texts are cut where neither tokenizer can join: at a single space between two ASCII letters, which starts a token on either
side. Pieces of some PIECE characters are worked on together as runs, so memory follows the run, not the text.

How often an id pair is linked corpus-wide cannot be known in one pass. Documents are therefore written in blocks of some BLOCK bytes of
text: one row per document with its distinct pairs, and one per block with the pairs of all its documents. Pairs are counted over
all blocks, the counts are joined to the blocks' pairs, and each block's documents look theirs up. What is shuffled grows with the
blocks' distinct pairs, not with links; a frequent pair has one row per block, and Spark splits such a join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.common import Scratch

PIECE = 1 << 17
RUN = 1 << 18
BLOCK = 1 << 23
#: What a document counts in a block besides its text, so that blocks of empty texts are bounded as well.
ROW = 256
PRODUCTS = 1 << 20
#: Ids of both sides are packed into one number.
SIDE = 1 << 24
#: Pre-tokens of the byte-level vocabulary (fixed value of the format).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@dataclass(frozen=True)
class Csr:
    """Compressed sparse rows of ones: the columns of row i are columns[starts[i]:starts[i + 1]]."""

    starts: np.ndarray
    columns: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self, columns: int) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), self.sizes())
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=columns))]), rows[order])


def incidence(lengths: np.ndarray) -> Csr:
    """Rows are tokens of so many bytes, one after another; columns are bytes."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(starts, np.arange(starts[-1]))


def membership(groups: np.ndarray) -> Csr:
    """Rows are tokens, columns the one group of each."""
    return Csr(np.arange(len(groups) + 1), groups)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Multiplications that each row of a * b takes (the symbolic phase); where rows of ``b`` meet no column twice, its entries."""
    sizes = np.concatenate([[0], np.cumsum(b.sizes()[a.columns])])
    return np.diff(sizes[a.starts])


def product(a: Csr, b: Csr, most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row products a * b as (row, column, value), a stretch of rows at a time: some ``most`` multiplications, one row at least."""
    upto = np.concatenate([[0], np.cumsum(row_sizes(a, b))])
    at, rows = 0, len(a.starts) - 1
    while at < rows:
        until = max(int(np.searchsorted(upto, upto[at] + most, "right")) - 1, at + 1)
        inner = a.columns[a.starts[at] : a.starts[until]]
        row = np.repeat(np.arange(at, until), np.diff(a.starts[at : until + 1]))
        counts = b.starts[inner + 1] - b.starts[inner]
        column = W.gather(b.columns, b.starts[inner], counts)
        row = np.repeat(row, counts)
        at = until
        if not len(row):
            continue
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])])
        if (((column[1:] < column[:-1]) & (row[1:] == row[:-1]))).any():  # columns of a row out of order: sort before adding up
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (column[1:] != column[:-1])])
        first = np.flatnonzero(new)
        yield row[first], column[first], np.diff(np.append(first, len(row)))


class ByteVocabulary:
    """Tokenizer A: byte-level BPE from a file of the ``tokenizers`` library, run by ``tiktoken`` on the same vocabulary.

    Ids are ranks there, so the file's merges must be numbered in order; special tokens are plain text.
    """

    def __init__(self, content: bytes):
        import tiktoken

        model = json.loads(content)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"][x + y] for x, y in merges] != list(range(256, len(vocabulary))):
            raise ValueError("only vocabularies of 256 bytes and then the merges in their order are supported")
        self.encoding = tiktoken.Encoding("bytes", pat_str=PRE_TOKENS, mergeable_ranks=vocabulary, special_tokens={})
        self.bytes = table({i: t for t, i in vocabulary.items()})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + p) for p in pieces]


class PieceVocabulary:
    """Tokenizer B: a SentencePiece model, run by its library."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if not self.model.is_control(i) and not self.model.is_unknown(i):
                pieces[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        if any(" " in p.lstrip(b" ").decode() for p in pieces.values() if len(p) > 1):
            raise ValueError("pieces that go on after an inner space: texts cannot be cut at spaces")
        self.bytes = table(pieces)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode(pieces, num_threads=1)


def table(tokens: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids one after another, where each id's begin, and their number; an id without bytes has none."""
    size = max(tokens) + 1
    lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
    return np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8), np.cumsum(lengths) - lengths, lengths


@dataclass
class Pair:
    """Both tokenizers, and ids as text with what stands before them: nothing, ``,``, ``;`` or ``|``."""

    a: ByteVocabulary
    b: PieceVocabulary
    names: list[str] = field(default_factory=list)
    size: int = 0

    def __post_init__(self) -> None:
        self.size = max(len(self.a.bytes[2]), len(self.b.bytes[2]))
        self.names = [before + str(i) for before in ("", ",", ";", "|") for i in range(self.size)]


@functools.lru_cache(maxsize=1)
def _loaded(a: bytes, b: bytes) -> Pair:
    return Pair(ByteVocabulary(a), PieceVocabulary(b))


def pieces(text: str) -> Iterator[str]:
    """The text cut at single spaces between letters, about every PIECE characters; the spaces themselves go, as both tokenizers add one."""
    at = 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


@dataclass
class Tokens:
    """Aligned tokens of a run of pieces, one after another."""

    a: np.ndarray
    b: np.ndarray
    good: np.ndarray  # per piece: tokens of both sides give exactly its bytes
    ends_a: np.ndarray  # bytes
    ends_b: np.ndarray
    common: np.ndarray  # group ends
    group_a: np.ndarray
    group_b: np.ndarray
    piece_of_group: np.ndarray


def align(pair: Pair, run: list[str]) -> Tokens:
    """Tokens and groups of a run; pieces whose tokens don't give their bytes have none."""
    a, b = pair.a.encode(run), pair.b.encode(run)
    good = np.ones(len(run), bool)
    raw = [(" " + p).encode() for p in run]

    def side(ids: list[list[int]], vocabulary: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        flat_bytes, start, length = vocabulary
        text = W.gather(flat_bytes, start[flat], length[flat]).tobytes()
        ends = np.concatenate([[0], np.cumsum(length[flat])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        for i, want in enumerate(raw):
            if text[ends[i] : ends[i + 1]] != want:
                good[i] = False
        return flat, sizes, length

    flat_a, sizes_a, length_a = side(a, pair.a.bytes)
    flat_b, sizes_b, length_b = side(b, pair.b.bytes)
    flat_a, flat_b = flat_a[np.repeat(good, sizes_a)], flat_b[np.repeat(good, sizes_b)]
    ends_a, ends_b = np.cumsum(length_a[flat_a]), np.cumsum(length_b[flat_b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    piece_ends = np.cumsum([len(r) if g else 0 for r, g in zip(raw, good)])
    return Tokens(flat_a, flat_b, good, ends_a, ends_b, common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), np.searchsorted(piece_ends, common))


def overlap_links(pair: Pair, t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A token, B token, shared bytes) of a run: the product of the token-byte incidences."""
    a, b = incidence(pair.a.bytes[2][t.a]), incidence(pair.b.bytes[2][t.b])
    yield from product(a, b.transposed(len(b.columns)))


def shared_group_links(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A token, B token, 1) of a run for tokens in one group: the product of the group incidences."""
    yield from product(membership(t.group_a), membership(t.group_b).transposed(len(t.common)))


def shared_group_sizes(t: Tokens) -> np.ndarray:
    """How many B tokens share each A token's group."""
    return row_sizes(membership(t.group_a), membership(t.group_b).transposed(len(t.common)))


def _group_text(pair: Pair, t: Tokens, piece_a: np.ndarray, piece_b: np.ndarray, count: int) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each piece: tokens of both sides in the order of groups, A before B."""
    starts_a, starts_b = np.searchsorted(t.group_a, np.arange(len(t.common) + 1)), np.searchsorted(t.group_b, np.arange(len(t.common) + 1))
    code = np.empty(len(t.a) + len(t.b), np.int64)
    first_a, first_b = np.zeros(len(t.a), bool), np.zeros(len(t.b), bool)
    first_a[starts_a[:-1]] = first_b[starts_b[:-1]] = True
    mark_a = np.where(first_a, 2, 1)
    new = np.concatenate([[True], piece_a[1:] != piece_a[:-1]]) if len(t.a) else np.zeros(0, bool)
    mark_a[new] = 0
    place_a = np.arange(len(t.a)) + starts_b[t.group_a]
    place_b = np.arange(len(t.b)) + starts_a[t.group_b + 1]
    code[place_a] = t.a + mark_a * pair.size
    code[place_b] = t.b + np.where(first_b, 3, 1) * pair.size
    words = list(map(pair.names.__getitem__, code.tolist()))
    sizes = np.bincount(piece_a, minlength=count) + np.bincount(piece_b, minlength=count)
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    return ["".join(words[x:y]) for x, y in zip(at[:-1], at[1:])]


class _Document:
    """What has been found of one document so far."""

    def __init__(self) -> None:
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.n_shared = True, 0, 0, 0, 0, 0
        self.digest, self.codes, self.counts = hashlib.sha256(), [], []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) == 1:
            return self.codes[0], self.counts[0]
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        return codes, np.bincount(at, np.concatenate(self.counts)).astype(np.int64)


def _work(pair: Pair, run: list[str], owners: np.ndarray, docs: list[_Document]) -> None:
    """Align the pieces of a run, which belong to the documents ``owners`` (ascending)."""
    t = align(pair, run)
    for i in np.flatnonzero(~t.good):
        docs[owners[i]].good = False
    if not len(t.a):
        return
    piece_a, piece_b = t.piece_of_group[t.group_a], t.piece_of_group[t.group_b]
    texts = _group_text(pair, t, piece_a, piece_b, len(run))
    count_a, count_b = np.bincount(piece_a, minlength=len(run)), np.bincount(piece_b, minlength=len(run))
    groups = np.bincount(t.piece_of_group, minlength=len(run))
    shared = np.bincount(piece_a, shared_group_sizes(t), minlength=len(run)).astype(np.int64)
    owner_a = owners[piece_a]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for left, right, _ in overlap_links(pair, t):
        found.append((owner_a[left], t.a[left] * SIDE + t.b[right]))
    doc, code = np.concatenate([d for d, _ in found]), np.concatenate([c for _, c in found])
    links = np.bincount(doc, minlength=owners[-1] + 1)
    for i in np.flatnonzero(t.good):
        d = docs[owners[i]]
        d.digest.update(((";" if d.n_a else "") + texts[i]).encode())
        d.n_a += int(count_a[i])
        d.n_b += int(count_b[i])
        d.n_groups += int(groups[i])
        d.n_shared += int(shared[i])
    at = np.searchsorted(doc, np.arange(owners[0], owners[-1] + 2))
    for i, o in enumerate(range(owners[0], owners[-1] + 1)):
        if at[i + 1] > at[i]:
            codes, counts = np.unique(code[at[i] : at[i + 1]], return_counts=True)
            docs[o].codes.append(codes)
            docs[o].counts.append(counts)
            docs[o].n_links += int(links[o])


def documents(pair: Pair, texts: list[str | None]) -> list[_Document]:
    """Align whole texts, in runs of some RUN characters."""
    docs, run, owners, size = [_Document() for _ in texts], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            docs[i].good = False
            continue
        for piece in pieces(text):
            run.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= RUN:
                _work(pair, run, np.array(owners), docs)
                run, owners, size = [], [], 0
    if run:
        _work(pair, run, np.array(owners), docs)
    for i, d in enumerate(docs):
        if not d.good:
            docs[i] = _Document()
    return docs


def _packed(values: list[np.ndarray], kind: type) -> pa.Array:
    return pa.array([zlib.compress(v.astype(kind).tobytes(), 1) for v in values], pa.binary())


def _unpacked(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(value), kind)


_DIGEST = "groups_sha256"
_FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def _blocks(df: DataFrame, a: bytes, b: bytes, key: str, text: str) -> DataFrame:
    """Rows of two kinds: documents with their pairs as places in their block's list, and the blocks' lists (``codes``)."""
    kind = df.schema[key].dataType.simpleString()
    names = ["block", "id", *_FIGURES, _DIGEST, "places", "counts", "codes"]
    schema = f"block long, id {kind}, " + ", ".join(f"{c} long" for c in _FIGURES) + f", {_DIGEST} string, places binary, counts binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _loaded(a, b), TaskContext.get().partitionId() << 32

        def full(ids: list[pa.Array], docs: list[_Document]) -> pa.RecordBatch:
            own = [d.pairs() if d.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for d in docs]
            codes, at = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, n in own]), minlength=len(codes)).astype(np.int64)
            cuts = np.cumsum([len(c) for c, _ in own])[:-1]
            columns = [pa.array([number] * (len(docs) + 1)), pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)])]
            columns += [pa.array([getattr(d, c) for d in docs] + [None], pa.int64()) for c in _FIGURES]
            columns.append(pa.array([d.digest.hexdigest() if d.n_a else "" for d in docs] + [None], pa.string()))
            columns.append(pa.concat_arrays([_packed([np.diff(x, prepend=0) for x in np.split(at, cuts)], np.int32), pa.nulls(1, pa.binary())]))
            columns.append(_packed([n for _, n in own] + [total], np.int64))
            columns.append(pa.concat_arrays([pa.nulls(len(docs), pa.binary()), _packed([np.diff(codes, prepend=0)], np.int64)]))
            return pa.RecordBatch.from_arrays(columns, names)

        ids, docs, size = [], [], 0
        for batch in W.pieces(batches, text):
            ids.append(batch.column("id"))
            docs += documents(pair, batch.column(text).to_pylist())
            size += (pc.sum(pc.binary_length(batch.column(text))).as_py() or 0) + ROW * batch.num_rows
            if size >= BLOCK:
                yield full(ids, docs)
                ids, docs, size = [], [], 0
                number += 1
        if docs:
            yield full(ids, docs)

    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias(text)).mapInArrow(run, schema)


def _links_of_blocks(blocks: DataFrame) -> DataFrame:
    """(block, place, a, b, n): the distinct id pairs of each block and how many of its links hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, codes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "codes", "counts"))):
                code, n = np.cumsum(_unpacked(codes, np.int64)), _unpacked(counts, np.int64)
                for at in range(0, len(code), 1 << 16):
                    part = code[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array((part // SIDE).astype(np.int32)), pa.array((part % SIDE).astype(np.int32)), pa.array(n[at : at + len(part)])],
                        ["block", "place", "a", "b", "n"])

    return blocks.where("codes is not null").select("block", "codes", "counts").mapInArrow(run, "block long, place int, a int, b int, n long")


def pair_counts(spans: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each id pair linked, and whether no other A id has more links with its B id."""
    counts = spans.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(df: DataFrame, a: bytes, b: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256), one row for each row of ``df``.

    ``a`` is the content of a byte-level BPE file, ``b`` that of a SentencePiece model. Null and empty texts, and texts whose tokens
    of either side don't give a space and the text, have zeros and an empty digest. Repeated rows and ids count as often as they come.
    Other columns are not read, so their names may clash. An empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession)
    blocks = scratch.written(_blocks(df, a, b, key, text), "blocks")
    spans = scratch.written(_links_of_blocks(blocks), "pairs")
    counts = scratch.written(pair_counts(spans), "counts")
    known = spans.join(counts, ["a", "b"]).select("block", "place", "count", "best")
    figures = [*_FIGURES, _DIGEST]
    kind = blocks.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in _FIGURES) + f", n_best long, count_sum long, {_DIGEST} string"

    def look_up(docs: pa.Table, found: pa.Table) -> pa.Table:
        place = found.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy().astype(np.int64)
        n_best, total = [], []
        for places, times in zip(docs.column("places").to_pylist(), docs.column("counts").to_pylist()):
            at, n = np.cumsum(_unpacked(places, np.int32)), _unpacked(times, np.int64)
            n_best.append(int((best[at] * n).sum()))
            total.append(int((count[at] * n).sum()))
        columns = [docs.column("id"), *(docs.column(c) for c in _FIGURES), pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), docs.column(_DIGEST)]
        return pa.Table.from_arrays(columns, ["id", *_FIGURES, "n_best", "count_sum", _DIGEST])

    rows = blocks.where("codes is null").select("block", "id", *figures, "places", "counts")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(look_up, schema).withColumnRenamed("id", key)


def links(df: DataFrame, a: bytes, b: bytes, key: str = "doc_id", text: str = "text", shared: bool = False) -> DataFrame:
    """(key, a_place, b_place, a, b, bytes): one row per overlap link, or (``shared``) per pair of tokens in one group, of every text that
    is aligned; places count a text's tokens from 0. Pairs of a group are as many as its tokens of either side multiplied."""
    kind = df.schema[key].dataType.simpleString()
    names = ["id", "a_place", "b_place", "a", "b", "bytes"]

    def of_text(pair: Pair, text: str) -> Iterator[tuple[np.ndarray, ...]]:
        if not all(align(pair, [p]).good[0] for p in pieces(text)):
            return
        before_a = before_b = 0
        for piece in pieces(text):
            t = align(pair, [piece])
            for left, right, value in shared_group_links(t) if shared else overlap_links(pair, t):
                yield left + before_a, right + before_b, t.a[left], t.b[right], value
            before_a, before_b = before_a + len(t.a), before_b + len(t.b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(a, b)
        for batch in W.pieces(batches, text):
            for i, value in enumerate(batch.column(text).to_pylist()):
                for found in of_text(pair, value) if value else ():
                    own = batch.column("id").take(pa.array(np.full(len(found[0]), i)))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(x.astype(np.int64)) for x in found)], names)

    schema = f"id {kind}, a_place long, b_place long, a long, b long, bytes long"
    return df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias(text)).mapInArrow(run, schema).withColumnRenamed("id", key)
