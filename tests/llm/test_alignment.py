"""Cross-tokenizer alignment against plain Python with the libraries."""

import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest

from gaugeframe.llm import alignment, queries

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
tokenizers_files = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def models():
    return queries.byte_model(), queries.piece_model()


class Plain:
    """Links of whole texts found token by token."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        path = tokenizers_files.path("byte_bpe_50k.json")
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
        with open(path) as f:
            self.tokens = {i: bytes(byte[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}
        self.b = SentencePieceProcessor(model_file=tokenizers_files.path("piece_bpe_32k.model"))

    def spans(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        left = [self.tokens[i] for i in a]
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [self.b.id_to_piece(i)]]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            return None

        def ends(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        return list(zip(a, ends(left))), list(zip(b, ends(right)))

    def links(self, text):
        found = self.spans(text)
        if found is None:
            return None
        a, b = found
        return [(i, j, x, y, min(xe, ye) - max(xs, ys)) for i, (x, (xs, xe)) in enumerate(a) for j, (y, (ys, ye)) in enumerate(b) if xs < ye and ys < xe]

    def groups(self, text):
        a, b = self.spans(text)
        common = sorted({e for _, (_, e) in a} & {e for _, (_, e) in b})
        start, out = 0, []
        for end in common:
            out.append(([x for x, (s, e) in a if start < e <= end], [y for y, (s, e) in b if start < e <= end]))
            start = end
        return out

    def table(self, rows):
        links = [self.links(t) for _, t in rows]
        counts = Counter((x, y) for found in links if found for _, _, x, y, _ in found)
        most = Counter()
        for (_, y), n in counts.items():
            most[y] = max(most[y], n)
        out = []
        for (key, text), found in zip(rows, links):
            if found is None:
                out.append((key, 0, 0, 0, 0, 0, 0, 0, ""))
                continue
            a, b = self.spans(text)
            groups = self.groups(text)
            written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            pairs = [(x, y) for _, _, x, y, _ in found]
            out.append((key, len(a), len(b), len(groups), len(found), sum(len(x) * len(y) for x, y in groups),
                        sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(written.encode()).hexdigest()))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def odd_texts():
    rng = random.Random(3)
    letters = "aab  \n\t<s>eth éüßñ中梦😀\x00AKIA0123.,!ĳǅ́'s"
    texts = [None, "", " ", "  ", "▁", "a▁b", "\n", " x", "<|endoftext|> and </s>", "<0x0A>", "it's  we'll", "a" * 400, " " * 300, "ab " * 200]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_odd_texts_nulls_repeats_and_clashing_columns(spark, models, plain, monkeypatch):
    rows = [*enumerate(odd_texts()), (None, "null key"), (3, "repeated id"), (3, "repeated id")]
    table = [(k, t, "x", 1) for k, t in rows]
    df = spark.createDataFrame(table, "doc_id long, text string, block string, n_a int").repartition(3)
    assert result(alignment.aligned(df, *models)) == sorted(plain.table(rows), key=str)


def test_empty_table(spark, models):
    found = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *models)
    assert found.columns == COLUMNS and found.count() == 0


def test_only_texts_without_tokens(spark, models):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert result(alignment.aligned(df, *models)) == [(i, 0, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_cuts_and_small_blocks_change_nothing(models, plain, monkeypatch):
    """Long texts in pieces, several runs a document and products in stretches, with a bad piece in the middle of one text."""
    monkeypatch.setattr(alignment, "PIECE", 20)
    monkeypatch.setattr(alignment, "RUN", 50)
    monkeypatch.setattr(alignment, "BLOCK", 300)
    rng = random.Random(5)
    words = ["the", "cat's", "été", "don't", "12", "x", "Über", "  ", "über-all", "naïve", "end.", "日本", "Then"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["some words before it ▁ and some words after it", "one two three four five six seven"] * 2
    assert list(alignment.pieces("some words before it and more")) == ["some words before it", "and more"]
    pair = alignment._loaded(*models)
    found = alignment.documents(pair, texts)
    wanted = plain.table(list(enumerate(texts)))
    assert [(d.n_a, d.n_b, d.n_groups, d.n_links, d.n_shared, d.digest.hexdigest() if d.n_a else "") for d in found] == [(*w[1:6], w[8]) for w in wanted]
    counts = [Counter(dict(zip(*(x.tolist() for x in d.pairs())))) if d.codes else Counter() for d in found]
    assert counts == [Counter(x * alignment.SIDE + y for _, _, x, y, _ in plain.links(t) or []) for t in texts]


def test_links_and_shared_groups(spark, models, plain, monkeypatch):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:80])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in alignment.links(df, *models).collect())
    assert found == sorted((k, *link) for k, t in rows for link in plain.links(t) or [])
    shared = Counter(r[0] for r in alignment.links(df, *models, shared=True).select("doc_id").collect())
    assert shared == Counter({k: sum(len(x) * len(y) for x, y in plain.groups(t)) for k, t in rows if plain.links(t)})


def test_product_against_dense_matrices():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = (rng.random((7, 9)) < 0.3).astype(int), (rng.random((9, 5)) < 0.4).astype(int)

        def csr(m):
            return alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1])

        dense = np.zeros((7, 5), int)
        for r, c, v in alignment.product(csr(a), csr(b), most=int(rng.integers(1, 20))):
            dense[r, c] += v
        assert (dense == a @ b).all()
        assert (alignment.row_sizes(csr(a), csr(b)) == (a @ b).sum(axis=1)).all()
        t = csr(b).transposed(5)
        assert (t.sizes() == b.sum(axis=0)).all()


@needs_tables
def test_query_on_the_given_table(spark, plain):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect() if r[1] is None or len(r[1]) < 4000]
    # corpus-wide figures need all rows; the per-document ones are compared for those that plain Python manages
    found = {r[0]: r for r in result(queries.QUERIES["op12_alignment"](spark, SF_DIR))}
    assert len(found) == df.count()
    for w in plain.table(rows):
        assert found[w[0]][:6] == w[:6] and found[w[0]][8] == w[8]
