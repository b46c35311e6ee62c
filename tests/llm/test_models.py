"""Tokenizer, chat format, classifier, vector searches and pipeline."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import chat, common, learned_partitions, metric_tree, mixing, quality, queries, sentencepiece

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("public_tokenizers")
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model(library):
    return sentencepiece.pieces_of(library.serialized_model_proto())


def odd_texts():
    rng = random.Random(1)
    letters = "aab  \n\t▁<s>eth éüßñ中梦😀\x00AKIA0123.,!ĳǅ́"
    texts = [None, "", " ", "  ", "▁", "\n", " \n ", "a" * 3000, " " * 3000, "ab " * 2000 + "x" * 1500, "</s>[INST]", "<0x0A>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * j for k in range(40) for j in range(3)]
    return texts + ["".join(rng.choice("abcdeths0189+/") for _ in range(1400)) for _ in range(5)]


def test_ids_and_texts_are_those_of_the_library(library, model):
    texts = odd_texts()
    ids, at = model.encode(texts)
    wanted = library.encode([t or "" for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted
    assert model.decode(ids, at) == [library.decode(w) for w in wanted]


def test_decoding_of_any_ids(library, model):
    rng = random.Random(2)
    rows = [[rng.choice([*range(0, 260), 29871, 319, 30672]) for _ in range(rng.randrange(1, 9))] for _ in range(3000)]
    rows = [r for r in rows if not {0, 1, 2} & set(r)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert model.decode(np.array([i for r in rows for i in r]), at) == [library.decode(r) for r in rows]


def test_heap_and_rounds_agree(model, monkeypatch):
    texts = [t for t in odd_texts() if t and len(t) < 1500]
    first = model.encode(texts)
    monkeypatch.setattr(sentencepiece, "LONG_WORD", 2)
    model._clear()
    second = model.encode(texts)
    model._clear()
    assert all(np.array_equal(a, b) for a, b in zip(first, second))


def test_encode_and_decode_tables(spark, library):
    proto = library.serialized_model_proto()
    rows = [(1, "Hello wörld\n", 5), (2, None, 6), (2, None, 6), (3, "", None), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = sentencepiece.encode(df, proto)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = sentencepiece.decode(coded, proto).collect()
    assert sorted([(r.doc_id, r.decoded) for r in back], key=str) == sorted([(1, "Hello wörld\n"), (2, ""), (2, ""), (3, ""), (None, "x")], key=str)
    whole = sentencepiece.round_trip(df, proto, with_ids=True).collect()
    for r in whole:
        text = {1: rows[0][1], 2: "", 3: "", None: "x"}[r.doc_id]
        ids = library.encode(text)
        assert (r.n_tokens, r.ids, r.decoded_sha256) == (len(ids), ids, hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece.round_trip(df.limit(0), proto).collect() == []


CONTROL = "</s>[INST] ok [/INST] <|end|> \\ <\\ |> <|user|>"


def conversations():
    rng = random.Random(3)
    out = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (7, 0, None, None), (7, None, "assistant", "é😀"), (8, 3, "a|>b", "x" * 30_000), (8, 3, "a|>b", "x" * 30_000)]
    for c in range(10, 60):
        for t in range(rng.randrange(1, 6)):
            out.append((c, t, "assistant" if t % 2 else "user", rng.choice(["hi", "", "yes", CONTROL])))
    return out


def grouped(rows):
    found = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((r or "", x or ""))
    return found


def test_chat_format_reads_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1) for r in [*rows, (None, 0, "user", "nobody's")]], "conv_id long, turn long, role string, text string, idx int").repartition(4)
    nodes, paths = chat.prefix_tree(df)
    got = {r.conv_id: r for r in chat.read_back(nodes, paths).collect()}
    wanted = grouped(rows)
    assert set(got) == set(wanted)
    for c, turns in wanted.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for r, x in turns)
        assert (got[c].n_turns, got[c].loss_chars, got[c].turns_sha256, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(f"<|{chat.escape(r)}|>{chat.escape(x)}{chat.END}") for r, x in turns)
    assert chat.read_back(*chat.prefix_tree(df.limit(0))).collect() == []


def test_shared_turns_are_emitted_once_depth_first(spark):
    rows = conversations()
    nodes, paths = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    prefixes = {tuple(t[: i + 1]) for t in grouped(rows).values() for i in range(len(t))}
    emitted = chat.depth_first(nodes, paths).collect()
    assert len(emitted) == len(prefixes)
    seen, roots = {}, []
    for r in emitted:
        # positions go on from the parent's end, and all ancestors have been emitted before
        steps = [s for s in r.attends if s.position_from < r.position_from or s.segment == r.segment]
        assert steps[0].position_from == 0 and all(a.position_to == b.position_from for a, b in zip(steps, steps[1:]))
        for s in steps:
            assert s.segment == r.segment or seen[s.segment] >= s.position_to
        assert r.position_to - r.position_from == len(r.formatted)
        seen[r.segment] = r.position_to
        if not roots or roots[-1] != steps[0].segment:
            roots.append(steps[0].segment)
    assert len(roots) == len(set(roots))  # one tree after another


def test_conversations_are_read_back_from_the_emission(spark):
    """The emitted nodes and the ends alone give the same turns as the tree's own paths; equal conversations share all their nodes."""
    rows = [*conversations(), *((1000 + c, t, "user", f"turn {t}") for c in range(30) for t in range(1 + c % 5))]
    nodes, paths = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    emitted = chat.depth_first(nodes, paths)
    for r in emitted.collect():
        assert r.attends[-1].segment == r.segment and (r.attends[-1].idx_to, r.attends[-1].position_to) == (r.idx, r.position_to)
        assert r.attends[0].idx_from == 0 and all(a.idx_to + 1 == b.idx_from for a, b in zip(r.attends, r.attends[1:]))
    got = chat.read_back(emitted, chat.attended(emitted, chat.ends(paths))).collect()
    assert len(got) == len(grouped(rows)) and sorted(got) == sorted(chat.read_back(nodes, paths).collect())
    empty = chat.depth_first(nodes.limit(0), paths.limit(0))
    assert empty.collect() == [] and chat.attended(empty, chat.ends(paths.limit(0))).collect() == []


def test_escapes_leave_no_control_string():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", ">", "[", "\\", "end", "<|end|>", "é"]) for _ in range(rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in ("<|", "|>", "<s", "[INST", "[/", "</"))


def test_classifier_on_held_out_documents(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        w = [rng.choice(["the", "river", "runs", "slowly", "past", "old", "mills"]) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 40)]), "s"))
        labels.append((i, int(good), 0))
    labels += [(1, None, 0), (None, 1, 0), (99_999, 1, 0)]
    docs = spark.createDataFrame([*rows, (9000, None, "s"), (9001, "", None), (None, "x", "s")], "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    fitted = quality.train(docs, marks)
    again = quality.train(docs.repartition(5), marks)
    assert np.array_equal(fitted.table, again.table)
    scored = quality.score(docs, fitted).withColumn("held", quality.held_out("doc_id")).collect()
    assert len(scored) == 603 and all(0 <= r.score <= 1 for r in scored)
    truth = {i: g for i, g, _ in labels}
    held = [r for r in scored if r.held and r.doc_id in truth]
    assert len(held) > 150 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.98
    none = quality.train(docs, marks.limit(0))
    assert quality.score(docs.limit(0), none).collect() == [] and set(none.scores(["a", None])) == {0.5}


def test_repeated_documents_are_one_example(spark, monkeypatch):
    """A labelled id that many rows repeat, with texts of their own, counts once, and always with the same text."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"text of {i}") for i in ids] + [(ids[0], f"other text {n}") for n in range(300)] + [(ids[0], None), (ids[1], f"text of {ids[1]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda examples: seen.append([(b.tolist(), c.tolist(), y) for b, c, y in examples]))
    quality.train(df, marks)
    quality.train(df.repartition(7), marks)
    assert len(seen[0]) == len(ids) and seen[0] == seen[1]


def vectors(n, rng, width=8):
    x = rng.normal(size=(n, width))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows hold one vector
    return x


def vector_table(spark, x, ids=None):
    rows = [(int(i), [float(c) for c in v], 0) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    width = x.shape[1]
    odd = [(10_000, None, 0), (10_020, [0.0] * width, 0), (10_040, [float("nan")] * width, 0), (10_060, [float("inf")] + [1.0] * (width - 1), 0), (10_080, [None] + [1.0] * (width - 1), 0), (None, [1.0] * width, 0)]
    return spark.createDataFrame([*rows, *odd, rows[-1], rows[0]], "vec_id long, embedding array<double>, score int").repartition(3)


def exact(x, ids, asked, k):
    out = {}
    for q in asked:
        s = {i: v for i, v in zip(ids, (x @ x[ids.index(q)]).tolist()) if i != q}
        out[q] = sorted(((i, v) for i, v in s.items()), key=lambda p: (-p[1], p[0]))[:k]
    return out


def test_learned_partitions(spark, monkeypatch):
    x = vectors(900, np.random.default_rng(1))
    monkeypatch.setattr(learned_partitions, "BLOCK_ROWS", 100)
    monkeypatch.setattr(learned_partitions, "BLOCK_QUERIES", 20)
    got = learned_partitions.search(vector_table(spark, x), F.col("id") % 20 == 0, 20, parts=6).collect()
    wanted = exact(x, list(range(900)), range(0, 900, 20), 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(wanted)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 21)) and q not in {i for _, i, _ in near}
        assert all(s == pytest.approx(float(x[i] @ x[q])) for _, i, s in near)
        assert all((-a[2], a[1]) < (-b[2] + 1e-12, b[1]) or a[2] > b[2] for a, b in zip(near, near[1:]))
        hits += sum(s >= wanted[q][-1][1] - 1e-9 for _, _, s in near)
    assert hits >= 0.9 * 20 * len(wanted)
    few = learned_partitions.search(vector_table(spark, x[:3]), F.col("id") == 0, 20).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(i + 1, j) for i, (j, _) in enumerate(exact(x[:3], [0, 1, 2], [0], 20)[0])]
    assert learned_partitions.search(vector_table(spark, x[:4]).limit(0), F.col("id") == 0).collect() == []


def test_queries_in_small_parts_get_all_they_ask_for(spark, monkeypatch):
    """Thirty parts of some five vectors each, of which a query would visit one."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8))
    monkeypatch.setattr(learned_partitions, "fit", lambda *args: learned_partitions.Router(np.random.default_rng(5).normal(size=(9, 30)), 1))
    for rows, wanted in ((150, 20), (12, 11)):
        got = learned_partitions.search(vector_table(spark, x[:rows]), F.col("id") % 5 == 0, 20).collect()
        assert Counter(r.query_id for r in got) == dict.fromkeys(range(0, rows, 5), wanted)


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(1000, 6))
    near = learned_partitions.neighbours(x, x, 8, True)
    part = learned_partitions.balanced_parts(x, near, 7)
    assert np.bincount(part, minlength=7).max() <= 1.05 * 1000 / 7 * 2 and len(set(part.tolist())) == 7
    inside = np.mean(part[near] == part[:, None])
    assert inside > 2 / 7


@pytest.mark.parametrize("scale, shard_rows", [(4, 40), (1024, 60), (1e12, 10_000)])
def test_metric_tree(spark, monkeypatch, scale, shard_rows):
    """Few distinct integers give ties; the largest scale needs integers beyond doubles."""
    rng = np.random.default_rng(3)
    x = np.vstack([vectors(200, rng), rng.normal(size=(150, 8)) * 0.1 + 3])
    monkeypatch.setattr(metric_tree, "BLOCK_QUERIES", 3)
    got = metric_tree.search(vector_table(spark, x), F.col("id") % 50 == 0, 10, scale=scale, shard_rows=shard_rows, pivot_rows=50).collect()
    whole = {i: [int(c) for c in np.floor(scale * v)] for i, v in enumerate(x)} | {10_020: [0] * 8}
    for q in [*range(0, 350, 50), 10_020]:
        if q % 50:
            continue
        s = sorted(((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q), key=lambda p: (-p[0], p[1]))[:10]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(n + 1, i, v) for n, (v, i) in enumerate(s)]
    assert metric_tree.search(vector_table(spark, x[:4]).limit(0), F.col("id") == 0).collect() == []


def test_tree_passes_over_pages(monkeypatch):
    """Clustered rows: most scores are never computed."""
    rng = np.random.default_rng(4)
    x = np.floor(np.vstack([rng.normal(size=(200, 8)) + 100 * c for c in rng.normal(size=(20, 8))]) * 100)
    top = float((x * x).sum(axis=1).max())
    monkeypatch.setattr(metric_tree, "PAGE", 32)
    tree, seen = metric_tree.Tree(np.arange(len(x)), x, top), []
    plain = metric_tree.products
    monkeypatch.setattr(metric_tree, "products", lambda rows, q, largest: (seen.append(len(rows)), plain(rows, q, largest))[1])
    for i in range(0, len(x), 400):
        found = tree.search(x[i], 5, float(x[i] @ x[i]) + top, np.inf)
        assert found == sorted(((int(s), n) for n, s in enumerate(x @ x[i])), key=lambda p: (-p[0], p[1]))[:5]
    assert sum(seen) < 0.5 * 10 * len(x)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(50, 120)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 300), (None, 1), (7, 7)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges if None not in e for v in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


@needs_tables
@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_equals_sql(spark, name):
    from tests.check_queries import database, difference

    assert difference(queries.QUERIES[name](spark, SF_DIR), database(SF_DIR), queries.CHECKS[name]) is None


@needs_tables
def test_registered_queries_return_all_documents(spark):
    n = common.read(spark, SF_DIR, "documents").count()
    for name in ("op3_sentencepiece", "op5_secret_scan", "op6_pii", "op7_quality", "op8_mixing"):
        assert queries.QUERIES[name](spark, SF_DIR).count() == n


def test_pipeline_stages(spark, tmp_path, library):
    """Every decision takes effect, on clean, rejected, copied and secret documents with nulls among them."""
    import corpus_pipeline

    rng = random.Random(11)

    def prose(n):
        return " ".join(rng.choice(["river", "stone", "bridge", "mill", "field", "road", "rain", "winter", "garden", "letter"]) + rng.choice(["", "s"]) for _ in range(n))

    rows = [(i, prose(60), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(50).split()), "en", "s0", 1) for i in range(30)]
    rows += [(200 + i, rows[i][1] + " end", "en", "s1", 1) for i in range(10)] + [(300, "token = abcdefgh12345 " + prose(40), "en", None, 1), (301, None, None, None, None), (302, "", "en", "s0", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(40), *range(100, 125)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = common.read(spark, str(tmp_path), "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns
    ids = {name: sorted(r.doc_id for r in found) for name, found in kept.items()}
    assert set(ids["quality"]) == {*range(60), *range(200, 210), 300, 301, 302} and ids["quality"].count(5) == 2
    assert ids["near_duplicates"] == [*range(60), 300, 301, 302] == ids["secrets"]
    secret = next(r for r in kept["secrets"] if r.doc_id == 300)
    assert secret.text.startswith("[SECRET] ") and secret.n_chars == len(secret.text)
    assert {301, 302} <= set(ids["mixture"]) <= set(ids["secrets"]) and len(ids["mixture"]) > len(set(ids["mixture"]))
    text = {r.doc_id: r.text or "" for r in kept["secrets"]}
    assert ids["tokens"] == ids["mixture"] and all(r.ids == library.encode(text[r.doc_id]) for r in kept["tokens"])
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).collect() == []


def test_mixture_stage_counts_copies_by_row(spark):
    """Rows that share an id, or have none, and rows that agree in all columns: the words that come out are those of the plan."""
    import corpus_pipeline

    rows = [(None if i % 2 else i // 10, f"w{i // 4} word " * (1 + i % 3), "en", "a" if i < 500 else "b", i % 5) for i in range(600)]
    rows += [(None, "same words", "en", "a", 1)] * 200 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, times long")
    out = corpus_pipeline.mix_sources(spark, docs, "").collect()
    plan = {r.source: r for r in mixing.mix(docs).select("source", "source_size", "target").distinct().collect()}
    for source in "ab":
        mine = sum(len((r.text or "").split()) for r in out if r.source == source)
        assert 0 <= plan[source].target - mine < 7
    assert sum(r.text is None for r in out) >= 3 and set(map(str, out)) <= set(map(str, docs.collect()))
