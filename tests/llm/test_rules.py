"""Quality rules: statistics against plain Python, and learned lists."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import decision_list as D
from gaugeframe.llm import queries
from gaugeframe.llm.quality import held_out

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "b", "ab", "Ñu", "日本", "#x", "a|b", "\n", "\n\n", " \n", "\t", "\x0b", "\x85", "12", "<>", "!", "x\r\n", " "]
    texts = [None, "", " ", "\n", "\n\n\n", "a", "a\na", "a\na\n", "\na\n\na", "a a a a", "a b c a b c", "x " * 30_000, "line\n" * 5_000, "a \na\n a\na ", "#*$%&|<>"]
    return texts + [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(500)]


def test_statistics_of_odd_texts(spark):
    rows = list(enumerate(odd_texts())) + [(None, "no key"), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_words int").repartition(2)
    measured = D.measure(df)
    assert measured.columns == ["doc_id", "text", *D.COUNTS, *D.RATIOS]
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *(r[c] for c in D.COUNTS)) for r in measured.collect())
    assert found == sorted((k if k is not None else -1, *plain(t)) for k, t in rows)


def test_ratios():
    import pyarrow as pa

    found = D.statistics(pa.array(["Ab! c1 c1\nc1 x", None, "a\na\nb"]))
    assert found["upper_rate"].tolist() == [1 / 10, 0, 0] and found["digit_rate"].tolist() == [3 / 10, 0, 0]
    assert found["mark_rate"].tolist() == [1 / 5, 0, 0] and found["top_word_rate"].tolist() == [3 / 5, 0, 2 / 3]
    assert found["dup_line_rate"].tolist() == [0, 0, 1 / 3] and found["words_a_line"].tolist() == [5 / 2, 0, 1]


def test_empty_tables(spark):
    measured = D.measure(spark.createDataFrame([], "doc_id long, text string"))
    rules = D.learn(measured, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules.rules == () and D.judge(measured, rules).count() == 0


def examples(n, seed=1):
    """Rejected if symbols are frequent and words short, or if lines repeat; a hundredth is wrongly labelled."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(D.RATIOS)))
    at = D.RATIOS.index
    y = ((x[:, at("symbol_rate")] > 0.6) & (x[:, at("mean_word")] <= 0.5)) | (x[:, at("dup_line_rate")] > 0.8)
    return x, np.where(rng.random(n) < 0.01, ~y, y), y


def test_planted_rules_are_found():
    x, y, truth = examples(6000)
    rules = D.fit(x, y, np.arange(len(x)) % 3 == 0)
    new, _, true = examples(4000, 2)
    hit = np.zeros(len(new), bool)
    for rule in rules.rules:
        hit |= D.covered(rule, new)
    assert (hit == true).mean() > 0.98 and (hit & ~true).mean() < 0.01
    assert {c.statistic for r in rules.rules[:2] for c in r} <= {"symbol_rate", "mean_word", "dup_line_rate"}


def test_labels_without_pattern_give_no_rule():
    rng = np.random.default_rng(3)
    x, y = rng.random((3000, len(D.RATIOS))), rng.random(3000) < 0.5
    assert D.fit(x, y, np.arange(3000) % 3 == 0).rules == ()


def test_one_class_gives_no_rule_that_splits_it():
    x = np.random.default_rng(3).random((100, len(D.RATIOS)))
    assert D.fit(x, np.zeros(100, bool), np.arange(100) % 3 == 0).rules == ()
    assert D.fit(x, np.ones(100, bool), np.arange(100) % 3 == 0).rules == ()


def test_pruning_takes_off_what_does_not_hold():
    x, y, _ = examples(3000)
    good = D.Condition("dup_line_rate", True, 0.8)
    chance = D.Condition("words_a_line", False, 0.02)
    assert D.prune((good, chance), x, y) == (good,)


def test_the_list_is_one_ordered_expression(spark):
    rules = D.DecisionList(((D.Condition("symbol_rate", True, 0.5), D.Condition("mean_word", False, 3.0)), (D.Condition("symbol_rate", True, 0.2),)))
    assert str(rules) == "1. reject if symbol_rate > 0.5 and mean_word <= 3\n2. reject if symbol_rate > 0.2"
    long = "word " + " ".join(f"word{i}" for i in range(60))
    texts = [long, long + " ###" * 20, "#a " + " ".join(f"#{i}" for i in range(70)), "short", "same again " * 40, None]
    df = D.judge(D.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), rules)
    found = {r["doc_id"]: (r["base_failed"], r["rule"], r["kept"]) for r in df.collect()}
    assert found == {0: (False, None, True), 1: (False, 2, False), 2: (False, 1, False), 3: (True, None, False), 4: (True, None, False), 5: (True, None, False)}
    assert "Python" not in D.judge(spark.createDataFrame([], D.measure(df).schema), rules)._jdf.queryExecution().executedPlan().toString()


def test_labels_with_nulls_conflicts_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "x"), (None, "y"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    assert D.learn(D.measure(docs), labels).rules == ()


@needs_tables
def test_held_out_labels_of_the_given_table(spark):
    """Of the labels kept from learning: nearly all documents with label 1 that pass the base rules are kept, and most with label 0 go."""
    judged = queries.QUERIES["op13_decision_list"](spark, SF_DIR).where(held_out("doc_id"))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality").distinct()
    rows = judged.join(labels, "doc_id").where(~F.col("base_failed")).groupBy("quality", "kept").count().collect()
    n = {(r[0], r[1]): r[2] for r in rows}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)] and n[(0, False)] >= 0.8 * (n[(0, False)] + n.get((0, True), 0))
