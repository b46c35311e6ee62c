"""Quality rules (operator 13): a decision list learned by sequential covering over statistics of texts.

Statistics of every whole text are counted with flat numpy arrays in one pass; they are a few numbers a document, whatever its
length. On the labelled ones a list of rules is learned. A rule is a conjunction of thresholds on statistics. It is *grown* condition by
condition for the most information gained on two thirds of the examples, then *pruned*: conditions are taken off its end while that
makes it better on the other third. Documents that a rule covers are set aside and the next rule is learned on the rest, until no
rule is precise enough. The list is emitted as one ordered Spark conditional expression, so it can be read and judged without Python.

Null texts and texts without words have zero counts and zero ratios. Repeated rows are rows of their own. An empty table gives an empty
table. Columns of the input named like a statistic are replaced, all others kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W
from gaugeframe.llm.quality import held_out

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may look at: ratios, so that thresholds mean the same for short and long texts.
RATIOS = ["mean_word", "symbol_rate", "mark_rate", "upper_rate", "digit_rate", "dup_line_rate", "repeat_rate", "top_word_rate", "words_a_line"]
#: Bound of the training sample: labelled documents with the smallest hashes of their ids. An example is nine numbers.
SAMPLE = 100_000
MOST_RULES, MOST_CONDITIONS = 24, 4
#: Least share of rejected documents among those a rule covers, on the examples kept from growing it (with half a success and half a failure added).
PRECISION = 0.9

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in "#*$%&|<>"]] = 1
_KIND[[ord(c) for c in "!\"'()+,-./:;=?@[\\]^_`{}~"]] = 2
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_WINDOW = 3


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and whether each sorted key equals the one before it."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    return order, same


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and RATIOS of each text. Equal words, lines and word windows of a text are found by 64-bit hashes."""
    raw, at = W.flat(texts)
    n = len(texts)
    starts, ends, first = W.words(raw, at)
    words = np.diff(first)

    def each(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])

    inside = ~W._SPACE[raw]
    chars = each(inside & ((raw & 0xC0) != 0x80))
    kind = _KIND[raw]
    hashes = W.word_hashes(raw, starts, ends)
    salt = W.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))  # keeps equal words of two texts apart
    text = np.repeat(np.arange(n), words)
    order, same = _equal(W.mix(hashes ^ salt[text]))
    runs = np.flatnonzero(~same)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, text[order[runs]], np.diff(np.append(runs, len(order))))

    windows, begin, per = W.windows(hashes, first, _WINDOW)
    order, same = _equal(W.mix(windows ^ salt[np.repeat(np.arange(n), np.diff(per))]))
    again = same.copy()
    again[:-1] |= same[1:]
    found = begin[order][again]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + _WINDOW, -1)
    repeated = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])[first])

    line_starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(raw == 10) + 1]))  # lines without a byte have no word
    line_ends = np.append(line_starts[1:], len(raw))
    upto = np.concatenate([[0], np.cumsum(inside)])
    full = upto[line_ends] > upto[np.minimum(line_starts, len(raw))]
    s, e = line_starts[full], line_ends[full]
    e = np.where(raw[e - 1] == 10, e - 1, e)
    owner = np.searchsorted(at, s, "right") - 1
    order, same = _equal(W.mix(W.word_hashes(raw, s, e) ^ salt[owner]))
    dup = np.bincount(owner[order][same], minlength=n)
    lines = np.bincount(owner, minlength=n)

    def rate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    symbols = each(kind == 1)
    return {
        "n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated,
        "mean_word": rate(chars, words), "symbol_rate": rate(symbols, words), "mark_rate": rate(each(kind == 2), words),
        "upper_rate": rate(each(kind == 3), chars), "digit_rate": rate(each(kind == 4), chars), "dup_line_rate": rate(dup, lines),
        "repeat_rate": rate(repeated, words), "top_word_rate": rate(top, words), "words_a_line": rate(words, lines),
    }


def measure(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns (the text only if asked for) and the statistics of the whole text, in one pass without a shuffle."""
    fields = [*COUNTS, *RATIOS]
    kept = [f.name for f in df.schema.fields if f.name not in fields and (keep_text or f.name != text)]
    types = [f"{c} long" for c in COUNTS] + [f"{c} double" for c in RATIOS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            found = statistics(batch.column(text))
            counts = [pa.array(found[c].astype(np.int64)) for c in COUNTS] + [pa.array(found[c].astype(np.float64)) for c in RATIOS]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + counts, [*kept, *fields])

    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for t in types:
        name, kind = t.split()
        schema = schema.add(name, kind)
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).mapInArrow(run, schema)


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def covers(self, x: np.ndarray) -> np.ndarray:
        value = x[:, RATIOS.index(self.statistic)]
        return value > self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    inside = np.ones(len(x), bool)
    for condition in rule:
        inside &= condition.covers(x)
    return inside


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that one of them covers is rejected, the rest is kept."""

    rules: tuple[Rule, ...]

    def fired(self) -> Column:
        """Number of the first rule that covers a row, from 1; null where none does."""
        chain = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            both = self.rules[i - 1][0].column()
            for condition in self.rules[i - 1][1:]:
                both = both & condition.column()
            chain = F.when(both, F.lit(i)).otherwise(chain)
        return chain

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if " + " and ".join(map(str, r)) for i, r in enumerate(self.rules, 1))


def _condition(x: np.ndarray, y: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold that gains most about y: true examples covered times the information gained per example."""
    total, true = len(y), int(y.sum())
    before, best = np.log2(true / total), None
    for i, name in enumerate(RATIOS):
        order = np.argsort(x[:, i], kind="stable")
        value, ends = x[order, i], np.cumsum(y[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        low_true, low = ends[cut], cut + 1
        for above, t, n in ((False, low_true, low), (True, true - low_true, total - low)):
            gain = t * (np.log2(np.maximum(t, 1e-9) / n) - before)
            k = int(np.argmax(gain))
            if gain[k] > 0 and (best is None or gain[k] > best[0]):
                a, b = value[cut[k]], value[cut[k] + 1]
                middle = float(f"{(a + b) / 2:.6g}")
                best = float(gain[k]), Condition(name, above, middle if a <= middle < b else float(a))
    return best


def grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Conditions that gain most, one after another, until only true examples are covered."""
    rule: list[Condition] = []
    while len(rule) < MOST_CONDITIONS and y.any() and not y.all():
        found = _condition(x, y)
        if found is None:
            break
        rule.append(found[1])
        inside = found[1].covers(x)
        x, y = x[inside], y[inside]
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = y[covered(rule, x)]
    return (hit.sum() + 0.5) / (len(hit) + 1)


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The shortest of the rule's beginnings that is best on other examples."""
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, x, y), -len(r)))


def fit(x: np.ndarray, y: np.ndarray, other: np.ndarray) -> DecisionList:
    """Sequential covering: ``x`` holds RATIOS, ``y`` what to reject, ``other`` which examples prune instead of grow."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES and y[~other].any():
        rule = grow(x[~other], y[~other])
        if not rule:
            break
        rule = prune(rule, x[other], y[other])
        if _worth(rule, x[other], y[other]) < PRECISION:
            break
        rules.append(rule)
        rest = ~covered(rule, x)
        x, y, other = x[rest], y[rest], other[rest]
    return DecisionList(tuple(rules))


def learn(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Fit on at most ``sample`` labelled documents (label 0: reject) that are not held out and that pass the base rules, which come
    first in the list.

    Null ids and labels and ids with both labels are left out; of rows that share an id, the smallest statistics are the example.
    What reaches the driver is nine numbers an example.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = measured.where(~base_failed()).select(F.col(f"`{key}`").alias("id"), F.struct(*RATIOS).alias("x")).join(chosen, "id").groupBy("id", "label").agg(F.min("x").alias("x"))
    found = rows.select(F.col("id").cast("string").alias("id"), F.col("label").cast("int").alias("label"), "x.*").toArrow().to_pandas().sort_values("id")
    other = np.array([zlib.crc32(f"prune {i}".encode()) % 3 == 0 for i in found["id"]], bool)
    return fit(found[RATIOS].to_numpy(np.float64), found["label"].to_numpy() == 0, other)


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, rules: DecisionList) -> DataFrame:
    """All columns, ``base_failed``, ``rule`` (the first that fires) and ``kept``, as one ordered conditional expression; columns of these
    names are replaced."""
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", rules.fired())
    return out.withColumn("kept", F.when(F.col("base_failed"), False).when(F.col("rule").isNotNull(), False).otherwise(True))
