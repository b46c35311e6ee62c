"""A training corpus from the table ``documents``: five stages, each of which works on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but the
last return the columns of their input.

1. quality: documents that the classifier, trained on the table ``labels``, rejects (score below 0.5) go.
2. near_duplicates: of each group linked by 5-word shingles at a similarity of 0.8, the document with the smallest id stays;
   of rows that agree in all columns, one. Documents without words are in no group and stay; null ids as well.
3. secrets: secrets in texts are replaced by a mark, and n_chars follows.
4. mixture: documents are repeated, or go, so that sources come near their target weights.
5. tokens: texts as ids of the model, with their number and digests; texts decode to what was encoded.

Null and empty texts pass all stages but the fourth, which has no budget for documents without words: it keeps them as often as
their source's whole epochs, at least once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import mixing, ngram_join, quality, secret_scan, sentencepiece
from gaugeframe.llm.common import read, sent, unused, written
from gaugeframe.llm.queries import piece_model

#: Rows of a batch that goes to a Python worker: a text may be a hundred times as long as most, and both sides hold a whole batch.
BATCH_ROWS = 512

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return quality.score(docs, model, column=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    groups = written(ngram_join.linked_groups(docs, size=5, num=80, den=100), "groups")
    gone = groups.where("n_shingles > 0 and component_id < doc_id").select("doc_id").distinct()
    left = docs.join(sent(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    again = groups.groupBy("doc_id").count().where("count > 1").select(F.struct("doc_id").alias("again"))
    if again.isEmpty():
        return left
    row = F.struct("doc_id")
    once = left.join(again, row == F.col("again"), "left_semi").dropDuplicates()
    return left.join(again, row == F.col("again"), "left_anti").unionByName(once)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by all their columns, so rows that share an id don't take each other's copies; rows that agree in all
    columns are one row with their copies together."""
    _in_small_batches(spark)
    row, times, number = unused(docs, "row"), unused(docs, "times"), unused(docs, "number")
    # a struct is never null, so null ids and sources join as well
    name = F.struct(F.col("doc_id").alias("id"), "source", mixing.digest("text", docs.columns).alias("digest"))
    found = mixing.decide(docs, apart=docs.columns)
    epochs = F.when(F.col("size") == 0, F.greatest("epochs", F.lit(1))).otherwise(F.col("epochs"))
    blocks = written(found.select(F.struct("id", "source", "digest").alias(row), "n", (F.col("n") * epochs + F.col("more")).cast("int").alias(times)), "copies")
    named = docs.withColumn(row, name)
    again = blocks.groupBy(row).agg(F.sum("n").alias("n")).where("n > 1").select(row)
    if not again.isEmpty():
        once = named.join(again, row, "left_semi").dropDuplicates()
        named = named.join(again, row, "left_anti").unionByName(once)
    kept = named.join(sent(blocks.where(F.col(times) > 0).select(row, times)), row)
    return kept.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return sentencepiece.round_trip(docs, piece_model(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("mixture", mix_sources),
    ("tokens", tokenise),
]

#: The trained classifier, the sampling and the tokenizer cannot be written in SQL: tests/llm checks the stages instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
