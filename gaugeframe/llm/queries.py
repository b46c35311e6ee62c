"""The registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import (
    alignment,
    chat,
    decision_list,
    learned_partitions,
    metric_tree,
    mixing,
    ngram_join,
    phrase_dedup,
    pii,
    quality,
    secret_scan,
    sentencepiece,
    threshold_clusters,
)
from gaugeframe.llm.common import read, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def piece_model() -> bytes:
    import public_tokenizers

    return sentencepiece.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(read(spark, sf_dir, "documents"), piece_model())


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_groups(read(spark, sf_dir, "documents"))


CHECKS["op10_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 90 * (max(nx.n) + max(ny.n) - count(*))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, paths = chat.prefix_tree(table.unionByName(extra))
    emitted = written(chat.depth_first(nodes, paths), "emitted")
    return chat.read_back(emitted, chat.attended(emitted, chat.ends(paths)))


CHECKS["op9_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(role) + 11
  + length(regexp_replace(text || role, '[^\\<|\[]', '', 'g')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e WHERE conv_id IS NOT NULL GROUP BY conv_id"""


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read(spark, sf_dir, "documents")))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query
def op2_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.search(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


CHECKS["op2_metric_tree"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op4_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrase_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


CHECKS["op4_phrase_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM s),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM g SEMI JOIN r ON g.h = r.h),
n AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""


@query
def op11_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_clusters.cluster(read(spark, sf_dir, "embeddings"))


def _clusters_sql(k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64) -> str:
    """Rounds as a chain of tables: c0 holds the first centroids, a1 the first assignment, c1 the centroids after it."""
    places = f"range(1, {dimensions + 1})"
    parts = [
        f"v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})",
    ]
    for i in range(1, rounds + 2):
        parts.append(
            f"a{i} AS (SELECT r, vec_id, v.v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, v.v, c.c,"
            f" list_sum(list_transform({places}, lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS d FROM v, c{i - 1} c) v GROUP BY r, vec_id, v.v)")
        if i <= rounds:
            parts.append(
                f"c{i} AS (SELECT c0.c, coalesce(m.v, c0.v) AS v FROM c{i - 1} c0 LEFT JOIN (SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS v FROM"
                f" (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, unnest({places}) AS u(j) GROUP BY c, j) GROUP BY c) m ON m.c = c0.c)")
    last = rounds + 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{rounds} c ON c.c = a.c"""


CHECKS["op11_threshold_clusters"] = _clusters_sql()


def byte_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"), byte_model(), piece_model())


@query
def op13_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    measured = written(decision_list.measure(docs, keep_text=False), "statistics")
    rules = decision_list.learn(measured, read(spark, sf_dir, "labels"))
    return decision_list.judge(measured, rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept", "rule")
