"""The registered queries of this package, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), radius=None)
    return out.select("doc_id", F.size("removed_lines").alias("n_removed"), F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import collapse

    out = collapse(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", F.col("n_turns").cast("long"), F.col("n_same").cast("long"), F.sha2("rendered", 256).alias("rendered_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS l, count(*) AS n FROM t GROUP BY conv_id),
u AS MATERIALIZED (SELECT min(conv_id) AS conv_id, l, n, count(*) AS n_same FROM c GROUP BY l, n),
k AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.n > u.n AND v.l[1] = u.l[1] AND v.l[1:u.n] = u.l))
SELECT conv_id, n AS n_turns, n_same, sha256(array_to_string(list_transform(l, lambda x:
  '<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), '')) AS rendered_sha256 FROM k
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, (held(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    return identify(docs, model).select(F.col("id").alias("doc_id"), (held(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP5_SQL = r"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    out = jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)["groups"]
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) END) AS s FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .learn import held
    from .quality import score
    from .toxicity import train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), learn=held(F.col("doc_id"), 4) != 2)
    return _scored(score(docs, model), held(F.col("id"), 4) == 2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .learn import held
    from .quality import score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), learn=held(F.col("doc_id"), 5) != 0)
    return _scored(score(docs, model), held(F.col("id"), 5) == 0)


def _scored(out: DataFrame, held_out) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest, extract

    return digest(extract(table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.xxhash64("tokens").alias("tokens_hash"), (F.col("decoded") == F.col("text")).alias("round_trip"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_line_dedup, op3_chat_formatting, op4_language_id, op5_exact_topk, op6_ngram_jaccard_join, op7_toxicity, op8_quality, op9_pii, op10_sentencepiece)
}
ORACLE: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op5_exact_topk": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL}
