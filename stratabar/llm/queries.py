"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm import balltree, itq, linededup, lm_score, mixing, packing, pii, secret_scan, simhash, toxicity
from stratabar.llm.common import table


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score(spark, docs, model))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(out["fp"]).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(spark, table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_k(spark, vectors, vectors.where("vec_id % 100 = 0"))


def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.sample(spark, table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("factor", "probability")})


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(*linededup.kept_lines(spark, table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(spark, table(spark, sf_dir, "documents")))


QUERIES = {
    "op2_pii": op2_pii,
    "op5_line_dedup": op5_line_dedup,
    "op3_mixing": op3_mixing,
    "op4_itq": op4_itq,
    "op6_top_k": op6_top_k,
    "op8_lm_score": op8_lm_score,
    "op10_packing": op10_packing,
    "op1_toxicity": op1_toxicity,
    "op7_simhash": op7_simhash,
    "op9_secret_scan": op9_secret_scan,
}
ORACLES: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op5_line_dedup": linededup.oracle(),
    "op6_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
