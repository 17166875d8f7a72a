"""The queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import dedup, fingerprints, langid, licenses, lm, manifest, packing, pieces, quality, runs, secrets, topk, toxicity
from .common import remainder, table

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.licenses(table(spark, sf_dir, "documents"))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"), s["edits"].cast("string")))
    return out.withColumn("spans", F.array_join(shown, ","))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND a.dim = b.dim) AS s) AS t
WHERE r <= 20"""


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit(docs, remainder("doc_id", 3) != 1))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages")


def op7_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of each text's ids, and the hash of the text that they decode to."""
    ids = pieces.encoded(table(spark, sf_dir, "documents"))
    return pieces.with_decoded(ids).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.fingerprints(docs, fingerprints.fit(docs))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), runs.planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_license_scan": Query(op1_license_scan),
    "op2_minhash_dedup": Query(op2_minhash_dedup),
    "op3_best_fit_packing": Query(op3_best_fit_packing),
    "op4_secret_scan": Query(op4_secret_scan),
    "op5_exact_top_k": Query(op5_exact_top_k, TOP_K_SQL),
    "op6_language_mixture": Query(op6_language_mixture),
    "op7_piece_encoding": Query(op7_piece_encoding),
    "op8_toxicity": Query(op8_toxicity),
    "op9_quality_rules": Query(op9_quality_rules),
    "op10_lm_score": Query(op10_lm_score),
    "op11_merkle_manifest": Query(op11_merkle_manifest, manifest.SQL),
    "op12_fingerprints": Query(op12_fingerprints),
    "op13_periodic_runs": Query(op13_periodic_runs),
    "pipeline": Query(pipeline),
}


def configured(run: Run) -> Run:
    return lambda spark, sf_dir: run(configure(spark), sf_dir)


def queries() -> dict[str, Run]:
    return {name: configured(q.run) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
