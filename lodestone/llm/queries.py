"""The registered queries op1_... to op10_..., each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents
from lodestone.llm.hnsw import near_duplicate_vectors
from lodestone.llm.idstore import store_documents
from lodestone.llm.licenses import license_digest, scan_licenses
from lodestone.llm.lm import score_documents
from lodestone.llm.mixing import mix
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import crc_fold, score, train
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.substrings import dedup_substrings
from lodestone.llm.winnowing import edit_likeness


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document, and the component of fingerprints linked at 4 or fewer of 64 bits. Null and empty texts have fingerprint zero."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text, and how alike they and those of the next document are."""
    return edit_likeness(documents(spark, sf_dir))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in every document. Null texts have no words, and nulls for the places."""
    return license_digest(scan_licenses(documents(spark, sf_dir)))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of at most 4096 tokens, packed into few sequences."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed unigram score and log-bilinear score of every document, learnt from all folds but one."""
    return score_documents(documents(spark, sf_dir))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all embeddings, and their components. Vectors that have no direction stay alone."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without windows of 50 words that start in a document of a smaller id."""
    return dedup_substrings(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled ones outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=lambda i: crc_fold(i, 3) != 1)
    scored = score(docs, model)
    return scored.select("doc_id", (F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op9_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a store of token ids, read back through its indexes."""
    return store_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson draws, which bring sources nearer to equal shares, in a global random order."""
    return mix(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_winnowing, op3_licenses, op4_packing, op5_lm, op6_hnsw, op7_substrings, op8_quality, op9_idstore, op10_mixing)}

#: Poisson probabilities are summed up as in the query; the same hashes give the same draws.
OP10_SQL = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w * sum(n) OVER () / (sum(w) OVER () * n) AS rate FROM counts),
steps AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
          FROM rates, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 60)::BIGINT)) AS k)),
drawn AS (SELECT d.*, ('0x' || substr(md5('draw-42:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents d),
many AS (SELECT d.doc_id, count(*) AS n FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.upto <= d.u GROUP BY d.doc_id)
SELECT d.*, c.copy::INTEGER AS mix_copy, m.n::INTEGER AS mix_copies, md5('order-42:' || d.doc_id || ':' || c.copy) AS mix_key
FROM documents d JOIN many m USING (doc_id), LATERAL (SELECT unnest(generate_series(0, m.n - 1)) AS copy) c
"""

ORACLES: dict[str, str] = {"op10_mixing": OP10_SQL}
