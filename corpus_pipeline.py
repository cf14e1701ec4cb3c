"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, free, materialize, standing
from lodestone.llm.mixing import mix
from lodestone.llm.packing import pack_documents
from lodestone.llm.quality import crc_fold, score, train
from lodestone.llm.simhash import drop_near_duplicates
from lodestone.llm.substrings import dedup_substrings


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold=lambda i: crc_fold(i, 3) != 1)
    return score(docs, model, keep=docs.columns).where("quality_score >= 0.5").drop("quality_score")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a likeness of 0.8 or more."""
    return drop_near_duplicates(docs, similarity=0.8, shingle_words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words or more that an earlier document holds. n_chars follows the text."""
    names = docs.columns
    kept = dedup_substrings(docs, carry=names)
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.col("dedup_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*names)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson draw whose mean brings each source to its target share, in a global random order."""
    return mix(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", simhash_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", source_mixing),
    ("best-fit packing", packing),
]

#: Scores, fingerprints and token ids are beyond SQL; the tests hold each stage's operator against brute force, and the stages' effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = documents(spark, sf_dir)
    before = standing()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
            free(spark, before, (docs,))  # the stage's input and what it wrote on its way
    return docs
