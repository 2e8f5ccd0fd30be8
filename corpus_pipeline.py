"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import packing, quality, secrets, simhash, toxicity
from tessella.llm.common import discard, fold, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It learns from labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold() != 0)
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents above their language's perplexity threshold go. Trusted are those labelled good."""
    return quality.keep_good(docs, quality.fit(quality.trusted_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that of the smallest id."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; what text looks like is learned from all that is left."""
    return secrets.redact(docs, secrets.train(of=secrets.language(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("SimHash near-dedup", drop_copies), ("secret scans", redact_secrets), ("best-fit packing", pack)]

#: No stage but the folds can be put in SQL: trained models, tokenizers and components. Tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs, before = stage(step(spark, docs, sf_dir)), docs
        discard(before)
    return docs
