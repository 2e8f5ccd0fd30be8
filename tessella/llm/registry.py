"""The queries of the text operators, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.common import fold
    from tessella.llm.maxent import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), fold() != 1)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import secrets

    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(of=secrets.language(docs)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import fingerprint_hex, near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity
    from tessella.llm.common import fold

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels.filter(fold() != 0)))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.winnowing import as_text, compare_edited

    found = compare_edited(_table(spark, sf_dir, "documents"))
    prints = as_text("own_hashes").alias("fingerprint"), as_text("edited_hashes").alias("edited_fingerprint")
    return found.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next", F.array_join(F.col("own_positions").cast("array<string>"), " ").alias("positions"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(quality.trusted_rows(docs, _table(spark, sf_dir, "labels"))))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import ann

    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.lattice import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict = {"op1_maxent": op1_maxent, "op2_secrets": op2_secrets, "op3_simhash": op3_simhash, "op4_toxicity": op4_toxicity, "op5_winnow": op5_winnow, "op6_quality": op6_quality, "op7_language": op7_language, "op8_pack": op8_pack, "op9_search": op9_search, "op10_sentencepiece": op10_sentencepiece}
ORACLE_SQL: dict = {}
