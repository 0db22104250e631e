"""From raw documents to training ids: language, near duplicates, personal data, mixture, tokens.

Each stage is one operator of ``lodestone.llm`` with its production parameters; its result is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_backtrack, curriculum, langid, pii_info, simhash_golay
from lodestone.llm.queries import ready, tokenizer_path
from lodestone.session import written

#: A document stays if its language's calibrated probability is at least this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language (null, or without a letter) and those whose language is less likely than all others together."""
    ready(spark)
    said = langid.identify(docs, langid.fit(docs))
    return said.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    ready(spark)
    return simhash_golay.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and removes or generalises the terms that reveal it; n_chars follows the new text."""
    ready(spark)
    clean = pii_info.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until each source meets its target, in curriculum order."""
    return curriculum.replay(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids of every document, and whether the ids decode to its text."""
    ready(spark)
    back = bpe_backtrack.encode(docs, tokenizer_path(), decoded="decoded")
    return back.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't train the language model or encode BPE; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
