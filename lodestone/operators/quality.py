"""Chunk quality and work routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

GRAM = 8


def chunk_quality(chunks: DataFrame, id_col: str, text_col: str, max_tokens: int) -> DataFrame:
    """id, n_tokens, ratio (share of tokens in repeats of the commonest 8 tokens), eligible, score from 0 to 100.

    The windows of a chunk are counted by (chunk, hash of the window) with partial sums, so a long chunk is not held in one row's map.
    """
    t = chunks.select(id_col, tokens(F.col(text_col)).alias("t"))
    n = F.size("t")
    grams = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.xxhash64(F.slice("t", i, F.lit(GRAM))))
    each = t.where(n >= 24).select(id_col, F.explode(grams).alias("g")).groupBy(id_col, "g").agg(F.count("*").alias("n"))
    most = each.groupBy(id_col).agg(F.max("n").alias("most"))
    r = t.select(id_col, n.cast("long").alias("n_tokens")).join(most, id_col, "left")
    ratio = F.when((F.col("n_tokens") >= 24) & (F.col("most") >= 3), F.least(F.lit(1.0), F.col("most") * F.lit(float(GRAM)) / F.col("n_tokens"))).otherwise(0.0)
    r = r.withColumn("ratio", ratio).withColumn("eligible", (F.col("n_tokens") >= 2) & (F.col("ratio") < 0.40))
    off = F.when(F.col("n_tokens") > max_tokens, 20).otherwise(0) + F.when(F.col("n_tokens") < 2, 35).otherwise(0) + F.when(F.col("ratio") >= 0.40, 35).otherwise(0)
    score = F.greatest(F.lit(0), F.least(100 - off, F.when(F.col("eligible"), 100).otherwise(45))).cast("long")
    return r.select(id_col, "n_tokens", "ratio", "eligible", score.alias("score"))


def merge_routes(routes: DataFrame, key: list[str]) -> DataFrame:
    """One route per key: highest priority, distinct codes in order, how many were merged."""
    return routes.groupBy(*key).agg(F.max("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count("*").alias("n"))


def cap_routes(routes: DataFrame, owner: str, ties: list[str], ceiling: int) -> DataFrame:
    """Adds place (by priority inside the owner) and created (within the ceiling); the others are deferred, not dropped."""
    w = Window.partitionBy(owner).orderBy(F.desc("priority"), *ties)
    return routes.withColumn("place", F.row_number().over(w)).withColumn("created", F.col("place") <= ceiling)
