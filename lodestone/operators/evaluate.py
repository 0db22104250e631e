"""Retrieval evaluation: hit at k and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hits(ranks: DataFrame, cases: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, rank of the first relevant result or null); cases without a relevant document leave the denominator."""
    eligible = cases.join(relevant.select("query_id").distinct(), "query_id", "left_semi")
    first = ranks.join(relevant, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return eligible.select("query_id").join(first, "query_id", "left")


def summary(first: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    share = lambda k: F.round(100.0 * F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 2).alias(f"hit_{k}")
    return first.agg(F.count("*").alias("cases"), *[share(k) for k in ks], F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 5).alias("mrr"))
