"""Job tables: counts, queue order, gates and transitions as pure DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written

#: Bits of a row's place in its partition, in the numbers that Spark gives to rows.
_PLACE_BITS = 33


def status_counts(jobs: DataFrame, status: str, known: list[str]) -> DataFrame:
    """One row per known status, zeros included, and per other status found."""
    seeds = jobs.sparkSession.createDataFrame([(s,) for s in known], "status string")
    got = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return seeds.join(got, "status", "full").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def pivot_counts(jobs: DataFrame, owner: str, status: str, known: list[str]) -> DataFrame:
    return jobs.groupBy(owner).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in known])


def queue_next(jobs: DataFrame, runnable, owner: str, order: list) -> DataFrame:
    """The first runnable row of each owner."""
    w = Window.partitionBy(owner).orderBy(*order)
    return jobs.where(runnable).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def unprocessed(jobs: DataFrame, done: DataFrame, left: str, right: str) -> DataFrame:
    return jobs.join(done, F.col(left) == F.col(right), "left_anti")


def claimable(jobs: DataFrame, sweep, blocker, group: str) -> DataFrame:
    """Sweep rows whose group has no unfinished normal row."""
    return jobs.where(sweep).join(jobs.where(blocker).select(group), group, "left_anti")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], first: list) -> DataFrame:
    """The table with the new rows whose key it lacks; of new rows with one key the first by ``first``."""
    w = Window.partitionBy(*keys).orderBy(*first)
    new = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def backoff(attempts, base: float, most: float, powers: int = 5):
    """Seconds until the next attempt: base * 2^min(n - 1, powers), at most ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(powers))))


def retry(jobs: DataFrame, status: str, attempts: str) -> DataFrame:
    """Failed rows become pending with one more attempt."""
    failed = F.col(status) == "failed"
    return jobs.withColumn(attempts, F.when(failed, F.col(attempts) + 1).otherwise(F.col(attempts))).withColumn(status, F.when(failed, "pending").otherwise(F.col(status)))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: the place of each row, from 1, in one order over all rows.

    Rows are dealt by ranges of the order and sorted in each; a row's place is its place in its range after the rows of the ranges before. No task holds more than
    a range, of which a table of one row each is counted up. The numbered ranges are written, since the same deal can't be made twice.
    """
    at = F.monotonically_increasing_id()
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "numbered")
    dealt = dealt.withColumns({"__range": F.shiftright("__at", _PLACE_BITS), "__at": F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__range", "__at", "__start")
