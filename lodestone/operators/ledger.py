"""Correction ledgers: winners among generations, review summaries, order-free signatures; usage over time."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import ship


def reconcile(entries: DataFrame, key: list[str], human: str, decided: str, generation: str, entry_id: str) -> DataFrame:
    """Adds ``winner``: of each source key the latest human decision, else the newest generation."""
    w = Window.partitionBy(*key).orderBy(F.desc(human), F.desc(F.when(F.col(human), F.col(decided))), F.desc(generation), F.desc(entry_id))
    return entries.withColumn("winner", F.row_number().over(w) == 1)


#: A digest is added up in words of this many hexadecimal digits, each in two halves of this many bits. Sums of a half fit 64 bits for 8 billion rows of a group; more are
#: an error, never a wrong sum.
WORD_DIGITS, WORDS, HALF = 15, 2, 30


def signature(rows: DataFrame, by: str, columns: list[str], digest=None) -> DataFrame:
    """A SHA-256 of each group's rows, whatever their order and however they are split over tasks.

    The first 120 bits of every row's digest are summed as two words by halves, and rows are counted, so tasks add up their own rows first and a group of any size needs
    five numbers. Rows that are there twice count twice. It tells changes apart, and is no seal against someone who makes rows up to fit.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256) if digest is None else digest
    words = [F.conv(F.substring("d", 1 + k * WORD_DIGITS, WORD_DIGITS), 16, 10).cast("long").alias(f"w{k}") for k in range(WORDS)]
    cut = rows.select(by, digest.alias("d")).select(by, *words)
    halves = {f"{side}{k}": half for k in range(WORDS) for side, half in (("h", F.shiftright(f"w{k}", HALF)), ("l", F.col(f"w{k}").bitwiseAND((1 << HALF) - 1)))}
    sums = cut.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(half).alias(name) for name, half in halves.items()])
    return sums.select(by, F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", *halves)]), 256).alias("signature"))


def sorted_signature(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """A SHA-256 of the whole digests of each group's rows in their order, with commas between, whatever the order and the split of the rows.

    Spark sorts the digests of a group; they are then read as a stream, so that a task keeps the state of one hash and no group is gathered.
    """
    ship(rows.sparkSession)
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    dealt = rows.select(by, digest.alias("d")).repartition(by).sortWithinPartitions(by, "d")
    return dealt.mapInArrow(_hashed, T.StructType([dealt.schema[by], T.StructField("signature", T.StringType())]))


def _hashed(batches):
    group = held = None
    for b in batches:
        keys, digests, i = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
        done = []
        while i < len(keys):
            last = i
            while last < len(keys) and keys[last] == keys[i]:
                last += 1
            text = ",".join(digests[i:last]).encode()
            if held is not None and keys[i] == group:
                held.update(b"," + text)
            else:
                done += [(group, held.hexdigest())] if held is not None else []
                group, held = keys[i], hashlib.sha256(text)
            i = last
        if done:
            yield _signed(done, b.schema.field(0))
    if held is not None:
        yield _signed([(group, held.hexdigest())], b.schema.field(0))


def _signed(done: list[tuple], by: pa.Field) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], by.type), pa.array([x[1] for x in done], pa.string())], names=[by.name, "signature"])


def rolling_usage(events: DataFrame, by: str, at: str, value: str, seconds: int = 86_400) -> DataFrame:
    """Adds calls and the sum of value in the window that ends with each event."""
    w = Window.partitionBy(by).orderBy(F.col("epoch")).rangeBetween(-seconds, 0)
    return events.withColumn("epoch", F.unix_timestamp(F.col(at).cast("timestamp"))).withColumn("calls", F.count("*").over(w)).withColumn("total", F.sum(value).over(w))


def quota_state(used, limit: int, warn: float = 0.80, stop: float = 0.90):
    """ok, warning or paused: the next request would pass floor(limit * stop), or floor(limit * warn) is reached."""
    return F.when(used + 1 > F.floor(F.lit(limit * stop)), "paused").when(used >= F.floor(F.lit(limit * warn)), "warning").otherwise("ok")


def sessions(events: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """Adds ``session``: a new one after ``gap`` idle seconds or more."""
    w = Window.partitionBy(by).orderBy("epoch", "event_id")
    e = events.withColumn("epoch", F.unix_timestamp(F.col(at).cast("timestamp")))
    new = F.coalesce((F.col("epoch") - F.lag("epoch").over(w) >= gap).cast("int"), F.lit(0))
    return e.withColumn("new", new).withColumn("session", F.sum("new").over(w)).drop("new")
