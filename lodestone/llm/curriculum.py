"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share a number of words by weight; none gets over ``most_repeats`` times its own size,
and what it can't take is shared again by weight. That is water filling: one level L with target
min(cap, L * weight), found in closed form from running sums over the sources, one row each.

Positions: a source's weight changes over training time t in [0, 1] as w(t) = 1 + s(2t - 1), s being its
schedule's slope. Its integral t + s(t^2 - t) is the share of the source's demand met by time t. The words
that a source gives stand in a fixed random order (by MD5 of the doc_id), the same in each epoch; the cumulative count at the
middle of a taking of a document, over the target and from the source's first epoch on, is inverted through that integral: the taking's training
position. ``replay`` range-sorts all takings by it, which gives the curriculum; ``mix`` reports the first of each document.

The running count over a source is built from two sums, over the hash slices of the source and inside a slice,
so a source that holds most rows is never gathered in one task. Reruns agree: no random numbers, no partition order.

Defined results: null text has size 0 and takes 0 words; a null source is a source of its own, ordered last; the document at the
end of a target is taken in part; rows of equal doc_id are told apart by their text and counted as one if that is equal too, each with its
own size and share; rows of null doc_id are rows each, ordered by text; an empty table gives no row. Input columns other than doc_id, text and source are dropped.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash slices of a source: one for each value of the key's first two hex digits.
SLICES = 256


def words(text: Column) -> Column:
    """Words of a text: runs of anything but the six ASCII white spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most_repeats: float, slopes: list[float]) -> DataFrame:
    """(source, source_size) with one row per source -> weight, slope, target added."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    up = Window.orderBy("ratio", "rank")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("demand", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("demand") - F.col("before")) / F.col("left"))
    # The first source, by cap over weight, that its level doesn't fill sets the level of all after it.
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"])
    return s.select("source", "source_size", "weight", "slope", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), F.col("cap")).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The time t at which t + s(t^2 - t) reaches the share."""
    y = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y)
    return F.when(F.abs(slope) < 1e-9, y).otherwise((slope - 1 + root) / (2 * slope))


#: Key of the rows without doc_id. They may be many, so they are cut into slices of their own, by their text.
NO_ID = hashlib.md5(b"mix").hexdigest()


def _planned(docs: DataFrame, carried: list[Column], weights=(3.0, 1.0, 2.0), share: float = 1.5, most_repeats: float = 2.0, slopes=(0.6, 0.0, -0.6)) -> DataFrame:
    """The carried columns of each row, doc_id, source, size, source_size, target, and takings: an array of (part, position), the words and the place of each taking."""
    if any(w <= 0 for w in weights) or any(abs(s) > 1 for s in slopes):
        raise ValueError("weights are positive and slopes within -1 and 1")
    rows = docs.select(*carried, "doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("mix"))).alias("key"), F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    first_two = lambda c: F.conv(F.substring(c, 1, 2), 16, 10).cast("int")
    within = F.when(F.col("key") < NO_ID, 0).when(F.col("key") == NO_ID, 1 + first_two("tie")).otherwise(257)
    rows = rows.withColumn("slice", first_two("key") * 258 + F.when(F.substring("key", 1, 2) == NO_ID[:2], within).otherwise(0))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    sources = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), list(weights), share, most_repeats, list(slopes))
    order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(order), F.lit(0))).drop("slice_size")
    # At most SLICES + 257 rows a source; every join is null-safe on the source.
    plan = slices.alias("a").join(sources.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.slice", "slice_before", "source_size", "slope", "target")
    inside = Window.partitionBy("source", "slice").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice")))
    before, size = F.col("slice_before") + F.col("inside"), F.col("size")
    whole = F.floor("target").cast("long")
    takings = []
    for epoch in range(int(-(-most_repeats // 1))):
        begin = before + F.lit(epoch) * F.col("source_size")
        part = F.greatest(F.lit(0), F.least(size, whole - begin)).cast("long")
        middle = (begin + part / 2) / F.greatest(F.col("target"), F.lit(1.0))
        takings.append(F.struct(part.alias("part"), position(middle, F.col("slope")).alias("position")))
    names = [F.col(c) for c in docs.select(*carried).columns]
    takings = F.filter(F.array(*takings), lambda x: x["part"] > 0)
    return rows.select(*names, "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", takings.alias("takings"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position of its first taking (null if none), in curriculum order.

    taken counts the words of all takings: 0 up to most_repeats times the size.
    """
    taken = F.aggregate("takings", F.lit(0).cast("long"), lambda n, x: n + x["part"])
    out = _planned(docs, [], **how).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.get("takings", F.lit(0))["position"].alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def replay(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents with their own columns, a row for each taking (a part counts as one), ordered by the position of the taking, then doc_id.

    Rows are numbered in a written table and positions are worked out without the texts, so a text is shuffled twice, to meet its positions and to be
    sorted by them; null and repeated doc_ids do no harm.
    """
    number, place = unused(docs, "__number"), unused(docs, "__position")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "mixture")
    plan = _planned(rows, [F.col(number)], **how).select(number, F.explode("takings.position").alias(place))
    return rows.join(plan, number).orderBy(place, "doc_id").select(*docs.columns)


def unused(df: DataFrame, name: str) -> str:
    """A name that no column has, however its letters are cased."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
