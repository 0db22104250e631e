"""Order of nested references: a depth-first walk of every book's structure at once, by an Euler tour and list ranking.

A reference names a child at a place (from 0 on, without gaps) of its parent. Each reference is entered once and left once; what
comes after entering is the first reference of the child, or leaving; after leaving, the next place of the parent, or leaving the
reference to the parent. These steps are one linked list a book. Pointers are doubled until every step points to the end, adding up
the steps on the way, so a walk of depth d takes about log2(d) rounds and not d; every round is a join on unique keys.

A child that several references name is entered by the first of them in the walk. Which that is depends on the walk: it begins
without such children, takes the first references found, and is done again until nothing changes. Each round settles at least the
next such child; sound structures have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides: packed tables of numbers are far smaller than their rows, so that by their size they would be gathered on the driver and sent out."""
    return left.join(right.hint("merge"), on, how)


def _doubled(steps: DataFrame) -> DataFrame:
    """steps (step, next, entered, deep) -> (step, end, entered, deep): sums from each step to the end of its list; steps of a list without an end (a ring) are left out."""
    doing = written(steps, "tour")
    done = doing.where("next IS NULL").select("step", F.col("step").alias("end"), "entered", "deep")
    doing = doing.where("next IS NOT NULL")
    count, rounds = doing.count(), 0
    farthest = count  # a list that has not ended after so many steps is a ring
    while count and 1 << rounds <= 2 * farthest:
        at_end = done.select(F.col("step").alias("next"), F.col("end"), F.col("entered").alias("e"), F.col("deep").alias("d"), F.lit(None).cast("long").alias("far"))
        on = doing.select(F.col("step").alias("next"), F.lit(None).cast("long").alias("end"), F.col("entered").alias("e"), F.col("deep").alias("d"), F.col("next").alias("far"))
        met = _met(doing, at_end.unionByName(on), "next").select("step", F.col("far").alias("next"), (F.col("entered") + F.col("e")).alias("entered"), (F.col("deep") + F.col("d")).alias("deep"), "end")
        met = written(met, "tour")
        done = done.unionByName(met.where("end IS NOT NULL").select("step", "end", "entered", "deep"))
        doing = met.where("end IS NULL").select("step", "next", "entered", "deep")
        count, rounds = doing.count(), rounds + 1
    return done


def _tour(refs: DataFrame, first: DataFrame) -> DataFrame:
    """refs (rid, book, parent, place, child), first (rid): the references that are entered -> rid, position (from 1), depth (from 0), enter, leave, end."""
    r = _met(refs, first.withColumn("entered", F.lit(True)), "rid", "left")
    own = r.where("entered").select("book", F.col("child").alias("parent"), F.col("rid").alias("above"))
    begin = refs.where("place = 0").select("book", F.col("parent").alias("child"), F.col("rid").alias("inside"))
    beside = refs.select("book", "parent", (F.col("place") - 1).alias("place"), F.col("rid").alias("beside"))
    j = _met(_met(_met(r, begin, ["book", "child"], "left"), beside, ["book", "parent", "place"], "left"), own, ["book", "parent"], "left")
    inside = F.when(F.col("entered"), F.col("inside") * 2)
    down = F.struct((F.col("rid") * 2).alias("step"), F.coalesce(inside, F.col("rid") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("deep"))
    up = F.struct((F.col("rid") * 2 + 1).alias("step"), F.coalesce(F.col("beside") * 2, F.col("above") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("deep"))
    steps = j.select(F.inline(F.array(down, up)))
    sums = _doubled(steps)
    enter = sums.where("step % 2 = 0").select((F.col("step") / 2).cast("long").alias("rid"), "end", F.col("entered").alias("left_e"), F.col("deep").alias("left_d"))
    leave = sums.where("step % 2 = 1").select(((F.col("step") - 1) / 2).cast("long").alias("rid"), F.col("entered").alias("after"))
    # Sums run to the end of the list, where the depth is that of a root's: what is left of it tells the depth.
    return _met(enter, leave, "rid").select("rid", "end", "left_e", "after", (-F.col("left_d")).alias("depth"))


def _without_gaps(sound: DataFrame) -> DataFrame:
    """Adds ``given``, the place as it came, and numbers places anew where some are missing; only those parents' references are sorted."""
    sound = sound.withColumn("given", F.col("place"))
    torn = sound.groupBy("book", "parent").agg(F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).where("low <> 0 OR high <> n - 1").select("book", "parent")
    again = F.row_number().over(Window.partitionBy("book", "parent").orderBy("given")) - 1
    mended = _met(sound, torn, ["book", "parent"], "left_semi").withColumn("place", again.cast(sound.schema["place"].dataType))
    return _met(sound, torn, ["book", "parent"], "left_anti").unionByName(mended)


def walk(references: DataFrame, root: str = "root", deepest: int | None = None) -> DataFrame:
    """references (book, parent, place, child), ids as strings -> book, parent, place, child, position, depth, kind.

    ``root`` is the parent of a book's outermost references. Positions count a book's references in depth-first order from 1; depth is 0 at the root.
    kind: ``entered``; ``repeated`` (the child was entered before); ``ring`` (the child is an ancestor: entering it again would never end); ``broken`` (no child is
    named); ``apart`` (not reached from the root: no position and no depth). References deeper than ``deepest`` are ``apart`` too. References without a book, a parent
    or a place are left out, as are all but one of those that share a parent and a place. Gaps between places are passed over.
    """
    sound = references.where("book IS NOT NULL AND parent IS NOT NULL AND place IS NOT NULL")
    sound = _without_gaps(sound.groupBy("book", "parent", "place").agg(F.min("child").alias("child")))
    refs = written(sound.withColumn("rid", F.monotonically_increasing_id()), "references")
    several = written(refs.where(F.col("child") != root).groupBy("book", "child").agg(F.count("*").alias("n"), F.min("rid").alias("rid")), "named")
    single = several.where("n = 1").select("rid")
    several = several.where("n > 1").select("book", "child")
    shared = _met(refs, several, ["book", "child"], "left_semi") if not several.isEmpty() else None
    outer = refs.where(F.col("parent") == root).select(F.col("rid").alias("outer"))
    first, before = single, None
    while True:
        tour = written(_tour(refs, first), "walk")
        # A list that ends by leaving an outermost reference is a walk from the root.
        ends = _met(tour, outer.select((F.col("outer") * 2 + 1).alias("end")), "end", "left_semi")
        if deepest is not None:
            ends = ends.where(F.col("depth") <= deepest)
        if shared is None:
            break
        found = _met(shared, ends.select("rid", "left_e"), "rid").groupBy("book", "child").agg(F.max_by("rid", "left_e").alias("rid")).select("rid")
        found = written(found, "first")
        if before is not None and found.count() == before.count() and _met(found, before, "rid", "left_anti").isEmpty():
            break
        before, first = found, single.unionByName(found)
    sizes = _met(refs, ends.select("rid"), "rid").groupBy("book").agg(F.count("*").alias("size"))
    # The number of references from a step to the end of its book's list, counted from the end, is its place from the front. Depth-limited walks keep gaps out by ranking anew.
    out = _met(_met(_met(refs, ends, "rid", "left"), first.withColumn("is_first", F.lit(True)), "rid", "left"), sizes, "book", "left")
    position = F.col("size") - F.col("left_e") + 1
    if deepest is not None:
        position = F.when(F.col("left_e").isNotNull(), F.row_number().over(Window.partitionBy("book").orderBy(F.col("left_e").desc_nulls_last())))
    out = out.withColumn("position", position)
    entered = out.where("is_first AND left_e IS NOT NULL").select("book", "child", F.col("left_e").alias("from_e"), F.col("after").alias("to_e"))
    out = _met(out, entered, ["book", "child"], "left")
    inside = (F.col("left_e") < F.col("from_e")) & (F.col("left_e") > F.col("to_e"))
    kind = F.when(F.col("left_e").isNull(), "apart").when(F.col("child").isNull(), "broken").when(F.col("is_first"), "entered").when(inside | (F.col("child") == root), "ring").otherwise("repeated")
    return out.select("book", "parent", F.col("given").alias("place"), "child", F.col("position").cast("long").alias("position"), "depth", kind.alias("kind"))
