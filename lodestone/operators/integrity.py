"""Structure checks: reference graphs, damage and kinds of pages, rare spellings near frequent ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

#: Levels that a walk goes down before it stops with an error; a longer chain of references is broken structure.
DEEPEST = 200


def broken_references(edges: DataFrame, nodes: DataFrame, to: str, key: str) -> DataFrame:
    """Edges whose target is no node; a null target counts as broken."""
    return edges.join(nodes.select(F.col(key).alias(to)).distinct(), to, "left_anti")


def reachable(edges: DataFrame, roots: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """edges (src, dst), roots (node) -> (node, depth): each node with the least number of steps from a root.

    Breadth-first: a step joins only the newest level, and each level is a table in the shared folder, so lineage stays short and lost executors
    cost one level. Cycles end because a node is reached once. A walk that isn't done after ``deepest`` levels is an error, never a part of the answer.
    """
    level = written(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "level")
    seen, e = level, edges.select("src", "dst")
    for depth in range(1, deepest + 1):
        step = e.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).where("node IS NOT NULL").distinct()
        level = written(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        raise ValueError(f"references go deeper than {deepest} levels")
    return seen


def damage(rows: DataFrame, by: str, text: str) -> DataFrame:
    """by, n, risk (0 to 100, half-even): replacement signs, runs of punctuation, letters apart and tiny texts of each group (a page, a source).

    Texts are judged each, so a run of single letters over the border of two texts doesn't count. Null counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    visible = F.length(F.regexp_replace(t, r"\s+", ""))
    each = rows.select(by, F.length(t).alias("c"), count("[�□¤]").alias("r"), count(r"[^\p{L}\p{N}_\s]{4,}").alias("p"), count(r"(?:\b[A-Za-z0-9]\s+){3,}[A-Za-z0-9]\b").alias("s"), visible.between(1, 3).cast("int").alias("tiny"))
    g = each.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("c", "r", "p", "s", "tiny")])
    risk = 900.0 * F.col("r") / F.greatest(F.col("c") + F.col("n") - 1, F.lit(1)) + (18.0 * F.col("p") + 35.0 * F.col("tiny") + 25.0 * F.col("s")) / F.col("n")
    return g.select(by, "n", F.bround(F.least(F.lit(100.0), risk), 0).cast("long").alias("risk"))


def running_furniture(lines: DataFrame, text: str, page: str, least: int) -> DataFrame:
    """Lines (blanks folded, digits as #) on ``least`` distinct pages or more: text, pages, first page."""
    norm = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"\d+", "#")
    l = lines.select(norm.alias("line"), page).where("line <> ''").distinct()  # noqa: E741
    return l.groupBy("line").agg(F.count("*").alias("pages"), F.min(page).alias("first_page")).where(F.col("pages") >= least)


def rare_near_frequent(tokens: DataFrame, token: str, rare_most: int = 2, frequent_least: int = 5, edits: int = 1) -> DataFrame:
    """rare, frequent, n: rare tokens (6 letters or more) one edit away from frequent ones.

    Both sides are keyed by the token and by each token with one letter left out: two tokens an edit apart always share a key, so this is an
    equality join on short keys and neither all pairs nor a cross join; the edit distance is verified after it.
    """
    if edits != 1:
        raise ValueError("the keys find one edit")
    n = tokens.groupBy(F.col(token).alias("t")).agg(F.count("*").alias("n")).where(F.length("t") >= 5)
    keys = F.explode(F.array_distinct(F.concat(F.array("t"), F.transform(F.sequence(F.lit(1), F.length("t")), lambda k: F.concat(F.substring("t", F.lit(1), k - 1), F.substring("t", k + 1, F.length("t")))))))
    keyed = n.select("t", "n", keys.alias("key"))
    rare = keyed.where((F.col("n") <= rare_most) & (F.length("t") >= 6)).select(F.col("t").alias("rare"), "key")
    often = keyed.where(F.col("n") >= frequent_least).select(F.col("t").alias("frequent"), "n", "key")
    return rare.join(often, "key").where(F.levenshtein("rare", "frequent") == 1).select("rare", "frequent", "n").distinct()


def box_problem(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Why a box is no place on its page; null if it is one, or if the size of the page isn't known."""
    sides = (left, top, right, bottom)
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    bad = ~(finite(left) & finite(top) & finite(right) & finite(bottom))
    empty = (F.abs(right - left) <= 1e-9) | (F.abs(top - bottom) <= 1e-9)
    out = (F.greatest(left, right) < -1) | (F.least(left, right) > width + 1) | (F.greatest(top, bottom) < -1) | (F.least(top, bottom) > height + 1)
    none = sides[0].isNull() & sides[1].isNull() & sides[2].isNull() & sides[3].isNull()
    return F.when(none, "missing_bbox").when(bad, "invalid_bbox").when(empty, "degenerate_bbox").when((width > 0) & (height > 0) & out, "bbox_outside_page")


def heading_levels(headings: DataFrame) -> DataFrame:
    """headings (book, place, text, level) -> of each numbering scheme and depth in a book: n, the commonest level (the first seen of equals), its support, and how many stand two levels or more from it."""
    from lodestone.functions import scalars

    h = headings.select("book", "place", "level", scalars.heading(F.col("text")).alias("h")).where("h IS NOT NULL").select("book", "h.scheme", "h.depth", "level", "place")
    counts = h.groupBy("book", "scheme", "depth", "level").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    mode = counts.groupBy("book", "scheme", "depth").agg(F.sum("c").alias("n"), F.max_by("level", F.struct("c", -F.col("first"))).alias("mode"), F.max("c").alias("support"))
    far = F.sum(F.when(F.abs(F.col("level") - F.col("mode")) >= 2, F.col("c")).otherwise(0)).alias("anomalies")
    return counts.drop("first").join(mode, ["book", "scheme", "depth"]).groupBy("book", "scheme", "depth", "n", "mode", "support").agg(far)
