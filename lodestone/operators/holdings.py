"""What a collection holds and what it still needs: search in pictures, identifiers in tables, inventories, readiness, backfills by version, provenance, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import normalized
from lodestone.operators.features import bounded
from lodestone.operators.retrieval import lexical_scores

# Words around an address, classes of technical pictures, how much a page counts for a picture, and the least confidence.
CONTACT = r"(?i)\b(?:tel|telephone|fax|phone|mobile|contact|office|address|www|email|e-mail)\b"
TECHNICAL = ["engineering_drawing", "flow_chart", "screenshot_from_manual", "table", "line_chart", "bar_chart", "box_plot", "full_page_image", "geographical_map"]
SAME_PAGE, NEXT_PAGE, INCIDENTAL = 1.5, 0.35, 15.0


def search_pictures(pictures: DataFrame, asked: DataFrame, preferred: DataFrame, k: int = 3, depth: int = 20) -> DataFrame:
    """pictures (id, scope, source, picture, pages array<int>, text), asked (query_id, scope, text), preferred (query_id, page) -> query_id, rank, id, score, affinity.

    Pictures are found by their words alone, the first max(depth, 5 k) of each question; a picture on a preferred page, or beside one, then moves up. Pages of a picture
    meet preferred pages by equality, each with its neighbours, so no pair of pages is listed that is of no use.
    """
    docs = pictures.select("id", "scope", "text")
    found = lexical_scores(docs, asked, scoped=True)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("score", F.round("score", 6)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(depth, 5 * k)).join(pictures.select("id", "source", "picture", "pages"), "id")
    near = preferred.select("query_id", F.explode(F.array(*[F.struct((F.col("page") + d).alias("page"), F.lit(d == 0).alias("same")) for d in (-1, 0, 1)])).alias("p")).select("query_id", "p.page", "p.same")
    on = found.select("query_id", "id", F.explode(F.coalesce("pages", F.array().cast("array<int>"))).alias("page")).join(near.groupBy("query_id", "page").agg(F.max("same").alias("same")), ["query_id", "page"])
    best = on.groupBy("query_id", "id").agg(F.max("same").alias("same"))
    j = found.join(best, ["query_id", "id"], "left")
    gain = F.when(F.col("same"), SAME_PAGE).when(F.col("same").isNotNull(), NEXT_PAGE).otherwise(0.0)
    affinity = F.when(F.col("same"), "same_page").when(F.col("same").isNotNull(), "adjacent_page").otherwise("query_match")
    j = j.withColumns({"score": F.col("score") + gain, "affinity": affinity})
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("source", F.lit("")), F.coalesce("picture", F.lit(0)), "id")
    return j.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 4).alias("score"), "affinity")


def defines_identifier(text: Column, identifier: Column) -> Column:
    """Whether a line of cells holds the identifier as a cell and a cell of words beside it: ``motor | 2141``."""
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    wanted = F.lower(identifier)
    says = lambda line: F.contains(line, F.lit("|")) & F.exists(cells(line), lambda c: normalized(c) == wanted) & F.exists(cells(line), lambda c: (normalized(c) != wanted) & c.rlike("[A-Za-z]{2}"))
    return F.coalesce(F.exists(F.split(F.coalesce(text, F.lit("")), r"\n"), says), F.lit(False))


def incidental_penalty(text: Column, identifiers: Column) -> Column:
    """What a text loses for lines in which an identifier stands beside an address or a telephone number."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\n")
    hit = F.filter(lines, lambda line: line.rlike(CONTACT) & F.exists(identifiers, lambda i: bounded(line, i)))
    return -INCIDENTAL * F.size(hit)


def picture_inventory(pictures: DataFrame, least: float) -> DataFrame:
    """pictures (book, picture, page, predictions array<struct<class, confidence>>) -> book, picture, page, class, confidence, inventory, review.

    inventory: a technical picture. review: its class is not known, or not with enough confidence for a technical one. The first of the most confident predictions counts.
    """
    best = F.array_max(F.transform("predictions", lambda p, i: F.struct(p["confidence"].alias("c"), (-i).alias("i"), p["class"].alias("k"))))
    p = pictures.withColumn("best", best).select("book", "picture", "page", F.col("best.k").alias("class"), F.round("best.c", 4).alias("confidence"))
    known = F.coalesce(F.col("class").isin(TECHNICAL), F.lit(False))
    return p.withColumns({"inventory": known, "review": F.col("confidence").isNull() | known & (F.col("confidence") < least)})


def readiness(books: DataFrame, machines: DataFrame) -> DataFrame:
    """One row: books, indexed, searchable, excluded, oversized, visuals, machines, machines_ready.

    books (book, index_ready, searchable, excluded, oversized, visuals), machines (machine, book): a machine is ready if it has books and all of them are.
    """
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    b = books.agg(F.count("*").alias("books"), F.count_if("index_ready").alias("indexed"), *[n(c) for c in ("searchable", "excluded", "oversized", "visuals")])
    held = machines.join(books.select("book", F.coalesce("index_ready", F.lit(False)).alias("ready")), "book", "left").groupBy("machine").agg(F.min(F.coalesce("ready", F.lit(False))).alias("ready"))
    return b.crossJoin(held.agg(F.count("*").alias("machines"), F.count_if("ready").alias("machines_ready")))  # one row each


def backfill_due(rows: DataFrame, entries: DataFrame, version: str) -> DataFrame:
    """The rows (generation, target, route) whose entry isn't there in this version of the rules, with its id and the version that is there.

    An entry counts as done only under the current version, so a change of the rules makes all of them due again and nothing twice.
    """
    kind = F.when(F.col("target") == "text_lane", "text").otherwise("vision")
    r = rows.withColumn("entry", F.concat_ws(":", F.coalesce("generation", F.lit("")), kind, F.coalesce("route", F.lit(""))))
    seen = entries.groupBy("entry").agg(F.max(F.coalesce("version", F.lit("")) == version).alias("current"), F.max("version").alias("version"))
    return r.join(seen, "entry", "left").where(~F.coalesce("current", F.lit(False))).drop("current").withColumnRenamed("version", "seen_version")


def provenance(refs: DataFrame) -> DataFrame:
    """refs (chunk, place, entry, source_type, table, cell, source) -> chunk, place, key, n: each correction once in a chunk, where it comes first, numbered in that order.

    A correction without an id is known by its source.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("source_type", "table", "cell", "source")]
    key = F.coalesce(F.col("entry").cast("string"), F.concat_ws(":", *parts))
    once = refs.withColumn("key", key).groupBy("chunk", "key").agg(F.min("place").alias("place"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("chunk").orderBy("place", "key"))).select("chunk", "place", "key", "n")


def renumbered(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds chunk_index from 0 and chunk_id in each book, in the given order: the same chunks always get the same numbers.

    A book is not sorted in one task: rows are counted by the first order column, only its different values are sorted together, and rows are numbered inside each.
    """
    first, *rest = order
    spans = chunks.groupBy("book", first).agg(F.count("*").alias("span"))
    before = F.sum("span").over(Window.partitionBy("book").orderBy(first)) - F.col("span")
    inside = F.row_number().over(Window.partitionBy("book", first).orderBy(*rest) if rest else Window.partitionBy("book", first).orderBy(F.lit(0)))
    starts = spans.select(F.col("book").alias("b"), F.col(first).alias("f"), before.alias("before"))
    j = chunks.withColumn("inside", inside).join(starts, F.col("book").eqNullSafe(F.col("b")) & F.col(first).eqNullSafe(F.col("f")))
    index = F.col("before") + F.col("inside") - 1
    return j.withColumns({"chunk_index": index, "chunk_id": F.format_string("CHK-%06d", index + 1)}).select(*chunks.columns, "chunk_index", "chunk_id")


def request_scope(book: Column, machine: Column) -> Column:
    """What is wrong with the scope of a request: it has to name one book or one machine, not both and not neither; null if it is sound."""
    has_machine = F.trim(F.coalesce(machine.cast("string"), F.lit(""))) != ""
    return F.when(book.isNotNull() & has_machine, "BOTH_SCOPES").when(book.isNull() & ~has_machine, "NO_SCOPE")
