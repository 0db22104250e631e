"""Machines and their manuals: a registry of nested manuals joined to the books there are, its edits with their rules, and the scope of a search.

The registry is a table of machines with an array of manuals; its edits explode, check and nest again. A machine's manuals are few, so its array is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a manual may be, and what authority it may have.
MANUAL_TYPES = ["operation", "maintenance", "parts", "troubleshooting", "installation", "electrical", "other"]
AUTHORITIES = ["authoritative", "historical", "draft"]


def books_by_id(books: DataFrame) -> DataFrame:
    """Books with a positive id, the last of those with one id."""
    w = Window.partitionBy("book").orderBy(F.desc("seen_at"))
    return books.where("book > 0").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def assigned(registry: DataFrame, books: DataFrame) -> DataFrame:
    """A row for each manual of a machine whose book there is; authority defaults to authoritative, type to other."""
    m = registry.select("machine", F.explode("manuals").alias("m")).select("machine", F.col("m.book").alias("book"), F.coalesce("m.type", F.lit("other")).alias("type"), F.coalesce("m.authority", F.lit("authoritative")).alias("authority"), F.col("m.supersedes").alias("supersedes"))
    return m.join(books, "book").withColumn("active", F.col("authority") == "authoritative")


def catalog(registry: DataFrame, books: DataFrame) -> DataFrame:
    """Of each machine: manuals, active ones, those with an index, and whether it can be searched (all active ones have one, and there is one)."""
    ready = lambda c: F.count_if(F.col("active") & F.col(c))
    a = assigned(registry, books).groupBy("machine").agg(F.count("*").alias("manuals"), F.count_if("active").alias("active"), ready("ready").alias("ready"), ready("hybrid").alias("hybrid"))
    out = registry.select("machine").join(a, "machine", "left").fillna(0)
    return out.withColumns({"searchable": (F.col("active") > 0) & (F.col("ready") == F.col("active")), "hybrid_ready": (F.col("active") > 0) & (F.col("hybrid") == F.col("active"))})


def unassigned(registry: DataFrame, books: DataFrame) -> DataFrame:
    return books.join(assigned(registry, books).select("book"), "book", "left_anti")


def scope(registry: DataFrame, books: DataFrame, machine: Column) -> DataFrame:
    """The books a machine's search reads: those of its active manuals."""
    return books.join(assigned(registry, books).where(F.col("active") & (F.col("machine") == machine)).select("book"), "book", "left_semi")


def problems(proposed: DataFrame, registry: DataFrame, books: DataFrame) -> DataFrame:
    """What speaks against machines as proposed (machine, name, manuals): each machine and problem once. None means that it may be saved."""
    m = proposed.select("machine", F.posexplode("manuals").alias("place", "m")).select("machine", "place", "m.*")
    m = m.join(books.select("book", F.lit(True).alias("__there")), "book", "left")
    others = registry.select(F.col("machine").alias("__owner"), F.explode("manuals.book").alias("book"))
    mine = proposed.select("machine", F.col("manuals.book").alias("__books"))
    s = m.join(mine, "machine")
    authority = F.lower(F.trim(F.coalesce("authority", F.lit("authoritative"))))
    strange = F.col("supersedes").isNotNull() & ((F.col("supersedes") == F.col("book")) | ~F.array_contains("__books", F.col("supersedes")))
    row = F.array_compact(F.array(
        F.when(F.col("__there").isNull(), "UNKNOWN_BOOK"), F.when(~F.lower(F.trim(F.coalesce("type", F.lit("other")))).isin(MANUAL_TYPES), "UNKNOWN_TYPE"), F.when(~authority.isin(AUTHORITIES), "UNKNOWN_AUTHORITY"), F.when(F.coalesce(strange, F.lit(False)), "SUPERSEDES_OUTSIDE"),
    ))
    rows = s.select("machine", F.explode(row).alias("problem"))
    taken = m.join(others, "book").where(F.col("__owner") != F.col("machine")).select("machine", F.lit("BOOK_OF_ANOTHER_MACHINE").alias("problem"))
    none = proposed.where(F.trim(F.coalesce("name", F.lit(""))) == "").select("machine", F.lit("NAME_MISSING").alias("problem"))
    empty = proposed.where(F.size("manuals") < 1).select("machine", F.lit("NO_MANUALS").alias("problem"))
    led = s.groupBy("machine").agg(F.bool_or(authority == "authoritative").alias("led")).where("NOT led").select("machine", F.lit("NO_AUTHORITATIVE_MANUAL").alias("problem"))
    return rows.unionByName(taken).unionByName(none).unionByName(empty).unionByName(led).distinct()


def upsert(registry: DataFrame, proposed: DataFrame, books: DataFrame) -> DataFrame:
    """The registry with the machines that nothing speaks against, new or in place of the old."""
    sound = proposed.join(problems(proposed, registry, books).select("machine"), "machine", "left_anti").select(*registry.columns)
    return registry.join(sound.select("machine"), "machine", "left_anti").unionByName(sound)


def without_book(registry: DataFrame, gone: Column) -> DataFrame:
    """The registry without a book: its manual goes, what it superseded no longer names it, and machines without manuals go too."""
    kept = F.transform(F.filter("manuals", lambda m: m["book"] != gone), lambda m: m.withField("supersedes", F.when(m["supersedes"] != gone, m["supersedes"])))
    return registry.withColumn("manuals", kept).where(F.size("manuals") > 0)


def single_owner(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """cases (case, book) -> the machine of each case, if its books have exactly one owner."""
    owners = registry.select("machine", F.explode("manuals.book").alias("book"))
    return cases.join(owners, "book").groupBy("case").agg(F.min("machine").alias("machine"), F.count_distinct("machine").alias("__n")).where("__n = 1").drop("__n")


def row_key(model: Column, prefix: Column, *parts: Column) -> Column:
    """Key of a cached vector: model, prefix and what was embedded, with a separator that none of them holds."""
    return F.sha2(F.concat_ws("\u0000", model, prefix, *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def index_status(rows: Column, indexed_rows: Column, fingerprint: Column, indexed_fingerprint: Column, has_source: Column) -> Column:
    """missing_source, not_built, stale or ready."""
    stale = (rows != indexed_rows) | (fingerprint != indexed_fingerprint)
    return F.when(~has_source, "missing_source").when(indexed_rows.isNull(), "not_built").when(F.coalesce(stale, F.lit(True)), "stale").otherwise("ready")


def reuse(rows: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that have a vector of their key, and those that must be embedded."""
    return rows.join(cached, "key"), rows.join(cached.select("key"), "key", "left_anti")
