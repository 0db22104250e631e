"""References in a text to other parts of its book, and what in the book they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, normalized, tokens

# How references are written, with the places of title and section among the groups of each (0: none).
PATTERNS = [
    (r"(?i)\b(?:see|refer\s+to)\s+(?:the\s+)?(?:instruction\s+)?[\"“”'](?<title>[^\"“”']{2,140})[\"“”'](?:\s*,?\s*(?:in|under)?\s*(?:section|chapter|clause)\s+(?<section>[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))?", 1, 2),
    (r"(?i)\b(?:see|refer\s+to)\s+(?:the\s+)?(?:instruction\s+)?(?:under|in)?\s*(?:section|chapter|clause)\s+(?<section>[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)\s*[,;:]?\s*[\"“”'](?<title>[^\"“”']{2,140})[\"“”']", 2, 1),
    (r"(?i)\b(?:see|refer\s+to)\s+(?:the\s+)?(?<title>[A-Za-z][A-Za-z0-9 /&()_-]{2,100}?)(?:\s*,?\s*(?:in|under)?\s*(?:section|chapter|clause)\s+(?<section>[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))(?=[.;,]|$)", 1, 2),
    (r"(?i)\b(?:see|refer\s+to)\s+(?:instruction\s+)?(?:in|under)?\s*(?:section|chapter|clause)\s+(?<section>[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)", 0, 1),
]
NO_TITLES = ["instruction", "instruction in", "the instruction"]
MOST = 8


def cross_references(text: Column) -> Column:
    """array<struct<title, section, label>>: explicit references in the order of the patterns and places, each once; a bare section that a titled one begins with is left out."""
    text = F.coalesce(text, F.lit(""))
    found = []
    for pattern, title, section in PATTERNS:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) if g else None for g in (title, section)]
        titles = groups[0] if title else F.transform(groups[1], lambda x: F.lit(""))
        found.append(F.zip_with(titles, groups[1], lambda a, b: F.struct(F.btrim(F.regexp_replace(a, r"\s+", " "), F.lit(" .,:;-")).alias("title"), F.btrim(b, F.lit(" .,:;")).alias("section"))))
    named = F.transform(F.concat(*found), lambda r: F.struct(F.when(F.lower(r["title"]).isin(NO_TITLES), "").otherwise(r["title"]).alias("title"), r["section"].alias("section")))
    key = lambda r: F.concat(F.lower(r["title"]), F.lit("\u0001"), F.lower(r["section"]))
    label = lambda r: F.when((r["title"] != "") & (r["section"] != ""), F.concat(r["title"], F.lit(" · section "), r["section"])).when(r["title"] != "", r["title"]).otherwise(F.concat(F.lit("Section "), r["section"]))
    first = lambda said: let(F.transform(said, key), lambda keys: F.filter(said, lambda r, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    bare = lambda once: let(F.transform(F.filter(once, lambda r: (r["title"] != "") & (r["section"] != "")), lambda r: r["section"]), lambda titled: F.filter(once, lambda r: (r["title"] != "") | ~F.exists(titled, lambda s: F.startswith(s, r["section"]))))
    kept = let(let(F.filter(named, lambda r: (r["title"] != "") | (r["section"] != "")), first), bare)
    return F.slice(F.transform(kept, lambda r: F.struct(r["title"].alias("title"), r["section"].alias("section"), label(r).alias("label"))), 1, MOST)


def match_score(text: Column, headings: Column, title: Column, section: Column) -> Column:
    """How well a row fits a title and a section: its headings count most, then its text, then shared words."""
    name, in_text = normalized(title), normalized(text)
    heads = F.transform(headings, normalized)
    by_head = F.when(F.array_contains(heads, name), 12.0).when(F.exists(heads, lambda h: F.contains(h, name)), 9.0).otherwise(0.0)
    wanted = F.array_distinct(tokens(title))
    shared = F.size(F.array_intersect(wanted, tokens(F.concat_ws(" ", text, F.array_join(headings, " "))))) / F.greatest(F.lit(1), F.size(wanted))
    by_title = F.when(name != "", by_head + F.when(F.contains(in_text, name), 5.0).otherwise(0.0) + 4.0 * shared).otherwise(0.0)
    # An identifier ends where no letter, digit or joining sign follows; the section is quoted, so its dots are dots.
    bounded = F.concat(F.lit(r"(?i)(?<![a-z0-9./:+-])\Q"), section, F.lit(r"\E(?![a-z0-9]|[./:+-][a-z0-9])"))
    by_section = F.when(F.exists(headings, lambda h: F.regexp_like(h, bounded)), 2.5).when(F.regexp_like(text, bounded), 0.5).otherwise(0.0)
    return by_title + F.when(F.coalesce(section, F.lit("")) != "", by_section).otherwise(0.0)


def follow(asked: DataFrame, rows: DataFrame, k: int = 5, relevance: str | None = None) -> DataFrame:
    """asked (ask, book, title, section) and rows (book, chunk_index, page, text, headings, content_type, quality, and perhaps a relevance to the question) -> ask, chunk_index, score, place.

    The rows that fit best are anchors; others count by their distance to the nearest anchor in pages and chunks, which two windows find without pairing rows. With a
    relevance, a row near an anchor may enter without fitting the reference itself.
    """
    j = asked.join(rows, "book").withColumn("ref", match_score(F.col("text"), F.col("headings"), F.col("title"), F.coalesce("section", F.lit(""))))
    # What fits neither a reference nor the question is no anchor and never counts; the rest goes on without its text, and sorted once for all that asks for it.
    j = j.where((F.col("ref") > 0) | (F.col(relevance) > 0) if relevance else F.col("ref") > 0)
    j = j.select("ask", "chunk_index", "page", "ref", "content_type", "quality", *([relevance] if relevance else []))
    j = j.repartition("ask").sortWithinPartitions("ask", "chunk_index")
    j = j.withColumn("__anchor", F.col("ref") >= F.greatest(F.lit(5.0), F.max("ref").over(Window.partitionBy("ask")) - 2.5))

    def nearest(column: str) -> Column:
        w = Window.partitionBy("ask").orderBy(column)
        of = F.when(F.col("__anchor"), F.col(column))
        before = F.last(of, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
        after = F.first(of, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
        return F.least(F.col(column) - before, after - F.col(column))

    j = j.withColumns({"__pages": F.when(F.col("page").isNotNull(), nearest("page")), "__chunks": nearest("chunk_index")})
    close = F.greatest(F.lit(0.0), F.when(F.col("__pages") <= 12, 3.2 * (1 - F.col("__pages") / 13)), F.when(F.col("__chunks") <= 24, 2.2 * (1 - F.col("__chunks") / 25)))
    if relevance:
        j = j.where((F.col("ref") > 0) | ((close > 0) & (F.col(relevance) > 0)))
        score = F.col("ref") * 0.35 + F.col(relevance) * 1.80 + close
    else:
        j, score = j.where("ref > 0"), F.col("ref") + close
    score = (score + F.when(F.col("content_type") == "prose", 0.25).otherwise(0.0)) * (0.9 + F.coalesce(F.nullif("quality", F.lit(0)), F.lit(100)) / 100 * 0.1)
    j = j.withColumn("score", F.bround(score, 4)).where("score > 0")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "chunk_index"))).where(F.col("place") <= k).select("ask", "chunk_index", "score", "place")
