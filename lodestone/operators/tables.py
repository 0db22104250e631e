"""Tables cut into chunks: what kind of content a chunk is, which labels its numbers have, and evidence stitched from the fragments of one table.

Shapes and counts are column expressions over a chunk's lines. Context and stitching go by windows over the chunks of a book's table reference, in order; what is
gathered to a row is one table's fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, tokens

# Table lines, labels, numbers, and the heads of part lists that lost their columns.
SEPARATOR_CELL = "^:?-{3,}:?$"
LABEL = r"\b[A-Za-z][A-Za-z-]{1,}\b"
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:[.,]\d+)?(?:\s*[%°])?(?![A-Za-z])"
PARTS_LIST = r"(?is)\bitem\b.{0,80}\b(?:qty|quantity)\b.{0,100}\b(?:article(?:\s+no)?|part(?:\s+no|\s+number)?)\b.{0,120}\bdescription\b"
CONTEXT_CHUNKS, CONTEXT_PAGES, LEAST_TOKENS = 8, 1, 64


def lines(raw: Column) -> Column:
    """The lines of a text that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\r?\n|\r"), lambda x: F.trim(x)), lambda x: x != "")


def cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(F.trim(line), F.lit("|")), r"\|"), lambda c: F.trim(c))


def is_separator(line: Column) -> Column:
    """Whether a line is cells of dashes alone, two or more; few lines have neither letter nor digit, and only these are cut into cells."""
    split = let(cells(line), lambda c: (F.size(c) >= 2) & F.forall(c, lambda x: x.rlike(SEPARATOR_CELL)))
    return F.when(line.rlike(r"^[\s|:-]*-[\s|:-]*$"), split).otherwise(F.when(line.isNotNull(), False))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[ \t]+", " ")


def shape(raw: Column) -> Column:
    """struct<table_like, header_only, fragment>: mostly lines with columns; a head without data; data lines among which some have lost their columns."""
    piped = lambda x: x.contains("|")

    def of(ls: Column) -> Column:
        head = (F.size(ls) >= 2) & F.coalesce(piped(F.get(ls, F.lit(0))) & is_separator(F.get(ls, F.lit(1))), F.lit(False))
        data = F.filter(F.slice(ls, 3, F.greatest(F.lit(0), F.size(ls) - 2)), lambda x: x.rlike("[A-Za-z0-9]"))
        mostly = (F.size(ls) > 0) & (F.size(F.filter(ls, piped)) >= 0.7 * F.size(ls))
        return let(F.struct(head.alias("head"), mostly.alias("mostly"), F.when(head, data).otherwise(F.array_repeat(F.lit(""), F.lit(0))).alias("data")), told)

    def told(x: Column) -> Column:
        some = F.size(x["data"]) > 0
        return F.struct((x["mostly"] | x["head"]).alias("table_like"), (x["head"] & ~some).alias("header_only"), (x["head"] & some & F.exists(x["data"], lambda d: ~piped(d))).alias("fragment"))

    return let(lines(raw), of)


def labels(raw: Column) -> Column:
    """struct<alpha, numeric, density>: labels, numbers, and the share of labels among both (1 if there are none)."""
    counted = F.struct(*[F.regexp_count(F.coalesce(raw, F.lit("")), F.lit(p)).alias(n) for n, p in (("alpha", LABEL), ("numeric", NUMBER))])
    both = lambda x: x["alpha"] + x["numeric"]
    return let(counted, lambda x: F.struct(x["alpha"].alias("alpha"), x["numeric"].alias("numeric"), F.when(both(x) > 0, x["alpha"] / both(x)).otherwise(1.0).alias("density")))


def headless(x: Column) -> Column:
    """Whether these ``labels`` are those of numbers without a head."""
    return (x["numeric"] >= 4) & (x["alpha"] <= 2) & (x["density"] < 0.20)


def lacks_header(raw: Column) -> Column:
    return let(labels(raw), headless)


def header_cells(raw: Column) -> Column:
    """The cells of the line that reads most like a head: many labels, many cells, few numbers; the first of equals. None if no line has two labels."""
    def rated(line: Column, i: Column) -> Column:
        count = lambda filled, p: F.aggregate(filled, F.lit(0), lambda n, c: n + F.regexp_count(c, F.lit(p)))
        score = lambda filled: let(count(filled, LABEL), lambda n: F.when((F.size(filled) >= 2) & (n >= 2), F.struct((n * 10 + F.size(filled) - count(filled, NUMBER)).alias("score"), (-i).alias("i"), filled.alias("cells"))))
        return F.when(line.contains("|") & ~is_separator(line), let(F.filter(cells(line), lambda c: c != ""), score))

    best = F.array_max(F.array_compact(F.transform(lines(raw), rated)))
    return F.coalesce(best["cells"], F.expr("cast(array() AS array<string>)"))


def clean_fragment(raw: Column, header: Column) -> Column:
    """The lines of a fragment without separators and repeats of its head."""
    head = F.lower(compact(F.array_join(header, " | ")))
    bare = lambda x: compact(F.btrim(x, F.lit("|")))
    keep = lambda x, h: ~is_separator(x) & let(bare(x), lambda y: (y != "") & ~((h != "") & (F.lower(y) == h))) & ~x.rlike("^[-:| ]{3,}$")
    return let(head, lambda h: F.array_join(F.filter(lines(raw), lambda x: keep(x, h)), "\n"))


def content_type(raw: Column, has_table_ref: Column) -> Column:
    return let(shape(raw), lambda s: _kind(s, raw, has_table_ref))


def _kind(s: Column, raw: Column, has_table_ref: Column) -> Column:
    listed = (F.length(compact(raw)) >= 24) & F.substring(compact(raw), 1, 500).rlike(PARTS_LIST)
    table = s["table_like"] | F.coalesce(has_table_ref, F.lit(False)) | F.coalesce(listed, F.lit(False))
    return F.when(s["header_only"], "table_header_only").when(s["fragment"], "table_fragment").when(table, "table").otherwise("prose")


def describe(chunks: DataFrame, most_tokens: int) -> DataFrame:
    """Adds kind, warnings, eligible, quality, searchable, shape, labels of chunks (raw_text, page, table_ref, n_tokens, repetition, a share)."""
    # Exploded from an array of one: what follows names these parts often, and each is to be read from the text once.
    read = F.struct(shape(F.col("raw_text")).alias("shape"), labels(F.col("raw_text")).alias("labels"), F.size(tokens(F.col("raw_text"))).alias("searchable"))
    c = chunks.select("*", F.explode(F.array(read)).alias("__read")).select("*", "__read.*").drop("__read")
    c = c.withColumn("kind", _kind(F.col("shape"), F.col("raw_text"), F.col("table_ref").isNotNull()))
    related = F.col("kind") != "prose"
    flags = {
        "OVERSIZED_CHUNK": (F.coalesce("n_tokens", F.lit(0)) > most_tokens, 20), "PAGE_UNKNOWN": (F.col("page").isNull(), 10), "NO_ITEM_REFERENCE": (F.col("table_ref").isNull(), 8), "TABLE_FRAGMENT": (F.col("kind") == "table_fragment", 12),
        "TABLE_HEADER_ONLY": (F.col("kind") == "table_header_only", 0), "TABLE_DATA_WITHOUT_HEADER": (related & headless(F.col("labels")), 35), "TOO_LITTLE_SEARCHABLE_TEXT": (F.col("searchable") < 2, 35), "REPETITIVE_OCR_BLOCK": (F.coalesce("repetition", F.lit(0.0)) >= 0.40, 35),
    }
    off = sum((F.when(test, F.lit(points)).otherwise(0) for test, points in flags.values()), F.lit(0))
    eligible = (F.trim(F.coalesce("raw_text", F.lit(""))) != "") & (F.col("searchable") >= 2) & (F.col("kind") != "table_header_only") & (F.coalesce("repetition", F.lit(0.0)) < 0.40)
    c = c.withColumns({"warnings": F.array_compact(F.array(*[F.when(test, name) for name, (test, _) in flags.items()])), "eligible": eligible})
    return c.withColumn("quality", F.greatest(F.lit(0), F.least(100 - off, F.when(F.col("eligible"), 100).otherwise(45))))


def with_context(chunks: DataFrame) -> DataFrame:
    """Adds anchor, distance, anchor_cells, continuation: the last chunk before with a head of the same table, at most CONTEXT_CHUNKS chunks and CONTEXT_PAGES pages back."""
    own = F.col("table_ref").isNotNull() & (F.size("header") > 0)
    before = Window.partitionBy("book", "table_ref").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(own, F.struct("chunk_id", "chunk_index", F.coalesce("page", F.lit(0)).alias("page"), F.col("header").alias("cells"))), ignorenulls=True).over(before)
    c = chunks.withColumn("header", header_cells(F.col("raw_text"))).withColumn("__last", last)
    far, pages = F.col("chunk_index") - F.col("__last.chunk_index"), F.coalesce("page", F.col("__last.page")) - F.col("__last.page")
    fits = F.col("table_ref").isNotNull() & far.between(1, CONTEXT_CHUNKS) & pages.between(0, CONTEXT_PAGES)
    torn = (pages > 0) | F.col("kind").isin("table_fragment", "table_header_only") | F.array_contains("warnings", "TABLE_DATA_WITHOUT_HEADER")
    return c.withColumns({"anchor": F.when(fits, F.col("__last.chunk_id")), "distance": F.when(fits, far), "anchor_cells": F.when(fits, F.col("__last.cells")), "continuation": F.when(fits, torn)}).drop("__last")


def stitched(chunks: DataFrame, most_tokens: int) -> DataFrame:
    """A row of evidence for each window of a torn table: chunks of one reference in unbroken order, on the same page or the next, two or more, with at least one fragment, head or headless piece.

    The head is the widest one found. Its labels stand before the pieces, which are packed in order while the tokens stay within ``most_tokens`` (LEAST_TOKENS at least).
    """
    w = Window.partitionBy("book", "table_ref").orderBy("page", "chunk_index")
    t = chunks.where("table_ref IS NOT NULL AND page IS NOT NULL").withColumn("header", header_cells(F.col("raw_text")))
    step = (F.col("chunk_index") != F.lag("chunk_index").over(w) + 1) | ~(F.col("page") - F.lag("page").over(w)).between(0, 1)
    t = t.withColumn("__break", F.coalesce(step, F.lit(True)).cast("int")).withColumn("__island", F.sum("__break").over(w))
    torn = F.col("kind").isin("table_header_only", "table_fragment") | F.array_contains("warnings", "TABLE_DATA_WITHOUT_HEADER") | F.trim("raw_text").rlike(r"^\|?---")
    piece = F.struct("chunk_index", "chunk_id", "page", "raw_text", "heading", F.col("header").alias("cells"))
    g = t.groupBy("book", "table_ref", "__island").agg(F.array_sort(F.collect_list(piece)).alias("rows"), F.bool_or(torn).alias("torn")).where("torn AND size(rows) >= 2")
    widest = F.array_max(F.transform("rows", lambda r, i: F.struct(F.size(r["cells"]).alias("n"), (-i).alias("i"), r["cells"].alias("cells"))))["cells"]
    g = g.withColumn("header", widest).where("size(header) > 0")
    heads = F.array_distinct(F.filter(F.transform("rows", lambda r: F.trim(F.coalesce(r["heading"], F.lit("")))), lambda h: h != ""))
    section = F.when(F.size(heads) > 0, F.concat(F.lit("Section: "), F.array_join(F.slice(heads, F.greatest(F.lit(1), F.size(heads) - 3), 4), " > ")))
    g = g.withColumn("base", F.concat_ws("\n", section, F.concat(F.lit("Table columns: "), F.array_join("header", " | "))))
    g = g.withColumn("pieces", F.filter(F.transform("rows", lambda r: F.struct(r["chunk_id"].alias("id"), clean_fragment(r["raw_text"], F.col("header")).alias("text"))), lambda p: p["text"] != ""))
    g = g.withColumn("sized", F.transform("pieces", lambda p: F.struct(p["id"].alias("id"), p["text"].alias("text"), F.size(tokens(p["text"])).alias("n")))).withColumn("room", F.greatest(F.lit(LEAST_TOKENS), F.lit(most_tokens)) - F.size(tokens(F.col("base"))))
    # A line end never stands inside a token, so a window's tokens are those of its parts.
    start = F.struct(F.lit(0).alias("window"), F.lit(0).alias("used"), F.expr("cast(array() AS array<struct<window:int,id:string,text:string>>)").alias("out"))
    full = lambda s, p: (s["used"] > 0) & (s["used"] + p["n"] > F.col("room"))
    place = lambda s, p: F.when((F.size(s["out"]) == 0) | full(s, p), s["window"] + 1).otherwise(s["window"])
    pack = lambda s, p: F.struct(place(s, p).alias("window"), F.when(full(s, p), p["n"]).otherwise(s["used"] + p["n"]).alias("used"), F.concat(s["out"], F.array(F.struct(place(s, p).alias("window"), p["id"].alias("id"), p["text"].alias("text")))).alias("out"))
    g = g.withColumn("packed", F.aggregate("sized", start, pack, lambda s: s["out"])).withColumn("windows", F.array_distinct(F.transform("packed", lambda p: p["window"])))
    out = g.select("book", "table_ref", "base", "packed", F.array_min(F.transform("rows", lambda r: r["page"])).alias("first_page"), F.array_max(F.transform("rows", lambda r: r["page"])).alias("last_page"), F.size("rows").alias("n_chunks"), F.explode("windows").alias("window"))
    mine = F.filter("packed", lambda p: p["window"] == F.col("window"))
    table = F.coalesce(F.regexp_extract("table_ref", r"^#/tables/(\d+)$", 1).try_cast("int"), F.lit(0))
    out = out.select("book", F.format_string("TBL-%06d-P%04d-%03d", table, "first_page", "window").alias("evidence_id"), "table_ref", F.concat_ws("\n", "base", F.array_join(F.transform(mine, lambda p: p["text"]), "\n")).alias("text"), F.array_join(F.transform(mine, lambda p: p["id"]), ",").alias("sources"), "n_chunks", (F.col("last_page") > F.col("first_page")).alias("cross_page"))
    return out.withColumn("n_tokens", F.size(tokens(F.col("text")))).where("n_tokens >= 2")
