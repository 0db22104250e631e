"""Scans of extracted books: texts and table cells that look misread, what runs along the edges of pages, tables that lost their context, and books against their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import lexical

# What stands for a letter, digit or underscore; words of letters with hyphens; marks of misreading; values with units; comparisons.
W = r"\p{L}\p{N}_"
ALPHA = rf"(?<![{W}-])(?:(?<=(['’]))|(?<!['’]))(\p{{L}}+(?:-\p{{L}}+)*)(?![{W}-])(?:(?=(['’]))|(?!['’]))"
REPLACEMENT = "�"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
LOWER_L = rf"(?<![{W}])(?:\d+l\d*|\d*l\d+)(?![{W}])"
UNITS_MISREAD = rf"(?<![{W}])\d+(?:[.,]\d+)?\s*(?i:Nrn|rnA|rnV|rnW)(?![{W}])|(?<![{W}])l\s*[AVW](?![{W}])"
LETTER_IN_NUMBER = rf"(?<![{W}])\d+[OoIl]\d+(?![{W}])"
UNITS = ["V", "VAC", "VDC", "A", "mA", "kA", "W", "kW", "MW", "bar", "mbar", "Pa", "kPa", "MPa", "Nm", "kNm", "°C", "°F", "Hz", "kHz", "rpm", "mm", "cm", "m", "µm", "um"]
VALUE = rf"(?i)(?<![{W}.])(?:[<>≤≥]\s*)?[+-]?\d+(?:[.,]\d+)?(?:\s*±\s*\d+(?:[.,]\d+)?)?\s*(?:(?:{'|'.join(UNITS)})(?![{W}])|%(?=[{W}]))"
COMPARISON = rf"(?i)(?<![{W}])(?:less than|greater than|at least|at most|maximum|minimum)(?![{W}])|[<>≤≥]"
#: Short words of several languages, which are no fragments.
SHORT_WORDS = ["a", "an", "and", "as", "at", "be", "by", "do", "for", "from", "if", "in", "is", "it", "no", "of", "on", "or", "so", "the", "to", "up", "we", "with", "i"]
SHORT_WORDS += ["de", "du", "la", "le", "les", "en", "et", "un", "une", "au", "aux", "des", "ce", "se", "ne", "ou", "il", "im", "zu", "am", "el", "y", "di", "da", "lo", "e"]
#: Words from which a text is judged by its fragments, and by those that repeat.
LEAST_WORDS, LEAST_FOR_REPEATS = 8, 12


def fragments(texts: DataFrame) -> DataFrame:
    """texts (id, text) -> id, words, singles, short, reasons of fragmentation.

    Fragments are words of one or two letters that are no common short words, no contractions and, alone, no capitals. Only texts whose repeats can matter are
    taken apart; the others are judged in place. Each id stands for one text.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    got = [F.regexp_extract_all(t, F.lit(ALPHA), F.lit(k)) for k in (1, 2, 3)]
    w = texts.select("id", F.arrays_zip(got[0].alias("before"), got[1].alias("word"), got[2].alias("after")).alias("w"))
    fragment = lambda x: ~F.lower(x["word"]).isin(SHORT_WORDS) & (x["before"] == "") & (x["after"] == "") & (F.length(x["word"]) <= 2) & ~x["word"].rlike(r"^\p{Lu}$")
    c = w.select("id", "w", F.size("w").alias("words"), F.size(F.filter("w", lambda x: fragment(x) & (F.length(x["word"]) == 1))).alias("singles"), F.size(F.filter("w", fragment)).alias("short"))
    again = c.where((F.col("words") >= LEAST_FOR_REPEATS) & (F.col("singles") > 0)).select("id", F.explode("w.word").alias("word")).select("id", F.lower("word").alias("word"))
    again = again.where(F.length("word").between(2, 5) & ~F.col("word").isin(SHORT_WORDS)).groupBy("id", "word").agg(F.count("*").alias("n"))
    repeats = again.groupBy("id").agg(F.max("n").alias("most"), F.count(F.when(F.col("n") >= 2, 1)).alias("twice")).where((F.col("most") >= 3) | (F.col("twice") >= 2)).select("id", F.lit("repeated_short_ocr_fragments").alias("repeated"))
    share = lambda x: F.col(x) / F.col("words")
    broken = F.when((F.col("singles") >= 3) & (share("singles") >= 0.15), "excessive_single_letter_fragments").when((F.col("singles") > 0) & (F.col("short") >= 3) & (share("short") >= 0.20), "fragmented_alpha_tokens")
    enough = F.col("words") >= LEAST_WORDS
    out = c.drop("w").join(repeats, "id", "left")
    return out.select("id", "words", "singles", "short", F.array_compact(F.array(F.when(enough, broken), F.col("repeated"))).alias("reasons"))


def suspicious(texts: DataFrame, cells: bool = False) -> DataFrame:
    """texts (id, text) -> id, reasons, technical (holds a value with a unit or a comparison) of those that look misread. ``cells``: of tables, where odd characters count by kind and digits beside letters don't."""
    t = F.coalesce(F.col("text"), F.lit(""))
    odd = lexical.odd_characters(t)
    tests = {"unicode_replacement_character": t.contains(REPLACEMENT), "control_character": t.rlike(CONTROL), "lowercase_l_inside_numeric_token": t.rlike(LOWER_L), "unit_like_ocr_confusion": t.rlike(UNITS_MISREAD)}
    if cells:
        kinds = {"private_use_character": "private", "unicode_noncharacter": "noncharacter", "replacement_character": "replacement", "control_or_surrogate_character": "control"}
        tests |= {name: odd[kind] > 0 for name, kind in kinds.items()}
    else:
        tests["numeric_letter_ambiguity"] = t.rlike(LETTER_IN_NUMBER)
    own = texts.select("id", F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])).alias("own"), (t.rlike(VALUE) | t.rlike(COMPARISON)).alias("technical"))
    both = own.join(fragments(texts).select("id", F.col("reasons").alias("broken")), "id")
    return both.select("id", F.concat("own", "broken").alias("reasons"), "technical").where(F.size("reasons") > 0)


def _placed(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with their distance from the top of the page: upper and lower edge, and the page's height."""
    sizes = pages.groupBy("book", "page").agg(F.max("height").alias("height"))
    i = items.where("page IS NOT NULL AND t IS NOT NULL AND b IS NOT NULL").join(sizes, ["book", "page"]).where("height IS NOT NULL")
    from_top = F.upper(F.coalesce("origin", F.lit("BOTTOMLEFT"))) != "BOTTOMLEFT"
    a, z = F.when(from_top, F.col("t")).otherwise(F.col("height") - F.col("t")), F.when(from_top, F.col("b")).otherwise(F.col("height") - F.col("b"))
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return i.withColumns({"upper": F.least(a, z), "lower": F.greatest(a, z), "line": line}).where("line <> ''")


def running_bands(items: DataFrame, pages: DataFrame, share: float = 0.20, least: int = 5) -> DataFrame:
    """book, band, line, pages, first_page of lines (digits as #) that stand in the top or bottom eighth of many pages of a book.

    items: book, page, text, t, b, origin (null: lower left); pages: book, page, height. The band is part of the key, so a line in the middle of pages is none.
    """
    i = _placed(items, pages)
    band = F.when(F.col("lower") < F.col("height") * 0.12, "top").when(F.col("upper") > F.col("height") * 0.88, "bottom")
    i = i.withColumn("band", band).where((F.length("line") <= 180) & F.col("band").isNotNull())
    seen = i.select("book", "band", F.regexp_replace(F.lower("line"), r"\d+", "#").alias("line"), "page").distinct()
    n = pages.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("of"))
    g = seen.groupBy("book", "band", "line").agg(F.count("*").alias("pages"), F.min("page").alias("first_page")).join(n, "book")
    return g.where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("of") * share))).drop("of")


def broken_words(items: DataFrame, pages: DataFrame) -> DataFrame:
    """book, page, place, line of items low on a page that end in a hyphen, where the book has a next page."""
    i = _placed(items, pages).where((F.col("lower") > F.col("height") * 0.75) & F.col("line").rlike(rf"[{W}]{{2,}}[-­]\s*$"))
    following = pages.select("book", (F.col("page") - 1).alias("page")).distinct()
    return i.join(following, ["book", "page"], "left_semi").select("book", "page", "place", "line")


def header_signatures(tables: DataFrame, least: int = 5) -> DataFrame:
    """tables (book, id, captions, cells array<struct<text, header>>) -> book, id, headers, repeats, finding: ``TABLE_WITHOUT_MARKED_HEADER``, or ``REPEATED_TABLE_NEEDS_CONTEXT`` where many tables of a book have the same headers and this one has no caption."""
    blank = F.expr("cast(array() AS array<string>)")
    texts = F.transform(F.filter(F.coalesce("cells", F.array().cast(tables.schema["cells"].dataType)), lambda c: F.coalesce(c["header"], F.lit(False))), lambda c: F.trim(F.regexp_replace(F.coalesce(c["text"], F.lit("")), r"\s+", " ")))
    t = tables.select("book", "id", F.coalesce("captions", F.lit(0)).alias("captions"), F.coalesce(F.filter(texts, lambda x: x != ""), blank).alias("headers")).withColumn("key", F.sha2(F.to_json("headers"), 256))
    # Counted by the digest of the headers, in the tasks first: a header that all tables share is one row a task.
    n = t.where(F.size("headers") > 0).groupBy("book", "key").agg(F.count("*").alias("repeats"))
    j = t.join(n, ["book", "key"], "left")
    finding = F.when(F.size("headers") == 0, "TABLE_WITHOUT_MARKED_HEADER").when((F.col("repeats") >= least) & (F.col("captions") == 0), "REPEATED_TABLE_NEEDS_CONTEXT")
    return j.select("book", "id", "headers", F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"), finding.alias("finding")).where("finding IS NOT NULL")


def cross_check(texts: DataFrame, pages: DataFrame, source: DataFrame) -> DataFrame:
    """Findings where a book and its source disagree: book, page, finding, measure.

    texts: book, page, place, text; pages: book, page, width, height; source: book, page, text, width, height, images. A book whose numbers of pages differ gets that
    finding alone, since its pages can't be matched. Else, page by page: sizes that differ by more than 5 %; less than 0.35 of the source page's distinct words
    of letters (of 20 or more) inside the page's text; pages of images with hardly any text. A page's text is gathered to one row; what a page holds bounds it.
    """
    n = pages.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("mine")).join(source.select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("theirs")), "book")
    unlike = n.where("mine <> theirs").select("book", F.lit(None).cast("long").alias("page"), F.lit("pdf_page_count_mismatch").alias("finding"), (F.col("theirs") - F.col("mine")).cast("double").alias("measure"))
    held = texts.where("page IS NOT NULL").groupBy("book", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("held"))
    sizes = pages.groupBy("book", "page").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    s = source.join(n.where("mine = theirs").select("book"), "book", "left_semi").join(sizes, ["book", "page"], "left").join(held, ["book", "page"], "left")
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x.rlike(r"^\p{L}+$"))
    s = s.select("book", F.col("page").cast("long").alias("page"), "width", "height", "w", "h", "images", F.lower(F.coalesce("held", F.lit(""))).alias("held"), words.alias("words"))
    s = s.withColumn("vocabulary", F.array_distinct("words"))
    covered = F.size(F.filter("vocabulary", lambda x: F.contains("held", x))) / F.size("vocabulary")
    off = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(F.lit(1.0), F.col(b))
    chars = F.length(F.regexp_replace("held", r"\s+", ""))
    shape = F.when((F.col("w") > 0) & (F.col("h") > 0) & ((off("w", "width") > 0.05) | (off("h", "height") > 0.05)), F.struct(F.lit("pdf_geometry_mismatch").alias("finding"), F.greatest(off("w", "width"), off("h", "height")).alias("measure")))
    gap = F.when((F.size("words") >= 20) & (covered < 0.35), F.struct(F.lit("pdf_text_coverage_gap").alias("finding"), covered.alias("measure")))
    bare = F.when((F.col("images") >= 1) & (chars < 40) & (F.size("words") < 10), F.struct(F.lit("image_page_low_text").alias("finding"), chars.cast("double").alias("measure")))
    each = s.select("book", "page", F.explode(F.array_compact(F.array(shape, gap, bare))).alias("f")).select("book", "page", "f.finding", "f.measure")
    return unlike.unionByName(each)


def cell_context(cells: DataFrame, reach: int = 1) -> DataFrame:
    """cells (book, id, row, column, text) -> book, id, row, column, text, row_header (the first cell of the row), column_header (the first of the column), left, right, above, below.

    Cells are dealt once, by their table; the first cells of rows and columns and the neighbours are read from the sorted rows and columns, so what one table holds
    bounds what a task keeps of a row or column, and nothing is joined.
    """
    key = ["book", "id"]
    c = cells.repartition(*key).groupBy(*key, "row", "column").agg(F.min("text").alias("text"))
    along, down = Window.partitionBy(*key, "row").orderBy("column"), Window.partitionBy(*key, "column").orderBy("row")
    at = lambda w, k: F.first("text").over(w.rangeBetween(k, k))
    c = c.withColumns({"row_header": F.min_by("text", "column").over(Window.partitionBy(*key, "row")), "left": at(along, -reach), "right": at(along, reach)})
    c = c.withColumns({"column_header": F.min_by("text", "row").over(Window.partitionBy(*key, "column")), "above": at(down, -reach), "below": at(down, reach)})
    return c.select(*key, "row", "column", "text", "row_header", "column_header", "left", "right", "above", "below")


def page_overlays(chunks: DataFrame, overlays: DataFrame, most: int = 8) -> DataFrame:
    """chunks (id, pages array<int>, text), overlays (page, entry, created, status, summary, visible array<string>) -> id, text, overlays: what was applied to a chunk's pages, the newest first, ``most`` of them.

    Only overlays that are applied take part, each once for a chunk however many of its pages it is on, as the newest of the first of its pages says. An entry that
    ``most`` others of a page precede is preceded by them in every chunk with this page, so each page offers its first ``most``; a chunk meets those of its pages and
    no others, and its own first are looked up on its pages again. Rows grow with the chunks' pages, not with the overlays on each.
    """
    newest = F.max_by(F.struct("created", "summary", "visible"), F.struct("created", "summary", "visible"))
    on = overlays.where("status = 'applied' AND page IS NOT NULL").groupBy("page", "entry").agg(newest.alias("o")).select("page", "entry", "o.*")
    offered = on.select("page", "entry", "created", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("created"), "entry")).alias("n")).where(F.col("n") <= most).drop("n")
    places = chunks.select("id", F.explode(F.array_distinct(F.coalesce("pages", F.array().cast("array<int>")))).alias("page"))
    once = places.join(offered, "page").groupBy("id", "entry").agg(F.max("created").alias("created"))
    w = Window.partitionBy("id").orderBy(F.desc("created"), "entry")
    first = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("created")
    met = first.join(places, "id").join(on.drop("created"), ["page", "entry"])
    found = met.groupBy("id", "n", "entry").agg(F.min_by(F.struct("page", "summary", "visible"), "page").alias("o")).select("id", "n", "entry", "o.*")
    listed = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "entry", "page", "summary", "visible"))).alias("overlays"))
    return chunks.join(listed, "id", "left").select("id", "text", F.coalesce("overlays", F.array().cast(listed.schema["overlays"].dataType)).alias("overlays"))
