"""Reading order of pages: whether the order of a book's items is one that the places of their boxes allow.

Boxes have their origin at the lower left: top is larger than bottom. What is no prose (furniture, page numbers, overlays of tables and pictures, forms, contents,
drawings, dense grids) is left out or ends the check of its page, with the reason. A page is compared with its rows from top to bottom and, if it has two columns,
with its columns from left to right; the better of the two counts. Inversions are counted by merging, in n log n steps for a page.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of pictures that are technical drawings, and headings of contents and indexes.
DRAWINGS = ("engineering_drawing", "flow_chart", "line_chart", "bar_chart", "box_plot", "geographical_map", "screenshot_from_manual")
CONTENTS = r"(?i)^(?:table\s+of\s+contents|contents|inhaltsverzeichnis|sommaire|indice|índice)(?:\b|\s|$)"
#: Page size where none is given.
WIDTH, HEIGHT = 595.0, 842.0


def inversions(values: np.ndarray) -> int:
    """Pairs that stand in the wrong order."""
    return int(inversions_of(np.zeros(len(values), dtype=np.int64), np.argsort(np.argsort(values, kind="stable"), kind="stable"), 1)[0])


def inversions_of(group: np.ndarray, rank: np.ndarray, n_groups: int) -> np.ndarray:
    """Pairs of each group that stand in the wrong order; groups stand one after the other, and no two ranks are equal. Runs of doubling length are merged in all groups at once, and each value of a right run counts the larger ones of the left run."""
    n, total, width = len(rank), np.zeros(n_groups, dtype=np.int64), 1
    first = np.searchsorted(group, np.arange(n_groups))
    place = np.arange(n) - first[group]
    longest = int(place.max()) + 1 if n else 0
    while width < longest:
        new = place % (2 * width) == 0
        pair, right = np.cumsum(new) - 1, place // width % 2 == 1
        order = np.lexsort((rank, pair))  # every pair of runs merged
        right = right[order]
        lefts = np.cumsum(~right)
        ends = np.append(np.flatnonzero(new)[1:], n) - 1
        np.add.at(total, group[right], (lefts[ends][pair] - lefts)[right])
        rank = rank[order]
        width *= 2
    return total


def comparable(items: DataFrame, pages: DataFrame) -> DataFrame:
    """The items whose order says something, with the size of their page and why the page isn't checked (``skip``, null if it is).

    items: book, page, place (order in the book), kind (texts, tables, pictures), label, text, class (of a picture), l, t, r, b; pages: book, page, width, height.
    """
    one = pages.where("page IS NOT NULL").groupBy("book", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    sizes = one.select("book", "page", F.coalesce("width", F.lit(WIDTH)).alias("width"), F.coalesce("height", F.lit(HEIGHT)).alias("height"))
    counts = one.groupBy("book").agg(F.count("*").alias("n_pages"))
    text = F.trim(F.coalesce("text", F.lit("")))
    i = items.where("page IS NOT NULL AND l IS NOT NULL AND t IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL").withColumn("text", text).withColumn("line", F.trim(F.regexp_replace("text", r"\s+", " ")))
    i = i.join(sizes, ["book", "page"], "left").na.fill({"width": WIDTH, "height": HEIGHT})
    # Lines on many places of a book are its title blocks and revision strings.
    often = items.select("book", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("line"), "kind").where("kind = 'texts' AND length(line) BETWEEN 2 AND 120")
    often = often.groupBy("book", "line").agg(F.count("*").alias("n")).join(counts, "book", "left")
    often = often.where(F.col("n") >= F.greatest(F.lit(5), F.ceil(F.greatest(F.coalesce("n_pages", F.lit(0)), F.lit(1)) * 0.05))).select("book", "line", F.lit(True).alias("running"))
    i = i.join(often, ["book", "line"], "left")
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    is_text = F.col("kind") == "texts"
    top = is_text & (F.col("t") >= 0.84 * F.col("height")) & (F.length("text") <= 40) & (w <= 0.30 * F.col("width"))
    drawing = (F.col("kind") == "pictures") & F.col("class").isin(*DRAWINGS) & (w * h >= 0.18 * F.col("width") * F.col("height"))
    of_page = i.groupBy("book", "page").agg(F.count(F.when(top, 1)).alias("tops"), F.coalesce(F.max(drawing), F.lit(False)).alias("drawing"))
    i = i.join(of_page, ["book", "page"]).withColumn("is_top", top & (F.col("tops") >= 3))
    noise = (
        F.coalesce(F.col("label").isin("page_header", "page_footer"), F.lit(False))
        | F.coalesce("running", F.lit(False))
        | (F.greatest(w, F.lit(0.0)) < 2)
        | (F.greatest(h, F.lit(0.0)) < 2)
        | (F.length("text") <= 1)
        | (F.col("text").rlike(r"^\d{1,4}$") & (F.col("b") < 0.12 * F.col("height")))
        | (F.col("text").rlike(r"^\d+\s*[-–]\s*\d+$") & (w < 0.12 * F.col("width")))
    )
    i = i.where((F.col("kind") == "tables") | is_text & ~noise).where(~F.col("is_top"))
    holds = items.where("kind IN ('tables', 'pictures') AND l IS NOT NULL AND t IS NOT NULL AND r IS NOT NULL AND b IS NOT NULL").select("book", "page", *[F.col(c).alias(f"o{c}") for c in "ltrb"])
    inside = (F.col("l") >= F.col("ol") - 3) & (F.col("r") <= F.col("or") + 3) & (F.col("b") >= F.col("ob") - 3) & (F.col("t") <= F.col("ot") + 3)
    loose = F.coalesce(F.col("label").isin("section_header", "caption"), F.lit(False)) | ~is_text
    # An anti join: an item inside a table or picture goes, and no pair is emitted.
    a, o = i.alias("a"), holds.alias("o")
    i = a.join(o, (F.col("a.book") == F.col("o.book")) & (F.col("a.page") == F.col("o.page")) & ~loose & inside, "left_anti")
    return i.select("book", "page", "place", "kind", "label", "text", "line", "l", "t", "r", "b", "width", "height", "drawing")


def _skips(of: DataFrame, least: int) -> DataFrame:
    """book, page, n, skip, items: why a page isn't checked, the first reason that holds, or the boxes of its items."""
    w, is_text, size = F.col("r") - F.col("l"), F.col("kind") == "texts", F.length("text")
    n_if = lambda c: F.count(F.when(c, 1))
    upper = lambda c: F.element_at(F.array_sort(F.collect_list(F.when(is_text, c))), (F.floor(n_if(is_text) / 2) + 1).cast("int"))
    g = of.groupBy("book", "page").agg(
        F.count("*").alias("n"),
        F.first("width").alias("width"),
        F.first("height").alias("height"),
        F.first("drawing").alias("drawing"),
        n_if(is_text).alias("texts"),
        n_if(is_text & F.col("line").rlike(CONTENTS)).alias("contents"),
        n_if(is_text & (size <= 45)).alias("short"),
        n_if(is_text & (size >= 120)).alias("long"),
        n_if(is_text & (size <= 45) & F.col("text").endswith(":")).alias("fields"),
        F.when(n_if(is_text) > 0, upper(size)).alias("mid_size"),
        F.when(n_if(is_text) > 0, upper(w / F.greatest(F.col("width"), F.lit(1.0)))).alias("mid_width"),
        n_if((F.col("kind") == "tables") & (w * (F.col("t") - F.col("b")) >= 0.55 * F.col("width") * F.col("height"))).alias("large_tables"),
        F.collect_list(F.struct("place", *[F.col(c).cast("double").alias(c) for c in ("l", "t", "r", "width")])).alias("items"),
    )
    short = F.col("short") / F.greatest(F.col("texts"), F.lit(1))
    form = (F.col("texts") >= 6) & (short >= 0.80) & (F.col("long") == 0) & (F.col("fields") >= 2)
    labels = F.col("drawing") & (F.col("texts") >= 10) & (short >= 0.45) & (F.col("long") <= 3)
    grid = (F.col("width") > F.col("height") * 1.10) & (F.col("texts") >= 20) | (F.col("texts") >= 40) & (F.col("mid_size") <= 18) & (F.col("mid_width") <= 0.18)
    why = F.when(F.col("n") < least, "insufficient_comparable_items").when(F.col("contents") > 0, "contents_or_index_page").when(form, "form_or_title_page").when(labels, "technical_visual_label_page")
    why = why.when(grid, "schematic_or_dense_label_grid").when((F.col("large_tables") > 0) & (F.col("n") <= 6), "large_table_non_prose_page")
    return g.withColumn("skip", why).select("book", "page", "n", "skip", F.when(F.col("skip").isNull(), F.col("items")).alias("items"))


def _compared(batches):
    """Pages with the boxes of their items (null: not checked), many at once: inversions against rows and, with two columns, against columns."""
    for b in batches:
        boxes = b.column("items")
        sizes = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False)
        flat = boxes.flatten()
        place, l, t, r, width = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "l", "t", "r", "width"))
        pages, page = len(sizes), np.repeat(np.arange(len(sizes)), sizes)

        def against(some, *keys, place=place, page=page, pages=pages):
            at, where = place[some], page[some]
            order = np.lexsort((at, where))
            rank = np.empty(len(some), dtype=np.int64)
            rank[np.lexsort((at, *(k[some] for k in keys), where))] = np.arange(len(some))
            n, size = inversions_of(where[order], rank[order], pages), np.bincount(where, minlength=pages)
            return n / np.maximum(1, size * (size - 1) / 2), n

        middle = (l + r) / 2
        row, row_n = against(np.arange(len(place)), l, -t)
        is_narrow = r - l < 0.62 * width
        on = lambda side: np.bincount(page[is_narrow & side], minlength=pages) >= 2  # noqa: B023, E731
        two = on(middle < 0.47 * width) & on(middle > 0.53 * width)
        column, column_n = against(np.flatnonzero(is_narrow & two[page]), l, -t, (middle >= 0.5 * width).astype(int))
        by_column = two & (column < row)
        checked = pc.is_valid(boxes).to_numpy(zero_copy_only=False)
        only = lambda values, some=checked: pa.array(values, mask=~some)
        found = [only(two), only(row), only(column, checked & two), only(np.where(by_column, "column_major", "row_major")), only(np.where(by_column, column, row)), only(np.where(by_column, column_n, row_n))]
        kept = [c for c in b.schema.names if c != "items"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *found], names=[*kept, "two_columns", "row_ratio", "column_ratio", "layout", "score", "inversions"])


def reading_order(items: DataFrame, pages: DataFrame, threshold: float = 0.18, least: int = 5) -> DataFrame:
    """book, page, n, skip, two_columns, row_ratio, column_ratio, layout, score, inversions, anomaly: a row for each page with comparable items.

    A page that is checked brings the boxes of its items along; a batch of pages is counted at once. What one printed page holds bounds a row.
    """
    of = _skips(comparable(items, pages), least)
    kinds = {f.name: f.dataType.simpleString() for f in of.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("book", "page", "n", "skip")) + ", two_columns boolean, row_ratio double, column_ratio double, layout string, score double, inversions long"
    return of.mapInArrow(_compared, schema).withColumn("anomaly", F.col("skip").isNull() & (F.col("score") > threshold) & (F.col("inversions") >= 3))


def coverage(checked: DataFrame, pages: DataFrame, least: float = 0.10) -> DataFrame:
    """book, pages, checked, two_columns, anomalies, coverage, status of what ``reading_order`` found, over all pages of each book."""
    n = pages.where("page IS NOT NULL").select("book", "page").distinct().groupBy("book").agg(F.count("*").alias("pages"))
    n_if = lambda c: F.count(F.when(c, 1))
    g = checked.groupBy("book").agg(n_if(F.col("skip").isNull()).alias("checked"), n_if(F.col("two_columns")).alias("two_columns"), n_if(F.col("anomaly")).alias("anomalies"))
    j = n.join(g, "book", "left").na.fill(0)
    share = F.col("checked") / F.col("pages")
    status = F.when(F.col("anomalies") > 0, "anomaly").when(F.col("checked") == 0, "not_evaluable").when(share < least, "limited").otherwise("consistent")
    return j.withColumn("coverage", share).withColumn("status", status)
