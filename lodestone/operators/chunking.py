"""Chunks over a token budget are split at rows, paragraphs or sentences, never inside one; a part that can't be split stays whole.

Units carry their length and lexical pieces, which add up over a group, so packing a text is linear. It runs in Arrow batches: as a fold of column
expressions the same took 108 s for the smallest test table, since such lambdas are interpreted and copy the groups made so far at each step.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The estimate's margin and its bound of characters a token; what counts as a piece, a separator row, a sentence border.
MARGIN, CHARS_A_TOKEN, MOSTLY_CELLS = 1.08, 2.5, 0.70
PIECE = r"[A-Za-z]+|\d+(?:\.\d+)?|[^\w\s]"
SEPARATOR = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*")
SENTENCE, PARAGRAPH = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])"), re.compile(r"\n\s*\n+")
_PIECE = re.compile(PIECE)
#: Texts whose parts are held at once.
TEXTS_AT_ONCE = 128


def estimate(length: Column, n_pieces: Column, parent_tokens: Column, parent_length: Column) -> Column:
    """Tokens of a text that is part of one whose tokens are known: the highest of three estimates, so no budget is passed unseen."""
    by_share = F.ceil(length * (F.greatest(parent_tokens, F.lit(1)) / F.greatest(parent_length, F.lit(1))) * MARGIN)
    return F.greatest(F.lit(1).cast("long"), by_share, F.ceil(F.greatest(length, F.lit(1)) / CHARS_A_TOKEN), n_pieces.cast("long"))


def pieces(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def units(text: str) -> tuple[str, str, list[str], str]:
    """boundary, what each part repeats, the units that stay whole, and what joins them."""
    rows = [r for r in text.splitlines() if r.strip()]
    if len(rows) >= 4 and SEPARATOR.fullmatch(rows[1]) and all("|" in r for r in rows[2:]):
        return "table_row", "\n".join(rows[:2]) + "\n", rows[2:], "\n"
    if len(rows) >= 2 and sum("|" in r for r in rows) >= MOSTLY_CELLS * len(rows):
        held: list[str] = []
        for r in rows:
            if held and SEPARATOR.fullmatch(r):
                held[-1] += "\n" + r
            else:
                held.append(r.rstrip())
        return "table_row", "", held, "\n"
    for rule in (PARAGRAPH, SENTENCE):
        parts = [p for x in rule.split(text.strip()) if (p := x.strip())]
        if len(parts) >= 2:
            break
    return "paragraph_or_sentence", "", parts, "\n\n"


def split_text(text: str | None, tokens: int | None, budget: int, repeat_header: bool = True) -> tuple[str, list[str], list[int]]:
    """boundary, parts and their estimated tokens; no parts for a text that is within the budget or has one unit."""
    if not text or not text.strip() or tokens is None or tokens <= budget:
        return "none", [], []
    boundary, head, whole, joint = units(text)
    head = head if repeat_header else ""
    share, fixed = max(1, tokens) / len(text) * MARGIN, len(_PIECE.findall(head))
    groups, sizes, length, count = [], [], 0, 0
    for u in whole:
        n, p = len(u), len(_PIECE.findall(u))
        longer, more = length + len(joint) + n, count + p
        if groups and (size := _size(len(head) + longer + 1, fixed + more, share)) <= budget:
            groups[-1].append(u)
            sizes[-1], length, count = size, longer, more
        else:
            groups.append([u])
            sizes.append(_size(len(head) + n + 1, fixed + p, share))
            length, count = n, p
    if len(groups) < 2:
        return "none", [], []
    return boundary, [head + joint.join(g) + "\n" for g in groups], sizes


def _size(length: int, n_pieces: int, share: float) -> int:
    return max(1, math.ceil(length * share), math.ceil(length / CHARS_A_TOKEN), n_pieces)


def split_over_budget(chunks: DataFrame, id_col: str, text_col: str, tokens_col: str, budget: int, repeat_header: bool = True) -> DataFrame:
    """id, part (from 0), n_parts, text, n_tokens (given, or estimated for parts), boundary (none, table_row or paragraph_or_sentence).

    Canonical tables (header, separator, rows of cells) are split at rows, each part with the header again; others at rows if most of their lines
    are cells, else at paragraphs, or sentences of a single paragraph. Chunks within the budget, and those of one unit, come back as they are. Null or
    blank text, or null tokens: a single part as given. One row a part, no shuffle.
    """
    c = chunks.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(tokens_col).cast("long").alias("__n"))
    shape = "boundary string, parts array<string>, sizes array<bigint>"

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # The parts of a few texts at a time, whatever the batches are that they come in.
        for text, tokens in batches:
            for at in range(0, len(text), TEXTS_AT_ONCE):
                few = slice(at, at + TEXTS_AT_ONCE)
                rows = [split_text(t, None if pd.isna(n) else int(n), budget, repeat_header) for t, n in zip(text.iloc[few], tokens.iloc[few], strict=True)]
                yield pd.DataFrame(rows, columns=["boundary", "parts", "sizes"])

    c = c.withColumn("__s", F.pandas_udf(run, shape)("__t", "__n"))
    split = F.size("__s.parts") > 0
    rows = F.when(split, F.arrays_zip(F.col("__s.parts").alias("text"), F.col("__s.sizes").alias("n"))).otherwise(F.array(F.struct(F.col("__t").alias("text"), F.col("__n").alias("n"))))
    out = c.select("__id", "__s.boundary", F.size(rows).alias("n_parts"), F.posexplode(rows).alias("part", "p"))
    return out.select(F.col("__id").alias(id_col), "part", "n_parts", "p.text", F.col("p.n").alias("n_tokens"), "boundary")


def compacted(chunks: DataFrame, raw: str, text: str, heading: str, n_tokens: str, budget: int) -> DataFrame:
    """Chunks over budget with less mark-up around what they say, and ``action``: what was done. ``text`` and its count change; ``raw`` never does.

    separator_only: nothing but table lines, so the deepest heading alone is kept. padding: a table without separators and blanks in cells. heading: the
    deepest heading instead of all of them, or none, if that fits the budget. Others are left to be split.
    """
    r, t, n = F.coalesce(raw, F.lit("")), F.coalesce(text, F.lit("")), F.col(n_tokens)
    deep = F.when(F.coalesce(heading, F.lit("")) == "", "").otherwise(F.concat(heading, F.lit("\n")))
    pieces = lambda c: F.regexp_count(c, F.lit(r"[A-Za-z]+|\d+(?:\.\d+)?|[^\w\s]"))
    estimate = lambda c: F.greatest(F.lit(1), F.ceil(F.length(c) * (n / F.length(t)) * 1.08), F.ceil(F.length(c) / 2.5), pieces(c)).cast("long")
    lines = F.filter(F.split(r, "\n"), lambda x: F.trim(x) != "")
    cells = lambda x: F.transform(F.split(F.btrim(F.trim(x), F.lit("|")), r"\|"), lambda c: F.trim(c))
    separator = lambda x: (F.size(cells(x)) >= 2) & F.forall(cells(x), lambda c: c.rlike("^:?-{3,}:?$"))
    row = lambda x: F.when(x.contains("|"), F.concat(F.lit("| "), F.array_join(cells(x), " | "), F.lit(" |"))).otherwise(F.trim(x))
    tight = F.concat(deep, F.array_join(F.transform(F.filter(lines, lambda x: ~(x.contains("|") & separator(x))), row), "\n"), F.lit("\n"))
    table = (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: x.contains("|"))) >= 0.7 * F.size(lines))
    over = (n > budget) & (F.trim(r) != "")
    short = F.when((deep != "") & (estimate(F.concat(deep, r)) <= budget), F.concat(deep, r)).when(estimate(r) <= budget, r)
    c = chunks.withColumn("__bare", over & r.rlike(r"^[\s|:\-]+$")).withColumn("__tight", F.when(over & table, tight))
    padded = F.col("__tight").isNotNull() & (F.length("__tight") < F.length(t))
    new = F.when(F.col("__bare"), deep).when(padded, F.col("__tight")).when(over & F.endswith(t, r), short)
    action = F.when(F.col("__bare"), "separator_only").when(padded, "padding").otherwise("heading")
    c = c.withColumn("__new", new).withColumn("action", F.when(F.col("__new").isNull(), "none").otherwise(action))
    return c.withColumn(n_tokens, F.when(F.col("__new").isNull(), n.cast("long")).otherwise(estimate(F.col("__new")))).withColumn("text", F.coalesce("__new", F.col(text))).drop("__bare", "__tight", "__new")
