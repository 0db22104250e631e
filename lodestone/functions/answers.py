"""Answers of models: JSON inside other text, fields of JSON that was cut off, reasoning and labels around an answer, and texts cut to a size.

A complete object in free text needs a parser that stops where the object ends, so ``json_salvage`` is an Arrow-batched function; the rest are column expressions.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def first_object(text: str | None) -> str | None:
    """The first complete JSON object in a text, as compact JSON; null if there is none or it is cut off."""
    text, begin = text or "", (text or "").find("{")
    try:
        found, _ = json.JSONDecoder().raw_decode(text, begin) if begin >= 0 else (None, 0)
    except ValueError:
        return None
    return None if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":"))


@lru_cache
def _salvage():
    def f(text: pd.Series) -> pd.Series:
        return pd.Series([first_object(t) for t in text], dtype=object)

    return pandas_udf(f, "string")


def json_salvage(text: Column | str) -> Column:
    return _salvage()(text)


def closed_string(text: Column, key: str) -> Column:
    """A string field of JSON that may be cut off, if the string itself is closed; null otherwise."""
    raw = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    return F.when(raw != "", F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0])


def closed_number(text: Column, key: str) -> Column:
    """A number field that is followed by a comma or brace, so that no digit of it is missing."""
    return F.regexp_extract(text, rf'"{key}"\s*:\s*(-?\d+(?:\.\d+)?)\s*[,}}]', 1).try_cast("double")


def closed_strings(text: Column, key: str) -> Column:
    """The closed strings of a list field, the last of which may be cut off; null if the field is missing."""
    body = F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*\[((?:\s*"(?:[^"\\]|\\.)*"\s*,?)*)', 1)
    found = F.transform(F.regexp_extract_all(body, F.lit(r'(?s)"(?:[^"\\]|\\.)*"'), F.lit(0)), lambda s: F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0])
    return F.when(text.rlike(rf'"{key}"\s*:\s*\['), found)


def verdict_of(text: Column, known: list[str]) -> Column:
    """The verdict of an answer that was cut off, upper-cased, if it is one of those known."""
    said = F.upper(F.btrim(closed_string(text, "verdict")))
    return F.when(said.isin(known), said)


def completion(text: Column) -> Column:
    """An answer without reasoning wrappers, closed or cut off at the front, and without outer white space."""
    bare = F.regexp_replace(text, r"(?is)<(think|reasoning|analysis)>.*?</\1>", "")
    bare = F.regexp_replace(bare, r"(?is)^.*?</(?:think|reasoning|analysis)>", "")
    return F.btrim(F.regexp_replace(bare, r"(?is)<(?:think|reasoning|analysis)>.*$", ""), F.lit(" \t\r\n"))


def text_segments(text: Column, limit: int = 1_800) -> Column:
    """Pieces of up to ``limit`` characters that join to the text again; words, and numbers with the word behind them, stay whole."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[+-]?\d+(?:[.,]\d+)?\s+\S+\s*|\S+\s*|\s+"), F.lit(0))
    start = F.struct(F.expr("cast(array() AS array<string>)").alias("done"), F.lit("").alias("now"))
    full = lambda t, u: (t["now"] != "") & (F.length(t["now"]) + F.length(u) > limit)
    step = lambda t, u: F.struct(F.when(full(t, u), F.concat(t["done"], F.array(t["now"]))).otherwise(t["done"]).alias("done"), F.when(full(t, u), u).otherwise(F.concat(t["now"], u)).alias("now"))
    return F.aggregate(units, start, step, lambda t: F.concat(t["done"], F.array(t["now"])))
