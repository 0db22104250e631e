"""Rare spellings near frequent ones, by evidence of the same book alone: likely misreadings, whatever the language.

A spelling is compared with those at most two edits away. Two spellings are as near as that only if they are equal once each has lost as many characters as there are
edits, so what is left of a spelling, for every choice of lost characters, are the keys of an equality join. A key is a hash of what is left; few spellings share one, and
distances are worked out for what meets there. Keys take many times the room of the spellings, so they are made where the spellings lie and only those are dealt out that
the other side may have, by a sieve of bits. Places are looked up in the texts again, for the spellings that are near another, since they are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import lexical
from lodestone.operators import sieve
from lodestone.session import written

# Words of a text, and from which count a spelling is frequent, up to which it is rare, and how alike the two must be.
WORD = r"(?<![\p{L}\p{N}_-])\p{L}+(?:[’']\p{L}+)?(?![\p{L}\p{N}_-])"
FREQUENT, RARE, TIMES, LIKENESS, NEAR = 5, 2, 4, 0.84, 3
#: A pair of spellings may differ by two edits from this length of the longer on, since two edits in fewer letters are too unlike.
TWO_EDITS_FROM = 13
#: And by one from this length on.
ONE_EDIT_FROM = 7


#: Characters of a hashed word count by powers of an odd number; its inverse takes those behind a lost character one place back. Keys that are made at once.
BASE = 0x9E3779B97F4A7C15
BACK = np.uint64(pow(BASE, -1, 1 << 64))
AT_ONCE = 1 << 20
#: Words of a text that travel together, so that a batch of rows is small whatever the texts are.
PIECE = 64


def counted(texts: DataFrame) -> DataFrame:
    """texts (book, text) -> book, word, n: how often each word stands in a book, for words long enough to be in a pair."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    w = texts.select("book", F.explode(found).alias("surface")).select("book", lexical.lexical_token(F.col("surface")).alias("word"))
    return w.where(F.length("word") >= ONE_EDIT_FROM - 1).groupBy("book", "word").agg(F.count("*").alias("n"))


@lru_cache(8)
def _two(size: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a word, the first from start to before stop."""
    i, k = np.repeat(np.arange(start, stop), size), np.tile(np.arange(size), stop - start)
    return i[i < k], k[i < k]


def _hashes(words: pa.Array, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words, and the hashes of their keys, a row each: of a word and what is left of it. Two characters may be lost from 13 on, one from 7 on; a shorter word of a pair has lost its characters already."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        every, each = np.flatnonzero(sizes == size), max(1, min(size, AT_ONCE // size))  # first lost characters at once
        powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)])
        step = max(1, AT_ONCE // (size * size if size >= TWO_EDITS_FROM else size))
        for at in (every[k : k + step] for k in range(0, len(every), step)):
            letters = np.array(words.take(pa.array(at)).to_pylist(), f"U{size}").view(np.uint32).reshape(len(at), size)
            sums = np.concatenate([np.zeros((len(at), 1), np.uint64), np.cumsum(letters * powers, 1, dtype=np.uint64)], 1)
            total, book = sums[:, -1:], books[at][:, None]
            stirred = lambda left, lost: sieve.mixed(left + np.uint64(size - lost)) ^ book  # noqa: B023, E731
            yield at, stirred(total, 0)
            if size >= ONE_EDIT_FROM:
                yield at, stirred(sums[:, :-1] + (total - sums[:, 1:]) * BACK, 1)
            for start in range(0, size if size >= TWO_EDITS_FROM else 0, each):
                i, k = _two(size, start, min(size, start + each))
                yield at, stirred(sums[:, i] + (sums[:, k] - sums[:, i + 1] + (total - sums[:, k + 1]) * BACK) * BACK, 2)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _fitting(df: DataFrame, word: str, fits: sieve.Sieve) -> DataFrame:
    """df with each key of its words that passes, once."""

    def run(batches):
        for b in batches:
            rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for at, h in _hashes(b.column(word), _unsigned(b.column("__book"))):
                found = fits.passing(h.ravel())
                rows.append(at[found // h.shape[1]])
                keys.append(h.ravel()[found])
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(key, prepend=np.uint64(0)) != 0))
            for k in range(0, len(new), AT_ONCE):
                some = new[k : k + AT_ONCE]
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(row[some])).columns, pa.array(key[some].view(np.int64))], names=[*b.schema.names, "key"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("key", T.LongType())])).drop("__book")


def candidates(rare: DataFrame, frequent: DataFrame) -> DataFrame:
    """rare (book, rare, ...), frequent (book, frequent, ...) -> the pairs of a book that share a key, among them all that are near enough; some more than once.

    Both are read more than once.
    """
    size, long_enough = F.length("frequent").cast("long"), lambda c: F.length(c) >= ONE_EDIT_FROM - 1
    r = rare.where(long_enough("rare")).withColumn("__book", F.xxhash64("book"))
    f = frequent.where(long_enough("frequent")).withColumn("__book", F.xxhash64("book"))
    lost = F.when(size >= ONE_EDIT_FROM, size).otherwise(0) + F.when(size >= TWO_EDITS_FROM, F.expr("length(frequent) * (length(frequent) - 1L) div 2")).otherwise(0)
    keys = f.agg(F.sum(1 + lost)).first()[0] or 0
    r = _fitting(r, "rare", sieve.of(f.select("frequent", "__book"), lambda b: (h.ravel() for _, h in _hashes(b.column(0), _unsigned(b.column(1)))), keys))
    # What passed are keys of the frequent ones but for a few.
    f = _fitting(f, "frequent", sieve.of(r.select("key"), lambda b: [_unsigned(b.column(0))], keys))
    return r.join(f, ["book", "key"]).drop("key")


def near_pairs(spellings: DataFrame) -> DataFrame:
    """spellings (book, word, n, surface) -> book, rare, rare_n, frequent, n, edits, likeness: the best frequent spelling of each rare one.

    Labels (digits, capitals) are no rare spellings, and forms of one word are no misreadings. Likeness counts first, then the frequent one's count, then fewer
    edits, then the later in the alphabet.
    """
    often = (F.col("n") >= FREQUENT) & (F.length("word") >= 4)
    seldom = (F.col("n") <= RARE) & (F.length("word") >= 6) & ~lexical.is_label(F.col("surface"))
    told = written(spellings.where(often | seldom).select("book", "word", "n"), "spellings")
    frequent = told.where(F.col("n") >= FREQUENT).select("book", F.col("word").alias("frequent"), "n")
    rare = told.where(F.col("n") <= RARE).select("book", F.col("word").alias("rare"), F.col("n").alias("rare_n"))
    longest = F.greatest(F.length("frequent"), F.length("rare"))
    allowed = F.when(longest >= TWO_EDITS_FROM, 2).otherwise(1)
    pairs = candidates(rare, frequent).where(F.col("n") >= F.greatest(F.lit(FREQUENT), F.col("rare_n") * TIMES))
    pairs = pairs.withColumn("edits", F.levenshtein("rare", "frequent", 2)).where((F.col("edits") >= 1) & (F.col("edits") <= allowed))
    pairs = pairs.withColumn("likeness", 1 - F.col("edits") / longest).where((F.col("likeness") >= LIKENESS) & ~lexical.same_word(F.col("rare"), F.col("frequent")))
    best = F.max_by(F.struct("frequent", "n", "edits", "likeness"), F.struct("likeness", "n", -F.col("edits"), "frequent"))
    return pairs.groupBy("book", "rare", "rare_n").agg(best.alias("b")).select("book", "rare", "rare_n", "b.*")


def standing(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts (book, item, text), wanted (book, word) -> book, item, place, surface, word, beside: where these words stand and the words up to three places from there. A few others may be among them."""
    fits = sieve.of(wanted.select(F.xxhash64("book", "word")), lambda b: [_unsigned(b.column(0))], wanted.count())
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    piece = lambda k: F.struct(k.alias("own"), F.greatest(F.lit(0), k - NEAR).alias("start"), F.slice("surfaces", F.greatest(F.lit(1), k + 1 - NEAR), PIECE + 2 * NEAR).alias("surfaces"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("surfaces") - 1), F.lit(PIECE)), piece)
    t = texts.select("book", "item", found.alias("surfaces")).select("book", "item", F.explode(pieces).alias("p")).select("book", "item", "p.*")
    t = t.withColumn("hashes", F.transform("surfaces", lambda s: F.xxhash64("book", lexical.lexical_token(s))))
    kinds = {"place": T.IntegerType(), "surface": T.StringType(), "beside": T.ArrayType(T.StringType())}

    def run(batches):
        for b in batches:
            ends, told = b.column("surfaces").offsets.to_numpy(), b.column("surfaces").flatten()
            ends = ends - ends[0]
            hits = fits.passing(_unsigned(b.column("hashes").flatten()))
            row = np.searchsorted(ends, hits, "right") - 1
            own, place = b.column("own").to_numpy()[row], b.column("start").to_numpy()[row] + hits - ends[row]
            kept = np.flatnonzero((own <= place) & (place < own + PIECE))  # the words around a piece are another's
            hits, row, place = hits[kept], row[kept], place[kept]
            start, stop = np.maximum(ends[row], hits - NEAR), np.minimum(ends[row + 1], hits + NEAR + 1)
            bounds = np.r_[0, np.cumsum(stop - start)]
            near = np.repeat(start - bounds[:-1], stop - start) + np.arange(bounds[-1])
            beside = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), told.take(pa.array(near)))
            where = b.select(["book", "item"]).take(pa.array(row)).columns
            yield pa.RecordBatch.from_arrays([*where, pa.array(place, pa.int32()), told.take(pa.array(hits)), beside], names=["book", "item", *kinds])

    schema = T.StructType([t.schema["book"], t.schema["item"], *[T.StructField(k, v) for k, v in kinds.items()]])
    w = t.mapInArrow(run, schema)
    return w.withColumns({"word": lexical.lexical_token(F.col("surface")), "beside": F.transform("beside", lexical.lexical_token)})


def misreadings(texts: DataFrame) -> DataFrame:
    """book, item, rare, rare_n, frequent, n, edits, likeness, score: where rare spellings stand, unless the frequent one is within three words of their first place there (a glossary).

    The surface of a spelling is its commonest, the smallest of equals; a rare one stands twice at most, so that is the smallest. Null texts count as empty, null books take no part.
    """
    texts = texts.where("book IS NOT NULL")
    # Of what is equal to its lower case, a label has no other surface; the others are left out below.
    pairs = written(near_pairs(counted(texts).withColumn("surface", F.col("word"))), "pairs")
    w = standing(texts, pairs.select("book", F.col("rare").alias("word"))).withColumnRenamed("word", "rare")
    # Of the words beside, only those count that may be the frequent one.
    w = w.withColumn("beside", F.filter("beside", lambda x: F.levenshtein(x, F.col("rare"), 2) > 0)).join(pairs, ["book", "rare"])
    w = w.withColumn("least", F.min("surface").over(Window.partitionBy("book", "rare"))).where(~lexical.is_label(F.col("least")))
    glossary = F.min_by(F.array_contains("beside", F.col("frequent")), F.col("place"))
    kept = w.groupBy("book", "item", "rare", "rare_n", "frequent", "n", "edits", "likeness").agg(glossary.alias("glossary")).where(~F.col("glossary"))
    score = 0.75 * F.col("likeness") + 0.25 * F.least(F.lit(1.0), F.col("n") / 50)
    return kept.select("book", "item", "rare", "rare_n", "frequent", "n", "edits", F.round("likeness", 4).alias("likeness"), F.round(score, 4).alias("score"))


def first_candidates(found: DataFrame, by: str, k: int) -> DataFrame:
    """The first k items of each book for review: the best score, then more evidence, then the item."""
    items = found.groupBy(by, "item").agg(F.max("score").alias("score"), F.count("*").alias("evidence"))
    w = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("evidence"), "item")
    return items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
