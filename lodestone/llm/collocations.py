"""Mines phrase collocations: pairs of ranked ids are counted in tiles, and frequent pairs become ids in turn.

Words are counted for each language; those that occur often enough get ids in falling order of their counts
(an id stands for a word of one language, so ids of two languages never meet). Documents become rows of ids,
broken where a piece of text ends or a word is too rare for any phrase. Then, for phrases of 2, 3 and more
words: the plane of pairs of adjacent ids is cut into square tiles. A task counts the pairs of a tile by direct
address (``bincount``) where it holds many of them and as sorted coordinates where it holds few; tiles of one
place meet in one task, which adds them up, again by direct address or sorted. Pairs that are frequent enough
get ids in falling order of their counts, the rows of ids are rewritten with them, and the same is done again:
two phrases of k words that overlap in k-1 are a pair of adjacent ids, so the next round counts k+1 words.

A phrase can only be frequent if its two halves of one word less are, so nothing is lost. Dictionaries are
broadcast in slices of bounded size; more slices mean more passes over the rows, with the same result.

Defined results: null text counts as empty and null language as ``und``; without a frequent phrase the result
is empty. Other columns are not read. Ties in the final order go to the larger count, then to the phrase.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written

UNKNOWN_LANG = "und"
#: Side of a tile, in ids.
SIDE = 1024
#: A tile is counted by direct address if it holds this many pairs or more.
DENSE = 1 << 16
#: Ids that a task gathers before it counts them.
BLOCK = 4_000_000
#: Different words that a task counts before it hands them on.
WORDS = 250_000
#: Entries of a dictionary that are broadcast at once: words, and pairs.
WORD_SLICE, PAIR_SLICE = 1_000_000, 4_000_000
#: Pairs for each task that adds up tiles.
PAIRS_PER_TASK = 4_000_000
#: Shares into which a language's phrases are dealt before the first ones are chosen.
SHARES = 64
#: Languages whose totals are broadcast.
MOST_LANGS = 10_000
#: In rows of ids: a break, and a word that this slice of the dictionary does not have.
BREAK, LATER = -1, -2

# What ends a piece, and what stands between words.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Stands for the end of a piece among the words; no byte of UTF-8.
_END = b"\xff"


def _words(text: str | None) -> list[bytes]:
    """Words of a text in order, with ``_END`` between pieces."""
    return text.encode().translate(_FOLD).replace(b"\n", b" \xff ").split() if text else []


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, word, f: occurrences of every word in each language, counted in the tasks first."""

    def work(batches):
        held: dict[str, Counter] = {}

        def flush():
            rows = [(k, w.decode(), n) for k, c in held.items() for w, n in c.items() if w != _END]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "f"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(UNKNOWN_LANG if k is None else k, Counter()).update(_words(x))
                if sum(map(len, held.values())) > WORDS:
                    yield flush()
        yield flush()

    return docs.select(lang, text).mapInArrow(work, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def ranked(df: DataFrame, *ties: str) -> DataFrame:
    """Adds ``id``, from 0, in falling order of ``f``: the number of rows with a larger f, and the place among those of the same f.

    Only the different values of f are sorted together, and rows of one value by themselves.
    """
    before = df.groupBy("f").count().select("f", (F.sum("count").over(Window.orderBy(F.desc("f"))) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("f").orderBy(*ties)) - 1
    return df.withColumn("place", place).join(before, "f").withColumn("id", F.col("before") + F.col("place")).drop("before", "place")


def _slices(words: DataFrame, n: int, size: int):
    """The rows of a dictionary by id, ``size`` at a time."""
    for begin in range(0, n, size):
        yield words.where((F.col("id") >= begin) & (F.col("id") < begin + size))


def word_ids(docs: DataFrame, vocabulary: DataFrame, n: int, lang: str, text: str) -> DataFrame:
    """``ids``: rows of 32-bit word ids, many documents in a row; rare words and ends of pieces are breaks.

    Each pass has one slice of the dictionary. Words that it lacks wait, joined by spaces, for the next pass.
    """
    spark, rows = docs.sparkSession, None
    for part in _slices(vocabulary, n, WORD_SLICE):
        known: dict[str, dict[bytes, int]] = {}
        for k, w, i in zip(*part.select("lang", "word", "id").toArrow().to_pydict().values(), strict=True):
            known.setdefault(k, {_END: BREAK})[w.encode()] = i
        shared, none = spark.sparkContext.broadcast(known), LATER if n > WORD_SLICE else BREAK
        if rows is None:

            def first(batches, shared=shared, none=none):
                nothing = {_END: BREAK}
                for b in batches:
                    out, ids, size, rest = [], [], 0, []
                    for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        k = UNKNOWN_LANG if k is None else k
                        words = _words(x)
                        got = np.fromiter(map(shared.value.get(k, nothing).get, words, repeat(none)), dtype=np.int32, count=len(words))
                        if none == LATER:
                            waits = b" ".join(words[i] for i in np.flatnonzero(got == LATER).tolist())
                            out.append((k, _tidy(got).tobytes(), waits.decode()))
                        else:
                            ids += [got, np.array([BREAK], dtype=np.int32)]
                            size += len(got)
                            if size > BLOCK // 8:
                                out.append((None, _tidy(np.concatenate(ids)).tobytes(), None))
                                ids, size = [], 0
                    if ids:
                        out.append((None, _tidy(np.concatenate(ids)).tobytes(), None))
                    yield _batch(out)

            rows = docs.select(lang, text).mapInArrow(first, "lang string, ids binary, rest string")
        else:

            def next_(batches, shared=shared):
                for b in batches:
                    out = []
                    for k, ids, waits in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                        ids, words = np.frombuffer(ids, dtype=np.int32).copy(), waits.encode().split(b" ") if waits else []
                        got = np.fromiter(map(shared.value.get(k, {}).get, words, repeat(LATER)), dtype=np.int32, count=len(words))
                        ids[ids == LATER] = got
                        out.append((k, ids.tobytes(), b" ".join(words[i] for i in np.flatnonzero(got == LATER).tolist()).decode()))
                    yield _batch(out)

            rows = rows.mapInArrow(next_, "lang string, ids binary, rest string")
        rows = written(rows, "phrase-words")
        shared.unpersist()
    if n > WORD_SLICE:
        return rows.select("ids").mapInArrow(_finished, "ids binary")
    return rows.select("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["lang", "ids", "rest"])


def _tidy(ids: np.ndarray) -> np.ndarray:
    """Without repeated breaks and without ids that stand alone: neither takes part in a pair."""
    if (ids == LATER).any():
        return ids
    broken = ids == BREAK
    alone = ~broken & np.append(True, broken[:-1]) & np.append(broken[1:], True)
    broken |= alone
    keep = ~(broken & np.append(True, broken[:-1]))
    return np.where(broken, np.int32(BREAK), ids)[keep]


def _finished(batches):
    for b in batches:
        rows = []
        for x in b.column(0).to_pylist():
            ids = np.frombuffer(x, dtype=np.int32)
            rows.append(_tidy(np.where(ids == LATER, np.int32(BREAK), ids)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where adjacent ids are, and their codes: tile of the left, tile of the right, place in the tile."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    left, right = ids[at].astype(np.int64), ids[at + 1].astype(np.int64)
    return at, ((left // SIDE) << 42) | ((right // SIDE) << 20) | (left % SIDE * SIDE + right % SIDE)


def _added(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different codes and their sums (occurrences, if n is None): full tiles by direct address, the others as sorted coordinates."""
    tile, place = code >> 20, code & (1 << 20) - 1
    order = np.argsort(tile, kind="stable")
    tile, place, n = tile[order], place[order], None if n is None else n[order]
    edges = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, dtype=np.int64)
    edges = np.append(edges, len(tile))
    dense = np.diff(edges) >= DENSE
    keys, sums = [], []
    for i in np.flatnonzero(dense):
        part = slice(edges[i], edges[i + 1])
        full = np.bincount(place[part], minlength=SIDE * SIDE) if n is None else _exact(place[part], n[part])
        some = np.flatnonzero(full)
        keys.append((tile[edges[i]] << 20) | some)
        sums.append(full[some])
    sparse = np.repeat(~dense, np.diff(edges))
    if sparse.any():
        code = (tile[sparse] << 20) | place[sparse]
        order = np.argsort(code, kind="stable")
        code = code[order]
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        keys.append(code[begins])
        sums.append(np.diff(np.append(begins, len(code))) if n is None else np.add.reduceat(n[sparse][order], begins))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(keys), np.concatenate(sums).astype(np.int64)


def _exact(place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums by place in whole numbers (``bincount`` with weights adds floats)."""
    out = np.zeros(SIDE * SIDE, dtype=np.int64)
    np.add.at(out, place, n)
    return out


def pair_counts(rows: DataFrame, total: int, least: int) -> DataFrame:
    """left, right, f: pairs of adjacent ids that occur ``least`` times or more. ``total``: occurrences at most, which sets the number of tasks that add up."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PAIRS_PER_TASK))

    def count(batches):
        held, size = [], 0

        def flush():
            code, n = _added(np.concatenate(held))
            held.clear()
            # Tiles are dealt line by line, so that those of the most frequent words meet in many tasks.
            task = ((code >> 10).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % tasks
            order = np.argsort(task, kind="stable")
            code, n, task = code[order], n[order], task[order]
            edges = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task)) if len(task) else [0]
            parts = [(int(task[a]), code[a:b].tobytes(), n[a:b].astype(np.int32).tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], names=["task", "codes", "counts"])

        for b in batches:
            for x in b.column(0).to_pylist():
                _, code = _codes(np.frombuffer(x, dtype=np.int32))
                held.append(code)
                size += len(code)
                if size >= BLOCK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def add(batches):
        code, n, waiting, size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def merged():
            return _added(np.concatenate([code, *(w[0] for w in waiting)]), np.concatenate([n, *(w[1] for w in waiting)]))

        for b in batches:
            for c, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                waiting.append((np.frombuffer(c, dtype=np.int64), np.frombuffer(m, dtype=np.int32).astype(np.int64)))
                size += len(waiting[-1][0])
                if size >= max(BLOCK // 4, len(code)):
                    code, n = merged()
                    waiting, size = [], 0
        code, n = merged()
        code, n = code[n >= least], n[n >= least]
        left, right = (code >> 42) * SIDE + (code & (1 << 20) - 1) // SIDE, (code >> 20 & (1 << 22) - 1) * SIDE + code % SIDE
        for k in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 100_000]) for a in (left, right, n)], names=["left", "right", "f"])

    parts = rows.mapInArrow(count, "task int, codes binary, counts binary")
    return parts.repartition(tasks, "task").mapInArrow(add, "left long, right long, f long")


def pair_ids(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """The rows rewritten: each place has the id of the pair that begins there, or a break."""
    sc, done = rows.sparkSession.sparkContext, rows.select("ids", F.lit(None).cast("binary").alias("new"))
    for part in _slices(pairs, n, PAIR_SLICE):
        got = part.select((F.shiftleft("left", 31) + F.col("right")).alias("key"), F.col("id").cast("int").alias("id")).toArrow()
        keys, ids = (got.column(c).to_numpy() for c in ("key", "id"))
        order = np.argsort(keys)
        shared = sc.broadcast((keys[order], ids[order]))

        def work(batches, shared=shared, last=n <= PAIR_SLICE):
            keys, new_ids = shared.value
            for b in batches:
                kept, out = [], []
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(x, dtype=np.int32)
                    new = np.full(len(ids), BREAK, dtype=np.int32) if y is None else np.frombuffer(y, dtype=np.int32).copy()
                    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                    code = (ids[at].astype(np.int64) << 31) | ids[at + 1]
                    place = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                    hit = keys[place] == code
                    new[at[hit]] = new_ids[place[hit]]
                    kept.append(None if last else x)
                    out.append((_tidy(new) if last else new).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()), pa.array(out, pa.binary())], names=["ids", "new"])

        done = written(done.mapInArrow(work, "ids binary, new binary"), "phrase-pairs")
        shared.unpersist()
    return done.select(F.col("new").alias("ids"))


def candidates(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5) -> tuple[list[DataFrame], DataFrame]:
    """For each number of words from 1 to ``longest``: lang, id, left, right, f, phrase, pre, suf; and the words of each language.

    left and right are the ids of the phrase without its last and without its first word. pre and suf are the counts of its beginnings and of its ends, by
    their number of words.
    """
    counted = written(word_counts(docs, lang, text), "phrase-counts")
    totals = written(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    frequent = counted.where(F.col("f") >= least)
    vocabulary = written(ranked(frequent, "lang", "word"), "phrase-vocabulary")
    no_counts = F.expr("cast(array() AS array<bigint>)")
    level = vocabulary.select("lang", "id", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), "f", F.col("word").alias("phrase"), no_counts.alias("pre"), no_counts.alias("suf"))
    levels = [level]
    n, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
    if n >= 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    rows = word_ids(docs, vocabulary, n, lang, text) if n else None
    for size in range(2, longest + 1):
        if not n:
            break
        pairs = written(ranked(pair_counts(rows, total, least), "left", "right"), "phrase-pairs-ranked")
        n, total = pairs.agg(F.count("*"), F.coalesce(F.sum("f"), F.lit(0))).first()
        if n >= 1 << 31:
            raise ValueError("more than 2^31 frequent phrases")
        if not n:
            break
        before, after = levels[-1].alias("l"), levels[-1].alias("r")
        joined = pairs.alias("p").join(before, F.col("p.left") == F.col("l.id")).join(after, F.col("p.right") == F.col("r.id"))
        level = joined.select(
            "l.lang",
            "p.id",
            "p.left",
            "p.right",
            "p.f",
            F.concat_ws(" ", "l.phrase", F.substring_index("r.phrase", " ", -1)).alias("phrase"),
            F.concat("l.pre", F.array("l.f")).alias("pre"),
            F.concat("r.suf", F.array("r.f")).alias("suf"),
        )
        levels.append(written(level, f"phrase-{size}"))
        if size < longest:
            rows = pair_ids(rows, pairs, n)
    return levels, totals


def mine(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to ``longest`` words by score.

    A phrase occurs a times. Of its cuts the one of the lowest score floor(1000 * a * n / (l * r)) counts, the earliest of them on ties. Phrases inside a
    longer one that occurs as often are left out: it is enough to look at those longer by one word, for what lies between occurs as often too.
    """
    levels, totals = candidates(docs, lang, text, least, longest)
    wide = "decimal(38,0)"
    kept = None
    for k, level in enumerate(levels[1:], start=1):
        if k + 1 < len(levels):
            longer = levels[k + 1]
            # The largest count of a longer phrase on each side: summed up in the tasks first, so that a frequent phrase inside many is one row.
            as_often = longer.groupBy(F.col("left").alias("id")).agg(F.max("f").alias("m")).unionByName(longer.groupBy(F.col("right").alias("id")).agg(F.max("f").alias("m")))
            covered = as_often.join(level.select("id", "f"), "id").where(F.col("m") >= F.col("f")).select("id").distinct()
            level = level.join(covered, "id", "left_anti")
        kept = level if kept is None else kept.unionByName(level)
    if kept is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    cut = F.expr("transform(sequence(1, size(pre)), k -> struct(k, element_at(pre, k) AS l, element_at(suf, size(pre) + 1 - k) AS r))")
    scored = kept.withColumn("cut", cut).join(F.broadcast(totals) if totals.count() <= MOST_LANGS else totals, "lang")
    score = F.expr(f"transform(cut, c -> struct(CAST(f AS {wide}) * 1000 * n div (CAST(c.l AS {wide}) * c.r) AS score, c.k AS k, c.l AS l, c.r AS r))")
    best = scored.withColumn("best", F.array_min(score)).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = best.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= first)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return some.withColumn("rank", place).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
