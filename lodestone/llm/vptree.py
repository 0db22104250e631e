"""Nearest neighbours by cosine through vantage-point trees, one per shard of the vectors.

Unit vectors under Euclidean distance form a metric space ordered like cosine. Each node of a tree keeps a vantage point and the
shells of distance that its two halves lie in. A half is pruned if the query's distance to its shell exceeds the distance of the
k-th best so far divided by ``relax``: the triangle inequality at 1, which makes the search exact; more than 1 prunes more
and may miss some. Distances are compared as squares, 2 - 2 x.q, whose rounding is the same near and far, with a bound on it (``rounding``) to spare;
near zero that is far more of the distance itself. Queries travel through a tree in blocks, so that every step works on arrays.

The upper levels are one tree for all: it is fitted on ``SAMPLE`` vectors, deals every vector to a cell, and its shells are measured over all
vectors of each cell. A query has k neighbours at most as far as its k nearest of the sample, so it travels only to the cells that the triangle
inequality leaves for that distance. Cells hold about ``SHARD_BYTES`` of vectors, and larger ones are cut into shards by hash. Vectors
of different lengths have no cosine, so each length has cells of its own. Scores are computed anew on the original vectors, in double
precision, in one order of summation, so equal vectors score equally; ties go to the smaller id, null ids last.

Defined results: null, empty or zero vectors, and those with null or non-finite components, take no part; with fewer than k candidates all
are returned; each row is a query or candidate of its own, whether or not others have its id or vector, and is no candidate for itself; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import written

SHARD_BYTES, LEAST_SHARD, MOST_CELLS, SAMPLE, QUERY_BLOCK, LEAF = 32 << 20, 4_096, 1_024, 2_048, 512, 128
#: Different lengths of vectors; more are an error.
MOST_LENGTHS = 1_000


def rounding(dims: int) -> float:
    """Over twice the most that a computed squared distance of unit vectors, or a score, is off: dims + 8 roundings in the product and the norms."""
    return 16 * (dims + 8) * 2.0**-53


class Tree:
    """A vantage-point tree over the rows of a matrix of unit vectors, laid out so that each leaf is a run of rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.leaf = np.arange(len(x)), leaf
        self.x = x
        self.root = self._grow(0, len(x))
        self.x = x[self.order]

    def _grow(self, a: int, b: int):
        if b - a <= self.leaf:
            return (a, b)
        rows = self.order[a:b]
        # Vantage: the row farthest from the first one's side, a corner of the set.
        v = self.x[rows[np.argmin(self.x[rows] @ self.x[rows[0]])]].copy()
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows] @ v)))
        by = np.argsort(d, kind="stable")
        self.order[a:b], d, m = rows[by], d[by], (b - a) // 2
        return (v, (d[0], d[m - 1]), (d[m], d[-1]), self._grow(a, a + m), self._grow(a + m, b))

    def search(self, q: np.ndarray, k: int, relax: float) -> list[np.ndarray]:
        """Rows (of the matrix given) that are among the k nearest of each query, with all that tie within rounding."""
        self.q, self.k, self.relax = q, k, relax
        self.best = np.full((len(q), k), np.inf)  # squared distances
        self.off = rounding(q.shape[1])
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
        if len(self.x):
            self._visit(self.root, np.arange(len(q)))
        out = []
        for got, worst in zip(self.found, self.best[:, -1], strict=True):
            rows, d = (np.concatenate(z) for z in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0))
            out.append(self.order[rows[d <= worst + self.off]])
        return out

    def _visit(self, node, active: np.ndarray) -> None:
        if len(node) == 2:
            a, b = node
            d = np.maximum(0, 2 - 2 * (self.q[active] @ self.x[a:b].T))
            both = np.concatenate([self.best[active], d], axis=1)
            both.partition(self.k - 1, axis=1)
            self.best[active] = np.sort(both[:, : self.k], axis=1)
            near = d <= self.best[active, -1:] + self.off
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                j = np.flatnonzero(near[i])
                self.found[active[i]].append((a + j, d[i, j]))
            return
        v, inner, outer, one, two = node
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.q[active] @ v)))
        inside = d <= (inner[1] + outer[0]) / 2
        for side, first, second in ((inside, (inner, one), (outer, two)), (~inside, (outer, two), (inner, one))):
            if side.any():
                for shell, child in (first, second):
                    gap = np.maximum(0, np.maximum(shell[0] - d[side], d[side] - shell[1]))
                    # The gap is off by as much as two distances are: each by the root of the bound at most.
                    go = gap <= np.sqrt(self.best[active[side], -1] + self.off) / self.relax + 2 * np.sqrt(self.off)
                    if go.any():
                        self._visit(child, active[side][go])


class Cells:
    """The upper levels: a vantage point and a median for each inner node, in heap order; a cell is a path through them."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, inner = levels, (1 << levels) - 1
        self.vantage, self.median = np.zeros((inner, sample.shape[1])), np.zeros(inner)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            here = rows.pop(node)
            x = sample[here] if len(here) else sample
            self.vantage[node] = x[np.argmin(x @ x[0])]
            d = self.far(x, self.vantage[node : node + 1])[:, 0]
            self.median[node] = np.median(d)
            if len(here):
                rows[2 * node + 1], rows[2 * node + 2] = here[d <= self.median[node]], here[d > self.median[node]]
            else:
                rows[2 * node + 1] = rows[2 * node + 2] = here

    @staticmethod
    def far(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (x @ v.T)))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distances to the vantage points on the way."""
        node, out = np.zeros(len(x), np.int64), np.zeros((len(x), self.levels))
        for level in range(self.levels):
            out[:, level] = np.sqrt(np.maximum(0, 2 - 2 * (x * self.vantage[node]).sum(axis=1)))
            node = 2 * node + 1 + (out[:, level] > self.median[node])
        return node - len(self.median), out

    def nearest(self, q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least distance that each query can have to each of the cells, by their shells."""
        gap = np.zeros((len(q), len(cells)))
        d, node = self.far(q, self.vantage) if self.levels else None, cells + len(self.median)
        for level in range(self.levels - 1, -1, -1):
            node = (node - 1) // 2
            gap = np.maximum(gap, np.maximum(low[:, level] - d[:, node], d[:, node] - high[:, level]))
        return gap


def _valid(vectors: DataFrame, asked: Column, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(vec_col).alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(v.isNotNull() & good, F.lit(False)))


def _matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    extreme = ~((norm > 1e-140) & (norm < 1e140))
    if extreme.any():  # squares overflow or vanish
        most = np.abs(x).max(axis=1, keepdims=True)
        unit = x / most
        length = np.sqrt((unit * unit).sum(axis=1))
        return unit / length[:, None], np.where(extreme, length * most[:, 0], norm)
    return x / norm[:, None], norm


def _scores(x: np.ndarray, norm: np.ndarray, q: np.ndarray, q_norm: float) -> np.ndarray:
    """Cosines of the rows of x with q."""
    if q_norm < 1e-140 or q_norm > 1e140 or ((norm < 1e-140) | (norm > 1e140)).any():
        return ((x / norm[:, None]) * (q / q_norm)).sum(axis=1)
    return (x * q).sum(axis=1) / (norm * q_norm)


def _by_length(batch: pa.RecordBatch, most: int = 4_096):
    """Parts of a batch whose vectors have one length."""
    sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        of = batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))
        for k in range(0, of.num_rows, most):
            yield int(size), of.slice(k, most)


def _sampled(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """size, v: for each length SAMPLE vectors at most (fewer where there are many lengths), the first by a hash of different rows.

    Only rows whose hash is under a bound are ranked, some four times as many as are taken, however many there are.
    """
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} different lengths of vectors")
    most = max(64, SAMPLE // max(1, len(counts)))
    bounds = [F.lit(x) for size, n in counts.items() for x in (size, int(min(1.0, 4 * most / n) * (1 << 32)))]
    if not bounds:
        return rows.select("size", "v")
    hashed = rows.select("size", "v", F.xxhash64("id", "v").alias("hash")).where(F.pmod("hash", F.lit(1 << 32)) < F.element_at(F.create_map(*bounds), F.col("size")))
    first = Window.partitionBy("size").orderBy("hash")
    return hashed.dropDuplicates(["size", "hash"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).select("size", "v")


def search(vectors: DataFrame, asked: Column | str, k: int = 5, relax: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """query_id, rank, ``id_col``, score: the k nearest rows of each row that ``asked`` (a condition on the rows) holds for."""
    asked = F.expr(asked) if isinstance(asked, str) else asked
    spark = vectors.sparkSession
    rows = _valid(vectors, asked, id_col, vec_col).withColumn("size", F.size("v"))
    counts = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}  # one row per length of vectors
    kind = vectors.schema[vec_col].dataType.simpleString()
    sample: dict[int, np.ndarray] = {}
    for r in _sampled(rows, counts).collect():
        sample.setdefault(r["size"], []).append(r["v"])
    sample = {size: _units(np.array(x, np.float64))[0] for size, x in sample.items()}
    cores = spark.sparkContext.defaultParallelism
    # Rows of a shard by memory; a small table is cut further, to keep all cores busy.
    most = {size: max(1, min(shard_bytes // (8 * size), max(LEAST_SHARD, -(-n // (2 * cores))))) for size, n in counts.items()}
    cells = {size: Cells(sample[size], int(np.log2(max(1, min(MOST_CELLS, len(sample[size]) // 2, n // most[size]))))) for size, n in counts.items()}
    fitted = spark.sparkContext.broadcast((cells, sample))

    def place(batches):
        grids = fitted.value[0]
        for b in batches:
            for size, part in _by_length(b):
                cell, d = grids[size].place(_units(_matrix(part.column("v")))[0])
                way = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "id", "asked", "size", "v")), pa.array(cell), way], ["rid", "id", "asked", "size", "v", "cell", "way"])

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    placed = written(numbered.mapInArrow(place, f"rid long, id long, asked boolean, size int, v {kind}, cell long, way array<double>"), "cells")
    deep = max((c.levels for c in cells.values()), default=0)
    way = lambda i: F.get("way", F.lit(i))
    shells = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), *[f(way(i)).alias(f"{name}{i}") for i in range(deep) for name, f in (("low", F.min), ("high", F.max))])
    # One row per cell: at most MOST_CELLS for each length.
    grid, at = {}, 0
    for r in shells.orderBy("size", "cell").collect():
        parts = max(1, -(-r["n"] // most[r["size"]]))
        levels = range(cells[r["size"]].levels)
        grid.setdefault(r["size"], []).append((r["cell"], at, parts, [r[f"low{i}"] for i in levels], [r[f"high{i}"] for i in levels]))
        at += parts
    shards = max(1, at)
    places = {size: tuple(np.array(x, float if i > 2 else np.int64).reshape(len(g), -1) if i > 2 else np.array(x, np.int64) for i, x in enumerate(zip(*g, strict=True))) for size, g in grid.items()}
    dealt_to = spark.sparkContext.broadcast(places)

    def deal(batches):
        grids, near = fitted.value
        for b in batches:
            for size, part in _by_length(b, QUERY_BLOCK):
                cell, begin, parts, low, high = dealt_to.value[size]
                x, _ = _units(_matrix(part.column("v")))
                rid, is_asked = part.column("rid").to_numpy(), part.column("asked").to_numpy(zero_copy_only=False)
                own = np.searchsorted(cell, part.column("cell").to_numpy())
                mixed = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                row, shard, kind_of = [np.arange(len(x))], [begin[own] + (mixed % parts[own].astype(np.uint64)).astype(np.int64)], [np.zeros(len(x), np.int32)]
                q = np.flatnonzero(is_asked)
                if len(q):
                    off = rounding(size)
                    d = np.maximum(0, 2 - 2 * (x[q] @ near[size].T))
                    # One more than k, since the query itself may be in the sample.
                    bound = np.sqrt(np.partition(d, k, axis=1)[:, k] + off) if d.shape[1] > k else np.full(len(q), np.inf)
                    i, j = np.nonzero(grids[size].nearest(x[q], cell, low, high) <= (bound / relax + 2 * np.sqrt(off))[:, None])
                    times = parts[j]
                    one = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row.append(np.repeat(q[i], times))
                    shard.append(np.repeat(begin[j], times) + one)
                    kind_of.append(np.ones(len(one), np.int32))
                sent = part.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), pa.array(np.concatenate(kind_of)), *(sent.column(c) for c in ("rid", "id", "v"))], ["shard", "kind", "rid", "id", "v"])

    def run(batches):
        shard, tree, held, waiting = None, None, [], []
        out_rows = lambda: {n: [] for n in schema.names}

        def answer():
            nonlocal tree, ids, rids, x, norm
            if tree is None:
                if not held:
                    return
                ids, rids = [z for h in held for z in h[0]], np.concatenate([h[1] for h in held])
                x = np.concatenate([h[2] for h in held])
                unit, norm = _units(x)
                tree = Tree(unit)
            q_ids, q_rids, q = [z for w in waiting for z in w[0]], np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            unit, q_norm = _units(q)
            out = out_rows()
            for i, found in enumerate(tree.search(unit, k + 1, relax)):
                found = found[rids[found] != q_rids[i]]
                score = _scores(x[found], norm[found], q[i], q_norm[i])
                near = sorted((-s, ids[r] is None, ids[r] or 0, int(rids[r])) for s, r in zip(score.tolist(), found.tolist(), strict=True))[:k]
                for s, no_id, j, r in near:
                    for name, v in zip(schema.names, (int(q_rids[i]), q_ids[i], r, None if no_id else j, -s), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

        ids = rids = x = norm = None
        for b in batches:
            shard_of, kind_of = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shard_of) != 0) | (np.diff(kind_of) != 0)) + 1
            for a, e in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard_of)]]), strict=True):
                if a == e:
                    continue
                if shard_of[a] != shard:
                    if waiting:
                        yield from answer()
                    shard, tree, held, waiting = shard_of[a], None, [], []
                part = b.slice(int(a), int(e - a))
                for t in range(0, part.num_rows, QUERY_BLOCK):
                    s = part.slice(t, QUERY_BLOCK)
                    some = s.column("id").to_pylist(), s.column("rid").to_numpy(), _matrix(s.column("v"))
                    if kind_of[a] == 0:
                        held.append(some)
                        continue
                    waiting.append(some)
                    if sum(len(w[1]) for w in waiting) >= QUERY_BLOCK:
                        yield from answer()
                        waiting.clear()
        if waiting:
            yield from answer()

    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    dealt = placed.mapInArrow(deal, f"shard long, kind int, rid long, id long, v {kind}").repartition(shards, "shard").sortWithinPartitions("shard", "kind", "rid")
    near = dealt.mapInArrow(run, "query long, query_id long, row long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
