"""Whitening of embeddings by shifted CholeskyQR.

Vectors are put on a whole-number grid; the fit list is each different grid vector once. Its centred rows A are
orthogonalised in passes: each pass adds up the Gram matrix of the rows as they stand (every task its own part,
parts added line by line), factors it with a small shift by Cholesky, and solves the triangle for each row. The
passes' triangles compose to R with A = QR; once Q's Gram matrix no longer changes it corrects R for what is left.
The singular values of R are those of A, and its right singular vectors are the principal components.

All passes read the same written table. A triangle is d x d numbers for vectors of length d, whatever the rows.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out. Vectors of different
lengths are fitted by themselves. Entries beyond 64 bits on the grid become the nearest value that has them; a
deviation beyond 64 bits is null. There are as many components as the vectors' covariance has rank, at most as
many as asked for; a list without variance has none. Repeated rows each get their own results. Other columns than
the id and the vector are not read; null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import written

#: Grid points for a length of one.
GRID = 256.0
#: Passes of shifted Cholesky at most; vectors of full rank take three.
MOST_PASSES = 6
#: Different lengths of vectors that are fitted one after the other; more are an error.
MOST_LENGTHS = 64
#: Vectors whose components are worked out together in a task.
ROWS = 4096


def _on_grid(rows: DataFrame, vector: str) -> DataFrame:
    """The rows that take part, with ``x``: the vector on the grid."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * GRID, F.lit(-9.2e18)), F.lit(9.2e18))))
    return rows.where(F.col(vector).isNotNull() & finite).withColumn("x", whole)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


def _blocks(batches, d: int, at: int = 0):
    """The vectors of a task in blocks of bounded size."""
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield _matrix(b.column(at).slice(k, ROWS), d)


def _added(parts: DataFrame, tasks: int) -> DataFrame:
    """line, v: the sums of lines that came from many tasks. Each line is added up in one task as it comes in."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for line, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy()
                total[line] = total[line] + v if line in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["line", "v"])

    return parts.repartition(tasks, "line").mapInArrow(add, "line int, v array<double>")


class Centre:
    """Exact sums of the fit list, and vectors less their mean."""

    def __init__(self, n: int, sums: list[int], most: int):
        self.n, self.sums, self.most = n, sums, most
        #: n*x - S fits 64 bits.
        self.fits = most * n < 1 << 61

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly."""
        if self.fits:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once or twice."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sums of squares of n*x - S, exactly; None where they pass 64 bits."""
        s = self.scaled(x)
        if self.fits and len(self.sums) * float(np.abs(s).max(initial=0)) ** 2 < 2.0**62:
            return (s * s).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in s]
        return [v if v < 1 << 63 else None for v in sums]


def centre(fit: DataFrame, d: int) -> Centre:
    """n, S and the largest entry, as whole numbers: the halves of 32 bits are added by themselves, so that no sum overflows."""

    def work(batches):
        n, low, high, most = 0, np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64), 0
        for x in _blocks(batches, d):
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            high += (x >> 32).sum(axis=0)
            most = max(most, -int(x.min(initial=0)), int(x.max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([most])], names=["n", "low", "high", "most"])

    parts = fit.mapInArrow(work, "n long, low array<long>, high array<long>, most long")
    split = parts.select("n", "most", F.posexplode(F.arrays_zip("low", "high")).alias("line", "s"))
    # A task's half sums stay under 2^63; their sums over tasks are decimals.
    lines = split.groupBy("line").agg(F.sum("n").alias("n"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.max("most").alias("most")).collect()
    lines.sort(key=lambda r: r["line"])
    return Centre(lines[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in lines], max(r["most"] for r in lines))


def gram(fit: DataFrame, d: int, of) -> np.ndarray:
    """The sum of v'v over the rows v = of(x): every task adds up its own rows, then lines of the tasks' matrices are added up."""

    def work(batches):
        total = None
        for x in _blocks(batches, d):
            v = of(x)
            part = v.T @ v
            total = part if total is None else total + part
        lines = [] if total is None else list(total)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), pa.array(lines, pa.list_(pa.float64()))], names=["line", "v"])

    tasks = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _added(fit.mapInArrow(work, "line int, v array<double>"), tasks).collect()
    g = np.array([r["v"] for r in sorted(lines, key=lambda r: r["line"])])
    return (g + g.T) / 2


def triangle(g: np.ndarray, n: int) -> np.ndarray:
    """Upper R with R'R = g + s*I, s as small as keeps the factorisation from breaking down."""
    d, u = len(g), np.finfo(np.float64).eps / 2
    shift = 11 * (d * n + d * (d + 1)) * u * np.linalg.norm(g, 2)
    # The shift that is proved safe grows with n; one that only covers the rounding of sums in blocks is tried first.
    for s in (11 * d * (d + 1) * u * np.linalg.norm(g, 2), shift, 100 * shift):
        try:
            return np.linalg.cholesky(g + s * np.eye(d)).T
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("the Gram matrix can't be factored")


def solved(v: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """v times the inverse of each triangle in turn, column by column."""
    for r in triangles:
        out = np.empty_like(v)
        for k in range(v.shape[1]):
            out[:, k] = (v[:, k] - out[:, :k] @ r[:k, k]) / r[k, k]
        v = out
    return v


class Whitening:
    """What a fit list says: centre, components as columns by falling eigenvalue, eigenvalues of the covariance, its trace."""

    def __init__(self, middle: Centre, components: np.ndarray, values: np.ndarray, trace: float):
        self.middle, self.components, self.values, self.trace = middle, components, values, trace

    def apply(self, x: np.ndarray, k: int) -> np.ndarray:
        return self.middle.rows(x) @ self.components[:, :k] / np.sqrt(self.values[:k])


def fit_whitening(fit: DataFrame, d: int) -> Whitening:
    """All components of positive variance of a table of different vectors ``x`` of length d."""
    middle = centre(fit, d)
    n, r, triangles, trace, before = middle.n, np.eye(d), [], None, None
    for _ in range(MOST_PASSES):
        done = list(triangles)
        g = gram(fit, d, lambda x, done=done: solved(middle.rows(x), done))
        if trace is None:
            trace = float(np.trace(g)) / n
            if not trace > 0:
                return Whitening(middle, np.zeros((d, 0)), np.zeros(0), 0.0)
        # Orthonormal, or no better than before: where the list has less than full rank some directions stay empty.
        settled = np.abs(g - np.eye(d)).max() < 1e-13 * d or before is not None and np.abs(g - before).max() < 1e-13 * d
        if settled:
            break
        before = g
        triangles.append(triangle(g, n))
        r = triangles[-1] @ r
    # A = QR and Q'Q = g, so A'A = (g^1/2 R)'(g^1/2 R).
    value, vector = np.linalg.eigh(g)
    root = vector * np.sqrt(np.clip(value, 0, None)) @ vector.T
    _, sigma, right = np.linalg.svd(root @ r)
    values = sigma * sigma / n
    some = values > values[0] * d * 1e-14
    return Whitening(middle, right.T[:, some], values[some], trace)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = 4) -> DataFrame:
    """A row for each row that takes part and each of its first k components: key, component, n, deviation, whitened, explained, identity_error.

    The vectors go through one shuffle, which leaves each once; the fit then reads that table in passes.
    """
    taking_part = _on_grid(rows.select(key, vector), vector).select(key, "x")
    fit = written(taking_part.select("x").distinct(), "whitening-fit")
    lengths = [r[0] for r in fit.select(F.size("x")).where(F.size("x") > 0).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} different lengths of vectors")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for d in sorted(lengths):
        own = fit.where(F.size("x") == d)
        w = fit_whitening(own, d)
        m = min(k, len(w.values))
        if not m:
            continue
        cov = gram(own, d, lambda x, w=w, m=m: w.apply(x, m)) / w.middle.n
        error = float(np.abs(cov - np.eye(m)).max())

        def work(batches, d=d, w=w, m=m, error=error):
            explained = w.values[:m] / w.trace
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = _matrix(part.column(1), d)
                    whole = len(x) * m
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), m)))
                    values = [np.tile(np.arange(1, m + 1, dtype=np.int32), len(x)), np.full(whole, w.middle.n), [v for v in w.middle.deviation(x) for _ in range(m)], w.apply(x, m).ravel(), np.tile(explained, len(x)), np.full(whole, error)]
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in zip(values, types, strict=True))], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        part = taking_part.where(F.size("x") == d).mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out
