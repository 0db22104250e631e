"""Retrieval: lexical and vector search, rank fusion, diversification, neighbours. All take many queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.session import ship

K1, B = 1.4, 0.75


def term_rows(docs: DataFrame, id_col: str, text_col: str, scope: str | None = None) -> DataFrame:
    """(id, scope, term) of all tokens."""
    return docs.select(F.col(id_col).alias("id"), (F.col(scope) if scope else F.lit("all")).alias("scope"), F.explode(tokens(F.col(text_col))).alias("term"))


#: Stands for a document itself among its terms; no token is empty.
WHOLE = ""
#: Terms of queries that are sent to all tasks; of more, each posting looks up its own by a join.
MOST_SENT = 200_000


def lexical_scores(docs: DataFrame, queries: DataFrame, scoped: bool = False) -> DataFrame:
    """docs (id, scope, text), queries (query_id, text) -> (query_id, scope, id, score): BM25 with N, df and average length inside each scope.

    Queries with a column ``scope`` ask that scope alone, the others every scope. Texts are read once: a document's postings are those of its terms that some query asks
    for, and one for itself, from which the sizes of scopes follow. Only these are shuffled. They meet the counts by scope and term and are dealt by document before they
    meet the queries, so a term that is frequent in a scope fans out over all tasks, and the scores of a document are added up in one of them.
    """
    own = ["scope"] if scoped and "scope" in queries.columns else []
    d = docs.select("id", F.col("scope") if scoped else F.lit("all").alias("scope"), tokens(F.col("text")).alias("t"))
    q = queries.select("query_id", *own, F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", *own, "term").agg(F.count("*").alias("qtf"))
    used = q.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(WHOLE).alias("term")))
    posted = d.select("id", "scope", F.size("t").alias("size"), F.explode(F.concat(F.array(F.lit(WHOLE)), "t")).alias("term"))
    tf = posted.join(used, "term", "left_semi").groupBy("scope", "id", "size", "term").agg(F.count("*").alias("tf"))
    itself = F.col("term") == WHOLE
    # Conditions inside the sums, not filters before them: a filter would be pushed down and the texts read again.
    sizes = tf.groupBy("scope").agg(F.sum(F.when(itself, F.col("tf")).otherwise(0)).alias("n"), (F.sum(F.when(itself, F.col("tf") * F.col("size")).otherwise(0)) / F.sum(F.when(itself, F.col("tf")).otherwise(0))).alias("avgdl"))
    df = tf.groupBy("scope", "term").agg(F.count("*").alias("df"))
    m = tf.join(df, ["scope", "term"]).join(sizes, "scope")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.greatest("size", F.lit(1))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length / F.col("avgdl")))
    m = m.select("scope", "id", "term", part.alias("part")).repartition("scope", "id")
    few = q.limit(MOST_SENT + 1).count() <= MOST_SENT
    m = m.join(F.broadcast(q) if few else q, [*own, "term"])
    return m.groupBy("query_id", "scope", "id").agg(F.sum(F.col("part") * (1 + 0.15 * (F.col("qtf") - 1))).alias("score"))


def ranked(scores: DataFrame, k: int, by: list[str], digits: int = 6) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries whose matrix is broadcast at once; more are taken in blocks of this many, one pass over the vectors for each. Vectors that are scored at once.
QUERY_BLOCK, VECTOR_BLOCK = 4_096, 256


def _sound(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null components; the others take no part, whichever side they are on."""
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull())).withColumn("id", F.col("id").cast("long"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, scoped: bool = False) -> DataFrame:
    """vectors and queries (id, v; with ``scoped`` also scope) -> query_id, scope, id, score, rank: the k largest dot products of each query, ties to the smaller id.

    A query meets the vectors of its own scope and length only, and never its own id. Every task keeps the k best of each query as it reads its vectors, and
    only those are shuffled: k rows for a query and task, however many vectors there are. Scores are rounded before they are compared.
    """
    ship(vectors.sparkSession)
    scope = F.col("scope").cast("string") if scoped else F.lit(None).cast("string")
    v, q = (_sound(x).select("id", scope.alias("scope"), "v") for x in (vectors, queries))
    if scoped:
        v, q = v.where("scope IS NOT NULL"), q.where("scope IS NOT NULL")
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    best = None
    for block in range(blocks):
        # A block is a few thousand queries by their hash, whatever their number.
        asked = q.where(F.pmod(F.xxhash64("id", "scope"), F.lit(blocks)) == block).select("id", "scope", "v").collect()
        part = _best_in_tasks(v, asked, k, digits)
        best = part if best is None else best.unionByName(part)
    w = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best_in_tasks(vectors: DataFrame, asked: list, k: int, digits: int) -> DataFrame:
    held: dict[tuple, tuple[list, list]] = {}
    for r in asked:
        ids, rows = held.setdefault((r["scope"], len(r["v"])), ([], []))
        ids.append(r["id"])
        rows.append(r["v"])
    shared = vectors.sparkSession.sparkContext.broadcast({key: (np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(ids), key[1])) for key, (ids, rows) in held.items()})

    def run(batches):
        best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            scopes, sizes = b.column("scope").to_pylist(), pc.list_value_length(b.column("v")).to_pylist()
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(scopes, sizes, strict=True)):
                if key in shared.value:
                    places.setdefault(key, []).append(i)
            for key, rows in places.items():
                asked_ids, matrix = shared.value[key]
                if key not in best:
                    best[key] = np.full((len(asked_ids), k), -np.inf), np.full((len(asked_ids), k), np.iinfo(np.int64).max)
                for at in range(0, len(rows), VECTOR_BLOCK):
                    part = b.take(pa.array(rows[at : at + VECTOR_BLOCK]))
                    ids = part.column("id").to_numpy()
                    v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), key[1])
                    score = np.round(matrix @ v.T, digits)
                    score[(asked_ids[:, None] == ids[None, :]) | np.isnan(score)] = -np.inf
                    _keep(best[key], score, ids, k)
        out = []
        for (scope, size), (score, ids) in best.items():
            q, j = np.nonzero(score > -np.inf)
            out.append(pa.RecordBatch.from_arrays([pa.array(shared.value[scope, size][0][q]), pa.array([scope] * len(q), pa.string()), pa.array(ids[q, j]), pa.array(score[q, j])], ["query_id", "scope", "id", "score"]))
        yield from out

    return vectors.mapInArrow(run, "query_id long, scope string, id long, score double")


def _keep(best: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Puts new scores among the k best of each query where one of them is as good as the last of these."""
    held, of = best
    rows = np.flatnonzero((score >= held[:, -1:]).any(axis=1))
    both = np.hstack([held[rows], score[rows]])
    both_ids = np.hstack([of[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
    order = np.lexsort((both_ids, -both), axis=1)[:, :k]
    held[rows], of[rows] = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_ids, order, axis=1)


def unit(v):
    """A vector over its length; a zero vector stays as it is. The length is repeated beside the components, since a lambda would work it out for each of them."""
    v = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.zip_with(v, F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size(v)), lambda x, n: x / n)


def rrf(one: DataFrame, two: DataFrame, k: int = 60, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Full outer join of two rankings (``by``, id, rank) -> summed reciprocal ranks; order by score, best rank, id."""
    j = one.select(*by, "id", F.col("rank").alias("r1")).join(two.select(*by, "id", F.col("rank").alias("r2")), [*by, "id"], "full")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    j = j.withColumn("score", F.round(part("r1") + part("r2"), 9))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.least("r1", "r2"), "id")
    return j.withColumn("rank", F.row_number().over(w)).select(*by, "id", "r1", "r2", "score", "rank")


def scoped_hybrid(docs: DataFrame, vectors: DataFrame, current: DataFrame, asked: DataFrame, asked_vectors: DataFrame, k: int, depth: int = 60) -> DataFrame:
    """Searches each scope (a machine) by text and by vector together, in its current generation only -> query_id, scope, id, r1, r2, score, rank.

    docs (id, scope, generation, text), vectors (id, scope, generation, v), current (scope, generation); asked (query_id, scope, text) and asked_vectors (id, scope, v)
    name the scope of each question. Counts of terms and lengths are those of the scope's current generation. A scope without a current generation gives nothing.
    """
    docs, vectors = (x.join(current, ["scope", "generation"], "left_semi") for x in (docs, vectors))
    lexical = ranked(lexical_scores(docs, asked, scoped=True), depth, ["query_id", "scope"])
    near = vector_topk(vectors, asked_vectors, depth, scoped=True)
    return rrf(lexical, near, by=("query_id", "scope")).where(F.col("rank") <= k)


def diversify(rows: DataFrame, cluster: str, k: int) -> DataFrame:
    """The first of each cluster in rank order, then the others, re-ranked; rows of no cluster are each their own."""
    key = F.coalesce(F.col(cluster).cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    n = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank"))
    r = rows.withColumn("first", n == 1)
    w = Window.partitionBy("query_id").orderBy(F.desc("first"), "rank")
    return r.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("first")


def neighbours(rows: DataFrame, group: str, order: str, reach: int = 2) -> DataFrame:
    """(group, order, distance, other): rows of the same group up to ``reach`` places away. An equality join on the place itself, no band scan."""
    near = rows.select(group, order, F.explode(F.array(*[F.lit(d) for d in range(-reach, reach + 1) if d])).alias("distance")).withColumn("other", F.col(order) + F.col("distance"))
    return near.join(rows.select(group, F.col(order).alias("other")), [group, "other"]).select(group, order, "distance", "other")
