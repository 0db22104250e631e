"""The engine's queries over the test tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, TOKEN, tokens
from lodestone.operators import evaluate, jobs, ledger, retrieval

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TOKS = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '" + TOKEN + "'), lambda t: length(t) > 1 AND t NOT IN (" + ", ".join(f"'{s}'" for s in STOPWORDS) + "))"
_BM25 = f"""
d AS (SELECT doc_id AS id, {{scope}} AS scope, {_TOKS.format(c="text")} AS t FROM documents),
s AS (SELECT scope, count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM d GROUP BY scope),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOKS.format(c="text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, scope, greatest(len(t), 1) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, scope, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * (1 + 0.15::DOUBLE * (qtf - 1))) AS score
    FROM tf JOIN df USING (scope, term) JOIN s USING (scope) JOIN q USING (term) GROUP BY ALL),
lex AS (SELECT query_id, scope, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(score, 6) DESC, id) AS rank FROM sc)"""


def _docs(spark, sf, scope="source"):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col(scope).alias("scope"), "text")


def _asked(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark, sf, k, scoped=False):
    scores = retrieval.lexical_scores(_docs(spark, sf), _asked(spark, sf), scoped).withColumn("score", F.round("score", 6))
    return retrieval.ranked(scores, k, ["query_id", "scope"] if scoped else ["query_id"])


@query(f"WITH {_BM25.format(scope=chr(39) + 'all' + chr(39))} SELECT query_id, id AS doc_id, score, rank FROM lex WHERE rank <= 10")
def lexical_bm25_topk(spark, sf):
    return _lexical(spark, sf, 10).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_BM25.format(scope='source')} SELECT query_id, scope, id AS doc_id, score, rank FROM lex WHERE rank <= 3")
def lexical_scoped_by_source(spark, sf):
    return _lexical(spark, sf, 3, scoped=True).select("query_id", "scope", F.col("id").alias("doc_id"), "score", "rank")


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {_TOKS.format(c='text')} AS t FROM documents)")
def tokenize_stats(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT term, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({_TOKS.format(c='text')}) AS term FROM documents) GROUP BY term")
def term_stats(spark, sf):
    per_doc = retrieval.term_rows(_t(spark, sf, "documents"), "doc_id", "text").groupBy("id", "term").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
#: Which vectors are asked: those of the benchmark's questions, whose ids they share, or every fiftieth.
_OF_ITEMS, _FIFTIETH = "q.id IN (SELECT item_id FROM benchmark)", "q.id % 50 = 0"
_VEC = f"""u AS (SELECT vec_id AS id, label, {_UNIT} AS v FROM embeddings),
vs AS (SELECT q.id AS query_id, d.id, round(list_dot_product(d.v, q.v), 6) AS score FROM u d JOIN u q ON {{asked}} AND d.id <> q.id),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs)"""


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", retrieval.unit(F.col("embedding")).alias("v"))


def _vector(spark, sf, k, asked):
    return retrieval.vector_topk(_vectors(spark, sf), asked, k).drop("scope")


@query(f"WITH {_VEC.format(asked=_FIFTIETH)} SELECT query_id, id AS vec_id, score, rank FROM vec WHERE rank <= 10")
def vector_topk(spark, sf):
    return _vector(spark, sf, 10, _vectors(spark, sf).where("id % 50 = 0")).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(f"SELECT vec_id, label, round(list_sum(list_transform({_UNIT}, lambda x: x * x)), 6) AS norm FROM embeddings")
def vector_l2_normalize(spark, sf):
    return _vectors(spark, sf).select(F.col("id").alias("vec_id"), "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


_RRF = f"""WITH {_BM25.format(scope=chr(39) + 'all' + chr(39))}, {_VEC.format(asked=_OF_ITEMS)},
l AS (SELECT * FROM lex WHERE rank <= 60), x AS (SELECT * FROM vec WHERE rank <= 60),
j AS (SELECT coalesce(l.query_id, x.query_id) AS query_id, coalesce(l.id, x.id) AS id, l.rank AS r1, x.rank AS r2, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS score
    FROM l FULL JOIN x ON l.query_id = x.query_id AND l.id = x.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(r1, r2), id) AS rank FROM j)"""


def _fused(spark, sf):
    items = _t(spark, sf, "benchmark").select(F.col("item_id").alias("id"))
    return retrieval.rrf(_lexical(spark, sf, 60), _vector(spark, sf, 60, _vectors(spark, sf).join(items, "id", "left_semi")))


@query(_RRF + " SELECT query_id, id, r1, r2, score, rank FROM r WHERE rank <= 20")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).where("rank <= 20")


@query(_RRF + """, c AS (SELECT r.*, d.source AS cluster, row_number() OVER (PARTITION BY query_id, coalesce(d.source, '#' || id) ORDER BY rank) = 1 AS first FROM r LEFT JOIN documents d ON d.doc_id = r.id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first DESC, rank) AS new_rank FROM c) SELECT query_id, id, cluster, rank, new_rank FROM n WHERE new_rank <= 10""")
def rrf_diversified(spark, sf):
    rows = _fused(spark, sf).join(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster")), "id", "left")
    return retrieval.diversify(rows, "cluster", 10).select("query_id", "id", "cluster", "rank", "new_rank")


@query("SELECT a.conv_id, a.turn, (b.turn - a.turn)::INTEGER AS distance, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) IN (1, 2)")
def neighbor_context(spark, sf):
    return retrieval.neighbours(_t(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_chunk(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lead("turn").over(w).alias("following"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'of') ORDER BY source, doc_id LIMIT 50 OFFSET 10")
def chunk_browser_page(spark, sf):
    low = F.lower("text")
    return _t(spark, sf, "documents").where(low.contains("the") & low.contains("of")).orderBy("source", "doc_id").offset(10).limit(50).select("doc_id", "source", "n_chars")


_EVAL = f"""WITH {_BM25.format(scope=chr(39) + 'all' + chr(39))},
rel AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40 JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1),
first AS (SELECT b.item_id AS query_id, min(x.rank) AS rank FROM benchmark b LEFT JOIN (SELECT lex.query_id, lex.rank FROM lex JOIN rel USING (query_id, id) WHERE rank <= 10) x ON x.query_id = b.item_id WHERE b.item_id IN (SELECT query_id FROM rel) GROUP BY b.item_id)"""


@query(_EVAL + """ SELECT count(*) AS cases, round(100.0::DOUBLE * avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 2) AS hit_1, round(100.0::DOUBLE * avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 2) AS hit_3,
round(100.0::DOUBLE * avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 2) AS hit_5, round(100.0::DOUBLE * avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 2) AS hit_10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 5) AS mrr FROM first""")
def eval_hit_mrr(spark, sf):
    good = _t(spark, sf, "labels").where("quality = 1").select("doc_id")
    d = _t(spark, sf, "documents").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("k"))
    q = _asked(spark, sf)
    relevant = q.withColumn("k", F.col("query_id") % 40).join(d, "k").select("query_id", "id")
    return evaluate.summary(evaluate.hits(_lexical(spark, sf, 10), q, relevant))


_STATUS = ["F", "O", "P", "X"]


@query("SELECT s AS status, count(o_orderkey)::BIGINT AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def status_counts(spark, sf):
    return jobs.status_counts(_t(spark, sf, "orders"), "o_orderstatus", _STATUS)


@query("SELECT o_custkey, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS n_f, count_if(o_orderstatus = 'O')::BIGINT AS n_o, count_if(o_orderstatus = 'P')::BIGINT AS n_p FROM orders GROUP BY o_custkey")
def status_pivot_by_owner(spark, sf):
    return jobs.pivot_counts(_t(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def queue_next(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return jobs.queue_next(_t(spark, sf, "orders"), F.col("o_orderstatus") == "O", "o_custkey", [rank, F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def discover_unprocessed(spark, sf):
    done = _t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return jobs.unprocessed(_t(spark, sf, "orders"), done, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = 'O')")
def sweep_claim_not_exists(spark, sf):
    return jobs.claimable(_t(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count_if(l_linestatus = 'O') = 0")
def books_ready_gate(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open")).where("open = 0").drop("open")


@query("SELECT n_name, r_name, count(s_suppkey)::BIGINT AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def catalog_star_join(spark, sf):
    n = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = _t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "r_name", F.coalesce("suppliers", F.lit(0)).cast("long").alias("suppliers"))


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS n, coalesce(last, 'none') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def left_join_coalesce_sort(spark, sf):
    o = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("last"))
    return _t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("last", F.lit("none")).alias("last")).orderBy(F.desc("n"), "c_custkey")


@query("SELECT o_orderkey, least(300.0::DOUBLE, 15.0::DOUBLE * pow(2.0::DOUBLE, least(greatest(o_orderkey % 9 - 1, 0), 5))) AS delay FROM orders")
def backoff_schedule(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", jobs.backoff(F.col("o_orderkey") % 9, 15, 300).alias("delay"))


@query("SELECT event_id, user_id, event_type, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value > 50) DESC, CASE WHEN value > 50 THEN ts END DESC, ts DESC, event_id DESC)) = 1 AS winner FROM events")
def reconcile_generations(spark, sf):
    e = _t(spark, sf, "events").withColumn("human", F.col("value") > 50)
    return ledger.reconcile(e, ["user_id", "event_type"], "human", "ts", "ts", "event_id").select("event_id", "user_id", "event_type", "winner")


@query("SELECT l_orderkey, sha256(string_agg(d, ',' ORDER BY d)) AS signature FROM (SELECT l_orderkey, sha256(concat_ws(chr(31), l_linenumber::VARCHAR, l_returnflag, l_linestatus)) AS d FROM lineitem) GROUP BY l_orderkey")
def set_signature(spark, sf):
    return ledger.sorted_signature(_t(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag", "l_linestatus"])


_ROLL = "SELECT event_id, user_id, count(*) OVER w AS calls, sum(value) OVER w AS total FROM (SELECT *, floor(epoch(ts))::BIGINT AS e FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY e RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, user_id, calls, round(total, 4) AS total FROM ({_ROLL})")
def rolling_24h_usage(spark, sf):
    return ledger.rolling_usage(_t(spark, sf, "events"), "user_id", "ts", "value").select("event_id", "user_id", "calls", F.round("total", 4).alias("total"))


@query(f"SELECT event_id, CASE WHEN calls + 1 > 9 THEN 'paused' WHEN calls >= 8 THEN 'warning' ELSE 'ok' END AS state FROM ({_ROLL})")
def quota_state(spark, sf):
    u = ledger.rolling_usage(_t(spark, sf, "events"), "user_id", "ts", "value")
    return u.select("event_id", ledger.quota_state(F.col("calls"), 10).alias("state"))


@query("SELECT event_type, user_id % 4 AS kind, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())")
def usage_grouping_sets(spark, sf):
    e = _t(spark, sf, "events").withColumn("kind", F.col("user_id") % 4)
    return e.groupingSets([[F.col("event_type")], [F.col("kind")], []], F.col("event_type"), F.col("kind")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT user_id, session, count(*) AS n, min(e) AS began, max(e) AS ended FROM (SELECT user_id, e, sum(new) OVER (PARTITION BY user_id ORDER BY e, event_id)::BIGINT AS session FROM
(SELECT *, coalesce((e - lag(e) OVER (PARTITION BY user_id ORDER BY e, event_id) >= 1200)::INT, 0) AS new FROM (SELECT *, floor(epoch(ts))::BIGINT AS e FROM events))) GROUP BY user_id, session""")
def session_windows(spark, sf):
    s = ledger.sessions(_t(spark, sf, "events"), "user_id", "ts", 1200)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("epoch").alias("began"), F.max("epoch").alias("ended"))


@query("""SELECT line, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 1 AND 80 GROUP BY line HAVING count(DISTINCT doc_id) >= 5""")
def repeated_short_text(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, 80))
    return lines.groupBy("line", "doc_id").agg(F.lit(1)).groupBy("line").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs >= 5")


@query("""SELECT conv_id, island, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) GROUP BY conv_id, role, island""")
def stitch_islands(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    i = _t(spark, sf, "conversations").withColumn("island", F.col("turn") - F.row_number().over(w))
    return i.groupBy("conv_id", "role", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).drop("role")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations")
def table_header_carry_forward(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w).alias("header"))
