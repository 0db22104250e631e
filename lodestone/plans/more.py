"""More catalog queries: quality, routes, registries, ledgers, transitions. Registered with those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import jobs, ledger, quality
from lodestone.plans import answering, collections, deep, entrybooks, jobqueues, judging, scalars, scopes, structure, tablebooks, texts
from lodestone.plans.catalog import _TOKS, _UNIT, QUERIES, SQL, _t, _vectors, query

_QUAL = f"""WITH t AS (SELECT doc_id, text, {_TOKS.format(c="text")} AS t FROM documents),
g AS (SELECT doc_id, max(n) AS most FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, array_to_string(t[i:i + 7], ' ') AS g FROM t, generate_series(1, 30000) s(i) WHERE i <= len(t) - 7) GROUP BY ALL) GROUP BY doc_id),
r AS (SELECT t.doc_id, len(t)::BIGINT AS n_tokens, CASE WHEN len(t) >= 24 AND most >= 3 THEN least(1.0::DOUBLE, most * 8.0::DOUBLE / len(t)) ELSE 0.0::DOUBLE END AS ratio FROM t LEFT JOIN g USING (doc_id)),
m AS (SELECT *, n_tokens >= 2 AND ratio < 0.40 AS eligible, CASE WHEN n_tokens > 512 THEN 20 ELSE 0 END + CASE WHEN n_tokens < 2 THEN 35 ELSE 0 END + CASE WHEN ratio >= 0.40 THEN 35 ELSE 0 END AS off FROM r),
k AS (SELECT doc_id, n_tokens, round(ratio, 6) AS ratio, eligible, greatest(0, least(100 - off, CASE WHEN eligible THEN 100 ELSE 45 END))::BIGINT AS score FROM m)"""


def _quality(spark, sf):
    return quality.chunk_quality(_t(spark, sf, "documents"), "doc_id", "text", 512)


@query(f"{_QUAL} SELECT * FROM k")
def chunk_quality_metadata(spark, sf):
    return _quality(spark, sf).withColumn("ratio", F.round("ratio", 6))


@query(f"{_QUAL} SELECT eligible, count(*) AS n, round(avg(score), 2) AS mean_score, count_if(n_tokens > 512)::BIGINT AS oversized, count_if(ratio >= 0.4)::BIGINT AS repetitive FROM k GROUP BY eligible")
def quality_summary(spark, sf):
    q = _quality(spark, sf)
    return q.groupBy("eligible").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean_score"), F.count_if(F.col("n_tokens") > 512).alias("oversized"), F.count_if(F.col("ratio") >= 0.4).alias("repetitive"))


@query(f"{_QUAL} SELECT warning, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_tokens > 512 THEN 'oversized' END, CASE WHEN n_tokens < 2 THEN 'too_little_text' END, CASE WHEN ratio >= 0.4 THEN 'repetitive' END], lambda w: w IS NOT NULL)) AS warning FROM k) GROUP BY warning")
def warning_histogram(spark, sf):
    w = F.array_compact(F.array(F.when(F.col("n_tokens") > 512, "oversized"), F.when(F.col("n_tokens") < 2, "too_little_text"), F.when(F.col("ratio") >= 0.4, "repetitive")))
    return _quality(spark, sf).select(F.explode(w).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


_ROUTE = "l_suppkey AS owner, l_partkey % 50 AS source, l_linestatus AS code, CASE l_returnflag WHEN 'R' THEN 80 WHEN 'A' THEN 55 ELSE 30 END + least(12.0::DOUBLE, 0.12::DOUBLE * l_quantity::DOUBLE) AS priority"
_MERGED = f"SELECT owner, source, max(priority) AS priority, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(*) AS n FROM (SELECT {_ROUTE} FROM lineitem) GROUP BY owner, source"


def _routes(spark, sf):
    base = F.when(F.col("l_returnflag") == "R", 80).when(F.col("l_returnflag") == "A", 55).otherwise(30)
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 50).alias("source"), F.col("l_linestatus").alias("code"), (base + F.least(F.lit(12.0), 0.12 * F.col("l_quantity").cast("double"))).alias("priority"))
    return quality.merge_routes(rows, ["owner", "source"])


@query(f"SELECT owner, source, round(priority, 6) AS priority, codes, n, place, place <= 20 AS created FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority DESC, source) AS place FROM ({_MERGED}))")
def route_priority_dedup_cap(spark, sf):
    return quality.cap_routes(_routes(spark, sf), "owner", ["source"], 20).withColumn("priority", F.round("priority", 6))


@query("SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)")
def route_summary_rollup(spark, sf):
    return _t(spark, sf, "lineitem").rollup("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def unassigned_books(spark, sf):
    used = _t(spark, sf, "lineitem").where("l_quantity > 40").select("l_partkey")
    return jobs.unprocessed(_t(spark, sf, "part"), used, "p_partkey", "l_partkey").select("p_partkey")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def exclusive_assignment_violations(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("owners")).where("owners > 1")


@query("""WITH old AS (SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderkey % 3 = 0), keyed AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM old GROUP BY ALL),
new AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)
SELECT * FROM keyed UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM keyed k WHERE k.o_custkey = n.o_custkey AND k.o_orderpriority = n.o_orderpriority)""")
def insert_or_ignore(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    keys = ["o_custkey", "o_orderpriority"]
    old = o.where("o_orderkey % 3 = 0").groupBy(*keys).agg(F.min("o_orderkey").alias("o_orderkey"))
    return jobs.insert_or_ignore(old, o.where("o_orderkey % 3 <> 0"), keys, [F.col("o_orderkey")])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'processing' END AS status, o_orderkey % 4 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS attempts FROM orders")
def retry_transition(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("processing")
    j = _t(spark, sf, "orders").select("o_orderkey", status.alias("status"), (F.col("o_orderkey") % 4).alias("attempts"))
    return jobs.retry(j, "status", "attempts")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100")
def queue_remaining_order(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    o = _t(spark, sf, "orders").where("o_orderstatus <> 'F'").orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), rank, F.desc("o_totalprice"), "o_orderkey")
    return o.limit(100).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""SELECT conv_id, turn, substr(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ' '), 1, 600) AS before,
substr(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' '), 1, 600) AS after FROM conversations""")
def context_window_text(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    cut = lambda c: F.when(F.length(c) > 0, F.substring(c, 1, 600))
    return _t(spark, sf, "conversations").select("conv_id", "turn", cut(text(-2, -1)).alias("before"), cut(text(1, 2)).alias("after"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'tion') AND contains(lower(concat_ws(' ', source, lang, text)), 'src1')")
def chunk_term_filter(spark, sf):
    hay = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    return _t(spark, sf, "documents").where(hay.contains("tion") & hay.contains("src1")).select("doc_id")


@query("SELECT user_id, d, event_id FROM (SELECT user_id, ts::DATE AS d, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY (value > 50) DESC, (event_type = 'click') DESC, ts DESC, event_id DESC) AS n, min(event_type = 'click') OVER p AS all_k, max(event_type = 'click') OVER p AS any_k FROM events WINDOW p AS (PARTITION BY user_id, ts::DATE)) WHERE n = 1 AND any_k AND NOT all_k")
def overlap_winner(spark, sf):
    e = _t(spark, sf, "events").withColumn("d", F.to_date("ts")).withColumn("k", F.col("event_type") == "click")
    p = Window.partitionBy("user_id", "d")
    e = e.withColumn("both", F.bool_or("k").over(p) & ~F.bool_and("k").over(p))
    e = e.withColumn("n", F.row_number().over(p.orderBy(F.desc(F.col("value") > 50), F.desc("k"), F.desc("ts"), F.desc("event_id"))))
    return e.where("both AND n = 1").select("user_id", "d", "event_id")


@query("SELECT source, count(*) AS entries, count(l.doc_id)::BIGINT AS reviewed, count_if(l.quality = 1)::BIGINT AS accepted, count_if(l.toxic = 1)::BIGINT AS flagged, count_if(l.doc_id IS NULL)::BIGINT AS required FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def review_summary(spark, sf):
    j = _t(spark, sf, "documents").select("doc_id", "source").join(_t(spark, sf, "labels").select("doc_id", "quality", "toxic", F.lit(1).alias("seen")), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("entries"), F.count("seen").alias("reviewed"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.count_if(F.col("seen").isNull()).alias("required"))


@query(f"""WITH u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings) SELECT vec_id, prototype FROM (SELECT a.vec_id, p.vec_id AS prototype, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, p.v), 6) DESC, p.vec_id) AS n
FROM u a JOIN u p ON p.vec_id < 8 AND a.vec_id >= 8) WHERE n = 1""")
def intent_nearest_prototype(spark, sf):
    v = _vectors(spark, sf)
    # Eight prototypes, a fixed number.
    s = v.where("id >= 8").join(F.broadcast(v.where("id < 8").select(F.col("id").alias("prototype"), F.col("v").alias("p"))), F.col("id") != F.col("prototype"))
    dot = F.round(F.aggregate(F.zip_with("v", "p", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x), 6)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "prototype")
    return s.withColumn("score", dot).withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("id").alias("vec_id"), "prototype")


@query("SELECT user_id, session, sum(value) AS busy FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY e, event_id)::BIGINT AS session FROM (SELECT *, coalesce((e - lag(e) OVER (PARTITION BY user_id ORDER BY e, event_id) >= 1200)::INT, 0) AS new FROM (SELECT *, floor(epoch(ts))::BIGINT AS e FROM events))) GROUP BY user_id, session HAVING sum(value) >= 60")
def idle_gap_budget(spark, sf):
    s = ledger.sessions(_t(spark, sf, "events"), "user_id", "ts", 1200)
    return s.groupBy("user_id", "session").agg(F.sum("value").alias("busy")).where("busy >= 60")



def query_table() -> dict:
    return {**QUERIES, **structure.ROWS}


def sql_table() -> dict[str, str]:
    return dict(SQL)


#: Importing it registers its queries.
TEXTS = texts.__name__, scalars.SCALARS, jobqueues.NAME, entrybooks.NAME, tablebooks.NAME, scopes.NAME, answering.NAME, judging.NAME, deep.NAME, collections.NAME
