"""Catalog queries on machines and manuals, quota, boxes, and evaluation by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import geometry as g
from lodestone.operators import registry as r
from lodestone.operators import usage
from lodestone.plans.catalog import _t, query
from lodestone.plans.inputs import view

_MANUALS = """SELECT s_nationkey AS machine, s_suppkey AS book, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'Parts' WHEN s_suppkey % 5 = 2 THEN 'operation' ELSE 'electrical' END AS type, CASE WHEN s_suppkey % 4 = 0 THEN 'historical' WHEN s_suppkey % 4 = 1 THEN 'draft' WHEN s_suppkey % 4 = 2 THEN 'authoritative' END AS authority,
CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey - 1 END AS supersedes FROM supplier WHERE s_suppkey % 9 > 0"""
_BOOKS = "SELECT s_suppkey AS book, concat('book', CAST(s_suppkey AS STRING)) AS name, s_suppkey % 7 > 0 AS ready, s_suppkey % 3 > 0 AS hybrid, s_suppkey AS seen_at FROM supplier WHERE s_suppkey % 10 > 0 UNION ALL SELECT s_suppkey AS book, 'older' AS name, false AS ready, false AS hybrid, s_suppkey - 1000 AS seen_at FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT 0 AS book, 'none' AS name, true AS ready, true AS hybrid, 0 AS seen_at FROM region"
_R = f"WITH m AS ({_MANUALS}), b0 AS ({_BOOKS}), b AS (SELECT * FROM b0 WHERE book > 0 QUALIFY row_number() OVER (PARTITION BY book ORDER BY seen_at DESC) = 1), a AS (SELECT m.machine, m.book, coalesce(authority, 'authoritative') = 'authoritative' AS active, ready, hybrid FROM m JOIN b USING (book))"


def _registry(spark, sf):
    m = view(spark, sf, _MANUALS)
    held = m.groupBy("machine").agg(F.array_sort(F.collect_list(F.struct("book", "type", "authority", "supersedes"))).alias("manuals"))
    return _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("machine"), F.col("n_name").alias("name")).join(held.withColumn("machine", F.col("machine").cast("long")), "machine")


def _books(spark, sf):
    return r.books_by_id(view(spark, sf, _BOOKS))


@query(f"{_R} SELECT x.machine::BIGINT AS machine, count(a.book)::BIGINT AS manuals, count_if(active)::BIGINT AS active, count_if(active AND ready)::BIGINT AS ready, count_if(active AND hybrid)::BIGINT AS hybrid, count_if(active) > 0 AND count_if(active AND NOT ready) = 0 AS searchable, count_if(active) > 0 AND count_if(active AND NOT hybrid) = 0 AS hybrid_ready FROM (SELECT DISTINCT machine FROM m) x LEFT JOIN a ON a.machine = x.machine GROUP BY x.machine")
def machine_catalog(spark, sf):
    return r.catalog(_registry(spark, sf), _books(spark, sf))


@query(f"{_R} SELECT book, name FROM b WHERE book NOT IN (SELECT book FROM a)")
def unassigned_manuals(spark, sf):
    return r.unassigned(_registry(spark, sf), _books(spark, sf)).select("book", "name")


@query(f"{_R} SELECT book, ready FROM b WHERE book IN (SELECT book FROM a WHERE active AND machine = 3)")
def machine_scope(spark, sf):
    return r.scope(_registry(spark, sf), _books(spark, sf), F.lit(3)).select("book", "ready")


_NEW = "SELECT s_nationkey + 1 AS machine, s_suppkey AS book, CASE WHEN s_suppkey % 8 = 0 THEN 'poster' ELSE 'parts' END AS type, CASE WHEN s_suppkey % 5 = 0 THEN 'secret' WHEN s_suppkey % 5 = 1 THEN 'draft' END AS authority, CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey WHEN s_suppkey % 6 = 1 THEN s_suppkey + 900 END AS supersedes FROM supplier WHERE s_suppkey % 2 = 0"


@query(f"""{_R}, n AS ({_NEW}), o AS (SELECT DISTINCT machine, book FROM m), p AS (SELECT machine, CASE WHEN b.book IS NULL THEN 'UNKNOWN_BOOK' END AS problem FROM n LEFT JOIN b USING (book) UNION SELECT machine, CASE WHEN type = 'poster' THEN 'UNKNOWN_TYPE' END FROM n UNION SELECT machine, CASE WHEN authority = 'secret' THEN 'UNKNOWN_AUTHORITY' END FROM n
UNION SELECT machine, CASE WHEN supersedes = book OR NOT EXISTS (SELECT 1 FROM n k WHERE k.machine = n.machine AND k.book = n.supersedes) THEN 'SUPERSEDES_OUTSIDE' END FROM n WHERE supersedes IS NOT NULL UNION SELECT n.machine, 'BOOK_OF_ANOTHER_MACHINE' FROM n JOIN o ON o.book = n.book AND o.machine <> n.machine
UNION SELECT machine, 'NAME_MISSING' FROM n WHERE machine % 4 = 0 UNION SELECT machine, 'NO_AUTHORITATIVE_MANUAL' FROM n GROUP BY machine HAVING count_if(authority IS NULL) = 0) SELECT machine::BIGINT AS machine, problem FROM p WHERE problem IS NOT NULL""")
def machine_upsert_problems(spark, sf):
    n = view(spark, sf, _NEW).groupBy("machine").agg(F.array_sort(F.collect_list(F.struct("book", "type", "authority", "supersedes"))).alias("manuals"))
    n = n.withColumn("machine", F.col("machine").cast("long")).withColumn("name", F.when(F.col("machine") % 4 == 0, " ").otherwise("m"))
    return r.problems(n, _registry(spark, sf), _books(spark, sf))


@query(f"{_R} SELECT m.machine::BIGINT AS machine, string_agg(m.book || ':' || coalesce(CASE WHEN supersedes <> 5 THEN supersedes END, 0), ',' ORDER BY m.book) AS manuals FROM m WHERE m.book <> 5 GROUP BY m.machine")
def machine_without_manual(spark, sf):
    kept = r.without_book(_registry(spark, sf), F.lit(5))
    return kept.select("machine", F.array_join(F.transform("manuals", lambda m: F.concat_ws(":", m["book"], F.coalesce(m["supersedes"], F.lit(0)))), ",").alias("manuals"))


_CASES = "SELECT p_partkey % 60 AS case, p_partkey % 97 AS book FROM part WHERE p_partkey % 97 > 0"


@query(f"{_R}, c AS ({_CASES.replace(' AS case', ' AS kase')}) SELECT kase AS \"case\", min(machine)::BIGINT AS machine FROM c JOIN m USING (book) GROUP BY kase HAVING count(DISTINCT machine) = 1")
def case_owners(spark, sf):
    return r.single_owner(view(spark, sf, _CASES.replace(" AS case", " AS `case`")), _registry(spark, sf))


@query("SELECT doc_id, sha256(concat_ws(chr(0), 'bge', 'doc: ', coalesce(source, ''), coalesce(text, ''))) AS key, CASE WHEN doc_id % 5 = 0 THEN 'missing_source' WHEN doc_id % 3 = 0 THEN 'not_built' WHEN doc_id % 4 = 0 OR doc_id % 7 = 0 THEN 'stale' ELSE 'ready' END AS status FROM documents")
def embedding_keys(spark, sf):
    k = F.col("doc_id")
    status = r.index_status(F.lit(10), F.when(k % 3 == 0, None).when(k % 4 == 0, 9).otherwise(10), F.lit("a"), F.when(k % 7 == 0, "b").otherwise("a"), k % 5 != 0)
    return _t(spark, sf, "documents").select("doc_id", r.row_key(F.lit("bge"), F.lit("doc: "), F.col("source"), F.col("text")).alias("key"), status.alias("status"))


@query("WITH old AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) SELECT doc_id, key IN (FROM old) AS reused FROM (SELECT doc_id, md5(text) AS key FROM documents WHERE text IS NOT NULL)")
def reuse_embeddings(spark, sf):
    d = _t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5("text").alias("key"))
    kept, new = r.reuse(d, d.where("doc_id % 2 = 0").select("key").distinct())
    return kept.select("doc_id", F.lit(True).alias("reused")).unionByName(new.select("doc_id", F.lit(False).alias("reused")))


_CALLS = "SELECT event_id AS id, user_id % 20 AS key, floor(epoch(ts))::BIGINT AS at, floor(epoch(ts))::BIGINT + 30 + event_id % 4000 AS ended, (event_id % 900)::BIGINT AS tokens FROM events"


def _calls(spark, sf):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return _t(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("key"), at.alias("at"), (at + 30 + F.col("event_id") % 4000).alias("ended"), (F.col("event_id") % 900).cast("long").alias("tokens"))


_HELD = f"""c AS ({_CALLS}), h AS (SELECT a.id, a.key, a.tokens, count_if(b.ended <= a.at AND b.ended + 86400 > a.at)::BIGINT AS used_requests, coalesce(sum(b.tokens) FILTER (WHERE b.ended <= a.at AND b.ended + 86400 > a.at), 0)::BIGINT AS used_tokens,
count_if((b.at < a.at OR (b.at = a.at AND b.id < a.id)) AND b.ended > a.at)::BIGINT AS reserved_requests, coalesce(sum(b.tokens) FILTER (WHERE (b.at < a.at OR (b.at = a.at AND b.id < a.id)) AND b.ended > a.at), 0)::BIGINT AS reserved_tokens FROM c a LEFT JOIN c b ON a.key = b.key AND b.at <= a.at AND b.ended + 86400 > a.at GROUP BY ALL)"""


@query(f"WITH {_HELD} SELECT id, used_requests, used_tokens, reserved_requests, reserved_tokens FROM h")
def quota_reservations(spark, sf):
    return usage.with_reservations(_calls(spark, sf)).select("id", "used_requests", "used_tokens", "reserved_requests", "reserved_tokens")


@query(f"""WITH {_HELD}, q AS (SELECT id, tokens, used_requests + reserved_requests AS n, used_tokens + reserved_tokens AS t FROM h)
SELECT id, CASE WHEN n + 1 > 18 OR t + tokens > 9000 THEN 'paused' WHEN n >= 16 OR t >= 8000 THEN 'warning' ELSE 'ok' END AS state, concat_ws(',', CASE WHEN n + 1 > 18 THEN 'LOCAL_DAILY_REQUEST_RESERVE' END, CASE WHEN t + tokens > 9000 THEN 'LOCAL_DAILY_TOKEN_RESERVE' END) AS reasons FROM q""")
def quota_gate(spark, sf):
    held = usage.gate(usage.with_reservations(_calls(spark, sf)), usage.limits(20, 10_000))
    return held.select("id", "state", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH h AS (SELECT event_id, event_id * 10.0::DOUBLE AS t0, CASE WHEN event_id % 3 = 0 THEN 429 ELSE 200 END AS s, CASE WHEN event_id % 4 = 0 THEN 7.0::DOUBLE END AS ra, CASE WHEN event_id % 5 = 0 THEN 90.0::DOUBLE END AS rt, CASE WHEN event_id % 6 < 3 THEN 300.0::DOUBLE END AS rr, CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 150 WHEN 2 THEN 99 END AS rem FROM events),
p AS (SELECT *, CASE WHEN s = 429 THEN t0 + greatest(1.0, coalesce(ra, rt, 60.0)) END AS pause, CASE WHEN rem <= 100 THEN t0 + rr END AS low FROM h) SELECT event_id, rem AS remaining, pause AS pause_until, least(pause, low) AS resume_at FROM p""")
def quota_after_response(spark, sf):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, " 12 ").when(k % 4 == 1, "150.0").when(k % 4 == 2, "99.9").otherwise("many")
    e = _t(spark, sf, "events").select("event_id", usage.header_int(raw).alias("remaining"))
    after = usage.after_response(k * F.lit(10.0), F.when(k % 3 == 0, 429).otherwise(200), F.when(k % 4 == 0, 7.0), F.when(k % 5 == 0, 90.0), F.when(k % 6 < 3, 300.0), F.col("remaining"), F.lit(1_000))
    return e.select("event_id", "remaining", after.alias("a")).select("event_id", "remaining", "a.pause_until", "a.resume_at")


@query("""SELECT event_type AS model, count(*) AS calls, round(sum(CASE event_type WHEN 'click' THEN (event_id % 500 * 0.5::DOUBLE + event_id % 70 * 1.5::DOUBLE) / 1000000 WHEN 'view' THEN (event_id % 500 * 0.1::DOUBLE + event_id % 70 * 0.2::DOUBLE) / 1000000 END), 6) AS cost FROM events GROUP BY event_type""")
def usage_cost_by_model(spark, sf):
    k = F.col("event_id")
    e = _t(spark, sf, "events").select("event_type", usage.cost(F.col("event_type"), k % 500, k % 70, {"click": (0.5, 1.5), "view": (0.1, 0.2)}).alias("cost"))
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) <= 120")
def bounded_usage_log(spark, sf):
    log = _t(spark, sf, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("key"), F.col("ts").alias("at"))
    return usage.newest(log, "key", 120).select(F.col("id").alias("event_id"))


_BOX = """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l, CAST(l_quantity AS DOUBLE) + l_partkey % 90 AS r, CAST(l_suppkey % 80 AS DOUBLE) AS t, CAST(l_suppkey % 80 + l_linenumber % 4 AS DOUBLE) AS b, CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 3 = 1 THEN 'TOPLEFT' ELSE 'bottomleft' END AS origin, CAST(l_partkey % 70 AS DOUBLE) AS above, CAST(l_suppkey % 95 AS DOUBLE) AS below FROM lineitem"""
_FLIP = "CASE WHEN upper(coalesce(origin, 'BOTTOMLEFT')) = 'BOTTOMLEFT' THEN 100.0::DOUBLE - {c} ELSE {c} END"
_BOXED = f"w AS ({_BOX}), x AS (SELECT *, least(l, r) AS x0, greatest(l, r) AS x1, least({_FLIP.format(c='t')}, {_FLIP.format(c='b')}) AS y0, greatest({_FLIP.format(c='t')}, {_FLIP.format(c='b')}) AS y1 FROM w), k AS (SELECT *, x1 - x0 > 0.5 AND y1 - y0 > 0.5 AS ok FROM x)"


def _boxes(spark, sf):
    c = F.col
    w = view(spark, sf, _BOX).withColumn("k", g.from_corners(c("l"), c("t"), c("r"), c("b"), c("origin"), F.lit(100.0)))
    top = g.box(F.lit(5.0), F.lit(0.0), F.lit(60.0), c("above"))
    low = g.box(F.lit(10.0), c("below"), F.lit(80.0), F.lit(100.0))
    return w.withColumns({"top": top, "low": low, "page": g.box(F.lit(0.0), F.lit(0.0), F.lit(120.0), F.lit(100.0))})


@query(f"WITH {_BOXED} SELECT l_orderkey, l_linenumber, count(*) AS n, min(CASE WHEN ok THEN x0 END) AS x0, min(CASE WHEN ok THEN y0 END) AS y0, max(CASE WHEN ok THEN x1 END) AS x1, max(CASE WHEN ok THEN y1 END) AS y1, count_if(ok AND x0 >= 7 AND y0 >= -3 AND x1 <= 93 AND y1 <= 53)::BIGINT AS inside FROM k GROUP BY ALL")
def union_boxes(spark, sf):
    inside = g.contains(g.box(F.lit(10.0), F.lit(0.0), F.lit(90.0), F.lit(50.0)), F.col("k"))
    b = _boxes(spark, sf).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), g.union(F.collect_list("k")).alias("u"), F.count_if(inside).alias("inside"))
    return b.select("l_orderkey", "l_linenumber", "n", "u.*", "inside")


@query(f"""WITH {_BOXED}, d AS (SELECT *, greatest(4.0::DOUBLE, least(12.0::DOUBLE, (x1 - x0) * 0.35::DOUBLE)) AS dx, least(20.0::DOUBLE, greatest(3.0::DOUBLE, (y1 - y0) * 1.5::DOUBLE)) AS dy FROM k WHERE ok),
e AS (SELECT *, CASE WHEN above <= y0 THEN greatest(y0 - dy, (above + y0) / 2) ELSE y0 - dy END AS u, CASE WHEN below >= y1 THEN least(y1 + dy, (y1 + below) / 2) ELSE y1 + dy END AS v FROM d)
SELECT l_orderkey, l_linenumber, round(sum(least(greatest(x0 - dx, 0), x0)), 4) AS x0, round(sum(greatest(least(greatest(u, 0), y0), 0)), 4) AS y0, round(sum(least(greatest(least(x1 + dx, 120), x1), 120)), 4) AS x1, round(sum(least(greatest(least(v, 100), y1), 100)), 4) AS y1 FROM e GROUP BY ALL""")
def crop_boxes(spark, sf):
    c = _boxes(spark, sf).where("k IS NOT NULL").withColumn("c", g.crop(F.col("page"), F.col("k"), F.col("top"), F.col("low"), 4.0, 3.0, 0.2))
    return c.groupBy("l_orderkey", "l_linenumber").agg(*[F.round(F.sum(f"c.{s}"), 4).alias(s) for s in ("x0", "y0", "x1", "y1")])


@query(f"""WITH {_BOXED} SELECT l_orderkey, l_linenumber, count(*) AS n, count_if(below - above > 3 AND below - above <= 35 AND below - above - 2 > 1)::BIGINT AS gaps, min(CASE WHEN below - above > 3 AND below - above <= 35 AND below - above - 2 > 1 THEN above + 1 END) AS first_y0 FROM k GROUP BY ALL""")
def gap_boxes(spark, sf):
    b = _boxes(spark, sf).withColumn("gap", g.gap(F.col("page"), F.col("top"), F.col("low"), 2.0))
    return b.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count("gap").alias("gaps"), F.min("gap.y0").alias("first_y0"))


@query("SELECT doc_id, greatest(512, least(1024, length(coalesce(text, '')) // 2 + 256))::INTEGER AS budget FROM documents")
def transcription_budgets(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", g.transcription_budget(F.col("text")).alias("budget"))


#: Importing it registers its queries.
NAME = __name__
