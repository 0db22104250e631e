"""Catalog queries on the transitions of job tables. Each shows the whole table after the change, or the columns that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import jobs
from lodestone.operators import jobtable as j
from lodestone.plans.catalog import _t, query
from lodestone.plans.inputs import CONVERSIONS, VERIFICATIONS, view

_C, _V = f"WITH c AS ({CONVERSIONS})", f"WITH v AS ({VERIFICATIONS})"
_SWEEP = "code = 'FULL_TECHNICAL_VISUAL'"
_NORMAL = "coalesce(code, '') <> 'FULL_TECHNICAL_VISUAL'"


def _c(spark, sf):
    return view(spark, sf, CONVERSIONS)


def _v(spark, sf):
    return view(spark, sf, VERIFICATIONS)


@query(f"""{_C} SELECT id, CASE WHEN status = 'processing' AND coalesce(task_id, '') = '' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' AND coalesce(task_id, '') = '' THEN NULL ELSE error_message END AS error_message FROM c""")
def recover_interrupted_conversions(spark, sf):
    return j.recover_conversions(_c(spark, sf)).select("id", "status", "error_message")


@query(f"""{_V} SELECT id, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' THEN NULL ELSE started_at END AS started_at, CASE WHEN status = 'processing' THEN NULL ELSE next_attempt_at END AS next_attempt_at,
CASE WHEN status = 'processing' THEN 'Interrupted' ELSE error_type END AS error_type, CASE WHEN status = 'processing' THEN 'Recovered after restart' ELSE error_message END AS error_message FROM v""")
def recover_interrupted_verifications(spark, sf):
    return j.recover_verifications(_v(spark, sf)).select("id", "status", "started_at", "next_attempt_at", "error_type", "error_message")


@query(f"""{_V} SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 1 ELSE authorized END AS authorized, CASE WHEN hit THEN 'outage_recovery' ELSE run_mode END AS run_mode, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count, CASE WHEN NOT hit THEN error_type END AS error_type
FROM (SELECT *, coalesce(status = 'failed' AND is_current = 1 AND error_type IN ('ConnectError', 'ConnectTimeout', 'ConnectionError', 'NetworkError'), false) AS hit FROM v)""")
def requeue_endpoint_outages(spark, sf):
    return j.requeue_outages(_v(spark, sf), applied=False).select("id", "status", "authorized", "run_mode", "retry_count", "error_type")


_EVENTS = """SELECT l_orderkey * 10 + l_linenumber AS id, min(CASE WHEN l_suppkey % 6 = 0 THEN 'start' WHEN l_suppkey % 6 = 1 THEN 'complete' WHEN l_suppkey % 6 = 2 THEN 'fail' WHEN l_suppkey % 6 = 3 THEN 'defer' WHEN l_suppkey % 6 = 4 THEN 'retry' END) AS event, min(l_orderkey + 100) AS happened_at, min(CAST(l_linenumber AS DOUBLE) * 2) AS took,
min(CAST(l_linenumber - 3 AS INT)) AS delay, 'E' AS detail, repeat('long ', 500) AS text FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY l_orderkey * 10 + l_linenumber"""


@query(f"""{_V}, e AS ({_EVENTS}), m AS (SELECT v.*, e.event, e.happened_at, e.took, e.delay, CASE WHEN event = 'start' AND status = 'pending' THEN 's' WHEN event = 'complete' AND status = 'processing' THEN 'c' WHEN event = 'fail' AND status = 'processing' THEN 'f' WHEN event = 'defer' AND status = 'processing' THEN 'd' WHEN event = 'retry' AND status = 'processing' THEN 'r' ELSE '-' END AS k FROM v LEFT JOIN e USING (id))
SELECT id, CASE k WHEN 's' THEN 'processing' WHEN 'c' THEN 'completed' WHEN 'f' THEN 'failed' WHEN '-' THEN status ELSE 'pending' END AS status, CASE k WHEN 's' THEN happened_at WHEN 'd' THEN NULL WHEN 'r' THEN NULL ELSE started_at END AS started_at,
CASE WHEN k IN ('c', 'f') THEN happened_at WHEN k = 's' THEN NULL ELSE completed_at END AS completed_at, CASE WHEN k = 'c' THEN took ELSE seconds END AS seconds, attempt_count + (k = 's')::INT AS attempt_count, CASE WHEN k = 'c' THEN 0 WHEN k = 'r' THEN retry_count + 1 ELSE retry_count END AS retry_count,
CASE k WHEN 'd' THEN happened_at + greatest(1, delay) WHEN 'r' THEN happened_at + greatest(0, delay) WHEN '-' THEN next_attempt_at END AS next_attempt_at, CASE WHEN k IN ('c', 'f') THEN 0 ELSE authorized END AS authorized, CASE WHEN k IN ('f', 'd', 'r') THEN 'E' WHEN k = '-' THEN error_type END AS error_type,
length(CASE WHEN k IN ('f', 'd', 'r') THEN substr(repeat('long ', 500), 1, 2000) WHEN k = '-' THEN error_message END) AS message_length FROM m""")
def job_event_marks(spark, sf):
    out = j.apply_events(_v(spark, sf), view(spark, sf, _EVENTS))
    return out.select("id", "status", "started_at", "completed_at", "seconds", "attempt_count", "retry_count", "next_attempt_at", "authorized", "error_type", F.length("error_message").cast("long").alias("message_length"))


@query(f"""{_C} SELECT id, CASE WHEN status <> 'failed' THEN status WHEN again THEN 'processing' ELSE 'pending' END AS status, CASE WHEN status <> 'failed' OR again THEN task_id END AS task_id, CASE WHEN status = 'failed' THEN 7 ELSE submitted_at END AS submitted_at,
CASE WHEN status <> 'failed' THEN seconds END AS seconds, retry_count + (status = 'failed')::INT AS retry_count, CASE WHEN status <> 'failed' THEN error_message END AS error_message FROM (SELECT *, coalesce(task_id, '') <> '' AND NOT coalesce(starts_with(error_message, 'The remote service reported a task failure'), false) AS again FROM c)""")
def retry_or_resume_conversions(spark, sf):
    return j.retry_conversions(_c(spark, sf), F.lit(7)).select("id", "status", "task_id", "submitted_at", "seconds", "retry_count", "error_message")


@query(f"""{_C} SELECT id, CASE WHEN status IN ('completed', 'failed') THEN 'pending' ELSE status END AS status, CASE WHEN status NOT IN ('completed', 'failed') THEN seconds END AS seconds, CASE WHEN status IN ('completed', 'failed') THEN 0 ELSE retry_count END AS retry_count FROM c""")
def rerun_ended_jobs(spark, sf):
    jobs = _c(spark, sf).withColumn("started_at", F.lit(None).cast("long"))
    return j.rerun(jobs, ["completed", "failed"], retry_count=0).select("id", "status", "seconds", "retry_count")


@query(f"""{_C}, m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45), r AS (SELECT c.*, status IN ('failed', 'completed') AND l_orderkey IS NULL AS gone FROM c LEFT JOIN m ON l_orderkey = id)
SELECT id, status AS kept_status, CASE WHEN gone THEN 'deleting' ELSE status END AS reserved_status, NOT gone AS stays FROM r""")
def terminal_deletion(spark, sf):
    managed = _t(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    held = j.reserve_deletion(_c(spark, sf), managed, "l_orderkey")
    back = j.cancel_deletion(held.withColumn("reserved_status", F.col("status")))
    left = j.delete(held).select("id", F.lit(True).alias("stays"))
    return back.join(left, "id", "left").select("id", F.col("status").alias("kept_status"), "reserved_status", F.coalesce("stays", F.lit(False)).alias("stays"))


_FILES = """SELECT o_orderkey AS file_id, concat('book', CAST(o_custkey + o_orderkey % 2 AS STRING), '.pdf') AS filename, CASE WHEN o_orderkey % 4 = 0 THEN concat('h', CAST((o_orderkey + o_orderkey % 3) % 90 AS STRING), 'abcdefghij') WHEN o_orderkey % 4 = 1 THEN '' END AS sha256,
CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 13 END AS size, o_orderkey % 5 AS mtime FROM orders"""


@query(f"""{_C}, f AS ({_FILES}) SELECT file_id, CASE WHEN coalesce(sha256, '') <> '' THEN EXISTS (SELECT 1 FROM c WHERE c.filename = f.filename AND c.sha256 = f.sha256)
WHEN size IS NOT NULL AND mtime IS NOT NULL THEN EXISTS (SELECT 1 FROM c WHERE c.filename = f.filename AND c.size = f.size AND c.mtime = f.mtime) ELSE EXISTS (SELECT 1 FROM c WHERE c.filename = f.filename) END AS tracked FROM f""")
def tracked_files(spark, sf):
    return j.tracked(view(spark, sf, _FILES), _c(spark, sf)).select("file_id", "tracked")


_KNOWN = "SELECT concat('book', CAST(c_custkey AS STRING), '.pdf') AS filename, c_custkey AS size, c_custkey * 2 AS mtime, concat('sha', CAST(c_custkey AS STRING)) AS sha256 FROM customer"


@query(f"""{_C}, k AS ({_KNOWN}), n AS (SELECT filename, max(id) AS id FROM c WHERE size IS NULL AND mtime IS NULL AND sha256 IS NULL GROUP BY filename)
SELECT c.id, CASE WHEN n.id IS NULL OR k.filename IS NULL THEN c.sha256 ELSE k.sha256 END AS sha256, CASE WHEN n.id IS NULL OR k.filename IS NULL THEN c.size ELSE k.size END AS size FROM c LEFT JOIN n ON n.id = c.id LEFT JOIN k ON k.filename = n.filename""")
def backfill_file_identity(spark, sf):
    return j.backfill_identity(_c(spark, sf), view(spark, sf, _KNOWN)).select("id", "sha256", "size")


_OUTPUTS = "SELECT concat('out', CAST(p_partkey AS STRING), '.zip') AS filename, p_partkey % 13 AS size, p_partkey % 5 AS mtime FROM part UNION ALL SELECT concat('book', CAST(c_custkey AS STRING), '.pdf') AS filename, c_custkey % 13 AS size, c_custkey % 5 AS mtime FROM customer"


@query(f"""{_C}, o AS ({_OUTPUTS}) SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE kind <> 'converted_folder' AND output_filename = o.filename) AND NOT EXISTS (SELECT 1 FROM c WHERE kind = 'converted_folder' AND c.filename = o.filename AND c.size = o.size AND c.mtime = o.mtime)""")
def register_converted_outputs(spark, sf):
    return j.register_outputs(_c(spark, sf), view(spark, sf, _OUTPUTS))


_WAITS = "is_current = 1 AND status = 'pending'"


@query(f"""{_V}, b AS (SELECT DISTINCT book FROM v WHERE {_WAITS} AND {_NORMAL} AND target = 'text_lane') SELECT id, CASE WHEN {_WAITS} AND {_NORMAL} AND target = 'text_lane' THEN 1 WHEN {_WAITS} AND {_SWEEP} AND book IN (FROM b) THEN 0 ELSE authorized END AS authorized,
CASE WHEN {_WAITS} AND {_NORMAL} AND target = 'text_lane' THEN 'manual' WHEN {_WAITS} AND {_SWEEP} AND book IN (FROM b) THEN 'awaiting_normal' ELSE run_mode END AS run_mode FROM v""")
def start_manual_batch(spark, sf):
    return j.start_batch(_v(spark, sf), target="text_lane").select("id", "authorized", "run_mode")


@query(f"""{_V}, b AS (SELECT DISTINCT book FROM v WHERE {_WAITS} AND {_NORMAL} AND book IN (1, 2, 3)) SELECT id, CASE WHEN {_WAITS} AND {_NORMAL} AND book IN (1, 2, 3) THEN 1 WHEN {_WAITS} AND {_SWEEP} AND book IN (FROM b) THEN 0 ELSE authorized END AS authorized,
CASE WHEN {_WAITS} AND {_NORMAL} AND book IN (1, 2, 3) THEN NULL WHEN {_WAITS} AND {_SWEEP} AND book IN (FROM b) THEN NULL ELSE next_attempt_at END AS next_attempt_at FROM v""")
def start_manual_books(spark, sf):
    return j.start_batch(_v(spark, sf), books=[1, 2, 3]).select("id", "authorized", "next_attempt_at")


@query(f"""{_V}, a AS (SELECT id, book, code, status, is_current, next_attempt_at, CASE WHEN hit THEN 0 ELSE authorized END AS authorized, CASE WHEN hit THEN 'awaiting_normal' ELSE run_mode END AS run_mode FROM (SELECT *, coalesce({_SWEEP}, false) AND {_WAITS} AND target = 'picture_lane' AS hit FROM v))
SELECT id, CASE WHEN ok THEN 1 ELSE authorized END AS authorized, CASE WHEN ok THEN 'artifact_ready' ELSE run_mode END AS run_mode FROM (SELECT *, coalesce({_SWEEP} AND {_WAITS} AND authorized = 0 AND run_mode = 'awaiting_normal' AND NOT EXISTS (SELECT 1 FROM v n WHERE n.book = a.book AND n.is_current = 1 AND coalesce(n.code, '') <> 'FULL_TECHNICAL_VISUAL' AND n.status <> 'completed'), false) AS ok FROM a)""")
def arm_and_release_sweeps(spark, sf):
    return j.release_sweeps(j.arm_sweeps(_v(spark, sf), "picture_lane")).select("id", "authorized", "run_mode")


@query(f"{_V} SELECT id, CASE WHEN hit THEN 0 ELSE authorized END AS authorized, CASE WHEN NOT hit THEN run_mode END AS run_mode FROM (SELECT *, target = 'text_lane' AND {_WAITS} AND authorized = 1 AS hit FROM v)")
def clear_manual_authorizations(spark, sf):
    return j.clear_authorizations(_v(spark, sf), "text_lane").select("id", "authorized", "run_mode")


@query(f"{_V} SELECT id, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN 1 ELSE authorized END AS authorized, CASE WHEN hit THEN 'manual' ELSE run_mode END AS run_mode FROM (SELECT *, status = 'failed' AND is_current = 1 AS hit FROM v)")
def retry_failed_rows(spark, sf):
    return j.retry_failed(_v(spark, sf), sweeps=False).select("id", "status", "authorized", "run_mode")


@query(f"{_V} SELECT target, count(*) AS armed FROM v WHERE status = 'failed' AND is_current = 1 AND {_SWEEP} GROUP BY target")
def retry_failed_sweeps(spark, sf):
    """How many sweeps of each target a retry arms again."""
    before = _v(spark, sf)
    after = j.retry_failed(before.withColumn("was", F.col("status")), sweeps=True)
    return after.where("was = 'failed' AND status = 'pending' AND run_mode = 'awaiting_normal' AND authorized = 0").groupBy("target").agg(F.count("*").alias("armed"))


_ROUTES = """SELECT l_suppkey AS book, 'g1' AS generation, CASE WHEN l_partkey % 17 = 0 THEN '' ELSE concat('R', CAST(l_partkey % 450 AS STRING)) END AS route_id, CASE WHEN l_partkey % 7 = 0 THEN 'none' WHEN l_partkey % 2 = 0 THEN 'text_lane' ELSE 'picture_lane' END AS target, concat('N', CAST(l_linenumber AS STRING)) AS code, 'low' AS priority,
CAST(l_linenumber AS INT) AS priority_score, l_orderkey * 10 + l_linenumber AS came_at FROM lineitem WHERE l_suppkey % 3 = 0"""


@query(f"""{_V}, r AS (SELECT *, row_number() OVER (PARTITION BY book, generation, route_id, target ORDER BY came_at DESC, code DESC, priority_score DESC) AS n FROM ({_ROUTES}) WHERE target IN ('text_lane', 'picture_lane') AND route_id <> ''), s AS (SELECT * FROM r WHERE n = 1)
SELECT v.book, v.generation, v.route_id, v.target, v.id, CASE WHEN s.book IS NOT NULL THEN s.code ELSE v.code END AS code, CASE WHEN s.book IS NOT NULL THEN 1 WHEN v.generation <> 'g1' AND v.book IN (SELECT book FROM s) THEN 0 ELSE v.is_current END AS is_current, v.status FROM v LEFT JOIN s USING (book, generation, route_id, target)
UNION ALL SELECT book, generation, route_id, target, NULL, code, 1, 'pending' FROM s WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.book = s.book AND v.generation = s.generation AND v.route_id = s.route_id AND v.target = s.target)""")
def sync_verification_routes(spark, sf):
    return j.sync_routes(_v(spark, sf), view(spark, sf, _ROUTES), ["text_lane", "picture_lane"]).select("book", "generation", "route_id", "target", "id", "code", "is_current", "status")


_PICTURES = "SELECT ps.l_suppkey AS book, ps.l_partkey % 90 AS index, CASE WHEN ps.l_partkey % 4 = 0 THEN 'Electrical_Schematic' WHEN ps.l_partkey % 4 = 1 THEN 'logo' ELSE 'pid' END AS class FROM lineitem ps WHERE ps.l_orderkey % 10 = 0"


@query(f"""{_V}, p AS (SELECT DISTINCT book, index FROM ({_PICTURES}) WHERE class <> 'logo') SELECT id, CASE WHEN hit THEN 0 ELSE is_current END AS is_current, CASE WHEN hit THEN 0 ELSE authorized END AS authorized FROM (SELECT v.*, coalesce({_SWEEP} AND is_current = 1 AND EXISTS (SELECT 1 FROM p WHERE p.book = v.book AND p.index = TRY_CAST(json_extract_string(source_json, '$.index') AS INT)), false) AS hit FROM v)""")
def suppress_overlapping_sweeps(spark, sf):
    return j.suppress_sweeps(_v(spark, sf), view(spark, sf, _PICTURES).where("class <> 'logo'")).select("id", "is_current", "authorized")


@query(f"""{_V}, p AS (SELECT DISTINCT book, index, class FROM ({_PICTURES})), n AS (SELECT DISTINCT book, TRY_CAST(json_extract_string(source_json, '$.index') AS INT) AS index FROM v WHERE is_current = 1 AND {_NORMAL})
SELECT book, index, class FROM p WHERE lower(class) IN ('electrical_schematic', 'pid') AND NOT EXISTS (SELECT 1 FROM n WHERE n.book = p.book AND n.index = p.index)""")
def artifact_sweep_plan(spark, sf):
    return j.sweep_plan(view(spark, sf, _PICTURES).distinct(), _v(spark, sf), ["electrical_schematic", "pid"])


_STATES = ["pending", "processing", "completed", "failed"]
_LANE = f"CASE WHEN {_SWEEP} THEN coalesce(claimed_by, target) ELSE target END"
_LANES = [f"count_if({'target' if s == 'pending' else _LANE} = '{t}' AND status = '{s}')::BIGINT AS {t}_{s}" for t in ("text_lane", "picture_lane") for s in _STATES]
_KINDS = {"text": f"{_NORMAL} AND target = 'text_lane'", "vision": f"{_NORMAL} AND target = 'picture_lane'", "artifact": _SWEEP}
_LANES += [f"count_if(({k}) AND status = '{s}')::BIGINT AS {n}_{s}" for n, k in _KINDS.items() for s in _STATES] + [f"count_if({k})::BIGINT AS {n}_total" for n, k in _KINDS.items()]


@query(f"{_V} SELECT book, {', '.join(_LANES)}, count(*) AS total FROM v WHERE is_current = 1 GROUP BY book")
def book_lane_counts(spark, sf):
    return j.lane_counts(_v(spark, sf), ["text_lane", "picture_lane"], _STATES)


@query(f"{_V} SELECT target, {', '.join(f'''count_if(status = '{s}')::BIGINT AS {s}''' for s in _STATES)}, count(*) AS total, count_if(status = 'pending' AND authorized = 0)::BIGINT AS waiting_manual, count_if(status = 'pending' AND next_attempt_at > 2000)::BIGINT AS backoff FROM v WHERE is_current = 1 GROUP BY target")
def target_status_counts(spark, sf):
    return j.target_counts(_v(spark, sf), _STATES, 2_000)


@query(f"{_V} SELECT id, target, coalesce(retry_count, 0) AS retry_count, coalesce(priority, 'medium') AS priority, NULL::STRING AS lane, 0 AS rerun_count FROM v")
def migrate_job_table(spark, sf):
    old = _v(spark, sf).select("id", "target", "retry_count", "priority")
    return j.migrated(old, {"retry_count": ("int", 0), "priority": ("string", "medium"), "lane": ("string", None), "rerun_count": ("int", 0)})


@query(f"{_V} SELECT book, generation, route_id, target, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 1")
def unique_key_violations(spark, sf):
    return j.violations(_v(spark, sf), ["book", "generation", "route_id", "target"])


@query(f"{_C} SELECT id, n > 1 AS has_earlier, regexp_replace(filename, '\\.[^.]*$', '') || CASE WHEN n > 1 THEN '__' || substr(sha256, 1, 8) ELSE '' END || '.zip' AS output_name FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY id) AS n FROM c)")
def reserve_output_names(spark, sf):
    return j.output_names(_c(spark, sf)).select("id", "has_earlier", "output_name")


@query(f"""{_C}, f AS (SELECT filename, sha256, min(submitted_at * 1000000 + id) AS first FROM c WHERE sha256 IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY first) - 1 AS n FROM f)
SELECT c.id, CASE WHEN n = 0 THEN filename ELSE regexp_replace(filename, '\\.[^.]*$', '') || ' (' || n || ')' || regexp_extract(filename, '\\.[^.]*$') END AS stored_as FROM c JOIN n USING (filename, sha256)""")
def upload_destinations(spark, sf):
    return j.free_names(_c(spark, sf).where("sha256 IS NOT NULL").withColumn("at", F.col("submitted_at"))).select("id", "stored_as")


_FORMATS = """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '["md", "json", "md", ""]' WHEN o_orderkey % 4 = 1 THEN 'broken [' WHEN o_orderkey % 4 = 2 THEN '[]' END AS raw, CASE WHEN o_orderkey % 3 = 0 THEN 'html' WHEN o_orderkey % 3 = 1 THEN '' END AS legacy,
CASE WHEN o_orderkey % 2 = 0 THEN 'a/doc.MD,b.json,img/x.png,c.md' ELSE 'only.txt,noext' END AS members FROM orders"""


@query(f"""SELECT o_orderkey, array_to_string(asked, ',') AS asked, returned, array_to_string(list_filter(asked, lambda x: NOT list_contains(string_split(returned, ','), x)), ',') AS missing FROM (SELECT o_orderkey, CASE WHEN raw LIKE '["md"%' THEN ['md', 'json'] WHEN coalesce(legacy, '') <> '' THEN [legacy] ELSE ['md'] END AS asked,
CASE WHEN o_orderkey % 2 = 0 THEN 'md,json' ELSE 'text' END AS returned FROM ({_FORMATS}))""")
def job_formats(spark, sf):
    f = view(spark, sf, _FORMATS)
    f = f.withColumn("asked", j.formats_of(F.col("raw"), F.col("legacy"), {})).withColumn("back", j.returned_formats(F.split("members", ","), {".md": "md", ".json": "json", ".txt": "text"}))
    return f.select("o_orderkey", F.array_join("asked", ",").alias("asked"), F.array_join("back", ",").alias("returned"), F.array_join(F.array_except("asked", "back"), ",").alias("missing"))


@query("SELECT l_orderkey, l_linenumber, (s >= 500 OR s IN (408, 429) OR coalesce(k IN ('ConnectError', 'NetworkError'), false)) AS again FROM (SELECT *, [200, 404, 408, 429, 500, 503, 400][l_linenumber::INT] AS s, CASE WHEN l_suppkey % 3 = 0 THEN 'ConnectError' WHEN l_suppkey % 3 = 1 THEN 'ValueError' END AS k FROM lineitem)")
def retryable_endpoint_failure(spark, sf):
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 408, 429, 500, 503, 400)]), F.col("l_linenumber").cast("int"))
    kind = F.when(F.col("l_suppkey") % 3 == 0, "ConnectError").when(F.col("l_suppkey") % 3 == 1, "ValueError")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", j.retryable(status, kind).alias("again"))


@query(f"{_V} SELECT book, count(*) AS n FROM v WHERE is_current = 1 AND NOT (coalesce({_SWEEP}, false) AND status = 'pending' AND coalesce(run_mode, '') = '') GROUP BY book HAVING bool_and(status = 'completed')")
def finished_books(spark, sf):
    return j.finished(_v(spark, sf))


@query(f"""{_C} SELECT id, row_number() OVER (ORDER BY coalesce(completed_at, submitted_at) DESC, id DESC) AS newest, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY status ORDER BY size IS NULL, size, submitted_at, filename, id) END AS next_pending,
status = 'processing' AND coalesce(task_id, '') <> '' AS resumable, kind <> 'converted_folder' AND status = 'failed' AS shown_failure FROM c""")
def job_listings(spark, sf):
    rows = _c(spark, sf).select("id", F.coalesce("completed_at", "submitted_at").alias("at"), "status", "size", "submitted_at", "filename", ((F.col("status") == "processing") & (F.coalesce("task_id", F.lit("")) != "")).alias("resumable"), ((F.col("kind") != "converted_folder") & (F.col("status") == "failed")).alias("shown_failure"))
    listed = jobs.numbered(rows, [F.desc("at"), F.desc("id")], "newest")
    waiting = jobs.numbered(listed.where("status = 'pending'"), [F.col("size").asc_nulls_last(), "submitted_at", "filename", "id"], "next_pending")
    rest = listed.where("status IS DISTINCT FROM 'pending'").withColumn("next_pending", F.lit(None).cast("long"))
    return waiting.unionByName(rest).select("id", "newest", "next_pending", "resumable", "shown_failure")


#: Importing it registers its queries.
NAME = __name__
