"""Catalog queries on verdicts of models, oversized chunks, staleness and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import answers
from lodestone.operators import chunking, freshness, upkeep, verdicts
from lodestone.plans.catalog import _t, query
from lodestone.plans.inputs import view

#: A text on one line, cut to ``n`` characters.
_LINE = "substr(trim(replace(coalesce(text, ''), chr(10), ' ')), 1, {n})"
#: A text as evidence is compared: without quotes and case, single blanks, none before punctuation.
_ET = "regexp_replace(trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '[\"''`“”‘’«»]', '', 'g')), '\\s+', ' ', 'g')), ' +([,.;:!?%)\\]])', '\\1', 'g')"
_SAID = f"""SELECT id, said, reason, sure, CASE WHEN length(suspect) % 5 = 0 THEN other WHEN length(suspect) % 7 = 0 THEN '' WHEN length(suspect) % 3 = 0 THEN concat('“', substr(suspect, 4, 25), '” .') ELSE substr(suspect, 7, 12) END AS evidence, suspect, sound, dominant, garble, recalled FROM (
SELECT conv_id * 1000 + turn AS id, {_LINE.format(n=120)} AS suspect, substr(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 'nothing said'), 1, 20) AS other, CASE WHEN turn % 5 = 0 THEN 'likely_corrupt' WHEN turn % 5 = 1 THEN 'LIKELY_OK' WHEN turn % 5 = 2 THEN 'maybe' WHEN turn % 5 = 3 THEN 'LIKELY_CORRUPT' END AS said,
CASE WHEN conv_id % 4 = 0 THEN 'unit_symbol' WHEN conv_id % 4 = 1 THEN 'OCR_GARBLE' WHEN conv_id % 4 = 2 THEN 'OTHER' END AS reason, CASE WHEN conv_id % 5 = 0 THEN 'high' ELSE concat(CAST(conv_id % 3 - 1 AS STRING), '.', CAST(turn % 10 AS STRING)) END AS sure, conv_id % 3 = 0 AS sound, conv_id % 9 = 0 AS dominant, CAST(length(text) % 10 AS DOUBLE) / 20 AS garble, turn % 2 = 1 AS recalled FROM conversations) x"""


@query(f"""WITH s AS ({_SAID.replace('AS STRING', 'AS VARCHAR')}), t AS (SELECT *, upper(coalesce(said, '')) AS m, CASE WHEN reason = 'unit_symbol' THEN 'TECHNICAL_FORMAT' ELSE coalesce(reason, 'AMBIGUOUS') END AS code, {_ET.format(c='evidence')} AS e, {_ET.format(c='suspect')} AS x, greatest(0.0, least(1.0, coalesce(TRY_CAST(sure AS DOUBLE), 0.0)))::DOUBLE AS c FROM s),
v AS (SELECT *, e <> '' AND contains(x, e) AS valid FROM t), u AS (SELECT *, valid AND m = 'LIKELY_CORRUPT' AND sound AS doubted, recalled AND code = 'OCR_GARBLE' AS kept FROM v)
SELECT id, CASE WHEN NOT valid THEN 'UNCERTAIN' WHEN doubted AND dominant THEN 'LIKELY_OK' WHEN doubted AND NOT kept THEN 'UNCERTAIN' WHEN m IN ('LIKELY_OK', 'LIKELY_CORRUPT') THEN m ELSE 'UNCERTAIN' END AS verdict, CASE WHEN NOT valid THEN least(c, 0.25) WHEN doubted AND dominant THEN greatest(0.75, 1.0 - garble) WHEN doubted AND NOT kept THEN least(c, 0.5) ELSE c END::DOUBLE AS confidence,
CASE WHEN NOT valid THEN 'INVALID_EVIDENCE' WHEN doubted AND dominant THEN 'TECHNICAL_FORMAT' ELSE code END AS reason_code, CASE WHEN doubted AND dominant THEN 'CLEAN_TECHNICAL_FORMAT' WHEN doubted AND kept THEN 'DOCUMENT_RECALL_CORROBORATED_OCR' WHEN doubted THEN 'NORMAL_STRUCTURE_MODEL_DISAGREEMENT' END AS override FROM u""")
def validate_text_verdicts(spark, sf):
    c = F.col
    v = verdicts.text_verdict(*[c(n) for n in ("said", "reason", "sure", "evidence", "suspect", "sound", "dominant", "garble", "recalled")])
    return view(spark, sf, _SAID).select("id", v.alias("v")).select("id", "v.verdict", "v.confidence", "v.reason_code", "v.override")


_SEEN = """SELECT o_orderkey AS id, o_custkey AS picture, CASE o_orderkey % 4 WHEN 0 THEN 'technical_useful' WHEN 1 THEN 'DECORATIVE_OR_LOW_VALUE' WHEN 2 THEN 'UNCERTAIN' END AS said, CASE o_orderkey % 5 WHEN 0 THEN '0.9' WHEN 1 THEN '0.55' WHEN 2 THEN 'x' ELSE '0.2' END AS sure, CASE o_orderkey % 6 WHEN 0 THEN 'Wiring Diagram' WHEN 1 THEN 'logo' WHEN 2 THEN 'poem' END AS category,
CASE WHEN o_orderkey % 8 = 0 THEN true WHEN o_orderkey % 8 = 1 THEN false END AS unresolved, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('P', CAST(o_orderkey % 4 AS STRING), '|P1') END AS words, CASE WHEN o_orderkey % 9 < 7 THEN '' ELSE 'pipe' END AS things, o_orderkey % 7 = 0 AS failed, o_orderkey % 2 = 0 AS drawn FROM orders"""
_CONF = "CASE sure WHEN '0.9' THEN 0.9 WHEN '0.55' THEN 0.55 WHEN 'x' THEN 0.0 ELSE 0.2 END::DOUBLE"
_PV = f"p AS (SELECT id, picture, failed, drawn, CASE WHEN said IS NULL THEN 'UNCERTAIN' ELSE upper(said) END AS verdict, {_CONF} AS confidence, CASE category WHEN 'Wiring Diagram' THEN 'wiring_diagram' WHEN 'logo' THEN 'logo' ELSE 'unknown' END AS category, coalesce(unresolved, coalesce(upper(said), 'UNCERTAIN') = 'UNCERTAIN') AS unresolved, list_filter(string_split(words, '|'), lambda w: w <> '') AS words, list_filter(string_split(things, '|'), lambda w: w <> '') AS things FROM s)"


def _pictures(spark, sf):
    c = F.col
    parts = lambda n: F.filter(F.split(n, r"\|"), lambda w: w != "")
    return view(spark, sf, _SEEN).withColumn("v", verdicts.picture_verdict(c("said"), c("sure"), c("category"), c("unresolved"), parts("words"), parts("things")))


@query(f"""WITH s AS ({_SEEN}), {_PV}, g AS (SELECT *, category = 'wiring_diagram' AND confidence >= 0.55 AND drawn AS d FROM p)
SELECT id, failed OR verdict = 'UNCERTAIN' OR unresolved OR (verdict = 'TECHNICAL_USEFUL' AND len(words) = 0 AND len(things) = 0) AS crops, CASE WHEN d THEN 'TECHNICAL_USEFUL' WHEN verdict = 'DECORATIVE_OR_LOW_VALUE' AND drawn THEN 'UNCERTAIN' ELSE verdict END AS verdict, CASE WHEN d AND verdict <> 'TECHNICAL_USEFUL' THEN greatest(confidence, 0.7) ELSE confidence END AS confidence,
unresolved OR (NOT d AND verdict = 'DECORATIVE_OR_LOW_VALUE' AND drawn) AS unresolved, CASE WHEN d AND verdict <> 'TECHNICAL_USEFUL' THEN 'STRUCTURALLY_CORROBORATED_TECHNICAL_DIAGRAM' WHEN NOT d AND verdict = 'DECORATIVE_OR_LOW_VALUE' AND drawn THEN 'STRUCTURAL_DIAGRAM_CONFLICT_REQUIRES_REVIEW' END AS override FROM g""")
def gate_picture_verdicts(spark, sf):
    p = _pictures(spark, sf).withColumn("g", verdicts.structural_gate(F.col("v"), F.col("drawn")))
    return p.select("id", verdicts.needs_crops(F.col("v"), F.col("failed")).alias("crops"), "g.verdict", "g.confidence", "g.unresolved", "g.override")


@query(f"""WITH s AS ({_SEEN}), {_PV} SELECT picture, CASE WHEN bool_or(verdict = 'TECHNICAL_USEFUL') THEN 'TECHNICAL_USEFUL' WHEN bool_and(verdict = 'DECORATIVE_OR_LOW_VALUE') THEN 'DECORATIVE_OR_LOW_VALUE' ELSE 'UNCERTAIN' END AS verdict,
CASE WHEN bool_or(verdict = 'TECHNICAL_USEFUL') THEN max(confidence) FILTER (WHERE verdict = 'TECHNICAL_USEFUL') WHEN bool_and(verdict = 'DECORATIVE_OR_LOW_VALUE') THEN max(confidence) ELSE coalesce(max(confidence) FILTER (WHERE verdict = 'UNCERTAIN'), 0) END AS confidence,
array_to_string(list_sort(list_distinct(flatten(list(words)))), ',') AS words, array_to_string(list_sort(list_distinct(flatten(list(things)))), ',') AS things FROM p GROUP BY picture""")
def merge_picture_parts(spark, sf):
    m = verdicts.merge_parts(_pictures(spark, sf).select("picture", F.col("id").alias("part"), "v"), "picture")
    return m.select("picture", "verdict", "confidence", F.array_join(F.array_sort("words"), ",").alias("words"), F.array_join(F.array_sort("things"), ",").alias("things"))


@query("SELECT o_custkey, CASE WHEN bool_and(o_orderkey % 5 > 0) THEN 'LIKELY_OK' ELSE 'UNCERTAIN' END AS verdict, min(o_orderkey % 9)::DOUBLE AS confidence, count(*) AS parts FROM orders GROUP BY o_custkey")
def merge_text_segments(spark, sf):
    o = _t(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 > 0, "LIKELY_OK").otherwise("LIKELY_CORRUPT").alias("verdict"), (F.col("o_orderkey") % 9).cast("double").alias("confidence"))
    return verdicts.merge_segments(o, "o_custkey")


@query("""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS a, CASE WHEN turn % 3 = 0 THEN substr(coalesce(text, ''), 1, 40) ELSE upper(coalesce(text, '')) END AS b FROM conversations), n AS (SELECT *, lower(trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS x, lower(trim(regexp_replace(b, '\\s+', ' ', 'g'))) AS y FROM c)
SELECT conv_id, turn, turn % 7 = 0 OR turn % 5 = 0 OR turn % 11 = 0 OR (length(x) >= 80 AND y <> '' AND length(y) < 0.9 * length(x) AND (starts_with(x, y) OR ends_with(x, y))) AS unsafe FROM n""")
def unsafe_overlays(spark, sf):
    k = F.col("turn")
    text = F.coalesce("text", F.lit(""))
    new = F.when(k % 3 == 0, F.substring(text, 1, 40)).otherwise(F.upper(text))
    return _t(spark, sf, "conversations").select("conv_id", "turn", verdicts.unsafe_overlay(text, new, k % 7 == 0, F.when(k % 5 == 0, F.array(F.lit("SOURCE_CONTENT_CONTRACTION"))), k % 11 != 0).alias("unsafe"))


_FAT = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '|---|---|' WHEN 1 THEN '| a    |   b |\n| ---- | --- |\n| 1    |   2 |' WHEN 2 THEN 'Plain words about a pump.' ELSE '' END AS raw, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Long heading of a part > Deepest' END AS heading, CAST(100 + o_orderkey % 900 AS INT) AS n_tokens FROM orders"""
_EST = "greatest(1, ceil(length({c}) * (n_tokens::DOUBLE / length(body)) * 1.08), ceil(length({c}) / 2.5), len(regexp_extract_all({c}, '[A-Za-z]+|\\d+(?:\\.\\d+)?|[^\\w\\s]')))"


@query(f"""WITH f AS (SELECT *, CASE WHEN heading = '' THEN '' ELSE 'Deepest' || chr(10) END AS deep, heading || CASE WHEN heading = '' THEN '' ELSE chr(10) END || raw AS body FROM ({_FAT})),
k AS (SELECT *, CASE WHEN n_tokens <= 300 OR trim(raw) = '' THEN 'none' WHEN id % 4 = 0 THEN 'separator_only' WHEN id % 4 = 1 AND length(deep || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10)) < length(body) THEN 'padding' ELSE 'heading' END AS how FROM f),
c AS (SELECT *, CASE how WHEN 'separator_only' THEN deep WHEN 'padding' THEN deep || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) WHEN 'heading' THEN CASE WHEN heading <> '' AND {_EST.format(c="(deep || raw)")} <= 300 THEN deep || raw WHEN {_EST.format(c='raw')} <= 300 THEN raw END END AS t FROM k)
SELECT id, CASE WHEN t IS NULL THEN 'none' ELSE how END AS action, coalesce(t, body) AS text, CASE WHEN t IS NULL THEN n_tokens ELSE {_EST.format(c='t')} END::BIGINT AS n_tokens FROM c""")
def compact_oversized_chunks(spark, sf):
    c = view(spark, sf, _FAT).withColumn("body", F.concat("heading", F.when(F.col("heading") == "", "").otherwise("\n"), "raw")).withColumn("deepest", F.when(F.col("heading") == "", "").otherwise("Deepest"))
    return chunking.compacted(c, "raw", "body", "deepest", "n_tokens", 300).select("id", "action", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


_FILES = """SELECT concat('/', CASE WHEN p_partkey % 4 = 0 THEN 'index' WHEN p_partkey % 4 = 1 THEN 'errors' ELSE 'books' END, '/m', CAST(p_partkey AS STRING), '__job', CAST(p_size AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '__x' END) AS path, CASE WHEN p_partkey % 4 = 0 THEN 'index' WHEN p_partkey % 4 = 1 THEN 'errors' ELSE 'books' END AS category, p_partkey % 5 AS files, p_partkey * 10 AS bytes FROM part"""


@query(f"WITH f AS ({_FILES}) SELECT category, count(*) AS items, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM f GROUP BY ROLLUP (category)")
def upkeep_rollup(spark, sf):
    return upkeep.rollup(view(spark, sf, _FILES))


@query(f"""WITH f AS (SELECT *, TRY_CAST(regexp_extract(path, '__job(\\d+)(?:__|$)', 1) AS BIGINT) AS job FROM ({_FILES})), done AS (SELECT DISTINCT job FROM f WHERE category = 'books'), known AS (SELECT s_suppkey AS job FROM supplier)
SELECT path, CASE category WHEN 'errors' THEN 'ERROR_OF_A_FINISHED_JOB' ELSE 'INDEX_WITHOUT_A_MACHINE' END AS reason FROM f WHERE (category = 'errors' AND job IN (FROM done)) OR (category = 'index' AND job NOT IN (FROM known))""")
def stale_files(spark, sf):
    return upkeep.stale(view(spark, sf, _FILES), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("job"))).select("path", "reason")


@query(f"""WITH f AS ({_FILES}) SELECT category, sha256(string_agg(d, ',' ORDER BY d)) AS token FROM (SELECT category, sha256(concat_ws(chr(31), path, files::VARCHAR, bytes::VARCHAR)) AS d FROM f) GROUP BY category""")
def preview_tokens(spark, sf):
    return upkeep.preview(view(spark, sf, _FILES), "category")


_FOLDERS = """SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 50 END AS stored, concat(replace(o_orderpriority, ' ', ''), CASE WHEN o_orderkey % 9 = 0 THEN '__JOB' WHEN o_orderkey % 9 = 1 THEN '_job' ELSE '__job' END, CAST(o_custkey % 50 + CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '__v2' WHEN o_orderkey % 3 = 1 THEN '' ELSE '-old' END) AS path FROM orders"""


@query(f"""WITH f AS ({_FOLDERS.replace("AS STRING", "AS VARCHAR")}), j AS (SELECT *, TRY_CAST(regexp_extract(path, '__job(\\d+)(?:__|$)', 1) AS BIGINT) AS in_name FROM f)
SELECT o_orderkey, stored, in_name, CASE WHEN stored IS NULL THEN 'missing' WHEN in_name IS NULL THEN 'unknown' WHEN stored = in_name THEN 'consistent' ELSE 'mismatch' END AS status, coalesce(in_name, stored) AS repaired FROM j""")
def identity_status(spark, sf):
    """The job that an order's folder names beside the job that is stored."""
    o = view(spark, sf, _FOLDERS).select("o_orderkey", "stored", upkeep.job_of(F.col("path")).alias("in_name"))
    return o.withColumns({"status": upkeep.identity(F.col("stored"), F.col("in_name")), "repaired": F.coalesce("in_name", "stored")})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'waiting_for_ledger' WHEN o_custkey % 4 = 0 THEN 'chunks_not_built' WHEN o_custkey % 4 = 1 THEN 'chunks_running' WHEN o_custkey % 5 <> o_orderkey % 5 THEN 'chunks_stale_input' WHEN o_orderkey % 2 = 0 THEN 'chunks_stale_rules' WHEN o_orderkey % 3 = 0 THEN 'chunks_outputs_missing' ELSE 'current' END AS step FROM orders""")
def pipeline_next_step(spark, sf):
    """What each book waits for: its upstream first, then the first reason why its chunks aren't current."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(c % 4 == 0, None).when(c % 4 == 1, "running").otherwise("completed")
    why = freshness.stale_reason("chunks", status, (c % 5).cast("string"), (k % 5).cast("string"), F.concat(F.lit("v"), (k % 2).cast("string")), F.lit("v1"), k % 3 > 0)
    return _t(spark, sf, "orders").select("o_orderkey", upkeep.next_step(F.when(k % 6 == 0, "waiting_for_ledger"), why).alias("step"))


@query("WITH seen AS (SELECT DISTINCT sha256(concat_ws(chr(0), 'm', coalesce(text, ''))) AS key FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE sha256(concat_ws(chr(0), 'm', coalesce(text, ''))) NOT IN (FROM seen)")
def uncached_calls(spark, sf):
    d = _t(spark, sf, "documents").withColumn("key", upkeep.call_key(F.lit("m"), F.col("text")))
    return upkeep.uncached(d, d.where("doc_id % 3 = 0").select("key")).select("doc_id")


_FRAMES = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat(event_type, CASE WHEN value > 50 THEN '_by_hand' ELSE '' END) END AS status, CASE WHEN value > 90 THEN concat(': keepalive ', event_type, chr(10)) WHEN value > 80 THEN concat('data: {"k": ', CAST(user_id AS STRING)) WHEN value > 60 THEN concat('event: update', chr(10), 'data: {"reason": "', event_type, '",', chr(10), 'data:"k": ', CAST(user_id AS STRING), '}', chr(10)) ELSE concat('event: x', chr(10), 'data: ', props, chr(10)) END AS frame FROM events"""


@query(
    f"""WITH f AS ({_FRAMES.replace("AS STRING", "AS VARCHAR")}), d AS (SELECT *, array_to_string(list_transform(list_filter(string_split(frame, chr(10)), lambda l: starts_with(l, 'data:')), lambda l: CASE WHEN starts_with(l, 'data: ') THEN substr(l, 7) ELSE substr(l, 6) END), chr(10)) AS data FROM f),
j AS (SELECT *, CASE WHEN json_valid(data) THEN data END AS held FROM d)
SELECT event_id, CASE status WHEN 'click' THEN 'Chosen' WHEN 'view_by_hand' THEN 'Looked at' ELSE coalesce(array_to_string(list_transform(string_split(replace(status, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 'Unknown') END AS label,
json_extract_string(held, '$.reason') AS reason, TRY_CAST(json_extract_string(held, '$.k') AS BIGINT) AS job, NOT regexp_matches(frame, '(^|\\n)data:') AS keepalive FROM j"""
)
def status_labels_and_frames(spark, sf):
    """Each event's status as people read it, and what a frame of an event stream that carries its properties says."""
    f = view(spark, sf, _FRAMES)
    data = upkeep.event_data(F.col("frame"))
    return f.select("event_id", upkeep.label(F.col("status"), {"click": "Chosen", "view_by_hand": "Looked at"}).alias("label"), F.get_json_object(data, "$.reason").alias("reason"), F.get_json_object(data, "$.k").try_cast("long").alias("job"), data.isNull().alias("keepalive"))


_FETCHED = """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat(url, '/file%20', CAST(page_id AS STRING), '.PDF?x=', CAST(page_id AS STRING)) WHEN page_id % 4 = 1 THEN concat(url, '/', CAST(page_id AS STRING), '.tar.gz') ELSE url END AS url,
CASE WHEN page_id % 5 = 0 THEN concat('attachment; filename="C:', chr(92), 'docs', chr(92), 'r ', CAST(page_id AS STRING), '.pdf"') WHEN page_id % 5 = 1 THEN concat('inline; filename*=UTF-8', chr(39), chr(39), 'a%2Fb', CAST(page_id AS STRING), '.html') WHEN page_id % 5 = 2 THEN 'attachment' END AS said FROM pages"""


@query(
    f"""WITH f AS ({_FETCHED.replace("AS STRING", "AS VARCHAR")}), x AS (SELECT page_id, regexp_extract(replace(url_decode(regexp_extract(coalesce(said, ''), 'filename\\*?=(?:UTF-8..)?"?([^";]+)', 1)), chr(92), '/'), '([^/]*)$', 1) AS named, regexp_extract(replace(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1)), chr(92), '/'), '([^/]*)$', 1) AS last FROM f),
n AS (SELECT page_id, substr(CASE WHEN named <> '' THEN named WHEN contains(last, '.') THEN last ELSE 'document' END, 1, 220) AS name FROM x) SELECT page_id, name, coalesce(nullif(lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)), ''), 'unknown') AS kind FROM n"""
)
def source_filenames(spark, sf):
    """What a fetched page's file is called: by what the server says of it, else by its address."""
    name = upkeep.download_name(F.col("url"), F.col("said"))
    return view(spark, sf, _FETCHED).select("page_id", name.alias("name"), F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("unknown")).alias("kind"))


@query("""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), s AS (SELECT source, 'REPLACEMENT_CHARACTERS' AS code, 'error' AS severity, count_if(contains(t, '�')) AS n FROM d GROUP BY source UNION ALL SELECT source, 'EMPTY_TEXT', 'warning', count_if(trim(t) = '') FROM d GROUP BY source UNION ALL SELECT source, 'SHORT_TEXT', 'info', count_if(length(t) BETWEEN 1 AND 80) FROM d GROUP BY source
UNION ALL SELECT source, 'REPEATED_TEXT', 'warning', sum(c) FROM (SELECT source, count(*) - 1 AS c FROM d WHERE t <> '' GROUP BY source, t) GROUP BY source) SELECT source, code, severity, n::BIGINT AS n FROM s WHERE n > 0""")
def diagnostic_signals(spark, sf):
    """One row for each source and finding: code, severity, count. Checks that need one row alone share one pass."""
    d = _t(spark, sf, "documents").select("source", F.coalesce("text", F.lit("")).alias("t"))
    own = upkeep.signals(d, "source", {"REPLACEMENT_CHARACTERS": ("error", F.col("t").contains("�")), "EMPTY_TEXT": ("warning", F.trim("t") == ""), "SHORT_TEXT": ("info", F.length("t").between(1, 80))})
    again = d.where("t <> ''").groupBy("source", F.md5("t").alias("k")).agg((F.count("*") - 1).alias("n")).groupBy("source").agg(F.sum("n").alias("n")).where("n > 0")
    return own.unionByName(again.select("source", F.lit("REPEATED_TEXT").alias("code"), F.lit("warning").alias("severity"), "n"))


_WRAPPED = """SELECT conv_id, turn, CASE WHEN length(text) % 6 = 0 THEN concat('<think>', substr(text, 1, 30), '</think> ', substr(text, 31, 60), '<Analysis>x</analysis>  ') WHEN length(text) % 6 = 1 THEN concat(substr(text, 1, 20), '</reasoning>', chr(10), substr(text, 21, 50)) WHEN length(text) % 6 = 2 THEN concat(substr(text, 1, 40), '<analysis>', substr(text, 41, 50))
WHEN length(text) % 6 = 3 THEN concat('<think>', substr(text, 1, 9), '</reasoning>', substr(text, 10, 20), '</think>', substr(text, 30, 20)) ELSE text END AS raw FROM conversations"""
_BARE_OF = "{x}"
for _tag in ("think", "reasoning", "analysis"):
    _BARE_OF = f"regexp_replace({_BARE_OF}, '(?is)<{_tag}>.*?</{_tag}>', '', 'g')"


@query(f"""WITH w AS ({_WRAPPED}) SELECT conv_id, turn, trim(regexp_replace(regexp_replace({_BARE_OF.format(x='raw')}, '(?is)^.*?</(think|reasoning|analysis)>', ''), '(?is)<(think|reasoning|analysis)>.*$', ''), ' ' || chr(9) || chr(13) || chr(10)) AS said FROM w""")
def completions(spark, sf):
    """Turns that came with wrappers of reasoning, closed, cut off in front or cut off behind."""
    return view(spark, sf, _WRAPPED).select("conv_id", "turn", answers.completion(F.col("raw")).alias("said"))


@query("""SELECT l_suppkey AS book, max(p) AS last_page, arg_max(t, p) AS last_text FROM (SELECT l_suppkey, l_linenumber AS p, string_agg(l_returnflag, '' ORDER BY l_orderkey, l_partkey, l_quantity) AS t FROM lineitem GROUP BY 1, 2) GROUP BY l_suppkey""")
def page_texts(spark, sf):
    """The text of each page, its items in reading order."""
    rows = _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_linenumber").alias("page"), F.struct("l_orderkey", "l_partkey", "l_quantity").alias("place"), F.col("l_returnflag").alias("text"))
    pages = upkeep.page_text(rows, ["book", "page"], "place", "text", "")
    return pages.groupBy("book").agg(F.max("page").alias("last_page"), F.max_by("text", "page").alias("last_text"))


_QUOTED = f"""SELECT id, suspect, CASE WHEN id % 8 = 0 THEN concat(' ', substr(suspect, 6, 30)) WHEN id % 8 = 1 THEN concat('It says “', substr(suspect, 5, 14), '” and “', substr(suspect, 30, 9), '” here') WHEN id % 8 = 2 THEN concat('I think that ', substr(suspect, 9, 40), ' it broke ', repeat('x', CAST(id % 3 AS INT) * 80)) WHEN id % 8 = 3 THEN concat('qqq ', reverse(suspect)) WHEN id % 8 = 4 THEN ''
WHEN id % 8 = 5 THEN substr(suspect, 1, 2) WHEN id % 8 = 6 THEN concat('see “not there” and ', substr(suspect, 20, 30)) END AS said FROM (SELECT conv_id * 1000 + turn AS id, {_LINE.format(n=160)} AS suspect FROM conversations) x"""
_RUN = "array_to_string(w[a:b], ' ')"


@query(f"""WITH q AS ({_QUOTED}), n AS (SELECT *, {_ET.format(c='suspect')} AS t, trim(coalesce(said, '')) AS raw, list_filter(regexp_split_to_array(coalesce(suspect, ''), '\\s+'), lambda z: z <> '') AS w FROM q), m AS (SELECT *, {_ET.format(c='raw')} AS s FROM n),
x AS (SELECT *, list_filter(list_transform(regexp_extract_all(raw, '["''‘’“”]([^"''‘’“”]{{1,500}})["''‘’“”]', 1), lambda z: trim(z)), lambda z: {_ET.format(c='z')} <> '' AND contains(t, {_ET.format(c='z')})) AS quotes FROM m),
r AS (SELECT id, t, raw, s, suspect, quotes, list_reduce(list_prepend('', flatten(list_transform(range(1, len(w) + 1), lambda a: list_transform(range(a, least(a + 14, len(w)) + 1), lambda b: CASE WHEN length({_RUN}) <= 120 AND length(regexp_replace({_RUN}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) >= 4 AND contains(s, {_ET.format(c=_RUN)}) THEN {_RUN} ELSE '' END)))),
    lambda p, z: CASE WHEN len(string_split(z, ' ')) * (z <> '')::INT > len(string_split(p, ' ')) * (p <> '')::INT THEN z ELSE p END) AS run FROM x)
SELECT id, CASE WHEN raw = '' OR coalesce(suspect, '') = '' THEN '' WHEN len(quotes) > 0 THEN quotes[list_position(list_transform(quotes, lambda z: length(z)), list_min(list_transform(quotes, lambda z: length(z))))] WHEN s <> '' AND contains(t, s) AND length(raw) <= 120 THEN raw WHEN run <> '' THEN run ELSE rtrim(substr(raw, 1, 120)) END AS span,
CASE WHEN raw = '' OR coalesce(suspect, '') = '' THEN NULL WHEN len(quotes) > 0 THEN 'QUOTED_SOURCE_SPAN' WHEN s <> '' AND contains(t, s) AND length(raw) <= 120 THEN NULL WHEN run <> '' THEN CASE WHEN length(raw) > 120 THEN 'TRIMMED_EXACT_SOURCE_SPAN' ELSE 'WRAPPED_SOURCE_SPAN' END END AS method FROM r""")
def recover_source_evidence(spark, sf):
    return verdicts.recover_evidence(view(spark, sf, _QUOTED), "said", "suspect").select("id", "recovered.span", "recovered.method")


_SCOPED = f"""SELECT id, original, context, CASE WHEN id % 6 = 0 THEN original WHEN id % 6 = 1 THEN concat(original, '  ', substr(context, 5, 90)) WHEN id % 6 = 2 THEN concat('Corrected text: ', original) WHEN id % 6 = 3 THEN substr(context, 1, 25) WHEN id % 6 = 4 THEN concat(substr(context, 11, 60), ' ', original) END AS proposed FROM (
SELECT conv_id * 1000 + turn AS id, {_LINE.format(n=150)} AS original, lag({_LINE.format(n=200)}) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations) x"""
_PLAIN = "lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')))"
_MARKED = ", ".join("'" + m.lower().replace("'", "''") + "'" for m in verdicts.MARKERS)


@query(f"""WITH q AS ({_SCOPED}), n AS (SELECT *, {_PLAIN.format(c='proposed')} AS p, {_PLAIN.format(c='original')} AS o, list_filter(string_split({_PLAIN.format(c='context')}, ' '), lambda w: w <> '') AS w FROM q)
SELECT id, concat_ws(',', CASE WHEN len(list_filter([{_MARKED}], lambda m: contains(p, m))) > 0 THEN 'PROMPT_OR_CONTEXT_MARKER_LEAKAGE' END, CASE WHEN len(list_filter(range(1, len(w) - 4), lambda i: contains(p, array_to_string(w[i:i + 5], ' ')) AND NOT contains(o, array_to_string(w[i:i + 5], ' ')))) > 0
    OR len(list_filter(range(1, len(w) - 5), lambda i: contains(p, array_to_string(w[i:i + 6], ' ')) AND NOT contains(o, array_to_string(w[i:i + 6], ' ')))) > 0 OR len(list_filter(range(1, len(w) - 6), lambda i: contains(p, array_to_string(w[i:i + 7], ' ')) AND NOT contains(o, array_to_string(w[i:i + 7], ' ')))) > 0 THEN 'NEARBY_CONTEXT_COPIED_INTO_CORRECTION' END) AS reasons FROM n""")
def correction_scope_guard(spark, sf):
    return verdicts.scope_guard(view(spark, sf, _SCOPED), "original", "context", "proposed").select("id", F.array_join("scope.reasons", ",").alias("reasons"))


#: Importing it registers its queries.
NAME = __name__
