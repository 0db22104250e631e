"""Catalog queries on text fidelity, chunk budgets, structure checks, reranking and rest periods.

``ROWS`` names those that SQL can't express (alignment, lookbehind, state machines); tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import answers, fidelity
from lodestone.operators import chunking, features, freshness, integrity
from lodestone.plans import catalog
from lodestone.plans.catalog import _TOKS, _asked, _fused, _lexical, _t, query
from lodestone.plans.inputs import view
from lodestone.session import ship
from lodestone.streaming import governor

ROWS: dict = {}


def rows_only(f):
    ROWS[f.__name__] = f
    return f


def _docs(spark, sf):
    ship(spark)
    return _t(spark, sf, "documents").select("doc_id", "source", "text")


_W = "list_filter(list_transform(p, lambda w: trim(w, '()[]{}.,;:')), lambda w: w <> '' AND NOT regexp_full_match(w, '[A-Z]{2,8}') AND NOT (regexp_full_match(w, '[A-Za-z0-9._/+%-]{2,}') AND regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[0-9]')))"
_SHAPE = "length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '\\pL+', chr(1), 'g'), '\\p{Nd}+', chr(2), 'g'), '[^' || chr(1) || chr(2) || ']+', chr(3), 'g'), '', ''))"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x0b]+', ''), '[\s\x0b]+$', '') AS t FROM documents), p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\s\x0b]+'), lambda w: w <> '') AS p FROM t),
w AS (SELECT doc_id, t, len(p) AS n, {_W} AS w FROM p), s AS (SELECT *, list_sort(list_filter(list_transform(w, lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: length(w) BETWEEN 1 AND 4)) AS short,
list_transform(list_filter(w, lambda w: length(w) >= 5), lambda w: {_SHAPE}) AS shapes FROM w),
g AS (SELECT doc_id, t, n, 20 * len(regexp_extract_all(t, '[�□¤]'))::DOUBLE / greatest(1, length(t)) AS a, 2 * len(regexp_extract_all(t, '[^\pL\pN_\s]{{4,}}'))::DOUBLE / greatest(1, n) AS b, 2 * len(regexp_extract_all(t, '(?:\b[A-Za-z0-9]\s+){{3,}}[A-Za-z0-9]\b'))::DOUBLE / greatest(1, n) AS c,
len(list_filter(w, lambda w: regexp_full_match(w, '\pL{{1,2}}')))::DOUBLE / greatest(1, len(w)) AS d, len(list_filter(w, lambda w: length(w) >= 4 AND len(regexp_extract_all(w, '[^A-Za-z0-9._/+%°µμΩΩ-]')) >= 2))::DOUBLE / greatest(1, len(w)) AS e,
2 * len(list_filter(range(3, len(short) + 1), lambda i: short[i] = short[i - 2]))::DOUBLE / greatest(1, n) AS f, coalesce(list_sum(list_transform(list_filter(shapes, lambda k: k >= 4), lambda k: least(1.0::DOUBLE, (k - 3) / 4.0::DOUBLE))), 0) / greatest(1, len(shapes)) AS h FROM s),
r AS (SELECT doc_id, t, n, round_even(least(1.0::DOUBLE, a), 4) AS a, round_even(least(1.0::DOUBLE, b), 4) AS b, round_even(least(1.0::DOUBLE, c), 4) AS c, round_even(d, 4) AS d, round_even(e, 4) AS e, round_even(least(1.0::DOUBLE, f), 4) AS f, round_even(h, 4) AS h FROM g),
x AS (SELECT *, CASE WHEN t = '' THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 0.18::DOUBLE * a + 0.10::DOUBLE * b + 0.15::DOUBLE * c + 0.34::DOUBLE * d + 0.08::DOUBLE * e + 0.10::DOUBLE * f + 0.05::DOUBLE * h) END AS score FROM r)
SELECT doc_id, a AS replacement_chars, b AS punctuation_runs, c AS spaced_character_fragments, d AS tiny_token_ratio, e AS mixed_fragment_ratio, f AS repeated_broken_fragments, h AS abnormal_token_transitions, (k // 100 + (k % 100 > 50 OR (k % 100 = 50 AND k // 100 % 2 = 1))::INT)::DOUBLE / 10000 AS score, score >= 0.12 AS confirmed, score <= 0.08 AS structurally_normal, n::BIGINT AS token_count FROM (SELECT *, round(score * 1000000)::BIGINT AS k FROM x)""")
def garble_profile(spark, sf):
    return fidelity.garble(_docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "garble.*")


@rows_only
def technical_profile(spark, sf):
    d = fidelity.read(_docs(spark, sf), "text", "r").select("doc_id", fidelity.technical(F.col("r")).alias("p"))
    return d.select("doc_id", F.array_join("p.classes", ",").alias("classes"), "p.coverage", "p.dominant", F.array_join("p.prose_classes", ",").alias("prose_classes"))


_PLAIN_CLASSES = {k: fidelity.PATTERNS[k].replace("(?i)", "") for k in ("tolerance", "standard_or_spec", "terminal_or_wire", "rating", "formula_like")}
_FLAGS = {k: "i" if fidelity.PATTERNS[k].startswith("(?i)") else "c" for k in _PLAIN_CLASSES}
_CLASS_SQL = [f"len(regexp_extract_all(coalesce(text, ''), '{p}', 0, '{_FLAGS[k]}'))::BIGINT AS {k}" for k, p in _PLAIN_CLASSES.items()]
_PROSE_SQL = [f"regexp_matches(coalesce(text, ''), '{p[p.index(')') + 1:]}', '{p[2:p.index(')')]}') AS {k}" for k, p in fidelity.PROSE.items()]


@query(f"SELECT doc_id, {', '.join(_CLASS_SQL)}, {', '.join(_PROSE_SQL)} FROM documents")
def technical_classes(spark, sf):
    """How often each technical pattern without lookaround occurs, and which kinds of technical prose a text shows."""
    found = {**fidelity.plain_counts(F.col("text"), _PLAIN_CLASSES), **fidelity.plain_prose(F.col("text"))}
    return _docs(spark, sf).select("doc_id", *[c.alias(k) for k, c in found.items()])


@rows_only
def critical_tokens(spark, sf):
    c = fidelity.read(_docs(spark, sf), "text", "r").select("doc_id", fidelity.critical_set(F.col("r")).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n"), F.array_join("c", " ").alias("tokens"))


#: Sentences of a manual, chosen by key: instructions that share a sentence, lead to each other, or have no object.



_ORDERS = """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat('Check the pump ', n, ' and replace the ', p, ' filter.') WHEN 1 THEN concat('Open valve ', n, '; close the ', p, ' drain, then stop.') WHEN 2 THEN concat('No work on ', n, ' is needed.') WHEN 3 THEN concat('Inspect and clean the ', p, ' bowl. Tighten ', n) ELSE concat('Measure A', n, ', B and ', p, ' before the test') END AS said
FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS n, CASE WHEN o_orderpriority < '2' THEN 'urgent' WHEN o_orderpriority < '4' THEN 'upper oil' ELSE 'old' END AS p FROM orders) x"""


@query(rf"""WITH m AS ({_ORDERS.replace("AS STRING", "AS VARCHAR")}),
parts AS (SELECT o_orderkey, string_split_regex(said, '[.;]') AS parts FROM m), s AS (SELECT o_orderkey, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM parts),
v AS (SELECT o_orderkey, k, s, unnest(regexp_extract_all(lower(s), '\b(check|inspect|replace|open|close|drain|clean|tighten|measure|test|stop)\b')) AS verb FROM s),
p AS (SELECT *, strpos(lower(s), verb) AS b, strpos(lower(s), verb) + length(verb) AS e FROM v), n AS (SELECT *, lead(b) OVER (PARTITION BY o_orderkey, k ORDER BY b) AS after FROM p),
o AS (SELECT o_orderkey, verb, CASE WHEN after IS NOT NULL AND regexp_matches(substr(s, e, after - e), '(\b(and|or)(\s+then)?\b|,\s*(then\s+)?)\s*$', 'i') THEN regexp_replace(substr(s, e, after - e), '(\b(and|or)(\s+then)?\b|,\s*(then\s+)?)\s*$', '', 'i') ELSE substr(s, e) END AS what FROM n)
SELECT o_orderkey, verb, regexp_replace(regexp_replace(lower(trim(what)), '^(the|a|an)\s+', ''), '[\s,.:;!?-]+$', '') AS object, count(*) AS n FROM o GROUP BY ALL""")
def action_obligations(spark, sf):
    ship(spark)
    d = fidelity.read(view(spark, sf, _ORDERS).select("o_orderkey", F.col("said").alias("text")), "text", "r")
    return d.select("o_orderkey", F.explode(fidelity.obligations(F.col("r"))).alias("o")).groupBy("o_orderkey", "o.verb", "o.object").agg(F.count("*").alias("n"))


def _turns(spark, sf):
    """Each turn and the one before it, as a source and its correction."""
    ship(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("before"))


@rows_only
def correction_fidelity(spark, sf):
    t = fidelity.correction_fidelity(_turns(spark, sf), "before", "text")
    return t.select("conv_id", "turn", "fidelity.accepted", F.array_join("fidelity.reasons", ",").alias("reasons"), "fidelity.similarity", "fidelity.length_ratio", "fidelity.preservation")


@rows_only
def transcription_safety(spark, sf):
    t = fidelity.transcription_safety(_turns(spark, sf), "before", "text")
    return t.select("conv_id", "turn", "safety.accepted", F.array_join("safety.reasons", ",").alias("reasons"), "safety.similarity", "safety.recall", "safety.precision")


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE json(props)::VARCHAR END AS found, CASE WHEN event_id % 4 IN (0, 1, 2) AND event_id % 4 <> 3 THEN CASE event_id % 4 WHEN 1 THEN 'OK' WHEN 2 THEN 'OK' END END AS verdict,
CASE WHEN event_id % 4 = 1 THEN 'a "b" c' WHEN event_id % 4 = 2 THEN 'whole' END AS reason, CASE WHEN event_id % 4 = 1 THEN 'x,y' END AS seen FROM events""".replace("json(props)::VARCHAR END AS found", "CASE WHEN event_id % 4 = 2 THEN '{\"verdict\":\"ok\",\"reason\":\"whole\"}' ELSE json(props)::VARCHAR END END AS found"))
def json_salvage(spark, sf):
    """Objects in free text, whole, cut off in a field, complete but for other text, and none at all."""
    ship(spark)
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("Here it is:\n"), F.col("props"), F.lit("\nIs {that} all?")))
    said = said.when(k == 1, F.lit('{"verdict": "ok", "reason": "a \\"b\\" c", "visible_text": ["x", "y", "z cut o')).when(k == 2, F.lit('```json {"verdict": "ok", "reason": "whole"} ```')).otherwise(F.lit("no object } here"))
    e = _t(spark, sf, "events").select("event_id", said.alias("said"))
    seen = F.array_join(answers.closed_strings(F.col("said"), "visible_text"), ",")
    return e.select("event_id", answers.json_salvage("said").alias("found"), answers.verdict_of(F.col("said"), ["OK", "WRONG"]).alias("verdict"), answers.closed_string(F.col("said"), "reason").alias("reason"), seen.alias("seen"))


@query(r"""SELECT doc_id, i - 1 AS part, string_split(acc, chr(30))[i] AS segment FROM (SELECT doc_id, acc, unnest(range(1, len(string_split(acc, chr(30))) + 1)) AS i FROM (
SELECT doc_id, CASE WHEN len(u) = 0 THEN '' ELSE list_reduce(u, lambda acc, x: CASE WHEN length(regexp_extract(acc, '[^]*$')) + length(x) > 1800 THEN acc || chr(30) || x ELSE acc || x END) END AS acc FROM (
SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[+-]?\d+(?:[.,]\d+)?\s+\S+\s*|\S+\s*|\s+') AS u FROM documents)))""")
def split_long_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(answers.text_segments(F.col("text"))).alias("part", "segment")).withColumn("part", F.col("part").cast("long"))


@rows_only
def greedy_pack_tokens(spark, sf):
    d = _docs(spark, sf).withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))
    return chunking.split_over_budget(d, "doc_id", "text", "n", 256)


@query(r"""SELECT source, count(*) AS n, round_even(least(100.0::DOUBLE, 900.0::DOUBLE * sum(r) / greatest(sum(c) + count(*) - 1, 1) + (18.0::DOUBLE * sum(p) + 35.0::DOUBLE * sum(tiny) + 25.0::DOUBLE * sum(s)) / count(*)), 0)::BIGINT AS risk FROM (
SELECT source, length(t) AS c, len(regexp_extract_all(t, '[�□¤]')) AS r, len(regexp_extract_all(t, '[^\pL\pN_\s]{4,}')) AS p, len(regexp_extract_all(t, '(?:\b[A-Za-z0-9]\s+){3,}[A-Za-z0-9]\b')) AS s,
(length(regexp_replace(t, '\s+', '', 'g')) BETWEEN 1 AND 3)::INT AS tiny FROM (SELECT source, coalesce(text, '') AS t FROM documents)) GROUP BY source""")
def ocr_risk_by_group(spark, sf):
    return integrity.damage(_t(spark, sf, "documents"), "source", "text")


@query(r"""SELECT line, count(DISTINCT doc_id) AS pages, min(doc_id) AS first_page FROM (SELECT doc_id, regexp_replace(lower(trim(regexp_replace(l, '\s+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 4""")
def running_furniture(spark, sf):
    lines = _t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return integrity.running_furniture(lines, "l", "doc_id", 4)


@query(f"""WITH w AS (SELECT t, count(*) AS n FROM (SELECT unnest({_TOKS.format(c="text")}) AS t FROM documents) WHERE length(t) >= 5 GROUP BY t),
k AS (SELECT t, n, t AS key FROM w UNION SELECT t, n, substr(t, 1, i - 1) || substr(t, i + 1) FROM w, generate_series(1, 400) s(i) WHERE i <= length(t))
SELECT DISTINCT r.t AS rare, f.t AS frequent, f.n FROM k r JOIN k f USING (key) WHERE r.n <= 2 AND length(r.t) >= 6 AND f.n >= 5 AND levenshtein(r.t, f.t) = 1""")
def rare_near_frequent_tokens(spark, sf):
    from lodestone.functions.text import tokens

    return integrity.rare_near_frequent(_t(spark, sf, "documents").select(F.explode(tokens(F.col("text"))).alias("t")), "t")


_GRAPH = "nodes AS (SELECT p_partkey AS node FROM part WHERE p_size % 7 <> 0), edges AS (SELECT p_partkey AS src, p_partkey * k + o AS dst FROM part, (VALUES (2, 0), (2, 1)) v(k, o))"


def _graph(spark, sf):
    p = _t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).alias("dst")), p.where("p_size % 7 <> 0").select(F.col("p_partkey").alias("node"))


@query(f"WITH {_GRAPH} SELECT src, dst FROM edges WHERE dst NOT IN (SELECT node FROM nodes)")
def broken_references(spark, sf):
    edges, nodes = _graph(spark, sf)
    return integrity.broken_references(edges, nodes, "dst", "node").select("src", "dst")


@query(f"WITH RECURSIVE {_GRAPH}, walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node JOIN nodes n ON n.node = e.dst) SELECT node, min(depth) AS depth FROM walk GROUP BY node")
def reachability(spark, sf):
    edges, nodes = _graph(spark, sf)
    sound = edges.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return integrity.reachable(sound, spark.range(1, 2).select(F.col("id").alias("node")))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN abs(r - l) <= 1e-9 OR abs(t - b) <= 1e-9 THEN 'degenerate_bbox' WHEN greatest(l, r) < -1 OR least(l, r) > 51 OR greatest(t, b) < -1 OR least(t, b) > 41 THEN 'bbox_outside_page' END AS problem
FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE + 5 AS l, l_linenumber::DOUBLE AS r, l_suppkey % 60::DOUBLE AS t, l_partkey % 45::DOUBLE AS b FROM lineitem)""")
def box_problems(spark, sf):
    c = lambda x: F.col(x).cast("double")
    why = integrity.box_problem(c("l_quantity") + 5, c("l_suppkey") % 60, c("l_linenumber"), c("l_partkey") % 45, F.lit(50.0), F.lit(40.0))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", why.alias("problem"))


@query("""WITH c AS (SELECT event_id, user_id, ts, value > 60 AS failed FROM events), s AS (SELECT *, count_if(NOT coalesce(failed, false)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM c),
f AS (SELECT *, count_if(coalesce(failed, false)) OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS n FROM s)
SELECT event_id, user_id, CASE WHEN failed THEN n ELSE 0 END::BIGINT AS failures, CASE WHEN failed THEN least(300, 30 * power(2, least(n - 1, 6))) ELSE 0 END::BIGINT AS delay FROM f""")
def breaker_state(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("value") > 60).alias("failed"))
    return governor.breaker(e, "user_id", ["ts", "event_id"], "failed").select("event_id", "user_id", "failures", "delay")


def calls(events):
    """Events as calls of devices: the value in tens of seconds, and a speed by event_id."""
    return events.select(F.col("user_id").cast("string").alias("device"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (F.col("value") * 10).alias("seconds"), (F.col("event_id") % 17).cast("double").alias("speed")).withColumn("at", F.col("us") / 1e6).drop("us")


@rows_only
def workload_cooldown(spark, sf):
    ship(spark)
    return governor.workload(calls(_t(spark, sf, "events")))


@query("""SELECT o_orderkey, CASE WHEN status IS NULL THEN 'chunks_not_built' WHEN status <> 'completed' THEN 'chunks_' || status WHEN recorded <> current THEN 'chunks_stale_input' WHEN rule <> 'v1' THEN 'chunks_stale_rules' WHEN NOT outputs THEN 'chunks_outputs_missing' END AS reason FROM (
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' END AS status, (o_custkey % 5)::VARCHAR AS recorded, (o_orderkey % 5)::VARCHAR AS current, 'v' || o_orderkey % 2 AS rule, o_orderkey % 3 > 0 AS outputs FROM orders)""")
def stage_freshness(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running")
    why = freshness.stale_reason("chunks", status, (F.col("o_custkey") % 5).cast("string"), (k % 5).cast("string"), F.concat(F.lit("v"), (k % 2).cast("string")), F.lit("v1"), k % 3 > 0)
    return _t(spark, sf, "orders").select("o_orderkey", why.alias("reason"))


def _candidates(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text"), "source")
    q = _asked(spark, sf).withColumnRenamed("text", "question")
    return _lexical(spark, sf, 60).select("query_id", "id", "score", "rank").join(q, "query_id").join(d, "id")


@rows_only
def feature_rerank(spark, sf):
    """The lexical candidates (six for each of ten results) by their scores with features."""
    none = F.expr("cast(array() AS array<string>)")
    c = features.score_features(_candidates(spark, sf).withColumns({"headings": none, "content_type": F.lit("prose"), "stitched": F.lit(False)}))
    c = c.withColumn("final", F.round(F.col("score") + F.col("features"), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("final"), "id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 10 AND final > 0").select("query_id", F.col("id").alias("doc_id"), "final", "place")


@rows_only
def identifier_guard(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    fused = _fused(spark, sf).where("rank <= 20").select("query_id", "id", "rank").join(d, "id", "left")
    top = _candidates(spark, sf).where("rank = 1").select("query_id", "id", "text", "question")
    return features.guard_identifiers(fused, top, "query_id", "id")


QUERIES, SQL = catalog.QUERIES, catalog.SQL
