"""Catalog queries on answers, sources, claims, evaluation by group, and small text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import lexical as x
from lodestone.operators import grounding as gr
from lodestone.plans.catalog import _TOKS, _t, query
from lodestone.plans.inputs import view

#: Answers whose values and parts come from an order; the sources below hold some of them.
_SAID = [
    "The pump runs at {v} V [S1]. It lifts the valve housing {n} slowly [s2].",
    "Set pressure to {v} bar [S1].\n- Tighten flange bolts evenly now [V1]",
    "Not enough information in the retrieved sources.",
    "The governor drive shaft {n} turns freely. Yes.",
    "Use part AB-12 of the pump housing [S9]",
    "Clean oil filter bowl {n} monthly here [S2].",
    "Pump P-7 shown {n} [V1].",
]
_FILLED = " ".join(f"WHEN {k} THEN concat('" + t.replace("{v}", "', v, '").replace("{n}", "', n, '") + "')" for k, t in enumerate(_SAID))
_FROM_ORDERS = "FROM (SELECT o_orderkey, CAST(o_custkey % 4 + 22 AS STRING) AS v, CAST(o_orderkey % 3 + 22 AS STRING) AS w, CASE WHEN o_orderstatus = 'F' THEN 'forward' WHEN o_orderpriority < '3' THEN 'starboard' ELSE 'amidships' END AS n FROM orders) x"
_ANSWERS = f"SELECT o_orderkey AS id, CASE o_orderkey % 8 {_FILLED} END AS answer {_FROM_ORDERS}"
_SOURCES = f"""SELECT o_orderkey AS id, 'S1' AS label, 'Pumps' AS heading, concat('The pump runs on ', w, 'V supply at ', w, ' bar') AS text, '' AS seen {_FROM_ORDERS} UNION ALL SELECT o_orderkey AS id, 'S2' AS label, 'Valve' AS heading, CASE WHEN o_orderkey % 3 = 0 THEN concat('lifts the valve housing ', n) ELSE 'nothing of note' END AS text, '' AS seen {_FROM_ORDERS}
UNION ALL SELECT o_orderkey AS id, 'V1' AS label, '' AS heading, 'drawing of pump P-7 shown and flange bolts' AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'P-7|shown' ELSE 'bolts' END AS seen FROM orders"""


def _answers(spark, sf):
    s = view(spark, sf, _SOURCES)
    return view(spark, sf, _ANSWERS), s.withColumn("visible_text", F.filter(F.split("seen", r"\|"), lambda v: v != ""))


_STOP = ", ".join(f"'{w}'" for w in gr.STOPWORDS)
_W = "list_distinct(list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z][A-Za-z0-9_/-]{{2,}}'), lambda w: lower(w)), lambda w: w NOT IN (" + _STOP + ")))"
_CR = "list_distinct(list_transform(regexp_extract_all({c}, '(?i)\\d+(?:\\.\\d+)?\\s*(?:V|bar)\\b|\\b(?:AB-12|P-7)\\b'), lambda w: lower(regexp_replace(w, '\\s+', '', 'g'))))"
_CLAIMS = f"""a AS ({_ANSWERS}), s AS ({_SOURCES}), g AS (SELECT id, generate_subscripts(p, 1) - 1 AS place, unnest(p) AS said, answer = 'Not enough information in the retrieved sources.' AS lacking FROM (SELECT id, answer, list_filter(string_split_regex(replace(regexp_replace(answer, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(1)), chr(1)), lambda z: trim(z) <> '') AS p FROM a WHERE answer IS NOT NULL)),
c AS (SELECT id, place, lacking, list_distinct(list_transform(regexp_extract_all(said, '\\[([SVsv]\\d+)\\]', 1), lambda l: upper(l))) AS labels, trim(regexp_replace(regexp_replace(said, '\\[[SVsv]\\d+\\]', '', 'g'), '^\\s*[-*]\\s*', '')) AS claim FROM g),
d AS (SELECT *, {_W.format(c='claim')} AS words, {_CR.format(c='claim')} AS critical FROM c), e AS (SELECT * FROM d WHERE len(critical) > 0 OR len(words) >= 3),
l AS (SELECT e.id, e.place, count(*) FILTER (WHERE s.id IS NULL) AS unknown, string_agg(CASE WHEN s.label = 'V1' THEN replace(seen, '|', ' ') ELSE heading || ' ' || text END, ' ') AS exact, string_agg(CASE WHEN s.label = 'V1' THEN replace(seen, '|', ' ') || ' ' || text ELSE heading || ' ' || text END, ' ') AS general
FROM (SELECT id, place, unnest(labels) AS label FROM e) e LEFT JOIN s ON s.id = e.id AND s.label = e.label GROUP BY e.id, e.place),
m AS (SELECT e.*, unknown, list_filter(critical, lambda t: NOT contains(lower(regexp_replace(coalesce(exact, ''), '\\s+', '', 'g')), t)) AS missing, len(list_intersect(words, {_W.format(c='general')})) AS shared, len(words) AS n FROM e LEFT JOIN l USING (id, place)),
r AS (SELECT id, place, missing, n, shared, CASE WHEN lacking THEN 'insufficient_evidence_statement' WHEN unknown > 0 THEN 'invalid_citation' WHEN len(labels) = 0 THEN 'missing_claim_citation' WHEN len(missing) > 0 THEN 'critical_token_not_in_cited_source' WHEN NOT CASE WHEN n <= 4 THEN shared >= 1 ELSE shared >= 2 AND shared::DOUBLE / n >= 0.25 END THEN 'weak_claim_source_overlap' ELSE 'supported' END AS reason FROM m)"""


@query(f"WITH {_CLAIMS} SELECT id, place::BIGINT AS place, reason IN ('supported', 'insufficient_evidence_statement') AS supported, reason, array_to_string(missing, ',') AS missing, round_even(CASE WHEN n > 0 THEN shared::DOUBLE / n ELSE 1 END, 3) AS coverage FROM r")
def claim_audit(spark, sf):
    c = gr.claims(*_answers(spark, sf))
    return c.select("id", F.col("place").cast("long").alias("place"), "supported", "reason", F.array_join("missing", ",").alias("missing"), "coverage")


@query(f"""WITH {_CLAIMS}, k AS (SELECT a.id, coalesce(len(labels), 0) AS n, labels, coalesce(answer = 'Not enough information in the retrieved sources.', false) AS lacking FROM (SELECT id, answer, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[([SVsv]\\d+)\\]', 1), lambda l: upper(l))) AS labels FROM a) a),
v AS (SELECT id, lacking, len(list_filter(labels, lambda z: z IN ('S1', 'S2', 'V1'))) AS valid, len(list_filter(labels, lambda z: z NOT IN ('S1', 'S2', 'V1'))) AS invalid FROM k), p AS (SELECT id, count(*) AS claims, count_if(reason IN ('supported', 'insufficient_evidence_statement')) AS supported FROM r GROUP BY id)
SELECT v.id, valid::BIGINT AS valid, invalid::BIGINT AS invalid, coalesce(claims, 0)::BIGINT AS claims, coalesce(supported, 0)::BIGINT AS supported, invalid = 0 AND (lacking OR (valid > 0 AND coalesce(claims, 0) > 0 AND claims = supported)) AS grounded FROM v LEFT JOIN p ON p.id = v.id""")
def answer_audit(spark, sf):
    return gr.audit(*_answers(spark, sf)).select("id", "valid", "invalid", "claims", "supported", "grounded")


_RESULTS = """SELECT l_orderkey AS question, n AS rank, l_suppkey % 3 AS book, l_partkey % 30 AS chunk, CASE WHEN l_partkey % 6 = 0 THEN ' ' ELSE 'text' END AS text, CASE WHEN n > 4 THEN n - 4 END AS neighbour_of, CASE WHEN l_orderkey % 4 = 0 THEN 'Compare both manuals' ELSE 'How is it set' END AS asked
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS n FROM lineitem) x"""
_SEEN = "SELECT l_orderkey AS question, n AS rank, l_suppkey % 3 AS book, l_partkey % 90 AS chunk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_linenumber) AS INT) AS n FROM lineitem WHERE l_partkey % 3 = 0) x"


@query(f"""WITH r AS ({_RESULTS}), p AS ({_SEEN}), f AS (SELECT question, arg_min(book, rank) AS anchor, min(rank) AS best, regexp_matches(min(asked), '(?i)compare') AS across FROM r WHERE neighbour_of IS NULL GROUP BY question),
t AS (SELECT r.question, book, chunk, rank, CASE WHEN neighbour_of IS NULL AND rank = best THEN 0 WHEN neighbour_of = best AND NOT across THEN 1 WHEN neighbour_of IS NULL AND (across OR book = anchor) THEN 2 END AS tier, across FROM r JOIN f USING (question) WHERE trim(text) <> ''),
o AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question, book, chunk ORDER BY tier, rank) = 1), k AS (SELECT question, least(2, count(*)) AS kept FROM p GROUP BY question), s AS (SELECT o.*, row_number() OVER (PARTITION BY o.question ORDER BY tier, rank, chunk) AS place, coalesce(kept, 0) AS kept FROM o LEFT JOIN k ON k.question = o.question)
SELECT question, 'S' || place AS label, book, chunk, CASE tier WHEN 0 THEN 'top_result' WHEN 1 THEN 'adjacent_context' ELSE CASE WHEN across THEN 'cross_book_result' ELSE 'same_book_result' END END AS role FROM s WHERE place <= greatest(1, 5 - kept)
UNION ALL SELECT question, 'V' || n, book, chunk, 'visual' FROM (SELECT p.question, book, chunk, row_number() OVER (PARTITION BY p.question ORDER BY rank) AS n FROM p JOIN f ON f.question = p.question WHERE across OR book = anchor) WHERE n <= 2""")
def generation_packet(spark, sf):
    return gr.packet(view(spark, sf, _RESULTS), view(spark, sf, _SEEN))


@query("""SELECT conv_id, 'QUESTION:' || chr(10) || 'What is said?' || chr(10) || chr(10) || 'SOURCE EXCERPTS:' || chr(10) || string_agg('[S' || (turn + 1) || '] Book: manual ' || conv_id || ' | Page: ' || CASE WHEN turn % 2 = 0 THEN turn || ', ' || (turn + 1) ELSE 'unknown' END || ' | Chunk: ' || CASE WHEN turn % 3 = 0 THEN 'unknown' ELSE 'c' || turn END || CASE WHEN role = 'user' THEN ' | Heading: Talk > ' || role ELSE '' END || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def grounded_prompt(spark, sf):
    n = F.col("turn").cast("string")
    pages = F.when(F.col("turn") % 2 == 0, F.array("turn", F.col("turn") + 1)).otherwise(F.expr("cast(array() AS array<bigint>)"))
    heads = F.when(F.col("role") == "user", F.array(F.lit("Talk"), F.lit(" "), F.col("role"))).otherwise(F.expr("cast(array() AS array<string>)"))
    b = gr.block(F.concat(F.lit("S"), (F.col("turn") + 1).cast("string")), F.concat(F.lit("manual "), F.col("conv_id").cast("string"), F.lit(".PDF")), pages, F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("c"), n)), heads, F.col("text"))
    c = _t(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", F.struct("turn", b.alias("block")).alias("b"))
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b")).select("conv_id", gr.prompt(F.lit(" What is said? "), F.col("b.block")).alias("prompt"))


_KINDS = "CASE doc_id % 5 WHEN 0 THEN 'value' WHEN 1 THEN 'procedure' WHEN 2 THEN 'safety' WHEN 3 THEN 'definition' ELSE 'other' END"
_SHOWN = "CASE WHEN text IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN substr(text, 1, 40) || ' check, open and close 7 danger means' ELSE substr(text, 1, 40) END"


@query(f"""WITH d AS (SELECT doc_id, {_KINDS} AS k, lower(coalesce({_SHOWN}, '')) AS t FROM documents) SELECT doc_id, CASE k WHEN 'value' THEN CASE WHEN regexp_matches(t, '[0-9]') THEN 1.0 ELSE 0.0 END
WHEN 'procedure' THEN least(3.0, 0.5 * len(list_intersect(list_distinct(regexp_split_to_array(t, '[^a-z]+')), ['check', 'inspect', 'adjust', 'test', 'replace', 'remove', 'install', 'verify', 'open', 'close']))) WHEN 'safety' THEN CASE WHEN regexp_matches(t, '\\b(warning|caution|danger|hazard|isolate|disconnect)\\b') THEN 2.0 ELSE 0.0 END
WHEN 'definition' THEN CASE WHEN regexp_matches(t, '\\b(is used to|purpose|function|means|consists|comprises)\\b') THEN 1.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS evidence FROM d""")
def intent_evidence(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", gr.intent_evidence(F.expr(_SHOWN), F.expr(_KINDS)).alias("evidence"))


_TIES = "SELECT l_orderkey AS query, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity) AS INT) AS rank, l_partkey % 4 AS evidence FROM lineitem"


@query(f"""WITH t AS ({_TIES}), s AS (SELECT *, floor((rank - 1) / 2)::INT AS island FROM t) SELECT query, rank, row_number() OVER (PARTITION BY query ORDER BY island, evidence DESC, rank) AS place FROM s""")
def intent_tie_break(spark, sf):
    # Scores fall by 3e-5 from rank to rank, so islands of 4e-5 hold two.
    t = view(spark, sf, _TIES).withColumn("score", 0.03 - F.col("rank") * F.lit(3e-5))
    return gr.tie_break(t).select("query", "rank", F.col("place").cast("long").alias("place"))


_CASES = """SELECT o_orderkey AS kase, concat('g', CAST(o_custkey % 5 AS STRING)) AS grp, o_orderkey % 6 > 0 AS ready, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 10 END AS e_book, CASE WHEN o_orderkey % 3 = 0 THEN concat('t', CAST(o_orderkey % 20 AS STRING)) END AS e_item, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 12 END AS e_page, concat('c', CAST(o_orderkey % 9 AS STRING)) AS e_chunk FROM orders"""
_FOUND = """SELECT l_orderkey AS kase, n AS rank, l_suppkey % 10 AS book, concat('t', CAST(l_partkey % 20 AS STRING)) AS item, l_partkey % 12 AS page, concat('c', CAST(l_suppkey % 9 AS STRING)) AS chunk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS n FROM lineitem) x"""


@query(f"""WITH c AS ({_CASES}), f AS ({_FOUND}), h AS (SELECT kase, min(rank) AS rank FROM c JOIN f USING (kase) WHERE ready AND (e_book IS NULL OR e_book = book) AND CASE WHEN e_item IS NOT NULL THEN e_item = item WHEN e_page IS NOT NULL THEN e_page = page ELSE e_chunk = chunk END GROUP BY kase)
SELECT grp, count(*) AS cases, count_if(NOT ready)::BIGINT AS skipped, round_even(100 * avg(CASE WHEN ready THEN CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END END), 2) AS hit_1, round_even(100 * avg(CASE WHEN ready THEN CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END END), 2) AS hit_5, round_even(avg(CASE WHEN ready THEN coalesce(1.0::DOUBLE / rank, 0) END), 5) AS mrr FROM c LEFT JOIN h USING (kase) GROUP BY grp""")
def eval_by_group(spark, sf):
    none = lambda t: F.expr(f"cast(array() AS array<{t}>)")
    c = view(spark, sf, _CASES).select(F.col("kase").alias("case"), "grp", "ready", "e_book", F.when(F.col("e_item").isNotNull(), F.array("e_item")).otherwise(none("string")).alias("e_items"), F.when(F.col("e_page").isNotNull(), F.array("e_page")).otherwise(none("bigint")).alias("e_pages"), "e_chunk")
    f = view(spark, sf, _FOUND).select(F.col("kase").alias("case"), "rank", "book", F.array("item").alias("items"), F.array("page").alias("pages"), "chunk")
    return gr.evaluate(f, c, "grp", [1, 5])


@query(f"""WITH b AS (SELECT item_id AS id, text AS question, concat('s', item_id % 3) AS source, CASE WHEN item_id % 2 = 0 THEN 'note' END AS note FROM benchmark UNION ALL SELECT item_id + 1000, 'The ' || text, concat('s', item_id % 4), ' ' FROM benchmark), k AS (SELECT *, array_to_string({_TOKS.format(c='question')}, ' ') AS key FROM b)
SELECT min(id) AS id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, coalesce(arg_max(note, id) FILTER (WHERE trim(note) <> ''), arg_max(coalesce(note, '?'), id)) AS note FROM k GROUP BY key""")
def merge_benchmark_cases(spark, sf):
    b = _t(spark, sf, "benchmark")
    k = F.col("item_id")
    name = lambda n: F.concat(F.lit("s"), (k % n).cast("string"))
    old = b.select(k.alias("id"), F.col("text").alias("question"), name(3).alias("source"), F.when(k % 2 == 0, "note").alias("note"))
    new = b.select((k + 1000).alias("id"), F.concat(F.lit("The "), F.col("text")).alias("question"), name(4).alias("source"), F.lit(" ").alias("note"))
    return gr.merge_cases(old, new).select("id", F.array_join("sources", ",").alias("sources"), "note")


_PAIR = "SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, concat(lower(split_part(p_name, ' ', 1)), CASE WHEN p_partkey % 5 = 0 THEN 's' WHEN p_partkey % 5 = 1 THEN 'ing' WHEN p_partkey % 5 = 2 THEN 'x' WHEN p_partkey % 5 = 3 THEN '’s' ELSE '' END) AS b FROM part"


@query(f"""WITH p AS ({_PAIR}), q AS (SELECT *, replace(b, '’', '''') AS folded FROM p) SELECT p_partkey, folded, CASE WHEN levenshtein(a, folded) <= 2 THEN levenshtein(a, folded) END::INTEGER AS distance, CASE WHEN length(a) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3)))) END::BIGINT AS grams,
CASE p_partkey % 5 WHEN 0 THEN length(a) >= 5 OR ends_with(a, 's') WHEN 1 THEN length(a) >= 5 WHEN 2 THEN false WHEN 3 THEN true ELSE true END AS same FROM q WHERE regexp_full_match(a, '[a-z]+') AND NOT ends_with(a, 's')""")
def word_pairs(spark, sf):
    p = view(spark, sf, _PAIR).where("a rlike '^[a-z]+$' AND NOT endswith(a, 's')").withColumn("folded", x.lexical_token(F.col("b")))
    return p.select("p_partkey", "folded", x.near(F.col("a"), F.col("folded"), 2).alias("distance"), F.size(x.trigrams(F.col("a"))).cast("long").alias("grams"), x.same_word(F.col("a"), F.col("folded")).alias("same"))


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' � □ Ж' WHEN 1 THEN chr(57344) || chr(7) || 'Ω' ELSE '' END AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '�'))::BIGINT AS replacement, len(regexp_extract_all(t, '\\p{Co}'))::BIGINT AS private, len(regexp_extract_all(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]'))::BIGINT AS control, len(regexp_extract_all(t, '□'))::BIGINT AS square, array_to_string(list_filter([CASE WHEN regexp_matches(t, '\\p{Latin}') THEN 'LATIN' END, CASE WHEN regexp_matches(t, '\\p{Cyrillic}') THEN 'CYRILLIC' END, CASE WHEN regexp_matches(t, '\\p{Greek}') THEN 'GREEK' END, CASE WHEN regexp_matches(t, '\\p{Han}') THEN 'HAN' END], lambda z: z IS NOT NULL), ',') AS scripts FROM t""")
def odd_characters(spark, sf):
    tail = F.when(F.col("doc_id") % 4 == 0, " � □ Ж").when(F.col("doc_id") % 4 == 1, "\x07Ω").otherwise("")
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("t")).withColumn("o", x.odd_characters(F.col("t")))
    return d.select("doc_id", "o.replacement", "o.private", "o.control", "o.square", F.array_join(x.scripts(F.col("t")), ",").alias("scripts"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), w AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(before, ''), '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+'), lambda z: lower(z)), lambda z: length(z) >= 2)) AS a, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÖØ-öø-ÿ0-9]+'), lambda z: lower(z)), lambda z: length(z) >= 2)) AS b, string_split(lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))), ' ') AS p FROM c)
SELECT conv_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(a) ELSE 0 END, 6) AS recall, len(list_distinct(list_filter(list_transform(range(1, len(p)), lambda i: CASE WHEN p[i] = p[i + 1] THEN p[i] END), lambda z: z IS NOT NULL)))::BIGINT AS doubled FROM w""")
def shared_and_doubled_words(spark, sf):
    from pyspark.sql import Window

    c = _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    words = F.split(F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))), " ")
    return c.select("conv_id", "turn", F.round(x.recall(F.col("before"), F.col("text")), 6).alias("recall"), F.size(F.array_distinct(x.doubled(words))).cast("long").alias("doubled"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s, lower(concat_ws(chr(10), 'c' || doc_id, 'Head ' || coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS hay, lower('Head ' || coalesce(lang, '')) AS h FROM documents), m AS (SELECT *, (length(hay) - length(replace(hay, 'the', ''))) / 3 AS n1, (length(hay) - length(replace(hay, 'en', ''))) / 2 AS n2 FROM d)
SELECT doc_id, round(CASE WHEN n1 = 0 AND n2 = 0 THEN 0.0::DOUBLE ELSE CASE WHEN contains(hay, 'the en') THEN 100 ELSE 0 END + CASE WHEN n1 > 0 THEN least(12.0::DOUBLE, 2 + n1) + CASE WHEN contains(h, 'the') THEN 5 ELSE 0 END ELSE 0 END + CASE WHEN n2 > 0 THEN least(12.0::DOUBLE, 2 + n2) + CASE WHEN contains(h, 'en') THEN 5 ELSE 0 END ELSE 0 END + 8.0::DOUBLE * ((n1 > 0)::INT + (n2 > 0)::INT) / 2 END, 6) AS score FROM m""")
def browse_scores(spark, sf):
    c = lambda n: F.coalesce(n, F.lit(""))
    d = _t(spark, sf, "documents")
    return d.select("doc_id", F.round(x.browse_score("The en", F.concat(F.lit("c"), F.col("doc_id").cast("string")), F.concat(F.lit("Head "), c("lang")), c("source"), c("text")), 6).alias("score"))


#: Importing it registers its queries.
NAME = __name__
