"""Catalog queries on what a collection holds and still needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import holdings
from lodestone.plans.catalog import _TOKS, query
from lodestone.plans.inputs import CHUNKS, view

NAME = __name__

#: Documents as what is seen in pictures; a question prefers the pages that its number gives.
_PICTURES = "SELECT doc_id AS id, source AS scope, lang AS source, CAST(doc_id % 7 AS INT) AS picture, CAST(doc_id % 40 AS INT) AS p, text FROM documents WHERE source IS NOT NULL"
_ASKED = "SELECT b.item_id AS query_id, d.source AS scope, b.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE d.source IS NOT NULL"


@query(f"""WITH p AS ({_PICTURES}), asked AS ({_ASKED}), d AS (SELECT id, scope, {_TOKS.format(c="text")} AS t FROM p), s AS (SELECT scope, count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM d GROUP BY scope),
q AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest({_TOKS.format(c="text")}) AS term FROM asked) GROUP BY ALL), tf AS (SELECT id, scope, greatest(len(t), 1) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * (1 + 0.15::DOUBLE * (qtf - 1))), 6) AS score FROM tf JOIN df USING (scope, term) JOIN s USING (scope) JOIN q USING (scope, term) GROUP BY ALL),
top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20), a AS (SELECT query_id, top.id, score, source, picture, abs(p - query_id % 40) AS far, abs(p + 1 - query_id % 40) AS far2 FROM top JOIN p USING (id)),
m AS (SELECT *, least(far, far2) AS d FROM a), g AS (SELECT query_id, id, source, picture, score + CASE d WHEN 0 THEN 1.5 WHEN 1 THEN 0.35 ELSE 0 END AS score, CASE d WHEN 0 THEN 'same_page' WHEN 1 THEN 'adjacent_page' ELSE 'query_match' END AS affinity FROM m)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(source, ''), picture, id) AS rank, id, round(score, 4) AS score, affinity FROM g QUALIFY rank <= 3""")
def picture_search(spark, sf):
    """Pictures of the asked machine by their words, moved up on and beside preferred pages. A picture stands on two pages."""
    p = view(spark, sf, _PICTURES).withColumn("pages", F.array(F.col("p"), F.col("p") + 1))
    asked = view(spark, sf, _ASKED)
    return holdings.search_pictures(p, asked, asked.select("query_id", (F.col("query_id") % 40).cast("int").alias("page")))


_IDENTIFIED = f"""SELECT chunk_id, raw_text, ident, concat(raw_text, chr(10), CASE WHEN chunk_index % 2 = 0 THEN 'Phone ' ELSE 'No ' END, ident, '-', part, chr(10), 'tel. ', CASE WHEN chunk_index % 3 = 0 THEN ident ELSE part END) AS with_line FROM (
SELECT chunk_id, chunk_index, raw_text, CASE WHEN n_tokens >= 120 THEN CAST(CAST(n_tokens / 12 AS INT) AS STRING) ELSE '77' END AS ident, concat('x', CAST(n_tokens AS STRING)) AS part FROM ({CHUNKS}) c) d"""


@query(rf"""WITH c AS ({_IDENTIFIED.replace("AS STRING", "AS VARCHAR")}), l AS (SELECT *, string_split(raw_text, chr(10)) AS ls, string_split(with_line, chr(10)) AS ws FROM c)
SELECT chunk_id, len(list_filter(ls, lambda x: contains(x, '|') AND len(list_filter(string_split(regexp_replace(trim(x), '^\|+|\|+$', '', 'g'), '|'), lambda z: lower(trim(z)) = ident)) > 0 AND len(list_filter(string_split(regexp_replace(trim(x), '^\|+|\|+$', '', 'g'), '|'), lambda z: lower(trim(z)) <> ident AND regexp_matches(z, '[A-Za-z]{{2}}'))) > 0)) > 0 AS defines,
-15.0::DOUBLE * len(list_filter(ws, lambda x: regexp_matches(x, '(?i)\b(tel|telephone|fax|phone|mobile|contact|office|address|www|email|e-mail)\b') AND regexp_matches(x, '(^|[^A-Za-z0-9_./:+-])' || ident || '($|[^A-Za-z0-9_./:+-])'))) AS penalty FROM l""")
def identifier_evidence(spark, sf):
    """Whether a chunk's cells define an identifier, and what it loses for identifiers in lines of addresses."""
    c = view(spark, sf, _IDENTIFIED)
    return c.select("chunk_id", holdings.defines_identifier(F.col("raw_text"), F.col("ident")).alias("defines"), holdings.incidental_penalty(F.col("with_line"), F.array("ident")).alias("penalty"))


_SEEN = "SELECT p_size AS book, p_partkey AS picture, CAST(p_partkey % 30 AS INT) AS page, CASE WHEN p_partkey % 5 = 0 THEN 'table' WHEN p_partkey % 5 = 1 THEN 'logo' WHEN p_partkey % 5 = 2 THEN 'flow_chart' ELSE 'photo' END AS a, CAST(p_partkey % 100 AS DOUBLE) / 100 AS x, CASE WHEN p_size % 2 = 0 THEN 'bar_chart' ELSE 'stamp' END AS b, CAST(p_size AS DOUBLE) / 60 AS y, p_partkey % 11 = 0 AS blank FROM part"


@query(f"""WITH s AS ({_SEEN}), b AS (SELECT book, picture, page, CASE WHEN blank THEN NULL WHEN x >= y THEN a ELSE b END AS class, CASE WHEN blank THEN NULL ELSE round(greatest(x, y), 4) END AS confidence FROM s), k AS (SELECT *, coalesce(class IN ('table', 'flow_chart', 'bar_chart'), false) AS inventory FROM b)
SELECT *, confidence IS NULL OR (inventory AND confidence < 0.6) AS review FROM k""")
def picture_inventory(spark, sf):
    """Each picture's class, whether it is technical, and whether a person should look at it."""
    s = view(spark, sf, _SEEN)
    pair = lambda k, c: F.struct(F.col(k).alias("class"), F.col(c).alias("confidence"))
    return holdings.picture_inventory(s.withColumn("predictions", F.when(~F.col("blank"), F.array(pair("a", "x"), pair("b", "y")))), 0.6)


_BOOKS = "SELECT s_suppkey AS book, s_acctbal > 0 AS index_ready, s_suppkey % 90 AS searchable, s_suppkey % 7 AS excluded, s_suppkey % 3 AS oversized, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 5 END AS visuals, s_nationkey AS machine FROM supplier"


@query(f"""WITH b AS ({_BOOKS}), m AS (SELECT machine, bool_and(index_ready) AS ready FROM b GROUP BY machine)
SELECT count(*) AS books, count_if(index_ready)::BIGINT AS indexed, sum(searchable)::BIGINT AS searchable, sum(excluded)::BIGINT AS excluded, sum(oversized)::BIGINT AS oversized, sum(coalesce(visuals, 0))::BIGINT AS visuals, (SELECT count(*) FROM m) AS machines, (SELECT count_if(ready) FROM m)::BIGINT AS machines_ready FROM b""")
def collection_readiness(spark, sf):
    b = view(spark, sf, _BOOKS)
    return holdings.readiness(b.drop("machine"), b.select("machine", "book"))


_ROWS = "SELECT l_orderkey * 10 + l_linenumber AS id, concat('g', CAST(l_suppkey % 3 AS STRING)) AS generation, CASE WHEN l_partkey % 2 = 0 THEN 'text_lane' ELSE 'picture_lane' END AS target, concat('R', CAST(l_partkey AS STRING)) AS route FROM lineitem"
_DONE = "SELECT concat('g', CAST(p_size % 3 AS STRING), ':', CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'vision' END, ':R', CAST(p_partkey AS STRING)) AS entry, CASE WHEN p_size % 4 = 0 THEN 'v1' WHEN p_size % 4 < 3 THEN 'v2' END AS version FROM part"


@query(f"""WITH r AS ({_ROWS}), e AS ({_DONE}), k AS (SELECT *, generation || ':' || CASE target WHEN 'text_lane' THEN 'text' ELSE 'vision' END || ':' || route AS entry FROM r)
SELECT k.id, k.entry, e.version AS seen_version FROM k LEFT JOIN e ON e.entry = k.entry WHERE e.entry IS NULL OR coalesce(e.version, '') <> 'v2'""".replace("AS STRING", "AS VARCHAR"))
def backfill_by_version(spark, sf):
    """Rows whose entry was made under older rules, or not at all."""
    return holdings.backfill_due(view(spark, sf, _ROWS), view(spark, sf, _DONE), "v2").select("id", "entry", "seen_version")


_REFS = "SELECT l_suppkey AS chunk, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 40 END AS entry, CASE WHEN l_partkey % 2 = 0 THEN 'table_cell' ELSE 'text' END AS source_type, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 5 END AS table, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber END AS cell, CASE WHEN l_partkey % 2 = 1 THEN l_partkey % 9 END AS source FROM lineitem"


@query(f"""WITH k AS (SELECT chunk, place, coalesce(entry::VARCHAR, concat_ws(':', source_type, coalesce("table"::VARCHAR, 'None'), coalesce(cell::VARCHAR, 'None'), coalesce(source::VARCHAR, 'None'))) AS key FROM ({_REFS.replace("AS table,", 'AS "table",')})), o AS (SELECT chunk, key, min(place) AS place FROM k GROUP BY ALL)
SELECT chunk, place, key, row_number() OVER (PARTITION BY chunk ORDER BY place, key)::INTEGER AS n FROM o""")
def correction_provenance(spark, sf):
    """The corrections behind each chunk, each once, in the order in which they come."""
    return holdings.provenance(view(spark, sf, _REFS))


_PIECES = "SELECT l_suppkey AS book, l_orderkey AS old, l_linenumber AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem"


@query(f"SELECT book, old, part, cents, i AS chunk_index, printf('CHK-%06d', i + 1) AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY old, part, cents) - 1 AS i FROM ({_PIECES}))")
def chunk_renumbering(spark, sf):
    """Numbers and ids of a book's pieces after some were split."""
    return holdings.renumbered(view(spark, sf, _PIECES), ["old", "part", "cents"])


_REQUESTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS book, CASE WHEN o_orderkey % 4 = 0 THEN '  ' WHEN o_orderkey % 4 = 1 THEN o_clerk END AS machine FROM (SELECT o_orderkey, o_custkey, o_orderpriority AS o_clerk FROM orders) x"


@query(f"SELECT id, CASE WHEN book IS NOT NULL AND trim(coalesce(machine, '')) <> '' THEN 'BOTH_SCOPES' WHEN book IS NULL AND trim(coalesce(machine, '')) = '' THEN 'NO_SCOPE' END AS problem FROM ({_REQUESTS})")
def request_scopes(spark, sf):
    return view(spark, sf, _REQUESTS).select("id", holdings.request_scope(F.col("book"), F.col("machine")).alias("problem"))
