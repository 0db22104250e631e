"""Catalog queries on tables cut into chunks and on references inside a book."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import references, tables
from lodestone.plans.catalog import _TOKS, query
from lodestone.plans.inputs import CHUNKS, ROWS, SAYINGS, view

_C = f"WITH c AS ({CHUNKS})"
_LINES = "list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_CELLS = "list_transform(string_split(trim(trim({x}), '|'), '|'), lambda y: trim(y))"
_SEP = "(contains({x}, '|') AND len(list_filter(" + _CELLS + ", lambda z: NOT regexp_full_match(z, ':?-{{3,}}:?'))) = 0)"
_ALPHA, _NUM = "len(regexp_extract_all({x}, '\\b[A-Za-z][A-Za-z-]+\\b'))", "len(regexp_extract_all({x}, '[0-9]+'))"
_SHAPED = f"""s AS (SELECT *, {_LINES} AS ls FROM c), h AS (SELECT *, len(ls) >= 2 AND contains(ls[1], '|') AND {_SEP.format(x='ls[2]')} AS head, list_filter(ls[3:], lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS data FROM s),
k AS (SELECT *, len(ls) > 0 AND len(list_filter(ls, lambda x: contains(x, '|'))) >= 0.7 * len(ls) AS mostly, head AND len(data) = 0 AS header_only, head AND len(data) > 0 AND len(list_filter(data, lambda x: NOT contains(x, '|'))) > 0 AS fragment FROM h),
d AS (SELECT *, CASE WHEN header_only THEN 'table_header_only' WHEN fragment THEN 'table_fragment' WHEN mostly OR head OR table_ref IS NOT NULL OR regexp_matches(raw_text, '(?is)\\bitem\\b.{{0,80}}\\bqty\\b.{{0,100}}\\barticle\\b.{{0,120}}\\bdescription\\b') THEN 'table' ELSE 'prose' END AS kind,
{_ALPHA.format(x='raw_text')} AS alpha, {_NUM.format(x='raw_text')} AS numeric, len({_TOKS.format(c='raw_text')}) AS searchable FROM k)"""
_HEADLESS = "(kind <> 'prose' AND numeric >= 4 AND alpha <= 2 AND alpha::DOUBLE / greatest(1, alpha + numeric) < 0.20)"
_BARE = "trim({x}, '|')"
_HEADER = f"coalesce(list_reduce(list_prepend({{{{'score': -1, 'cells': []::VARCHAR[]}}}}, list_transform(ls, lambda x: {{{{'score': CASE WHEN contains(x, '|') AND NOT {_SEP.format(x='x')} AND {_ALPHA.format(x='x')} >= 2 THEN {_ALPHA.format(x='x')} * 10 + len(list_filter({_CELLS.format(x='x')}, lambda z: z <> '')) - {_NUM.format(x='x')} ELSE -1 END, 'cells': list_filter({_CELLS.format(x='x')}, lambda z: z <> '')}}}})), lambda a, b: CASE WHEN b.score > a.score THEN b ELSE a END).cells, []::VARCHAR[])".replace("{{", "{").replace("}}", "}")


def _chunks(spark, sf):
    return tables.describe(view(spark, sf, CHUNKS).withColumn("repetition", F.lit(0.0)), 512)


@query(f"""{_C}, {_SHAPED} SELECT chunk_id, kind, mostly OR head AS table_like, alpha::BIGINT AS alpha, numeric::BIGINT AS numeric, array_to_string({_HEADER}, ';') AS header, {_HEADLESS} AS headless FROM d""")
def table_shapes(spark, sf):
    c = _chunks(spark, sf)
    return c.select("chunk_id", "kind", F.col("shape.table_like").alias("table_like"), F.col("labels.alpha").cast("long").alias("alpha"), F.col("labels.numeric").cast("long").alias("numeric"), F.array_join(tables.header_cells(F.col("raw_text")), ";").alias("header"), ((F.col("kind") != "prose") & tables.headless(F.col("labels"))).alias("headless"))


@query(f"""{_C}, {_SHAPED}, f AS (SELECT *, {_HEADLESS} AS headless, trim(raw_text) <> '' AND searchable >= 2 AND kind <> 'table_header_only' AS eligible FROM d)
SELECT chunk_id, eligible, searchable::BIGINT AS searchable, greatest(0, least(100 - 20 * (n_tokens > 512)::INT - 8 * (table_ref IS NULL)::INT - 12 * (kind = 'table_fragment')::INT - 35 * headless::INT - 35 * (searchable < 2)::INT, CASE WHEN eligible THEN 100 ELSE 45 END))::BIGINT AS quality,
array_to_string(list_filter([CASE WHEN n_tokens > 512 THEN 'OVERSIZED_CHUNK' END, CASE WHEN table_ref IS NULL THEN 'NO_ITEM_REFERENCE' END, CASE WHEN kind = 'table_fragment' THEN 'TABLE_FRAGMENT' END, CASE WHEN kind = 'table_header_only' THEN 'TABLE_HEADER_ONLY' END, CASE WHEN headless THEN 'TABLE_DATA_WITHOUT_HEADER' END, CASE WHEN searchable < 2 THEN 'TOO_LITTLE_SEARCHABLE_TEXT' END], lambda w: w IS NOT NULL), ',') AS warnings FROM f""")
def table_chunk_metadata(spark, sf):
    return _chunks(spark, sf).select("chunk_id", "eligible", F.col("searchable").cast("long").alias("searchable"), F.col("quality").cast("long").alias("quality"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""{_C}, {_SHAPED}, x AS (SELECT *, {_HEADER} AS header, {_HEADLESS} AS headless FROM d), p AS (SELECT a.chunk_id, a.chunk_index, a.page, a.kind, a.headless, max(b.chunk_index) AS at FROM x a JOIN x b ON b.book = a.book AND b.table_ref = a.table_ref AND b.chunk_index < a.chunk_index AND len(b.header) > 0 GROUP BY ALL)
SELECT p.chunk_id, b.chunk_id AS anchor, (p.chunk_index - b.chunk_index)::BIGINT AS distance, array_to_string(b.header, ';') AS cells, p.page > b.page OR p.kind IN ('table_fragment', 'table_header_only') OR p.headless AS continuation
FROM p JOIN x b ON b.chunk_id = split_part(p.chunk_id, '-', 1) || '-' || p.at WHERE p.chunk_index - b.chunk_index <= 8 AND p.page - b.page BETWEEN 0 AND 1""")
def table_context(spark, sf):
    c = tables.with_context(_chunks(spark, sf)).where("anchor IS NOT NULL")
    return c.select("chunk_id", "anchor", F.col("distance").cast("long").alias("distance"), F.array_join("anchor_cells", ";").alias("cells"), "continuation")


_CLEAN = f"array_to_string(list_filter(ls, lambda x: NOT {_SEP.format(x='x')} AND trim(trim(x, '|')) <> '' AND NOT regexp_full_match(x, '[-:| ]{{3,}}') AND lower(regexp_replace(trim(trim(x, '|')), '[ \\t]+', ' ', 'g')) <> lower(array_to_string(cells, ' | '))), chr(10))"


@query(f"""{_C}, {_SHAPED}, x AS (SELECT *, {_HEADER} AS header, kind IN ('table_header_only', 'table_fragment') OR {_HEADLESS} OR starts_with(trim(raw_text), '---') AS torn FROM d WHERE table_ref IS NOT NULL),
b AS (SELECT *, coalesce(NOT (chunk_index = lag(chunk_index) OVER w + 1 AND page - lag(page) OVER w BETWEEN 0 AND 1), true)::INT AS new FROM x WINDOW w AS (PARTITION BY book, table_ref ORDER BY page, chunk_index)), i AS (SELECT *, sum(new) OVER (PARTITION BY book, table_ref ORDER BY page, chunk_index) AS island FROM b),
g AS (SELECT book, table_ref, island, min(page) AS p, max(page) AS q, count(*) AS n, arg_max(header, len(header) * 100000 - chunk_index) AS cells FROM i GROUP BY ALL HAVING count(*) >= 2 AND bool_or(torn) AND max(len(header)) > 0),
t AS (SELECT i.*, g.cells, g.p, g.q, g.n, {_CLEAN.replace('{{', '{').replace('}}', '}')} AS piece FROM i JOIN g USING (book, table_ref, island)),
hd AS (SELECT book, table_ref, island, string_agg(heading, ' > ' ORDER BY first) AS heads FROM (SELECT book, table_ref, island, heading, min(chunk_index) AS first FROM t GROUP BY ALL) GROUP BY ALL),
r AS (SELECT t.book, t.table_ref, t.island, any_value(cells) AS cells, any_value(p) AS p, any_value(q) AS q, any_value(n) AS n, string_agg(piece, chr(10) ORDER BY chunk_index) FILTER (WHERE piece <> '') AS body, string_agg(chunk_id, ',' ORDER BY chunk_index) FILTER (WHERE piece <> '') AS sources FROM t GROUP BY t.book, t.table_ref, t.island)
SELECT r.book, printf('TBL-%06d-P%04d-001', split_part(table_ref, '/', 3)::INT, p) AS evidence_id, 'Section: ' || heads || chr(10) || 'Table columns: ' || array_to_string(cells, ' | ') || chr(10) || body AS text, sources, n AS n_chunks, q > p AS cross_page FROM r JOIN hd USING (book, table_ref, island) WHERE body IS NOT NULL""")
def stitched_table_evidence(spark, sf):
    return tables.stitched(_chunks(spark, sf), 512).select("book", "evidence_id", "text", "sources", F.col("n_chunks").cast("long").alias("n_chunks"), "cross_page")


@query(f"""WITH s AS ({SAYINGS}), x AS (SELECT o_orderkey, list_transform(regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?(?:instruction\\s+)?["“”'']([^"“”'']{{2,140}})["“”''](?:\\s*,?\\s*(?:in|under)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))?', 1), lambda t: t) AS t1,
regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?(?:instruction\\s+)?["“”'']([^"“”'']{{2,140}})["“”''](?:\\s*,?\\s*(?:in|under)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))?', 2) AS s1,
regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?(?:instruction\\s+)?(?:under|in)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)\\s*[,;:]?\\s*["“”'']([^"“”'']{{2,140}})["“”'']', 2) AS t2, regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?(?:instruction\\s+)?(?:under|in)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)\\s*[,;:]?\\s*["“”'']([^"“”'']{{2,140}})["“”'']', 1) AS s2,
regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?([A-Za-z][A-Za-z0-9 /&()_-]{{2,100}}?)(?:\\s*,?\\s*(?:in|under)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))(?:[.;,]|$)', 1) AS t3, regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:the\\s+)?([A-Za-z][A-Za-z0-9 /&()_-]{{2,100}}?)(?:\\s*,?\\s*(?:in|under)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*))(?:[.;,]|$)', 2) AS s3,
regexp_extract_all(said, '(?i)\\b(?:see|refer\\s+to)\\s+(?:instruction\\s+)?(?:in|under)?\\s*(?:section|chapter|clause)\\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)', 1) AS s4 FROM s WHERE said IS NOT NULL),
y AS (SELECT o_orderkey, unnest(list_transform(list_zip(t1 || t2 || t3 || list_transform(s4, lambda z: ''), s1 || s2 || s3 || s4, range(1, len(s1 || s2 || s3 || s4) + 1)), lambda z: {{'t': trim(regexp_replace(z[1], '\\s+', ' ', 'g'), ' .,:;-'), 's': trim(z[2], ' .,:;'), 'n': z[3]}})) AS r FROM x),
z AS (SELECT o_orderkey, CASE WHEN lower(r.t) IN ('instruction', 'instruction in', 'the instruction') THEN '' ELSE r.t END AS t, r.s AS s, r.n AS n FROM y), u AS (SELECT o_orderkey, arg_min(t, n) AS t, arg_min(s, n) AS s, min(n) AS n FROM z WHERE t <> '' OR s <> '' GROUP BY o_orderkey, lower(t), lower(s))
SELECT o_orderkey, string_agg(CASE WHEN t <> '' AND s <> '' THEN t || ' · section ' || s WHEN t <> '' THEN t ELSE 'Section ' || s END, ';' ORDER BY n) AS labels, count(*) AS n FROM u WHERE t <> '' OR NOT EXISTS (SELECT 1 FROM u v WHERE v.o_orderkey = u.o_orderkey AND v.t <> '' AND v.s <> '' AND starts_with(v.s, u.s)) GROUP BY o_orderkey""")
def cross_references(spark, sf):
    # Exploded from an array of one, so that the condition isn't moved below it and the references found twice.
    s = view(spark, sf, SAYINGS).select("o_orderkey", F.explode(F.array(references.cross_references(F.col("said")))).alias("r")).where("size(r) > 0")
    return s.select("o_orderkey", F.array_join("r.label", ";").alias("labels"), F.size("r").cast("long").alias("n"))


_ASKS = "SELECT s_suppkey AS ask, s_suppkey AS book, CASE WHEN s_suppkey % 3 = 0 THEN 'High pressure pumps' WHEN s_suppkey % 3 = 1 THEN 'oil pumps' ELSE '' END AS title, CASE WHEN s_suppkey % 2 = 0 THEN '6.1' ELSE '' END AS section FROM supplier"
_N = "list_distinct({})".format(_TOKS.format(c="{c}"))
_NORM = "array_to_string({}, ' ')".format(_TOKS.format(c="{c}"))


@query(f"""WITH a AS ({_ASKS}), r AS ({ROWS}), n AS (SELECT a.ask, r.*, title, section, {_NORM.format(c='title')} AS nt, {_NORM.format(c='text')} AS nx, {_NORM.format(c='heading')} AS nh, {_N.format(c='title')} AS wanted, {_TOKS.format(c="text || ' ' || heading")} AS has FROM a JOIN r USING (book)),
m AS (SELECT *, CASE WHEN nt = '' THEN 0 ELSE CASE WHEN nh = nt THEN 12.0 WHEN contains(nh, nt) THEN 9.0 ELSE 0.0 END + CASE WHEN contains(nx, nt) THEN 5.0 ELSE 0.0 END + 4.0 * len(list_intersect(wanted, has))::DOUBLE / greatest(1, len(wanted)) END
+ CASE WHEN section = '' THEN 0.0 WHEN regexp_matches(heading, '(^|[^a-zA-Z0-9./:+-])6\\.1($|[^a-zA-Z0-9./:+-])') THEN 2.5 WHEN regexp_matches(text, '(^|[^a-zA-Z0-9./:+-])6\\.1($|[^a-zA-Z0-9./:+-])') THEN 0.5 ELSE 0.0 END AS ref FROM n),
k AS (SELECT *, ref >= greatest(5.0, max(ref) OVER (PARTITION BY ask) - 2.5) AS anchor FROM m), d AS (SELECT k.ask, k.chunk_index, k.ref, k.content_type, k.quality, min(abs(k.page - b.page)) AS pages, min(abs(k.chunk_index - b.chunk_index)) AS chunks FROM k LEFT JOIN k b ON b.ask = k.ask AND b.anchor WHERE k.ref > 0 GROUP BY ALL),
s AS (SELECT ask, chunk_index, round_even((ref + greatest(0.0::DOUBLE, CASE WHEN pages <= 12 THEN 3.2::DOUBLE * (1 - pages / 13.0::DOUBLE) END, CASE WHEN chunks <= 24 THEN 2.2::DOUBLE * (1 - chunks / 25.0::DOUBLE) END) + CASE WHEN content_type = 'prose' THEN 0.25 ELSE 0.0 END) * (0.9::DOUBLE + quality / 100.0::DOUBLE * 0.1::DOUBLE), 4) AS score FROM d)
SELECT * FROM (SELECT ask, chunk_index, score, row_number() OVER (PARTITION BY ask ORDER BY score DESC, chunk_index) AS place FROM s WHERE score > 0) WHERE place <= 5""")
def follow_references(spark, sf):
    rows = view(spark, sf, ROWS).withColumn("headings", F.array("heading"))
    return references.follow(view(spark, sf, _ASKS), rows).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH r AS ({ROWS}) SELECT a.book, a.chunk_index, b.chunk_index AS other, CASE WHEN a.page = b.page AND a.text = b.text THEN 'shared_item' ELSE 'same_heading' END AS relation, row_number() OVER (PARTITION BY a.book, a.chunk_index ORDER BY abs(a.chunk_index - b.chunk_index), b.chunk_index) AS place
FROM r a JOIN r b ON a.book = b.book AND abs(a.chunk_index - b.chunk_index) IN (1, 2) WHERE (a.page = b.page AND a.text = b.text) OR lower(a.heading) = lower(b.heading) QUALIFY place <= 2""")
def structural_neighbours(spark, sf):
    """Neighbours that share an item (here: page and text) or the deepest heading; plain nearness isn't enough."""
    r = view(spark, sf, ROWS).withColumn("items", F.array(F.concat_ws("/", "page", "text")))
    sides = r.select("book", F.explode(F.array(*[F.col("chunk_index") + k for k in (-2, -1, 1, 2)])).alias("chunk_index"), F.col("chunk_index").alias("other"), F.col("items").alias("theirs"), F.col("heading").alias("their_heading"))
    j = r.join(sides, ["book", "chunk_index"])
    relation = F.when(F.arrays_overlap("items", "theirs"), "shared_item").when(F.lower("heading") == F.lower("their_heading"), "same_heading")
    w = Window.partitionBy("book", "chunk_index").orderBy(F.abs(F.col("chunk_index") - F.col("other")), "other")
    return j.withColumn("relation", relation).where("relation IS NOT NULL").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2").select("book", "chunk_index", "other", "relation", "place")


#: Importing it registers its queries.
NAME = __name__
