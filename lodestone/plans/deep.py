"""Catalog queries on structure and search: walks of references, reading order, scoped transcriptions, rare spellings, search by machine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import outline, reading, retrieval, scans, scoping, spelling
from lodestone.plans.catalog import _TOKS, _t, _vectors, query
from lodestone.plans.inputs import view
from lodestone.plans.structure import rows_only
from lodestone.session import ship

NAME = __name__

#: A machine is a source of documents; its generations are languages, and its current one is that of most of its documents.
_CURRENT = "SELECT source AS scope, lang AS generation FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang) x WHERE n = 1"
#: Each question asks the machine of the document that bears its number.
_ASKED = "SELECT b.item_id AS query_id, d.source AS scope, b.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id"


@query(f"""WITH cur AS ({_CURRENT}), asked AS ({_ASKED}),
docs AS (SELECT d.doc_id AS id, d.source AS scope, {_TOKS.format(c="d.text")} AS t FROM documents d JOIN cur ON cur.scope = d.source AND cur.generation = d.lang),
sizes AS (SELECT scope, count(*) AS n, avg(len(t)::DOUBLE) AS avgdl FROM docs GROUP BY scope),
q AS (SELECT query_id, scope, term, count(*) AS qtf FROM (SELECT query_id, scope, unnest({_TOKS.format(c="text")}) AS term FROM asked) GROUP BY ALL),
tf AS (SELECT id, scope, greatest(len(t), 1) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
lex AS (SELECT query_id, scope, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.4::DOUBLE / (tf + 1.4::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) * (1 + 0.15::DOUBLE * (qtf - 1))), 6) AS score
    FROM tf JOIN df USING (scope, term) JOIN sizes USING (scope) JOIN q USING (scope, term) GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 60),
u AS (SELECT e.vec_id AS id, d.source AS scope, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v, cur.scope IS NOT NULL AS held FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN cur ON cur.scope = d.source AND cur.generation = d.lang),
x AS (SELECT a.query_id, a.scope, d.id, row_number() OVER (PARTITION BY a.query_id ORDER BY round(list_dot_product(d.v, q.v), 6) DESC, d.id) AS rank FROM asked a JOIN u q ON q.id = a.query_id JOIN u d ON d.scope = a.scope AND d.held AND d.id <> q.id QUALIFY rank <= 60),
j AS (SELECT coalesce(l.query_id, x.query_id) AS query_id, coalesce(l.scope, x.scope) AS scope, coalesce(l.id, x.id) AS id, l.rank AS r1, x.rank AS r2, round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS score
    FROM l FULL JOIN x ON l.query_id = x.query_id AND l.scope = x.scope AND l.id = x.id)
SELECT query_id, scope, id, r1, r2, score, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, least(r1, r2), id) AS rank FROM j QUALIFY rank <= 5""")
def machine_hybrid_search(spark, sf):
    """Questions by text and vector inside their machine's current generation."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("scope"), F.col("lang").alias("generation"), "text")
    vectors = _vectors(spark, sf).join(docs.drop("text"), "id")
    asked = view(spark, sf, _ASKED)
    asked_vectors = _vectors(spark, sf).select("id", "v").join(asked.select(F.col("query_id").alias("id"), "scope"), "id")
    return retrieval.scoped_hybrid(docs, vectors, view(spark, sf, _CURRENT), asked, asked_vectors, 5)


#: The tags of pages as nested references: a tag of a later kind stands inside the last one of an earlier kind before it.
_NESTED = r"(?i)<(body|main|article|section|div|ul|li|p|h[1-6])\b"
_LEVEL = "CASE WHEN tag IN ('body') THEN 1 WHEN tag IN ('main', 'article') THEN 2 WHEN tag = 'section' THEN 3 WHEN tag = 'div' THEN 4 WHEN tag = 'ul' THEN 5 WHEN tag = 'li' THEN 6 ELSE 7 END"


def _tags(spark, sf):
    """page_id, i (order on the page), level of each tag."""
    found = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_NESTED), F.lit(1)), F.lower)
    return _t(spark, sf, "pages").select("page_id", F.posexplode(found).alias("i", "tag")).select("page_id", "i", F.expr(_LEVEL).alias("level"))


def outline_references(spark, sf):
    """book, parent, place, child: each tag inside the last one before it of a lower level; a page's others at its root."""
    t = _tags(spark, sf)
    before = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.greatest(*[F.when(F.col("level") > k, F.coalesce(F.max(F.when(F.col("level") == k, F.col("i"))).over(before), F.lit(-1))).otherwise(-1) for k in range(1, 7)])
    r = t.withColumn("parent", F.when(parent < 0, "root").otherwise(parent.cast("string")))
    place = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("i")) - 1
    return r.select(F.col("page_id").alias("book"), "parent", place.alias("place"), F.col("i").cast("string").alias("child"))


@query(rf"""WITH RECURSIVE tags AS (SELECT page_id, i - 1 AS i, {_LEVEL} AS level FROM (SELECT page_id, generate_subscripts(f, 1) AS i, lower(unnest(f)) AS tag FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_NESTED}', 1) AS f FROM pages))),
p AS (SELECT page_id, i, greatest(*COLUMNS('^k\d$')) AS parent FROM (SELECT page_id, i, {', '.join(f"CASE WHEN level > {k} THEN coalesce(max(CASE WHEN level = {k} THEN i END) OVER w, -1) ELSE -1 END AS k{k}" for k in range(1, 7))} FROM tags WINDOW w AS (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
refs AS (SELECT page_id AS book, parent, row_number() OVER (PARTITION BY page_id, parent ORDER BY i) - 1 AS place, i AS child FROM p),
walk AS (SELECT book, parent, place, child, 0 AS depth, [place] AS path FROM refs WHERE parent = -1 UNION ALL SELECT r.book, r.parent, r.place, r.child, w.depth + 1, list_append(w.path, r.place) FROM walk w JOIN refs r ON r.book = w.book AND r.parent = w.child)
SELECT book, CASE WHEN parent < 0 THEN 'root' ELSE parent::VARCHAR END AS parent, place::INTEGER AS place, child::VARCHAR AS child, row_number() OVER (PARTITION BY book ORDER BY path) AS position, depth::BIGINT AS depth, 'entered' AS kind FROM walk""")
def depth_first_order(spark, sf):
    """Position and depth of each tag of each page in a walk of its nested references."""
    return outline.walk(outline_references(spark, sf))


_ITEMS = """SELECT l_orderkey % 8 AS book, l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS place, 'texts' AS kind, CASE WHEN l_returnflag = 'R' THEN 'page_header' ELSE 'text' END AS label, concat('part ', CAST(l_partkey AS STRING), CASE WHEN l_linestatus = 'F' THEN ':' ELSE '' END) AS text, CAST(NULL AS STRING) AS class,
CASE WHEN l_suppkey % 2 = 0 THEN 50.0D ELSE 340.0D END AS l, CAST(20 + l_quantity * 15 AS DOUBLE) AS t, CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 5 > 0 THEN 260.0D ELSE 550.0D END AS r, CAST(8 + l_quantity * 15 AS DOUBLE) AS b FROM lineitem"""
_PAGES = "SELECT o_orderkey % 8 AS book, o_orderkey AS page, 600.0D AS width, 800.0D AS height FROM orders"
_READ = (
    f"""WITH items AS ({_ITEMS}), pages AS ({_PAGES}), often AS (SELECT book, text FROM items WHERE length(text) BETWEEN 2 AND 120 GROUP BY book, text HAVING count(*) >= greatest(5, ceil(0.05 * (SELECT count(*) FROM pages p WHERE p.book = items.book)))),
tops AS (SELECT *, count_if(t >= 672 AND length(text) <= 40 AND r - l <= 180) OVER (PARTITION BY book, page) >= 3 AND t >= 672 AND length(text) <= 40 AND r - l <= 180 AS is_top FROM items),
c AS (SELECT * FROM tops WHERE NOT is_top AND label <> 'page_header' AND (book, text) NOT IN (SELECT (book, text) FROM often)),
s AS (SELECT book, page, count(*) AS n, count_if(length(text) <= 45) AS short, count_if(text LIKE '%:') AS fields, CASE WHEN count(*) < 3 THEN 'insufficient_comparable_items' WHEN count(*) >= 6 AND count_if(text LIKE '%:') >= 2 THEN 'form_or_title_page' END AS skip FROM c GROUP BY book, page),
k AS (SELECT c.*, row_number() OVER (PARTITION BY page ORDER BY t DESC, l, place) AS row_rank, (l + r) / 2 >= 300 AS on_right, r - l < 372 AS narrow FROM c JOIN s USING (book, page) WHERE s.skip IS NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY page, narrow ORDER BY on_right, t DESC, l, place) AS column_rank FROM k),
two AS (SELECT page, count_if(narrow AND (l + r) / 2 < 282) >= 2 AND count_if(narrow AND (l + r) / 2 > 318) >= 2 AS two FROM m GROUP BY page),
i AS (SELECT a.page, count(*) AS pairs, count_if(a.row_rank > b.row_rank) AS row_n, count_if(a.narrow AND b.narrow) AS narrow_pairs, count_if(a.narrow AND b.narrow AND a.column_rank > b.column_rank) AS column_n FROM m a JOIN m b ON a.page = b.page AND a.place < b.place GROUP BY a.page),
x AS (SELECT i.page, two, row_n / pairs AS row_ratio, CASE WHEN two THEN column_n / narrow_pairs END AS column_ratio, row_n, column_n FROM i JOIN two USING (page)),
y AS (SELECT *, coalesce(column_ratio < row_ratio, false) AS by_column FROM x),
found AS (SELECT s.book, s.page, s.n, s.skip, y.two AS two_columns, row_ratio, column_ratio, CASE WHEN s.skip IS NULL THEN CASE WHEN by_column THEN 'column_major' ELSE 'row_major' END END AS layout, CASE WHEN by_column THEN column_ratio ELSE row_ratio END AS score, (CASE WHEN by_column THEN column_n ELSE row_n END)::BIGINT AS inversions FROM s LEFT JOIN y USING (page)),
flagged AS (SELECT *, skip IS NULL AND score > 0.18 AND inversions >= 3 AS anomaly FROM found)"""
).replace(".0D", ".0::DOUBLE").replace("AS STRING", "AS VARCHAR")


def _read(spark, sf):
    ship(spark)
    return reading.reading_order(view(spark, sf, _ITEMS), view(spark, sf, _PAGES), least=3)


@query(f"{_READ} SELECT book, page, n, skip, two_columns, round(row_ratio, 9) AS row_ratio, round(column_ratio, 9) AS column_ratio, layout, round(score, 9) AS score, inversions, anomaly FROM flagged")
def reading_order(spark, sf):
    """Each page's order against its rows and its columns, from boxes."""
    return _read(spark, sf).withColumns({c: F.round(c, 9) for c in ("row_ratio", "column_ratio", "score")})


@query(f"""{_READ} SELECT p.book, p.pages, count_if(f.page IS NOT NULL AND skip IS NULL)::BIGINT AS checked, count_if(two_columns)::BIGINT AS two_columns, count_if(anomaly)::BIGINT AS anomalies, count_if(f.page IS NOT NULL AND skip IS NULL) / p.pages AS coverage,
CASE WHEN count_if(anomaly) > 0 THEN 'anomaly' WHEN count_if(f.page IS NOT NULL AND skip IS NULL) = 0 THEN 'not_evaluable' WHEN count_if(f.page IS NOT NULL AND skip IS NULL) / p.pages < 0.1 THEN 'limited' ELSE 'consistent' END AS status
FROM (SELECT book, count(*) AS pages FROM pages GROUP BY book) p LEFT JOIN flagged f ON f.book = p.book GROUP BY p.book, p.pages""")
def reading_order_coverage(spark, sf):
    return reading.coverage(_read(spark, sf), view(spark, sf, _PAGES))


@rows_only
def scoped_transcriptions(spark, sf):
    """Each turn of a conversation as target, with a reading that the turns around it have leaked into: theirs are taken off again."""
    ship(spark)
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = _t(spark, sf, "conversations").select("conv_id", "turn", "text", F.lag("text").over(w).alias("b"), F.lead("text").over(w).alias("a"))
    t = t.withColumns({"said": F.concat_ws("\n", "b", "text", "a"), "before": F.array_compact(F.array("b")), "after": F.array_compact(F.array("a"))})
    s = scoping.scope(t, "said", "text", "before", "after")
    return s.select("conv_id", "turn", "scope.accepted", "scope.status", "scope.text", F.array_join("scope.reasons", ",").alias("reasons"), "scope.before_hits", "scope.after_hits", "scope.score")


@rows_only
def misread_spellings(spark, sf):
    """Rare spellings of each source's documents near frequent ones, and where they stand."""
    ship(spark)
    texts = _t(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("item"), "text")
    return spelling.misreadings(texts)


@query(f"""WITH w AS (SELECT source AS book, t AS word, count(*) AS n FROM (SELECT source, unnest({_TOKS.format(c="text")}) AS t FROM documents WHERE source IS NOT NULL) WHERE regexp_full_match(t, '[a-z]+') GROUP BY ALL),
r AS (SELECT * FROM w WHERE n <= 2 AND length(word) >= 6), f AS (SELECT * FROM w WHERE n >= 20 AND length(word) >= 4),
p AS (SELECT r.book, r.word AS rare, r.n AS rare_n, f.word AS frequent, f.n, levenshtein(r.word, f.word) AS edits, greatest(length(r.word), length(f.word)) AS m FROM r JOIN f ON f.book = r.book AND abs(length(r.word) - length(f.word)) <= 2 AND levenshtein(r.word, f.word) BETWEEN 1 AND CASE WHEN greatest(length(r.word), length(f.word)) >= 13 THEN 2 ELSE 1 END),
s AS (SELECT *, {{}} AS a, {{}} AS b FROM p WHERE 1 - edits / m >= 0.84)
SELECT book, rare, rare_n, frequent, n, edits::INTEGER AS edits, round(1 - edits / m, 4) AS likeness FROM s WHERE NOT list_has_any(a, b) QUALIFY row_number() OVER (PARTITION BY book, rare ORDER BY 1 - edits / m DESC, n DESC, edits, frequent DESC) = 1""".format(
    *["list_prepend({0}, list_transform(list_filter(['ingly', 'ation', 'ations', 'tion', 'tions', 'ing', 'ers', 'ies', 'ied', 'ed', 'er', 'es', 's', 'ly', 'd', 'y'], lambda e: ends_with({0}, e) AND length({0}) - length(e) >= 5), lambda e: {0}[1:length({0}) - length(e)]))".format(c) for c in ("rare", "frequent")]
))
def rare_within_two_edits(spark, sf):
    """Rare words of each source with the frequent word (twenty times or more) that they are most alike, up to two edits."""
    ship(spark)
    t = _t(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("book"), F.explode(F.filter(retrieval.tokens(F.col("text")), lambda x: x.rlike("^[a-z]+$"))).alias("word"))
    n = t.groupBy("book", "word").agg(F.count("*").alias("n")).where("n <= 2 OR n >= 20").withColumn("surface", F.col("word"))
    return spelling.near_pairs(n).withColumn("likeness", F.round("likeness", 4))


#: Words of letters and hyphens with the apostrophes beside them: apostrophes are doubled, so that two words can share one.
_ALPHA_RUNS = r"regexp_extract_all(regexp_replace(coalesce(text, ''), '([''’])', '\1\1', 'g'), '([''’]?)([\p{L}\p{N}_-]+)([''’]?)', "
_SHORT = ", ".join(f"'{w}'" for w in scans.SHORT_WORDS)
_FRAGMENTS = f"""runs AS (SELECT doc_id AS id, unnest({_ALPHA_RUNS}1)) AS b, unnest({_ALPHA_RUNS}2)) AS w, unnest({_ALPHA_RUNS}3)) AS a FROM documents),
ws AS (SELECT id, lower(w) AS w, b = '' AND a = '' AND lower(w) NOT IN ({_SHORT}) AND length(w) <= 2 AND NOT regexp_full_match(w, '\\p{{Lu}}') AS frag FROM runs WHERE regexp_full_match(w, '\\p{{L}}+(-\\p{{L}}+)*')),
cs AS (SELECT id, count(*) AS words, count_if(frag AND length(w) = 1) AS singles, count_if(frag) AS short FROM ws GROUP BY id),
rs AS (SELECT id, max(n) AS most, count_if(n >= 2) AS twice FROM (SELECT id, w, count(*) AS n FROM ws WHERE length(w) BETWEEN 2 AND 5 AND w NOT IN ({_SHORT}) GROUP BY id, w) GROUP BY id),
fr AS (SELECT d.doc_id AS id, coalesce(words, 0) AS words, coalesce(singles, 0) AS singles, coalesce(short, 0) AS short, CASE WHEN words >= 8 THEN CASE WHEN singles >= 3 AND singles / words >= 0.15 THEN 'excessive_single_letter_fragments' WHEN singles > 0 AND short >= 3 AND short / words >= 0.20 THEN 'fragmented_alpha_tokens' END END AS broken,
    CASE WHEN words >= 12 AND singles > 0 AND (most >= 3 OR twice >= 2) THEN 'repeated_short_ocr_fragments' END AS repeated FROM documents d LEFT JOIN cs ON cs.id = d.doc_id LEFT JOIN rs ON rs.id = d.doc_id)"""


@query(f"WITH {_FRAGMENTS} SELECT id, words::INTEGER AS words, singles::INTEGER AS singles, short::INTEGER AS short, concat_ws(',', broken, repeated) AS reasons FROM fr")
def text_fragments(spark, sf):
    """How far each document is in fragments: single letters, short pieces, pieces that repeat."""
    texts = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return scans.fragments(texts).withColumn("reasons", F.array_join("reasons", ","))


_WC, _UNIT_NAMES = r"[^\p{L}\p{N}_]", "|".join(scans.UNITS)
_OWN = rf"""own AS (SELECT doc_id AS id, concat_ws(',', CASE WHEN contains(t, chr(65533)) THEN 'unicode_replacement_character' END, CASE WHEN regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_character' END,
CASE WHEN regexp_matches(t, '(^|{_WC})(\d+l\d*|\d*l\d+)($|{_WC})') THEN 'lowercase_l_inside_numeric_token' END, CASE WHEN regexp_matches(t, '(^|{_WC})(\d+([.,]\d+)?\s*(?i:Nrn|rnA|rnV|rnW)|l\s*[AVW])($|{_WC})') THEN 'unit_like_ocr_confusion' END,
CASE WHEN regexp_matches(t, '(^|{_WC})\d+[OoIl]\d+($|{_WC})') THEN 'numeric_letter_ambiguity' END) AS own,
regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_.])([<>≤≥]\s*)?[+-]?\d+([.,]\d+)?(\s*±\s*\d+([.,]\d+)?)?\s*(({_UNIT_NAMES})($|{_WC})|%[\p{{L}}\p{{N}}_])') OR regexp_matches(t, '(?i)(^|{_WC})(less than|greater than|at least|at most|maximum|minimum)($|{_WC})|[<>≤≥]') AS technical
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


@query(f"WITH {_FRAGMENTS}, {_OWN} SELECT * FROM (SELECT id, concat_ws(',', nullif(own, ''), broken, repeated) AS reasons, technical FROM own JOIN fr USING (id)) WHERE reasons <> ''")
def suspicious_texts(spark, sf):
    """Documents that look misread, with every reason, and whether they hold technical values."""
    texts = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return scans.suspicious(texts).withColumn("reasons", F.array_join("reasons", ","))


_BANDS = """SELECT l_suppkey % 20 AS book, l_orderkey % 40 AS page, l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_partkey % 3 = 0 THEN concat('Rev ', CAST(l_partkey AS STRING), ' ', l_returnflag) WHEN l_partkey % 3 = 1 THEN concat(l_linestatus, '-', l_returnflag, 'word-') ELSE l_returnflag END AS text,
CAST(l_quantity * 16 AS DOUBLE) AS t, CAST(l_quantity * 16 - 10 AS DOUBLE) AS b, CASE WHEN l_partkey % 7 = 0 THEN 'TOPLEFT' WHEN l_partkey % 7 = 1 THEN 'bottomleft' END AS origin FROM lineitem"""
_BAND_PAGES = "SELECT DISTINCT l_suppkey % 20 AS book, l_orderkey % 40 AS page, 800.0D AS height FROM lineitem"
_PLACED = f"""WITH items AS ({_BANDS}), pages AS ({_BAND_PAGES}), e AS (SELECT *, CASE WHEN origin = 'TOPLEFT' THEN t ELSE 800 - t END AS y, CASE WHEN origin = 'TOPLEFT' THEN b ELSE 800 - b END AS z FROM items),
i AS (SELECT *, least(y, z) AS upper, greatest(y, z) AS lower FROM e)""".replace(".0D", ".0::DOUBLE").replace("AS STRING", "AS VARCHAR")


@query(f"""{_PLACED} SELECT k.book, band, line, pages, first_page FROM (SELECT book, band, line, count(DISTINCT page) AS pages, min(page) AS first_page FROM (SELECT book, page, CASE WHEN lower < 96 THEN 'top' WHEN upper > 704 THEN 'bottom' END AS band, regexp_replace(lower(text), '\\d+', '#', 'g') AS line FROM i) WHERE band IS NOT NULL GROUP BY ALL) k
JOIN (SELECT book, count(*) AS n FROM pages GROUP BY book) p USING (book) WHERE pages >= greatest(5, ceil(n * 0.2))""")
def running_bands(spark, sf):
    """Lines that run along the top or bottom of a book's pages."""
    return scans.running_bands(view(spark, sf, _BANDS), view(spark, sf, _BAND_PAGES))


@query(f"{_PLACED} SELECT book, page, place, text AS line FROM i WHERE lower > 600 AND text LIKE '%word-' AND (book, page + 1) IN (SELECT (book, page) FROM pages)")
def words_broken_over_pages(spark, sf):
    return scans.broken_words(view(spark, sf, _BANDS), view(spark, sf, _BAND_PAGES))


_TABLES = "SELECT l_suppkey % 10 AS book, l_orderkey AS id, CAST(l_orderkey % 3 AS INT) AS captions, l_linenumber AS n, l_extendedprice AS x, concat(' ', l_returnflag, '  ', l_linestatus) AS text, l_linenumber <= 2 AND l_partkey % 4 > 0 AS header FROM lineitem"


@query(f"""WITH c AS ({_TABLES}), t AS (SELECT book, id, captions, coalesce(list(trim(regexp_replace(text, '\\s+', ' ', 'g')) ORDER BY n, x) FILTER (WHERE header), []) AS headers FROM c GROUP BY ALL),
k AS (SELECT *, CASE WHEN len(headers) > 0 THEN count(*) OVER (PARTITION BY book, headers) ELSE 0 END AS repeats FROM t)
SELECT * FROM (SELECT book, id, array_to_string(headers, '|') AS headers, repeats, CASE WHEN len(headers) = 0 THEN 'TABLE_WITHOUT_MARKED_HEADER' WHEN repeats >= 5 AND captions = 0 THEN 'REPEATED_TABLE_NEEDS_CONTEXT' END AS finding FROM k) WHERE finding IS NOT NULL""")
def header_signatures(spark, sf):
    """Tables without headers, and those whose headers repeat in a book without a caption to tell them apart."""
    cells = F.array_sort(F.collect_list(F.struct("n", "x", "text", "header")))
    t = view(spark, sf, _TABLES).groupBy("book", "id", "captions").agg(F.transform(cells, lambda c: F.struct(c["text"].alias("text"), c["header"].alias("header"))).alias("cells"))
    return scans.header_signatures(t).withColumn("headers", F.array_join("headers", "|"))


#: A conversation as a book, a turn as a page; the source of every fifth turn is another turn, some lack a page, some pages are wider, some hold an image alone.
_BOOK = "SELECT conv_id AS book, turn AS page, 0 AS place, CASE WHEN turn % 7 = 3 THEN '' ELSE text END AS text, 600.0D AS width, 800.0D AS height FROM conversations"
_SOURCE = """SELECT conv_id AS book, turn AS page, CASE WHEN turn % 7 = 3 THEN 'few words' WHEN turn % 5 = 2 THEN lag(text) OVER (PARTITION BY conv_id ORDER BY turn) ELSE text END AS text, CASE WHEN conv_id % 6 = 1 THEN 660.0D ELSE 600.0D END AS width, 800.0D AS height, CAST(turn % 7 AS INT) AS images FROM conversations
WHERE conv_id % 9 > 0 OR turn > 0"""


@query(
    f"""WITH m AS ({_BOOK}), s AS ({_SOURCE}), n AS (SELECT a.book, mine, theirs FROM (SELECT book, count(*) AS mine FROM m GROUP BY book) a JOIN (SELECT book, count(*) AS theirs FROM s GROUP BY book) b USING (book)),
v AS (SELECT s.book, s.page, s.width, s.height, s.images, m.width AS w, lower(coalesce(m.text, '')) AS held, list_filter(regexp_split_to_array(lower(coalesce(s.text, '')), '\\s+'), lambda x: regexp_full_match(x, '\\p{{L}}+')) AS words FROM s JOIN n ON n.book = s.book AND mine = theirs LEFT JOIN m ON m.book = s.book AND m.page = s.page),
x AS (SELECT *, len(list_filter(list_distinct(words), lambda x: contains(held, x))) / len(list_distinct(words)) AS covered, length(regexp_replace(held, '\\s+', '', 'g')) AS chars FROM v)
SELECT book, NULL::BIGINT AS page, 'pdf_page_count_mismatch' AS finding, (theirs - mine)::DOUBLE AS measure FROM n WHERE mine <> theirs UNION ALL SELECT book, page, 'pdf_geometry_mismatch', abs(w - width) / width FROM x WHERE abs(w - width) / width > 0.05
UNION ALL SELECT book, page, 'pdf_text_coverage_gap', covered FROM x WHERE len(words) >= 20 AND covered < 0.35 UNION ALL SELECT book, page, 'image_page_low_text', chars::DOUBLE FROM x WHERE images >= 1 AND chars < 40 AND len(words) < 10""".replace(".0D", ".0::DOUBLE")
)
def source_cross_check(spark, sf):
    """Pages on which a book and its source disagree: numbers, sizes, words, images without text."""
    book = view(spark, sf, _BOOK)
    return scans.cross_check(book.select("book", "page", "place", "text"), book.select("book", "page", "width", "height"), view(spark, sf, _SOURCE))


_CELLS = "SELECT l_suppkey % 10 AS book, l_orderkey AS id, CAST(l_partkey % 3 AS INT) AS row, CAST(l_linenumber AS INT) AS column, concat(l_returnflag, CAST(l_partkey AS STRING)) AS text FROM lineitem"


@query(
    f"""WITH c AS (SELECT book, id, "row", "column", min(text) AS text FROM ({_CELLS}) GROUP BY ALL) SELECT c.*, (SELECT arg_min(text, "column") FROM c k WHERE k.book = c.book AND k.id = c.id AND k."row" = c."row") AS row_header, (SELECT arg_min(text, "row") FROM c k WHERE k.book = c.book AND k.id = c.id AND k."column" = c."column") AS column_header,
l.text AS "left", r.text AS "right", a.text AS above, b.text AS below FROM c LEFT JOIN c l ON l.book = c.book AND l.id = c.id AND l."row" = c."row" AND l."column" = c."column" - 1 LEFT JOIN c r ON r.book = c.book AND r.id = c.id AND r."row" = c."row" AND r."column" = c."column" + 1
LEFT JOIN c a ON a.book = c.book AND a.id = c.id AND a."row" = c."row" - 1 AND a."column" = c."column" LEFT JOIN c b ON b.book = c.book AND b.id = c.id AND b."row" = c."row" + 1 AND b."column" = c."column" """.replace("AS STRING", "AS VARCHAR").replace("AS row,", 'AS "row",').replace("AS column,", 'AS "column",')
)
def table_cell_context(spark, sf):
    """Each cell of a table with its headers and neighbours."""
    return scans.cell_context(view(spark, sf, _CELLS))


_CHUNKS = "SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS INT) AS p, o_orderpriority AS text FROM orders"
_OVERLAYS = "SELECT CAST(s_suppkey % 53 AS INT) AS page, s_suppkey % 40 AS entry, s_suppkey AS created, CASE WHEN s_suppkey % 5 = 0 THEN 'rejected' ELSE 'applied' END AS status, s_name AS summary, s_name AS seen FROM supplier"


@query(
    f"""WITH c AS ({_CHUNKS}), o AS ({_OVERLAYS}), met AS (SELECT DISTINCT c.id, o.* FROM c JOIN o ON o.status = 'applied' AND o.page IN (c.p, c.p + 1)),
once AS (SELECT id, entry, max(created) AS created, min(page) AS page FROM met GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created DESC, entry) AS n FROM once QUALIFY n <= 2)
SELECT c.id, coalesce(string_agg(entry || ':' || page, ',' ORDER BY n), '') AS overlays FROM c LEFT JOIN k ON k.id = c.id GROUP BY c.id"""
)
def page_overlays(spark, sf):
    """The newest overlays that were applied to the pages of each chunk."""
    chunks = view(spark, sf, _CHUNKS).select("id", F.array(F.col("p"), F.col("p") + 1, F.col("p")).alias("pages"), "text")
    got = scans.page_overlays(chunks, view(spark, sf, _OVERLAYS).withColumn("visible", F.array("seen")), most=2)
    return got.select("id", F.array_join(F.transform("overlays", lambda o: F.concat_ws(":", o["entry"].cast("string"), o["page"].cast("string"))), ",").alias("overlays"))
