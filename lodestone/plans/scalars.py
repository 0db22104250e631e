"""Catalog queries on scalar functions, page kinds, citations and labelled sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.plans.catalog import _BM25, _lexical, _t, query
from lodestone.plans.inputs import view


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (p_size - 10) / 25.0::DOUBLE)) END AS share, substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 12) AS slug, p_name AS book,
printf('TBL-%06d-P%04d-%03d', p_partkey, p_size, 7) AS table_id, printf('V-%s-%06d', p_size::VARCHAR, p_partkey) AS visual_id, 'texts' AS collection, p_size::INTEGER AS place, length(p_name)::BIGINT + 2 AS units, p_partkey::VARCHAR || ', ' || p_size::VARCHAR AS pages FROM part""")
def scalar_helpers(spark, sf):
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    share = F.when(k % 3 == 0, F.lit("none")).otherwise(((size - 10) / F.lit(25.0)).cast("string"))
    at = scalars.pointer(F.concat(F.lit("#/texts/"), size.cast("string")))
    return _t(spark, sf, "part").select(
        "p_partkey", scalars.unit_interval(share, 0.5).alias("share"), scalars.slug(name, 12).alias("slug"), scalars.book_name(F.concat(name, F.lit(".PDF"))).alias("book"),
        scalars.table_id(k, size, F.lit(7)).alias("table_id"), scalars.visual_id(size, k).alias("visual_id"), at["collection"].alias("collection"), at["place"].alias("place"),
        scalars.utf16_length(F.concat(name, F.lit("\U0001f527"))).alias("units"), scalars.page_label(F.array(k.cast("long"), size.cast("long"))).alias("pages"),
    )


_CITED = """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'So [S1] and [s2], as [S1] says.' WHEN 1 THEN 'See [S9] or [V1]' WHEN 2 THEN 'See (S1) and [S 1] and [Sx]' WHEN 3 THEN '' WHEN 4 THEN '[v1][V1] [S10]' WHEN 5 THEN '[S3]' END AS answer FROM orders"""


@query(f"""WITH a AS ({_CITED}), c AS (SELECT o_orderkey, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\\[([SVsv]\\d+)\\]', 1), lambda l: upper(l))) AS said, CASE WHEN o_orderkey % 2 = 0 THEN ['S1', 'S2', 'V1'] ELSE ['S3', 'S9'] END AS given FROM a)
SELECT o_orderkey, len(list_filter(said, lambda l: list_contains(given, l)))::BIGINT AS valid, len(list_filter(said, lambda l: NOT list_contains(given, l)))::BIGINT AS invalid, len(said) > 0 AND len(list_filter(said, lambda l: NOT list_contains(given, l))) = 0 AS grounded FROM c""")
def citation_check(spark, sf):
    given = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("S1"), F.lit("S2"), F.lit("V1"))).otherwise(F.array(F.lit("S3"), F.lit("S9")))
    c = view(spark, sf, _CITED).select("o_orderkey", scalars.citations(F.col("answer"), given).alias("c"))
    return c.select("o_orderkey", F.size("c.valid").cast("long").alias("valid"), F.size("c.invalid").cast("long").alias("invalid"), "c.grounded")


_PAGES = r"""SELECT page_id, CASE WHEN drawings > 0 THEN 'engineering_visual' WHEN tables >= 1 AND pictures = 0 THEN 'table_or_list' WHEN pictures > 0 AND texts > 0 THEN 'mixed' WHEN pictures > 0 THEN 'visual' ELSE 'text' END AS kind FROM (
SELECT page_id, len(regexp_extract_all(h, '<svg')) AS drawings, len(regexp_extract_all(h, '<table')) AS tables, len(regexp_extract_all(h, '<img')) AS pictures, len(regexp_extract_all(h, '<p[ >]')) AS texts FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""


def _kinds(spark, sf):
    count = lambda p: F.size(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(p), F.lit(0)))
    return _t(spark, sf, "pages").select("page_id", scalars.page_kind(count("<svg"), count("<table"), count("<img"), count("<p[ >]")).alias("kind"))


@query(_PAGES)
def page_kind_profile(spark, sf):
    return _kinds(spark, sf)


@query(f"""SELECT n % 10 AS book, CASE WHEN d >= greatest(3, p * 0.10) THEN 'mixed_technical_manual' WHEN t >= greatest(3, p * 0.25) THEN 'table_heavy_document' WHEN s >= greatest(3, p * 0.35) THEN 'visual_document' ELSE 'text_document' END AS kind FROM (
SELECT page_id % 10 AS n, count(*) AS p, count_if(kind = 'engineering_visual') AS d, count_if(kind = 'table_or_list') AS t, count_if(kind IN ('visual', 'mixed')) AS s FROM ({_PAGES}) GROUP BY page_id % 10)""")
def document_kinds(spark, sf):
    k, has = F.col("kind"), F.count_if
    g = _kinds(spark, sf).groupBy((F.col("page_id") % 10).alias("book")).agg(F.count("*").alias("p"), has(k == "engineering_visual").alias("d"), has(k == "table_or_list").alias("t"), has(k.isin("visual", "mixed")).alias("s"))
    return g.select("book", scalars.document_kind(F.col("p"), F.col("d"), F.col("t"), F.col("s")).alias("kind"))


@query(f"WITH {_BM25.format(scope=chr(39) + 'all' + chr(39))} SELECT query_id, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY lex.rank) AS label, id AS doc_id FROM lex JOIN documents d ON d.doc_id = lex.id WHERE lex.rank <= 8 AND trim(d.text) <> ''")
def prepare_sources(spark, sf):
    """Labels for the results that hold text, in order; an answer cites them."""
    d = _t(spark, sf, "documents").where("trim(text) <> ''").select(F.col("doc_id").alias("id"))
    w = Window.partitionBy("query_id").orderBy("rank")
    return _lexical(spark, sf, 8).join(d, "id").select("query_id", F.concat(F.lit("S"), F.row_number().over(w).cast("string")).alias("label"), F.col("id").alias("doc_id"))


#: Importing it registers its queries.
SCALARS = __name__
