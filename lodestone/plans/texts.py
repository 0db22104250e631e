"""Catalog queries on text functions, claims and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.functions.text import duration_seconds, identifiers, snippet, tokens
from lodestone.operators import integrity
from lodestone.plans.catalog import _TOKS, _t, query
from lodestone.plans.inputs import view


@query("""SELECT doc_id, (CASE WHEN s > 1 THEN '…' ELSE '' END) || trim(substr(text, s, 560), ' ') || (CASE WHEN s + 559 < length(text) THEN '…' ELSE '' END) AS snippet
FROM (SELECT doc_id, text, greatest(strpos(lower(text), 'tion') - 120, 1) AS s FROM documents)""")
def snippets(spark, sf):
    d = _t(spark, sf, "documents")
    return d.select("doc_id", snippet(F.col("text"), F.locate("tion", F.lower("text"))).alias("snippet"))


_SAID = "SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN '1d2h3m4s' WHEN 1 THEN ' 90 ' WHEN 2 THEN '1m30.5s' WHEN 3 THEN '' WHEN 4 THEN '4s1m' WHEN 5 THEN 'soon' WHEN 6 THEN '2h x' WHEN 7 THEN '1h 30m' WHEN 8 THEN '-5' WHEN 9 THEN concat(CAST(o_custkey AS STRING), 'm') WHEN 10 THEN concat(CAST(o_custkey AS STRING), 'd7') END AS said FROM orders"
_PART = "coalesce(TRY_CAST(regexp_extract(t, '(\\d+(?:\\.\\d+)?){u}', 1) AS DOUBLE), 0)"


@query(rf"""SELECT o_orderkey, CASE WHEN regexp_full_match(t, '\d+') THEN t::DOUBLE WHEN t <> '' AND regexp_full_match(t, '(\d+(\.\d+)?d)?\s*(\d+(\.\d+)?h)?\s*(\d+(\.\d+)?m)?\s*(\d+(\.\d+)?s)?') THEN {_PART.format(u='d')} * 86400 + {_PART.format(u='h')} * 3600 + {_PART.format(u='m')} * 60 + {_PART.format(u='s')} END AS seconds FROM (SELECT o_orderkey, trim(said) AS t FROM ({_SAID}))""")
def parse_duration(spark, sf):
    return view(spark, sf, _SAID).select("o_orderkey", duration_seconds(F.col("said")).alias("seconds"))


@query(f"SELECT doc_id, len(i)::BIGINT AS n, array_to_string(list_sort(i), ' ') AS ids FROM (SELECT doc_id, list_distinct(list_filter({_TOKS.format(c='text')}, lambda t: regexp_matches(t, '[-_/.+:]') AND regexp_matches(t, '\\d'))) AS i FROM documents)")
def structured_identifiers(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", identifiers(F.col("text")).alias("i"))
    return d.select("doc_id", F.size("i").cast("long").alias("n"), F.array_join(F.array_sort("i"), " ").alias("ids"))


_SUPPORT = f"""SELECT item_id, doc_id, shared, size, (CASE WHEN size <= 4 THEN shared >= 1 ELSE shared >= 2 AND shared::DOUBLE / size >= 0.25 END) AS supported FROM (
SELECT item_id, doc_id, len(list_intersect(w, v))::BIGINT AS shared, len(w)::BIGINT AS size FROM (SELECT item_id, list_distinct({_TOKS.format(c='text')}) AS w FROM benchmark) b JOIN (SELECT doc_id, list_distinct({_TOKS.format(c='text')}) AS v FROM documents) d ON d.doc_id % 40 = b.item_id % 40)"""


@query(_SUPPORT)
def claim_support(spark, sf):
    """Each claim against its cited sources, the documents of its class: an equality join on the class, whose tokens are taken once a document."""
    claims = _t(spark, sf, "benchmark").select("item_id", F.array_distinct(tokens(F.col("text"))).alias("w"), (F.col("item_id") % 40).alias("k"))
    sources = _t(spark, sf, "documents").select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("v"), (F.col("doc_id") % 40).alias("k"))
    j = claims.join(sources, "k").select("item_id", "doc_id", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"), F.size("w").cast("long").alias("size"))
    return j.withColumn("supported", F.when(F.col("size") <= 4, F.col("shared") >= 1).otherwise((F.col("shared") >= 2) & (F.col("shared") / F.col("size") >= 0.25)))


@query("""SELECT a.l_orderkey, count(*) AS pairs, count_if(a.l_quantity > b.l_quantity)::BIGINT AS inversions FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey""")
def reading_order_inversions(spark, sf):
    """Inverted pairs of each order's lines, counted inside its own array: the lines of an order are few by nature."""
    rows = _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("x"))

    def pairs(inverted: bool):
        later = lambda a: F.size(F.filter("x", lambda b: (b["l_linenumber"] > a["l_linenumber"]) & ((a["l_quantity"] > b["l_quantity"]) if inverted else F.lit(True))))
        return F.aggregate(F.transform("x", later), F.lit(0), lambda s, n: s + n).cast("long")

    return rows.select("l_orderkey", pairs(False).alias("pairs"), pairs(True).alias("inversions")).where("pairs > 0")


_HEADS = """SELECT l_suppkey AS book, place, CASE k % 9 WHEN 0 THEN concat(CAST(k % 5 + 1 AS STRING), '.', CAST(k % 3 AS STRING), ' Pumps') WHEN 1 THEN concat('  ', CAST(k % 4 + 1 AS STRING), '.1.', CAST(k % 7 AS STRING), ' Valves') WHEN 2 THEN 'B.2 Tests' WHEN 3 THEN 'CHAPTER IV Safety' WHEN 4 THEN 'Appendix C' WHEN 5 THEN 'IV. Safety' WHEN 6 THEN '7 a list' WHEN 7 THEN '' END AS text,
CAST(CASE WHEN k % 9 = 0 THEN 1 + k % 2 WHEN k % 9 = 1 THEN CASE WHEN k % 11 = 0 THEN 5 ELSE 1 END WHEN k % 9 = 2 THEN 3 ELSE k % 4 END AS INT) AS level FROM (SELECT l_suppkey, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place FROM lineitem) x"""
_SIGN = r"""s AS (SELECT *, CASE WHEN regexp_matches(t, '^[0-9]+(\.[0-9]+){1,5}(\s|\.|$)') THEN 'decimal' WHEN regexp_matches(t, '^[A-Z](\.[0-9]+){1,5}(\s|\.|$)') THEN 'alpha_decimal' WHEN regexp_matches(t, '(?i)^(chapter|section)\s+([0-9]+|[IVXLCDM]+)\b') THEN 'chapter_section' WHEN regexp_matches(t, '(?i)^appendix\s+([A-Z]|[0-9]+|[IVXLCDM]+)\b') THEN 'appendix' WHEN regexp_matches(t, '^[IVXLCDM]+(\.|\s)\s*[A-Z0-9]') THEN 'roman' END AS scheme,
len(string_split(regexp_extract(t, '^([0-9A-Z]+(\.[0-9]+)+)', 1), '.')) AS dots FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM h))"""
_GROUPS = f"""WITH h AS ({_HEADS}), {_SIGN}, d AS (SELECT *, CASE WHEN scheme IN ('decimal', 'alpha_decimal') THEN dots ELSE 1 END AS depth FROM s WHERE scheme IS NOT NULL),
c AS (SELECT book, scheme, depth, level, count(*) AS n, min(place) AS first FROM d GROUP BY ALL), m AS (SELECT book, scheme, depth, sum(n)::BIGINT AS n, max(n)::BIGINT AS support, arg_max(level, n * 1000000 - first) AS mode FROM c GROUP BY ALL)"""


@query(f"WITH h AS ({_HEADS}), {_SIGN} SELECT book, place, scheme, CASE WHEN scheme IN ('decimal', 'alpha_decimal') THEN dots WHEN scheme IS NOT NULL THEN 1 END::INTEGER AS depth FROM s")
def heading_depth(spark, sf):
    h = view(spark, sf, _HEADS)
    return h.select("book", "place", scalars.heading(F.col("text")).alias("h")).select("book", "place", "h.scheme", "h.depth")


@query(f"{_GROUPS} SELECT m.book, m.scheme, m.depth::INTEGER AS depth, m.n, m.mode, m.support, sum(CASE WHEN abs(c.level - m.mode) >= 2 THEN c.n ELSE 0 END)::BIGINT AS anomalies FROM m JOIN c ON c.book = m.book AND c.scheme = m.scheme AND c.depth = m.depth WHERE m.n >= 4 GROUP BY ALL")
def heading_mode_deviation(spark, sf):
    """Levels of headings against the commonest level of their numbering scheme and depth in the book."""
    return integrity.heading_levels(view(spark, sf, _HEADS)).where("n >= 4")


@query(f"{_GROUPS} SELECT book, scheme, depth::INTEGER AS depth, mode, before FROM (SELECT *, lag(mode) OVER (PARTITION BY book, scheme ORDER BY depth) AS before FROM m WHERE n >= 4) WHERE before >= mode")
def heading_monotonicity(spark, sf):
    """Depths whose commonest level isn't below that of the depth before it."""
    w = Window.partitionBy("book", "scheme").orderBy("depth")
    return integrity.heading_levels(view(spark, sf, _HEADS)).where("n >= 4").withColumn("before", F.lag("mode").over(w)).where("before >= mode").select("book", "scheme", "depth", "mode", "before")


@query("""WITH e AS (SELECT doc_id, source, text FROM documents), a AS (SELECT e.doc_id, l.quality, l.toxic FROM e JOIN labels l USING (doc_id) WHERE l.toxic = 0)
SELECT e.doc_id, coalesce(a.quality, -1) AS overlay, a.doc_id IS NOT NULL AS applied FROM e LEFT JOIN a USING (doc_id)""")
def overlay_apply(spark, sf):
    """Applied and safe overlays onto their texts; the others keep the original."""
    safe = _t(spark, sf, "labels").where("toxic = 0").select("doc_id", "quality", F.lit(True).alias("hit"))
    return _t(spark, sf, "documents").join(safe, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("overlay"), F.coalesce("hit", F.lit(False)).alias("applied"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, quantile_disc(value, 0.5) AS middle, max(value) AS most FROM events GROUP BY user_id")
def usage_medians(spark, sf):
    """The lower median by order of values, with no sampling."""
    return _t(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("middle"), F.max("value").alias("most"))
