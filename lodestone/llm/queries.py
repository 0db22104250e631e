"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe_backtrack, cholesky_whitening, collocations, curriculum, langid, media_sniff, pii_info, simhash_golay, site_style, token_store, token_transducer, url_asof, vptree
from lodestone.session import ship, written

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"
#: Tokens of a document over which op12 marks it.
TOKEN_LIMIT = 2048


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows in a batch that goes to Python. Whole texts may be long, so few travel together.
BATCH_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return site_style.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.store(_table(spark, sf_dir, "documents"), tokenizer_path(), end=2)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # What was declared of the media is right for some and wrong for others, or missing.
    said = F.element_at(F.array(F.lit("audio/wav"), F.lit("image/png"), F.lit("image/bmp"), F.lit("application/zip"), F.lit(None)), F.pmod(F.xxhash64("text"), F.lit(5)).cast("int") + 1)
    kept = written(media_sniff.store(docs).select("doc_id", "n_bytes", "media", said.alias("declared")), "media")
    seen = media_sniff.sniff(kept, "media", "declared")
    return seen.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "media_type",
        "corrected",
        F.size("carved").cast("long").alias("n_carved"),
    )


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    said = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return said.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: two years of fetch days, by page_id."""
    return _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") % 730).cast("int")).alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries about the hosts in the table, chosen by digits of the host's MD5, and about one parent domain."""
    h = pages.select(site_style.host(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("m", F.md5("host"))
    made = """
        SELECT 'spam' AS list_name, 'block' AS action, 'add' AS op, 'domain' AS kind, host AS pattern, DATE '2023-02-01' AS day FROM hosts WHERE substr(m, 1, 1) < '8'
        UNION ALL SELECT 'spam', 'block', 'remove', 'domain', host, DATE '2023-09-01' FROM hosts WHERE substr(m, 1, 1) < '8' AND substr(m, 2, 1) < '8'
        UNION ALL SELECT 'spam', 'block', 'add', 'domain', host, DATE '2024-03-01' FROM hosts WHERE substr(m, 1, 1) < '8' AND substr(m, 3, 1) < '8'
        UNION ALL SELECT 'trusted', 'allow', 'add', 'prefix', concat(host, '/en/'), DATE '2023-06-01' FROM hosts WHERE substr(m, 4, 1) < '4'
        UNION ALL SELECT 'parents', 'block', 'add', 'domain', 'example.net', DATE '2024-06-01'
        UNION ALL SELECT 'parents', 'block', 'remove', 'domain', 'example.net', DATE '2024-08-01'
    """
    return pages.sparkSession.sql(made.replace("FROM hosts", "FROM {hosts}"), hosts=h)


def op6_url_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    return url_asof.judge(c, list_entries(c)).select("page_id", "url", "fetched", "blocked", "list_name", "pattern", "since")


def spans_text(spans: F.Column) -> F.Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in pii_info.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_info.find(_table(spark, sf_dir, "documents"))
    term = F.lit(len(pii_info.KINDS) - 1)
    terms = F.coalesce(F.transform("terms", lambda t: F.struct(t["start"].alias("start"), term.alias("kind"), t["end"].alias("end"))), F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)"))
    both = F.array_sort(F.concat("spans", terms))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii_info.KINDS[k]}")
    return found.select("doc_id", *[number(k) for k in range(4)], F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"), spans_text(both).alias("spans"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(_table(spark, sf_dir, "documents"))


def op10_bpe_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe_backtrack.encode(docs, tokenizer_path(), decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cholesky_whitening.whiten(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id", k=4)


def op12_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_transducer.count(docs, tokenizer_path(WORD_TOKENIZER))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_site_style,
        op2_token_store,
        op3_media_sniff,
        op4_vptree,
        op5_langid,
        op6_url_asof,
        op7_pii_info,
        op8_simhash_golay,
        op9_curriculum,
        op10_bpe_backtrack,
        op11_cholesky_whitening,
        op12_token_transducer,
        op13_collocations,
    )
}

_WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

#: A phrase's cut after its first k words, for phrases of 2 to 5.
_CUTS = " UNION ALL ".join(
    f"SELECT c.lang, c.phrase, c.a, {k} AS k, l.a AS l, r.a AS r FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:{k}], ' ')"
    f" JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[{k + 1}:], ' ') WHERE c.size > {k}"
    for k in range(1, 5)
)
_GRAMS = " UNION ALL ".join(f"SELECT lang, {k} AS size, {' || chr(32) || '.join(['word', 'w2', 'w3', 'w4', 'w5'][:k])} AS phrase FROM words WHERE {['word', 'w2', 'w3', 'w4', 'w5'][k - 1]} IS NOT NULL" for k in range(1, 6))

ORACLE_SQL = {
    "op13_collocations": rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
cut AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
apart AS (SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM pieces),
words AS (SELECT lang, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4, lead(word, 4) OVER p AS w5 FROM apart WINDOW p AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND a >= 100),
cuts AS ({_CUTS}),
scored AS (SELECT lang, phrase, a, k, l, r, n, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM cuts JOIN n USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000""",
    "op6_url_asof": r"""
WITH captures AS (SELECT page_id, url, DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched,
    lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '')) AS host,
    lower(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')) AS path FROM pages),
hosts AS (SELECT DISTINCT host, md5(host) AS m FROM captures WHERE host <> ''),
entries AS (
    SELECT 'spam' AS list_name, 'block' AS action, 'add' AS op, 'domain' AS kind, host AS pattern, DATE '2023-02-01' AS day FROM hosts WHERE substr(m, 1, 1) < '8'
    UNION ALL SELECT 'spam', 'block', 'remove', 'domain', host, DATE '2023-09-01' FROM hosts WHERE substr(m, 1, 1) < '8' AND substr(m, 2, 1) < '8'
    UNION ALL SELECT 'spam', 'block', 'add', 'domain', host, DATE '2024-03-01' FROM hosts WHERE substr(m, 1, 1) < '8' AND substr(m, 3, 1) < '8'
    UNION ALL SELECT 'trusted', 'allow', 'add', 'prefix', concat(host, '/en/'), DATE '2023-06-01' FROM hosts WHERE substr(m, 4, 1) < '4'
    UNION ALL SELECT 'parents', 'block', 'add', 'domain', 'example.net', DATE '2024-06-01'
    UNION ALL SELECT 'parents', 'block', 'remove', 'domain', 'example.net', DATE '2024-08-01'),
spans AS (SELECT list_name, action, kind, pattern, day AS since,
    (SELECT min(r.day) FROM entries r WHERE r.op = 'remove' AND r.list_name = e.list_name AND r.action = e.action AND r.kind = e.kind AND r.pattern = e.pattern AND r.day > e.day) AS until
    FROM entries e WHERE op = 'add'),
hits AS (SELECT c.page_id, s.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.pattern) DESC, s.action = 'allow' DESC, s.list_name DESC, s.since DESC, s.pattern DESC) AS n
    FROM captures c JOIN spans s ON s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
    AND (s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)) OR s.kind = 'prefix' AND (c.host || c.path = s.pattern OR starts_with(c.host || c.path, s.pattern) AND ends_with(s.pattern, '/'))))
SELECT c.page_id, c.url, c.fetched, coalesce(h.action = 'block', false) AS blocked, h.list_name, h.pattern, h.since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.n = 1""",
    "op9_curriculum": f"""
WITH docs AS (SELECT doc_id, source, {_WORDS} AS size, md5(concat_ws(':', doc_id::VARCHAR, 'mix')) AS key, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(rank % 3 + 1)::INT] AS weight, [0.6::DOUBLE, 0.0, -0.6][(rank % 3 + 1)::INT] AS slope, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, coalesce(least(cap, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)), cap) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM docs d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - before)) AS one, greatest(0, least(size, floor(target)::BIGINT - (before + source_size))) AS two FROM p),
y AS (SELECT *, CASE WHEN one > 0 THEN (before + one / 2) / greatest(target, 1.0::DOUBLE) WHEN two > 0 THEN (before + source_size + two / 2) / greatest(target, 1.0::DOUBLE) END AS part FROM q),
z AS (SELECT *, least(greatest(part, 0.0::DOUBLE), 1.0::DOUBLE) AS share FROM y WHERE part IS NOT NULL UNION ALL SELECT *, NULL FROM y WHERE part IS NULL)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, (one + two)::BIGINT AS taken,
    CASE WHEN share IS NULL THEN NULL WHEN abs(slope) < 1e-9 THEN share ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) / (2 * slope) END AS position FROM z""",
}
