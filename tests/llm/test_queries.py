"""Every registered opN query and the pipeline over whole small tables, against plain Python."""

import hashlib
import io
import re
import struct
import sys
import wave
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tests")
from test_operators import brute_components, brute_fp, library, naive_spans

import corpus_pipeline
from lodestone.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def test_op1(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_site_style(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        html = pages[r.page_id].html or ""
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))
        # One template: the article's blocks are its h1, and its p and bold pieces.
        import html as entities

        body = html[html.find("<article>") + 9 : html.find("</article>")] if "<article>" in html else ""
        plain = entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a|i|em)\b[^>]*>", "", body)))
        blocks = [" ".join(b.split()) for b in re.split(r"</?(?:h1|p)\b[^>]*>", plain)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_op2(spark, sf, docs):
    lib, start = library(), 0
    for r in queries.op2_token_store(spark, sf).orderBy("doc_id").collect():
        ids = lib.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, sf, docs):
    rows = queries.op3_media_sniff(spark, sf).collect()
    assert len(rows) == len(docs) and {r.media_type for r in rows} == {"audio/wav", "image/png", "image/bmp", "application/zip"}
    assert {r.corrected for r in rows} == {True, False} and {r.n_carved > 0 for r in rows} >= {True, False}
    from lodestone.llm import media_sniff

    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        form = media_sniff.FORMS[zlib.crc32(full) % 4]
        made = media_sniff._MADE[form](full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), sha(full), zlib.crc32(full[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(made), sha(made))
        # The stored form is what other readers take it for.
        if form == "zip":
            made = zipfile.ZipFile(io.BytesIO(made)).read("samples.wav")
        if form in ("zip", "wave"):
            with wave.open(io.BytesIO(made)) as w:
                assert w.readframes(w.getnframes()) == full
        n, total = np.bincount(np.frombuffer(full, np.uint8), minlength=256), len(full)
        p = n[n > 0] / total
        assert f"samples={total};mean={sum(full) * 1000 // total};" in r.feature and f"entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};" in r.feature


def test_op4(spark, sf):
    v = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op4_vptree(spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i, _ in v if i % 50 == 0}
    for q, a in v:
        if q % 50 == 0:
            best = sorted((-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in v if i != q)[:5]
            assert [got[q][k + 1][0] for k in range(5)] == [i for _, i in best]
            assert all(abs(got[q][k + 1][1] + s) < 1e-12 for k, (s, _) in enumerate(best))


def test_op5(spark, sf, docs):
    rows = queries.op5_langid(spark, sf).collect()
    known = {d.lang for d in docs.values() if d.lang}
    assert len(rows) == len(docs) and {r.lang_pred for r in rows} <= known | {"und"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean(judged) > 0.95


def test_op7(spark, sf, docs):
    names = ("email", "ip", "card", "phone", "term")
    rows = queries.op7_pii_info(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = naive_spans(docs[r.doc_id].text or "")
        said = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert r.base_sha256 == sha(said)
        assert [x for x in r.spans.split(",") if x and not x.startswith("term:")] == [x for x in said.split(",") if x]


def test_op8(spark, sf, docs):
    ids = sorted(docs)
    fps = [brute_fp(docs[i].text) for i in ids]
    roots = [ids[k] for k in brute_components(fps)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_golay(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", root) for i, f, root in zip(ids, fps, roots, strict=True)}


def test_op10(spark, sf, docs):
    lib = library()
    for r in queries.op10_bpe_backtrack(spark, sf).collect():
        ids = lib.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_pipeline_stages_and_run(spark, sf, docs):
    """Each stage on what the one before kept, with the kept rows worked out in plain Python."""
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    table, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf).cache()
        kept.append((name, table.collect()))
        if name != "tokens":
            assert table.columns == columns
    by = dict(kept)
    said = {r.doc_id: r for r in queries.op5_langid(spark, sf).collect()}
    sure = [i for i, r in said.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE]
    assert sorted(r.doc_id for r in by["language"]) == sorted(sure)
    ids = sorted(sure)
    roots = {ids[k] for k in brute_components([brute_fp(docs[i].text) for i in ids])}
    assert {r.doc_id for r in by["near_duplicates"]} == roots and len(by["near_duplicates"]) == len(roots)
    assert {r.doc_id for r in by["personal_data"]} == roots
    for r in by["personal_data"]:
        assert not naive_spans(r.text) and r.n_chars == len(r.text)
        if not naive_spans(docs[r.doc_id].text):
            assert r.text == docs[r.doc_id].text
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in by["personal_data"]}
    assert {r.doc_id for r in by["mixture"]} <= roots and len(by["mixture"]) > len(roots)
    mixed = sum(sizes[r.doc_id] for r in by["mixture"])
    assert abs(mixed - 1.5 * sum(sizes.values())) <= sum(sorted(sizes.values())[-3 * len({r.source for r in by["mixture"]}) :])
    lib, text = library(), {r.doc_id: r.text for r in by["personal_data"]}
    assert len(by["tokens"]) == len(by["mixture"])
    for r in by["tokens"]:
        assert r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids and r.round_trip
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == sorted((r.doc_id, r.n_tokens) for r in by["tokens"])


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_stages_take_null_and_odd_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "!!!", None, None, 3), (2, "The house is on the hill and the dog runs", "en", "s", 41), (2, "The house is on the hill and the dog runs", "en", "s", 41), (None, "mail a@b.co to the house on the hill now", "en", None, 39)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit("extra")).withColumn("position", F.lit(1.0))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, docs, sf)
        assert set(got.columns) == set(docs.columns), name
        texts = [r.text for r in got.collect()]
        assert any(t and "house" in t for t in texts), name
