"""Books on disk on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.sources import books


def test_lines_and_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n\n[1]\n{broken\n{"k": "no number"}\n{"t": "y"}\n')
    assert sorted((r.k or 0, r.t) for r in books.read_lines(spark, [str(tmp_path / "a.jsonl")], "k long, t string").collect()) == [(0, "y"), (1, "x")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/good.json").write_text('{"machine": "m",\n "manuals": [{"book": 1}]}')
    (tmp_path / "d/bad.json").write_text("{")
    got = {r.path.rsplit("/", 1)[1]: r.machine for r in books.read_documents(spark, [str(tmp_path / "d")], "machine string, manuals array<struct<book:long>>").collect()}
    assert got == {"good.json": "m", "bad.json": None}


def test_chunk_layouts(spark):
    one = {"chunk_id": "c", "chunk_index": 3, "text": "t"}
    rows = [(k, json.dumps(v)) for k, v in enumerate([{"chunks": [one]}, {"document": {"chunks": [one, one]}}, {"result": {"chunks": [one]}}, [one], {"other": 1}])] + [(5, "broken"), (6, None)]
    df = spark.createDataFrame(rows, "k int, payload string").select("k", F.size(books.chunks_of(F.col("payload"))).alias("n"))
    assert dict(df.collect()) == {0: 1, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0}


def test_pictures_and_references(spark):
    kind = "path string, pictures array<struct<meta:struct<classification:struct<predictions:array<struct<class_name:string,confidence:double>>>>,annotations:array<struct<class_name:string,confidence:double>>>>"
    a = ((([("logo", 0.2), ("pid", 0.9)],),), None)
    df = spark.createDataFrame([("b", [a, (None, [("map", 0.4), (None, 1.0)]), (None, None)])], kind)
    got = books.pictures_of(df, "pictures").collect()
    assert [(r["index"], r["class"], r.confidence) for r in got] == [(0, "pid", 0.9), (1, "map", 0.4), (2, None, None)]
    docs = spark.createDataFrame([("z", json.dumps({"a": [{"image": {"uri": "x/1.png"}}, {"uri": "./x/2.png"}], "uri": "https://e.org", "b": {"uri": "x/3 \"q\".png"}}))], "path string, text string")
    members = spark.createDataFrame([("z", "x/1.png"), ("y", "x/2.png")], "path string, member string")
    assert sorted(r.uri for r in books.missing_members(docs, members).collect()) == ['x/2.png', 'x/3 "q".png']


def test_vectors(spark, tmp_path):
    x = np.arange(30, dtype="<f4").reshape(10, 3)
    (tmp_path / "v.f32").write_bytes(x.tobytes())
    got = books.read_vectors(spark, [str(tmp_path / "v.f32")], 3).orderBy("row").collect()
    assert [list(r.embedding) for r in got] == x.tolist() and [r.row for r in got] == list(range(10))
    (tmp_path / "v.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole rows"):
        books.read_vectors(spark, [str(tmp_path / "v.f32")], 3).collect()


def test_arrivals_and_stability(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name, body in {"a.pdf": b"one", "b.PDF": b"two", ".hidden.pdf": b"x", "c.txt": b"no"}.items():
        (src / name).write_bytes(body)
    q = books.arrivals(spark, str(src), [".pdf"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(60)
    assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.pdf", "b.PDF"]
    seen = spark.createDataFrame([("a", 1, 5, 0.0), ("a", 1, 5, 1.5), ("b", 1, 5, 0.0), ("b", 2, 6, 1.2), ("b", 2, 6, 1.9)], "filename string, size int, modified int, at double")
    assert [r.filename for r in books.stable(seen, 1.0).collect()] == ["a"]
    now = spark.createDataFrame([("p", 1, 2), ("q", 3, 4)], "path string, modified int, size int")
    assert [r.path for r in books.changed(now, now.where("path = 'p'")).collect()] == ["q"]


def test_generations(spark, tmp_path):
    folder, df = str(tmp_path / "index"), spark.range(5)
    with pytest.raises(FileNotFoundError):
        books.read_current(spark, folder)
    mark = books.fingerprint(df, ["id"], "model")
    assert mark == books.fingerprint(df.orderBy(F.desc("id")), ["id"], "model") != books.fingerprint(spark.range(6), ["id"], "model")
    first = books.publish(df, folder, mark)
    assert books.publish(spark.range(9), folder, mark) == first and books.read_current(spark, folder).count() == 5
    assert books.publish(spark.range(9), folder, "other") != first and books.read_current(spark, folder).count() == 9
