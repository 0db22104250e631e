"""Sources and streams on small files."""

import json
import zipfile

from lodestone.sources import chunks
from lodestone.streaming import usage


def test_index_round_trip(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    rows = [{"chunk_id": "c1", "chunk_index": 0, "text": "The 2141-101 Valve at 24.5 bar", "headings": ["Main Pumps"]}, {"chunk_id": "c2", "text": None}]
    f.write_text("\n".join([json.dumps(rows[0]), "", "[1, 2]", "{broken", json.dumps(rows[1])]))
    got = {r.chunk_id: r for r in chunks.read_index(spark, [str(f)]).collect()}
    assert set(got) == {"c1", "c2"}
    assert got["c1"].tokens == ["2141-101", "valve", "24.5", "bar"] and got["c1"].heading_tokens == ["main", "pumps"] and got["c2"].tokens == []
    chunks.write_index(chunks.read_index(spark, [str(f)]), str(tmp_path / "out"))
    assert sorted(r.chunk_id for r in chunks.read_index(spark, [str(tmp_path / "out")]).collect()) == ["c1", "c2"]


def test_archives(spark, tmp_path):
    for name, members in {"one": {"d.json": '{"texts": [1]}', "m.json": "{}", "x.txt": "x"}, "two": {"a.json": '{"texts": []}', "b.json": '{"texts": []}'}, "none": {"a.json": "{bad"}}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for m, body in members.items():
                z.writestr(m, body)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    m = chunks.archive_members(spark, [str(tmp_path / f"{n}.zip") for n in ("one", "two", "none", "broken")])
    assert m.where("member IS NULL").count() == 1
    got = {r.path.rsplit("/", 1)[1]: (r.found, r.member) for r in chunks.documents(m).collect()}
    assert got == {"one.zip": (1, "d.json"), "two.zip": (2, None), "none.zip": (0, None), "broken.zip": (0, None)}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "src"
    events.coalesce(1).write.parquet(str(src))
    q = usage.follow(spark, str(src), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    done = spark.read.parquet(str(tmp_path / "out"))
    want = {(r.hour, r.event_type): (r.calls, round(r.total, 4)) for r in usage.hourly(events).collect()}
    got = {(r.hour, r.event_type): (r.calls, round(r.total, 4)) for r in done.collect()}
    assert all(want[k] == v for k, v in got.items()) and len(got) >= 0.5 * len(want)
    assert usage.distinct_events(events.union(events)).count() == events.select("event_id").distinct().count()
