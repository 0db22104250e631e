"""Operators against plain versions where their queries can't show everything: packing, islands of scores, boxes, nulls."""

import random

from pyspark.sql import functions as F

from lodestone.functions import geometry, lexical
from lodestone.functions.text import tokens
from lodestone.operators import entries, grounding, jobtable, references, registry, retrieval, tables, usage

NONE = "cast(array() AS array<string>)"


def test_stitched_windows_are_packed_like_a_plain_packer(spark):
    rnd = random.Random(4)
    rows = [("b", k, f"b-{k}", 1, "#/tables/7", ("| Name part | Torque value |\n| --- | --- |" if k == 0 else "\n".join(f"| bolt{rnd.randrange(99)} size | {rnd.randrange(99)} mm |" for _ in range(rnd.randrange(1, 9)))), "Head", "table_fragment", ["TABLE_FRAGMENT"]) for k in range(20)]
    df = spark.createDataFrame(rows, "book string, chunk_index long, chunk_id string, page int, table_ref string, raw_text string, heading string, kind string, warnings array<string>")
    got = tables.stitched(df, 70).orderBy("evidence_id").collect()
    count = lambda t: len(spark.createDataFrame([(t,)], "t string").select(tokens(F.col("t")).alias("t")).first().t)
    base, windows = "Section: Head\nTable columns: Name part | Torque value", []
    pieces = [(r[2], r[5]) for r in rows[1:]]
    for cid, text in pieces:
        if windows and count("\n".join([base, *(t for _, t in windows[-1]), text])) <= 70:
            windows[-1].append((cid, text))
        else:
            windows.append([(cid, text)])
    assert [r.sources for r in got] == [",".join(c for c, _ in w) for w in windows]
    assert [r.text for r in got] == ["\n".join([base, *(t for _, t in w)]) for w in windows]
    assert got[0].evidence_id == "TBL-000007-P0001-001" and len(got) > 2
    assert tables.stitched(df.where("chunk_index % 2 = 0"), 70).count() == 0


def test_tables_take_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "raw string")
    got = df.select(tables.shape(F.col("raw")).alias("s"), tables.labels(F.col("raw")).alias("l"), tables.header_cells(F.col("raw")).alias("h"), tables.content_type(F.col("raw"), F.lit(None)).alias("k")).collect()
    assert [(r.s.table_like, r.l.density, r.h, r.k) for r in got] == [(False, 1.0, [], "prose")] * 3
    assert references.cross_references(F.lit(None).cast("string")) is not None
    assert spark.range(1).select(references.cross_references(F.lit(None).cast("string")).alias("r")).first().r == []


def test_islands_begin_anew_at_their_first_score(spark):
    rnd = random.Random(9)
    rows, want = [], {}
    for q in range(40):
        score, scored = 1.0, []
        for rank in range(1, 13):
            scored.append((q, rank, score, rnd.randrange(3)))
            score -= rnd.choice([0.0, 1e-5, 3e-5, 9e-5])
        rows += scored
        order, i = [], 0
        while i < len(scored):
            j = i
            while j < len(scored) and abs(scored[i][2] - scored[j][2]) <= 4e-5:
                j += 1
            order += sorted(scored[i:j], key=lambda r: (-r[3], r[1]))
            i = j
        want[q] = [r[1] for r in order]
    got = {}
    for r in grounding.tie_break(spark.createDataFrame(rows, "query int, rank int, score double, evidence int")).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append(r["rank"])
    assert got == want


def test_boxes(spark):
    b = lambda *v: geometry.box(*[F.lit(float(x)) for x in v])
    page = b(0, 0, 100, 200)
    one = spark.range(1)
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    assert one.select(geometry.crop(page, b(10, 50, 30, 60), none, none, 5.0, 4.0, 0.05).alias("c")).first().c[:] == (3.0, 40.0, 37.0, 70.0)
    assert one.select(geometry.crop(page, b(10, 50, 30, 60), b(0, 0, 50, 48), b(0, 61, 50, 90), 5.0, 4.0, 0.05).alias("c")).first().c[:] == (3.0, 49.0, 37.0, 60.5)
    assert one.select(geometry.gap(page, b(0, 0, 20, 10), b(0, 30, 20, 40), 1.0).alias("g")).first().g[:] == (0.0, 11.0, 21.0, 29.0)
    for a, z in ((b(0, 0, 20, 10), b(50, 30, 90, 40)), (b(0, 0, 20, 30), b(0, 20, 20, 40)), (b(0, 0, 20, 10), none)):
        assert one.select(geometry.gap(page, a, z, 1.0).alias("g")).first().g is None
    assert one.select(geometry.union(F.array(none, b(1, 2, 3, 4), b(0, 3, 2, 9))).alias("u")).first().u[:] == (0.0, 2.0, 3.0, 9.0)
    assert one.select(geometry.from_corners(F.lit(5.0), F.lit(190.0), F.lit(1.0), F.lit(150.0), F.lit(None).cast("string"), F.lit(200.0)).alias("u")).first().u[:] == (1.0, 10.0, 5.0, 50.0)


def test_vector_topk_is_one_result_in_any_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, "ab"[i % 2] if i % 9 else None, [rnd.choice((-1.0, 0.0, 0.5)) for _ in range(6 if i % 5 else 3)]) for i in range(80)]
    rows += [(99, "a", None), (98, "a", [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, "a", [1.0] * 6), (97, "b", []), (96, "b", [float("nan")] * 6)]
    v = spark.createDataFrame(rows, "id long, scope string, v array<double>")
    q = v.where("id % 7 = 0 OR id >= 96")

    def plain(k, scoped):
        out = {}
        good = [(i, s, x) for i, s, x in rows if i is not None and x is not None and None not in x and (s or not scoped)]
        for i, s, x in good:
            if i % 7 == 0 or i >= 96:
                at = [(-round(sum(a * b for a, b in zip(x, y, strict=True)), 6), j) for j, t, y in good if j != i and len(x) == len(y) and (t == s or not scoped)]
                out[i] = [(j, -z) for z, j in sorted(p for p in at if p[0] == p[0])[:k]]
        return {i: x for i, x in out.items() if x}

    def ours(k, scoped):
        out = {}
        for r in retrieval.vector_topk(v, q, k, scoped=scoped).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.id, r.score))
        return out

    for blocks in (4_096, 3):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", blocks)
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7 if blocks == 3 else 256)
        for scoped in (False, True):
            assert ours(5, scoped) == plain(5, scoped)
    assert retrieval.vector_topk(v, v.where("false"), 3).count() == 0
    assert retrieval.vector_topk(v.where("false"), q, 3).count() == 0


def test_a_scope_is_searched_in_its_current_generation(spark):
    docs = spark.createDataFrame([(1, "a", "g1", "hydraulic pump"), (2, "a", "g0", "hydraulic pump stale"), (3, "b", "g1", "unrelated generator pump"), (4, "c", "g1", "pump")], "id long, scope string, generation string, text string")
    vectors = spark.createDataFrame([(1, "a", "g1", [1.0, 0.0]), (2, "a", "g0", [1.0, 0.0]), (3, "b", "g1", [1.0, 0.0]), (4, "c", "g1", [1.0, 0.0])], "id long, scope string, generation string, v array<double>")
    current = spark.createDataFrame([("a", "g1"), ("b", "g1")], "scope string, generation string")
    asked = spark.createDataFrame([(7, "a", "pump"), (8, "c", "pump")], "query_id long, scope string, text string")
    asked_vectors = spark.createDataFrame([(7, "a", [1.0, 0.0]), (8, "c", [1.0, 0.0])], "id long, scope string, v array<double>")
    got = retrieval.scoped_hybrid(docs, vectors, current, asked, asked_vectors, 5).collect()
    assert [(r.query_id, r.scope, r.id, r.r1, r.r2) for r in got] == [(7, "a", 1, 1, 1)]


def test_transitions_leave_null_conditions_alone(spark):
    df = spark.createDataFrame([(1, "failed", None), (2, None, "x")], "id int, status string, error string")
    assert [tuple(r) for r in jobtable.transition(df, F.col("status") == "failed", status="pending", error=F.lit("e")).orderBy("id").collect()] == [(1, "pending", "e"), (2, None, "x")]
    assert jobtable.migrated(df, {"ERROR": ("string", "none"), "n": ("int", 3)}).orderBy("id").select("ERROR", "n").collect()[0][:] == ("none", 3)


def test_lists_of_evidence(spark):
    got = spark.range(1).select(entries.clean_list(F.array(F.lit(" a  B "), F.lit("A b"), F.lit(""), F.lit(None), F.lit("c" * 300)), 2, 5).alias("a"), entries.clean_list(F.lit(None).cast("array<string>")).alias("b")).first()
    assert got.a == ["a B", "ccccc"] and got.b == []
    k = spark.range(1).select(lexical.leaks(F.lit("one two three four five six seven"), F.lit("one two"), F.lit("and two three four five six seven more")).alias("x"), lexical.leaks(F.lit("one two three four five six"), F.lit("one two three four five six"), F.lit("one two three four five six")).alias("y"), lexical.stems(F.lit("pumpings")).alias("s")).first()
    assert k.x and not k.y and set(k.s) == {"pumpings", "pumping"}


def test_quota_limits():
    assert usage.limits(1_000, 200_000) == {"request_limit": 1_000, "token_limit": 200_000, "request_warn": 800, "request_stop": 900, "token_warn": 160_000, "token_stop": 180_000}
    low = usage.limits(0, 1, 2.0, 0.1)
    assert low["request_limit"] == low["request_stop"] == 1


def test_registry_upsert_replaces_sound_machines_only(spark):
    kind = "machine long, name string, manuals array<struct<book:long,type:string,authority:string,supersedes:long>>"
    old = spark.createDataFrame([(1, "a", [(1, None, None, None)]), (2, "b", [(2, "parts", "draft", None)])], kind)
    new = spark.createDataFrame([(2, "b2", [(3, "PARTS ", None, None), (2, None, "historical", 3)]), (3, "c", [(1, None, None, None)]), (4, "d", [(9, None, None, None)])], kind)
    books = spark.createDataFrame([(k,) for k in (1, 2, 3)], "book long")
    assert sorted((r.machine, r.name) for r in registry.upsert(old, new, books).collect()) == [(1, "a"), (2, "b2")]
    assert {(r.machine, r.problem) for r in registry.problems(new, old, books).collect()} == {(3, "BOOK_OF_ANOTHER_MACHINE"), (4, "UNKNOWN_BOOK")}
