"""Fidelity, chunk budgets, structure, reranking and rest periods against plain versions and cases worked by hand."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import answers, fidelity
from lodestone.operators import chunking, features, integrity
from lodestone.plans import structure
from lodestone.streaming import governor


@pytest.mark.parametrize("name", sorted(structure.ROWS))
def test_query_runs_on_the_whole_table(spark, sf, name):
    df = structure.ROWS[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    assert rows


def one(spark, df, column):
    return df.select(column).first()[0]


def text_of(spark, *texts):
    return spark.createDataFrame([texts], ", ".join(f"{c} string" for c in "ab"[: len(texts)]))


def test_garble_judges_shape_not_words(spark):
    g = lambda t: one(spark, fidelity.garble(text_of(spark, t), "a"), "garble")
    assert g("")["score"] == 1.0 and g(None)["confirmed"]
    assert g("Check the main pump before the engine starts every morning")["structurally_normal"]
    # Every ordinary piece is tiny: 0.34; two runs of spaced letters over 16 pieces: 0.15 * 0.25 at least.
    bad = g("t h e p u mp i s b r o ke n a t")
    assert bad["tiny_token_ratio"] == 1.0 and bad["confirmed"]
    assert g("\ufffd\ufffd")["replacement_chars"] == 1.0
    assert g("PLC RPM MCC PT100")["score"] == 0.0
    # The third and fourth "ab" of six pieces; and shapes a-p-d-p-a (5) of one long word.
    assert g("ab ab ab ab word word")["repeated_broken_fragments"] == round(4 / 6, 4)
    assert g("ab-1-cdé")["abnormal_token_transitions"] == 0.5


def plain_spans(text):
    """Spans by the patterns alone, without the module's reading."""
    return {(k, m.start(), m.end()) for k, p in fidelity.PATTERNS.items() for m in re.finditer(p, text)}


def test_technical_tokens(spark):
    def read(t):
        df = fidelity.read(text_of(spark, t), "a", "r")
        return df.select(fidelity.critical_set(F.col("r")).alias("c"), fidelity.technical(F.col("r")).alias("t"), "r").first()

    assert set(read("set 24 V at X12, 5 to 7").c) >= {"24v", "x12", "5to7"}
    assert read("24V 400V").t.dominant and not read("plain words only").t.classes
    assert read(None).t.asDict() == {"classes": [], "coverage": 0.0, "dominant": False, "prose_classes": []}
    assert read("If the pump fails, stop. Check the fuse").t.prose_classes == ["conditional_fault", "imperative_check"]
    for t in ("P12 = 3.5 kW\n IP 54, EN 60204-1:2 ± 5 mm and 10 - 20 °C", "x" * 50 + " 24 V 24V M8x20 ﬁne", "5 to 7 mm²"):
        row, plain = read(t), fidelity.unicodedata.normalize("NFKC", t)
        assert {(s.kind, s.start, s.stop) for s in row.r.spans} == plain_spans(plain)
        inside = {i for k, a, b in plain_spans(plain) if k in fidelity.TECHNICAL for i in range(a, b) if not plain[i].isspace()}
        assert row.t.coverage == round(len(inside) / sum(not c.isspace() for c in plain), 4)


def test_obligations_split_at_the_next_verb_only(spark):
    r = one(spark, fidelity.read(text_of(spark, "Replace the fuse and holder assembly and check the plug. Then stop."), "a", "r").select(fidelity.obligations(F.col("r")).alias("o")), "o")
    assert [(x.verb, x.object) for x in r] == [("replace", "fuse and holder assembly"), ("check", "plug"), ("stop", "")]
    fuse = ("replace", "fuse")
    assert fidelity.unmatched_of([fuse, fuse], [fuse]) == [fuse]
    assert fidelity.unmatched_of([("check", "oil level")], [("check", "oil levels")]) == []
    assert fidelity.unmatched_of([("check", "oil")], [("stop", "oil")]) == [("check", "oil")]


@pytest.mark.parametrize(
    ("source", "proposed", "reasons"),
    [
        ("The pump runs at 24 V", "The pump runs at 24V", []),
        ("The pump runs at 24 V", "The pump runs at 42 V", ["UNSUPPORTED_NEW_TECHNICAL_TOKEN", "TECHNICAL_TOKENS_NOT_PRESERVED"]),
        ("The pump", "", ["EMPTY_CORRECTION"]),
        (None, None, ["EMPTY_CORRECTION"]),
        ("at 85 o C", "at 85°C", ["UNSUPPORTED_NEW_TECHNICAL_TOKEN"]),
        ("short", "a very much longer text than short", ["EDIT_DISTANCE_TOO_LARGE", "LENGTH_RATIO_OUT_OF_RANGE", "SOURCE_CHARACTERS_NOT_PRESERVED"]),
    ],
)
def test_corrections(spark, source, proposed, reasons):
    got = fidelity.correction_fidelity(text_of(spark, source, proposed), "a", "b")
    assert got.columns == ["a", "b", "fidelity"] and got.first().fidelity.reasons == reasons


def test_transcriptions(spark):
    judge = lambda a, b, cell=False: fidelity.transcription_safety(text_of(spark, a, b), "a", "b", cell).first().safety
    assert judge("Oil pressure low", "Oil presure low").accepted
    dropped = judge("Alarm rings. Replace the filter.", "Alarm rings. The filter.")
    assert "TROUBLESHOOTING_ACTION_DROPPED" in dropped.reasons and (dropped.missing_verbs, dropped.missing_objects) == (["replace"], ["filter"])
    assert "CRITICAL_SOURCE_TOKEN_NOT_PRESERVED" in judge("Set to 24 V", "Set to 42 V").reasons
    # A bare number counts in a cell alone.
    assert judge("row 7", "row 8").accepted and not judge("row 7", "row 8", cell=True).accepted
    assert judge(None, "x").accepted


def test_json_and_segments(spark):
    assert answers.first_object('<think>x</think> ```{"a": {"b": "}"}}``` {') == '{"a":{"b":"}"}}'
    assert answers.first_object('{"a": 1') is None and answers.first_object(None) is None
    for text in ("", "one", " lead and trail ", "a 12 mm bolt " * 400):
        parts = one(spark, text_of(spark, text).select(answers.text_segments(F.col("a"), 50).alias("p")), "p")
        assert "".join(parts) == text and all(len(p) <= 50 for p in parts)
        assert not any(p.rstrip().endswith("12") for p in parts)
    said = F.lit('{"n": 4, "confidence": 0.')
    assert text_of(spark, "").select(answers.closed_number(said, "n"), answers.closed_number(said, "confidence"), answers.closed_string(said, "n")).first()[:] == (4.0, None, None)
    for raw, want in (("<think>a\nb</think> yes ", "yes"), ("rest of it</think>yes", "yes"), ("yes<think>cut", "yes"), ("plain", "plain")):
        assert one(spark, text_of(spark, raw).select(answers.completion(F.col("a")).alias("c")), "c") == want


def _greedy(units, joint, head, parent_tokens, parent_length, budget):
    """Packs by measuring each whole candidate text anew."""
    groups = []
    for u in units:
        text = head + joint.join([*(groups[-1] if groups else []), u]) + "\n"
        n = max(1, math.ceil(len(text) * (parent_tokens / parent_length) * 1.08), math.ceil(len(text) / 2.5), len(re.findall(r"[A-Za-z]+|\d+(?:\.\d+)?|[^\w\s]", text)))
        if groups and n <= budget:
            groups[-1].append(u)
        else:
            groups.append([u])
    return [head + joint.join(g) + "\n" for g in groups]


def test_chunks_over_budget_are_split_like_a_plain_packer(spark, sf):
    table = "| name | size |\n| --- | --- |\n" + "".join(f"| part {k} | {k} mm |\n" for k in range(40))
    prose = " ".join(f"Sentence number {k} says little." for k in range(60))
    blocks = "\n\n".join(f"Block {k} " + "word " * 30 for k in range(6))
    texts = {1: (table, 400), 2: (prose, 300), 3: (blocks, 300), 4: ("short", 3), 5: ("unbroken " * 300, 900), 6: (None, None), 7: ("", 900), 8: ("a | b\nc | d\n" * 40, 500)}
    df = spark.createDataFrame([(k, t, n) for k, (t, n) in texts.items()], "id long, text string, n long")
    got = {}
    for r in chunking.split_over_budget(df, "id", "text", "n", 100).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r)
    lines = table.splitlines()
    assert [r.text for r in got[1]] == _greedy(lines[2:], "\n", "\n".join(lines[:2]) + "\n", 400, len(table), 100)
    assert all(r.text.startswith(lines[0]) and r.boundary == "table_row" and r.n_tokens <= 100 for r in got[1])
    assert [r.text for r in got[2]] == _greedy(re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", prose), "\n\n", "", 300, len(prose), 100)
    assert [r.text for r in got[3]] == _greedy([b.strip() for b in blocks.split("\n\n")], "\n\n", "", 300, len(blocks), 100)
    assert [r.text for r in got[8]] == _greedy(texts[8][0].splitlines(), "\n", "", 500, len(texts[8][0]), 100)
    for k in (4, 5, 6, 7):
        assert [(r.text, r.n_parts, r.boundary) for r in got[k]] == [(texts[k][0], 1, "none")]


def test_walks_end_in_cycles_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8), (4, None)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert {(r.node, r.depth) for r in integrity.reachable(edges, roots).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    nodes = spark.createDataFrame([(1,), (2,), (3,), (8,)], "id long")
    assert sorted((r.src, r.dst or 0) for r in integrity.broken_references(edges, nodes, "dst", "id").collect()) == [(3, 4), (4, 0)]


def test_features_by_hand(spark):
    cases = {
        "no question": (None, "text", {}), "nothing": ("", None, {}),
        # Subject pump (1.55 + 2.6); voltage with its unit (5.2). The wrong subject for an attribute (-4), the unit alone (2.2).
        "value": ("pump voltage", "pump at 24 V", {}), "other": ("pump voltage", "motor at 24 V", {}),
        "heading": ("oil filter", "oil filter", {"headings": ["oil filter"]}), "procedure": ("replace filter", "remove filter, clean, install, tighten", {}),
        "load": ("swl crane", "crane SWL: 5 t", {}), "wide": ("oil filter", "oil " + "word " * 12 + "filter", {}),
        "in heading": ("see section 6.1", "x", {"headings": ["6.1 Pumps"]}), "in text": ("see section 6.1", "6.1 x", {}), "nowhere": ("see section 6.1", "x", {}),
        "item": ("item 033 emergency stop", "033 emergency-stop", {}), "other item": ("item 034 emergency stop", "033 emergency-stop", {}),
    }
    base = {"headings": [], "source": "a.pdf", "content_type": "prose", "stitched": False}
    rows = [(name, q, t, *(base | more).values()) for name, (q, t, more) in cases.items()]
    df = spark.createDataFrame(rows, "name string, question string, text string, headings array<string>, source string, content_type string, stitched boolean")
    got = {r["name"]: r.features for r in features.score_features(df).collect()}
    want = {
        "no question": 0, "nothing": 0, "value": 1.55 + 2.6 + 5.2, "other": -4.0 + 2.2,
        # Two subject words next to each other (3.4), in a heading as well (2 x 0.8); 13 words apart (2).
        "heading": 2 * 1.55 + 2.6 + 1.6 + 3.4, "wide": 2 * 1.55 + 2.6 + 2.0,
        # Four evidence words (2.88 + 1.2 + 0.4); replace itself is no subject.
        "procedure": 1.55 + 2.6 + 4 * 0.72 + 1.2 + 0.4,
        "load": 2 * 1.55 + 2.6 + 3.4 + 20.0,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert got["in heading"] > got["in text"] > got["nowhere"]
    assert got["item"] - got["other item"] >= 26


def test_identifier_guard(spark):
    fused = spark.createDataFrame([(q, k, r, t) for q in (1, 2, 3) for k, r, t in ((10, 1, "pump A-12 only"), (20, 2, "B-7 here"), (30, 3, "none"))], "q long, k long, rank int, text string")
    top = spark.createDataFrame([(1, 20, "B-7 here", "fault of part B-7"), (2, 20, "B-7 here", "no identifier"), (3, 20, "B-71 here", "part B-7")], "q long, k long, text string, question string")
    got = {(r.q, r["rank"]): (r.k, r.guarded) for r in features.guard_identifiers(fused, top, "q", "k").collect()}
    assert [got[1, n] for n in (1, 2, 3)] == [(20, True), (10, False), (30, False)]
    assert [got[q, n] for q in (2, 3) for n in (1, 2, 3)] == [(10, False), (20, False), (30, False)] * 2


def test_rest_rules_by_hand():
    rules, state = governor.Rules(), governor.FRESH
    said = []
    for at, seconds, speed in ((0, 10, 9), (100, 10, 5), (200, 10, 6), (300, 5, 7.5), (2300, 5, 9), (2400, 700, 9), (4300, 10, None), (9000, 5400, 9)):
        state, why = governor.step(state, at, seconds, speed, rules)
        said.append((why, state[0], state[2]))
    assert said[2] == ("repeated_slowdown", 30.0, 1400) and said[3] == ("not_recovered", 35.0, 2100)
    # The rest was over at 2100: the budget begins anew, and a fast call ends the probation.
    assert said[4] == (None, 5.0, 0.0) and said[5][0] == "long_call" and said[5][2] == 4200
    assert said[6] == (None, 10.0, 0.0) and said[7][0] == "long_call"


def test_stream_equals_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    calls = structure.calls(e)
    batch = {tuple(r) for r in governor.workload(calls).collect()}
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = governor.workload_stream(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert len(batch) == e.count() and any(r[5] for r in batch)


def test_workload_keeps_state_over_batches_and_null_devices(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(d, k, float(k * 10), 300.0, 9.0) for d in ("a", None) for k in range(20)]
        got = governor.workload(spark.createDataFrame(rows, "device string, event_id long, at double, seconds double, speed double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.device, r.event_id) for r in got if r.reason == "budget_reached"} == {(d, k) for d in ("a", "") for k in (17, 18, 19)}


def test_native_token_estimate(spark):
    df = spark.createDataFrame([("a1 b2, c3",), ("",)], "t string")
    got = [r[0] for r in df.select(chunking.estimate(F.length("t"), chunking.pieces(F.col("t")), F.lit(10), F.lit(100))).collect()]
    assert got == [7, 1]
