"""Walks of references, reading order, scoped transcriptions, rare spellings, set signatures: against plain versions and cases worked by hand."""

import math
import random

import numpy as np

from lodestone.operators import ledger, outline, reading, scoping, spelling


def plain_walk(refs, deepest=None):
    kids, out = {}, {}
    for b, p, i, c in refs:
        kids.setdefault((b, p), {})[i] = c
    for b in {r[0] for r in refs}:
        seen, n, stack = {"root"}, 0, [("root", 0, ("root",))]
        while stack:
            p, i, path = stack.pop()
            if i not in kids.get((b, p), {}):
                continue
            c, depth = kids[b, p][i], len(path) - 1
            stack.append((p, i + 1, path))
            if deepest is not None and depth > deepest:
                continue
            n += 1
            kind = "ring" if c in path else "repeated" if c in seen else "entered"
            out[b, p, i] = (c, n, depth, kind)
            if kind == "entered":
                seen.add(c)
                stack.append((c, 0, (*path, c)))
    return {(b, p, i): out.get((b, p, i), (c, None, None, "apart")) for b, p, i, c in refs}


def walked(spark, refs, **how):
    df = spark.createDataFrame(refs, "book long, parent string, place int, child string")
    return {(r.book, r.parent, r.place): (r.child, r.position, r.depth, r.kind) for r in outline.walk(df, **how).collect()}


def test_walk_equals_a_stack(spark):
    rng, refs = random.Random(3), [(9, "x", 0, "y"), (9, "y", 0, "x"), (9, "root", 0, "z"), (9, "z", 0, "root"), (9, "z", 1, "w")]
    for b in range(6):
        names, kids = [f"n{i}" for i in range(rng.choice([1, 5, 30]))], {}
        for i, n in enumerate(names):
            kids.setdefault(rng.choice(["root", *(names if b % 3 == 0 else names[:i])]), []).append(n)
        for _ in range(len(names) // 4 if b % 2 == 0 else 0):
            kids.setdefault(rng.choice(["root", *names]), []).insert(0, rng.choice(names))
        refs += [(b, p, i, c) for p, cs in kids.items() for i, c in enumerate(cs)]
    assert walked(spark, refs) == plain_walk(refs)
    chain = [(1, f"g{i - 1}" if i else "root", 0, f"g{i}") for i in range(250)] + [(1, "g199", 1, "t"), (1, "root", 1, "end")]
    got = walked(spark, chain, deepest=199)
    assert got == plain_walk(chain, 199) and got[1, "root", 1] == ("end", 201, 0, "entered")


def test_walk_of_a_chain_of_ten_thousand(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("1L AS book", "if(id = 0, 'root', concat('c', id - 1)) AS parent", "0 AS place", "concat('c', id) AS child")
    assert tuple(outline.walk(chain).selectExpr("count(*)", "max(depth)", "count_if(position = depth + 1)").first()) == (n, n - 1, n)


def test_walk_of_broken_structure(spark):
    refs = [(1, None, 0, "a"), (1, "root", 0, None), (None, "root", 0, "a"), (1, "root", 2, "b"), (1, "b", 3, "c"), (1, "b", 7, "d"), (2, "root", 0, "a"), (2, "root", 0, "b")]
    got = walked(spark, refs)
    assert got == {(1, "root", 0): (None, 1, 0, "broken"), (1, "root", 2): ("b", 2, 0, "entered"), (1, "b", 3): ("c", 3, 1, "entered"), (1, "b", 7): ("d", 4, 1, "entered"), (2, "root", 0): ("a", 1, 0, "entered")}
    assert walked(spark, []) == {}


def test_inversions_by_merging():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 7, 64, 101]:
        for _ in range(20):
            v = np.array([rng.randrange(max(1, n // 2 + 1)) for _ in range(n)], dtype=np.int64)
            assert reading.inversions(v) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))
    assert reading.inversions(np.arange(200_000)[::-1]) == 200_000 * 199_999 // 2


ITEM = "book long, page long, place long, kind string, label string, text string, class string, l double, t double, r double, b double"


def test_reading_order_of_pages(spark):
    items, pages = [], [(1, p, 600.0, 800.0) for p in range(1, 8)]
    add = lambda p, order, boxes, label="text", kind="texts", texts=None: [items.append((1, p, order.index(k), kind, label, texts[k] if texts else f"Paragraph {p} {k}", None, *map(float, box))) for k, box in enumerate(boxes)]
    column = [(50, 740 - 100 * k, 550, 700 - 100 * k) for k in range(5)]
    add(1, [0, 3, 4, 1, 2], column)  # read as A D E B C
    add(2, list(range(6)), [(50, 720, 260, 680), (50, 620, 260, 580), (50, 520, 260, 480), (340, 720, 550, 680), (340, 620, 550, 580), (340, 520, 550, 480)])
    add(3, [0, 3, 4, 1, 2], column, texts=["Table of Contents", *[f"Line {k}" for k in range(4)]])
    add(4, [0, 3, 4, 1, 2], [(50, 740 - 100 * k, 550, 739 - 100 * k) for k in range(5)])  # too flat
    add(5, [0, 3, 4, 1, 2], column, label="page_footer")
    add(6, [0, 3, 4, 1, 2], column)
    items.append((1, 6, 99, "tables", None, "", None, 40.0, 800.0, 560.0, 0.0))  # holds all of them
    add(7, [0, 1, 2, 3, 4], [(50, 640 - 100 * k, 550, 600 - 100 * k) for k in range(5)])
    items += [(1, None, 0, "texts", None, "x", None, 0.0, 1.0, 1.0, 0.0), (1, 8, 0, "texts", None, "no box", None, None, 1.0, 1.0, 0.0)]
    i, p = spark.createDataFrame(items, ITEM), spark.createDataFrame(pages, "book long, page long, width double, height double")
    got = {r.page: r for r in reading.reading_order(i, p).collect()}
    assert got[1].anomaly and got[1].layout == "row_major" and got[1].inversions == 4 and math.isclose(got[1].score, 0.4)
    assert not got[2].anomaly and got[2].two_columns and got[2].column_ratio == 0 and got[2].layout == "column_major"
    assert got[3].skip == "contents_or_index_page" and got[6].skip == "insufficient_comparable_items" and not got[7].anomaly
    assert 4 not in got and 5 not in got and 8 not in got
    c = reading.coverage(reading.reading_order(i, p), p).first()
    assert (c.pages, c.checked, c.two_columns, c.anomalies, c.status) == (7, 3, 1, 1, "anomaly")
    assert reading.reading_order(i.where("false"), p).count() == 0
    few = reading.coverage(reading.reading_order(i.where("page = 7"), p.where("false").unionByName(spark.range(1, 21).selectExpr("1L AS book", "id AS page", "600D AS width", "800D AS height"))), spark.range(1, 21).selectExpr("1L AS book", "id AS page")).first()
    assert (few.checked, few.coverage, few.status) == (1, 0.05, "limited")


def test_scope_takes_off_what_leaked_in():
    got = scoping.scope_of("1.1 Controls\n---\nswitches\n: Speed - Metre/Knot Choice\n(※ Only for the main indicator. Not for sub-indicators.)\n: Brighter", ": Speed - Metre/Knot Choice e nn  n n naas sub-indicators.)", ["1.1 Controls", "switches"], [": Brighter", "α"])
    assert got["text"] == ": Speed - Metre/Knot Choice\n(※ Only for the main indicator. Not for sub-indicators.)" and not got["reasons"] and got["trimmed"] and (got["before_hits"], got["after_hits"]) == (2, 1)
    only = scoping.scope_of("19.1.3.1    Below proper heat", "19.1.3    Settling Tank", ["19.1.2 Purifier"], ["19.1.3.1    Below proper heat"])
    assert only["reasons"] == ["ONLY_CONTEXT_OR_ADJACENT_BLOCK_RETURNED"] and only["text"] == ""
    other = scoping.scope_of("IEC 1-10\nd) Proof case\ne) Proof case", "In addition, lasting supervision requires that the management will set aside means and found routines.", ["Heading"], ["Next"])
    assert "NO_TARGET_LEXICAL_OVERLAP" in other["reasons"]
    label = scoping.scope_of("HW-1\n8W\nDECK\nTransmitter Terminal\nDN\n+1\nRX\nRX\nTX", "Transmilter Terminal", ["HW-1"], ["DECK"])
    assert label["text"] == "Transmitter Terminal" and "DN" in label["suffix"] and label["repeated"]
    wrapped = scoping.scope_of("<think>hm</think>```text\nHere is the transcription:\nTarget: open the valve\n```", "open the valve", [], [])
    assert wrapped["text"] == "open the valve" and wrapped["foreign"]
    assert scoping.scope_of(None, None, None, None)["reasons"] == ["EMPTY_TRANSCRIPTION"]
    assert "NOVEL_TOKEN_DUPLICATION" in scoping.scope_of("turn on on the pump", "turn on the pump", [], [])["reasons"]
    assert scoping.scope_of("open\nopen", "open", [], [])["text"] == "open"


def test_pruned_windows_change_nothing():
    rng, words = random.Random(5), "pump valve open close the drain 3 bar - seal main A-12 mm; ok? of and".split()
    line = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(1, n)))
    for _ in range(300):
        target = line(14)
        said = "\n".join(rng.choice([line(6), line(3), target, target[: len(target) // 2], "---", "x", "Answer: " + line(4)]) for _ in range(rng.randint(1, 9)))
        assert scoping.scope_of(said, target, ["pump"], ["seal main"], True) == scoping.scope_of(said, target, ["pump"], ["seal main"], True, prune=False)


def test_scope_of_rows(spark):
    rows = [(1, "the pump\nopen the valve", "open the valve", ["the pump"], None), (2, None, "x", [], []), (3, "pressure 12 bar", "pressure 13 bar", [], [])]
    df = spark.createDataFrame(rows, "id int, said string, text string, before array<string>, after array<string>")
    got = {r.id: r.scope for r in scoping.scope(df, "said", "text", "before", "after").collect()}
    assert got[1].accepted and got[1].status == "SCOPED" and got[1].text == "open the valve"
    assert got[2].reasons == ["EMPTY_TRANSCRIPTION"] and got[2].status == "UNRESOLVED"
    assert "CRITICAL_SOURCE_TOKEN_NOT_PRESERVED" in got[3].reasons and got[3].text == ""


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_rare_spellings_against_all_pairs(spark):
    rng, spellings = random.Random(8), {}
    letters = "abcdefgh"
    for b in range(2):
        for _ in range(120):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(5, 17)))
            spellings[b, w] = rng.choice([5, 9, 40])
            for _ in range(3):
                x = list(w)
                for _ in range(rng.randint(1, 3)):
                    k = rng.randrange(len(x))
                    rng.choice([lambda: x.__setitem__(k, rng.choice(letters)), lambda: x.insert(k, rng.choice(letters)), lambda: x.pop(k)])()
                spellings.setdefault((b, "".join(x)), rng.choice([1, 2]))
    ends = ["ingly", "ation", "ations", "tion", "tions", "ing", "ers", "ies", "ied", "ed", "er", "es", "s", "ly", "d", "y"]
    stems = lambda w: {w} | {w[: -len(e)] for e in ends if w.endswith(e) and len(w) - len(e) >= 5}
    want = {}
    for (b, rare), m in spellings.items():
        found = []
        for (c, often), n in spellings.items():
            longest = max(len(rare), len(often))
            if b == c and m <= 2 and len(rare) >= 6 and n >= max(5, 4 * m) and len(often) >= 4 and abs(len(rare) - len(often)) <= 2 and not stems(rare) & stems(often):
                d = _edits(rare, often)
                if 1 <= d <= (1 if longest <= 6 else 2) and 1 - d / longest >= 0.84:
                    found.append((1 - d / longest, n, -d, often))
        if found:
            like, n, d, often = max(found)
            want[b, rare] = (often, n, -d, round(like, 9))
    df = spark.createDataFrame([(b, w, n, w) for (b, w), n in spellings.items()], "book int, word string, n long, surface string")
    got = {(r.book, r.rare): (r.frequent, r.n, r.edits, round(r.likeness, 9)) for r in spelling.near_pairs(df).collect()}
    assert got == want and {x[2] for x in got.values()} == {1, 2}


def test_misreadings_stand_apart_from_their_glossary(spark):
    texts = [("b", k, "the hydraulic pump") for k in range(6)] + [("b", 7, "the hydrauilc pump"), ("b", 8, "hydraulik hydraulic"), ("b", 9, "an HYDRAUL1C tag"), ("b", 10, None), (None, 11, "hydraulc"), ("c", 12, "hydraulc")]
    df = spark.createDataFrame(texts, "book string, item int, text string")
    got = spelling.misreadings(df).collect()
    assert [(r.item, r.rare, r.frequent, r.edits) for r in got] == []  # two edits in nine letters are too unlike, and item 8 has both side by side
    df = df.unionByName(spark.createDataFrame([("b", 13, "a hydraullc pump")], df.schema))
    got = spelling.misreadings(df).collect()
    assert [(r.item, r.rare, r.rare_n, r.frequent, r.n, r.edits) for r in got] == [(13, "hydraullc", 1, "hydraulic", 7, 1)]
    assert [(r.item, r.evidence) for r in spelling.first_candidates(spelling.misreadings(df), "book", 1).collect()] == [(13, 1)]


def test_signature_of_a_set(spark):
    rows = [("a", k, "x") for k in range(50)] + [("b", k, "x") for k in reversed(range(50))] + [("c", k, "x") for k in range(50)] + [("c", 3, "x"), ("d", None, None)]
    df = spark.createDataFrame(rows, "g string, k int, v string")
    got = {r.g: r.signature for r in ledger.signature(df.repartition(7), "g", ["k", "v"]).collect()}
    assert got["a"] == got["b"] != got["c"] and len(set(got.values())) == 3
    assert got == {r.g: r.signature for r in ledger.signature(df.coalesce(1), "g", ["k", "v"]).collect()}
    plan = ledger.signature(df, "g", ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
