"""Scans of books and their archives, by cases worked by hand."""

import io
import json
import os
import zipfile

from lodestone.operators import scans
from lodestone.sources import chunks


def fragments(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.reasons for r in scans.fragments(df).orderBy("id").collect()]


def test_fragments(spark):
    words = "pump valve motor seal drain cover plate"
    got = fragments(spark, f"{words} x q z", f"{words} A B C", f"{words} don't l'eau d'un", "x q z", None, f"{words} {words} x ab ab ab", f"{words} x ab cd", f"{words} {words} {words} x ab ab cd cd", "über-maß x-y " + words)
    assert got == [["excessive_single_letter_fragments"], [], [], [], [], ["fragmented_alpha_tokens", "repeated_short_ocr_fragments"], ["fragmented_alpha_tokens"], ["repeated_short_ocr_fragments"], []]


def test_suspicious_texts_and_cells(spark):
    texts = {1: "flow � 3", 2: "\x07", 3: "set 1l0 mm", 4: "torque 12 Nrn", 5: "l A", 6: "1O5", 7: "10 bar", 8: None, 9: "al1", 10: "at most 5", 11: "", 12: "5%x"}
    df = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: (r.reasons, r.technical) for r in scans.suspicious(df).collect()}
    assert got == {1: (["unicode_replacement_character"], False), 2: (["control_character"], False), 3: (["lowercase_l_inside_numeric_token", "numeric_letter_ambiguity"], False), 4: (["unit_like_ocr_confusion"], False), 5: (["unit_like_ocr_confusion"], False), 6: (["numeric_letter_ambiguity"], False)}
    cells = {r.id: (r.reasons, r.technical) for r in scans.suspicious(df, cells=True).collect()}
    assert cells[1][0] == ["unicode_replacement_character", "replacement_character"] and cells[2][0] == ["control_character", "control_or_surrogate_character"] and cells[11][0] == ["private_use_character"] and 6 not in cells
    more = spark.createDataFrame([(1, "1l0 and 10 bar"), (2, "1l0 at most"), (3, "1l0 5%x")], "id int, text string")
    assert all(r.technical for r in scans.suspicious(more).collect())


def test_running_bands_and_broken_words(spark):
    pages = spark.createDataFrame([(1, p, 800.0) for p in range(1, 21)], "book int, page int, height double")
    items = [(1, p, 1, f"Manual rev {p}", 790.0, 780.0, None) for p in range(1, 6)] + [(1, p, 2, "middle", 400.0, 390.0, None) for p in range(1, 9)] + [(1, p, 3, "foot", 795.0, 799.0, "TOPLEFT") for p in range(1, 5)]
    items += [(1, 3, 4, "to be con-", 60.0, 50.0, None), (1, 20, 4, "to be con-", 60.0, 50.0, None), (1, 4, 5, "high con-", 700.0, 690.0, None), (1, None, 6, "x", 1.0, 0.0, None), (1, 5, 7, None, 1.0, 0.0, None)]
    i = spark.createDataFrame(items, "book int, page int, place int, text string, t double, b double, origin string")
    assert [tuple(r) for r in scans.running_bands(i, pages).collect()] == [(1, "top", "manual rev #", 5, 1)]
    assert [tuple(r) for r in scans.broken_words(i, pages).collect()] == [(1, 3, 4, "to be con-")]


def test_header_signatures(spark):
    head = lambda *t: [(x, True) for x in t] + [("body", False)]
    rows = [(1, k, 0, head("No", " Part  name ")) for k in range(4)] + [(1, 4, 1, head("No", "Part name")), (1, 5, 0, head("No")), (1, 6, 0, [("x", False)]), (1, 7, None, None), (2, 8, 0, head("No", "Part name"))]
    t = spark.createDataFrame(rows, "book int, id int, captions int, cells array<struct<text:string,header:boolean>>")
    got = {r.id: (r.headers, r.repeats, r.finding) for r in scans.header_signatures(t).collect()}
    assert got == {**{k: (["No", "Part name"], 5, "REPEATED_TABLE_NEEDS_CONTEXT") for k in range(4)}, 6: ([], 0, "TABLE_WITHOUT_MARKED_HEADER"), 7: ([], 0, "TABLE_WITHOUT_MARKED_HEADER")}


def test_a_book_against_its_source(spark):
    words = " ".join("".join(chr(97 + (k * 7 + j * 3) % 26) for j in range(6)) for k in range(26))
    texts = spark.createDataFrame([(1, 1, 0, words), (1, 2, 0, "other"), (1, 3, 0, "x"), (2, 1, 0, words)], "book int, page int, place int, text string")
    pages = spark.createDataFrame([(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0), (1, 3, 500.0, 800.0), (2, 1, 600.0, 800.0)], "book int, page int, width double, height double")
    source = spark.createDataFrame([(1, 1, words, 600.0, 800.0, 1), (1, 2, words.upper(), 620.0, 800.0, 0), (1, 3, None, 600.0, 800.0, 2), (2, 1, words, 600.0, 800.0, 0), (2, 2, "x", 600.0, 800.0, 0)], "book int, page int, text string, width double, height double, images int")
    got = {(r.book, r.page, r.finding): round(r.measure, 4) for r in scans.cross_check(texts, pages, source).collect()}
    assert got == {(2, None, "pdf_page_count_mismatch"): 1.0, (1, 2, "pdf_text_coverage_gap"): 0.0, (1, 3, "pdf_geometry_mismatch"): 0.1667, (1, 3, "image_page_low_text"): 1.0}


def test_overlays_of_a_chunk(spark):
    c = spark.createDataFrame([(1, [3, 4, 3], "a"), (2, [9], "b"), (3, None, "c")], "id int, pages array<int>, text string")
    o = spark.createDataFrame([(3, 7, 10, "applied", "s", ["x"]), (4, 7, 10, "applied", "s", ["x"]), (4, 8, 11, "applied", "t", None), (3, 9, 12, "rejected", "u", None), (None, 5, 13, "applied", "v", None)], "page int, entry int, created int, status string, summary string, visible array<string>")
    got = {r.id: [(x.entry, x.page) for x in r.overlays] for r in scans.page_overlays(c, o, most=8).collect()}
    assert got == {1: [(8, 4), (7, 3)], 2: [], 3: []}


def _archives(folder):
    def make(name, members, **how):
        with zipfile.ZipFile(folder / name, "w", **how) as z:
            for m, body in members.items():
                z.writestr(m, body)

    make("good.zip", {"meta.json": json.dumps({"padding": "x" * 10_000}), "broken.json": "{", "book.json": json.dumps({"texts": [{"text": "manual", "uri": "./art/a%20b.png"}, {"uri": "data:image/png,x"}]}), "art/a b.png": b"png"})
    make("lacks.zip", {"book.json": json.dumps({"texts": [], "p": [{"uri": "art/none.png"}, {"uri": "http://x/y"}]})})
    make("two.zip", {"a.json": '{"texts": []}', "b.json": '{"texts": []}'})
    make("bomb.zip", {"book.json": json.dumps({"texts": ["0" * 3_000_000]})}, compression=zipfile.ZIP_DEFLATED)
    make("crc.zip", {"book.json": json.dumps({"texts": []}), "data.bin": b"0123456789" * 50})
    raw = bytearray((folder / "crc.zip").read_bytes())
    raw[raw.index(b"0123456789") + 3] ^= 1
    (folder / "crc.zip").write_bytes(raw)
    lying = io.BytesIO((folder / "bomb.zip").read_bytes())
    raw = bytearray(lying.getvalue())  # the directory says that the member is small
    at = raw.rindex(b"PK\x01\x02")
    raw[at + 24 : at + 28] = (10).to_bytes(4, "little")
    (folder / "lies.zip").write_bytes(raw)
    (folder / "none.zip").write_bytes(b"no archive")
    return sorted(str(folder / f) for f in os.listdir(folder))


def test_archives_are_read_in_pieces(spark, tmp_path):
    paths = _archives(tmp_path)
    want = {"good.zip": ("ok", 4, 0, "book.json", 2, 1, 0), "lacks.zip": ("warning", 1, 0, "book.json", 2, 1, 1), "two.zip": ("several_documents", 2, 0, None, 0, 0, 0), "bomb.zip": ("damaged", 1, 1, None, 0, 0, 0), "crc.zip": ("damaged", 2, 1, "book.json", 0, 0, 0), "lies.zip": ("damaged", 1, 1, None, 0, 0, 0), "none.zip": ("no_archive", 0, 0, None, 0, 0, 0)}
    local = lambda path: open(path.removeprefix("file:"), "rb")  # noqa: E731, SIM115
    for opener in (None, local):
        m = chunks.archive_members(spark, paths, most=1_000_000, opener=opener)
        status = {(r.path.rsplit("/", 1)[1], r.member): r.status for r in m.collect()}
        assert status["bomb.zip", "book.json"] == "too_large" and status["crc.zip", "data.bin"] == "damaged" and status["lies.zip", "book.json"] in ("damaged", "too_large") and status["none.zip", None] == "no_archive"
        got = {r.path.rsplit("/", 1)[1]: (r.status, r.members, r.damaged, r.member, r.references, r.internal, r.missing) for r in chunks.integrity(m).collect()}
        assert got == want
    over = chunks.archive_members(spark, paths, largest=1_000).where("status = 'archive_too_large'").collect()
    assert {r.path.rsplit("/", 1)[1] for r in over} >= {"good.zip", "bomb.zip"} and all(r.document is None for r in over)
