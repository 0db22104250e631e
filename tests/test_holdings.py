"""What a collection holds, by cases worked by hand."""

from pyspark.sql import functions as F

from lodestone.operators import holdings


def test_pictures_are_found_by_words_and_moved_by_pages(spark):
    pictures = spark.createDataFrame([(1, "m", "a.pdf", 3, [7], "pump valve"), (2, "m", "a.pdf", 1, [4], "pump valve"), (3, "m", "a.pdf", 2, [5, 9], "pump valve"), (4, "m", "a.pdf", 4, None, "pump valve"), (5, "m", "a.pdf", 5, [4], "rotor"), (6, "x", "b.pdf", 1, [4], "pump valve")], "id long, scope string, source string, picture int, pages array<int>, text string")
    asked = spark.createDataFrame([(1, "m", "pump")], "query_id long, scope string, text string")
    pages = spark.createDataFrame([(1, 4), (1, 4)], "query_id long, page int")
    got = [(r.id, r.affinity) for r in holdings.search_pictures(pictures, asked, pages, 4).orderBy("rank").collect()]
    assert got == [(2, "same_page"), (3, "adjacent_page"), (1, "query_match"), (4, "query_match")]


def test_identifiers_in_cells_and_addresses(spark):
    texts = {"| Hydraulic motor | 2141 |": (True, 0.0), "2141 | 17": (False, 0.0), "motor 2141": (False, 0.0), "Tel 2141": (False, -15.0), "Tel 2141-101\nfax: 2141 | x": (False, -15.0), "valve | 2141-101": (False, 0.0), "a | 2141\nvalve | 2141": (True, 0.0)}
    df = spark.createDataFrame([(k,) for k in [*texts, None]], "t string")
    got = {r.t: (r.d, r.p) for r in df.select("t", holdings.defines_identifier(F.col("t"), F.lit("2141")).alias("d"), holdings.incidental_penalty(F.col("t"), F.array(F.lit("2141"))).alias("p")).collect()}
    assert got == {**texts, None: (False, 0.0)}


def test_inventory_of_pictures(spark):
    rows = [(1, 1, [("logo", 0.2), ("flow_chart", 0.9)]), (1, 2, [("table", 0.5), ("logo", 0.5)]), (1, 3, [("logo", 0.1)]), (1, 4, None), (1, 5, [])]
    p = spark.createDataFrame([(b, i, 1, x) for b, i, x in rows], "book int, picture int, page int, predictions array<struct<class:string,confidence:double>>")
    got = {r.picture: (r["class"], r.inventory, r.review) for r in holdings.picture_inventory(p, 0.6).collect()}
    assert got == {1: ("flow_chart", True, False), 2: ("table", True, True), 3: ("logo", False, False), 4: (None, False, True), 5: (None, False, True)}


def test_backfill_readiness_and_scopes(spark):
    rows = spark.createDataFrame([("g", "text_lane", "R1"), ("g", "picture_lane", "R1"), (None, "text_lane", None)], "generation string, target string, route string")
    entries = spark.createDataFrame([("g:text:R1", "v1"), ("g:text:R1", "v2"), ("g:vision:R1", "v1")], "entry string, version string")
    assert sorted((r.entry, r.seen_version) for r in holdings.backfill_due(rows, entries, "v2").collect()) == [(":text:", None), ("g:vision:R1", "v1")]
    assert holdings.backfill_due(rows, entries, "v3").count() == 3
    books = spark.createDataFrame([(1, True, 5), (2, None, 1)], "book int, index_ready boolean, searchable int").selectExpr("*", "0 AS excluded", "0 AS oversized", "CAST(NULL AS INT) AS visuals")
    machines = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 9)], "machine int, book int")
    assert holdings.readiness(books, machines).first()[:] == (2, 1, 6, 0, 0, 0, 3, 1)
    assert holdings.readiness(books.where("false"), machines.where("false")).first()[:] == (0, 0, 0, 0, 0, 0, 0, 0)
    s = spark.createDataFrame([(1, None), (None, " m "), (1, "m"), (None, " ")], "b int, m string")
    assert [r[0] for r in s.select(holdings.request_scope(F.col("b"), F.col("m"))).collect()] == [None, None, "BOTH_SCOPES", "NO_SCOPE"]


def test_provenance_and_numbers(spark):
    refs = spark.createDataFrame([(1, 5, None, "text", None, None, 3), (1, 2, "e", "text", None, None, 3), (1, 9, "e", "text", None, None, 4), (1, 7, None, "text", None, None, 3)], "chunk int, place int, entry string, source_type string, table int, cell int, source int")
    assert [tuple(r) for r in holdings.provenance(refs).orderBy("n").collect()] == [(1, 2, "e", 1), (1, 5, "text:None:None:3", 2)]
    c = spark.createDataFrame([(1, 4, 1), (1, 4, 0), (1, 2, 0), (2, None, 0), (2, 1, 0)], "book int, old int, part int")
    got = [(r.book, r.old, r.part, r.chunk_id) for r in holdings.renumbered(c, ["old", "part"]).orderBy("book", "chunk_index").collect()]
    assert got == [(1, 2, 0, "CHK-000001"), (1, 4, 0, "CHK-000002"), (1, 4, 1, "CHK-000003"), (2, None, 0, "CHK-000001"), (2, 1, 0, "CHK-000002")]
