"""Whitening, token counts by transducer and collocations: against numpy, the tokenizers library and plain counting."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import cholesky_whitening as cw
from lodestone.llm import collocations as co
from lodestone.llm import queries as q
from lodestone.llm import token_transducer as tt


def test_every_new_query_against_a_plain_version(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    lib = Tokenizer.from_file(q.tokenizer_path(q.WORD_TOKENIZER))
    want = {d: len(e.ids) for d, e in zip(docs["doc_id"], lib.encode_batch([t or "" for t in docs["text"]], add_special_tokens=False), strict=True)}
    got = q.op12_token_transducer(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)
    assert {r.doc_id: r.n_bytes for r in got} == {d: len((t or "").encode()) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert _whitened(q.op11_cholesky_whitening(spark, sf)) == _plain_whitening(rows)


def _plain_whitening(rows, k=4):
    """vec_id and component -> n, deviation and, in size, whitened and explained, by eigh of the covariance."""
    out = {}
    for d in {len(v) for _, v in rows if v}:
        grid = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v and len(v) == d]
        fit = sorted({tuple(x) for _, x in grid})
        n, sums = len(fit), [sum(x) for x in zip(*fit, strict=True)]
        a = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
        value, vector = np.linalg.eigh(a.T @ a / n)
        value, vector = value[::-1], vector[:, ::-1]
        for i, x in grid:
            off = [n * c - s for c, s in zip(x, sums, strict=True)]
            for j in range(min(k, int((value > value[0] * d * 1e-14).sum()) if value[0] > 0 else 0)):
                w = float(np.array(off) / n @ vector[:, j] / np.sqrt(value[j]))
                out.setdefault((i, j + 1), []).append((n, sum(o * o for o in off), round(abs(w), 7), round(value[j] / value.sum(), 9)))
    return {key: sorted(v) for key, v in out.items()}


def _whitened(df):
    out = {}
    for r in df.collect():
        assert r.identity_error <= 1e-4
        out.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, round(abs(r.whitened), 7), round(r.explained, 9)))
    return {key: sorted(v) for key, v in out.items()}


VECTORS = "vec_id long, embedding array<float>, extra string"


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=5) * [8, 4, 2, 1, 0.5]], "x") for i in range(60)]
    rows += [(1, rows[1][1], "again"), (None, rows[2][1], "no id"), (90, None, ""), (91, [1.0, None, 0.0, 0.0, 0.0], ""), (92, [float("nan")] * 5, ""), (93, [float("inf")] * 5, ""), (94, [], ""), (95, [0.25] * 3, "alone"), (96, [-0.0] * 5, "")]
    rows += [(200 + i, [float(np.float32(x)) for x in (i % 5, 2 * (i % 5), i // 5, 7.5)], "of rank 2") for i in range(25)]
    good = [(i, v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    got = cw.whiten(spark.createDataFrame(rows, VECTORS))
    assert _whitened(got) == _plain_whitening(good)
    assert got.where("vec_id >= 200").select("component").distinct().count() == 2 and got.where("vec_id = 95").count() == 0
    assert got.where("vec_id IS NULL").count() == 4 and got.where("vec_id = 1").count() == 8
    for none in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, [0.5, 0.5], "")] * 3, VECTORS)):
        assert cw.whiten(none).count() == 0


def test_whitening_of_ill_conditioned_and_large_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-4000, 4000, size=(400, 4))
    # Two directions that differ by a hair beside large ones, far from the origin.
    rows = [(i, [float(b[0]), float(b[0] + b[1] * 1e-2), float(b[2]) + 100_000.0, float(b[3]) * 1e-2]) for i, b in enumerate(base.tolist())]
    got = _whitened(cw.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = _plain_whitening(rows)
    assert got.keys() == want.keys()
    for key, ((n, deviation, w, e),) in want.items():
        (gn, gd, gw, ge) = got[key][0]
        assert (gn, gd) == (n, deviation) and abs(gw - w) < 1e-6 and abs(ge - e) <= 1e-4 * e
    big = [(i, [float(x) * 2.0**40 for x in v]) for i, v in enumerate(rng.integers(-50, 50, size=(30, 3)).tolist())]
    got = {r.vec_id: r.deviation for r in cw.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()}
    assert set(got.values()) == {None}  # beyond 64 bits


TEXTS = ["'start they're we'll 'R 'r'e ''s !'s a's 'é 'ré", "<|endoftext|>a<|startoftext|>'s", "", "a" * 5_000, "漢字" * 3_000, "thethethe" * 2_000, "x" * 1_500 + "'" * 3_000 + "s", "İstanbul Σίσυφος ΣΑΣ", "éá é", "internationalization" * 300, "½Ⅷ٣ 12 3", "a\x1cb\x85c　d", None]


@pytest.mark.parametrize("states", [400_000, 300])
def test_transducer_equals_the_library(monkeypatch, states):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tt, "MOST_STATES", states)
    path = q.tokenizer_path(q.WORD_TOKENIZER)
    lib, own = Tokenizer.from_file(path), tt.Transducer(path)
    rng, letters = random.Random(1), "abcdefghijklmnopqrstuvwxyz'''  re ve ll s t m d 0123.,!?-ABCéüßΣσ漢字ñ \t\x1c\x85½Ⅷ'"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 10, 50, 400]))) for _ in range(300)]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts).tolist() == want
    monkeypatch.setattr(tt, "CHUNK", 7)  # chunks end inside words and characters
    monkeypatch.setattr(tt, "REACH", 0)
    monkeypatch.setattr(tt, "LANES", 50)
    assert own.counts(texts).tolist() == want
    assert own.counts([]).tolist() == []


def test_characters_count_as_in_the_library():
    from tokenizers import Tokenizer

    path = q.tokenizer_path(q.WORD_TOKENIZER)
    texts = [f"a{chr(c)}a{chr(c)}{chr(c)}1" for c in [*range(1, 0x3200), *range(0xA000, 0xA100), *range(0xF900, 0x10000), *range(0x1D400, 0x1D500), *range(0x1F600, 0x1F650)]]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = tt.Transducer(path).counts(texts).tolist()
    import unicodedata

    unlike = {hex(ord(t[1])) for t, a, b in zip(texts, got, want, strict=True) if a != b and unicodedata.category(t[1]) != "Cn"}
    assert not unlike


def test_counts_of_rows(spark):
    df = spark.createDataFrame([(1, "The pump's on", "x"), (1, None, "y"), (None, "", "z")], "doc_id long, text string, tokens string")
    got = tt.count(df, q.tokenizer_path(q.WORD_TOKENIZER))
    assert sorted((r.n_tokens, r.tokens) for r in got.collect()) == [(0, "y"), (0, "z"), (4, "x")]
    assert tt.count(df.where("false"), q.tokenizer_path(q.WORD_TOKENIZER)).count() == 0
    with pytest.raises(ValueError, match="already"):
        tt.count(df, q.tokenizer_path(q.WORD_TOKENIZER), tokens="tokens")


def test_maps_compose_in_any_number_of_rounds():
    rng = np.random.default_rng(5)
    owner = np.sort(rng.integers(0, 9, size=60))
    to, n = rng.integers(0, 3, size=(60, 3)), rng.integers(-2, 5, size=(60, 3))
    want = np.zeros(9, dtype=np.int64)
    for t in range(9):
        c = 0
        for k in np.flatnonzero(owner == t):
            want[t] += n[k, c]
            c = to[k, c]
    assert tt.scan(to, n, owner, 9).tolist() == want.tolist()


def _plain_phrases(docs, least, first, longest=5):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", "abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
    f, n, out = Counter(), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in (text or "").translate(fold).split("\n"):
            w = [x for x in piece.split(" ") if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    hidden = {p for p in held for longer, a in held.items() if len(longer) > len(p) and longer[0] == p[0] and a >= held[p] and any(longer[i : i + len(p) - 1] == p[1:] for i in range(1, len(longer) - len(p) + 2))}
    for p, a in held.items():
        if p not in hidden:
            lang, w = p[0], p[1:]
            cuts = [(1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k, *x[1:]) for k, x in enumerate(own[:first], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_plain_counting(spark, monkeypatch, small):
    if small:  # every slice, tile and block more than once
        for name, value in {"WORD_SLICE": 3, "PAIR_SLICE": 4, "SIDE": 1024, "DENSE": 2, "BLOCK": 40, "WORDS": 5, "PAIRS_PER_TASK": 30, "SHARES": 2}.items():
            monkeypatch.setattr(co, name, value)
    rng = random.Random(9)
    words = ["The", "pump", "of", "valve", "éa", "x\x85y", "漢字", "aa", "b-c", "pump"]
    piece = lambda: " ".join(rng.choice(words[: rng.choice([3, 10])]) for _ in range(rng.randint(0, 9)))
    docs = [(rng.choice(["en", "de", None, "und", ""]), rng.choice([".", "\n", "\r\n", "!?", "\t", " \x0b"]).join(piece() for _ in range(rng.randint(1, 5)))) for _ in range(60)]
    docs += [("en", None), ("en", ""), ("fr", "once only"), ("en", "aa aa aa aa aa aa aa"), ("en", "of the pump " * 40), ("de", "aa " * 3_000)]
    df = spark.createDataFrame(docs, "lang string, text string")
    got = sorted(tuple(r) for r in co.mine(df, least=6, first=25).collect())
    assert got == _plain_phrases(docs, 6, 25)
    assert co.mine(df, least=1_000_000).count() == 0 and co.mine(df.where("false")).count() == 0


def test_collocations_query_equals_sql(spark, duck, sf):
    from conftest import same_rows

    mine, theirs = same_rows(q.op13_collocations(spark, sf), duck, q.ORACLE_SQL["op13_collocations"])
    assert mine == theirs


def test_pairs_counted_in_tiles_and_coordinates():
    rng = np.random.default_rng(7)
    left, right = (rng.zipf(1.3, size=400_000) % 5_000 for _ in range(2))
    ids = np.stack([left, right, np.full(len(left), -1)], axis=1).ravel().astype(np.int32)
    _, code = co._codes(ids)
    keys, n = co._added(code)
    got = {(int(k >> 42) * co.SIDE + int(k & (1 << 20) - 1) // co.SIDE, int(k >> 20 & (1 << 22) - 1) * co.SIDE + int(k) % co.SIDE): int(c) for k, c in zip(keys, n, strict=True)}
    assert got == Counter(zip(left.tolist(), right.tolist(), strict=True))
    again, twice = co._added(np.concatenate([keys, keys]), np.concatenate([n, n]))
    assert dict(zip(again.tolist(), twice.tolist(), strict=True)) == {int(k): 2 * int(c) for k, c in zip(keys, n, strict=True)}


def test_no_task_ranks_all_vectors(spark):
    """The sample of the vantage points is taken under a bound on the hash; it is no smaller for it."""
    from lodestone.llm import vptree

    rows = spark.range(40_000).selectExpr("id", "array(double(id), 1D) AS v", "2 AS size")
    taken = vptree._sampled(rows, {2: 40_000})
    assert taken.count() == vptree.SAMPLE
    ranked = rows.selectExpr("*", "pmod(xxhash64(id, v), 4294967296) AS h").where(f"h < {int(4 * vptree.SAMPLE / 40_000 * (1 << 32))}").count()
    assert vptree.SAMPLE < ranked < 6 * vptree.SAMPLE


def test_clashing_names_in_stages(spark):
    from lodestone.llm import simhash_golay, url_asof

    text = " ".join(f"word{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, "a", "b", "c"), (1, text, "a", "b", "d"), (2, "other words here", "a", "b", "c")], "doc_id long, text string, first_id string, first_tie string, __tie string")
    assert sorted((r.doc_id, r["__tie"]) for r in simhash_golay.keep_first(df).collect()) == [(1, "c"), (2, "c")]
    c = spark.createDataFrame([("http://a.example/x", "2024-01-02", "u", "d")], "url string, fetched string, asked_url string, __url string")
    e = spark.createDataFrame([("l", "block", "add", "domain", "a.example", "2024-01-01")], "list_name string, action string, op string, kind string, pattern string, day string").selectExpr("list_name", "action", "op", "kind", "pattern", "to_date(day) AS day")
    got = url_asof.judge(c, e).first()
    assert got.blocked and (got.asked_url, got["__url"]) == ("u", "d")


def test_a_lone_page_whose_article_has_a_mild_name(spark):
    from lodestone.llm import site_style

    prose = "the article says a good deal about pumps and how they are kept in order over the years"
    links = "".join(f"<li><a href='/{k}'>Story {k}</a></li>" for k in range(40))
    page = lambda name, body, more="": f"<body><div class='{name}'>{body}</div>{more}<div class='footer'>imprint</div></body>"
    cases = [
        (page("story-reviews", f"<p>{prose}</p><p>{prose}</p>"), f"{prose}\n\n{prose}"),
        (page("related", f"<ul>{links}</ul>", f"<div><p>{prose}</p></div>"), prose),  # a list of links, however long
        (page("comments", f"<p>{prose}</p><p>{prose}</p>", f"<div><p>{prose}</p></div>"), prose),  # readers' comments never
        (page("social", "<p>Share this</p>", f"<div><p>{prose}</p></div>"), prose),
        (page("search", f"<p>{prose}</p>", f"<div><p>{prose} {prose}</p></div>"), f"{prose} {prose}"),  # less than half
    ]
    rows = [(k, f"http://h{k}.example/x", html) for k, (html, _) in enumerate(cases)]
    got = {r.page_id: r.text for r in site_style.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
