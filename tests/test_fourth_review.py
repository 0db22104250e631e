"""What the fourth review found: each test failed before its finding was settled."""

import random
import re
from collections import Counter

import numpy as np

from lodestone.operators import scoping, sieve, spelling


def _prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_scope_keeps_whole_texts(spark):
    rng = random.Random(4)
    target, ahead, behind = _prose(rng, 900), _prose(rng, 400), "\n".join(_prose(rng, 8) for _ in range(60))
    assert len(target) > 4_000 and min(len(ahead), len(behind)) > 1_200
    got = scoping.scope_of(f"{ahead}\n{target}\n{behind}", target, [ahead], behind.split("\n"))
    assert (got["text"], got["prefix"], got["suffix"]) == (target, ahead, behind) and not got["reasons"]
    # What is said of a whole text is said of all that is kept of it.
    df = spark.createDataFrame([(f"{ahead}\n{target}", target, [ahead], None)], "said string, text string, before array<string>, after array<string>")
    row = scoping.scope(df, "said", "text", "before", "after").first().scope
    assert row.accepted and row.text == target and row.prefix == ahead and not row.reasons


def test_a_target_far_into_what_was_cut_is_seen():
    rng = random.Random(6)
    kept, ahead, target = _prose(rng, 100), _prose(rng, 250), _prose(rng, 400)
    assert len(ahead) > 1_200
    # Two neighbouring blocks are cut off, and the second is the target.
    got = scoping.scope_of(f"{kept}\n{ahead}\n{target}", target, [ahead], [target])
    assert got["text"] == kept and "SCOPE_INVERSION_DISCARDED_TARGET" in got["reasons"]


def _dealt_rows(spark, do) -> int:
    """Rows that go through a shuffle while this is done."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    stages = lambda: {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(every.apply, range(every.size()))}
    told = []
    for act in (lambda: None, do):
        act()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        every = store.stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        told.append(stages())
    return sum(n for k, n in told[1].items() if k not in told[0])


def test_only_keys_that_meet_are_dealt_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20))
    often, seldom = [word() for _ in range(40)], [word() for _ in range(400)]
    seldom += [often[k][:7] + "u" + often[k][8:] for k in range(20)]
    rows = [("b", w, 9, w) for w in often] + [("b", w, 1, w) for w in seldom]
    df = spark.createDataFrame(rows, "book string, word string, n long, surface string")
    found = []
    dealt = _dealt_rows(spark, lambda: found.extend(spelling.near_pairs(df).collect()))
    # Each of the 440 spellings has 211 keys; 20 pairs share 20 or so.
    assert sorted((r.rare, r.frequent) for r in found) == sorted((seldom[400 + k], often[k]) for k in range(20))
    assert dealt < 5_000


def test_spellings_of_any_length_and_script(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh\u4e00\U00020000") for _ in range(1_500))
    rows = [("b", long, 9, long), ("b", long[:700] + "x" + long[702:], 1, "x"), ("b", "\U00020000" * 12 + "a", 5, ""), ("b", "\U00020000" * 12, 1, ""), (None, "abcdefg", 1, ""), ("b", None, 1, ""), ("c", "hydraulic", 9, "")]
    df = spark.createDataFrame(rows, "book string, word string, n long, surface string")
    got = {(len(r.rare), len(r.frequent), r.edits) for r in spelling.near_pairs(df).collect()}
    assert got == {(1_499, 1_500, 2), (12, 13, 1)}
    assert spelling.near_pairs(df.limit(0)).count() == 0


def test_a_full_sieve_loses_nothing(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 40_000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    of = lambda n: sieve.of(df, lambda b: [b.column(0).to_numpy().view(np.uint64)], n)
    others = keys + np.uint64(1 << 63)
    for n, share in ((40_000, 0.02), (1, 1.0)):
        fits = of(n)
        assert len(fits.passing(keys)) == len(keys) and len(fits.passing(others)) <= share * len(others)
    assert len(of(40_000).passing(others[:0])) == 0
    assert len(sieve.of(df.limit(0), lambda b: [], 0).passing(keys)) == 0


def _plain(texts):
    """Misreadings by plain Python, of short words: one edit from 7 letters on."""
    word = re.compile(r"(?<![\w-])[^\W\d_]+(?:[’'][^\W\d_]+)?(?![\w-])")
    told = [(book, item, [(m[0], m[0].replace("’", "'").lower()) for m in word.finditer(text or "")]) for book, item, text in texts if book is not None]
    count, surfaces = Counter(), {}
    for book, _, words in told:
        for surface, w in words:
            count[book, w] += 1
            surfaces.setdefault((book, w), Counter())[surface] += 1
    stems = lambda w: {w} | {w[: -len(e)] for e in ("ing", "ers", "ed", "er", "es", "s", "ly", "d", "y") if w.endswith(e) and len(w) - len(e) >= 5}
    best = {}
    for (book, rare), m in count.items():
        surface = min(surfaces[book, rare].items(), key=lambda x: (-x[1], x[0]))[0]
        if m > 2 or len(rare) < 6 or all(c.isupper() for c in surface if c.isalpha()):
            continue
        left = lambda w: {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}
        near = [(1 - 1 / max(len(rare), len(w)), n, -1, w) for (b, w), n in count.items() if b == book and n >= max(5, 4 * m) and max(len(rare), len(w)) >= 7 and abs(len(w) - len(rare)) <= 1 and _one_edit(rare, w, left) and not stems(rare) & stems(w)]
        if near:
            best[book, rare] = max(near)[3]
    out = set()
    for book, item, words in told:
        line = [w for _, w in words]
        for rare in {w for w in line if (book, w) in best}:
            first, often = line.index(rare), best[book, rare]
            if all(w != often or abs(k - first) > 3 for k, w in enumerate(line)):
                out.add((book, item, rare, often, count[book, rare], count[book, often]))
    return out


def _one_edit(a, b, left):
    return a != b and (a in left(b) or b in left(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def test_misreadings_against_plain_python(spark):
    rng = random.Random(7)
    often = ["hydraulic", "kettenöle", "l'ouvrage", "pression", "Überdruck", "manuals"]
    spoilt = lambda w: w[: (k := rng.randrange(2, len(w)))] + rng.choice(["x", "é", ""]) + w[k + 1 :]
    said = lambda w: rng.choice([w, w, w, w.upper(), w.capitalize(), w.replace("'", "’")])
    rare = [spoilt(rng.choice(often)) for _ in range(90)]
    texts = []
    for item in range(80):
        words = [said(rng.choice(often if rng.random() < 0.35 else rare if rng.random() < 0.3 else ["of", "the", "A-1", "x2", "und"])) for _ in range(rng.randrange(14))]
        texts.append((rng.choice(["b", "c", None]), item, " ".join(words) if item % 9 else None))
    df = spark.createDataFrame(texts, "book string, item long, text string").repartition(3)
    want = _plain(texts)
    got = {(r.book, r.item, r.rare, r.frequent, r.rare_n, r.n) for r in spelling.misreadings(df).collect()}
    assert got == want and len(want) > 15


def test_places_of_words_across_pieces_of_a_text(spark):
    rng = random.Random(9)
    texts = [(rng.choice("bc"), k, " ".join(rng.choice(["Pump", "pump", "valve", "seal", "of", "x", "the"]) for _ in range(n))) for k, n in enumerate([0, 1, 63, 64, 65, 67, 127, 128, 129, 300])]
    df = spark.createDataFrame(texts, "book string, item int, text string").coalesce(1)
    wanted = spark.createDataFrame([("b", "pump"), ("c", "seal"), ("c", "of")], "book string, word string")
    got = sorted((r.item, r.place, r.surface, r.word, r.beside) for r in spelling.standing(df, wanted).join(wanted, ["book", "word"]).collect())
    want = []
    for book, item, text in texts:
        told = text.split()
        want += [(item, k, w, w.lower(), [x.lower() for x in told[max(0, k - 3) : k + 4]]) for k, w in enumerate(told) if (book, w.lower()) in {("b", "pump"), ("c", "seal"), ("c", "of")}]
    assert got == sorted(want) and len(want) > 50
