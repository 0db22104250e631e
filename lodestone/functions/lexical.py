"""Small text measures as column expressions: fragments, pairs of spellings, odd characters, scripts, shared words and repeated words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that make forms of one word, scripts that are told apart, and words of words compared.
SUFFIXES = ["ingly", "ation", "ations", "tion", "tions", "ing", "ers", "ies", "ied", "ed", "er", "es", "s", "ly", "d", "y"]
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Thai", "Hangul", "Hiragana", "Katakana", "Han"]
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"


def lexical_token(word: Column) -> Column:
    return F.lower(F.replace(F.coalesce(word, F.lit("")), F.lit("’"), F.lit("'")))


def trigrams(word: Column, n: int = 3) -> Column:
    """Distinct runs of n word characters; the whole word if it has no more than n."""
    bare = F.regexp_replace(word, r"[^\p{L}\p{N}_]", "")
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(bare) - (n - 1))), lambda i: F.substring(bare, i, F.lit(n))))
    return F.when(bare == "", F.expr("cast(array() AS array<string>)")).when(F.length(bare) <= n, F.array(bare)).otherwise(many)


def is_label(word: Column) -> Column:
    """Digits, underscores or up to twelve capitals: a tag, no word."""
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    return word.rlike(r"[\p{Nd}_]") | ((letters != "") & ~letters.rlike(r"[^\p{Lu}]") & (F.length(letters) <= 12))


def stems(word: Column) -> Column:
    bare = F.replace(word, F.lit("'s"), F.lit(""))
    cut = [F.when(F.endswith(bare, F.lit(s)) & (F.length(bare) - len(s) >= 5), F.substring(bare, F.lit(1), F.length(bare) - len(s))) for s in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(bare, *cut)))


def same_word(a: Column, b: Column) -> Column:
    """Whether two spellings are forms of one word, by their endings."""
    return (a == b) | F.arrays_overlap(stems(a), stems(b))


def near(a: Column, b: Column, limit: int) -> Column:
    """The edit distance if it is within the limit; null beyond it."""
    return F.nullif(F.levenshtein(a, b, limit), F.lit(-1))


def odd_characters(text: Column) -> Column:
    """struct<replacement, private, control, noncharacter, square>: how many characters of each kind no sound text holds."""
    count = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long")
    return F.struct(count("�").alias("replacement"), count(r"\p{Co}").alias("private"), count(r"[\p{Cc}&&[^\t\n\r]]").alias("control"), count(r"[\x{FDD0}-\x{FDEF}\x{FFFE}\x{FFFF}]").alias("noncharacter"), count("□").alias("square"))


def scripts(text: Column) -> Column:
    """The scripts whose letters a text holds, in a fixed order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(rf"\p{{Is{s}}}"), s.upper()) for s in SCRIPTS]))


def recall(reference: Column, observed: Column) -> Column:
    """The share of the reference's words of two letters or more that the other text holds; 0 if either has none."""
    words = lambda t: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(WORD), F.lit(0)), F.lower), lambda w: F.length(w) >= 2))
    a, b = words(reference), words(observed)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def doubled(words: Column) -> Column:
    """Words that stand twice in a row, each pair."""
    later = F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 1))
    return F.array_compact(F.zip_with(words, later, lambda a, b: F.when(F.lower(a) == F.lower(b), F.lower(a))))


def new_doubled(candidate: Column, original: Column) -> Column:
    return F.array_except(doubled(candidate), doubled(original))


def leaks(proposed: Column, original: Column, context: Column, n: int = 6) -> Column:
    """Whether n words in a row of the proposal come from the context and not from the original."""
    squeeze = lambda t: F.lower(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " ")))
    words = F.split(squeeze(proposed), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    padded = lambda t: F.concat(F.lit(" "), squeeze(t), F.lit(" "))
    inside = lambda run, t: F.contains(padded(t), F.concat(F.lit(" "), run, F.lit(" ")))
    return (F.size(words) >= n) & F.exists(runs, lambda r: inside(r, context) & ~inside(r, original))


def browse_score(query: str, chunk_id: Column, headings: Column, source: Column, text: Column) -> Column:
    """How well a row fits what a person types: its id above all, the phrase, then each word by how often it stands where."""
    import re

    q = query.strip().lower()
    hay = F.lower(F.concat_ws("\n", chunk_id, headings, source, text))
    words = [w for w in re.findall(r"[a-z0-9_+./~:\-]+", q) if len(w) > 1]
    count = lambda w: (F.length(hay) - F.length(F.replace(hay, F.lit(w), F.lit("")))) / len(w)
    hit = [F.contains(hay, F.lit(w)) for w in words]
    each = [F.when(h, F.least(F.lit(12.0), 2.0 + count(w)) + F.when(F.contains(F.lower(chunk_id), F.lit(w)), 18.0).otherwise(0.0) + F.when(F.contains(F.lower(headings), F.lit(w)), 5.0).otherwise(0.0)).otherwise(0.0) for w, h in zip(words, hit, strict=True)]
    found = sum((h.cast("int") for h in hit), F.lit(0))
    total = F.when(F.contains(hay, F.lit(q)), 100.0).otherwise(0.0) + sum(each, F.lit(0.0)) + 8.0 * found / max(1, len(words))
    return F.when(F.lower(chunk_id) == q, 10_000.0).when(found == 0, 0.0 if words else F.when(F.contains(hay, F.lit(q)), 100.0).otherwise(0.0)).otherwise(total)
