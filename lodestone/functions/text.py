"""Text as column expressions: the search tokenizer and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern and the stop words of the search index.
TOKEN = r"[a-z0-9]+(?:[-_/.+:][a-z0-9]+)+|\d+(?:\.\d+)?(?:°[cf])?|[a-z]+|\d+"
#: The same for Java, with possessive quantifiers: each part ends where the next can't match inside it, so nothing is tried twice.
_TOKEN_ONCE = r"[a-z0-9]++(?:[-_/.+:][a-z0-9]++)++|\d++(?:\.\d++)?+(?:°[cf])?+|[a-z]++|\d++"
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "when",
    "where", "which", "with", "why",
]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it; an expression that stands inside a lambda is computed again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased tokens without stop words and single characters; structured identifiers stay whole."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN_ONCE), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")




def snippet(text: Column, first_hit: Column, limit: int = 560, lead: int = 120) -> Column:
    """``limit`` characters that begin ``lead`` before the hit (1-based; 0 for none), with ellipses where text was cut."""
    start = F.greatest(first_hit - lead, F.lit(1))
    body = F.trim(F.substring(text, start, F.lit(limit)))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + limit - 1 < F.length(text), "…").otherwise(""))


def duration_seconds(value: Column) -> Column:
    """Seconds of texts such as ``1d2h3m4s``, ``1m30.5s`` or a whole number of seconds; null for anything else."""
    t = F.trim(value)
    part = lambda unit: F.coalesce(F.regexp_extract(t, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    total = part("d") * 86400 + part("h") * 3600 + part("m") * 60 + part("s")
    whole = r"^(?:\d+(?:\.\d+)?d)?\s*(?:\d+(?:\.\d+)?h)?\s*(?:\d+(?:\.\d+)?m)?\s*(?:\d+(?:\.\d+)?s)?$"
    return F.when(t.rlike(r"^\d+$"), t.try_cast("double")).when((t != "") & t.rlike(whole), total)


def identifiers(text: Column) -> Column:
    """Distinct structured identifiers with a digit, in order of first place."""
    return F.array_distinct(F.filter(tokens(text), lambda t: t.rlike(r"[-_/.+:]") & t.rlike(r"\d")))
