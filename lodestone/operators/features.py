"""Reranking: what a question asks for (a value, a remedy, a procedure) against what a row shows, and a guard for exact identifiers.

Scores are column expressions over (question, row) pairs, so they run where the candidates are; only a search's candidates are paired, never all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

# Words and patterns of intents and of evidence.
PROCEDURE = r"(?i)\b(?:how\s+(?:do|to)|procedure|check|adjust|test|measure|inspect|replace|remove|install|change|calibrat(?:e|ion)|zero\s+set(?:ting)?)\b"
TROUBLE = r"(?i)\b(?:what\s+to\s+do|alarm|fault|trip|failure|failed|not\s+working|problem|error|trouble|cause|remedy|corrective|why)\b"
DEFINITION = r"(?i)\b(?:what\s+is|what\s+does|what\b.{0,80}\bdo\b|function\s+of|refer(?:s|red)?\s+to|means?|identify|identification)\b"
FUNCTION = r"(?i)\b(?:what\b.{0,80}\bdo\b|what\s+does|function\s+of|how\s+does|purpose\s+of)\b"
ACTION = r"(?i)\b(?:what\s+to\s+do|what\s+to\s+check|how\s+to\s+(?:fix|troubleshoot|clear|reset))\b"
VALUE = r"(?i)\b(?:value|rating|rated|capacity|setting|setpoint|limit|range|maximum|minimum|max|min|swl|wll|safe\s+working\s+load|working\s+load\s+limit|interval|period|clearance|diameter|dimension|wear\s+limit|thickness|length|width|service\s+life)\b"
LOAD_NAME = r"(?:swl|wll|safe\s+working\s+load|working\s+load\s+limit|hoisting\s+capacity|lifting\s+capacity)"
LOAD_VALUE = r"[-+]?\d+(?:[.,]\d+)?\s*(?:metric\s+)?(?:t|ton|tons|tonne|tonnes|kg|kn)\b"
INTERVAL_ASKED = r"(?i)\b(?:interval|period|maintenance|service)\b"
INTERVAL = r"(?i)[-+]?\d+(?:[.,]\d+)?\s*(?:h|hr|hrs|hour|hours|day|days|week|weeks|month|months|year|years)\b"
DURATION_ASKED = r"(?i)\b(?:operating|working|service|run[- ]?in|break[- ]?in|hours?|hrs?)\b"
DURATION = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:hours?|hrs?)\b"
REFERENCE_ASKED = r"(?i)\b(?:refer|reference|see|section|chapter|clause|where\s+(?:is|are|can)|which\s+(?:section|chapter|drawing|table))\b"
SECTION = r"(?i)\b(?:section|chapter|clause)\s+([A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*)"
QUOTED = "[\"“”']([^\"“”']{3,100})[\"“”']"
ITEM = r"(?i)\b(?:item|pos(?:ition)?)\s*#?\s*(\d{2,4})\b"
ITEM_GENERIC = [
    "what", "which", "article", "number", "item", "position", "pos", "parts", "part", "list", "this", "the", "for", "is",
]
STATE_WORDS = r"(?i)\b(?:normal|at\s+limit|fault|faulty|alarm|not\s+working|stopp?ed|operated)\b"
MEASURED = r"(?i)[-+]?\d+(?:[.,]\d+)?\s*(?:v|vac|vdc|bar|mpa|psi|°?c|°?f|a|ma|hz|rpm)\b"
EFFECT = r"(?i)\b(?:affect(?:s|ed)?|causes?|controls?|releases?|blocks?|supplies?|drives?|results?\s+in)\b"
BY_HAND = r"(?i)\b(?:manually|during\s+checking|during\s+adjustment)\b"
PROCEDURE_WORDS = [
    "check", "adjust", "measure", "inspect", "remove", "install", "operate", "connect", "start", "stop", "loosen", "tighten", "drain", "replace", "set",
    "turn", "open", "close", "disconnect", "reconnect", "clean", "fill", "apply", "press", "verify",
]
TROUBLE_WORDS = [
    "check", "inspect", "reset", "replace", "fault", "faulty", "failure", "alarm", "error", "cause", "causes", "remedy", "corrective", "operated", "trip",
    "tripped", "stopped", "stop", "measure", "verify", "normal", "abnormal", "open", "closed", "broken",
]
FUNCTION_WORDS = [
    "operate", "operates", "operated", "control", "controls", "controlled", "release", "releases", "released", "block", "blocks", "blocked", "open", "opens",
    "close", "closes", "supply", "supplies", "drive", "drives", "start", "starts", "stop", "stops", "shift", "shifts", "connect", "connects", "disconnect",
    "energize", "energizes", "deenergize", "actuate", "actuates",
]
ACTION_TERMS = [
    "procedure", "check", "adjust", "test", "measure", "inspect", "replace", "remove", "install", "change", "calibrate", "calibration", "zero", "set",
    "setting", "do", "refer", "refers", "mean", "means", "identify", "alarm", "fault", "trip", "failure", "failed", "problem", "error", "trouble", "cause",
    "remedy", "corrective", "came",
]
UNITS = [
    "a", "bar", "c", "f", "hz", "ka", "kg", "kn", "kw", "l", "ma", "mm", "mpa", "nm", "pa", "psi", "rpm", "s", "v", "vac", "vdc", "w", "ohm", "ohms",
]
#: Words that name a measured attribute, and its units.
ATTRIBUTE_WORDS = {
    "voltage": ["volt", "volts", "voltage"],
    "pressure": ["press", "pressure"],
    "temperature": ["temp", "temperature"],
    "torque": ["torque"],
    "current": ["current", "amp", "amps"],
    "resistance": ["resistance"],
    "frequency": ["frequency"],
    "speed": ["speed"],
    "flow": ["flow"],
    "clearance": ["clearance"],
}
ATTRIBUTE_UNITS = {
    "voltage": ["v", "vac", "vdc", "mv", "kv"],
    "pressure": ["bar", "mpa", "pa", "kpa", "psi", "kg/cm2"],
    "temperature": ["c", "f", "°c", "°f"],
    "torque": ["nm", "n-m"],
    "current": ["a", "ma", "ka"],
    "resistance": ["ohm", "ohms", "kohm", "mohm"],
    "frequency": ["hz", "khz"],
    "speed": ["rpm"],
    "flow": ["l/min", "lpm", "m3/h", "m³/h"],
    "clearance": ["mm", "cm"],
}
#: Characters that continue an identifier: of sections and items, and of identifiers that a question names.
BORDER, ID_BORDER = r"A-Za-z0-9_./:+\-", r"A-Za-z0-9_/:+~\-"
IDENTIFIER = r"(?i)\+?[A-Za-z0-9]+(?:[._/:+~\-][A-Za-z0-9]+)+|[A-Za-z]+\d+[A-Za-z0-9]*|\d+[A-Za-z]+[A-Za-z0-9]*"
ID_CUE = r"\b(?:part|code|alarm|tag|terminal|wire|component|for|of|on|at)\s*$"


def _has(array: Column, words: list[str]) -> Column:
    return F.size(F.array_intersect(array, F.array(*map(F.lit, words))))


def attribute(asked: Column) -> Column:
    """The measured attribute that the first such word of the tokens names, or null."""
    by = {w: name for name, words in ATTRIBUTE_WORDS.items() for w in words}
    named = F.create_map(*[F.lit(x) for pair in by.items() for x in pair])
    return F.get(F.filter(F.transform(asked, lambda t: F.try_element_at(named, t)), lambda n: n.isNotNull()), F.lit(0))


def subject_terms(asked: Column, about: Column) -> Column:
    """What the question is about: its distinct tokens without words of action, units, and names of the attribute asked for."""
    names = F.create_map(*[F.lit(x) for name, words in ATTRIBUTE_WORDS.items() for w in words for x in (w, name)])
    own = F.filter(asked, lambda t: ~t.isin(ACTION_TERMS + UNITS) & ~F.coalesce(F.try_element_at(names, t) == about, F.lit(False)))
    return F.array_distinct(own)


def with_cohesion(rows: DataFrame, terms: str, found: str, out: str) -> DataFrame:
    """A bonus for terms close together: around each place of the first term the nearest of each other one, and the tightest such span.

    Places and the span are columns of their own, so they are worked out once for a row.
    """
    where = F.transform(terms, lambda t: F.filter(F.transform(found, lambda x, k: F.when(x == t, k)), lambda k: k.isNotNull()))
    rows = rows.withColumn("__where", F.when((F.size(terms) >= 2) & (F.size(F.array_except(terms, found)) == 0), where).otherwise(F.expr("cast(array() AS array<array<int>>)")))
    nearest = lambda p, at: F.array_min(F.transform(p, lambda k: F.struct(F.abs(k - at).alias("d"), k.alias("k"))))["k"]
    near = F.transform(F.get("__where", F.lit(0)), lambda at: F.transform("__where", lambda p: nearest(p, at)))
    whole = (F.size("__where") >= 2) & F.forall("__where", lambda p: F.size(p) > 0)
    rows = rows.withColumn("__near", F.when(whole, near))
    rows = rows.withColumn("__span", F.array_min(F.transform("__near", lambda s: F.array_max(s) - F.array_min(s))))
    span = F.col("__span")
    return rows.withColumn(out, F.when(span <= 6, 3.4).when(span <= 15, 2.0).when(span <= 30, 0.8).otherwise(0.0)).drop("__where", "__near", "__span")


def bounded(text: Column, identifier: Column, border: str = BORDER) -> Column:
    """Whether the identifier stands in the text with no identifier character beside it."""
    return F.regexp_like(text, F.concat(F.lit(rf"(?i)(?<![{border}])\Q"), identifier, F.lit(rf"\E(?![{border}])")))


def asked_identifiers(question: Column) -> Column:
    """Identifiers with a digit that a question names, each once whatever its case, in order."""
    found = F.filter(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda i: i.rlike(r"\d"))
    low = F.transform(found, F.lower)
    return F.filter(found, lambda i, k: F.array_position(low, F.lower(i)) == k + 1)


def score_features(pairs: DataFrame) -> DataFrame:
    """Adds ``features`` to pairs with question, text, headings (array), source, content_type, stitched. Null text: empty; null question: 0."""
    q, raw = F.coalesce("question", F.lit("")), F.coalesce("text", F.lit(""))
    heads = F.array_join(F.coalesce("headings", F.expr("cast(array() AS array<string>)")), " ")
    p = pairs.withColumns({"__q": tokens(q), "__t": tokens(raw), "__h": F.array_distinct(tokens(heads)), "__s": F.regexp_extract_all(F.lower(F.coalesce("source", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))})
    p = p.withColumn("__a", attribute(F.col("__q"))).withColumn("__terms", subject_terms(F.col("__q"), F.col("__a")))
    terms, n = F.col("__terms"), F.size("__terms")
    hits = F.size(F.filter("__terms", lambda t: F.array_contains("__t", t) | F.array_contains("__h", t) | F.array_contains("__s", t)))
    placed = F.size(F.array_intersect(terms, "__h")) + F.size(F.array_intersect(terms, "__s"))
    p = p.withColumns({"__m": hits, "__place": placed, "__w": F.array_distinct("__t")}).withColumn("__r", F.col("__m") / F.greatest(F.size("__terms"), F.lit(1)))
    p = with_cohesion(p, "__terms", "__t", "__c")
    m, r, w, about = F.col("__m"), F.col("__r"), F.col("__w"), F.col("__a")
    asks = {k: q.rlike(v) for k, v in (("procedure", PROCEDURE), ("trouble", TROUBLE), ("definition", DEFINITION), ("function", FUNCTION), ("action", ACTION), ("value", VALUE), ("load", rf"(?i)\b{LOAD_NAME}\b"), ("explicit", r"(?i)\b(?:value|capacity|rating|rated)\b"))}
    doing, trouble, working = _has(w, PROCEDURE_WORDS), _has(w, TROUBLE_WORDS), _has(w, FUNCTION_WORDS)
    kind = F.coalesce("content_type", F.lit(""))
    table, stitched = kind.startswith("table"), F.coalesce("stitched", F.lit(False))
    add = lambda when, much: F.when(when, much).otherwise(F.lit(0.0))
    unit = F.lit(False)
    folded = F.regexp_replace(F.lower(raw), r"\s+", " ")
    for name, units in ATTRIBUTE_UNITS.items():
        unit = unit | F.coalesce(about == name, F.lit(False)) & folded.rlike("|".join(rf"[-+]?\d+(?:[.,]\d+)?\s*\Q{u}\E(?=$|[^a-z])" for u in units))
    load_direct, load_near = raw.rlike(rf"(?i)\b{LOAD_NAME}\b\s*[:=]?\s*{LOAD_VALUE}"), raw.rlike(rf"(?i)\b{LOAD_NAME}\b") & raw.rlike(f"(?i){LOAD_VALUE}")
    sections = F.regexp_extract_all(q, F.lit(SECTION), F.lit(1))
    quoted = F.filter(F.transform(F.regexp_extract_all(q, F.lit(QUOTED), F.lit(1)), lambda s: F.array_join(tokens(s), " ")), lambda s: s != "")
    item = F.regexp_extract(q, ITEM, 1)
    item_lines = F.filter(F.split(raw, r"\r\n|[\n\r]"), lambda s: (item != "") & F.regexp_like(s, F.concat(F.lit(r"(?<!\d)"), item, F.lit(r"(?!\d)"))))
    item_terms = F.filter(tokens(F.replace(q, F.lit("-"), F.lit(" "))), lambda t: ~t.isin(ITEM_GENERIC) & ~t.rlike(r"^\d+$"))
    shared = F.array_max(F.transform(item_lines, lambda s: F.size(F.array_intersect(item_terms, tokens(F.replace(s, F.lit("-"), F.lit(" ")))))))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    in_heads, in_text = F.array_join(tokens(heads), " "), F.array_join("__t", " ")
    ten, number = raw.rlike(r"(?i)\b(?:see|refer\s+to)\b"), raw.rlike(r"\d")
    parts = {
        "subject": add(n > 0, 1.55 * m + 2.6 * r + F.least(F.lit(2.4), 0.8 * F.col("__place")) + F.col("__c") + F.when((r == 0) & (asks["procedure"] | asks["trouble"] | about.isNotNull()), -4.0).when((r < 0.5) & (n >= 2), -1.0).otherwise(0.0)),
        "procedure": add(asks["procedure"], F.least(F.lit(4.2), 0.72 * doing) + add(doing >= 3, 1.2) + add((kind == "prose") & (doing > 0), 0.4)),
        "trouble": add(asks["trouble"], F.least(F.lit(7.0), 1.05 * trouble) + F.when(trouble >= 3, 2.0).when((trouble == 0) & (r > 0), -2.8).otherwise(0.0) + add(raw.rlike(STATE_WORDS), 1.7) + add(raw.rlike(MEASURED), 1.2) + add(asks["action"], F.least(F.lit(5.0), 1.0 * doing) + add((doing == 0) & (r > 0), -1.6))),
        "function": add(asks["function"], F.least(F.lit(6.0), 1.0 * working) + add((working >= 2) & (r > 0), 1.5) + add(raw.rlike(EFFECT), 3.2) + add(raw.rlike(BY_HAND), -1.8) + add((kind == "table") & (working == 0), -5.5)),
        "attribute": add(about.isNotNull(), F.when(unit & (r > 0), 5.2).when(unit, 2.2).when(r > 0, -2.4).otherwise(0.0)),
        "value": add(asks["value"], add(table & number & (m > 0), 2.0) + add(stitched & table & number, 2.5)),
        "load": add(asks["value"] & asks["load"], F.when(load_direct, 20.0).when(load_near, 3.5 - F.when(asks["explicit"] & ~stitched, 3.0).otherwise(0.0)).otherwise(0.0) + add(stitched & raw.rlike(r"(?i)\b(?:hoisting|lifting)\s+capacity\b"), F.when(asks["explicit"], 12.0).otherwise(5.0))),
        "reference": add(q.rlike(REFERENCE_ASKED), total(F.transform(sections, lambda s: F.when(bounded(heads, s), 2.5).when(bounded(raw, s), 0.5).otherwise(0.0))) + total(F.transform(quoted, lambda s: F.when(F.contains(in_heads, s), 8.0).when(F.contains(in_text, s), 3.0).otherwise(0.0))) + add(ten & (r > 0), 1.4)),
        "interval": add(asks["value"] & q.rlike(INTERVAL_ASKED) & raw.rlike(INTERVAL) & (m > 0), 5.0),
        "item": add(F.size(item_lines) > 0, 12.0 + add(raw.rlike(r"(?i)\b(?:article\s*(?:no|number)|parts?\s+manual|description)\b"), 4.0) + F.when(shared >= 2, 14.0).when(shared == 1, 4.0).otherwise(0.0)),
        "duration": add(asks["value"] & q.rlike(DURATION_ASKED), add(raw.rlike(DURATION), 5.0) + add(q.rlike(r"(?i)\b(?:run[- ]?in|breaking[- ]?in|starting\s+up)\b") & raw.rlike(r"(?i)\b(?:run[- ]?in|starting\s+up)\b"), 3.5) + add(q.rlike(r"(?i)\bpower\b") & raw.rlike(r"(?i)\bpower\b") & raw.rlike(r"\d+(?:[.,]\d+)?\s*%"), 5.0)),
        "definition": add(asks["definition"] & (n > 0) & (r >= 0.5), 0.6),
    }
    whole = F.lit(0.0)
    for part in parts.values():
        whole = whole + part
    return p.withColumn("features", F.when(q != "", whole).otherwise(0.0)).drop("__q", "__t", "__h", "__s", "__a", "__terms", "__m", "__place", "__w", "__r", "__c")


def identifier_weights(question: Column, ids: Column) -> Column:
    """array<struct<id, weight>>: an identifier after a cue or in the first half of the question weighs more, one in brackets less."""
    low = F.lower(question)

    def one(i: Column) -> Column:
        at = F.call_function("locate", F.lower(i), low) - 1
        left = F.substring(low, F.greatest(at - 32, F.lit(0)) + 1, F.least(at, F.lit(32)))
        bare = F.rtrim(left)
        extra = F.when(left.rlike(ID_CUE), 0.75).otherwise(0.0) + F.when(at <= F.greatest(F.lit(1), F.floor(F.length(question) / 2)), 0.35).otherwise(0.0) - F.when(bare.endswith("(") | bare.endswith(","), 0.15).otherwise(0.0)
        return F.struct(i.alias("id"), F.round(F.greatest(F.lit(0.5), F.when(at >= 0, 1.0 + extra).otherwise(1.0)), 2).alias("weight"))

    return F.transform(ids, one)


def guard_identifiers(fused: DataFrame, lexical_top: DataFrame, by: str, key: str) -> DataFrame:
    """Puts a question's lexical first row first among its fused ones if it covers the identifiers asked for better.

    fused: by, key, rank, text; lexical_top, a row for each question: by, key, text, question. Returns by, key, rank, guarded.
    Questions without identifiers, or whose first rows agree, keep their order. The window is over one question's results.
    """
    first = fused.where("rank = 1").select(by, F.col(key).alias("__fk"), F.col("text").alias("__ft"))
    g = lexical_top.select(by, F.col(key).alias("__lk"), F.col("text").alias("__lt"), identifier_weights(F.col("question"), asked_identifiers(F.col("question"))).alias("__w")).join(first, by)
    got = lambda t: F.filter("__w", lambda x: bounded(F.coalesce(t, F.lit("")), x["id"], ID_BORDER))
    weigh = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["weight"]), 6)
    g = g.withColumns({"__l": got(F.col("__lt")), "__f": got(F.col("__ft")), "__top": F.array_max(F.transform("__w", lambda x: x["weight"]))})
    lead = lambda a: F.size(F.filter(a, lambda x: x["weight"] == F.col("__top"))) == F.size(F.filter("__w", lambda x: x["weight"] == F.col("__top")))
    n, lw, fw = F.size("__w"), weigh(F.col("__l")), weigh(F.col("__f"))
    better = ((lw >= weigh(F.col("__w"))) & (fw < lw)) | ((n >= 2) & (F.size("__l") == n)) | ((n >= 2) & (lw > fw)) | ~lead(F.col("__f"))
    move = g.where((n > 0) & ~F.col("__lk").eqNullSafe(F.col("__fk")) & (F.size("__l") > 0) & lead(F.col("__l")) & better).select(by, "__lk")
    rows = fused.select(by, key, "rank").join(move.select(by, F.col("__lk").alias(key), F.lit(True).alias("guarded")), [by, key], "full_outer")
    w = Window.partitionBy(by).orderBy(F.coalesce("guarded", F.lit(False)).desc(), "rank")
    return rows.select(by, key, F.row_number().over(w).alias("rank"), F.coalesce("guarded", F.lit(False)).alias("guarded"))
