"""What a model says about a text or a picture, held against what can be seen without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdicts, and kinds of drawings that lines in a picture speak for.
TEXT_VERDICTS = ["LIKELY_OK", "LIKELY_CORRUPT", "UNCERTAIN"]
PICTURE_VERDICTS = ["TECHNICAL_USEFUL", "DECORATIVE_OR_LOW_VALUE", "UNCERTAIN"]
DRAWINGS = [
    "electrical_schematic", "wiring_diagram", "single_line_diagram", "ladder_logic", "block_diagram", "hydraulic_schematic", "pneumatic_schematic", "pid",
    "control_logic", "terminal_diagram", "timing_or_waveform", "mechanical_section", "exploded_view", "installation_layout", "safety_diagram",
]
OTHER_PICTURES = [
    "technical_photo", "nameplate_or_data_plate", "table_or_schedule", "graph_or_plot", "map", "control_panel", "other_technical", "decorative_photo", "logo",
    "signature_or_stamp", "cover_art", "unknown",
]


def evidence_text(text: Column) -> Column:
    """Without quotes and case, one space between words and none before punctuation."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[\"'`“”‘’«»]", ""))
    return F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r" +([,.;:!?%)\]])", "$1")


def confidence(text: Column) -> Column:
    """A number between 0 and 1; 0 for anything else."""
    value = text.cast("string").try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def text_verdict(said: Column, reason: Column, sure: Column, evidence: Column, suspect: Column, sound: Column, dominant: Column, garble: Column, recalled: Column) -> Column:
    """struct<verdict, confidence, reason_code, override, evidence_valid>: evidence that isn't in the text takes a verdict's weight; a text of sound structure isn't corrupt for a model's word alone.

    sound, dominant and garble describe the text: structurally normal, mostly technical patterns, and the damage score. recalled: the document itself has a likelier spelling.
    """
    model, code = F.upper(F.coalesce(said, F.lit(""))), F.substring(F.upper(F.coalesce(reason, F.lit("AMBIGUOUS"))), 1, 80)
    code = F.when(code == "UNIT_SYMBOL", "TECHNICAL_FORMAT").otherwise(code)
    quoted = evidence_text(evidence)
    valid = (quoted != "") & F.contains(evidence_text(suspect), quoted)
    doubted = valid & (model == "LIKELY_CORRUPT") & F.coalesce(sound, F.lit(False))
    clean, kept = doubted & F.coalesce(dominant, F.lit(False)), F.coalesce(recalled, F.lit(False)) & (code == "OCR_GARBLE")
    own = F.when(model.isin(TEXT_VERDICTS), model).otherwise("UNCERTAIN")
    c = confidence(sure)
    return F.struct(
        F.when(~valid, "UNCERTAIN").when(clean, "LIKELY_OK").when(doubted & ~kept, "UNCERTAIN").otherwise(own).alias("verdict"),
        F.when(~valid, F.least(c, F.lit(0.25))).when(clean, F.greatest(F.lit(0.75), 1.0 - F.coalesce(garble, F.lit(0.0)))).when(doubted & ~kept, F.least(c, F.lit(0.5))).otherwise(c).alias("confidence"),
        F.when(~valid, "INVALID_EVIDENCE").when(clean, "TECHNICAL_FORMAT").otherwise(code).alias("reason_code"),
        F.when(clean, "CLEAN_TECHNICAL_FORMAT").when(doubted & kept, "DOCUMENT_RECALL_CORROBORATED_OCR").when(doubted, "NORMAL_STRUCTURE_MODEL_DISAGREEMENT").alias("override"),
        valid.alias("evidence_valid"),
    )


def picture_verdict(said: Column, sure: Column, category: Column, unresolved: Column, words: Column, things: Column) -> Column:
    """struct<verdict, confidence, category, unresolved, words, things> with unknown values made plain and lists cut to what is kept."""
    verdict = F.when(F.upper(said).isin(PICTURE_VERDICTS), F.upper(said)).otherwise("UNCERTAIN")
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("unknown")))), " ", "_")
    cut = lambda xs, n, size: F.transform(F.slice(F.coalesce(xs, F.expr("cast(array() AS array<string>)")), 1, n), lambda w: F.substring(w, 1, size))
    return F.struct(verdict.alias("verdict"), confidence(sure).alias("confidence"), F.when(kind.isin(DRAWINGS + OTHER_PICTURES), kind).otherwise("unknown").alias("category"), F.coalesce(unresolved, verdict == "UNCERTAIN").alias("unresolved"), cut(words, 12, 120).alias("words"), cut(things, 10, 160).alias("things"))


def needs_crops(v: Column, parse_failed: Column) -> Column:
    """Whether parts of a picture are to be read as well: the whole was unreadable, uncertain, unresolved, or useful without any evidence."""
    empty = (F.size(v["words"]) == 0) & (F.size(v["things"]) == 0)
    return F.coalesce(parse_failed, F.lit(False)) | (v["verdict"] == "UNCERTAIN") | v["unresolved"] | ((v["verdict"] == "TECHNICAL_USEFUL") & empty)


def structural_gate(v: Column, diagram_like: Column) -> Column:
    """struct<verdict, confidence, unresolved, override>: lines in a picture speak for a drawing, and against throwing it away."""
    lines = F.coalesce(diagram_like, F.lit(False))
    drawn = v["category"].isin(DRAWINGS) & (v["confidence"] >= 0.55) & lines
    raised, kept = drawn & (v["verdict"] != "TECHNICAL_USEFUL"), ~drawn & (v["verdict"] == "DECORATIVE_OR_LOW_VALUE") & lines
    return F.struct(
        F.when(raised, "TECHNICAL_USEFUL").when(kept, "UNCERTAIN").otherwise(v["verdict"]).alias("verdict"), F.when(raised, F.greatest(v["confidence"], F.lit(0.70))).otherwise(v["confidence"]).alias("confidence"),
        (kept | v["unresolved"]).alias("unresolved"), F.when(raised, "STRUCTURALLY_CORROBORATED_TECHNICAL_DIAGRAM").when(kept, "STRUCTURAL_DIAGRAM_CONFLICT_REQUIRES_REVIEW").alias("override"),
    )


def merge_parts(parts: DataFrame, by: str) -> DataFrame:
    """parts (by, part, v: picture verdicts, 0 being the whole picture) -> one verdict: useful if any part is, else low value if all are, with the highest confidence among those that agree, and all words and things in order of the parts."""
    useful, low = F.bool_or(F.col("v.verdict") == "TECHNICAL_USEFUL"), F.bool_and(F.col("v.verdict") == "DECORATIVE_OR_LOW_VALUE")
    top = lambda verdict: F.max(F.when(F.col("v.verdict") == verdict, F.col("v.confidence")))
    g = parts.groupBy(by).agg(useful.alias("u"), low.alias("l"), top("TECHNICAL_USEFUL").alias("cu"), top("DECORATIVE_OR_LOW_VALUE").alias("cl"), top("UNCERTAIN").alias("cn"), F.array_sort(F.collect_list(F.struct("part", "v.words", "v.things"))).alias("x"))
    gather = lambda name, n: F.slice(F.array_distinct(F.flatten(F.transform("x", lambda p: p[name]))), 1, n)
    verdict = F.when(F.col("u"), "TECHNICAL_USEFUL").when(F.col("l"), "DECORATIVE_OR_LOW_VALUE").otherwise("UNCERTAIN")
    return g.select(by, verdict.alias("verdict"), F.coalesce(F.when(F.col("u"), F.col("cu")).when(F.col("l"), F.col("cl")).otherwise(F.col("cn")), F.lit(0.0)).alias("confidence"), gather("words", 20).alias("words"), gather("things", 12).alias("things"))


def merge_segments(parts: DataFrame, by: str) -> DataFrame:
    """parts (by, verdict, confidence) of a long text -> fine only if every part is, with the least confidence."""
    fine = F.every(F.col("verdict") == "LIKELY_OK")
    return parts.groupBy(by).agg(F.when(fine, "LIKELY_OK").otherwise("UNCERTAIN").alias("verdict"), F.min("confidence").alias("confidence"), F.count("*").alias("parts"))


def unsafe_overlay(original: Column, proposed: Column, truncated: Column, guard_reasons: Column, profile_accepted: Column) -> Column:
    """Whether a text that was put in automatically must go back to review: its reading was cut off or doubted, it doesn't keep what the source says, or it is only a beginning or end of it."""
    a, b = (F.lower(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))) for t in (original, proposed))
    part = (F.length(a) >= 80) & (b != "") & (F.length(b) < 0.90 * F.length(a)) & (F.startswith(a, b) | F.endswith(a, b))
    return F.coalesce(truncated, F.lit(False)) | (F.size(F.coalesce(guard_reasons, F.expr("cast(array() AS array<string>)"))) > 0) | ~F.coalesce(profile_accepted, F.lit(False)) | part


# The length of kept evidence, the longest run of words sought, and marks of a prompt.
EVIDENCE_CHARS, EVIDENCE_WORDS = 120, 16
MARKERS = ["NEARBY CONTEXT:", "ORIGINAL TEXT:", "SUSPECT TEXT:", "CONTEXT:", "CORRECTED TEXT:", "PI5 PROPOSAL:"]


def _runs(words: Column, n: int) -> Column:
    """Every n words in a row, joined by one space."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1)))
    return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() AS array<string>)"))


def recover_evidence(df: DataFrame, evidence: str, suspect: str) -> DataFrame:
    """Adds recovered: struct<span, method>. The shortest quotation that stands in the suspect text; else the evidence itself if it stands there; else the longest run of the suspect's words, first of equals, that the evidence holds.

    Nothing is matched loosely: apart from quotes, case and blanks, a span stands in the text as it is.
    """
    df = df.withColumns({"__raw": F.trim(F.coalesce(evidence, F.lit(""))), "__in": evidence_text(F.col(suspect)), "__words": F.filter(F.split(F.coalesce(suspect, F.lit("")), r"\s+"), lambda w: w != "")})
    df = df.withColumn("__said", evidence_text(F.col("__raw")))
    quoted = F.transform(F.regexp_extract_all("__raw", F.lit("[\"'‘’“”]([^\"'‘’“”]{1,500})[\"'‘’“”]"), F.lit(1)), lambda q: F.trim(q))
    there = F.filter(quoted, lambda q: (evidence_text(q) != "") & F.contains(F.col("__in"), evidence_text(q)))
    quote = F.array_min(F.transform(there, lambda q, i: F.struct(F.length(q).alias("n"), i.alias("i"), q.alias("q"))))["q"]
    df = df.withColumn("__quote", quote)
    fits = lambda run: (F.length(run) <= EVIDENCE_CHARS) & (F.length(F.regexp_replace(run, r"[^\p{L}\p{N}_]", "")) >= 4) & F.contains(F.col("__said"), evidence_text(run))
    longest = F.coalesce(*[F.get(F.filter(_runs(F.col("__words"), n), fits), F.lit(0)) for n in range(EVIDENCE_WORDS, 0, -1)])
    has_quote, whole = F.length("__quote") <= EVIDENCE_CHARS, (F.col("__said") != "") & F.contains(F.col("__in"), F.col("__said")) & (F.length("__raw") <= EVIDENCE_CHARS)
    df = df.withColumn("__run", F.when(~F.coalesce(has_quote, F.lit(False)) & ~whole, longest))
    none = (F.col("__raw") == "") | (F.coalesce(suspect, F.lit("")) == "")
    span = F.when(none, "").when(has_quote, F.col("__quote")).when(whole, F.col("__raw")).otherwise(F.coalesce("__run", F.rtrim(F.substring("__raw", 1, EVIDENCE_CHARS))))
    method = F.when(none, None).when(has_quote, "QUOTED_SOURCE_SPAN").when(whole, None).when(F.col("__run").isNotNull(), F.when(F.length("__raw") > EVIDENCE_CHARS, "TRIMMED_EXACT_SOURCE_SPAN").otherwise("WRAPPED_SOURCE_SPAN"))
    return df.withColumn("recovered", F.struct(span.alias("span"), method.alias("method"))).drop("__raw", "__in", "__words", "__said", "__quote", "__run")


def points_at(observed: Column, evidence: Column) -> Column:
    """Whether the evidence holds one of the spellings that the document itself makes doubtful."""
    said = evidence_text(evidence)
    return (said != "") & F.exists(observed, lambda o: (evidence_text(o) != "") & F.contains(said, evidence_text(o)))


def scope_guard(df: DataFrame, original: str, context: str, proposed: str) -> DataFrame:
    """Adds scope: struct<accepted, reasons>: a correction that repeats marks of its prompt, or six to eight words in a row of its context that the original hasn't."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    df = df.withColumns({"__new": F.lower(plain(F.col(proposed))), "__old": F.lower(plain(F.col(original))), "__near": F.filter(F.split(F.lower(plain(F.col(context))), " "), lambda w: w != "")})
    leaked = F.exists(F.concat(*[_runs(F.col("__near"), n) for n in (8, 7, 6)]), lambda r: F.contains(F.col("__new"), r) & ~F.contains(F.col("__old"), r))
    marked = F.exists(F.array(*[F.lit(m.lower()) for m in MARKERS]), lambda m: F.contains(F.col("__new"), m))
    reasons = F.array_compact(F.array(F.when(marked, "PROMPT_OR_CONTEXT_MARKER_LEAKAGE"), F.when(leaked, "NEARBY_CONTEXT_COPIED_INTO_CORRECTION")))
    return df.withColumn("scope", F.struct((F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))).drop("__new", "__old", "__near")
