"""Answers and the sources they cite: which sources go into a prompt, and whether each claim of an answer stands in what it cites.

Claims and their citations are rows, joined to sources by answer and label, so an answer of any length and any number of sources is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Citations, words, values and identifiers of claims, questions across books, and the sentence for no answer.
CITATION = r"\[([SVsv]\d+)\]"
WORD = "[A-Za-z][A-Za-z0-9_/-]{2,}"
STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "onto", "your", "their", "then", "than", "are", "was", "were", "is", "be", "to", "of", "in",
    "on", "at", "by", "or", "as", "it", "its", "a", "an", "if", "when", "while", "before", "after", "must", "should", "may", "can", "will", "not", "only",
    "source", "manual", "system", "equipment",
]
CRITICAL = (
    r"(?i)(?<!\w)(?:[<>≤≥]=?\s*)?\d+(?:\.\d+)?\s*(?:%|°\s*[CF]|V|mV|A|mA|bar|psi|Hz|rpm|kW|W|N\s*[·.-]?\s*m|Nm|mm|cm|kg|tonnes?|tons?|t|s|sec(?:onds?)?|min(?:utes?)?|h|hours?|Ω|ohms?)\b"
    r"|\b(?=[A-Za-z0-9_./-]*[A-Za-z])(?=[A-Za-z0-9_./-]*\d)[A-Za-z0-9][A-Za-z0-9_./-]{2,}\b"
)
CROSS_BOOK = r"(?i)\b(compare|comparison|difference(?:s)?|across\s+(?:books|manuals)|all\s+(?:books|manuals)|both\s+(?:books|manuals)|other\s+(?:book|manual)|which\s+(?:book|manual))\b"
NOT_ENOUGH = "Not enough information in the retrieved sources."


def words(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOPWORDS)))


def critical(text: Column) -> Column:
    """Values with units and identifiers, without spaces and case, each once in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CRITICAL), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"\s+", ""))))


def segments(answer: Column) -> Column:
    """The lines and sentences of an answer; a citation behind a sentence stays with it."""
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\n+|(?<=[.!?])\s+(?=(?:[-*]\s*)?[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def support_text(exact: bool) -> Column:
    """What a source says in support: of a picture the words read from it alone, if exact values are asked for."""
    picture = F.upper("label").startswith("V")
    seen = F.array_join("visible_text", " ")
    return F.when(picture, seen if exact else F.concat_ws(" ", seen, "text")).otherwise(F.concat_ws(" ", "heading", "text"))


def claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (id, answer), sources (id, label, heading, text, visible_text) -> id, claim number, supported, reason, missing (critical tokens), coverage. Fragments of under three words and no critical token are no claims."""
    c = answers.select("id", F.posexplode(segments(F.col("answer"))).alias("place", "said"), F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(NOT_ENOUGH.lower())).alias("lacking"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("said", CITATION, ""), r"^\s*(?:[-*•]|\d+[.)])\s*", ""))
    c = c.withColumns({"labels": F.array_distinct(F.transform(F.regexp_extract_all("said", F.lit(CITATION), F.lit(1)), F.upper)), "claim": clean})
    c = c.withColumns({"words": words(F.col("claim")), "critical": critical(F.col("claim"))}).where((F.col("claim") != "") & ((F.size("critical") > 0) | (F.size("words") >= 3)))
    s = sources.select("id", F.upper("label").alias("label"), support_text(True).alias("exact"), support_text(False).alias("general"))
    cited = c.select("id", "place", F.explode("labels").alias("label")).join(s, ["id", "label"], "left")
    cited = cited.groupBy("id", "place").agg(F.count_if(F.col("general").isNull()).alias("unknown"), F.concat_ws(" ", F.collect_list("exact")).alias("exact"), F.concat_ws(" ", F.collect_list("general")).alias("general"))
    j = c.join(cited, ["id", "place"], "left")
    squeezed = F.lower(F.regexp_replace(F.coalesce("exact", F.lit("")), r"\s+", ""))
    j = j.withColumns({"missing": F.filter("critical", lambda t: ~F.contains(squeezed, t)), "shared": F.size(F.array_intersect("words", words(F.col("general")))), "n": F.size("words")})
    coverage = F.when(F.col("n") > 0, F.col("shared") / F.col("n")).otherwise(1.0)
    overlaps = F.when(F.col("n") <= 4, F.col("shared") >= 1).otherwise((F.col("shared") >= 2) & (coverage >= 0.25))
    admits = F.col("lacking") & F.contains(F.lower("claim"), F.lit(NOT_ENOUGH.lower()))
    reason = F.when(admits, "insufficient_evidence_statement").when(F.col("unknown") > 0, "invalid_citation").when(F.size("labels") == 0, "missing_claim_citation").when(F.size("missing") > 0, "critical_token_not_in_cited_source").when(~overlaps, "weak_claim_source_overlap").otherwise("supported")
    return j.select("id", "place", "claim", reason.isin("supported", "insufficient_evidence_statement").alias("supported"), reason.alias("reason"), "missing", F.bround(coverage, 3).alias("coverage"))


def audit(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each answer: claims, supported ones, and whether it is grounded: no label of a source that wasn't given, and either every claim is supported or it says that there isn't enough."""
    per = claims(answers, sources).groupBy("id").agg(F.count("*").alias("claims"), F.count_if("supported").alias("supported"))
    said = answers.select("id", F.explode_outer(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(CITATION), F.lit(1)), F.upper))).alias("label"), F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(NOT_ENOUGH.lower())).alias("lacking"))
    known = sources.select("id", F.upper("label").alias("label"), F.lit(1).alias("there")).distinct()
    cites = said.join(known, ["id", "label"], "left").groupBy("id").agg(F.count("there").alias("valid"), F.count_if(F.col("label").isNotNull() & F.col("there").isNull()).alias("invalid"), F.bool_or("lacking").alias("lacking"))
    j = cites.join(per, "id", "left").fillna(0)
    return j.withColumn("grounded", (F.col("invalid") == 0) & (F.col("lacking") | ((F.col("valid") > 0) & (F.col("claims") > 0) & (F.col("supported") == F.col("claims")))))


def packet(results: DataFrame, pictures: DataFrame, most: int = 5) -> DataFrame:
    """results and pictures (question, rank, book, chunk, text; results also neighbour_of, null for a result itself, and asked) -> question, label, book, chunk, role, in order.

    The best result anchors the packet. Its neighbours come next, then further results: of the same book, or of all books if the question compares books. Pictures of the same scope take
    up to two places. Empty texts and repeated chunks are left out.
    """
    first = results.where("neighbour_of IS NULL").groupBy("question").agg(F.min_by("book", "rank").alias("anchor"), F.min("rank").alias("best"), F.min("asked").alias("asked"))
    across = F.coalesce(F.col("asked").rlike(CROSS_BOOK), F.lit(False))
    r = results.drop("asked").join(first, "question")
    top = F.col("neighbour_of").isNull() & (F.col("rank") == F.col("best"))
    beside = F.col("neighbour_of").isNotNull() & (F.col("neighbour_of") == F.col("best")) & ~across
    role = F.when(top, "top_result").when(beside, "adjacent_context").when(F.col("neighbour_of").isNull() & across, "cross_book_result").when(F.col("neighbour_of").isNull() & (F.col("book") == F.col("anchor")), "same_book_result")
    tier = F.when(top, 0).when(beside, 1).otherwise(2)
    r = r.withColumns({"role": role, "tier": tier}).where(F.col("role").isNotNull() & (F.trim("text") != ""))
    once = Window.partitionBy("question", "book", "chunk").orderBy("tier", "rank")
    r = r.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    p = pictures.join(first, "question").where(across | (F.col("book") == F.col("anchor"))).withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("rank"))).where(F.col("place") <= min(2, max(0, most - 1)))
    there = pictures.groupBy("question").agg(F.least(F.lit(min(2, max(0, most - 1))), F.count("*")).alias("kept"))
    r = r.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("tier", "rank", "chunk"))).join(there, "question", "left").where(F.col("place") <= F.greatest(F.lit(1), most - F.coalesce("kept", F.lit(0))))
    name = lambda letter: F.concat(F.lit(letter), F.col("place").cast("string"))
    return r.select("question", name("S").alias("label"), "book", "chunk", "role").unionByName(p.select("question", name("V").alias("label"), "book", "chunk", F.lit("visual").alias("role")))


def block(label: Column, book: Column, pages: Column, chunk: Column, headings: Column, text: Column) -> Column:
    """A source as it stands in a prompt."""
    clean = F.regexp_replace(F.trim(F.coalesce(book, F.lit("Unknown source"))), r"(?i)\.(?:pdf|zip)$", "")
    page = F.when(F.size(pages) > 0, F.array_join(pages.cast("array<string>"), ", ")).otherwise("unknown")
    heads = F.array_join(F.filter(F.transform(headings, lambda h: F.trim(h)), lambda h: h != ""), " > ")
    meta = F.concat_ws(" | ", F.concat(F.lit("Book: "), clean), F.concat(F.lit("Page: "), page), F.concat(F.lit("Chunk: "), F.coalesce(F.nullif(chunk, F.lit("")), F.lit("unknown"))), F.when(heads != "", F.concat(F.lit("Heading: "), heads)))
    return F.concat(F.lit("["), label, F.lit("] "), meta, F.lit("\n"), F.trim(F.coalesce(text, F.lit(""))))


def prompt(question: Column, blocks: Column) -> Column:
    return F.concat(F.lit("QUESTION:\n"), F.trim(question), F.lit("\n\nSOURCE EXCERPTS:\n"), F.array_join(blocks, "\n\n"))


def intent_evidence(text: Column, intent: Column) -> Column:
    """How much a text shows of what a question wants."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = F.split(F.regexp_replace(low, "[^a-z]+", " "), " ")
    found = lambda ws: F.least(F.lit(3.0), F.size(F.array_intersect(F.array_distinct(has), F.array(*[F.lit(w) for w in ws]))) * 0.5)
    yes = lambda p, points: F.when(low.rlike(p), points).otherwise(0.0)
    kinds = {
        "value": yes(r"[-+]?\d+(?:[.,]\d+)?", 1.0), "procedure": found(["check", "inspect", "adjust", "test", "replace", "remove", "install", "verify", "open", "close"]), "troubleshooting": found(["fault", "failure", "alarm", "cause", "remedy", "trip", "check", "inspect", "reset"]),
        "safety": yes(r"\b(?:warning|caution|danger|hazard|isolate|disconnect)\b", 2.0), "definition": yes(r"\b(?:is used to|purpose|function|means|consists|comprises)\b", 1.5),
    }
    return F.coalesce(*[F.when(intent == k, v) for k, v in kinds.items()], F.lit(0.0))


def tie_break(rows: DataFrame, epsilon: float = 4e-5) -> DataFrame:
    """rows (query, rank, score, evidence) -> place: scores within epsilon of the first of their island count as equal, and there more evidence comes first. A fold over each query's few results."""
    state = "cast(array() AS array<struct<rank:int,island:int>>)"
    listed = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")))).alias("x"))
    start = F.struct(F.lit(0).alias("island"), F.lit(None).cast("double").alias("base"), F.expr(state).alias("out"))
    new = lambda s, r: s["base"].isNull() | (F.abs(s["base"] - r["score"]) > epsilon)
    number = lambda s, r: s["island"] + F.when(new(s, r), 1).otherwise(0)
    fold = lambda s, r: F.struct(number(s, r).alias("island"), F.when(new(s, r), r["score"]).otherwise(s["base"]).alias("base"), F.concat(s["out"], F.array(F.struct(r["rank"].alias("rank"), number(s, r).alias("island")))).alias("out"))
    islands = listed.select("query", F.explode(F.aggregate("x", start, fold, lambda s: s["out"])).alias("i")).select("query", "i.rank", "i.island")
    w = Window.partitionBy("query").orderBy("island", F.desc("evidence"), "rank")
    return rows.join(islands, ["query", "rank"]).withColumn("place", F.row_number().over(w)).drop("island")


def same_source(a_book: Column, b_book: Column, a_items: Column, b_items: Column, a_pages: Column, b_pages: Column, a_chunk: Column, b_chunk: Column) -> Column:
    """Whether a result is one that was expected: of its book, and by shared items, else pages, else the chunk, whichever the expectation names."""
    other = F.coalesce(a_book != b_book, F.lit(False))
    fits = F.when(F.size(b_items) > 0, F.arrays_overlap(a_items, b_items)).when(F.size(b_pages) > 0, F.arrays_overlap(a_pages, b_pages)).otherwise(a_chunk == b_chunk)
    return ~other & F.coalesce(fits, F.lit(False))


def evaluate(results: DataFrame, cases: DataFrame, group: str, depths: list[int]) -> DataFrame:
    """results (case, rank, book, items, pages, chunk), cases (case, group, ready, and expected book, items, pages, chunk as e_...; several rows for several sources) -> of each group: cases, skipped ones (not ready), hits at each depth in per cent, and the mean reciprocal rank."""
    known = cases.where("ready")
    j = results.join(known, "case").where(same_source(*[F.col(c) for c in ("book", "e_book", "items", "e_items", "pages", "e_pages", "chunk", "e_chunk")]))
    first = j.groupBy("case").agg(F.min("rank").alias("rank"))
    per = cases.groupBy("case", group).agg(F.bool_and("ready").alias("ready")).join(first, "case", "left")
    share = lambda k: F.bround(100 * F.avg(F.when(F.col("ready"), F.when(F.col("rank") <= k, 1.0).otherwise(0.0))), 2).alias(f"hit_{k}")
    return per.groupBy(group).agg(F.count("*").alias("cases"), F.count_if(~F.col("ready")).alias("skipped"), *[share(k) for k in depths], F.bround(F.avg(F.when(F.col("ready"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))), 5).alias("mrr"))


def merge_cases(saved: DataFrame, added: DataFrame) -> DataFrame:
    """Cases of one question, told by its search tokens, are one: sources are joined, each once, and the newest note stays."""
    from lodestone.functions.text import normalized

    both = saved.unionByName(added).withColumn("key", normalized(F.col("question")))
    return both.groupBy("key").agg(F.min("id").alias("id"), F.array_sort(F.collect_set("source")).alias("sources"), F.max_by("note", F.struct(F.col("note").isNotNull() & (F.trim("note") != ""), "id")).alias("note"))
