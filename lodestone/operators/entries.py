"""Ledger entries: what source an entry speaks of, which of several entries holds, what people and checks decide, and what of it becomes evidence.

Entries are rows; a decision gives the table after it. Groups of entries on one source are settled by windows over the source key, so a group is as large as
the reruns of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.jobtable import transition

# Decisions of people about pictures, and verdicts that ask for a review.
DECISIONS = ["technical", "decorative", "useful", "not_useful"]
ACCEPTED, REFUSED = ["technical", "useful"], ["decorative", "not_useful"]
REVIEW_VERDICTS = ["LIKELY_CORRUPT", "UNCERTAIN"]


def source_key() -> Column:
    """text:table_cell:table:cell, text:text:index or vision:index; null if the entry doesn't say which source it means."""
    vision, cell = F.col("entry_type") == "vision_enrichment", F.col("source_type") == "table_cell"
    parts = lambda *xs: F.when(F.forall(F.array(*[x.cast("string") for x in xs]), lambda x: x.isNotNull()), F.concat_ws(":", *xs))
    text = F.when(cell, parts(F.lit("text:table_cell"), F.col("table_index"), F.col("cell_index"))).otherwise(parts(F.lit("text:text"), F.col("source_index")))
    return F.when(vision, parts(F.lit("vision"), F.col("source_index"))).when(F.col("entry_type") == "text_correction", text)


def decision_epoch() -> Column:
    return F.coalesce("decided_at", "saved_at", "created_at", F.lit(0.0))


def is_sweep() -> Column:
    return F.col("route_id").rlike("^AV[0-9]{6}$") | (F.coalesce("route_code", F.lit("")) == "FULL_TECHNICAL_VISUAL")


def needs_human() -> Column:
    undecided = ~F.coalesce(F.col("human_decision").isin(DECISIONS), F.lit(False))
    open_ = (F.coalesce("verdict", F.lit("")) == "UNCERTAIN") | F.coalesce("unresolved", F.lit(False)) | (F.lower("status") == "pending")
    return (F.col("entry_type") == "vision_enrichment") & (F.col("status") != "superseded") & undecided & open_


def vision_status(verdict: Column, diagram_like: Column) -> tuple[Column, Column]:
    """Status and reason that a verdict on a picture leads to."""
    v = F.coalesce(verdict, F.lit("UNCERTAIN"))
    low, drawn = v == "DECORATIVE_OR_LOW_VALUE", F.coalesce(diagram_like, F.lit(False))
    pick = lambda a, b, c, d: F.when(v == "TECHNICAL_USEFUL", a).when(low & drawn, b).when(low, c).otherwise(d)
    return pick("applied", "pending", "excluded", "pending"), pick("TECHNICAL_VISUAL_ENRICHMENT", "VISION_DIAGRAM_CONFLICT_REVIEW", "DECORATIVE_OR_LOW_VALUE", "VISION_UNCERTAIN")


def restored() -> tuple[Column, Column]:
    """Status and reason before an overlap superseded an entry, if it was superseded and they can be told."""
    gone, by_normal = F.col("status") == "superseded", F.col("status_reason") == "SUPERSEDED_BY_NORMAL_PICTURE_ROUTE"
    status, reason = vision_status(F.col("verdict"), F.col("diagram_like"))
    kept = gone & (F.coalesce("previous_status", F.lit("")) != "")
    return (
        F.when(gone & by_normal, status).when(kept, F.col("previous_status")).otherwise(F.coalesce("status", F.lit("pending"))),
        F.when(gone & by_normal, reason).when(kept, F.coalesce(F.col("previous_status_reason"), F.lit("RESTORED_PREVIOUS_STATUS"))).otherwise(F.coalesce("status_reason", F.lit(""))),
    )


def resolve_overlaps(entries: DataFrame, group: list[str]) -> DataFrame:
    """Of the entries on one picture one stays, if both a sweep and an ordinary route have one: the applied one, else the ordinary one, else the newest. The winner gets its status back, the others are superseded by its route."""
    status, reason = restored()
    mine = (F.col("entry_type") == "vision_enrichment") & F.col("source_index").isNotNull()
    e = entries.withColumns({"__status": status, "__reason": reason, "__sweep": is_sweep(), "__mine": mine})
    w = Window.partitionBy("__mine", *group, "source_index")
    both = F.col("__mine") & F.bool_or("__sweep").over(w) & F.bool_or(~F.col("__sweep")).over(w)
    order = [F.desc(F.col("__status") == "applied"), F.asc("__sweep"), F.desc("created_at"), F.asc("entry_id")]
    e = e.withColumns({"__both": both, "__n": F.row_number().over(w.orderBy(*order)), "__winner": F.first("route_id").over(w.orderBy(*order))})
    e = transition(e, F.col("__both") & (F.col("__n") == 1), status=F.col("__status"), status_reason=F.col("__reason"))
    lost = F.col("__both") & (F.col("__n") > 1)
    e = transition(e, lost, previous_status=F.col("__status"), previous_status_reason=F.col("__reason"), status="superseded", status_reason="SUPERSEDED_BY_BETTER_OVERLAP_EVIDENCE")
    return e.withColumn("superseded_by", F.when(lost, F.col("__winner"))).select(*entries.columns, "superseded_by")


def reconcile(entries: DataFrame, current: str) -> DataFrame:
    """One entry stays of each book and source: the one that a person decided last, else that of the current generation, else the newest. The others are superseded and keep their status for the record."""
    e = entries.withColumn("__key", source_key())
    order = [F.desc("human_verified"), F.when(F.col("human_verified"), decision_epoch()).desc_nulls_last(), F.desc(F.col("generation") == current), F.desc("created_at"), F.desc("entry_id")]
    w = Window.partitionBy("book", "__key").orderBy(*order)
    e = e.withColumns({"__n": F.row_number().over(w), "superseded_by": F.first("entry_id").over(w)})
    lost = F.col("__key").isNotNull() & (F.col("__n") > 1)
    e = e.withColumn("superseded_by", F.when(lost, F.col("superseded_by")))
    fresh = lost & (F.col("status") != "superseded")
    return transition(e, fresh, previous_status=F.col("status"), previous_status_reason=F.col("status_reason"), status="superseded", status_reason="SUPERSEDED_BY_RERUN").select(*entries.columns, "superseded_by")


def authorities(entries: DataFrame) -> DataFrame:
    """The entry that speaks for each picture: the last one that a person decided, else an open one, an ordinary route before a sweep, else the newest."""
    subject = F.coalesce(F.concat(F.lit("source:"), F.col("source_index").cast("string")), F.concat(F.lit("entry:"), F.col("entry_id").cast("string")))
    decided = F.coalesce(F.col("human_verified") & F.col("human_decision").isin(DECISIONS), F.lit(False))
    tier = F.when(decided, 0).when(needs_human() & ~is_sweep(), 1).when(needs_human(), 2).otherwise(3)
    order = [F.asc("__tier"), F.when(decided, decision_epoch()).otherwise(F.col("created_at")).desc(), F.desc("entry_id")]
    v = entries.where("entry_type = 'vision_enrichment' AND status <> 'superseded'").withColumns({"subject": subject, "__tier": tier})
    return v.withColumn("__n", F.row_number().over(Window.partitionBy("book", "subject").orderBy(*order))).where("__n = 1").drop("__n", "__tier")


def decide_pictures(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (entry_id, decision): what a person says of a picture settles it; accepted pictures without evidence ask for it to be read again."""
    d = entries.join(decisions.select("entry_id", F.lower(F.trim("decision")).alias("__decision")), "entry_id", "left")
    hit = (F.col("entry_type") == "vision_enrichment") & F.col("__decision").isin(DECISIONS)
    yes = F.col("__decision").isin(ACCEPTED)
    d = d.withColumn("recovery_required", hit & yes & ~has_evidence())
    return transition(d, hit, human_decision=F.col("__decision"), human_verified=True, previous_status=F.col("status"), previous_status_reason=F.col("status_reason"), status=F.when(yes, "applied").otherwise("excluded"), status_reason=F.when(yes, "HUMAN_VISUAL_ACCEPTED").otherwise("HUMAN_VISUAL_EXCLUDED"), unresolved=False).select(*entries.columns, F.coalesce("recovery_required", F.lit(False)).alias("recovery_required"))


def decide_texts(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (entry_id, action, text): a person applies, rejects or proposes a text; empty texts and other actions change nothing."""
    d = entries.join(decisions.select("entry_id", F.col("action").alias("__action"), F.trim("text").alias("__text")), "entry_id", "left")
    status = F.create_map(*[F.lit(x) for p in {"apply": "applied", "reject": "rejected", "propose": "proposed"}.items() for x in p])[F.col("__action")]
    hit = (F.col("entry_type") == "text_correction") & status.isNotNull() & (F.col("__text") != "")
    d = d.withColumn("review", F.when(hit, F.struct(F.col("__action").alias("action"), F.col("original_text").alias("before_text"), F.col("__text").alias("after_text"), (F.coalesce("original_text", F.lit("")) != F.col("__text")).alias("changed"), F.col("status").alias("previous_status"))))
    return transition(d, hit, proposed_text=F.col("__text"), status=status, status_reason="HUMAN_VERIFIED", human_verified=True).select(*entries.columns, "review")


def revalidate(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (entry_id, new_verdict): newer rules judge texts again that no person has seen."""
    u = entries.join(updates.select("entry_id", F.coalesce("new_verdict", F.lit("UNCERTAIN")).alias("__new")), "entry_id", "left")
    hit = (F.col("entry_type") == "text_correction") & ~F.col("human_verified") & F.col("__new").isNotNull()
    new, old = F.col("__new"), F.col("status")
    status = F.when(new == "LIKELY_OK", "excluded").when(new == "UNCERTAIN", F.when(old == "applied", old).otherwise("pending")).otherwise(F.when(old.isin("applied", "proposed"), old).otherwise("pending"))
    reason = F.when(new == "LIKELY_OK", "REVALIDATED_LIKELY_OK").when(new == "UNCERTAIN", "REVALIDATED_UNCERTAIN_HUMAN_REVIEW").otherwise("REVALIDATED_LIKELY_CORRUPT_HUMAN_REVIEW")
    return transition(u, hit, verdict=new, status=status, status_reason=reason, proposed_text=F.when(new != "LIKELY_OK", F.col("proposed_text"))).select(*entries.columns)


def text_review(entries: DataFrame, required: bool) -> DataFrame:
    """Of each book: corrections, those to review, reviewed, applied by themselves, still required (all unseen ones, or the unsettled), by verdict, and whether the review is complete."""
    t = entries.where("status <> 'superseded' AND entry_type = 'text_correction'")
    asks = F.coalesce(F.upper("verdict").isin(REVIEW_VERDICTS), F.lit(False))
    unseen = asks & ~F.col("human_verified")
    unsettled = unseen & F.lower("status").isin("pending", "proposed")
    needed = unseen if required else unsettled
    return t.groupBy("book").agg(
        F.count("*").alias("total"), F.count_if(asks).alias("candidates"), F.count_if(asks & F.col("human_verified")).alias("reviewed"), F.count_if(unseen & (F.lower("status") == "applied")).alias("auto_applied"), F.count_if(needed).alias("required"),
        F.count_if(needed & (F.upper("verdict") == "UNCERTAIN")).alias("uncertain"), F.count_if(needed & (F.upper("verdict") == "LIKELY_CORRUPT")).alias("corrupt"), F.count_if(unsettled).alias("unsettled"), (F.count_if(needed) == 0).alias("complete"),
    )


def audit_gate(entries: DataFrame, bypassed: DataFrame, text_required: bool) -> DataFrame:
    """Of each book: pictures that wait for a decision, by ordinary route and sweep, accepted ones without evidence, and whether chunks may be built. bypassed (book) lets books through for a test."""
    text = text_review(entries, text_required).select("book", F.col("required").alias("text_required"))
    open_, sweep = needs_human(), is_sweep()
    lacking = F.coalesce(F.col("human_decision").isin(ACCEPTED), F.lit(False)) & ~has_evidence()
    pictures = authorities(entries).groupBy("book").agg(F.count("*").alias("subjects"), F.count_if(open_ & ~sweep).alias("route_required"), F.count_if(open_ & sweep).alias("sweep_required"), F.count_if(lacking).alias("recovery_required"))
    g = pictures.join(text, "book", "full").fillna(0).join(bypassed.select("book", F.lit(True).alias("__through")), "book", "left")
    text_blocks = F.col("text_required") if text_required else F.lit(0)
    waits = F.col("route_required") + F.col("sweep_required")
    blocking = text_blocks + waits + F.col("recovery_required")
    status = F.when((blocking > 0) & F.col("__through"), "bypassed_for_testing").when(blocking == 0, "ready").when((waits == 0) & (text_blocks == 0), "waiting_for_evidence_recovery").otherwise("waiting_for_audit")
    return g.withColumns({"blocking": blocking.cast("long"), "gate": status}).drop("__through", "text_required")


def clean_list(values: Column, limit: int = 20, longest: int = 160) -> Column:
    """Trimmed, one space inside, cut, each once whatever its case, in order, no more than ``limit``."""
    texts = F.filter(F.transform(F.coalesce(values, F.expr("cast(array() AS array<string>)")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    keyed = F.transform(texts, lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    first = F.filter(keyed, lambda x, i: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == i + 1)
    return F.slice(F.transform(first, lambda x: F.substring(x["v"], 1, longest)), 1, limit)


def has_evidence() -> Column:
    none = lambda c: F.size(clean_list(F.split(c, r"\|"))) == 0
    return ~(none("visible_text") & none("visible_objects") & (F.trim(F.coalesce("summary", F.lit(""))) == ""))


def eligibility() -> tuple[Column, Column]:
    """Whether an entry may serve as visual evidence, and why: the first rule that holds."""
    status, decided = F.lower(F.coalesce("status", F.lit(""))), F.col("human_verified")
    refused, taken = (F.coalesce(decided & F.col("human_decision").isin(d), F.lit(False)) for d in (REFUSED, ACCEPTED))
    verdict = F.upper(F.coalesce("verdict", F.lit("")))
    rules = [
        (status != "applied", F.concat(F.lit("stage2c_"), F.when(status == "", "unknown").otherwise(status))), (refused, F.lit("human_visual_excluded")), (taken & ~has_evidence(), F.lit("human_accepted_evidence_recovery_required")),
        (taken, F.lit("human_accepted_technical_visual")), ((verdict != "") & (verdict != "TECHNICAL_USEFUL"), F.concat(F.lit("verdict_"), F.lower(verdict))), (F.coalesce("unresolved", F.lit(True)), F.lit("unresolved_visual_details")), (~has_evidence(), F.lit("empty_visual_evidence")),
    ]
    reason = F.coalesce(*[F.when(test, why) for test, why in rules], F.lit("applied_resolved_technical_visual"))
    return reason.isin("human_accepted_technical_visual", "applied_resolved_technical_visual"), reason


def evidence(entries: DataFrame) -> DataFrame:
    """A row of visual evidence for each picture entry: its words, things and summary cleaned, its category, whether it may serve, and the text that a search reads."""
    ok, why = eligibility()
    v = entries.where("entry_type = 'vision_enrichment'")
    category = F.regexp_replace(F.lower(F.trim(F.coalesce("category", F.lit("unknown")))), " ", "_")
    v = v.select("entry_id", "book", "source_index", F.when(category == "", "unknown").otherwise(category).alias("category"), clean_list(F.split("visible_text", r"\|")).alias("words"), clean_list(F.split("visible_objects", r"\|"), 20, 220).alias("things"), F.substring(F.trim(F.regexp_replace(F.coalesce("summary", F.lit("")), r"\s+", " ")), 1, 1_200).alias("summary"), ok.alias("eligible"), why.alias("reason"))
    named = F.when(F.col("category") != "unknown", F.regexp_replace("category", "_", " "))
    return v.withColumn("search_text", F.concat_ws("\n", named, F.when(F.size("words") > 0, F.array_join("words", "\n")), F.when(F.size("things") > 0, F.array_join("things", "\n")), F.when(F.col("summary") != "", F.col("summary"))))


def merged(first: Column, second: Column, limit: int) -> Column:
    """Two lists of evidence as one: in order, each once whatever its case."""
    return clean_list(F.concat(first, second), limit, 220)


def page_affinity(pages: Column, preferred: Column) -> Column:
    """struct<kind, bonus>: a picture on a page of the best texts, beside one, or neither."""
    near = F.exists(pages, lambda p: F.exists(preferred, lambda q: F.abs(p - q) == 1))
    kind = F.when(F.arrays_overlap(pages, preferred), "same_page").when(near, "adjacent_page").otherwise("query_match")
    return F.struct(kind.alias("kind"), F.when(kind == "same_page", 1.5).when(kind == "adjacent_page", 0.35).otherwise(0.0).alias("bonus"))
