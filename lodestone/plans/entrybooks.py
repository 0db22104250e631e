"""Catalog queries on ledger entries: which holds, what was decided, what waits, and what serves as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import entries as e
from lodestone.plans.catalog import query
from lodestone.plans.inputs import LEDGER, view

_L = f"WITH l AS ({LEDGER})"
_SWEEP = "(regexp_full_match(route_id, 'AV[0-9]{6}') OR coalesce(route_code, '') = 'FULL_TECHNICAL_VISUAL')"
_NEEDS = "(entry_type = 'vision_enrichment' AND status <> 'superseded' AND human_decision IS NULL AND (coalesce(verdict, '') = 'UNCERTAIN' OR unresolved OR status = 'pending'))"
_KEY = "CASE WHEN entry_type = 'vision_enrichment' THEN 'vision:' || source_index WHEN source_type = 'table_cell' THEN 'text:table_cell:' || table_index || ':' || cell_index ELSE 'text:text:' || source_index END"
_EPOCH = "coalesce(decided_at, saved_at, created_at)"
_HAS = "(regexp_matches(visible_text, '\\S') OR regexp_matches(visible_objects, '\\S') OR trim(summary) <> '')"


def _l(spark, sf):
    return view(spark, sf, LEDGER)


@query(f"{_L} SELECT entry_id, {_KEY} AS key, {_EPOCH} AS decided, {_SWEEP} AS sweep, {_NEEDS} AS needs_human FROM l")
def logical_source_keys(spark, sf):
    return _l(spark, sf).select("entry_id", e.source_key().alias("key"), e.decision_epoch().alias("decided"), e.is_sweep().alias("sweep"), e.needs_human().alias("needs_human"))


_VS = "CASE coalesce(verdict, 'UNCERTAIN') WHEN 'TECHNICAL_USEFUL' THEN 'applied' WHEN 'DECORATIVE_OR_LOW_VALUE' THEN CASE WHEN diagram_like THEN 'pending' ELSE 'excluded' END ELSE 'pending' END"
_VR = "CASE coalesce(verdict, 'UNCERTAIN') WHEN 'TECHNICAL_USEFUL' THEN 'TECHNICAL_VISUAL_ENRICHMENT' WHEN 'DECORATIVE_OR_LOW_VALUE' THEN CASE WHEN diagram_like THEN 'VISION_DIAGRAM_CONFLICT_REVIEW' ELSE 'DECORATIVE_OR_LOW_VALUE' END ELSE 'VISION_UNCERTAIN' END"
_RS = f"CASE WHEN status = 'superseded' AND status_reason = 'SUPERSEDED_BY_NORMAL_PICTURE_ROUTE' THEN {_VS} WHEN status = 'superseded' AND previous_status IS NOT NULL THEN previous_status ELSE status END"
_RR = f"CASE WHEN status = 'superseded' AND status_reason = 'SUPERSEDED_BY_NORMAL_PICTURE_ROUTE' THEN {_VR} WHEN status = 'superseded' AND previous_status IS NOT NULL THEN coalesce(previous_status_reason, 'RESTORED_PREVIOUS_STATUS') ELSE status_reason END"


@query(f"{_L} SELECT entry_id, {_VS} AS policy_status, {_VR} AS policy_reason, {_RS} AS restored_status, {_RR} AS restored_reason FROM l")
def restored_statuses(spark, sf):
    (a, b), (c, d) = e.vision_status(F.col("verdict"), F.col("diagram_like")), e.restored()
    return _l(spark, sf).select("entry_id", a.alias("policy_status"), b.alias("policy_reason"), c.alias("restored_status"), d.alias("restored_reason"))


@query(f"""{_L}, r AS (SELECT *, {_RS} AS rs, {_RR} AS rr, {_SWEEP} AS sw FROM l), g AS (SELECT book, generation, source_index FROM r WHERE entry_type = 'vision_enrichment' AND source_index IS NOT NULL GROUP BY ALL HAVING bool_or(sw) AND bool_or(NOT sw)),
n AS (SELECT r.entry_id, rs, rr, row_number() OVER w AS n, first_value(route_id) OVER w AS winner FROM r JOIN g USING (book, generation, source_index) WHERE entry_type = 'vision_enrichment' WINDOW w AS (PARTITION BY book, generation, source_index ORDER BY (rs = 'applied') DESC, sw, created_at DESC, entry_id))
SELECT l.entry_id, CASE WHEN n = 1 THEN rs WHEN n > 1 THEN 'superseded' ELSE status END AS status, CASE WHEN n = 1 THEN rr WHEN n > 1 THEN 'SUPERSEDED_BY_BETTER_OVERLAP_EVIDENCE' ELSE status_reason END AS status_reason, CASE WHEN n > 1 THEN rs ELSE previous_status END AS previous_status, CASE WHEN n > 1 THEN winner END AS superseded_by FROM l LEFT JOIN n USING (entry_id)""")
def resolve_picture_overlaps(spark, sf):
    return e.resolve_overlaps(_l(spark, sf), ["book", "generation"]).select("entry_id", "status", "status_reason", "previous_status", "superseded_by")


@query(f"""{_L}, k AS (SELECT *, {_KEY} AS key FROM l), n AS (SELECT entry_id, row_number() OVER w AS n, first_value(entry_id) OVER w AS winner FROM k WHERE key IS NOT NULL
WINDOW w AS (PARTITION BY book, key ORDER BY human_verified DESC, CASE WHEN human_verified THEN {_EPOCH} END DESC NULLS LAST, (generation = 'g1') DESC, created_at DESC, entry_id DESC))
SELECT l.entry_id, CASE WHEN n > 1 THEN 'superseded' ELSE status END AS status, CASE WHEN n > 1 AND status <> 'superseded' THEN status ELSE previous_status END AS previous_status, CASE WHEN n > 1 THEN winner END AS superseded_by FROM l LEFT JOIN n USING (entry_id)""")
def reconcile_entry_generations(spark, sf):
    return e.reconcile(_l(spark, sf), "g1").select("entry_id", "status", "previous_status", "superseded_by")


_SUBJECT = "coalesce('source:' || source_index, 'entry:' || entry_id)"
_AUTH = f"""a AS (SELECT * FROM (SELECT *, {_SUBJECT} AS subject, row_number() OVER (PARTITION BY book, {_SUBJECT} ORDER BY CASE WHEN human_verified AND human_decision IS NOT NULL THEN 0 WHEN {_NEEDS} AND NOT {_SWEEP} THEN 1 WHEN {_NEEDS} THEN 2 ELSE 3 END,
CASE WHEN human_verified AND human_decision IS NOT NULL THEN {_EPOCH} ELSE created_at END DESC, entry_id DESC) AS n FROM l WHERE entry_type = 'vision_enrichment' AND status <> 'superseded') WHERE n = 1)"""


@query(f"{_L}, {_AUTH} SELECT book, subject, entry_id FROM a")
def authoritative_subjects(spark, sf):
    return e.authorities(_l(spark, sf)).select("book", "subject", "entry_id")


_DECISIONS = "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 5 = 0 THEN ' Technical ' WHEN o_orderkey % 5 = 1 THEN 'decorative' WHEN o_orderkey % 5 = 2 THEN 'useful' WHEN o_orderkey % 5 = 3 THEN 'maybe' END AS decision FROM orders WHERE o_orderkey % 2 = 0"


@query(f"""{_L}, d AS (SELECT l.*, lower(trim(decision)) AS decision, coalesce(entry_type = 'vision_enrichment' AND lower(trim(decision)) IN ('technical', 'useful', 'decorative'), false) AS hit FROM l LEFT JOIN ({_DECISIONS}) USING (entry_id))
SELECT entry_id, CASE WHEN NOT hit THEN status WHEN decision = 'decorative' THEN 'excluded' ELSE 'applied' END AS status, CASE WHEN NOT hit THEN status_reason WHEN decision = 'decorative' THEN 'HUMAN_VISUAL_EXCLUDED' ELSE 'HUMAN_VISUAL_ACCEPTED' END AS status_reason, hit OR human_verified AS human_verified, unresolved AND NOT hit AS unresolved, hit AND decision <> 'decorative' AND NOT {_HAS} AS recovery_required FROM d""")
def human_picture_decisions(spark, sf):
    return e.decide_pictures(_l(spark, sf), view(spark, sf, _DECISIONS)).select("entry_id", "status", "status_reason", "human_verified", "unresolved", "recovery_required")


_TEXTS = "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN 'apply' WHEN o_orderkey % 4 = 1 THEN 'reject' WHEN o_orderkey % 4 = 2 THEN 'propose' ELSE 'drop' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE concat(' text ', CAST(o_orderkey % 50 AS STRING)) END AS text FROM orders WHERE o_orderkey % 2 = 1"


@query(f"""{_L}, d AS (SELECT l.*, action, trim(text) AS text, coalesce(entry_type = 'text_correction' AND action <> 'drop' AND trim(text) <> '', false) AS hit FROM l LEFT JOIN ({_TEXTS}) USING (entry_id))
SELECT entry_id, CASE WHEN NOT hit THEN status WHEN action = 'apply' THEN 'applied' WHEN action = 'reject' THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN hit THEN text ELSE proposed_text END AS proposed_text, CASE WHEN hit THEN original_text <> text END AS changed, CASE WHEN hit THEN status END AS previous FROM d""")
def human_text_decisions(spark, sf):
    return e.decide_texts(_l(spark, sf), view(spark, sf, _TEXTS)).select("entry_id", "status", "proposed_text", F.col("review.changed").alias("changed"), F.col("review.previous_status").alias("previous"))


_UPDATES = "SELECT o_orderkey AS entry_id, CASE WHEN o_orderkey % 4 = 0 THEN 'LIKELY_OK' WHEN o_orderkey % 4 = 1 THEN 'UNCERTAIN' WHEN o_orderkey % 4 = 2 THEN 'LIKELY_CORRUPT' END AS new_verdict FROM orders WHERE o_custkey % 3 > 0"


@query(f"""{_L}, d AS (SELECT l.*, coalesce(new_verdict, 'UNCERTAIN') AS new, u.entry_id IS NOT NULL AND entry_type = 'text_correction' AND NOT human_verified AS hit FROM l LEFT JOIN ({_UPDATES}) u ON u.entry_id = l.entry_id)
SELECT entry_id, CASE WHEN hit THEN new ELSE verdict END AS verdict, CASE WHEN NOT hit THEN status WHEN new = 'LIKELY_OK' THEN 'excluded' WHEN status = 'applied' OR (new = 'LIKELY_CORRUPT' AND status = 'proposed') THEN status ELSE 'pending' END AS status,
CASE WHEN NOT hit THEN status_reason WHEN new = 'LIKELY_OK' THEN 'REVALIDATED_LIKELY_OK' ELSE 'REVALIDATED_' || new || '_HUMAN_REVIEW' END AS status_reason, CASE WHEN NOT hit OR new <> 'LIKELY_OK' THEN proposed_text END AS proposed_text FROM d""")
def revalidate_unreviewed_texts(spark, sf):
    return e.revalidate(_l(spark, sf), view(spark, sf, _UPDATES)).select("entry_id", "verdict", "status", "status_reason", "proposed_text")


_REVIEW = """t AS (SELECT *, coalesce(verdict IN ('LIKELY_CORRUPT', 'UNCERTAIN'), false) AS asks FROM l WHERE status <> 'superseded' AND entry_type = 'text_correction')"""


@query(f"""{_L}, {_REVIEW} SELECT book, count(*) AS total, count_if(asks)::BIGINT AS candidates, count_if(asks AND human_verified)::BIGINT AS reviewed, count_if(asks AND NOT human_verified AND status = 'applied')::BIGINT AS auto_applied, count_if(asks AND NOT human_verified)::BIGINT AS required,
count_if(asks AND NOT human_verified AND verdict = 'UNCERTAIN')::BIGINT AS uncertain, count_if(asks AND NOT human_verified AND verdict = 'LIKELY_CORRUPT')::BIGINT AS corrupt, count_if(asks AND NOT human_verified AND status IN ('pending', 'proposed'))::BIGINT AS unsettled, count_if(asks AND NOT human_verified) = 0 AS complete FROM t GROUP BY book""")
def human_review_counts(spark, sf):
    return e.text_review(_l(spark, sf), required=True)


@query(f"""{_L}, {_REVIEW}, {_AUTH}, x AS (SELECT book, count_if(asks AND NOT human_verified) AS text_required FROM t GROUP BY book),
p AS (SELECT book, count(*) AS subjects, count_if({_NEEDS} AND NOT {_SWEEP}) AS route_required, count_if({_NEEDS} AND {_SWEEP}) AS sweep_required, count_if(coalesce(human_decision = 'technical', false) AND NOT {_HAS}) AS recovery_required FROM a GROUP BY book),
g AS (SELECT book, coalesce(subjects, 0) AS subjects, coalesce(route_required, 0) AS route_required, coalesce(sweep_required, 0) AS sweep_required, coalesce(recovery_required, 0) AS recovery_required, coalesce(text_required, 0) AS text_required FROM p FULL JOIN x USING (book))
SELECT book, subjects::BIGINT AS subjects, route_required::BIGINT AS route_required, sweep_required::BIGINT AS sweep_required, recovery_required::BIGINT AS recovery_required, (text_required + route_required + sweep_required + recovery_required)::BIGINT AS blocking,
CASE WHEN text_required + route_required + sweep_required + recovery_required = 0 THEN 'ready' WHEN book < 5 THEN 'bypassed_for_testing' WHEN route_required + sweep_required + text_required = 0 THEN 'waiting_for_evidence_recovery' ELSE 'waiting_for_audit' END AS gate FROM g""")
def verifier_audit_gate(spark, sf):
    return e.audit_gate(_l(spark, sf), spark.range(5).select(F.col("id").alias("book")), text_required=True)


_CLEAN = "list_filter(list_transform(string_split({c}, '|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_UNIQUE = "list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i)"
_WORDS = _UNIQUE.format(l=_CLEAN.format(c="visible_text"))
_THINGS = _UNIQUE.format(l=_CLEAN.format(c="visible_objects"))
_WHY = f"""CASE WHEN status <> 'applied' THEN 'stage2c_' || status WHEN human_verified AND coalesce(human_decision = 'decorative', false) THEN 'human_visual_excluded' WHEN human_verified AND coalesce(human_decision = 'technical', false) AND NOT {_HAS} THEN 'human_accepted_evidence_recovery_required'
WHEN human_verified AND coalesce(human_decision = 'technical', false) THEN 'human_accepted_technical_visual' WHEN verdict IS NOT NULL AND verdict <> 'TECHNICAL_USEFUL' THEN 'verdict_' || lower(verdict) WHEN unresolved THEN 'unresolved_visual_details' WHEN NOT {_HAS} THEN 'empty_visual_evidence' ELSE 'applied_resolved_technical_visual' END"""
_EVID = f"""v AS (SELECT entry_id, book, source_index, replace(lower(trim(coalesce(category, 'unknown'))), ' ', '_') AS category, {_WORDS} AS words, {_THINGS} AS things, trim(regexp_replace(summary, '\\s+', ' ', 'g')) AS summary, {_WHY} AS reason FROM l WHERE entry_type = 'vision_enrichment')"""


@query(f"""{_L}, {_EVID} SELECT entry_id, category, array_to_string(words, ';') AS words, array_to_string(things, ';') AS things, reason, reason IN ('human_accepted_technical_visual', 'applied_resolved_technical_visual') AS eligible,
concat_ws(chr(10), CASE WHEN category <> 'unknown' THEN replace(category, '_', ' ') END, CASE WHEN len(words) > 0 THEN array_to_string(words, chr(10)) END, CASE WHEN len(things) > 0 THEN array_to_string(things, chr(10)) END, CASE WHEN summary <> '' THEN summary END) AS search_text FROM v""")
def visual_evidence(spark, sf):
    return e.evidence(_l(spark, sf)).select("entry_id", "category", F.array_join("words", ";").alias("words"), F.array_join("things", ";").alias("things"), "reason", "eligible", "search_text")


@query(f"{_L}, {_EVID} SELECT reason, count(*) AS n, count(DISTINCT book) AS books FROM v GROUP BY reason")
def visual_reason_counts(spark, sf):
    return e.evidence(_l(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("book").alias("books"))


@query(f"{_L} SELECT entry_id, array_to_string({_UNIQUE.format(l='(' + _CLEAN.format(c='visible_text') + ' || ' + _CLEAN.format(c='visible_objects') + ' || ' + _CLEAN.format(c='visible_text') + ')')}[1:3], ';') AS merged FROM l")
def merge_visual_evidence(spark, sf):
    parts = lambda c: F.split(c, r"\|")
    return _l(spark, sf).select("entry_id", F.array_join(e.merged(parts("visible_text"), F.concat(parts("visible_objects"), parts("visible_text")), 3), ";").alias("merged"))


@query(f"""{_L}, q AS (SELECT book, list_distinct(list(source_index)) AS preferred FROM l WHERE entry_type = 'text_correction' AND status = 'applied' AND source_index IS NOT NULL GROUP BY book), v AS (SELECT entry_id, book, source_index FROM l WHERE entry_type = 'vision_enrichment' AND source_index IS NOT NULL)
SELECT entry_id, CASE WHEN same THEN 'same_page' WHEN near THEN 'adjacent_page' ELSE 'query_match' END AS kind, CASE WHEN same THEN 1.5 WHEN near THEN 0.35 ELSE 0.0 END::DOUBLE AS bonus FROM (SELECT entry_id, list_contains(preferred, source_index) AS same, list_contains(preferred, source_index - 1) OR list_contains(preferred, source_index + 1) AS near FROM v JOIN q USING (book))""")
def visual_page_affinity(spark, sf):
    rows = _l(spark, sf)
    preferred = rows.where("entry_type = 'text_correction' AND status = 'applied' AND source_index IS NOT NULL").groupBy("book").agg(F.collect_set("source_index").alias("preferred"))
    v = rows.where("entry_type = 'vision_enrichment' AND source_index IS NOT NULL").join(preferred, "book")
    return v.select("entry_id", e.page_affinity(F.array("source_index"), F.col("preferred")).alias("a")).select("entry_id", "a.kind", "a.bonus")


@query(f"{_L} SELECT entry_id, outcome, place, of_book FROM (SELECT entry_id, outcome, row_number() OVER (PARTITION BY book ORDER BY created_at DESC, entry_id) AS place, of_book, blob FROM (SELECT *, CASE WHEN human_verified THEN 'reviewed' WHEN status = 'applied' THEN 'applied' WHEN status IN ('pending', 'proposed') THEN 'needs_review' ELSE 'original_kept' END AS outcome, count(*) OVER (PARTITION BY book) AS of_book, lower(concat_ws(' ', original_text, proposed_text, route_id, verdict)) AS blob FROM l WHERE entry_type = 'text_correction') WHERE outcome <> 'original_kept' AND contains(blob, 'r1') AND contains(blob, 'new')) WHERE place <= 5")
def text_audit_page(spark, sf):
    """The first page of each book's audit: counts are taken before the filters, order and limit after them."""
    from pyspark.sql import Window

    outcome = F.when(F.col("human_verified"), "reviewed").when(F.col("status") == "applied", "applied").when(F.col("status").isin("pending", "proposed"), "needs_review").otherwise("original_kept")
    t = _l(spark, sf).where("entry_type = 'text_correction'").withColumns({"outcome": outcome, "of_book": F.count("*").over(Window.partitionBy("book")), "blob": F.lower(F.concat_ws(" ", "original_text", "proposed_text", "route_id", "verdict"))})
    t = t.where((F.col("outcome") != "original_kept") & F.col("blob").contains("r1") & F.col("blob").contains("new"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("book").orderBy(F.desc("created_at"), "entry_id"))).where("place <= 5").select("entry_id", "outcome", F.col("place").cast("long").alias("place"), "of_book")


#: Importing it registers its queries.
NAME = __name__
