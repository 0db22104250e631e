"""Inputs of catalog queries: rows in the shape an operator wants, made from the test tables by SQL that Spark and DuckDB read alike.

Only the input is shared; what a query computes from it is written twice, as an operator and as SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

CONVERSIONS = """SELECT o_orderkey AS id, concat('book', CAST(o_custkey AS STRING), '.pdf') AS filename,
CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'processing' WHEN o_orderkey % 7 IN (2, 3) THEN 'failed' WHEN o_orderkey % 7 = 4 THEN 'completed' ELSE 'pending' END AS status,
CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('task', CAST(o_orderkey AS STRING)) END AS task_id,
CASE WHEN o_orderkey % 11 < 4 THEN 'The remote service reported a task failure: x' WHEN o_orderkey % 11 < 8 THEN 'ReadTimeout' END AS error_message, CASE WHEN o_orderkey % 11 < 8 THEN 'Error' END AS error_type,
CAST(o_orderkey % 4 AS INT) AS retry_count, CAST(o_orderkey % 97 AS DOUBLE) AS seconds, o_orderkey * 10 AS submitted_at, CASE WHEN o_orderkey % 7 IN (2, 3, 4) THEN o_orderkey * 10 + 5 END AS completed_at,
CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('h', CAST(o_orderkey % 90 AS STRING), 'abcdefghij') END AS sha256, CASE WHEN o_orderkey % 6 < 2 THEN NULL ELSE o_orderkey % 13 END AS size, CASE WHEN o_orderkey % 6 < 2 THEN NULL ELSE o_orderkey % 5 END AS mtime,
CASE WHEN o_orderkey % 8 = 0 THEN 'converted_folder' ELSE 'watcher' END AS kind, concat('out', CAST(o_orderkey % 300 AS STRING), '.zip') AS output_filename FROM orders"""

VERIFICATIONS = """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS book, concat('g', CAST(l_orderkey % 2 AS STRING)) AS generation, concat('R', CAST(l_partkey % 400 AS STRING)) AS route_id, CASE WHEN l_partkey % 2 = 0 THEN 'text_lane' ELSE 'picture_lane' END AS target,
CASE WHEN l_orderkey % 5 = 0 THEN 'FULL_TECHNICAL_VISUAL' WHEN l_orderkey % 5 = 1 THEN NULL ELSE concat('C', CAST(l_orderkey % 3 AS STRING)) END AS code, CASE WHEN l_linenumber = 1 THEN 'high' WHEN l_linenumber = 2 THEN 'medium' WHEN l_linenumber = 3 THEN 'low' END AS priority, CAST(l_quantity AS INT) AS priority_score,
concat('{"index": ', CASE WHEN l_partkey % 9 = 0 THEN '"x"' ELSE CAST(l_partkey % 40 AS STRING) END, '}') AS source_json,
CASE WHEN l_suppkey % 4 = 0 AND (l_orderkey % 5 > 0 OR l_suppkey % 8 = 0) THEN 'completed' WHEN l_orderkey % 6 = 0 THEN 'processing' WHEN l_orderkey % 6 = 1 THEN 'failed' WHEN l_orderkey % 6 < 4 THEN 'pending' ELSE 'completed' END AS status,
CAST(l_linenumber % 2 AS INT) AS authorized, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber % 2 = 0 THEN 'awaiting_normal' WHEN l_linenumber % 3 = 0 THEN 'manual' END AS run_mode, CASE WHEN l_orderkey % 8 = 0 THEN 0 ELSE 1 END AS is_current, CASE WHEN l_partkey % 3 = 0 THEN 'text_lane' WHEN l_partkey % 3 = 1 THEN 'picture_lane' END AS claimed_by,
CAST(l_linenumber AS INT) AS attempt_count, CAST(l_linenumber % 4 AS INT) AS retry_count, CASE WHEN l_linenumber % 2 = 1 THEN l_orderkey END AS next_attempt_at, CASE WHEN l_linenumber > 2 THEN l_orderkey + 1 END AS started_at, CASE WHEN l_linenumber > 3 THEN l_orderkey + 2 END AS completed_at, CAST(l_linenumber AS DOUBLE) AS seconds,
CASE WHEN l_linenumber = 1 THEN 'ConnectError' WHEN l_linenumber = 2 THEN 'NetworkError' WHEN l_linenumber = 3 THEN 'ValueError' END AS error_type, CASE WHEN l_linenumber < 4 THEN 'it broke' END AS error_message FROM lineitem"""


def view(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """The rows of this SQL over the test tables."""
    found = {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)}
    named = re.sub(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in found})


LEDGER = """SELECT o_orderkey AS entry_id, o_custkey % 50 AS book, CASE WHEN o_orderkey % 3 = 0 THEN 'text_correction' ELSE 'vision_enrichment' END AS entry_type, CASE WHEN o_orderkey % 6 = 0 THEN 'table_cell' ELSE 'text' END AS source_type,
CASE WHEN o_orderkey % 19 > 0 THEN o_orderkey % 23 END AS source_index, o_orderkey % 5 AS table_index, CASE WHEN o_orderkey % 12 > 0 THEN o_orderkey % 4 END AS cell_index, concat('g', CAST(o_orderkey % 2 AS STRING)) AS generation,
CASE WHEN o_custkey % 7 < 2 THEN 'applied' WHEN o_custkey % 7 = 2 THEN 'pending' WHEN o_custkey % 7 = 3 THEN 'proposed' WHEN o_custkey % 7 = 4 THEN 'excluded' WHEN o_custkey % 7 = 5 THEN 'superseded' ELSE 'rejected' END AS status,
CASE WHEN o_custkey % 7 = 5 AND o_orderkey % 4 = 1 THEN 'SUPERSEDED_BY_NORMAL_PICTURE_ROUTE' ELSE 'WHY' END AS status_reason, CASE WHEN o_orderkey % 4 = 2 THEN 'applied' END AS previous_status, CASE WHEN o_orderkey % 8 = 2 THEN 'BEFORE' END AS previous_status_reason,
CASE WHEN o_orderkey % 5 = 0 THEN 'TECHNICAL_USEFUL' WHEN o_orderkey % 5 = 1 THEN 'DECORATIVE_OR_LOW_VALUE' WHEN o_orderkey % 5 = 2 THEN 'UNCERTAIN' WHEN o_orderkey % 5 = 3 THEN 'LIKELY_CORRUPT' END AS verdict, o_orderkey % 10 < 3 AS diagram_like,
o_orderkey % 13 = 0 AS human_verified, CASE WHEN o_orderkey % 26 = 0 THEN 'technical' WHEN o_orderkey % 39 = 0 THEN 'decorative' END AS human_decision, CASE WHEN o_orderkey % 26 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS decided_at, CASE WHEN o_orderkey % 39 = 0 THEN CAST(o_orderkey AS DOUBLE) / 2 END AS saved_at, CAST(o_orderkey % 1000 AS DOUBLE) AS created_at,
o_orderkey % 3 = 1 AS unresolved, CASE WHEN o_orderkey % 4 = 0 THEN concat('AV', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')) ELSE concat('R', CAST(o_orderkey % 90 AS STRING)) END AS route_id, CASE WHEN o_orderkey % 11 = 0 THEN 'FULL_TECHNICAL_VISUAL' END AS route_code,
CASE WHEN o_orderkey % 9 < 3 THEN '' WHEN o_orderkey % 9 < 6 THEN 'Pump  P1|pump p1| Valve' ELSE 'Gauge' END AS visible_text, CASE WHEN o_orderkey % 8 < 5 THEN '' ELSE 'pipe|PIPE|flange' END AS visible_objects, CASE WHEN o_orderkey % 10 < 6 THEN ' ' ELSE ' A  view of pump ' END AS summary, CASE WHEN o_orderkey % 4 = 0 THEN 'Wiring Diagram' WHEN o_orderkey % 4 = 1 THEN 'unknown' END AS category,
concat('text ', CAST(o_orderkey % 77 AS STRING)) AS original_text, CASE WHEN o_orderkey % 2 = 0 THEN concat('new ', CAST(o_orderkey % 77 AS STRING)) END AS proposed_text FROM orders"""


#: Shapes of chunks, filled with a part's number, its count and how it was returned: tables whole and torn, without a header, with odd rules, flattened, and prose.
_RAW = {
    0: "| Item {flag} | Size {part} range |\n| --- | --- |",
    1: "| bolt {part} | {count} | 4 |\n| nut {flag} brass | 5 | {part} |",
    2: "| Name {flag} | Torque value |\n|---|:---:|\n| bearing {part} | {count} |\nloose line {flag}",
    3: "{count} | {part} | 14\n15 | {count} | {part}",
    4: "Plain prose about pump {part} and valve {flag}.\n\n  It has   {count} lines.",
    5: "Item Qty Article no Description {count} {part} 3 bolt",
    6: "",
    7: "-----|----\n| seal kit {part} | {count} |",
}
_FILLED = {k: "concat('" + v.replace("{part}", "', part, '").replace("{count}", "', n, '").replace("{flag}", "', flag, '") + "')" for k, v in _RAW.items()}
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in _FILLED.items())
CHUNKS = f"""SELECT book, chunk_index, concat(CAST(book AS STRING), '-', CAST(chunk_index AS STRING)) AS chunk_id, CAST(floor((chunk_index + 1) / 3) AS INT) AS page, CASE WHEN k < 8 THEN concat('#/tables/', CAST(floor(chunk_index / 5) AS INT)) END AS table_ref, CASE k % 8 {_CASES} END AS raw_text, CAST(n_tokens AS INT) AS n_tokens,
concat('Part ', CAST(floor(chunk_index / 4) AS INT)) AS heading FROM (SELECT l_orderkey AS book, l_partkey % 10 AS k, CAST(l_partkey AS STRING) AS part, CAST(CAST(l_quantity AS INT) AS STRING) AS n, concat(l_returnflag, l_linestatus) AS flag, l_quantity * 12 AS n_tokens, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS chunk_index FROM lineitem) x"""

#: Sentences that refer to other places, filled with a machine's number, a section and a word of an order.
_SAID = [
    'See instruction "High pressure pump {n}" in section {s}.1 first.',
    "Refer to section {s}.{n}, '{word} gear' and see section {s}.",
    "see the Cooling water system {n} in chapter A-{s}; then stop.",
    "No reference {n} here.",
    "See “Fuel {word}”. Refer to clause {s}.2 and see section {s}.2.1 too",
    'SEE INSTRUCTION UNDER SECTION {s} "Governor  drive {n}".',
    'see "instruction" and see "Filters {n}", see "filters {n}"',
]
_SPOKEN = " ".join(f"WHEN {k} THEN concat('" + v.replace("'", "''").replace("{n}", "', n, '").replace("{s}", "', s, '").replace("{word}", "', word, '") + "')" for k, v in enumerate(_SAID))
SAYINGS = f"SELECT o_orderkey, CASE o_orderkey % 8 {_SPOKEN} END AS said FROM (SELECT o_orderkey, CAST(o_custkey AS STRING) AS n, CAST(o_custkey % 19 + 1 AS STRING) AS s, CASE WHEN o_orderstatus = 'F' THEN 'Valve' WHEN o_orderstatus = 'O' THEN 'Piston' ELSE 'Rotor' END AS word FROM orders) x"

ROWS = """SELECT book, chunk_index, CAST(floor(chunk_index / 4) AS INT) AS page, CASE WHEN k % 25 = 0 THEN 'High Pressure Pumps' WHEN k % 25 = 1 THEN 'The high pressure pumps of type 2' WHEN k % 25 = 2 THEN 'Section 6.1' ELSE concat('Part ', CAST(k % 9 AS STRING)) END AS heading,
CASE WHEN k % 7 = 0 THEN 'see high pressure pumps in 6.1' WHEN k % 7 = 1 THEN 'pumps for oil' WHEN k % 7 = 2 THEN 'section 6.12 of this' ELSE 'other text' END AS text, CASE WHEN k % 2 = 0 THEN 'prose' ELSE 'table' END AS content_type, CAST(60 + k % 40 AS INT) AS quality FROM
(SELECT l_suppkey AS book, l_partkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS chunk_index FROM lineitem) x"""
