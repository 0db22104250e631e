"""Is what a stage made still current? The first reason why not, as a column; null if it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stale_reason(stage: str, status: Column, recorded: Column, current: Column, recorded_rule: Column, rule: Column, has_outputs: Column, upstream_ready: Column | None = None) -> Column:
    """not_built (no status), the status itself unless completed, stale_input (signatures differ or none was recorded), stale_rules (only where a rule version is asked for), outputs_missing."""
    same = F.coalesce((recorded != "") & (recorded == current), F.lit(False))
    ruled = F.coalesce(rule == "", F.lit(True)) | F.coalesce(recorded_rule == rule, F.lit(False))
    chain = F.when(~F.coalesce(upstream_ready, F.lit(False)), f"{stage}_upstream_not_current") if upstream_ready is not None else F.when(F.lit(False), "")
    chain = chain.when(status.isNull(), f"{stage}_not_built").when(status != "completed", F.concat(F.lit(f"{stage}_"), F.coalesce(F.nullif(status, F.lit("")), F.lit("not_ready"))))
    return chain.when(~same, f"{stage}_stale_input").when(~ruled, f"{stage}_stale_rules").when(~F.coalesce(has_outputs, F.lit(False)), f"{stage}_outputs_missing")
