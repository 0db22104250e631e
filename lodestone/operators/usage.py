"""Quota of an external service: what counts in the last day, what is reserved, when calls pause and go on, and what a response changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def limits(requests: int = 1_000, tokens: int = 200_000, warn: float = 0.80, stop: float = 0.90) -> dict[str, int]:
    """Where a warning begins and where calls stop, for requests and tokens; fractions are kept within sense."""
    warn = min(max(warn, 0.01), 0.99)
    stop = min(max(stop, warn), 0.999)
    at = lambda n, part: max(1, int(max(1, n) * part))
    return {"request_limit": max(1, requests), "token_limit": max(1, tokens), "request_warn": at(requests, warn), "request_stop": at(requests, stop), "token_warn": at(tokens, warn), "token_stop": at(tokens, stop)}


def with_reservations(calls: DataFrame) -> DataFrame:
    """calls (key, at, ended, tokens) -> used_requests, used_tokens of calls that ended in the day before each call begins, and reserved_requests, reserved_tokens of those still in flight.

    Every call is a reservation when it begins and usage when it ends, so both are running sums over one stream of changes.
    """
    steps = calls.select("key", "id", F.explode(F.array(
        F.struct(F.col("at").alias("t"), F.lit(2).alias("order"), F.lit(1).alias("flight"), F.lit(0).alias("used")),
        F.struct(F.col("ended").alias("t"), F.lit(1).alias("order"), F.lit(-1).alias("flight"), F.lit(1).alias("used")),
        F.struct((F.col("ended") + DAY).alias("t"), F.lit(0).alias("order"), F.lit(0).alias("flight"), F.lit(-1).alias("used")),
    )).alias("s"), "tokens").select("key", "id", "s.*", "tokens")
    before = Window.partitionBy("key").orderBy("t", "order", "id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    s = steps.withColumns({"used_requests": total(F.col("used")), "used_tokens": total(F.col("used") * F.col("tokens")), "reserved_requests": total(F.col("flight")), "reserved_tokens": total(F.col("flight") * F.col("tokens"))})
    return s.where(F.col("order") == 2).select("key", "id", F.col("t").alias("at"), "tokens", "used_requests", "used_tokens", "reserved_requests", "reserved_tokens")


def gate(calls: DataFrame, quota: dict[str, int]) -> DataFrame:
    """Adds state (ok, warning, paused) and reasons for a next call of ``tokens`` tokens."""
    requests, tokens = F.col("used_requests") + F.col("reserved_requests"), F.col("used_tokens") + F.col("reserved_tokens")
    stop_r, stop_t = requests + 1 > quota["request_stop"], tokens + F.col("tokens") > quota["token_stop"]
    warn_r, warn_t = ~stop_r & (requests >= quota["request_warn"]), ~stop_t & (tokens >= quota["token_warn"])
    named = lambda pairs: F.array_compact(F.array(*[F.when(test, name) for name, test in pairs.items()]))
    reasons = named({"LOCAL_DAILY_REQUEST_RESERVE": stop_r, "LOCAL_DAILY_TOKEN_RESERVE": stop_t})
    warnings = named({"LOCAL_DAILY_REQUEST_WARNING": warn_r, "LOCAL_DAILY_TOKEN_WARNING": warn_t})
    return calls.withColumns({"reasons": reasons, "warnings": warnings, "state": F.when(F.size(reasons) > 0, "paused").when(F.size(warnings) > 0, "warning").otherwise("ok")})


def header_int(text: Column) -> Column:
    """A whole number from a header, whatever its form; null for anything else."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 1e18), value.cast("long"))


def after_response(at: Column, status: Column, retry_after: Column, reset_tokens: Column, reset_requests: Column, remaining: Column, limit: Column, stop: float = 0.90) -> Column:
    """struct<pause_until, resume_at>: a refused call pauses for what the service says (a minute if nothing); a reserve used up pauses until its reset. The earliest pause to end is when calls go on."""
    pause = F.when(status == 429, at + F.greatest(F.lit(1.0), F.coalesce(F.nullif(retry_after, F.lit(0.0)), F.nullif(reset_tokens, F.lit(0.0)), F.lit(60.0))))
    reserve = F.greatest(F.lit(1), limit - F.floor(limit * stop))
    low = F.when(remaining <= reserve, at + reset_requests)
    return F.struct(pause.alias("pause_until"), F.least(pause, low).alias("resume_at"))


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call in dollars by the price of a million tokens in and out; null for models without a price."""
    row = F.coalesce(*[F.when(model == m, (tokens_in * a + tokens_out * b) / 1_000_000.0) for m, (a, b) in prices.items()])
    return F.round(row, 8)


def newest(log: DataFrame, key: str, keep: int) -> DataFrame:
    """The newest rows of each key: at least a hundred, whatever is asked."""
    w = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id"))
    return log.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(100, keep)).drop("__n")
