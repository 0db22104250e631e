"""Rest periods and circuit breakers from a log of calls: one rule, in batch and in Structured Streaming.

The breaker is a matter of windows. The workload rule is a true state machine for each device, a fold over its calls in order; a device's calls are
one after another by nature, and pass through in batches with a state of five numbers, so nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Seconds and tokens a second at which a device has to rest."""

    long_call: float = 600
    severe_speed: float = 2
    recovered_speed: float = 8
    slow_speed: float = 7
    slow_calls: int = 2
    budget: float = 5_400
    idle: float = 1_200
    rest: int = 1_200
    long_rest: int = 1_800


FRESH = (0.0, 0, 0.0, -1.0, False)
OUT = "device string, event_id long, at double, busy double, slow int, reason string, until double"


def step(state: tuple, at: float, seconds: float, speed: float | None, rules: Rules) -> tuple[tuple, str | None]:
    """state (busy seconds, slow calls in a row, rest until, end of the last call or -1, on probation) and a call -> the next state and why a rest begins, if one does.

    A rest that is over clears the budget; so does an idle gap. While resting no rest gets shorter.
    """
    busy, slow, until, last, probation = state
    if (0 < until <= at) or (until <= at and last >= 0 and at - last >= rules.idle):
        busy, slow, until = 0.0, 0, 0.0 if until <= at else until
    busy += seconds
    known, reason, rest = speed is not None, None, rules.long_rest
    if seconds >= rules.long_call:
        reason = "long_call"
    elif known and speed < rules.severe_speed:
        reason = "severe_slowdown"
    elif known and probation and speed < rules.recovered_speed:
        reason = "not_recovered"
    else:
        probation = probation and not known
        slow = slow + 1 if known and speed < rules.slow_speed else 0
        rest = rules.rest
        if slow >= rules.slow_calls:
            reason = "repeated_slowdown"
        elif busy >= rules.budget:
            reason = "budget_reached"
    if reason:
        slow, until, probation = 0, max(until, at + rest), True
    return (busy, slow, until, at, probation), reason


def _fold(state: tuple, calls: pd.DataFrame, rules: Rules) -> tuple[tuple, list]:
    out = []
    for k, event_id, at, seconds, speed in zip(calls.device, calls.event_id, calls["at"], calls.seconds, calls.speed, strict=True):
        state, why = step(state, at, 0.0 if pd.isna(seconds) else seconds, None if pd.isna(speed) else speed, rules)
        out.append((k, event_id, at, state[0], state[1], why, state[2]))
    return state, out


_NAMES = [c.split()[0] for c in OUT.split(", ")]


def workload(calls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """calls (device, event_id, at in seconds, seconds, speed) -> each call with the state after it. Batch: one shuffle by device, sorted; equal times by event_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, state = None, FRESH
        for b in batches:
            rows = []
            for name, part in b.groupby("device", sort=False, dropna=False):
                if name != device and not (pd.isna(name) and device is None):
                    device, state = name, FRESH
                state, got = _fold(state, part, rules)
                rows += got
            yield pd.DataFrame(rows, columns=_NAMES)

    c = calls.select(F.col("device").cast("string").alias("device"), F.col("event_id").cast("long").alias("event_id"), F.col("at").cast("double").alias("at"), F.col("seconds").cast("double").alias("seconds"), F.col("speed").cast("double").alias("speed"))
    # A null device is a device of its own, under the empty name.
    return c.fillna("", ["device"]).repartition("device").sortWithinPartitions("device", "at", "event_id").mapInPandas(run, OUT)


def workload_stream(calls: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The same on a stream: a device's calls of one trigger are put in order; those of a later trigger come after them, whatever their time."""

    def run(key, batches, held):
        state = tuple(held.get) if held.exists else FRESH
        calls = pd.concat([*batches]).sort_values(["at", "event_id"])
        state, rows = _fold(state, calls, rules)
        held.update((float(state[0]), int(state[1]), float(state[2]), float(state[3]), bool(state[4])))
        yield pd.DataFrame(rows, columns=_NAMES)

    shape = "busy double, slow int, until double, last double, probation boolean"
    return calls.fillna("", ["device"]).groupBy("device").applyInPandasWithState(run, OUT, shape, "append", "NoTimeout")


def breaker(calls: DataFrame, by: str, order: list[str], failed: str, base: int = 30, most: int = 300) -> DataFrame:
    """Adds failures (in a row, up to this call) and delay: seconds to the next probe, doubled with each failure; 0 where the call succeeded."""
    so_far = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.coalesce(F.col(failed), F.lit(False))
    c = calls.withColumn("__ok", F.count_if(~bad).over(so_far))
    run = Window.partitionBy(by, "__ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count_if(bad).over(run)
    delay = F.least(F.lit(most), base * F.pow(F.lit(2), F.least(n - 1, F.lit(6)))).cast("long")
    return c.withColumn("failures", F.when(bad, n).otherwise(0)).withColumn("delay", F.when(bad, delay).otherwise(0)).drop("__ok")
