"""Guards of a service on a stream: a day's quota with reservations in flight, and a circuit breaker that lets one probe through.

Both wait for the watermark: an event is dealt with when nothing earlier can come any more, so the answers are those of a batch over the same events, in whatever
order they arrived. Events that come later than the watermark allows are dropped by Spark. State is kept by key in the state store, entry by entry, so a busy key
takes disk and not memory; timers bring back what is due. Both need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400

#: Kinds of events, in the order in which those of one moment count: what has ended frees quota before something new asks.
ORDER = {"ended": 0, "released": 1, "asked": 2, "failed": 0, "worked": 1}


class _InOrder(StatefulProcessor):
    """Keeps events by their second until the watermark has passed it, then hands them on in the order of time, kind and id; an event that is there already is dropped.

    Timers fire in the order of their times, so each looks up its own second and nothing is searched.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "events array<struct<rank:int,id:string,kind:string,tokens:bigint>>")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come: dict[int, dict] = {}
        for batch in rows:
            for at, kind, i, tokens in zip(batch["second"], batch["kind"], batch["id"], batch["tokens"], strict=True):
                come.setdefault(int(at), {}).setdefault((ORDER[kind], i, kind), int(tokens))
        for at, events in come.items():
            if self.waiting.containsKey((at,)):
                events |= {(e[0], e[1], e[2]): e[3] for e in map(tuple, self.waiting.getValue((at,))[0])}
            else:
                self.handle.registerTimer(at * 1000 + 999)
            self.waiting.updateValue((at,), ([(*k, tokens) for k, tokens in events.items()],))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        second, part = divmod(expiredTimerInfo.getExpiryTimeInMs(), 1000)
        rows = []
        if part == 0:
            self.expire(second)
        elif self.waiting.containsKey((second,)):
            events = sorted(map(tuple, self.waiting.getValue((second,))[0]))
            self.waiting.removeKey((second,))
            for _, i, kind, tokens in events:
                rows += self.deal(key, second, kind, i, tokens)
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def expire(self, second: int) -> None:
        """What ends with the beginning of a second."""

    def close(self) -> None:
        pass


QUOTA = "key string, id string, second long, tokens long, used_requests long, used_tokens long, reserved_requests long, reserved_tokens long, state string"


class Quota(_InOrder):
    """asked (an id and the tokens it may need), ended (the tokens it took), released (it never went out): what each asking finds, and whether it may go on.

    A refused asking reserves nothing. Use counts for a day after it ended. An end or release without a reservation only counts its use, or nothing.
    """

    columns = [c.split()[0] for c in QUOTA.split(", ")]

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "used_requests long, used_tokens long, reserved_requests long, reserved_tokens long")
        self.flying = handle.getMapState("flying", "id string", "tokens long")
        #: A queue: uses end in the order of time, and so do their days. ``ends`` has its first place and the one behind its last.
        self.used = handle.getMapState("used", "place long", "until long, tokens long")
        self.ends = handle.getValueState("ends", "first long, behind long")

    def totals(self) -> list[int]:
        return list(self.total.get()) if self.total.exists() else [0, 0, 0, 0]

    def expire(self, second: int) -> None:
        first, behind = tuple(self.ends.get()) if self.ends.exists() else (0, 0)
        totals, begin = self.totals(), first
        while first < behind:
            until, tokens = self.used.getValue((first,))
            if until > second:
                break
            self.used.removeKey((first,))
            totals[0] -= 1
            totals[1] -= tokens
            first += 1
        if first > begin:
            self.ends.update((first, behind))
            self.total.update(tuple(totals))

    def deal(self, key, at: int, kind: str, i: str, tokens: int) -> list[tuple]:
        self.expire(at)  # timers set in this trigger fire in the next
        totals, rows = self.totals(), []
        if kind == "asked":
            state = "ok"
            if totals[0] + totals[2] + 1 > self.limits["request_stop"] or totals[1] + totals[3] + tokens > self.limits["token_stop"]:
                state = "paused"
            elif totals[0] + totals[2] >= self.limits["request_warn"] or totals[1] + totals[3] >= self.limits["token_warn"]:
                state = "warning"
            rows.append((key[0], i, at, tokens, *totals, state))
            if state != "paused" and not self.flying.containsKey((i,)):
                self.flying.updateValue((i,), (tokens,))
                totals[2] += 1
                totals[3] += tokens
        else:
            if self.flying.containsKey((i,)):
                totals[2] -= 1
                totals[3] -= self.flying.getValue((i,))[0]
                self.flying.removeKey((i,))
            if kind == "ended":
                first, behind = tuple(self.ends.get()) if self.ends.exists() else (0, 0)
                self.used.updateValue((behind,), (at + DAY, tokens))
                self.ends.update((first, behind + 1))
                self.handle.registerTimer((at + DAY) * 1000)
                totals[0] += 1
                totals[1] += tokens
        self.total.update(tuple(totals))
        return rows


BREAKER = "key string, id string, second long, kind string, verdict string, failures long, next_probe long"


class Breaker(_InOrder):
    """failed and worked open and close the circuit of an endpoint; asked gets a verdict: go, wait, or probe.

    While the circuit is open nothing goes out before the next probe's time; then one asking is let through as the probe, and the others wait until it has worked or
    failed, or until as much time again has passed (a probe that never answers must not close the endpoint for ever).
    """

    columns = [c.split()[0] for c in BREAKER.split(", ")]

    def __init__(self, base: int = 30, most: int = 300):
        self.base, self.most = base, most

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.circuit = handle.getValueState("circuit", "failures long, next_probe long")

    def deal(self, key, at: int, kind: str, i: str, tokens: int) -> list[tuple]:
        failures, probe = tuple(self.circuit.get()) if self.circuit.exists() else (0, 0)
        delay = lambda n: min(self.most, self.base * 2 ** min(max(0, n - 1), 6))
        verdict = None
        if kind == "worked":
            failures, probe = 0, 0
        elif kind == "failed":
            failures += 1
            probe = at + delay(failures)
        elif not failures:
            verdict = "go"
        elif at < probe:
            verdict = "wait"
        else:
            verdict, probe = "probe", at + delay(failures)
        self.circuit.update((failures, probe))
        return [(key[0], i, at, kind, verdict, failures, probe)]


def _guarded(events: DataFrame, processor: StatefulProcessor, shape: str, late: str) -> DataFrame:
    """events (key, id, kind, at timestamp, tokens): those without a key, an id, a time or a known kind are left out."""
    from pyspark.sql import functions as F

    e = events.where(F.col("key").isNotNull() & F.col("id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*ORDER))
    e = e.select(F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("id"), "kind", "at", F.unix_timestamp("at").alias("second"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))
    return e.withWatermark("at", late).groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")


def quota_stream(events: DataFrame, limits: dict[str, int], late: str = "10 minutes") -> DataFrame:
    """What each asking finds: use of the last day, what is in flight, and ok, warning or paused."""
    return _guarded(events, Quota(limits), QUOTA, late)


def breaker_stream(events: DataFrame, base: int = 30, most: int = 300, late: str = "10 minutes") -> DataFrame:
    """Each event with the circuit after it; askings with their verdict."""
    return _guarded(events, Breaker(base, most), BREAKER, late)
