"""Quota and breaker on a stream against a plain fold over the same events in order, with late, repeated and shuffled events."""

import datetime as dt
import os
import random
import tempfile

import pytest

from lodestone.streaming import guards

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SHAPE = "key string, id string, kind string, at timestamp, tokens long"
LIMITS = {"request_warn": 6, "request_stop": 8, "token_warn": 300, "token_stop": 400}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def streamed(spark, batches, guard, name):
    """The rows of a stream that gets these batches one by one."""
    folder = tempfile.mkdtemp(prefix="spark-guards-")
    for n, rows in enumerate(batches):
        made = spark.createDataFrame([(k, i, kind, BEGIN + dt.timedelta(seconds=s), t) for k, i, kind, s, t in rows], SHAPE)
        made.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in os.listdir(f"{folder}/in"):  # files are read in the order of their times
            if f.endswith(".parquet") and os.stat(f"{folder}/in/{f}").st_mtime > 2_000:
                os.utime(f"{folder}/in/{f}", (1_000 + n, 1_000 + n))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = guard(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.table(name).where("key <> 'end'").collect()), key=repr)


def in_order(events):
    return sorted(set(events), key=lambda e: (e[3], guards.ORDER[e[2]], e[1]))


def plain_quota(events):
    out = []
    for key in {e[0] for e in events}:
        flying, used = {}, []
        for _, i, kind, s, tokens in in_order([e for e in events if e[0] == key]):
            used = [u for u in used if u[0] + guards.DAY > s]
            n, t = len(used), sum(u[1] for u in used)
            if kind == "asked":
                r, rt = len(flying), sum(flying.values())
                paused = n + r + 1 > LIMITS["request_stop"] or t + rt + tokens > LIMITS["token_stop"]
                state = "paused" if paused else "warning" if n + r >= LIMITS["request_warn"] or t + rt >= LIMITS["token_warn"] else "ok"
                out.append((key, i, int(BEGIN.timestamp()) + s, tokens, n, t, r, rt, state))
                if not paused:
                    flying.setdefault(i, tokens)
            else:
                flying.pop(i, None)
                if kind == "ended":
                    used.append((s, tokens))
    return sorted(out, key=repr)


def plain_breaker(events, base=30, most=300):
    out = []
    for key in {e[0] for e in events}:
        failures, probe = 0, 0
        for _, i, kind, s, _ in in_order([e for e in events if e[0] == key]):
            at, verdict = int(BEGIN.timestamp()) + s, None
            if kind == "worked":
                failures, probe = 0, 0
            elif kind == "failed":
                failures += 1
                probe = at + min(most, base * 2 ** min(failures - 1, 6))
            elif not failures:
                verdict = "go"
            elif at < probe:
                verdict = "wait"
            else:
                verdict, probe = "probe", at + min(most, base * 2 ** min(failures - 1, 6))
            out.append((key, i, at, kind, verdict, failures, probe))
    return sorted(out, key=repr)


def shuffled(events, rng, late):
    """Batches that hold events up to ``late`` seconds out of order and some of them twice, and then what moves the watermark past all."""
    moved = sorted(events, key=lambda e: e[3] + rng.randrange(late))
    batches = [moved[k : k + 25] + rng.sample(moved[k : k + 25], 3) for k in range(0, len(moved), 25)]
    end = max(e[3] for e in events) + 10 * guards.DAY
    return [*batches, [("end", "x", "asked", end, 0)], [("end", "y", "asked", end + 1, 0)], [("end", "z", "asked", end + 2, 0)]]


def test_quota_stream_equals_a_fold(rocks):
    rng, events = random.Random(4), []
    for n in range(45):
        key, at = rng.choice("kkm"), rng.randrange(2 * guards.DAY)
        events.append((key, f"c{n}", "asked", at, rng.choice([10, 50, 90])))
        if rng.random() < 0.8:
            events.append((key, f"c{n}", rng.choice(["ended", "ended", "released"]), at + rng.randrange(1, 9_000), rng.choice([10, 40])))
    got = streamed(rocks, shuffled(events, rng, 3_000), lambda s: guards.quota_stream(s, LIMITS, "2 hours"), "quota_guard")
    assert got == plain_quota(events) and {x[-1] for x in got} == {"ok", "warning", "paused"}


def test_breaker_stream_lets_one_probe_through(rocks):
    rng = random.Random(6)
    by_hand = [("h", "1", "asked", 0, 0), ("h", "2", "failed", 10, 0), ("h", "3", "asked", 20, 0), ("h", "4", "asked", 40, 0), ("h", "5", "asked", 41, 0), ("h", "6", "failed", 45, 0), ("h", "7", "asked", 100, 0), ("h", "8", "asked", 105, 0), ("h", "9", "worked", 106, 0), ("h", "a", "asked", 107, 0)]
    events = by_hand + [(rng.choice("ef"), f"c{n}", rng.choice(["asked", "asked", "failed", "worked"]), rng.randrange(4_000), 0) for n in range(90)]
    got = streamed(rocks, shuffled(events, rng, 300), guards.breaker_stream, "breaker_guard")
    assert got == plain_breaker(events)
    assert [x[4] for x in sorted(got, key=lambda x: x[2]) if x[0] == "h"] == ["go", None, "wait", "probe", "wait", None, "wait", "probe", None, "go"]
