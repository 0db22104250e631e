"""Transitions of job tables as pure functions: a table goes in, the table after the change comes out.

A transition is a condition and the values that the rows it holds for take on, all read from the row before the change. Nothing is updated in place: a
caller writes the result as the next version of the table. A null condition changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The code of rows that sweep all pictures of a book, and the errors of an endpoint that was down. How a remote service says that it failed itself is its own.
SWEEP = "FULL_TECHNICAL_VISUAL"
OUTAGES = ["ConnectError", "ConnectTimeout", "ConnectionError", "NetworkError"]
REMOTE_FAILURE = "The remote service reported a task failure"
LONGEST_MESSAGE = 2_000


def transition(df: DataFrame, when: Column, **new) -> DataFrame:
    """The table with these columns changed where the condition holds."""
    hit = F.coalesce(when, F.lit(False))
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({c: F.when(hit, value(v)).otherwise(F.col(c)) for c, v in new.items()})


def is_sweep() -> Column:
    return F.coalesce(F.col("code"), F.lit("")) == SWEEP


def message(text: Column) -> Column:
    return F.substring(text, 1, LONGEST_MESSAGE)


def recover_conversions(jobs: DataFrame) -> DataFrame:
    """Rows in work without a remote task can't be resumed, so they wait again; those with one are polled on."""
    return transition(jobs, (F.col("status") == "processing") & (F.coalesce("task_id", F.lit("")) == ""), status="pending", error_type=None, error_message=None)


def recover_verifications(jobs: DataFrame) -> DataFrame:
    return transition(jobs, F.col("status") == "processing", status="pending", started_at=None, next_attempt_at=None, error_type="Interrupted", error_message="Recovered after restart")


def requeue_outages(jobs: DataFrame, applied: bool) -> DataFrame:
    """Current rows that failed only because an endpoint was down wait again; a migration that has been applied changes nothing."""
    hit = (F.col("status") == "failed") & (F.col("is_current") == 1) & F.col("error_type").isin(OUTAGES) & F.lit(not applied)
    return transition(jobs, hit, status="pending", authorized=1, run_mode="outage_recovery", started_at=None, completed_at=None, retry_count=0, next_attempt_at=None, error_type=None, error_message=None)


def apply_events(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """events (id, event, happened_at, took, delay, detail, text): one for each job at most. 'start' takes a pending row, 'complete', 'fail', 'defer' and 'retry' a row in work; others change nothing.

    A deferral doesn't use up a retry. ``delay`` seconds later the row may run again.
    """
    j = jobs.join(events.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left")
    runs = F.col("status") == "processing"
    on = lambda name, guard: (F.col("event") == name) & guard
    start, done, fail = on("start", F.col("status") == "pending"), on("complete", runs), on("fail", runs)
    defer, again = on("defer", runs), on("retry", runs)
    none = F.lit(None)
    changed = F.coalesce(start | done | fail | defer | again, F.lit(False))
    status = F.when(start, "processing").when(done, "completed").when(fail, "failed").when(defer | again, "pending").otherwise(F.col("status"))
    trouble = fail | defer | again
    out = j.withColumns({
        "status": status,
        "started_at": F.when(start, F.col("happened_at")).when(defer | again, none).otherwise(F.col("started_at")),
        "completed_at": F.when(done | fail, F.col("happened_at")).when(start, none).otherwise(F.col("completed_at")),
        "seconds": F.when(done, F.col("took")).otherwise(F.col("seconds")),
        "attempt_count": F.col("attempt_count") + F.when(start, 1).otherwise(0),
        "retry_count": F.when(done, 0).otherwise(F.col("retry_count") + F.when(again, 1).otherwise(0)),
        "next_attempt_at": F.when(defer, F.col("happened_at") + F.greatest(F.lit(1), F.col("delay"))).when(again, F.col("happened_at") + F.greatest(F.lit(0), F.col("delay"))).when(changed, none).otherwise(F.col("next_attempt_at")),
        "authorized": F.when(done | fail, 0).otherwise(F.col("authorized")),
        "error_type": F.when(trouble, F.col("detail")).when(changed, none).otherwise(F.col("error_type")),
        "error_message": F.when(trouble, message(F.col("text"))).when(changed, none).otherwise(F.col("error_message")),
    })
    return out.select(*jobs.columns)


def retry_conversions(jobs: DataFrame, now: Column) -> DataFrame:
    """A failed row is polled on if a remote service took it and didn't fail itself; otherwise it is submitted anew."""
    failed = F.col("status") == "failed"
    resumed = (F.coalesce("task_id", F.lit("")) != "") & ~F.coalesce(F.startswith("error_message", F.lit(REMOTE_FAILURE)), F.lit(False))
    return transition(jobs, failed, status=F.when(resumed, "processing").otherwise("pending"), task_id=F.when(resumed, F.col("task_id")), submitted_at=now, completed_at=None, seconds=None, retry_count=F.col("retry_count") + 1, error_type=None, error_message=None)


def rerun(jobs: DataFrame, states: list[str], **cleared) -> DataFrame:
    """Rows that have come to an end run once more, without what the last run left."""
    return transition(jobs, F.col("status").isin(states), status="pending", started_at=None, completed_at=None, seconds=None, error_type=None, error_message=None, **cleared)


def reserve_deletion(jobs: DataFrame, managed: DataFrame, key: str) -> DataFrame:
    """Ended rows that no book manages become 'deleting'; ``was`` keeps the status to return to."""
    j = jobs.join(managed.select(F.col(key).alias("id"), F.lit(True).alias("__managed")).distinct(), "id", "left").withColumn("was", F.col("status"))
    return transition(j, F.col("status").isin("failed", "completed") & F.col("__managed").isNull(), status="deleting").drop("__managed")


def cancel_deletion(jobs: DataFrame) -> DataFrame:
    return transition(jobs, F.col("status") == "deleting", status=F.col("was"))


def delete(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status") != "deleting")


def tracked(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds tracked: whether a job has the file, known by name and hash, or, without a hash, by name, size and time, or by name alone."""
    keys = {"sha": ["filename", "sha256"], "stat": ["filename", "size", "mtime"], "name": ["filename"]}
    by = F.when(F.coalesce("sha256", F.lit("")) != "", "sha").when(F.col("size").isNotNull() & F.col("mtime").isNotNull(), "stat").otherwise("name")
    f = files.withColumn("__by", by)
    for name, cols in keys.items():
        seen = jobs.select(*cols).distinct().withColumn(f"__{name}", F.lit(True))
        f = f.join(seen, cols, "left")
    hit = F.when(F.col("__by") == "sha", F.col("__sha")).when(F.col("__by") == "stat", F.col("__stat")).otherwise(F.col("__name"))
    return f.withColumn("tracked", F.coalesce(hit, F.lit(False))).select(*files.columns, "tracked")


def backfill_identity(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """The newest row of a file name without any identity takes that of the file of this name."""
    bare = F.col("size").isNull() & F.col("mtime").isNull() & F.col("sha256").isNull()
    newest = jobs.where(bare).groupBy("filename").agg(F.max("id").alias("__newest"))
    new = files.select("filename", *[F.col(c).alias(f"__{c}") for c in ("size", "mtime", "sha256")]).join(newest, "filename")
    j = jobs.join(new.drop("filename"), F.col("id") == F.col("__newest"), "left")
    return transition(j, F.col("__newest").isNotNull(), size=F.col("__size"), mtime=F.col("__mtime"), sha256=F.col("__sha256")).select(*jobs.columns)


def register_outputs(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Converted files that no job has put out and none was imported from by name, size and time."""
    made = jobs.where(F.col("kind") != "converted_folder").select(F.col("output_filename").alias("filename"))
    imported = jobs.where(F.col("kind") == "converted_folder").select("filename", "size", "mtime")
    return outputs.join(made, "filename", "left_anti").join(imported, ["filename", "size", "mtime"], "left_anti")


def start_batch(jobs: DataFrame, target: str | None = None, books: list[int] | None = None) -> DataFrame:
    """Waiting current rows may run by hand, of a target, of books, or of both; sweeps of the same books are armed, and wait until the other rows are done."""
    scope = F.lit(True)
    scope = scope & (F.col("target") == target) if target else scope
    scope = scope & F.col("book").isin(books) if books else scope
    waits = (F.col("is_current") == 1) & (F.col("status") == "pending")
    mine = jobs.where(waits & ~is_sweep() & scope).select("book").distinct().withColumn("__mine", F.lit(True))
    j = jobs.join(mine, "book", "left")
    j = transition(j, waits & ~is_sweep() & scope, authorized=1, run_mode="manual", next_attempt_at=None)
    return transition(j, waits & is_sweep() & F.col("__mine"), authorized=0, run_mode="awaiting_normal", next_attempt_at=None).select(*jobs.columns)


def arm_sweeps(jobs: DataFrame, target: str) -> DataFrame:
    return transition(jobs, (F.col("target") == target) & is_sweep() & (F.col("is_current") == 1) & (F.col("status") == "pending"), authorized=0, run_mode="awaiting_normal", next_attempt_at=None)


def clear_authorizations(jobs: DataFrame, target: str) -> DataFrame:
    return transition(jobs, (F.col("target") == target) & (F.col("is_current") == 1) & (F.col("status") == "pending") & (F.col("authorized") == 1), authorized=0, run_mode=None)


def release_sweeps(jobs: DataFrame) -> DataFrame:
    """Armed sweeps of books whose other current rows are all completed may run."""
    blocked = jobs.where((F.col("is_current") == 1) & ~is_sweep() & (F.col("status") != "completed")).select("book").distinct().withColumn("__blocked", F.lit(True))
    armed = is_sweep() & (F.col("is_current") == 1) & (F.col("status") == "pending") & (F.col("authorized") == 0) & (F.col("run_mode") == "awaiting_normal")
    j = jobs.join(blocked, "book", "left")
    return transition(j, armed & F.col("__blocked").isNull(), authorized=1, run_mode="artifact_ready", next_attempt_at=None).select(*jobs.columns)


def retry_failed(jobs: DataFrame, sweeps: bool) -> DataFrame:
    """Failed current rows wait again: all of them by hand, or the sweeps alone, armed."""
    hit = (F.col("status") == "failed") & (F.col("is_current") == 1)
    hit = hit & is_sweep() if sweeps else hit
    return transition(jobs, hit, status="pending", authorized=0 if sweeps else 1, run_mode="awaiting_normal" if sweeps else "manual", started_at=None, completed_at=None, retry_count=0, next_attempt_at=None, error_type=None, error_message=None)


def sync_routes(jobs: DataFrame, routes: DataFrame, targets: list[str]) -> DataFrame:
    """The jobs after the routes of a book's new generation have come in: rows of older generations stop being current, known routes take the new fields, new ones wait."""
    keys = ["book", "generation", "route_id", "target"]
    fields = ["code", "priority", "priority_score"]
    good = routes.where(F.col("target").isin(targets) & (F.coalesce("route_id", F.lit("")) != ""))
    last = good.groupBy(*keys).agg(F.max_by(F.struct(*fields), "came_at").alias("new"))
    now = good.select("book", F.col("generation").alias("__generation")).distinct()
    j = jobs.join(now, "book", "left").join(last, keys, "left")
    j = transition(j, F.col("__generation").isNotNull() & (F.col("__generation") != F.col("generation")), is_current=0)
    j = transition(j, F.col("new").isNotNull(), is_current=1, **{c: F.col(f"new.{c}") for c in fields})
    added = last.join(jobs.select(*keys), keys, "left_anti").select(*keys, *[F.col(f"new.{c}").alias(c) for c in fields], F.lit("pending").alias("status"), F.lit(1).alias("is_current"), F.lit(0).alias("authorized"), F.lit(0).alias("retry_count"))
    return j.select(*jobs.columns).unionByName(added, allowMissingColumns=True)


def suppress_sweeps(jobs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Sweeps of pictures (book, index) that have rows of their own stop being current. The picture is a number in the row's JSON source; others are left alone."""
    index = F.get_json_object("source_json", "$.index").try_cast("int")
    covered = pictures.select(F.col("book").alias("__book"), F.col("index").alias("__index")).distinct()
    j = jobs.withColumn("__at", index).join(covered, (F.col("book") == F.col("__book")) & (F.col("__at") == F.col("__index")), "left")
    return transition(j, is_sweep() & (F.col("is_current") == 1) & F.col("__index").isNotNull(), is_current=0, authorized=0).select(*jobs.columns)


def sweep_plan(pictures: DataFrame, jobs: DataFrame, technical: list[str]) -> DataFrame:
    """Pictures (book, index, class) of technical classes without a current row of their own."""
    own = jobs.where((F.col("is_current") == 1) & ~is_sweep()).select("book", F.get_json_object("source_json", "$.index").try_cast("int").alias("index"))
    return pictures.where(F.lower("class").isin(technical)).join(own, ["book", "index"], "left_anti")


def lane_counts(jobs: DataFrame, targets: list[str], states: list[str]) -> DataFrame:
    """Counts of current rows of each book by lane (who runs it; a sweep counts for who claimed it, waiting rows for their target), by kind of work and status."""
    lane = F.when(is_sweep(), F.coalesce("claimed_by", "target")).otherwise(F.col("target"))
    kinds = {"text": ~is_sweep() & (F.col("target") == targets[0]), "vision": ~is_sweep() & (F.col("target") == targets[1]), "artifact": is_sweep()}
    counts = [F.count_if(((F.col("target") if s == "pending" else lane) == t) & (F.col("status") == s)).alias(f"{t}_{s}") for t in targets for s in states]
    counts += [F.count_if(test & (F.col("status") == s)).alias(f"{k}_{s}") for k, test in kinds.items() for s in states]
    counts += [F.count_if(test).alias(f"{k}_total") for k, test in kinds.items()]
    return jobs.where("is_current = 1").groupBy("book").agg(*counts, F.count("*").alias("total"))


def target_counts(jobs: DataFrame, states: list[str], now: int) -> DataFrame:
    """Counts of current rows of each target by status, those that wait for a hand, and those that wait for their time."""
    waits = F.col("status") == "pending"
    counts = [F.count_if(F.col("status") == s).alias(s) for s in states]
    return jobs.where("is_current = 1").groupBy("target").agg(*counts, F.count("*").alias("total"), F.count_if(waits & (F.col("authorized") == 0)).alias("waiting_manual"), F.count_if(waits & (F.col("next_attempt_at") > now)).alias("backoff"))


def migrated(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds the columns (name: type, default) that the table lacks; those it has keep their values, and nulls where a default is set take it."""
    have = {c.lower() for c in df.columns}
    for name, (kind, default) in columns.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(name, (F.coalesce(F.col(name), value) if name.lower() in have else value) if default is not None or name.lower() not in have else F.col(name))
    return df


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Values of a key that should be unique and how often they occur."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def output_names(jobs: DataFrame) -> DataFrame:
    """Adds output_name: the file's stem, or with eight digits of its hash if an earlier job has the same file name."""
    earlier = F.row_number().over(Window.partitionBy("filename").orderBy("id")) > 1
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return jobs.withColumn("has_earlier", earlier).withColumn("output_name", F.concat(stem, F.when(earlier, F.concat(F.lit("__"), F.substring("sha256", 1, 8))).otherwise(""), F.lit(".zip")))


def free_names(files: DataFrame) -> DataFrame:
    """Adds stored_as: files of one name and content are stored once; other contents get the next free ' (n)' before the suffix, in the order they came."""
    first = Window.partitionBy("filename", "sha256").orderBy("at", "id")
    contents = files.withColumn("first_at", F.first("at").over(first)).withColumn("first_id", F.first("id").over(first))
    n = F.dense_rank().over(Window.partitionBy("filename").orderBy("first_at", "first_id")) - 1
    stem, suffix = F.regexp_replace("filename", r"\.[^.]*$", ""), F.regexp_extract("filename", r"\.[^.]*$", 0)
    return contents.withColumn("stored_as", F.when(n == 0, F.col("filename")).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), suffix))).drop("first_at", "first_id")


def formats_of(raw: Column, legacy: Column, known: dict[str, str]) -> Column:
    """The formats of a JSON list, or the one of an older row; each once, in order."""
    listed = F.filter(F.coalesce(F.from_json(raw, "array<string>"), F.expr("cast(array() AS array<string>)")), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.when(F.size(listed) > 0, listed).when(F.coalesce(legacy, F.lit("")) != "", F.array(legacy)).otherwise(F.array(F.lit("md"))))


def returned_formats(names: Column, by_suffix: dict[str, str]) -> Column:
    """The formats of an archive's members by their suffix; each once, in order."""
    table = F.create_map(*[F.lit(x) for pair in by_suffix.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(names, lambda n: table[F.lower(F.regexp_extract(n, r"\.[^./]+$", 0))])))


def retryable(status: Column, kind: Column) -> Column:
    """Whether a failed call may be tried again: server errors, time-outs, too many requests, and lost connections."""
    return F.coalesce((status >= 500) | status.isin(408, 429), F.lit(False)) | F.coalesce(kind.isin(OUTAGES), F.lit(False))


def finished(jobs: DataFrame) -> DataFrame:
    """Books all of whose current rows have come to an end without a failure; sweeps that nobody has armed don't count."""
    counted = ~(is_sweep() & (F.col("status") == "pending") & (F.coalesce("run_mode", F.lit("")) == ""))
    rows = jobs.where((F.col("is_current") == 1) & counted)
    return rows.groupBy("book").agg(F.count("*").alias("n"), F.every(F.col("status") == "completed").alias("done")).where("done").drop("done")
