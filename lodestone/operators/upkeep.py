"""Upkeep of what a pipeline leaves behind: stale files, identities, what to run next, cached calls, findings, labels and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(files: DataFrame) -> DataFrame:
    """Items, files and bytes of each category, and of all."""
    return files.rollup("category").agg(F.count("*").alias("items"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def job_of(path: Column) -> Column:
    """The job that a folder name ends its main part with."""
    return F.nullif(F.regexp_extract(path, r"__job(\d+)(?:__|$)", 1), F.lit("")).cast("long")


def stale(files: DataFrame, machines: DataFrame) -> DataFrame:
    """Files that nothing needs: errors of jobs that have a book since, and indexes of machines (job) that are no more."""
    f = files.withColumn("job", job_of(F.col("path")))
    done = f.where("category = 'books'").select("job").distinct()
    errors = f.where("category = 'errors'").join(done, "job", "left_semi").withColumn("reason", F.lit("ERROR_OF_A_FINISHED_JOB"))
    orphans = f.where("category = 'index' AND job IS NOT NULL").join(machines, "job", "left_anti").withColumn("reason", F.lit("INDEX_WITHOUT_A_MACHINE"))
    return errors.unionByName(orphans)


def preview(files: DataFrame, by: str) -> DataFrame:
    """A token of exactly the files that were shown, whatever their order: a clean-up goes ahead only if it still holds."""
    from lodestone.operators.ledger import sorted_signature

    return sorted_signature(files, by, ["path", "files", "bytes"]).withColumnRenamed("signature", "token")


def identity(stored: Column, named: Column) -> Column:
    return F.when(stored.isNull(), "missing").when(named.isNull(), "unknown").when(stored == named, "consistent").otherwise("mismatch")


def next_step(upstream: Column, stale_reason: Column) -> Column:
    """What a book waits for: the stage before it, else why its own isn't current."""
    return F.coalesce(upstream, stale_reason, F.lit("current"))


def call_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def uncached(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """The calls whose result isn't there yet."""
    return calls.join(cache.select("key"), "key", "left_anti")


def label(status: Column, known: dict[str, str]) -> Column:
    """A status as people read it: a known label, else its words with capitals."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[status], F.initcap(F.replace(status, F.lit("_"), F.lit(" "))), F.lit("Unknown"))


def event_data(frame: Column) -> Column:
    """The data lines of a frame of an event stream, joined; null for comments."""
    found = F.regexp_extract_all(frame, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1))
    return F.when(F.size(found) > 0, F.array_join(found, "\n"))


def download_name(url: Column, disposition: Column) -> Column:
    """A file's name from what a server says, else from the path of its address, without folders, 220 characters at most."""
    said = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"filename\*?=(?:UTF-8'')?\"?([^\";]+)", 1)
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^?#]*)", 1)
    base = lambda t: F.regexp_extract(F.regexp_replace(F.try_url_decode(t), r"\\", "/"), r"([^/]*)$", 1)
    dotted = F.when(base(path).contains("."), base(path))
    return F.substring(F.coalesce(F.nullif(base(said), F.lit("")), F.nullif(dotted, F.lit("")), F.lit("document")), 1, 220)


def signals(rows: DataFrame, by: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """by, code, severity, n of the checks (code: severity, test) that hold for some row."""
    counts = rows.groupBy(by).agg(*[F.count_if(test).alias(code) for code, (_, test) in checks.items()])
    listed = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("n")) for code, (severity, _) in checks.items()])
    return counts.select(by, F.explode(listed).alias("s")).select(by, "s.*").where("n > 0")


def page_text(rows: DataFrame, by: list[str], place: str, text: str, joint: str = "\n", most: int = 5_000) -> DataFrame:
    """The texts of each group in order as one, cut to ``most`` characters: what a prompt shows of a page. Texts that begin beyond the cut are dropped before any are gathered."""
    so_far = Window.partitionBy(*by).orderBy(place, text).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text) + len(joint)).over(so_far), F.lit(0))
    seen = rows.withColumn("begins", before).where(F.col("begins") < most)
    kept = F.array_sort(F.collect_list(F.struct(place, text)))
    return seen.groupBy(*by).agg(F.substring(F.array_join(F.transform(kept, lambda r: r[text]), joint), 1, most).alias("text"))
