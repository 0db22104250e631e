"""URL filters whose lists change over time: each capture is judged by the entries that were active when it was fetched.

A dated entry adds a pattern to a list or removes it. Ordered by date, an addition holds until the next
entry for the same list and pattern: a validity interval [since, until). A capture has few candidate patterns: its host and the
host's parent domains (kind ``domain``), and its URL's path prefixes (kind ``prefix``). The as-of join is an equality join on (kind, pattern)
with the fetch time inside the interval. The capture is blocked if a block entry was active, unless an allow entry of
the same or a longer pattern was active as well.

A verdict depends on the URL and the day of the fetch alone, so each distinct pair is judged once and joined back to its captures, which keep their rows
whatever their ids. The interval table is broadcast only by Spark's own size check, and AQE splits what a hot URL or host makes
uneven. Path prefixes and parent domains tried for a URL follow its own length; domains of fewer labels than any list entry has aren't tried.

Defined results: a null or unparsable URL or a null fetch time matches nothing and is kept; of entries of equal date for one list and pattern a
removal counts last; a repeated addition only renews; entries with a null pattern or date are ignored; captures repeated in the table
are judged each; an empty list blocks nothing. Columns of captures pass through; a column named blocked, list_name, pattern or since is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.site_style import host
from lodestone.llm.curriculum import unused
from lodestone.session import written


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list_name, action block|allow, op add|remove, kind domain|prefix, pattern, day date) -> (list_name, action, kind, pattern, since, until)."""
    good = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND op IN ('add', 'remove')").select("list_name", "action", "op", "kind", F.lower("pattern").alias("pattern"), "day")
    day = good.groupBy("list_name", "action", "kind", "pattern", "day").agg(F.max("op").alias("op"))  # 'remove' over 'add'
    w = Window.partitionBy("list_name", "action", "kind", "pattern").orderBy("day")
    day = day.withColumn("before", F.lag("op").over(w)).where("before IS NULL AND op = 'add' OR op <> before")
    day = day.withColumn("until", F.lead("day").over(w)).where("op = 'add'")
    return day.select("list_name", "action", "kind", "pattern", F.col("day").alias("since"), "until")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns(url: Column) -> Column:
    """array<struct<kind, pattern>>: the host with each of its parent domains, and host + path up to each slash and in full."""
    h, path = host(url), F.lower(_path(url))
    labels, parts = F.split(h, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(h, F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")).alias("pattern")))
    return F.when(h != "", F.array_distinct(F.concat(domains, dirs)))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """Adds blocked, list_name, pattern, since: the deciding entry, longest pattern first, allow over block, then list and date."""
    if taken := {"blocked", "list_name", "pattern", "since"} & {c.lower() for c in captures.columns}:
        raise ValueError(f"the input has columns {sorted(taken)} already")
    spans = written(intervals(entries), "intervals")
    labels = spans.where("kind = 'domain'").agg(F.min(F.size(F.split("pattern", r"\."))).alias("n")).first()["n"] or 0
    link, date = unused(captures, "asked_url"), unused(captures, "asked_day")
    asked = captures.select(F.col(url_col).alias(link), F.to_date(time_col).alias(date)).where(F.col(link).isNotNull() & F.col(date).isNotNull()).distinct()
    tried = F.filter(patterns(F.col(link)), lambda p: (p["kind"] != "domain") | (F.size(F.split(p["pattern"], r"\.")) >= labels))
    keys = asked.select(link, date, F.explode(tried).alias("p")).select(link, date, "p.kind", "p.pattern")
    active = keys.join(spans, ["kind", "pattern"]).where((F.col("since") <= F.col(date)) & (F.col("until").isNull() | (F.col(date) < F.col("until"))))
    rank = F.struct(F.length("pattern").alias("size"), (F.col("action") == "allow").alias("allow"), F.col("list_name"), F.col("since"), F.col("pattern"))
    best = active.groupBy(link, date).agg(F.max(rank).alias("best"))
    named = best.select(link, date, (~F.col("best.allow")).alias("blocked"), F.col("best.list_name").alias("list_name"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since"))
    out = captures.join(named, (captures[url_col] == named[link]) & (F.to_date(captures[time_col]) == named[date]), "left").drop(link, date)
    return out.withColumn("blocked", F.coalesce("blocked", F.lit(False)))
