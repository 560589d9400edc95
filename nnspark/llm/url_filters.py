"""URL filters by a temporal list join (operator 6), DataFrame functions only.

A list changes over time: each dated entry adds a host pattern (``block`` or ``allow``) or removes it.
An entry holds from its date until the next entry of the same pattern, so the dated
entries become validity intervals.  A capture is judged by the entries active when it was fetched: an as-of
join of its host's suffixes (``a.b.c``, ``b.c``, ``c``) with the intervals of those patterns.  The
active entry with the longest pattern decides; a host without one passes.

The as-of join is an equi-join on (pattern, month): an interval has a row per
month it touches, up to the last fetch month, so a capture meets the few intervals of its own month and not
a pattern's whole history.  A hot host's rows can be split by AQE, as nothing but the join needs them
together; verdicts are combined per capture.

Defined cases: a capture with a null or hostless url, or a null fetch time, has no active entry and is
kept; entries with a null pattern or date are ignored; of entries of one pattern and date
the last by (action, kind) holds; equal captures get equal verdicts and all stay; an
empty list keeps everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, REMOVE = "add", "remove"
BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """Lower-case host of a url without user, port and a final dot; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    found = F.regexp_replace(found, r"\.+$", "")
    return F.when(found != "", found)


def suffixes(name: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, kind, valid_from, valid_to) from dated (pattern, kind, action, dated); valid_to is exclusive, null: open.

    Windows run per pattern and hold a pattern's dated entries, one per date.
    """
    dated = (entries.filter("pattern is not null and dated is not null")
             .groupBy(F.lower("pattern").alias("pattern"), "dated")
             .agg(F.max(F.struct("action", "kind")).alias("entry")))
    until = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return (dated.withColumn("valid_to", until).filter(F.col("entry.action") == ADD)
            .select("pattern", F.col("entry.kind").alias("kind"), F.col("dated").alias("valid_from"), "valid_to"))


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` plus host, n_active, matched (pattern) and blocked, as of each capture's fetch time."""
    seen = captures.withColumn("__host", host(F.col(url_col)))
    key = seen.select(F.col("__host").alias("host"), F.col(time_col).alias("fetched")).filter("host is not null and fetched is not null").distinct()
    month = lambda c: F.trunc(F.col(c).cast("date"), "month")
    # the last fetch month bounds the months of open intervals
    last = captures.agg(F.max(month(time_col))).first()[0]
    spans = (intervals(entries).withColumn("from_month", month("valid_from"))
             .withColumn("to_month", F.least(F.coalesce(month("valid_to"), F.lit(last)), F.lit(last)))
             .filter("from_month <= to_month")
             .withColumn("month", F.explode(F.sequence("from_month", "to_month", F.expr("interval 1 month")))))
    active = (key.select("host", "fetched", month("fetched").alias("month"), F.explode(suffixes(F.col("host"))).alias("pattern"))
              .join(spans, ["pattern", "month"])
              .filter((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
              .groupBy("host", "fetched")
              .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("pattern", "kind"), F.length("pattern")).alias("entry")))
    joined = seen.join(active, (seen["__host"] == active["host"]) & (seen[time_col] == active["fetched"]), "left")
    return joined.select(
        *[seen[c] for c in captures.columns], F.col("__host").alias("host"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"),
        F.col("entry.pattern").alias("matched"), F.coalesce(F.col("entry.kind") == BLOCK, F.lit(False)).alias("blocked"))


def keep_allowed(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures that no entry blocked when they were fetched."""
    return judge(captures, entries, url_col, time_col).filter(~F.col("blocked")).select(*captures.columns)
