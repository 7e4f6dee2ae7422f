"""Intervals, gaps, hierarchies: what ingestion needs to turn logs and lists into validity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def root_of(tree: DataFrame, node: str, parent: str, most: int = 64) -> DataFrame:
    """(node, top): the root above each node, by doubling the reach of each step; a cycle raises ValueError."""
    up = tree.select(F.col(node), F.coalesce(parent, node).alias("top"))
    for _ in range(most.bit_length()):
        far = up.select(F.col(node).alias("__n"), F.col("top").alias("__t"))
        up = up.join(far, up.top == F.col("__n"), "left").select(node, F.coalesce("__t", "top").alias("top"))
    return up


def missing_sessions(bars: DataFrame, calendar: DataFrame, instruments: DataFrame) -> DataFrame:
    """(i, d): sessions inside an instrument's listing window without a bar.

    The calendar becomes one array per instrument, cut to its window, so no cross join is needed.
    """
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("days"))  # one row; as long as the history has sessions
    inside = lambda x: (x >= F.col("listed")) & (F.col("delisted").isNull() | (x < F.col("delisted")))
    wanted = instruments.join(F.broadcast(days)).select("i", F.explode(F.filter("days", inside)).alias("d"))
    return wanted.join(bars.select("i", "d"), ["i", "d"], "left_anti")


def expand_sessions(intervals: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """One row per session ``d`` in ``[start, end)`` of each interval."""
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("__days"))
    return intervals.join(F.broadcast(days)).withColumn("d", F.explode(F.filter("__days", lambda x: (x >= F.col(start)) & (x < F.col(end))))).drop("__days")


def abutting(log: DataFrame, keys: list[str], start: str, tie: str) -> DataFrame:
    """A state log as windows: each state ends where the next begins; several states of one day: the last tie wins."""
    one = log.withColumn("__n", F.row_number().over(W.partitionBy(*keys, start).orderBy(F.desc(tie)))).where("__n = 1").drop("__n")
    return one.withColumn("effective_to", F.lead(start).over(W.partitionBy(*keys).orderBy(start)))


def members_to_intervals(daily: DataFrame, calendar: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Daily member lists as intervals (keys, effective_from, effective_to) of consecutive sessions."""
    placed = daily.select(*keys, day).distinct().join(calendar.select(F.col("d").alias(day), "idx"), day)
    run = F.col("idx") - F.row_number().over(W.partitionBy(*keys).orderBy("idx"))
    return placed.withColumn("__run", run).groupBy(*keys, "__run").agg(F.min(day).alias("effective_from"), F.max(day).alias("effective_to")).drop("__run")


def codes_to_intervals(daily: DataFrame, key: str, day: str, code: str) -> DataFrame:
    """Daily codes as intervals (key, code, effective_from, effective_to): a new one wherever the code changes."""
    w = W.partitionBy(key).orderBy(day)
    changed = F.when(F.col(code).eqNullSafe(F.lag(code).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    run = daily.withColumn("__c", changed).withColumn("__run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(key, code, "__run").agg(F.min(day).alias("effective_from"), F.max(day).alias("effective_to")).drop("__run")


def overlaps(intervals: DataFrame, keys: list[str], start: str, end: str, tie: str | None = None) -> DataFrame:
    """Intervals whose successor begins before they end (ends count; an open interval must be the last).

    Equal intervals follow each other by ``tie``; without it, which of them comes last is open.
    """
    w = W.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last(), *([tie] if tie else []))
    following = F.lead(start).over(w)
    return intervals.withColumn("next_start", following).where(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col("next_start") <= F.col(end))))


def filled_halts(bars: DataFrame, calendar: DataFrame, instruments: DataFrame) -> DataFrame:
    """Bars with one row per listed session: a session without a bar repeats the last close, without volume, paused."""
    gaps = missing_sessions(bars, calendar, instruments).select("i", "d", F.lit(None).cast("double").alias("close"), F.lit(0.0).alias("volume"), F.lit(True).alias("halted"))
    rows = bars.select("i", "d", "close", "volume", F.lit(False).alias("halted")).unionByName(gaps)
    w = W.partitionBy("i").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("close", F.last("close", ignorenulls=True).over(w)).where("close is not null")


def next_session(rows: DataFrame, calendar: DataFrame, day: str, out: str) -> DataFrame:
    """Adds the first session after ``day``, or the next weekday beyond the calendar.

    The sorted calendar is one array (as long as the history has sessions), searched per row.
    """
    days = calendar.agg(F.array_sort(F.collect_set("d")).alias("__days"))
    later = F.get(F.filter("__days", lambda x: x > F.col(day)), F.lit(0))
    weekday = F.date_add(day, F.when(F.dayofweek(day) == 6, 3).when(F.dayofweek(day) == 7, 2).otherwise(1))
    return rows.join(F.broadcast(days)).withColumn(out, F.coalesce(later, weekday)).drop("__days")
