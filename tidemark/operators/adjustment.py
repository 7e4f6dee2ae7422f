"""Price adjustment for corporate actions.

The factor of a day is the product of the steps so far; a step needs the previous raw close and the day's events only,
so the fold is a running product over a window, kept as a sum of logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import close_to, ratio
from tidemark.functions.windows import series

#: How far a published previous close may lie from the theoretical one and still be used instead of it.
NEAR = 0.0100001


def event_steps(actions: DataFrame) -> DataFrame:
    """(i, ex, cash, paid_in, bonus, rights, by_ratio): what the active events of a day do together.

    The divisor starts at 1; bonus shares multiply it by 1 + ratio, splits and merges by the ratio, and rights add
    theirs; events of a day count in the order of their ids.
    """
    events = F.array_sort(F.collect_list(F.struct("id", "kind", "share")))
    one = lambda acc, e: F.when(e["kind"] == "bonus", acc * (1 + e["share"])).when(e["kind"].isin("split", "merge"), acc * e["share"]).when(e["kind"] == "rights_issue", acc + e["share"]).otherwise(acc)
    grouped = actions.where("active").groupBy("i", "ex").agg(
        F.sum("cash").alias("cash"),
        F.sum(F.when(F.col("kind") == "rights_issue", F.col("share") * F.col("price")).otherwise(0.0)).alias("paid_in"),
        events.alias("events"),
    )
    return grouped.select("i", F.col("ex").alias("d"), "cash", "paid_in", F.aggregate("events", F.lit(1.0), one).alias("divisor"))


def adjustment_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Bars with ``factor``, 1 on each instrument's first day; events on its first day or on days without a bar count nothing."""
    w = series("i", "d")
    rows = bars.join(event_steps(actions), ["i", "d"], "left").withColumn("before", F.lag("close").over(w))
    theory = (F.col("before") - F.col("cash") + F.col("paid_in")) / F.col("divisor")
    pre = F.when(F.abs(F.col("pre_close") - theory) <= NEAR, F.col("pre_close")).otherwise(theory) if "pre_close" in bars.columns else theory
    step = F.when(F.col("divisor").isNotNull() & F.col("before").isNotNull() & (theory > 0), F.col("before") / pre).otherwise(F.lit(1.0))
    ahead = w.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("step", step).withColumn("factor", F.exp(F.sum(F.ln("step")).over(ahead))).select(*bars.columns, "step", "factor")


def adjusted(bars_with_factor: DataFrame) -> DataFrame:
    """Adjusted open, high, low, close, and the previous adjusted close (of the first day: its own open)."""
    w = series("i", "d")
    rows = bars_with_factor
    for c in ("open", "high", "low", "close"):
        rows = rows.withColumn(f"{c}_post", F.col(c) * F.col("factor"))
    first = F.col("pre_close") * F.col("factor") if "pre_close" in rows.columns else F.col("open_post")
    return rows.withColumn("pre_close_post", F.coalesce(F.lag("close_post").over(w), first))


def vendor_adjusted(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Bars with a vendor's factor (i, d, factor): carried forward, and back from the first known one."""
    w = series("i", "d")
    rows = bars.join(factors, ["i", "d"], "left")
    known = F.last("factor", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("factor", F.coalesce(known, F.first("factor", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))))


def compare_factors(own: DataFrame, vendor: DataFrame, rtol: float = 1e-4) -> DataFrame:
    """Rows (i, d, own, vendor, same), both normalised by each instrument's first value."""
    w = series("i", "d").rowsBetween(W.unboundedPreceding, 0)
    norm = lambda df, name: df.select("i", "d", ratio(F.col("factor"), F.first("factor").over(w)).alias(name))
    return norm(own, "own").join(norm(vendor, "vendor"), ["i", "d"]).withColumn("same", close_to(F.col("own"), F.col("vendor"), rtol, 1e-10))
