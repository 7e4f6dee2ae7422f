"""Performance, attribution and reconciliation over ledger tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.asof import interval_join

YEAR = 252.0


def nav_returns(nav: DataFrame, key: str = "run") -> DataFrame:
    """Rows (key, d, nav) with ``r``, ``high`` (running maximum), ``drawdown`` and ``n`` (row number)."""
    w = W.partitionBy(key).orderBy("d")
    rows = nav.withColumn("r", F.try_divide("nav", F.lag("nav").over(w)) - 1).withColumn("high", F.max("nav").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("drawdown", F.col("nav") / F.col("high") - 1).withColumn("n", F.row_number().over(w))


def compounded(r: Column) -> Column:
    """What returns ``r`` make together; NaN if one is below -1, for an account that fell below zero has no such result."""
    return F.product(F.when(r < -1, F.lit(float("nan"))).otherwise(1 + r)) - 1


def performance(nav: DataFrame, key: str = "run", risk_free: float = 0.0) -> DataFrame:
    """One row per key: returns, volatility, ratios, the deepest fall, how long it took and how long recovery did."""
    w = W.partitionBy(key).orderBy("d")
    rows = nav_returns(nav, key)
    under = F.col("drawdown") < 0
    island = F.sum(F.when(under, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__under", under).withColumn("__island", island)
    lengths = rows.where("__under").groupBy(key, "__island").agg(F.count(F.lit(1)).alias("long")).groupBy(key).agg(F.max("long").alias("drawdown_days"))
    trough = rows.groupBy(key).agg(F.min_by("n", F.struct("drawdown", "n")).alias("trough"), F.min_by("high", F.struct("drawdown", "n")).alias("peak"))
    back = rows.join(trough, key).where((F.col("n") >= F.col("trough")) & (F.col("nav") >= F.col("peak"))).groupBy(key).agg(F.min(F.col("n") - F.col("trough")).alias("recovery_days"))
    daily = risk_free / YEAR
    facts = rows.groupBy(key).agg(
        (F.max_by("nav", "d") / F.min_by("nav", "d") - 1).alias("total_return"),
        F.count("r").alias("days"),
        F.avg(F.col("r") - daily).alias("__mean"),
        F.stddev_samp("r").alias("__std"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r") - daily, F.lit(0.0)), 2))).alias("__down"),
        F.min("drawdown").alias("max_drawdown"),
    )
    facts = facts.withColumn("annual_return", F.when(F.col("days") > 0, F.pow(1 + F.col("total_return"), F.lit(YEAR) / F.col("days")) - 1)).withColumn("volatility", F.col("__std") * YEAR**0.5)
    facts = facts.withColumn("sharpe", F.when(F.col("__std") > 0, F.col("__mean") / F.col("__std") * YEAR**0.5)).withColumn("sortino", F.when(F.col("__down") > 0, F.col("__mean") / F.col("__down") * YEAR**0.5))
    facts = facts.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / -F.col("max_drawdown")))
    out = facts.join(lengths, key, "left").join(back, key, "left")
    return out.select(key, "total_return", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", F.coalesce("drawdown_days", F.lit(0)).cast("long").alias("drawdown_days"), F.col("recovery_days").cast("long").alias("recovery_days"))


def against_benchmark(nav: DataFrame, benchmark: DataFrame, key: str = "run") -> DataFrame:
    """(key, benchmark_return, excess, tracking_error, information_ratio) over the days both have returns."""
    w = W.orderBy("d")
    bench = benchmark.select("d", (F.try_divide("nav", F.lag("nav").over(w)) - 1).alias("b"))
    both = nav_returns(nav, key).join(bench, "d").where("r is not null and b is not null")
    facts = both.groupBy(key).agg(compounded(F.col("b")).alias("benchmark_return"), (compounded(F.col("r")) - compounded(F.col("b"))).alias("excess"), F.avg(F.col("r") - F.col("b")).alias("__m"), F.stddev_samp(F.col("r") - F.col("b")).alias("__s"))
    return facts.select(key, "benchmark_return", "excess", (F.col("__s") * YEAR**0.5).alias("tracking_error"), F.when(F.col("__s") > 0, F.col("__m") / F.col("__s") * YEAR**0.5).alias("information_ratio"))


def security_pnl(positions: DataFrame, keys: tuple[str, ...] = ("i",)) -> DataFrame:
    """(keys, d, pnl): the quantity of the day before times the change of the price, which is carried over gaps."""
    w = W.partitionBy(*keys).orderBy("d")
    rows = positions.withColumn("p", F.last("price", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select(*keys, "d", F.coalesce(F.lag("quantity").over(w) * (F.col("p") - F.lag("p").over(w)), F.lit(0.0)).alias("pnl"))


def industry_pnl(pnl: DataFrame, membership: DataFrame) -> DataFrame:
    """(d, industry, pnl): each instrument's result in the industry that held it that day, UNKNOWN where none did."""
    placed = interval_join(pnl, membership, ["i"], "d", "start", "end", ["industry"], {"industry": "UNKNOWN"})
    return placed.groupBy("d", "industry").agg(F.sum("pnl").alias("pnl"))


def attribution(nav: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(d, each part, residual): parts (d, pnl) of the account's daily result; the residual is what they leave."""
    out = nav.select("d", (F.col("nav") - F.lag("nav").over(W.orderBy("d"))).alias("account"))
    for name, df in parts.items():
        out = out.join(df.groupBy("d").agg(F.sum("pnl").alias(name)), "d", "left").fillna(0.0, [name])
    return out.withColumn("residual", F.col("account") - sum((F.col(p) for p in parts), F.lit(0.0)))


def yearly(nav: DataFrame, key: str = "run") -> DataFrame:
    rows = nav_returns(nav, key).where("r is not null")
    return rows.groupBy(key, F.year("d").alias("year")).agg(compounded(F.col("r")).alias("total_return"), F.count(F.lit(1)).alias("days"))


def without_best_days(nav: DataFrame, n: int, key: str = "run") -> DataFrame:
    best = F.row_number().over(W.partitionBy(key).orderBy(F.desc("r"), "d"))
    rows = nav_returns(nav, key).where("r is not null").withColumn("best", best)
    return rows.groupBy(key).agg(compounded(F.when(F.col("best") > n, F.col("r")).otherwise(0.0)).alias("total_return"))


def strategy_pnl(nav: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(d, strategy, pnl, error) of (d, strategy, nav): daily results, and by how much their sum misses the account's.

    The account's value is the sum over strategies; an error beyond ``tolerance`` raises where it is read.
    """
    own = nav.withColumn("pnl", F.col("nav") - F.lag("nav").over(W.partitionBy("strategy").orderBy("d")))
    account = nav.groupBy("d").agg(F.sum("nav").alias("nav"), F.count(F.lit(1)).alias("n"))
    line = W.orderBy("d")  # one row per day
    account = account.withColumn("account", F.when(F.lag("n").over(line) == F.col("n"), F.col("nav") - F.lag("nav").over(line))).select("d", "account")
    summed = own.groupBy("d").agg(F.sum("pnl").alias("total")).join(account, "d")
    error = F.coalesce(F.abs(F.col("total") - F.col("account")), F.lit(0.0))
    checked = F.when(error > tolerance, F.raise_error(F.lit("strategy results do not add up to the account's")).cast("double")).otherwise(error)
    return own.where("pnl is not null").join(summed.select("d", checked.alias("error")), "d").select("d", "strategy", "pnl", "error")


def delisting_summary(positions: DataFrame) -> DataFrame:
    """One row (frozen, frozen_value, stalest) from (d, i, status, value, stale): what is left of delisted holdings on
    the last day, and the longest run of stale prices on any."""
    last = positions.agg(F.max("d").alias("last"))
    rows = positions.join(F.broadcast(last))  # one row
    frozen = (F.col("d") == F.col("last")) & (F.col("status") == "delisted_illiquid")
    return rows.agg(
        F.countDistinct(F.when(frozen, F.col("i"))).alias("frozen"),
        F.coalesce(F.sum(F.when(frozen, F.col("value"))), F.lit(0.0)).alias("frozen_value"),
        F.coalesce(F.max("stale"), F.lit(0)).alias("stalest"),
    )
