"""Factors: (d, i, value) relations over bars.

Risk factors work on sessions: a window is the last ``n`` sessions of the calendar, a missing bar is a gap in it, and
nothing is emitted before the calendar has ``n + 1`` sessions. Rows carry the session number ``idx`` and windows use
it as their range. Weights that decay with age are powers of two of the session number; the common factor cancels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import positive_log
from tidemark.functions.windows import change, median, rolling, series

def by_day():
    """The rows of one instrument by day; made on use, for a window needs a session."""
    return series("i", "d")


def two_point_return(bars: DataFrame, n: int) -> DataFrame:
    return bars.select("d", "i", change(F.col("close"), n, by_day()).alias("value")).where("value is not null")


def momentum_top(bars: DataFrame, n: int, k: int) -> DataFrame:
    """The ``k`` largest ``n``-row returns of each day."""
    ret = bars.select("d", "i", F.round(change(F.col("close"), n, by_day()), 6).alias("ret")).where("ret is not null")
    place = F.row_number().over(W.partitionBy("d").orderBy(F.desc("ret"), "i"))
    return ret.withColumn("n", place).where(F.col("n") <= k).drop("n")


def median_amount(bars: DataFrame, n: int) -> DataFrame:
    return bars.select("d", "i", rolling(median, F.col("amount"), n, by_day()).alias("value")).where("value is not null")


def composite(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of factors on the keys they share."""
    total = None
    for k, (part, weight) in enumerate(parts):
        one = part.select("d", "i", (F.col("value") * F.lit(float(weight))).alias(f"v{k}"))
        total = one if total is None else total.join(one, ["d", "i"])
    return total.select("d", "i", sum((F.col(f"v{k}") for k in range(1, len(parts))), F.col("v0")).alias("value"))


def session_returns(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with ``idx`` and ``r``: null if the previous session has no bar, 0 on paused days."""
    placed = bars.join(calendar, "d")
    w = series("i", "idx")
    r = F.when(F.lag("idx").over(w) == F.col("idx") - 1, change(F.col("close"), 1, w))
    return placed.withColumn("r", F.when(F.col("paused") & r.isNotNull(), F.lit(0.0)).otherwise(r))


def sessions(n: int, until: int = 0) -> W:
    return W.partitionBy("i").orderBy("idx").rangeBetween(until - n + 1, until)


def _emit(rows: DataFrame, value: Column, n: int, need: int, x: str = "r") -> DataFrame:
    found = rows.select("d", "i", "idx", F.when(F.count(x).over(sessions(n)) >= need, value).alias("value"))
    return found.where((F.col("idx") > n) & F.col("value").isNotNull()).select("d", "i", "value")


def total_volatility(rows: DataFrame, n: int, need: int) -> DataFrame:
    return _emit(rows, F.stddev_samp("r").over(sessions(n)) * F.sqrt(F.lit(252.0)), n, need)


def downside_volatility(rows: DataFrame, n: int, need: int) -> DataFrame:
    down = F.pow(F.least("r", F.lit(0.0)), 2)
    return _emit(rows, F.sqrt(F.avg(F.when(F.col("r").isNotNull(), down)).over(sessions(n)) * 252), n, need)


def worst_loss(rows: DataFrame, n: int, need: int, k: int = 5) -> DataFrame:
    worst = F.slice(F.array_sort(F.collect_list("r").over(sessions(n))), 1, k)
    mean = -F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.lit(float(k))
    return _emit(rows, mean, n, need)


def volatility_of_volatility(rows: DataFrame, short: int = 20, n: int = 252, need_short: int = 16, need: int = 202) -> DataFrame:
    """Spread of the short volatility relative to its mean."""
    vol = F.when((F.count("r").over(sessions(short)) >= need_short) & (F.col("idx") > short), F.stddev_samp("r").over(sessions(short)))
    found = rows.withColumn("vol", vol)
    mean = F.avg("vol").over(sessions(n))
    return _emit(found, F.try_divide(F.stddev_samp("vol").over(sessions(n)), mean), n, need, "vol")


def market_return(rows: DataFrame) -> DataFrame:
    """(d, m): mean return per day, weighted by each instrument's ``cap`` on the session before.

    Instruments without a return, or without a positive ``cap`` then, do not count; a day without any has no row.
    """
    w = series("i", "idx")
    before = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("cap").over(w))
    weighted = rows.withColumn("w", before).where("r is not null and w > 0")
    return weighted.groupBy("d").agg(F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("m"))


def _decayed(rows: DataFrame, half_life: int, n: int) -> dict[str, Column]:
    """Weighted sums over pairs (m, r) of the last ``n`` sessions, up to a common factor."""
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    w = F.when(both, F.pow(F.lit(2.0), F.col("idx") / F.lit(float(half_life))))
    x, y, frame = F.col("m"), F.col("r"), sessions(n)
    terms = {"w": w, "x": w * x, "y": w * y, "xx": w * x * x, "xy": w * x * y, "yy": w * y * y}
    return {k: F.sum(v).over(frame) for k, v in terms.items()} | {"n": F.count(w).over(frame)}


def _pairs(rows: DataFrame, half_life: int, n: int) -> DataFrame:
    joined = rows.join(market_return(rows), "d", "left")
    return joined.select("d", "i", "idx", *[v.alias(f"s_{k}") for k, v in _decayed(joined, half_life, n).items()])


def beta(rows: DataFrame, n: int = 252, half_life: int = 63, need: int = 21) -> DataFrame:
    """Slope of the return on the market return, weights halving every ``half_life`` sessions."""
    s = _pairs(rows, half_life, n)
    top = F.col("s_xy") - F.col("s_x") * F.col("s_y") / F.col("s_w")
    below = F.col("s_xx") - F.col("s_x") * F.col("s_x") / F.col("s_w")
    value = F.when((F.col("s_n") >= need) & (below > 0), top / below)
    return s.where("s_w > 0").select("d", "i", "idx", value.alias("value")).where((F.col("idx") > n) & F.col("value").isNotNull()).select("d", "i", "value")


def residual_volatility(rows: DataFrame, n: int = 252, half_life: int = 63, need: int = 202) -> DataFrame:
    """Weighted spread of what the market return leaves unexplained, per year."""
    s = _pairs(rows, half_life, n)
    top = F.col("s_xy") - F.col("s_x") * F.col("s_y") / F.col("s_w")
    below = F.col("s_xx") - F.col("s_x") * F.col("s_x") / F.col("s_w")
    whole = F.col("s_yy") - F.col("s_y") * F.col("s_y") / F.col("s_w")
    rest = F.greatest(whole - top * top / below, F.lit(0.0)) / F.col("s_w")
    value = F.when((F.col("s_n") >= need) & (below > 0), F.sqrt(rest * 252))
    return s.where("s_w > 0").select("d", "i", "idx", value.alias("value")).where((F.col("idx") > n) & F.col("value").isNotNull()).select("d", "i", "value")


def trend(closes: Column, n: int) -> Column:
    """Struct (slope, r2) of the log of an array of ``n`` closes.

    The slope is a least-squares one with squared linear weights from 1 to 2; R squared uses the weights themselves
    and the unweighted mean. Everything on the side of time is constant, so both are dot products.
    """
    w = [1 + k / (n - 1) for k in range(n)]
    total = sum(x * x for x in w)
    middle = sum(k * x * x for k, x in enumerate(w)) / total
    spread = sum(x * x * (k - middle) ** 2 for k, x in enumerate(w))
    slope_by = F.array(*[F.lit(x * x * (k - middle) / spread) for k, x in enumerate(w)])
    level_by = F.array(*[F.lit(x * x / total) for x in w])
    weights = F.array(*[F.lit(x) for x in w])
    add = lambda a, x: a + x
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), add)

    def fit(y: Column) -> Column:
        return F.struct(y.alias("y"), dot(y, slope_by).alias("slope"), dot(y, level_by).alias("level"), (F.aggregate(y, F.lit(0.0), add) / n).alias("mean"))

    def measure(f: Column) -> Column:
        left = F.transform(f["y"], lambda v, k: F.pow(v - f["level"] - f["slope"] * (k - F.lit(middle)), 2))
        whole = F.transform(f["y"], lambda v: F.pow(v - f["mean"], 2))
        rest, all_of = dot(left, weights), dot(whole, weights)
        return F.struct(f["slope"].alias("slope"), F.when(all_of > 1e-18, 1 - rest / all_of).otherwise(F.lit(0.0)).alias("r2"))

    bound = F.transform(F.array(F.transform(closes, lambda c: F.ln(c))), fit)
    return F.get(F.transform(bound, measure), F.lit(0))


def momentum_6_1(rows: DataFrame, n: int = 140, skip: int = 20) -> DataFrame:
    """Annualised trend of the last ``n`` sessions without the newest ``skip``, times its R squared; rows carry ``idx``."""
    frame = W.partitionBy("i").orderBy("idx").rangeBetween(-(n - 1), -skip)
    held = n - skip
    full = rows.withColumn("__c", F.collect_list(F.when(F.col("close") > 0, F.col("close"))).over(frame)).where((F.size("__c") == held) & (F.col("idx") >= n))
    t = full.withColumn("__t", trend(F.col("__c"), held))
    return t.select("d", "i", ((F.exp(F.col("__t.slope") * 250) - 1) * F.col("__t.r2")).alias("value"))


def log_growth(levels: DataFrame, calendar: DataFrame, lag: int = 252) -> DataFrame:
    """ln(level) minus ln(level ``lag`` sessions before), on exact sessions; (d, i, level) in."""
    rows = levels.join(calendar, "d").select("d", "i", "idx", positive_log(F.col("level")).alias("l"))
    before = F.first("l").over(W.partitionBy("i").orderBy("idx").rangeBetween(-lag, -lag))
    return rows.select("d", "i", (F.col("l") - before).alias("value")).where("value is not null")


def dividend_continuity(grid: DataFrame, actions: DataFrame, years: int = 3) -> DataFrame:
    """How many of the last ``years`` 365-day buckets have an active cash dividend; (d, i) in ``grid``, zeros kept."""
    paid = actions.where("active and kind = 'cash_dividend' and announced <= ex").select(F.col("i").alias("pi"), "ex")
    age = F.datediff("d", "ex")
    hit = grid.join(paid, (F.col("i") == F.col("pi")) & (F.col("ex") <= F.col("d")) & (age < 365 * years), "left")
    return hit.groupBy("d", "i").agg(F.countDistinct(F.floor(age / 365)).alias("value"))


def month_end_median(rows: DataFrame, calendar: DataFrame, n: int = 36, need: int = 24) -> DataFrame:
    """(d, i, value): median of the last ``n`` month-end values, only finished months of the full calendar."""
    following = F.lead("d").over(W.orderBy("d"))
    ends = calendar.withColumn("next", following).where("next is not null and trunc(next, 'month') <> trunc(d, 'month')")
    ends = ends.withColumn("m", F.row_number().over(W.orderBy("d"))).select("d", "m")
    w = W.partitionBy("i").orderBy("m").rangeBetween(-(n - 1), 0)
    found = rows.join(ends, "d").withColumn("seen", F.count("value").over(w)).withColumn("med", median(F.col("value")).over(w))
    return found.where(F.col("seen") >= need).select("d", "i", F.col("med").alias("value"))
