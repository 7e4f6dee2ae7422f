"""From scores to weights: schedules, signals, constructors, constraints, sleeves."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.errors import ConstraintError
from tidemark.functions.windows import rank_share_first, winsorised, zscore
from tidemark.workers import ship_package

# --- schedules and signals -------------------------------------------------------------------------------------


def schedule(calendar: DataFrame, kind: str, n: int = 1, first: bool = False) -> DataFrame:
    """Decision dates (d) of a calendar (d, idx): daily, every ``n`` sessions, first or last of week or month."""
    if kind == "daily":
        return calendar.select("d")
    if kind == "every":
        return calendar.where((F.col("idx") - 1) % n == 0).select("d")
    period = {"weekly": [F.extract(F.lit("YEAROFWEEK"), "d"), F.weekofyear("d")], "monthly": [F.year("d"), F.month("d")]}[kind]
    return calendar.groupBy(*[p.alias(f"p{k}") for k, p in enumerate(period)]).agg((F.min if first else F.max)("d").alias("d")).select("d")


def factor_signal(parts: list[tuple[DataFrame, float]], transform: str = "zscore") -> DataFrame:
    """(d, i, score): weighted sum of factors, each transformed within its day."""
    shape = {"zscore": lambda: zscore(F.col("value"), "d"), "rank": lambda: rank_share_first(F.col("value"), "d", "i"), "winsorize": lambda: winsorised(F.col("value"), "d"), "none": lambda: F.col("value")}[transform]
    total = None
    for k, (df, weight) in enumerate(parts):
        one = df.select("d", "i", (shape() * F.lit(float(weight))).alias(f"v{k}"))
        total = one if total is None else total.join(one, ["d", "i"])
    return total.select("d", "i", sum((F.col(f"v{k}") for k in range(1, len(parts))), F.col("v0")).alias("score"))


# --- constructors ------------------------------------------------------------------------------------------------


def top_k_equal(signal: DataFrame, k: int) -> DataFrame:
    """(d, i, weight): the best ``k`` of each day in equal parts (of fewer, those)."""
    place = F.row_number().over(W.partitionBy("d").orderBy(F.desc("score"), "i"))
    best = signal.withColumn("n", place).where(F.col("n") <= k)
    return best.select("d", "i", (F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("d"))).alias("weight"))


def score_weighted(signal: DataFrame, kind: str = "positive", heat: float = 1.0) -> DataFrame:
    """(d, i, weight): in proportion to positive scores, to ranks, or to a softmax of the scores."""
    day = W.partitionBy("d")
    if kind == "positive":
        raw = F.greatest("score", F.lit(0.0))
    elif kind == "rank":
        raw = F.row_number().over(day.orderBy("score", F.desc("i"))).cast("double")
    else:
        raw = F.exp((F.col("score") - F.max("score").over(day)) / heat)
    rows = signal.withColumn("raw", raw)
    return rows.withColumn("sum", F.sum("raw").over(day)).where("sum > 0 and raw > 0").select("d", "i", (F.col("raw") / F.col("sum")).alias("weight"))


def top_k_dropout(ranked: list, held: list, k: int, buffer: int = 5, replace: int | None = None) -> tuple[list, list, list]:
    """(next holdings, those kept, those added by right) of a ranking and the names held before.

    A name stays while it ranks among the best ``k + buffer``. Empty places go to the best other names: the first
    ``replace`` of them by right, the rest because the portfolio must be full, so the limit shows in the report only.
    """
    near = set(ranked[: k + buffer])
    kept = [x for x in held if x in near]
    others = [x for x in ranked if x not in set(kept)][: max(0, k - len(kept))]
    return (kept + others)[:k], kept, others[: k if replace is None else replace]


def dropout_path(signal: DataFrame, k: int, buffer: int = 5, replace: int | None = None) -> DataFrame:
    """(d, i, weight, kept): the holdings of each decision date of (d, i, score), each from those of the date before.

    Dates depend on each other, so they are one fold; only the ``2 * k + buffer`` best of a date and whether a name is
    among them matter, so a window cuts the rows before they meet.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held: list = []
        out = []
        for d, day in rows.groupby("d", sort=True):
            ranked = day.sort_values("n")["i"].tolist()
            held, kept, _ = top_k_dropout(ranked, held, k, buffer, replace)
            out += [(d, i, 1.0 / len(held), i in kept) for i in held]
        return pd.DataFrame(out, columns=["d", "i", "weight", "kept"])

    place = F.row_number().over(W.partitionBy("d").orderBy(F.desc("score"), "i"))
    best = signal.select("d", "i", place.alias("n")).where(F.col("n") <= 2 * k + buffer)
    return best.groupBy(F.lit(0).alias("one")).applyInPandas(fold, "d date, i long, weight double, kept boolean")


def risk_parity(returns, shrink: float = 0.1, rounds: int = 1000, tolerance: float = 1e-8):
    """Weights with equal risk contributions for a (time x instrument) array of returns.

    One weight after the other is set so that its own contribution is right. Unlike a step of all weights at once, this
    converges for any covariance, also where hedges make some contributions negative on the way.
    """
    import numpy as np

    x = np.asarray(returns, float)
    cov = np.atleast_2d(np.cov(x, rowvar=False))
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    n = len(cov)
    w = np.full(n, 1.0 / n)
    scale = np.diag(cov).mean()
    if not scale > 0:
        return w
    cov = cov / scale
    own = np.maximum(np.diag(cov), 1e-12)
    for _ in range(rounds):
        part = w * (cov @ w)
        total = part.sum()
        if total > 0 and np.abs(part - total / n).max() < tolerance * total:
            break
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (np.sqrt(rest * rest + 4 * own[i] / n) - rest) / (2 * own[i])
    return w / w.sum()


def risk_parity_by_date(returns: DataFrame, n: int = 60) -> DataFrame:
    """(d, i, weight) per decision date from rows (d, i, lag, r): one array of the last ``n`` returns per date.

    Instruments with fewer than half of the returns (two at least) stay out, and days on which one of the others has
    none. Dates with fewer than two days left, or without any spread, have no rows: all stays in cash.
    """
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="lag", columns="i", values="r").dropna(axis=1, thresh=max(2, n // 2)).dropna()
        if len(wide) < 2 or wide.shape[1] == 0 or not math.isfinite(wide.to_numpy().var()) or wide.to_numpy().var(axis=0).sum() <= 0:
            return pd.DataFrame({"d": [], "i": [], "weight": []})
        return pd.DataFrame({"d": pdf["d"].iloc[0], "i": wide.columns, "weight": risk_parity(wide.to_numpy())})

    ship_package(returns.sparkSession)
    return returns.where(F.col("lag") < n).groupBy("d").applyInPandas(solve, "d date, i long, weight double")


# --- constraints ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Bounds on a target: everything is a share of the account."""

    instrument: float = 1.0
    industry: float | None = None
    assets: Mapping[str, float] = field(default_factory=dict)
    least_cash: float = 0.0
    most_cash: float = 1.0
    least_holdings: int = 0
    holdings: int | None = None
    least_weight: float = 0.0
    turnover: float | None = None

    def __post_init__(self):
        if not 0 <= self.least_cash <= self.most_cash <= 1:
            raise ConstraintError("cash limits must satisfy 0 <= least <= most <= 1")
        for name, value in (("instrument", self.instrument), ("industry", self.industry)):
            if value is not None and not 0 < value <= 1:
                raise ConstraintError(f"{name} must lie in (0, 1]")
        if any(not 0 <= v <= 1 for v in self.assets.values()):
            raise ConstraintError("asset limits must lie between 0 and 1")
        if self.turnover is not None and self.turnover <= 0:
            raise ConstraintError("turnover must be positive")
        if self.holdings is not None and self.holdings < self.least_holdings:
            raise ConstraintError("the most holdings must not be fewer than the least")


def _caps(names, limits: Limits, industry: Mapping, asset: Mapping) -> list[tuple[frozenset, float]]:
    """(names, cap) of every bound that can bind."""
    groups = [(frozenset([k]), limits.instrument) for k in names]
    if limits.industry is not None:
        groups += [(frozenset(k for k in names if industry[k] == g), limits.industry) for g in {industry[k] for k in names}]
    groups += [(frozenset(k for k in names if asset[k] == g), cap) for g, cap in limits.assets.items()]
    return [(g, cap) for g, cap in groups if g]


def progressive_fill(base: Mapping, budget: float, caps: list[tuple[frozenset, float]]) -> dict:
    """Shares ``budget`` in proportion to ``base`` under caps on sets of names.

    One level rises for all names at once, and a name holds its base times the level at which the first of its caps
    (or the budget) was reached. At most one step per cap, whatever the order of names.
    """
    level, free, out = 0.0, {k for k, v in base.items() if v > 0}, dict.fromkeys(base, 0.0)
    bounds = [*caps, (frozenset(base), budget)]
    while free:
        def until(bound: tuple[frozenset, float], free=free) -> float:
            rising = sum(base[k] for k in sorted(bound[0] & free))
            return (bound[1] - sum(out[k] for k in sorted(bound[0] - free))) / rising if rising > 0 else math.inf

        heights = [until(b) for b in bounds]
        level = max(level, min(heights))
        stop = set().union(*(b[0] for b, h in zip(bounds, heights, strict=True) if h <= level * (1 + 1e-15))) & free
        for k in stop:
            out[k] = base[k] * level
        free = free - stop
    return {k: v for k, v in out.items() if v > 1e-15}


def _broken(w: Mapping, limits: Limits, industry: Mapping, asset: Mapping) -> bool:
    if limits.industry is not None and any(k not in industry for k in w):
        return True
    known = {k: asset.get(k) for k in w}
    bounds = [*_caps(list(w), limits, industry, known), (frozenset(w), 1 - limits.least_cash)]
    return any(v < -1e-12 for v in w.values()) or any(sum(w[k] for k in g) > cap + 1e-12 for g, cap in bounds)


def constrain(target: Mapping, limits: Limits, universe: set | None = None, industry: Mapping | None = None, asset: Mapping | None = None, previous: Mapping | None = None, cash: float | None = None) -> tuple[dict, dict]:
    """(weights, report) within ``limits``; what is not invested is cash.

    In order: a target must be a valid one over the universe; cash is kept; caps cut weights and others take what they
    lose; the largest ``holdings`` stay; small weights go; where the turnover is too high, the step from ``previous``
    is shortened, unless that breaks a bound, which the report then tells. ConstraintError where names have no
    industry or asset type that a bound needs, or where the bounds cannot hold.
    """
    industry, asset, previous = industry or {}, asset or {}, previous or {}
    rest = 1 - sum(target.values()) if cash is None else cash
    if universe is not None and not set(target) <= universe:
        raise ConstraintError(f"outside the universe: {sorted(set(target) - universe)}")
    if any(not math.isfinite(v) or v < 0 for v in target.values()) or not -1e-10 <= rest <= 1 + 1e-10 or abs(sum(target.values()) + rest - 1) > 1e-10:
        raise ConstraintError("weights and cash must be finite, not negative and 1 together")
    for wanted, known, what in ((limits.industry is not None, industry, "industry"), (bool(limits.assets), asset, "asset type")):
        if wanted and not set(target) <= set(known):
            raise ConstraintError(f"without {what}: {sorted(set(target) - set(known))}")
    report: dict = {"before": dict(target), "changes": []}
    base = {k: v for k, v in target.items() if v > 0}
    budget = min(sum(base.values()), 1 - limits.least_cash)
    if budget < sum(base.values()) - 1e-12:
        report["changes"].append(("min_cash", budget / sum(base.values())))
    w = progressive_fill(base, budget, _caps(list(base), limits, industry, asset))
    best = sorted(w, key=lambda k: (-w[k], k))[: limits.holdings]
    for name, keep in (("max_holdings", set(best)), ("min_weight", {k for k, v in w.items() if v >= limits.least_weight})):
        if gone := sorted(w.keys() - keep):
            report["changes"].append((name, gone))
            w = {k: v for k, v in w.items() if k in keep}
    moved = turnover(w, previous)
    if limits.turnover is not None and moved > limits.turnover:
        t = limits.turnover / moved
        near = {k: previous.get(k, 0.0) + t * (w.get(k, 0.0) - previous.get(k, 0.0)) for k in w.keys() | previous.keys() if universe is None or k in universe}
        near = {k: v for k, v in near.items() if v > 1e-15}
        if _broken(near, limits, industry, asset):
            report["turnover_kept"] = moved
        else:
            w = near
            report["changes"].append(("turnover", t))
    if _broken(w, limits, industry, asset):
        raise ConstraintError("the bounds cannot hold")
    if len(w) < limits.least_holdings:
        report["too_few_holdings"] = len(w)
    report |= {"cash": 1 - sum(w.values()), "turnover": turnover(w, previous)}
    if report["cash"] > limits.most_cash + 1e-12:
        raise ConstraintError("too much cash is left")
    return dict(sorted(w.items())), report


def constrain_by_date(targets: DataFrame, limits: Limits) -> DataFrame:
    """(d, i, weight) within ``limits`` per decision date from (d, i, weight, industry, asset); dates run in parallel.

    A date whose bounds cannot hold has no rows. Turnover needs the date before and is left to :func:`constrain`.
    """
    import pandas as pd

    def solve(day: pd.DataFrame) -> pd.DataFrame:
        by = day.set_index("i")
        try:
            w, _ = constrain(by["weight"].to_dict(), limits, None, by["industry"].to_dict(), by["asset"].to_dict())
        except ConstraintError:
            w = {}
        return pd.DataFrame({"d": day["d"].iloc[0], "i": list(w), "weight": list(w.values())})

    ship_package(targets.sparkSession)
    return targets.groupBy("d").applyInPandas(solve, "d date, i long, weight double")


def turnover(new: dict[str, float], old: dict[str, float]) -> float:
    """One-way: half the sum of absolute changes."""
    return sum(abs(new.get(k, 0.0) - old.get(k, 0.0)) for k in new.keys() | old.keys()) / 2


def turnover_by_date(weights: DataFrame) -> DataFrame:
    """(d, turnover) between consecutive decision dates of rows (d, i, weight)."""
    days = weights.select("d").distinct().withColumn("next", F.lead("d").over(W.orderBy("d")))
    new = weights.select("d", "i", F.col("weight").alias("new"))
    old = weights.join(days, "d").where("next is not null").select(F.col("next").alias("d"), "i", F.col("weight").alias("old"))
    moved = F.sum(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2
    return new.join(old, ["d", "i"], "full").groupBy("d").agg(moved.alias("turnover"))


# --- sleeves -----------------------------------------------------------------------------------------------------


def cross_demands(demands: DataFrame) -> DataFrame:
    """(i, buyer, seller, quantity): buys and sells of one instrument meet, each side in the order of its sleeves.

    Every demand covers a stretch of its side's running total; a buy and a sell cross where their stretches overlap.
    Rows in: (i, sleeve, quantity), positive to buy.
    """
    line = W.partitionBy("i", F.col("quantity") > 0).orderBy("sleeve").rowsBetween(W.unboundedPreceding, 0)
    placed = demands.where("quantity <> 0").withColumn("end", F.sum(F.abs("quantity")).over(line)).withColumn("start", F.col("end") - F.abs("quantity"))
    b = placed.where("quantity > 0").select("i", F.col("sleeve").alias("buyer"), F.col("start").alias("bs"), F.col("end").alias("be"))
    s = placed.where("quantity < 0").select("i", F.col("sleeve").alias("seller"), F.col("start").alias("ss"), F.col("end").alias("se"))
    met = b.join(s, "i").where("bs < se and ss < be")
    return met.select("i", "buyer", "seller", (F.least("be", "se") - F.greatest("bs", "ss")).alias("quantity"))


def residual_orders(demands: DataFrame, crosses: DataFrame) -> DataFrame:
    """(i, sleeve, quantity): what is left of each demand after crossing."""
    used = crosses.select("i", F.col("buyer").alias("sleeve"), (-F.col("quantity")).alias("q")).unionByName(crosses.select("i", F.col("seller").alias("sleeve"), F.col("quantity").alias("q")))
    rows = demands.select("i", "sleeve", F.col("quantity").alias("q")).unionByName(used)
    return rows.groupBy("i", "sleeve").agg(F.sum("q").alias("quantity")).where("quantity <> 0")


def allocate_lots(orders: DataFrame, lot: int = 100) -> DataFrame:
    """Adds ``allocated``: a fill (i, filled) shared in whole lots by demand, largest remainders first, none above its demand."""
    by = W.partitionBy("i")
    share = F.col("filled") * F.col("demand") / F.sum("demand").over(by) / lot
    rows = orders.withColumn("__whole", F.floor(share) * lot).withColumn("__rest", share - F.floor(share))
    spare = F.floor((F.col("filled") - F.sum("__whole").over(by)) / lot)
    rows = rows.withColumn("__spare", spare).withColumn("__place", F.row_number().over(by.orderBy(F.desc("__rest"), "sleeve")))
    got = F.col("__whole") + F.when(F.col("__place") <= F.col("__spare"), F.lit(lot)).otherwise(0)
    return rows.withColumn("allocated", F.least(got, "demand").cast("long")).drop("__whole", "__rest", "__spare", "__place")


def split_costs(rows: DataFrame, keys: list[str], order: str, part: str, cost: str, digits: int = 2) -> DataFrame:
    """Adds ``share`` of ``cost`` in proportion to ``part``, rounded; the last row takes what rounding leaves."""
    by = W.partitionBy(*keys)
    raw = F.round(F.col(cost) * F.col(part) / F.sum(part).over(by), digits)
    w = by.orderBy(order)
    marked = rows.withColumn("__raw", raw).withColumn("__left", F.row_number().over(by.orderBy(F.desc(order))))
    before = F.coalesce(F.sum("__raw").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return marked.withColumn("share", F.round(F.when(F.col("__left") == 1, F.col(cost) - before).otherwise(F.col("__raw")), digits)).drop("__raw", "__left")
