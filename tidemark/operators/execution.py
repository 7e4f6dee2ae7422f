"""Fills and costs: one model, as column expressions for tables of orders and as a function for the account's loop."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite

COSTS = ("commission_bps", "minimum_commission", "sell_tax_bps", "buy_tax_bps", "transfer_fee_bps")

#: Costs where neither the run nor the market's rules know any; other asset types count as stocks.
DEFAULTS = {
    "stock": {"commission_bps": 2.5, "minimum_commission": 5.0, "sell_tax_bps": 5.0, "buy_tax_bps": 0.0, "transfer_fee_bps": 0.1},
    "etf": {"commission_bps": 2.5, "minimum_commission": 5.0, "sell_tax_bps": 0.0, "buy_tax_bps": 0.0, "transfer_fee_bps": 0.0},
}


def resolve_costs(orders: DataFrame, overrides: Mapping[str, float] | None = None, by_asset: Mapping[str, Mapping[str, float]] | None = None, defaults: Mapping[str, Mapping[str, float]] = DEFAULTS) -> DataFrame:
    """Adds each cost and where it came from: the run's value, its value for the asset type, the rule's, the default.

    A run's sell tax is one on stocks only. Values that are null, NaN or infinite do not count as known.
    """
    stock = F.col("asset_type") == "stock"
    known = {}
    for c in COSTS:
        run = F.lit((overrides or {}).get(c)).cast("double")
        own = F.lit(None).cast("double")
        for asset, costs in (by_asset or {}).items():
            own = F.when(F.col("asset_type") == asset, F.lit(costs.get(c)).cast("double")).otherwise(own)
        last = F.lit(defaults["stock"][c])
        for asset, costs in defaults.items():
            last = F.when(F.col("asset_type") == asset, F.lit(costs[c])).otherwise(last)
        chain = [
            (finite(F.when(stock, run) if c == "sell_tax_bps" else run), "run"),
            (finite(own), "asset"),
            *([(finite(F.col(c).cast("double")), "rule")] if c in orders.columns else []),
            (last, "default"),
        ]
        known[c] = F.coalesce(*[v for v, _ in chain])
        known[f"{c}_from"] = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, name in chain])
    return orders.withColumns(known)


def costs_of(asset: str, overrides: Mapping[str, float] | None = None, by_asset: Mapping | None = None, rule: Mapping | None = None, defaults: Mapping = DEFAULTS) -> dict[str, float]:
    """The same chain for one order."""

    def sure(x) -> float | None:
        return float(x) if x is not None and math.isfinite(x) else None

    out = {}
    for c in COSTS:
        run = None if c == "sell_tax_bps" and asset != "stock" else (overrides or {}).get(c)
        chain = [run, (by_asset or {}).get(asset, {}).get(c), (rule or {}).get(c)]
        out[c] = next((v for v in map(sure, chain) if v is not None), defaults.get(asset, defaults["stock"])[c])
    return out


@dataclass(frozen=True)
class Impact:
    """How much of a day's volume an order may take, and what it pays for that, in basis points."""

    participation: float = 0.1
    slippage: float = 0.0
    per_root: float = 10.0
    most: float = 200.0


def fills(orders: DataFrame, impact: Impact = Impact()) -> DataFrame:
    """Orders (side 1 or -1, quantity, lot, price, high, low, limits, volume, amount, paused, costs) with their fills.

    A rejected order says why and fills nothing. The price moves by the slippage and an impact that grows with the
    square root of the order's share of the day's amount, and stays within the day's range and limits.
    """
    c = F.col
    capacity = F.floor(c("volume") * impact.participation / c("lot")) * c("lot")
    reason = (
        F.when(c("price").isNull(), "no_bar")
        .when(F.coalesce(c("paused"), F.lit(False)) | (c("volume") <= 0), "halted")
        .when((c("side") > 0) & (c("low") >= c("limit_up") - 1e-12), "limit_up")
        .when((c("side") < 0) & (c("high") <= c("limit_down") + 1e-12), "limit_down")
        .when(F.floor(F.least("quantity", capacity) / c("lot")) < 1, "below_one_lot")
    )
    rows = orders.withColumn("reason", reason)
    rows = rows.withColumn("filled", F.when(c("reason").isNull(), F.floor(F.least("quantity", capacity) / c("lot")) * c("lot")).otherwise(0).cast("long"))
    share = c("filled") * c("price") / F.greatest("amount", F.lit(1e-12))
    bps = F.lit(impact.slippage) + F.least(F.lit(impact.most), F.lit(impact.per_root) * F.sqrt(share))
    moved = c("price") * (1 + c("side") * bps / 10000)
    low, high = F.greatest(c("low"), F.coalesce("limit_down", "low")), F.least(c("high"), F.coalesce("limit_up", "high"))
    rows = rows.withColumn("fill_price", F.when(c("filled") > 0, F.least(F.greatest(moved, low), high)))
    notional = c("filled") * c("fill_price")
    fee = F.greatest(c("minimum_commission"), notional * (c("commission_bps") + c("transfer_fee_bps")) / 1e4)
    tax = notional * F.when(c("side") > 0, c("buy_tax_bps")).otherwise(c("sell_tax_bps")) / 1e4
    some = c("filled") > 0
    return rows.withColumns({"commission": F.when(some, fee).otherwise(0.0), "tax": F.when(some, tax).otherwise(0.0), "slippage": F.when(some, F.abs(c("fill_price") - c("price")) * c("filled")).otherwise(0.0)})


def fees(side: int, notional: float, costs: Mapping[str, float]) -> tuple[float, float]:
    """(commission, tax) of a fill."""
    if notional <= 0:
        return 0.0, 0.0
    rate = costs["buy_tax_bps"] if side > 0 else costs["sell_tax_bps"]
    return max(costs["minimum_commission"], notional * (costs["commission_bps"] + costs["transfer_fee_bps"]) / 1e4), notional * rate / 1e4


def fill_order(side: int, quantity: int, price: float | None, lot: int, bar: Mapping | None, costs: Mapping[str, float], impact: Impact = Impact()) -> tuple[int, float, float, float, str]:
    """(filled, price, commission, tax, reason) of one order, as :func:`fills` gives them; no reason means it may trade."""
    if bar is None or price is None:
        return 0, 0.0, 0.0, 0.0, "no_bar"
    up, down = bar.get("limit_up"), bar.get("limit_down")
    room = min(quantity, math.floor(bar["volume"] * impact.participation / lot) * lot) // lot * lot
    if bar["paused"] or bar["volume"] <= 0:
        reason = "halted"
    elif side > 0 and up is not None and bar["low"] >= up - 1e-12:
        reason = "limit_up"
    elif side < 0 and down is not None and bar["high"] <= down + 1e-12:
        reason = "limit_down"
    elif room < lot:
        reason = "below_one_lot"
    else:
        bps = impact.slippage + min(impact.most, impact.per_root * math.sqrt(room * price / max(bar["amount"], 1e-12)))
        low, high = bar["low"] if down is None else max(bar["low"], down), bar["high"] if up is None else min(bar["high"], up)
        at = min(max(price * (1 + side * bps / 10000), low), high)
        return int(room), at, *fees(side, room * at, costs), ""
    return 0, 0.0, 0.0, 0.0, reason


def hold_limit_up(orders: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Adds ``hold``: why a sell at the close is kept back, or null.

    An active security that closes at its upper limit is held; without a known limit the rule cannot decide and the
    order is rejected too.
    """
    c = F.col
    applies = (c("side") < 0) & (c("phase") == "close") & ~F.coalesce("paused", F.lit(False)) & (c("volume") > 0)
    rule = F.when(c("limit_up").isNull(), "missing_limit_up_for_hold_rule").when(c("close") >= c("limit_up") - tolerance, "strategy_hold_limit_up")
    return orders.withColumn("hold", F.when(applies, rule))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that raises at run time where a key is not unique on a side; no pass of its own looks for that."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn(name, F.when(n > 1, F.raise_error(F.lit(f"key is not unique: {', '.join(keys)}")).cast("int")).otherwise(1))

    return counted(left, "__l").join(counted(right, "__r"), keys).where("__l = 1 and __r = 1").drop("__l", "__r")
