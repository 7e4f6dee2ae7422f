"""The published factors by name: each a function of the market's tables that gives (d, i, value).

Values of statements are step functions, so every factor is cut to the sessions on which an instrument is listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_backward, metric_steps
from tidemark.functions.scalar import finite, prior_year, ratio
from tidemark.operators import factors as fac

#: The periods for which profit, cash flow and return on equity are published.
PERIODS = ("ytd", "single_quarter", "ttm")


@dataclass(frozen=True)
class Market:
    """What factors read: bars, calendar (d, idx), instruments (i, listed, delisted), valuation (d, i, dividend_yield,
    market_cap, circulating_cap, pe, pb), metrics (i, code, basis, period, available, id, value), actions."""

    bars: DataFrame
    calendar: DataFrame
    instruments: DataFrame
    valuation: DataFrame
    metrics: DataFrame
    actions: DataFrame

    def cells(self) -> DataFrame:
        """(i, d): the sessions of each instrument while it is listed; the calendar is one array per instrument."""
        days = self.calendar.agg(F.array_sort(F.collect_set("d")).alias("days"))  # one row, as long as the history
        inside = lambda x: (x >= F.col("listed")) & (F.col("delisted").isNull() | (x < F.col("delisted")))
        return self.instruments.join(F.broadcast(days)).select("i", F.explode(F.filter("days", inside)).alias("d"))

    def listed(self, rows: DataFrame) -> DataFrame:
        """``rows`` within listing windows, without values that are null or not finite."""
        window = (F.col("d") >= F.col("listed")) & (F.col("delisted").isNull() | (F.col("d") < F.col("delisted")))
        met = rows.join(self.instruments.select("i", "listed", "delisted"), "i").where(window)
        return met.select("d", "i", finite(F.col("value")).alias("value")).where("value is not null")

    def metric(self, code: str, basis: str, cells: DataFrame | None = None, day: str = "d") -> DataFrame:
        """``cells`` with the ``value`` of a metric known on ``day``: the newest period, not the newest row."""
        rows = self.metrics.where((F.col("code") == code) & (F.col("basis") == basis))
        steps = metric_steps(rows, ["i"], "period", "available", "id", "value")
        return asof_backward(self.cells() if cells is None else cells, steps, ["i"], day, "eligible", ["value"])


def from_valuation(value: Callable[[], Column]) -> Callable[[Market], DataFrame]:
    return lambda m: m.listed(m.valuation.select("d", "i", value().alias("value")))


def metric_value(code: str, basis: str) -> Callable[[Market], DataFrame]:
    return lambda m: m.metric(code, basis).where("value is not null").select("d", "i", "value")


def return_on_equity(basis: str) -> Callable[[Market], DataFrame]:
    """Profit by equity; no equity is unknown, and a loss by negative equity stays positive."""

    def build(m: Market) -> DataFrame:
        both = m.metric("equity_parent", "instant", m.metric("net_profit_parent", basis).withColumnRenamed("value", "profit"))
        return both.select("d", "i", finite(ratio(F.col("profit"), F.col("value"))).alias("value")).where("value is not null")

    return build


def asset_growth(m: Market) -> DataFrame:
    """Total assets as known on a day by those known a year before, both positive."""
    now = m.metric("total_assets", "instant").withColumnRenamed("value", "now").withColumn("then", prior_year(F.col("d")))
    both = m.metric("total_assets", "instant", now, "then")
    return both.where("now > 0 and value > 0").select("d", "i", (F.col("now") / F.col("value") - 1).alias("value"))


def dividend_funding(code: str, payout: bool) -> Callable[[Market], DataFrame]:
    """Dividends paid (yield times market value) by a metric that must be positive, or the metric by such dividends."""

    def build(m: Market) -> DataFrame:
        rows = m.listed(m.valuation.select("d", "i", (F.col("dividend_yield") * F.col("market_cap")).alias("value"))).withColumnRenamed("value", "cash")
        rows = m.metric(code, "ttm", rows)
        top, below = ("cash", "value") if payout else ("value", "cash")
        return rows.where(F.col(below) > 0).select("d", "i", finite(F.col(top) / F.col(below)).alias("value")).where("value is not null")

    return build


def yield_history(anomaly: bool) -> Callable[[Market], DataFrame]:
    """The median month-end yield of three years as known on each session, or the current yield by it."""

    def build(m: Market) -> DataFrame:
        raw = m.valuation.select("d", "i", F.col("dividend_yield").alias("value"))
        monthly = fac.month_end_median(raw, m.calendar).select("i", F.col("d").alias("at"), F.col("value").alias("mid"))
        rows = asof_backward(m.cells(), monthly, ["i"], "d", "at", ["mid"])
        if anomaly:
            rows = rows.join(raw, ["d", "i"]).withColumn("mid", ratio(F.col("value"), F.col("mid"))).drop("value")
        return rows.select("d", "i", finite(F.col("mid")).alias("value")).where("value is not null")

    return build


def level_growth(level: Callable[[], Column]) -> Callable[[Market], DataFrame]:
    return lambda m: m.listed(fac.log_growth(m.valuation.select("d", "i", level().alias("level")), m.calendar))


def _returns(m: Market) -> DataFrame:
    """Session returns with the market value of the session before as ``cap``."""
    rows = fac.session_returns(m.bars, m.calendar)
    return rows.join(m.valuation.select("d", "i", F.col("circulating_cap").alias("cap")), ["d", "i"], "left")


def risk(build: Callable[[DataFrame], DataFrame]) -> Callable[[Market], DataFrame]:
    return lambda m: m.listed(build(_returns(m)))


def _momentum(m: Market) -> DataFrame:
    return m.listed(fac.momentum_6_1(m.bars.join(m.calendar, "d")))


def _continuity(m: Market) -> DataFrame:
    return m.listed(fac.dividend_continuity(m.cells(), m.actions).withColumn("value", F.col("value").cast("double")))


def catalog() -> dict[str, Callable[[Market], DataFrame]]:
    """The 35 factors in their order of publication."""
    c = F.col
    cash = lambda: c("dividend_yield") * c("market_cap")
    found = [
        ("dividend_yield_l12m", from_valuation(lambda: c("dividend_yield"))),
        ("dividend_cash_log_growth_1y", level_growth(cash)),
        ("market_value_log_growth_1y", level_growth(lambda: c("market_cap"))),
        ("dividend_yield_log_change_1y", level_growth(lambda: c("dividend_yield"))),
        ("earnings_yield_ttm", from_valuation(lambda: F.when(c("pe") > 0, 1 / c("pe")))),
        ("pb_ratio", from_valuation(lambda: F.when(c("pb") > 0, c("pb")))),
        ("beta_252_hl63", risk(fac.beta)),
        ("total_volatility_120", risk(lambda r: fac.total_volatility(r, 120, 96))),
        ("total_volatility_252", risk(lambda r: fac.total_volatility(r, 252, 202))),
        ("residual_volatility_252_hl63", risk(fac.residual_volatility)),
        ("downside_volatility_252", risk(lambda r: fac.downside_volatility(r, 252, 202))),
        ("worst5_loss_252", risk(lambda r: fac.worst_loss(r, 252, 202))),
        ("volatility_of_volatility_20_252", risk(fac.volatility_of_volatility)),
        ("dividend_continuity_3y", _continuity),
        ("dividend_yield_median_3y", yield_history(False)),
        ("dividend_yield_anomaly_3y", yield_history(True)),
        ("dividend_payout_ratio_ttm", dividend_funding("net_profit", True)),
        ("dividend_ocf_coverage_ttm", dividend_funding("operating_cash_flow", False)),
        ("dividend_fcf_coverage_ttm", dividend_funding("free_cash_flow", False)),
        ("net_profit_ttm_yoy", metric_value("net_profit_parent_yoy", "ttm")),
        ("operating_cash_flow_ttm_yoy", metric_value("operating_cash_flow_yoy", "ttm")),
        ("revenue_ttm", metric_value("revenue", "ttm")),
        ("revenue_ttm_yoy", metric_value("revenue_yoy", "ttm")),
        ("roa_ttm", metric_value("roa", "ttm")),
        ("asset_growth_1y", asset_growth),
        ("momentum_6_1", _momentum),
        *((f"net_profit_{p}", metric_value("net_profit", p)) for p in PERIODS),
        *((f"operating_cash_flow_{p}", metric_value("operating_cash_flow", p)) for p in PERIODS),
        *((f"roe_{p}", return_on_equity(p)) for p in PERIODS),
    ]
    by_name = dict(found)
    if len(by_name) != len(found):
        raise ValueError("two factors share a name")
    return by_name
