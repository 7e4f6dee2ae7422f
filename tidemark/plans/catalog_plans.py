"""One query per published factor that reads valuation or statements, each against its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.catalog import PERIODS, Market, catalog
from tidemark.plans.registry import query
from tidemark.plans.views import CALENDAR, DENSE, INSTRUMENTS, METRICS, VALUATION, actions, calendar, dense_bars, instruments, metrics, valuation, with_views

#: The test tables have three order statuses and five priorities; they stand for metric codes and bases.
CODES = {"net_profit": "F", "net_profit_parent": "F", "net_profit_parent_yoy": "F", "revenue": "F", "roa": "F", "operating_cash_flow": "O", "operating_cash_flow_yoy": "O", "revenue_yoy": "O", "free_cash_flow": "P", "equity_parent": "O", "total_assets": "O"}
BASES = {"ytd": "1-URGENT", "single_quarter": "2-HIGH", "ttm": "3-MEDIUM", "instant": "5-LOW"}


def market(spark, sf_dir) -> Market:
    own, named = dense_bars(spark, sf_dir), metrics(spark, sf_dir)
    told = [named.where((F.col("code") == c) & (F.col("basis") == b)).withColumns({"code": F.lit(code), "basis": F.lit(basis)}) for code, c in CODES.items() for basis, b in BASES.items()]
    rows = told[0]
    for more in told[1:]:
        rows = rows.unionByName(more)
    return Market(own, calendar(spark, sf_dir), instruments(spark, sf_dir).where("i < 5"), valuation(own), rows, actions(spark, sf_dir))


CELLS = """cells AS (SELECT n.i, c.d FROM instruments n JOIN cal c ON c.d >= listed AND (delisted IS NULL OR c.d < delisted) WHERE n.i < 5),
listing AS (SELECT v.* FROM valuation v JOIN cells USING (i, d))"""
VIEWS = (DENSE, CALENDAR, INSTRUMENTS, VALUATION, METRICS)


def known(name: str, code: str, basis: str, day: str = "c.d") -> str:
    """A view (i, d, value): the metric known on a day that depends on the cell's."""
    return f"""{name} AS (SELECT c.i, c.d, arg_max(value, (period, available, id)) AS value FROM cells c JOIN metrics m
  ON m.i = c.i AND m.available <= {day} AND m.period <= {day} AND m.code = '{CODES[code]}' AND m.basis = '{BASES[basis]}' GROUP BY 1, 2)"""


def metric_sql(code: str, basis: str) -> str:
    return with_views(f"{CELLS}, {known('k', code, basis)}\nSELECT d, i, round(value, 6) AS value FROM k", *VIEWS)


def valuation_sql(value: str) -> str:
    return with_views(f"{CELLS}\nSELECT d, i, round({value}, 6) AS value FROM listing WHERE ({value}) IS NOT NULL", *VIEWS)


def growth_sql(level: str) -> str:
    return with_views(f"""{CELLS}, l AS (SELECT v.i, v.d, idx, CASE WHEN {level} > 0 THEN ln({level}) END AS l FROM valuation v JOIN cal USING (d))
SELECT a.d, a.i, round(a.l - b.l, 6) AS value FROM l a JOIN cells USING (i, d) JOIN l b ON b.i = a.i AND b.idx = a.idx - 252 WHERE a.l - b.l IS NOT NULL""", *VIEWS)


def funding_sql(code: str, payout: bool) -> str:
    value, least = ("cash / value", "value") if payout else ("value / cash", "cash")
    return with_views(f"""{CELLS}, {known('k', code, 'ttm')}
SELECT d, i, round({value}, 9) AS value FROM (SELECT i, d, dividend_yield * market_cap AS cash, value FROM listing JOIN k USING (i, d)) WHERE {least} > 0""", *VIEWS)


_MID = f"""{CELLS}, ends AS (SELECT d, row_number() OVER (ORDER BY d) AS m FROM (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM cal) WHERE month(nx) <> month(d) OR year(nx) <> year(d)),
e AS (SELECT i, d, median(dividend_yield) OVER w AS mid, count(dividend_yield) OVER w AS n FROM valuation JOIN ends USING (d) WINDOW w AS (PARTITION BY i ORDER BY m RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)),
mid AS (SELECT c.i, c.d, arg_max(e.mid, e.d) AS mid FROM cells c JOIN e ON e.i = c.i AND e.d <= c.d AND e.n >= 24 GROUP BY 1, 2)"""

SQL = {
    "dividend_yield_l12m": valuation_sql("dividend_yield"),
    "dividend_cash_log_growth_1y": growth_sql("dividend_yield * market_cap"),
    "market_value_log_growth_1y": growth_sql("market_cap"),
    "dividend_yield_log_change_1y": growth_sql("dividend_yield"),
    "earnings_yield_ttm": valuation_sql("CASE WHEN pe > 0 THEN 1 / pe END"),
    "pb_ratio": valuation_sql("CASE WHEN pb > 0 THEN pb END"),
    "dividend_yield_median_3y": with_views(f"{_MID}\nSELECT d, i, round(mid, 6) AS value FROM mid", *VIEWS),
    "dividend_yield_anomaly_3y": with_views(f"{_MID}\nSELECT d, i, round(dividend_yield / mid, 6) AS value FROM mid JOIN valuation USING (i, d) WHERE mid <> 0", *VIEWS),
    "dividend_payout_ratio_ttm": funding_sql("net_profit", True),
    "dividend_ocf_coverage_ttm": funding_sql("operating_cash_flow", False),
    "dividend_fcf_coverage_ttm": funding_sql("free_cash_flow", False),
    "net_profit_ttm_yoy": metric_sql("net_profit_parent_yoy", "ttm"),
    "operating_cash_flow_ttm_yoy": metric_sql("operating_cash_flow_yoy", "ttm"),
    "revenue_ttm": metric_sql("revenue", "ttm"),
    "revenue_ttm_yoy": metric_sql("revenue_yoy", "ttm"),
    "roa_ttm": metric_sql("roa", "ttm"),
    "asset_growth_1y": with_views(f"""{CELLS}, {known('a', 'total_assets', 'instant')}, {known('b', 'total_assets', 'instant', '(c.d - INTERVAL 1 YEAR)::DATE')}
SELECT d, i, round(a.value / b.value - 1, 6) AS value FROM a JOIN b USING (i, d) WHERE a.value > 0 AND b.value > 0""", *VIEWS),
    **{f"net_profit_{p}": metric_sql("net_profit", p) for p in PERIODS},
    **{f"operating_cash_flow_{p}": metric_sql("operating_cash_flow", p) for p in PERIODS},
    **{f"roe_{p}": with_views(f"""{CELLS}, {known('p', 'net_profit_parent', p)}, {known('e', 'equity_parent', 'instant')}
SELECT d, i, round(p.value / e.value, 6) AS value FROM p JOIN e USING (i, d) WHERE e.value <> 0""", *VIEWS) for p in PERIODS},
}
#: Identifiers of the survey by factor; risk factors and momentum have queries of their own on bars.
GROUPS = {"dividend_yield_l12m": "05", "dividend_cash_log_growth_1y": "06", "market_value_log_growth_1y": "06", "dividend_yield_log_change_1y": "06", "earnings_yield_ttm": "07", "pb_ratio": "07", "dividend_yield_median_3y": "15", "dividend_yield_anomaly_3y": "15", "dividend_payout_ratio_ttm": "16", "dividend_ocf_coverage_ttm": "17", "dividend_fcf_coverage_ttm": "17", "net_profit_ttm_yoy": "18", "operating_cash_flow_ttm_yoy": "18", "revenue_ttm": "18", "revenue_ttm_yoy": "18", "roa_ttm": "18", "asset_growth_1y": "21"}


def _register(name: str, sql: str) -> None:
    number = GROUPS.get(name) or ("20" if name.startswith("roe") else "19")
    digits = 9 if "coverage" in name or "payout" in name else 6

    @query(f"fac_{number}_{name}", sql)
    def build(spark, sf_dir):
        return catalog()[name](market(spark, sf_dir)).select("d", "i", F.round("value", digits).alias("value"))


for _name, _sql in SQL.items():
    _register(_name, _sql)


@query("fac_23_catalog")
def fac_23(spark, sf_dir):
    """The published names with their places; a list of the library, not of data."""
    return spark.createDataFrame([(k, name) for k, name in enumerate(catalog(), 1)], "place long, name string")
