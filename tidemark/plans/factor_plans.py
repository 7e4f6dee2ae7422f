"""Factors and technical features, each against its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import factors as fac
from tidemark.operators.technical import cross_section, features
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, DENSE, GRID, VALUATION, actions, bars, calendar, dense_bars, grid, valuation, with_views
from tidemark.plans.windowed import trend_body

#: Session returns: null over gaps, 0 on paused days.
R = """rows AS (SELECT b.*, c.idx, circulating_cap AS cap FROM bars b JOIN cal c USING (d) JOIN valuation v USING (d, i)),
ret AS (SELECT *, CASE WHEN r0 IS NULL THEN NULL WHEN paused THEN 0 ELSE r0 END AS r FROM (
  SELECT *, CASE WHEN lag(idx) OVER w = idx - 1 THEN close / lag(close) OVER w - 1 END AS r0, CASE WHEN lag(idx) OVER w = idx - 1 THEN lag(cap) OVER w END AS pw FROM rows WINDOW w AS (PARTITION BY i ORDER BY idx)))"""


def _s(n: int) -> str:
    return f"(PARTITION BY i ORDER BY idx RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rounded(df, digits=6):
    return df.select("d", "i", F.round("value", digits).alias("value"))


def _risk(spark, sf_dir):
    own = dense_bars(spark, sf_dir)
    returns = fac.session_returns(own, calendar(spark, sf_dir))
    return returns.join(valuation(own).select("d", "i", F.col("circulating_cap").alias("cap")), ["d", "i"])


def _risk_sql(value: str, n: int, need: int, digits: int = 6) -> str:
    return with_views(f"{R}\nSELECT d, i, round(v, {digits}) AS value FROM (SELECT d, i, idx, count(r) OVER w AS n, {value} AS v FROM ret WINDOW w AS {_s(n)}) WHERE n >= {need} AND idx > {n} AND v IS NOT NULL", DENSE, CALENDAR, VALUATION)


@query("fac_01_return", with_views("SELECT d, i, round(v, 6) AS value FROM (SELECT d, i, close / lag(close, 5) OVER (PARTITION BY i ORDER BY d) - 1 AS v FROM bars) WHERE v IS NOT NULL", BARS))
def fac_01(spark, sf_dir):
    return _rounded(fac.two_point_return(bars(spark, sf_dir), 5))


@query("fac_02_momentum", with_views("SELECT d, i, round(v, 6) AS value FROM (SELECT d, i, close / lag(close, 60) OVER (PARTITION BY i ORDER BY d) - 1 AS v FROM bars) WHERE v IS NOT NULL", BARS))
def fac_02(spark, sf_dir):
    return _rounded(fac.two_point_return(bars(spark, sf_dir), 60))


@query("fac_03_median_amount", with_views("SELECT d, i, round(v, 4) AS value FROM (SELECT d, i, CASE WHEN count(amount) OVER w >= 20 THEN median(amount) OVER w END AS v FROM bars WINDOW w AS (PARTITION BY i ORDER BY d ROWS 19 PRECEDING)) WHERE v IS NOT NULL", BARS))
def fac_03(spark, sf_dir):
    return _rounded(fac.median_amount(bars(spark, sf_dir), 20), 4)


@query("fac_04_composite", with_views("""x AS (SELECT d, i, close / lag(close, 5) OVER (PARTITION BY i ORDER BY d) - 1 AS a, close / lag(close, 20) OVER (PARTITION BY i ORDER BY d) - 1 AS b FROM bars)
SELECT d, i, round(a * 0.7::DOUBLE + b * 0.3::DOUBLE, 6) AS value FROM x WHERE a IS NOT NULL AND b IS NOT NULL""", BARS))
def fac_04(spark, sf_dir):
    b = bars(spark, sf_dir)
    return _rounded(fac.composite([(fac.two_point_return(b, 5), 0.7), (fac.two_point_return(b, 20), 0.3)]))


@query("fac_06_log_growth", with_views("""rows AS (SELECT b.i, b.d, c.idx, ln(b.amount) AS l FROM bars b JOIN cal c USING (d))
SELECT a.d, a.i, round(a.l - b.l, 6) AS value FROM rows a JOIN rows b ON a.i = b.i AND b.idx = a.idx - 252""", BARS, CALENDAR))
def fac_06(spark, sf_dir):
    return _rounded(fac.log_growth(bars(spark, sf_dir).select("d", "i", F.col("amount").alias("level")), calendar(spark, sf_dir)))


@query("fac_07_reciprocal", with_views("SELECT d, i, round(1.0::DOUBLE / close, 10) AS value FROM bars WHERE close > 0", BARS))
def fac_07(spark, sf_dir):
    return bars(spark, sf_dir).where("close > 0").select("d", "i", F.round(F.lit(1.0) / F.col("close"), 10).alias("value"))


@query("fac_08_dividend_continuity", with_views("""cells AS (SELECT DISTINCT g.d, b.i FROM grid g JOIN (SELECT DISTINCT i FROM bars) b ON true)
SELECT c.d, c.i, count(DISTINCT floor((c.d - a.ex) / 365)) AS value FROM cells c LEFT JOIN (SELECT * FROM actions WHERE active AND kind = 'cash_dividend' AND announced <= ex) a ON a.i = c.i AND a.ex <= c.d AND c.d - a.ex < 1095 GROUP BY 1, 2""", BARS, CALENDAR, GRID, ACTIONS))
def fac_08(spark, sf_dir):
    cells = bars(spark, sf_dir).select("i").distinct().crossJoin(F.broadcast(grid(spark, sf_dir)))  # instruments x month ends, as asked for
    return fac.dividend_continuity(cells, actions(spark, sf_dir))


_PAIRS = f"""mkt AS (SELECT d, sum(pw * r) / sum(pw) AS m FROM ret WHERE r IS NOT NULL AND pw > 0 GROUP BY d),
p AS (SELECT ret.*, m, CASE WHEN r IS NOT NULL AND m IS NOT NULL THEN pow(2.0::DOUBLE, idx / 63.0::DOUBLE) END AS w FROM ret LEFT JOIN mkt USING (d)),
s AS (SELECT d, i, idx, count(w) OVER f AS n, sum(w) OVER f AS sw, sum(w * m) OVER f AS sx, sum(w * r) OVER f AS sy, sum(w * m * m) OVER f AS sxx, sum(w * m * r) OVER f AS sxy, sum(w * r * r) OVER f AS syy FROM p WINDOW f AS {_s(252)})"""


@query("fac_09_beta", with_views(f"{R},\n{_PAIRS}\nSELECT d, i, round((sxy - sx * sy / sw) / (sxx - sx * sx / sw), 5) AS value FROM s WHERE sw > 0 AND n >= 21 AND idx > 252 AND sxx - sx * sx / sw > 0", DENSE, CALENDAR, VALUATION))
def fac_09(spark, sf_dir):
    return _rounded(fac.beta(_risk(spark, sf_dir)), 5)


@query("fac_10_total_volatility", _risk_sql("stddev_samp(r) OVER w * sqrt(252.0::DOUBLE)", 120, 96))
def fac_10(spark, sf_dir):
    return _rounded(fac.total_volatility(_risk(spark, sf_dir), 120, 96))


@query("fac_11_downside_volatility", _risk_sql("sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END) OVER w * 252)", 252, 202))
def fac_11(spark, sf_dir):
    return _rounded(fac.downside_volatility(_risk(spark, sf_dir), 252, 202))


@query("fac_12_worst_loss", with_views(f"{R}\nSELECT d, i, round(-list_sum(list_sort(c)[1:5]) / 5, 6) AS value FROM (SELECT d, i, idx, list(r) FILTER (WHERE r IS NOT NULL) OVER {_s(252)} AS c FROM ret) WHERE len(c) >= 202 AND idx > 252", DENSE, CALENDAR, VALUATION))
def fac_12(spark, sf_dir):
    return _rounded(fac.worst_loss(_risk(spark, sf_dir), 252, 202))


@query("fac_13_residual_volatility", with_views(f"{R},\n{_PAIRS}\nSELECT d, i, round(sqrt(greatest((syy - sy * sy / sw) - pow(sxy - sx * sy / sw, 2) / (sxx - sx * sx / sw), 0) / sw * 252), 5) AS value FROM s WHERE sw > 0 AND n >= 202 AND idx > 252 AND sxx - sx * sx / sw > 0", DENSE, CALENDAR, VALUATION))
def fac_13(spark, sf_dir):
    return _rounded(fac.residual_volatility(_risk(spark, sf_dir)), 5)


@query("fac_14_volatility_of_volatility", with_views(f"""{R},
v AS (SELECT d, i, idx, CASE WHEN count(r) OVER w >= 16 AND idx > 20 THEN stddev_samp(r) OVER w END AS vol FROM ret WINDOW w AS {_s(20)})
SELECT d, i, round(x, 6) AS value FROM (SELECT d, i, idx, count(vol) OVER w AS n, stddev_samp(vol) OVER w / nullif(avg(vol) OVER w, 0) AS x FROM v WINDOW w AS {_s(252)}) WHERE n >= 202 AND idx > 252 AND x IS NOT NULL""", DENSE, CALENDAR, VALUATION))
def fac_14(spark, sf_dir):
    return _rounded(fac.volatility_of_volatility(_risk(spark, sf_dir)))


@query("fac_22_market_return", with_views(f"{R}\nSELECT d, round(sum(pw * r) / sum(pw), 8) AS m FROM ret WHERE r IS NOT NULL AND pw > 0 GROUP BY d", DENSE, CALENDAR, VALUATION))
def fac_22(spark, sf_dir):
    return fac.market_return(_risk(spark, sf_dir)).select("d", F.round("m", 8).alias("m"))


@query("fac_25_momentum_6_1", with_views(f"""days AS (SELECT b.*, c.idx AS n FROM bars b JOIN cal c USING (d)),
l AS (SELECT * FROM (SELECT i, d, n, list(close) OVER (PARTITION BY i ORDER BY n RANGE BETWEEN 139 PRECEDING AND 20 PRECEDING) AS c FROM days) WHERE len(c) = 120 AND n >= 140),
{trend_body("l", 120)}
SELECT d, i, round((exp(250 * slope) - 1) * r2, 4) AS value FROM s3""", DENSE, CALENDAR))
def fac_25(spark, sf_dir):
    return _rounded(fac.momentum_6_1(dense_bars(spark, sf_dir).join(calendar(spark, sf_dir), "d")), 4)


#: The features whose SQL form fits a line, over active bars.
_TECH = {
    "vol_ratio": "CASE WHEN count(ret) OVER w30 >= 30 AND stddev_pop(ret) OVER w30 > 0 THEN stddev_pop(ret) OVER w10 / stddev_pop(ret) OVER w30 ELSE 1 END",
    "ret_1d": "close / lag(close, 1) OVER w - 1",
    "ret_20d": "close / lag(close, 20) OVER w - 1",
    "close_over_ma20": "CASE WHEN count(close) OVER b20 >= 20 THEN close / avg(close) OVER b20 - 1 END",
    "bollinger_z_20": "CASE WHEN count(close) OVER w20 >= 20 AND stddev_pop(close) OVER w20 <> 0 THEN (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 END",
    "rsi_14": "CASE WHEN count(up) OVER w14 >= 14 AND avg(up) OVER w14 + avg(down) OVER w14 > 1e-15 THEN 100 * avg(up) OVER w14 / (avg(up) OVER w14 + avg(down) OVER w14) ELSE 50 END",
    "ma_cross_5_20": "CASE WHEN count(close) OVER w20 >= 20 THEN avg(close) OVER w5 / avg(close) OVER w20 - 1 END",
    "realized_vol_20": "CASE WHEN count(ret) OVER w20 >= 20 THEN stddev_pop(ret) OVER w20 * sqrt(252) END",
    "downside_vol_20": "CASE WHEN count(ret) OVER w20 >= 20 THEN sqrt(avg(pow(least(ret, 0), 2)) OVER w20) * sqrt(252) END",
    "drawdown_from_high_20": "CASE WHEN count(high) OVER b20 >= 20 THEN close / max(high) OVER b20 - 1 END",
    "atr_ratio_14": "CASE WHEN count(tr) OVER w14 >= 14 THEN avg(tr) OVER w14 / close END",
    "vol_ratio_recent_hist": "CASE WHEN count(volume) OVER b7 >= 7 AND avg(volume) OVER b7 > 0 THEN avg(volume) OVER w3 / avg(volume) OVER b7 ELSE 0 END",
    "vol_ratio_20": "CASE WHEN count(volume) OVER b20 >= 20 AND avg(volume) OVER b20 > 0 THEN volume / avg(volume) OVER b20 ELSE 0 END",
    "money_ratio_5_20": "CASE WHEN count(amount) OVER w20 >= 20 AND avg(amount) OVER w20 > 0 THEN avg(amount) OVER w5 / avg(amount) OVER w20 - 1 END",
    "amihud_illiquidity_20": "CASE WHEN count(ret) OVER w20 >= 20 THEN avg(abs(ret) / amount) OVER w20 * 1e8 END",
    "upper_shadow_ratio": "CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END",
    "body_ratio": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END",
    "overnight_gap": "open / prev - 1",
}
_FRAMES = {"w": "", **{f"w{n}": f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" for n in (3, 5, 10, 14, 20, 30)}, "b20": "ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING", "b7": "ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING"}
_TECH_SQL = f"""act AS (SELECT *, lag(close) OVER (PARTITION BY i ORDER BY d) AS prev FROM bars WHERE NOT paused),
t AS (SELECT *, close / prev - 1 AS ret, CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS down,
  CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM act)
SELECT d, i, {", ".join(f"round({x} + 1e-9, 5) AS {k}" for k, x in _TECH.items())} FROM t
WINDOW {", ".join(f"{k} AS (PARTITION BY i ORDER BY d {f})" for k, f in _FRAMES.items())}"""


@query("technical_features", with_views(_TECH_SQL, BARS))
def technical(spark, sf_dir):
    return features(bars(spark, sf_dir)).select("d", "i", *[F.round(F.col(k) + F.lit(1e-9), 5).alias(k) for k in _TECH])


@query("technical_all")
def technical_all(spark, sf_dir):
    """All features, those within a day's cross-section too; tests compare them with numpy."""
    return cross_section(features(bars(spark, sf_dir)))
