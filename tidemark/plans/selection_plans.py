"""Universes, portfolio construction under limits, training splits and execution rules."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import change, series
from tidemark.operators import execution as exe
from tidemark.operators import ml
from tidemark.operators import portfolio as por
from tidemark.operators import universe as uni
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, GRID, INSTRUMENTS, MEMBERSHIP, actions, bars, calendar, grid, instruments, membership, table, with_views

_PANEL = """panel AS (SELECT i, d, ln(close / lag(close) OVER w) AS a, CASE WHEN volume > 0 THEN ln(amount / volume - 900) END AS b,
  lead(close) OVER w IS NOT NULL AND NOT paused AS ok FROM (SELECT * FROM bars WHERE close > 901) WINDOW w AS (PARTITION BY i ORDER BY d))"""


def _panel(spark, sf_dir):
    w = series("i", "d")
    rows = bars(spark, sf_dir).where("close > 901")
    b = F.when(F.col("volume") > 0, F.ln(F.col("amount") / F.col("volume") - 900))
    return rows.select("i", "d", F.ln(F.col("close") / F.lag("close").over(w)).alias("a"), b.alias("b"), (F.lead("close").over(w).isNotNull() & ~F.col("paused")).alias("ok"))


@query("flt_08_clean_panel", with_views(f"{_PANEL}\nSELECT i, d, round(a, 8) AS a, round(b, 6) AS b FROM panel WHERE ok AND a IS NOT NULL AND b IS NOT NULL", BARS))
def flt_08(spark, sf_dir):
    clean, _ = uni.clean_panel(_panel(spark, sf_dir), ["a", "b"], "ok")
    return clean.select("i", "d", F.round("a", 8).alias("a"), F.round("b", 6).alias("b"))


@query("flt_08_excluded", with_views(f"""{_PANEL}
SELECT i, d, CASE WHEN NOT ok AND (a IS NULL OR b IS NULL) THEN 'invalid_label_and_nonfinite_feature' WHEN NOT ok THEN 'invalid_label' ELSE 'nonfinite_feature' END AS exclusion_reason
FROM panel WHERE NOT ok OR a IS NULL OR b IS NULL""", BARS))
def flt_08_excluded(spark, sf_dir):
    _, bad = uni.clean_panel(_panel(spark, sf_dir), ["a", "b"], "ok")
    return bad.select("i", "d", "exclusion_reason")


_TREATED = """treated AS (SELECT i, ex AS start, (ex + 20)::DATE AS "end", announced AS known FROM actions WHERE kind = 'split')"""
_CROSSING = f"""{_TREATED},
n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) - 1 AS t FROM bars),
s AS (SELECT *, sum(close * CASE WHEN t = 0 THEN 1 ELSE 2.0::DOUBLE / 21 END * pow(21.0::DOUBLE / 19, t)) OVER (PARTITION BY i ORDER BY d) AS total FROM n),
e AS (SELECT *, CASE WHEN t >= 19 THEN total * pow(19.0::DOUBLE / 21, t) END AS mean,
  CASE WHEN t >= 19 THEN median(amount) OVER (PARTITION BY i ORDER BY d ROWS 19 PRECEDING) END AS mid FROM s),
r AS (SELECT e.*, lag(close) OVER w AS before, lag(mean) OVER w AS mean_before, c.idx, (SELECT count(*) FROM cal x WHERE x.d < n.listed) AS ahead, n.delisted,
  EXISTS (SELECT 1 FROM treated x WHERE x.i = e.i AND x.start <= e.d AND x."end" > e.d AND x.known <= e.d) AS special
  FROM e JOIN cal c USING (d) JOIN instruments n USING (i) WINDOW w AS (PARTITION BY e.i ORDER BY e.d)),
universe AS (SELECT d, i, CASE WHEN delisted <= d THEN 'not_alive' WHEN idx - ahead < 120 THEN 'insufficient_listing' WHEN special THEN 'special_treatment' WHEN paused THEN 'paused'
  WHEN volume <= 0 THEN 'zero_volume' WHEN close < 950 THEN 'price' WHEN mid IS NULL OR mid < 30000 THEN 'liquidity_or_warmup'
  WHEN before IS NULL OR mean IS NULL OR mean_before IS NULL THEN 'not_ready' WHEN NOT (before <= mean_before AND close > mean) THEN 'no_cross' END AS reason FROM r)"""


def _universe(spark, sf_dir):
    treated = actions(spark, sf_dir).where("kind = 'split'").select("i", F.col("ex").alias("start"), F.date_add("ex", 20).alias("end"), F.col("announced").alias("known"))
    return uni.crossing_universe(bars(spark, sf_dir), calendar(spark, sf_dir), instruments(spark, sf_dir), treated, minimum_price=950.0, minimum_amount=30000.0)


@query("flt_09_crossing_universe", with_views(f"{_CROSSING}\nSELECT d, i, reason FROM universe", BARS, CALENDAR, INSTRUMENTS, ACTIONS))
def flt_09(spark, sf_dir):
    return _universe(spark, sf_dir)


@query("flt_09_waterfall", with_views(f"""{_CROSSING}
SELECT d, count(*) AS rows, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(*) FILTER (WHERE reason = 'paused') AS paused, count(*) FILTER (WHERE reason = 'special_treatment') AS special FROM universe GROUP BY d""", BARS, CALENDAR, INSTRUMENTS, ACTIONS))
def flt_09_waterfall(spark, sf_dir):
    w = uni.waterfall(_universe(spark, sf_dir))
    count = lambda name: F.coalesce(F.try_element_at("excluded", F.lit(name)), F.lit(0))
    return w.select("d", "rows", F.col("eligible").cast("long").alias("eligible"), count("paused").alias("paused"), count("special_treatment").alias("special"))


@query("flt_10_standard_universe", with_views("""c AS (SELECT g.d, n.i, n.listed, n.delisted FROM grid g JOIN instruments n ON true
  WHERE EXISTS (SELECT 1 FROM membership m WHERE m.i = n.i AND m.industry = 'BUILDING' AND m.start <= g.d AND (m."end" IS NULL OR m."end" >= g.d) AND m.known <= g.d)),
h AS (SELECT i, d, row_number() OVER w AS seen, median(amount) OVER (PARTITION BY i ORDER BY d ROWS 19 PRECEDING) AS mid FROM bars WINDOW w AS (PARTITION BY i ORDER BY d)),
x AS (SELECT c.d, c.i, any_value(listed) AS listed, any_value(delisted) AS delisted, coalesce(max(seen), 0) AS seen, arg_max(mid, h.d) AS mid FROM c LEFT JOIN h ON h.i = c.i AND h.d <= c.d GROUP BY 1, 2)
SELECT d, i, CASE WHEN d - listed < 200 THEN 'listed_days' WHEN delisted <= d THEN 'delisted' WHEN seen < 20 THEN 'history' WHEN mid IS NULL OR mid < 40000 THEN 'liquidity' END AS reason FROM x""", BARS, CALENDAR, GRID, INSTRUMENTS, MEMBERSHIP))
def flt_10(spark, sf_dir):
    members = membership(spark, sf_dir).where("industry = 'BUILDING'")
    return uni.standard_universe(grid(spark, sf_dir), instruments(spark, sf_dir), bars(spark, sf_dir), members, 200, 20, 40000.0)


_LABELLED = "l AS (SELECT i, d, lead(d, 6) OVER (PARTITION BY i ORDER BY d) AS label_end FROM bars)"


def _labelled(spark, sf_dir):
    return bars(spark, sf_dir).select("i", "d", F.lead("d", 6).over(series("i", "d")).alias("label_end")).where("label_end is not null")


_YEARS = f"""{_LABELLED},
f AS (SELECT y AS test_year, CASE WHEN year(d) = y THEN 'test' ELSE 'train' END AS part, i, d, label_end FROM l JOIN (SELECT unnest(range(1998, 2002)) AS y) ON year(d) BETWEEN y - 3 AND y
  WHERE label_end IS NOT NULL AND (year(d) = y OR label_end < make_date(y, 1, 1)))"""


@query("ml_04_rolling_years", with_views(f"{_YEARS}\nSELECT test_year::INT AS test_year, part, i, d FROM f", BARS))
def ml_04(spark, sf_dir):
    return ml.rolling_years(_labelled(spark, sf_dir), 1995, 2001).select("test_year", "part", "i", "d")


@query("ml_05_held_out_sessions", with_views(f"""{_YEARS},
b AS (SELECT *, dense_rank() OVER (PARTITION BY test_year ORDER BY d DESC) AS back FROM f WHERE part = 'train'),
s AS (SELECT *, min(CASE WHEN back <= 126 THEN d END) OVER (PARTITION BY test_year) AS start FROM b)
SELECT test_year::INT AS test_year, i, d, CASE WHEN back <= 126 THEN 'validation' WHEN back <= 128 THEN 'embargo' WHEN label_end >= start THEN 'purged' ELSE 'fit' END AS role FROM s""", BARS))
def ml_05(spark, sf_dir):
    train = ml.rolling_years(_labelled(spark, sf_dir), 1995, 2001).where("part = 'train'")
    return ml.held_out_sessions(train, ["test_year"]).select("test_year", "i", "d", "role")


@query("agg_07_grade_means", "SELECT p_size AS grade, count(*) AS n, round(sum(round(p_retailprice * 100)::BIGINT)::DOUBLE / 100 / count(*), 6) AS mean FROM part GROUP BY 1")
def agg_07(spark, sf_dir):
    cents = F.round(F.col("p_retailprice") * 100)
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("grade"), cents.alias("cents"))
    return ml.grade_means(rows, "grade", "cents").select("grade", "n", F.round(F.col("mean") / 100, 6).alias("mean"))


@query("agg_22_importance", "SELECT s_nationkey AS feature, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, count(*) FILTER (WHERE g <> 0) AS models FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal) ELSE 0 END AS g FROM supplier) GROUP BY 1")
def agg_22(spark, sf_dir):
    gain = F.when(F.col("s_acctbal") > 0, F.round("s_acctbal")).otherwise(0.0)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model"), F.col("s_nationkey").alias("feature"), gain.alias("gain"))
    return ml.importance(rows).select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "models")


@query("join_02_one_to_one", with_views("SELECT i, d, a.close, b.volume FROM (SELECT i, d, close FROM bars) a JOIN (SELECT i, d, volume FROM bars WHERE NOT paused) b USING (i, d)", BARS))
def join_02(spark, sf_dir):
    rows = bars(spark, sf_dir)
    return exe.one_to_one(rows.select("i", "d", "close"), rows.where("not paused").select("i", "d", "volume"), ["i", "d"])


_HOLD = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN o_orderkey % 4 = 0 THEN 'open' ELSE 'close' END AS phase, b.*,
  CASE WHEN o_orderkey % 7 <> 0 THEN close + o_orderkey % 5 - 2 END AS limit_up FROM orders JOIN bars b ON b.i = o_custkey % 25 AND b.d = o_orderdate::DATE)"""


@query("exe_03_hold_limit_up", with_views(f"""{_HOLD}
SELECT id, CASE WHEN side < 0 AND phase = 'close' AND NOT paused AND volume > 0 THEN CASE WHEN limit_up IS NULL THEN 'missing_limit_up_for_hold_rule' WHEN close >= limit_up - 1e-8 THEN 'strategy_hold_limit_up' END END AS hold FROM o""", BARS))
def exe_03(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, 1).otherwise(-1).alias("side"), F.when(k % 4 == 0, "open").otherwise("close").alias("phase"), (F.col("o_custkey") % 25).alias("i"), F.col("o_orderdate").cast("date").alias("d"))
    rows = o.join(bars(spark, sf_dir), ["i", "d"]).withColumn("limit_up", F.when(F.col("id") % 7 != 0, F.col("close") + F.col("id") % 5 - 2))
    return exe.hold_limit_up(rows).select("id", "hold")


def month_signal(spark, sf_dir):
    """(d, i, score): 20-row returns on the last session of each month."""
    score = F.round(change(F.col("close"), 20, series("i", "d")), 6)
    rows = bars(spark, sf_dir).select("d", "i", score.alias("score")).where("score is not null")
    return rows.join(F.broadcast(grid(spark, sf_dir)), "d")  # one row per month


@query("por_02_top_k_dropout")
def por_02(spark, sf_dir):
    return por.dropout_path(month_signal(spark, sf_dir), 5, 3, 2)


LIMITS = por.Limits(instrument=0.2, industry=0.35, assets={"x": 0.5}, least_cash=0.05, holdings=8, least_weight=0.01)


@query("con_01_limits")
def con_01(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("d").orderBy("score", F.desc("i"))).cast("double")
    rows = month_signal(spark, sf_dir).withColumn("rank", rank)
    share = F.col("rank") / F.sum("rank").over(W.partitionBy("d"))
    asset = F.when(F.col("i") % 2 == 0, "x").otherwise("y")
    return por.constrain_by_date(rows.select("d", "i", share.alias("weight"), (F.col("i") % 5).cast("string").alias("industry"), asset.alias("asset")), LIMITS)
