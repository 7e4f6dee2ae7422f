"""Window functions, each against its SQL form."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import windows as win
from tidemark.operators import factors, ml
from tidemark.operators.intervals import next_session
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, CALENDAR, INSTRUMENTS, bars, calendar, instruments, table, with_views

def by_day():
    """The rows of one instrument by day; made on use, for a window needs a session."""
    return win.series("i", "d")
_W = "WINDOW w AS (PARTITION BY i ORDER BY d)"


def _rows(n: int, until: int = 0) -> str:
    start = f"{n - 1 - until} PRECEDING"
    end = "CURRENT ROW" if until == 0 else f"{-until} PRECEDING"
    return f"OVER (PARTITION BY i ORDER BY d ROWS BETWEEN {start} AND {end})"


def _full(agg: str, x: str, n: int, until: int = 0, digits: int = 6) -> str:
    return f"CASE WHEN count({x}) {_rows(n, until)} >= {n} THEN round({agg} {_rows(n, until)}, {digits}) END"


def _one(spark, sf_dir, **cols):
    return bars(spark, sf_dir).select("i", "d", *[c.alias(k) for k, c in cols.items()])


@query("win_01_lag_lead", with_views(f"SELECT i, d, lag(close, 5) OVER w AS before, lead(close, 2) OVER w AS after FROM bars {_W}", BARS))
def win_01(spark, sf_dir):
    return _one(spark, sf_dir, before=win.lag_by(F.col("close"), 5, by_day()), after=win.lag_by(F.col("close"), -2, by_day()))


@query("win_02_change", with_views(f"SELECT i, d, round(close / nullif(lag(close, 20) OVER w, 0) - 1, 8) AS ret FROM bars {_W}", BARS))
def win_02(spark, sf_dir):
    return _one(spark, sf_dir, ret=F.round(win.change(F.col("close"), 20, by_day()), 8))


@query("win_03_difference", with_views(f"SELECT i, d, close - lag(close) OVER w AS diff FROM bars {_W}", BARS))
def win_03(spark, sf_dir):
    return _one(spark, sf_dir, diff=F.col("close") - F.lag("close").over(by_day()))


@query("win_04_rolling", with_views(f"SELECT i, d, {_full('avg(close)', 'close', 20)} AS mean, {_full('sum(volume)', 'volume', 10)} AS total, {_full('min(low)', 'low', 15)} AS low, {_full('max(high)', 'high', 20, -1)} AS high FROM bars", BARS))
def win_04(spark, sf_dir):
    r = lambda agg, x, n, until=0: F.round(win.rolling(agg, F.col(x), n, by_day(), until=until), 6)
    return _one(spark, sf_dir, mean=r(F.avg, "close", 20), total=r(F.sum, "volume", 10), low=r(F.min, "low", 15), high=r(F.max, "high", 20, -1))


@query("win_05_rolling_std", with_views(f"SELECT i, d, {_full('stddev_pop(close)', 'close', 20)} AS pop, {_full('stddev_samp(close)', 'close', 20)} AS samp FROM bars", BARS))
def win_05(spark, sf_dir):
    return _one(spark, sf_dir, pop=F.round(win.rolling(F.stddev_pop, F.col("close"), 20, by_day()), 6), samp=F.round(win.rolling(F.stddev_samp, F.col("close"), 20, by_day()), 6))


@query("win_06_rolling_median", with_views(f"SELECT i, d, {_full('median(amount)', 'amount', 20)} AS med FROM bars", BARS))
def win_06(spark, sf_dir):
    return _one(spark, sf_dir, med=F.round(win.rolling(win.median, F.col("amount"), 20, by_day()), 6))


@query("win_07_rolling_corr", with_views(f"SELECT i, d, CASE WHEN count(close) {_rows(20)} >= 20 AND stddev_pop(close) {_rows(20)} * stddev_pop(volume) {_rows(20)} > 0 THEN round(covar_pop(close, volume) {_rows(20)} / (stddev_pop(close) {_rows(20)} * stddev_pop(volume) {_rows(20)}), 6) END AS corr FROM bars", BARS))
def win_07(spark, sf_dir):
    return _one(spark, sf_dir, corr=F.round(win.rolling_corr(F.col("close"), F.col("volume"), 20, by_day()), 6))


@query("win_08_ewm", with_views("""n AS (SELECT i, d, close, row_number() OVER (PARTITION BY i ORDER BY d) - 1 AS t FROM bars),
s AS (SELECT *, sum(close * CASE WHEN t = 0 THEN 1 ELSE 2.0::DOUBLE / 21 END * pow(21.0::DOUBLE / 19, t)) OVER (PARTITION BY i ORDER BY d) AS total FROM n)
SELECT i, d, round(total * pow(19.0::DOUBLE / 21, t), 5) AS e FROM s""", BARS))
def win_08(spark, sf_dir):
    rows = win.ewm(bars(spark, sf_dir).select("i", "d", "close"), "i", "d", {"e": ("close", 20)})
    return rows.select("i", "d", F.round("e", 5).alias("e"))


@query("win_09_decayed_sum", with_views("SELECT a.i, a.d, round(sum(b.close * pow(0.5::DOUBLE, (a.n - b.n) / 10.0::DOUBLE)), 4) AS s FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS n FROM bars) a JOIN (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS n FROM bars) b ON a.i = b.i AND b.n BETWEEN a.n - 19 AND a.n GROUP BY 1, 2", BARS))
def win_09(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("n", F.row_number().over(by_day()))
    frame = by_day().rowsBetween(-19, 0)
    values = F.collect_list("close").over(frame)
    size = F.size("v")
    decayed = F.aggregate(F.transform("v", lambda x, k: x * F.pow(F.lit(0.5), (size - 1 - k) / F.lit(10.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("v", values).select("i", "d", F.round(decayed, 4).alias("s"))


@query("win_10_running_max", with_views(f"SELECT i, d, max(close) OVER w AS high, round(close / max(close) OVER w - 1, 8) AS drawdown FROM bars {_W}", BARS))
def win_10(spark, sf_dir):
    high = win.running(F.max, F.col("close"), by_day())
    return _one(spark, sf_dir, high=high, drawdown=F.round(F.col("close") / high - 1, 8))


@query("win_11_row_number", with_views(f"SELECT i, d, row_number() OVER w AS n FROM bars {_W}", BARS))
def win_11(spark, sf_dir):
    return _one(spark, sf_dir, n=F.row_number().over(by_day()))


@query("win_12_forward_fill", with_views("SELECT i, d, last_value(CASE WHEN NOT paused THEN close END IGNORE NULLS) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM bars", BARS))
def win_12(spark, sf_dir):
    return _one(spark, sf_dir, filled=win.forward_fill(F.when(~F.col("paused"), F.col("close")), by_day()))


@query("win_13_rank_share", with_views("SELECT i, d, round((rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0::DOUBLE) / count(volume) OVER (PARTITION BY d), 8) AS share FROM bars", BARS))
def win_13(spark, sf_dir):
    return _one(spark, sf_dir, share=F.round(win.rank_share(F.col("volume"), "d"), 8))


@query("win_14_rank_first", with_views("SELECT i, d, round(row_number() OVER (PARTITION BY d ORDER BY volume, i) / (count(volume) OVER (PARTITION BY d))::DOUBLE, 8) AS share FROM bars", BARS))
def win_14(spark, sf_dir):
    return _one(spark, sf_dir, share=F.round(win.rank_share_first(F.col("volume"), "d", "i"), 8))


@query("win_15_new_leader", with_views("""t AS (SELECT d, arg_min(i, (-close, i)) AS top FROM bars GROUP BY d), p AS (SELECT d, top, lag(top) OVER (ORDER BY d) AS before FROM t)
SELECT i, d, (i = top AND before IS NOT NULL AND top <> before)::INT AS is_new_top1 FROM bars JOIN p USING (d)""", BARS))
def win_15(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", F.col("close").alias("score"))
    return ml.new_leader(rows).select("i", "d", "is_new_top1")


@query("win_16_winsorise", with_views("SELECT i, d, round(least(greatest(close, quantile_cont(close, 0.01) OVER (PARTITION BY d)), quantile_cont(close, 0.99) OVER (PARTITION BY d)) + 1e-9, 6) AS x FROM bars", BARS))
def win_16(spark, sf_dir):
    return _one(spark, sf_dir, x=F.round(win.winsorised(F.col("close"), "d") + F.lit(1e-9), 6))


@query("win_17_month_end_median", with_views("""e AS (SELECT d, row_number() OVER (ORDER BY d) AS m FROM (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM cal) WHERE nx IS NOT NULL AND date_trunc('month', nx) <> date_trunc('month', d)),
x AS (SELECT b.i, b.d, b.close, e.m FROM bars b JOIN e USING (d))
SELECT i, d, round(med, 6) AS value FROM (SELECT i, d, count(close) OVER w AS n, median(close) OVER w AS med FROM x WINDOW w AS (PARTITION BY i ORDER BY m RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)) WHERE n >= 12""", BARS, CALENDAR))
def win_17(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", F.col("close").alias("value"))
    return factors.month_end_median(rows, calendar(spark, sf_dir), 36, 12).select("i", "d", F.round("value", 6).alias("value"))


_STREAK = """r AS (SELECT i, d, close - lag(close) OVER (PARTITION BY i ORDER BY d) AS x FROM bars),
g AS (SELECT *, sum(CASE WHEN x > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT i, d, least(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY i, run ORDER BY d ROWS UNBOUNDED PRECEDING), 10)::BIGINT AS up FROM g"""


@query("win_18_streak", with_views(_STREAK, BARS))
def win_18(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", (F.col("close") - F.lag("close").over(by_day())).alias("x"))
    return win.streak(rows, "x", "i", "d", "up").select("i", "d", "up")


@query("win_19_decay_counter", with_views("""f AS (SELECT i, d, coalesce(close < lag(close) OVER (PARTITION BY i ORDER BY d), false) AS fell FROM bars),
g AS (SELECT *, sum(CASE WHEN fell THEN 0 ELSE 1 END) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT i, d, least(sum(fell::INT) OVER (PARTITION BY i, run ORDER BY d ROWS UNBOUNDED PRECEDING), 3)::BIGINT AS decay_days FROM g""", BARS))
def win_19(spark, sf_dir):
    from tidemark.operators.technical import decay_days

    return decay_days(bars(spark, sf_dir).select("i", "d", F.col("close").alias("score"))).select("i", "d", "decay_days")


@query("win_20_window_drawdown", with_views("""l AS (SELECT i, d, list(close) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM bars)
SELECT i, d, round(list_min(list_transform(c, lambda x, n: x / list_max(c[1:n]) - 1)), 8) AS dd FROM l WHERE len(c) = 5""", BARS))
def win_20(spark, sf_dir):
    from tidemark.operators.technical import _drawdown

    rows = bars(spark, sf_dir).withColumn("c", F.collect_list("close").over(by_day().rowsBetween(-4, 0))).where("size(c) = 5")
    return rows.select("i", "d", F.round(_drawdown(F.col("c")), 8).alias("dd"))


def trend_sql(n: int) -> tuple[str, str]:
    """Slope and R squared of list c of n closes, in DuckDB."""
    w = [1 + k / (n - 1) for k in range(n)]
    total = sum(x * x for x in w)
    mid = sum(k * x * x for k, x in enumerate(w)) / total
    spread = sum(x * x * (k - mid) ** 2 for k, x in enumerate(w))
    weight = f"(1 + (n - 1) / {n - 1}.0::DOUBLE)"
    slope = f"list_sum(list_transform(c, lambda x, n: ln(x) * {weight} * {weight} * (n - 1 - {mid!r}::DOUBLE))) / {spread!r}::DOUBLE"
    level = f"list_sum(list_transform(c, lambda x, n: ln(x) * {weight} * {weight})) / {total!r}::DOUBLE"
    return slope, level


def trend_body(source: str, n: int) -> str:
    slope, level = trend_sql(n)
    weight = f"(1 + (n - 1) / {n - 1}.0::DOUBLE)"
    w = [1 + k / (n - 1) for k in range(n)]
    mid = sum(k * x * x for k, x in enumerate(w)) / sum(x * x for x in w)
    return f"""s1 AS (SELECT *, {slope} AS slope, {level} AS level, list_sum(list_transform(c, lambda x: ln(x))) / {n} AS mean FROM {source}),
s2 AS (SELECT *, list_sum(list_transform(c, lambda x, n: {weight} * pow(ln(x) - level - slope * (n - 1 - {mid!r}::DOUBLE), 2))) AS rest,
  list_sum(list_transform(c, lambda x, n: {weight} * pow(ln(x) - mean, 2))) AS whole FROM s1),
s3 AS (SELECT *, CASE WHEN whole > 1e-18 THEN 1 - rest / whole ELSE 0 END AS r2 FROM s2)"""


@query("win_21_weighted_trend", with_views(f"""l AS (SELECT * FROM (SELECT i, d, list(close) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS c FROM bars) WHERE len(c) = 21),
{trend_body("l", 21)}
SELECT i, d, round(slope, 7) AS slope, round(r2, 6) AS r2 FROM s3""", BARS))
def win_21(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("c", F.collect_list("close").over(by_day().rowsBetween(-20, 0))).where("size(c) = 21")
    t = rows.withColumn("t", factors.trend(F.col("c"), 21))
    return t.select("i", "d", F.round("t.slope", 7).alias("slope"), F.round("t.r2", 6).alias("r2"))


@query("win_22_longest_run", with_views("""f AS (SELECT i, d, close < max(close) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING) AS under FROM bars),
g AS (SELECT *, sum((NOT under)::INT) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT i, max(n) AS longest FROM (SELECT i, run, count(*) AS n FROM g WHERE under GROUP BY 1, 2) GROUP BY i""", BARS))
def win_22(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("under", F.col("close") < win.running(F.max, F.col("close"), by_day()))
    rows = rows.withColumn("run", win.running(F.sum, (~F.col("under")).cast("int"), by_day()))
    return rows.where("under").groupBy("i", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.max("n").alias("longest"))


@query("win_23_recovery", with_views("""n AS (SELECT i, d, close, row_number() OVER (PARTITION BY i ORDER BY d) AS n FROM bars),
t AS (SELECT i, arg_min(n, (close, n)) AS low FROM n GROUP BY i)
SELECT i, low, min(n) FILTER (WHERE n > low AND close >= 1500) AS back FROM n JOIN t USING (i) GROUP BY i, low""", BARS))
def win_23(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", "close", F.row_number().over(by_day()).alias("n"))
    low = rows.groupBy("i").agg(F.min_by("n", F.struct("close", "n")).alias("low"))
    return rows.join(low, "i").groupBy("i", "low").agg(F.min(F.when((F.col("n") > F.col("low")) & (F.col("close") >= 1500), F.col("n"))).alias("back"))


@query("win_24_smallest_mean", with_views("SELECT i, d, round(list_avg(list_sort(c)[1:5]), 6) AS tail FROM (SELECT i, d, list(close) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS c FROM bars) WHERE len(c) = 40", BARS))
def win_24(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("c", F.collect_list("close").over(by_day().rowsBetween(-39, 0))).where("size(c) = 40")
    low = F.slice(F.array_sort("c"), 1, 5)
    return rows.select("i", "d", F.round(F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / 5, 6).alias("tail"))


@query("win_25_next_session", with_views("SELECT o_orderkey, coalesce((SELECT min(d) FROM cal WHERE d > o_orderdate::DATE), CASE WHEN dayofweek(o_orderdate) = 5 THEN o_orderdate::DATE + 3 WHEN dayofweek(o_orderdate) = 6 THEN o_orderdate::DATE + 2 ELSE o_orderdate::DATE + 1 END) AS available FROM orders", CALENDAR))
def win_25(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return next_session(rows, calendar(spark, sf_dir), "day", "available").select("o_orderkey", "available")


@query("win_26_session_offset", with_views("SELECT a.d, b.d AS start FROM cal a LEFT JOIN cal b ON b.idx = a.idx - 60", CALENDAR))
def win_26(spark, sf_dir):
    return calendar(spark, sf_dir).select("d", F.lag("d", 60).over(W.orderBy("d")).alias("start"))


@query("win_27_sessions_listed", with_views("SELECT b.i, b.d, (SELECT count(*) FROM cal c WHERE c.d >= listed AND c.d <= b.d) AS age FROM bars b JOIN instruments n ON b.i = n.i WHERE b.d >= listed", BARS, CALENDAR, INSTRUMENTS))
def win_27(spark, sf_dir):
    c = calendar(spark, sf_dir)
    first = instruments(spark, sf_dir).select("i", "listed").join(F.broadcast(c.agg(F.array_sort(F.collect_set("d")).alias("days"))))
    first = first.select("i", "listed", F.size(F.filter("days", lambda x: x < F.col("listed"))).alias("ahead"))
    return bars(spark, sf_dir).join(c, "d").join(first, "i").where("d >= listed").select("i", "d", (F.col("idx") - F.col("ahead")).alias("age"))
