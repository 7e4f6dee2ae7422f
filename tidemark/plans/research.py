"""Labels, splits, ranking, portfolios, fills, performance and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.stored import stored
from tidemark.functions.windows import change, series
from tidemark.operators import analysis as ana
from tidemark.operators import backtest as bt
from tidemark.operators import execution as exe
from tidemark.operators import ml
from tidemark.operators import portfolio as por
from tidemark.operators.execution import Impact
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, MEMBERSHIP, actions, bars, calendar, instruments, membership, table, with_views

def by():
    """The rows of one instrument by day; made on use, for a window needs a session."""
    return series("i", "d")
_SIG = "sig AS (SELECT * FROM (SELECT d, i, round(close / lag(close, 20) OVER (PARTITION BY i ORDER BY d) - 1, 6) AS score FROM bars) WHERE score IS NOT NULL)"


def _signal(spark, sf_dir):
    return bars(spark, sf_dir).select("d", "i", F.round(change(F.col("close"), 20, by()), 6).alias("score")).where("score is not null")


@query("ml_01_labels", with_views("SELECT d, i, round(label, 8) AS label, label_end FROM (SELECT d, i, lead(close, 6) OVER w / lead(close, 1) OVER w - 1 AS label, lead(d, 6) OVER w AS label_end FROM bars WINDOW w AS (PARTITION BY i ORDER BY d)) WHERE label IS NOT NULL AND label_end <= DATE '2001-06-30'", BARS))
def ml_01(spark, sf_dir):
    return ml.forward_labels(bars(spark, sf_dir), 1, 5, "2001-06-30").select("d", "i", F.round("label", 8).alias("label"), "label_end")


@query("ml_02_session_labels", with_views("""SELECT b.d, b.i, CASE WHEN c.idx + 2 > (SELECT max(idx) FROM cal) THEN 'beyond_calendar' WHEN e.open IS NULL THEN 'no_entry' WHEN x.close IS NULL THEN 'no_exit' ELSE 'valid' END AS status,
CASE WHEN e.open IS NOT NULL AND x.close IS NOT NULL THEN round(x.close / e.open - 1, 8) END AS label
FROM bars b JOIN cal c USING (d) LEFT JOIN cal c1 ON c1.idx = c.idx + 1 LEFT JOIN cal c2 ON c2.idx = c.idx + 2 LEFT JOIN bars e ON e.i = b.i AND e.d = c1.d LEFT JOIN bars x ON x.i = b.i AND x.d = c2.d""", BARS, CALENDAR))
def ml_02(spark, sf_dir):
    return ml.session_labels(bars(spark, sf_dir), calendar(spark, sf_dir)).select("d", "i", "status", F.round("label", 8).alias("label"))


@query("ml_03_date_chunks", with_views("SELECT d, (CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS chunk FROM (SELECT d, idx - 1 AS k, count(*) OVER () AS n FROM cal)", CALENDAR))
def ml_03(spark, sf_dir):
    return ml.date_chunks(calendar(spark, sf_dir), 7)


@query("ml_03_purged_folds", with_views("""l AS (SELECT * FROM (SELECT d, i, lead(d, 6) OVER (PARTITION BY i ORDER BY d) AS label_end FROM bars) WHERE label_end IS NOT NULL),
n AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM l)),
c AS (SELECT d, k, CASE WHEN k - 1 < (n % 4) * (n // 4 + 1) THEN (k - 1) // (n // 4 + 1) ELSE n % 4 + (k - 1 - (n % 4) * (n // 4 + 1)) // (n // 4) END AS chunk FROM n),
s AS (SELECT chunk AS fold, min(k) AS first_at, min(d) AS first_day FROM c WHERE chunk > 0 GROUP BY 1)
SELECT fold::INT AS fold, part, count(*) AS n, max(d) AS last FROM (SELECT fold, d, CASE WHEN chunk = fold THEN 'validation' WHEN chunk < fold AND label_end < first_day AND k < first_at - 5 THEN 'train' END AS part FROM l JOIN c USING (d) JOIN s ON fold >= chunk) WHERE part IS NOT NULL GROUP BY 1, 2""", BARS))
def ml_03_folds(spark, sf_dir):
    rows = bars(spark, sf_dir).select("d", "i", F.lead("d", 6).over(by()).alias("label_end")).where("label_end is not null")
    return ml.purged_folds(rows, 4, 5).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))


@query("ml_06_standardise", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer WHERE c_custkey % 2 = 0)) / (SELECT stddev_pop(c_acctbal) FROM customer WHERE c_custkey % 2 = 0), 6) AS c_acctbal FROM customer WHERE c_custkey % 2 = 1")
def ml_06(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return ml.standardise(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


_REL = "rel AS (SELECT d, i, least(ceil(5 * ((rank() OVER (PARTITION BY d ORDER BY volume) + (count(*) OVER (PARTITION BY d, volume) - 1) / 2.0::DOUBLE) / count(volume) OVER (PARTITION BY d))) - 1, 4)::INT AS relevance, close AS score FROM bars)"


@query("ml_07_relevance", with_views(f"{_REL} SELECT d, i, relevance FROM rel", BARS))
def ml_07(spark, sf_dir):
    return bars(spark, sf_dir).select("d", "i", ml.relevance(F.col("volume"), "d").alias("relevance"))


@query("ml_08_ndcg", with_views(f"""{_REL},
p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, i) AS s, row_number() OVER (PARTITION BY d ORDER BY relevance DESC, i) AS g FROM rel),
x AS (SELECT d, sum((pow(2, relevance) - 1) / log2(s + 1)) FILTER (WHERE s <= 3) AS got, sum((pow(2, relevance) - 1) / log2(g + 1)) FILTER (WHERE g <= 3) AS best FROM p GROUP BY d)
SELECT d, round(CASE WHEN best > 0 THEN got / best ELSE 0 END, 6) AS ndcg FROM x""", BARS))
def ml_08(spark, sf_dir):
    rows = bars(spark, sf_dir).select("d", "i", F.col("close").alias("score"), ml.relevance(F.col("volume"), "d").alias("relevance"))
    return ml.ndcg(rows, 3).select("d", F.round("ndcg", 6).alias("ndcg"))


@query("ml_09_top_means", with_views(f"{_SIG} SELECT round(avg(score) FILTER (WHERE n = 1), 8) AS top1, round(avg(score) FILTER (WHERE n <= 3), 8) AS top3, round(avg(score), 8) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, i) AS n FROM sig)", BARS))
def ml_09(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _signal(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("d").orderBy(F.desc("score"), "i")))
    mean = lambda c: F.round(F.avg(F.when(c, F.col("score"))), 8)
    return rows.agg(mean(F.col("n") == 1).alias("top1"), mean(F.col("n") <= 3).alias("top3"), F.round(F.avg("score"), 8).alias("pool"))


@query("ml_11_ridge")
def ml_11(spark, sf_dir):
    rows = bars(spark, sf_dir).select("d", "i", "close", "volume", (F.lead("close").over(by()) / F.col("close") - 1).alias("y"))
    weights = ml.fit_ridge(rows, ["close", "volume"], "y")
    return ml.predict_linear(rows, ["close", "volume"], weights).select("d", "i", "score")


@query("str_01_schedule_monthly", with_views("SELECT max(d) AS d FROM cal GROUP BY year(d), month(d)", CALENDAR))
def str_01_monthly(spark, sf_dir):
    return por.schedule(calendar(spark, sf_dir), "monthly")


@query("str_01_schedule_weekly", with_views("SELECT min(d) AS d FROM cal GROUP BY isoyear(d), week(d)", CALENDAR))
def str_01_weekly(spark, sf_dir):
    return por.schedule(calendar(spark, sf_dir), "weekly", first=True)


@query("str_01_schedule_every", with_views("SELECT d FROM cal WHERE (idx - 1) % 5 = 0", CALENDAR))
def str_01_every(spark, sf_dir):
    return por.schedule(calendar(spark, sf_dir), "every", 5)


@query("str_02_factor_signal", with_views(f"""{_SIG},
z AS (SELECT d, i, CASE WHEN stddev_pop(score) OVER p > 0 THEN (score - avg(score) OVER p) / stddev_pop(score) OVER p ELSE 0 END AS a FROM sig WINDOW p AS (PARTITION BY d)),
y AS (SELECT d, i, CASE WHEN stddev_pop(volume) OVER p > 0 THEN (volume - avg(volume) OVER p) / stddev_pop(volume) OVER p ELSE 0 END AS b FROM bars WINDOW p AS (PARTITION BY d))
SELECT d, i, round(0.8::DOUBLE * a + 0.2::DOUBLE * b, 5) AS score FROM z JOIN y USING (d, i)""", BARS))
def str_02(spark, sf_dir):
    volume = bars(spark, sf_dir).select("d", "i", F.col("volume").alias("value"))
    return por.factor_signal([(_signal(spark, sf_dir).withColumnRenamed("score", "value"), 0.8), (volume, 0.2)]).select("d", "i", F.round("score", 5).alias("score"))


@query("por_01_top_k", with_views(f"{_SIG} SELECT d, i, round(1.0::DOUBLE / count(*) OVER (PARTITION BY d), 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score DESC, i) AS n FROM sig) WHERE n <= 5", BARS))
def por_01(spark, sf_dir):
    return por.top_k_equal(_signal(spark, sf_dir), 5).select("d", "i", F.round("weight", 8).alias("weight"))


@query("por_03_softmax", with_views(f"{_SIG}, e AS (SELECT d, i, exp(score - max(score) OVER (PARTITION BY d)) AS r FROM sig) SELECT d, i, round(r / sum(r) OVER (PARTITION BY d), 8) AS weight FROM e WHERE r > 0", BARS))
def por_03(spark, sf_dir):
    return por.score_weighted(_signal(spark, sf_dir), "softmax").select("d", "i", F.round("weight", 8).alias("weight"))


@query("por_03_positive", with_views(f"{_SIG}, e AS (SELECT d, i, greatest(score, 0) AS r FROM sig), s AS (SELECT *, sum(r) OVER (PARTITION BY d) AS t FROM e) SELECT d, i, round(r / t, 8) AS weight FROM s WHERE t > 0 AND r > 0", BARS))
def por_03_positive(spark, sf_dir):
    return por.score_weighted(_signal(spark, sf_dir), "positive").select("d", "i", F.round("weight", 8).alias("weight"))


@query("por_04_risk_parity")
def por_04(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = bars(spark, sf_dir).withColumn("r", change(F.col("close"), 1, by())).where("r is not null")
    lag = F.row_number().over(W.partitionBy("i").orderBy(F.desc("d"))) - 1
    last = bars(spark, sf_dir).agg(F.max("d").alias("last"))
    return por.risk_parity_by_date(rows.select("i", lag.cast("long").alias("lag"), "r").join(F.broadcast(last)).select(F.col("last").alias("d"), "i", "lag", "r"))


_TOP = f"""{_SIG}, m AS (SELECT max(d) AS d FROM cal GROUP BY year(d), month(d)),
w AS (SELECT d, i, 1.0::DOUBLE / count(*) OVER (PARTITION BY d) AS weight FROM (SELECT sig.*, row_number() OVER (PARTITION BY d ORDER BY score DESC, i) AS n FROM sig JOIN m USING (d)) WHERE n <= 5)"""


def _targets(spark, sf_dir):
    return por.top_k_equal(_signal(spark, sf_dir).join(por.schedule(calendar(spark, sf_dir), "monthly"), "d"), 5)


@query("con_03_turnover", with_views(f"""{_TOP}, n AS (SELECT d, lead(d) OVER (ORDER BY d) AS nx FROM (SELECT DISTINCT d FROM w))
SELECT coalesce(a.d, b.nx) AS d, round(sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2, 8) AS turnover FROM w a FULL JOIN (SELECT nx, i, weight FROM w JOIN n USING (d) WHERE nx IS NOT NULL) b ON a.d = b.nx AND a.i = b.i GROUP BY 1""", BARS, CALENDAR))
def con_03(spark, sf_dir):
    return por.turnover_by_date(_targets(spark, sf_dir)).select("d", F.round("turnover", 8).alias("turnover"))


_DEMANDS = "dem AS (SELECT (l_partkey % 50)::BIGINT AS i, l_suppkey AS sleeve, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE -l_quantity END)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2)"


def _demands(spark, sf_dir):
    signed = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("i"), F.col("l_suppkey").alias("sleeve")).agg(F.sum(signed).cast("long").alias("quantity"))


@query("slv_01_crosses", with_views("""p AS (SELECT *, sum(abs(quantity)) OVER (PARTITION BY i, quantity > 0 ORDER BY sleeve ROWS UNBOUNDED PRECEDING) AS e FROM dem WHERE quantity <> 0)
SELECT b.i, b.sleeve AS buyer, s.sleeve AS seller, (least(b.e, s.e) - greatest(b.e - abs(b.quantity), s.e - abs(s.quantity)))::BIGINT AS quantity FROM p b JOIN p s ON b.i = s.i AND b.quantity > 0 AND s.quantity < 0 AND b.e - abs(b.quantity) < s.e AND s.e - abs(s.quantity) < b.e""", _DEMANDS))
def slv_01(spark, sf_dir):
    return por.cross_demands(_demands(spark, sf_dir))


@query("slv_01_residuals", with_views("""p AS (SELECT *, sum(abs(quantity)) OVER (PARTITION BY i, quantity > 0 ORDER BY sleeve ROWS UNBOUNDED PRECEDING) AS e FROM dem WHERE quantity <> 0),
m AS (SELECT i, least(sum(greatest(quantity, 0)), sum(greatest(-quantity, 0))) AS matched FROM dem GROUP BY i),
r AS (SELECT p.i, sleeve, (sign(quantity) * (abs(quantity) - greatest(0, least(e, matched) - (e - abs(quantity)))))::BIGINT AS quantity FROM p JOIN m ON m.i = p.i)
SELECT i, sleeve, quantity FROM r WHERE quantity <> 0""", _DEMANDS))
def slv_01_residuals(spark, sf_dir):
    d = _demands(spark, sf_dir)
    return por.residual_orders(d, por.cross_demands(d)).select("i", "sleeve", "quantity")


@query("slv_02_lot_allocation", with_views("""o AS (SELECT i, sleeve, quantity AS demand, (sum(quantity) OVER (PARTITION BY i) // 2 // 10 * 10)::BIGINT AS filled FROM dem WHERE quantity > 0),
s AS (SELECT *, filled * demand / sum(demand) OVER (PARTITION BY i)::DOUBLE / 10 AS share FROM o),
r AS (SELECT *, floor(share) * 10 AS whole, share - floor(share) AS rest FROM s),
q AS (SELECT *, floor((filled - sum(whole) OVER (PARTITION BY i)) / 10) AS spare, row_number() OVER (PARTITION BY i ORDER BY rest DESC, sleeve) AS place FROM r)
SELECT i, sleeve, least(whole + CASE WHEN place <= spare THEN 10 ELSE 0 END, demand)::BIGINT AS allocated FROM q""", _DEMANDS))
def slv_02(spark, sf_dir):
    from pyspark.sql import Window as W

    filled = F.floor(F.floor(F.sum("quantity").over(W.partitionBy("i")) / 2) / 10) * 10
    orders = _demands(spark, sf_dir).where("quantity > 0").select("i", "sleeve", F.col("quantity").alias("demand"), filled.alias("filled"))
    return por.allocate_lots(orders, 10).select("i", "sleeve", "allocated")


@query("slv_03_cost_split", with_views("""r AS (SELECT i, sleeve, quantity, round(123.45 * quantity / sum(quantity) OVER (PARTITION BY i), 2) AS raw, row_number() OVER (PARTITION BY i ORDER BY sleeve DESC) AS n, sleeve AS s FROM dem WHERE quantity > 0)
SELECT i, sleeve, round(CASE WHEN n = 1 THEN 123.45 - coalesce(sum(raw) OVER (PARTITION BY i ORDER BY sleeve ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE raw END, 2)::DOUBLE AS share FROM r""".replace("123.45", "123.45::DOUBLE"), _DEMANDS))
def slv_03(spark, sf_dir):
    rows = _demands(spark, sf_dir).where("quantity > 0").withColumn("cost", F.lit(123.45))
    return por.split_costs(rows, ["i"], "sleeve", "quantity", "cost").select("i", "sleeve", "share")


_ORD = """ord AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS side, (o_orderkey % 50 * 100)::BIGINT AS quantity, b.*, b.close AS price,
  CASE WHEN o_orderkey % 5 = 0 THEN b.low WHEN o_orderkey % 5 = 1 THEN b.high + 1 END AS up, CASE WHEN o_orderkey % 5 = 2 THEN b.high WHEN o_orderkey % 5 = 1 THEN b.low - 1 END AS down
  FROM orders JOIN bars b ON b.i = o_custkey % 25 AND b.d = o_orderdate::DATE),
fl AS (SELECT *, least(quantity, floor(volume * 10 / 100) * 100) // 100 * 100 AS room FROM ord),
fi AS (SELECT *, CASE WHEN paused OR volume <= 0 THEN 'halted' WHEN side > 0 AND low >= up - 1e-12 THEN 'limit_up' WHEN side < 0 AND high <= down + 1e-12 THEN 'limit_down' WHEN room < 100 THEN 'below_one_lot' END AS reason FROM fl),
fq AS (SELECT *, CASE WHEN reason IS NULL THEN room ELSE 0 END::BIGINT AS filled FROM fi),
fp AS (SELECT *, CASE WHEN filled > 0 THEN least(greatest(price * (1 + side * (2 + least(150.0::DOUBLE, 20.0::DOUBLE * sqrt(filled * price / greatest(amount, 1e-12)))) / 10000), greatest(low, coalesce(down, low))), least(high, coalesce(up, high))) END AS fill_price FROM fq)"""


@query("exe_02_fills", with_views(f"""{_ORD}
SELECT id, reason, filled, floor(fill_price * 1e4 + 0.5::DOUBLE) / 1e4 AS fill_price, floor(CASE WHEN filled > 0 THEN greatest(5, filled * fill_price * 2.6 / 1e4) ELSE 0 END * 1e4 + 0.5::DOUBLE) / 1e4 AS commission,
  floor(CASE WHEN filled > 0 AND side < 0 THEN filled * fill_price * 10 / 1e4 ELSE 0 END * 1e4 + 0.5::DOUBLE) / 1e4 AS tax FROM fp""", BARS))
def exe_02(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 2 == 0, 1).otherwise(-1).alias("side"), (k % 50 * 100).alias("quantity"), (F.col("o_custkey") % 25).alias("i"), F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("id") % 5
    rows = o.join(bars(spark, sf_dir), ["i", "d"]).withColumns({
        "price": F.col("close"),
        "lot": F.lit(100),
        "asset_type": F.lit("stock"),
        "limit_up": F.when(k == 0, F.col("low")).when(k == 1, F.col("high") + 1),
        "limit_down": F.when(k == 2, F.col("high")).when(k == 1, F.col("low") - 1),
    })
    priced = exe.resolve_costs(rows, overrides={"sell_tax_bps": 10.0})
    done = exe.fills(priced, Impact(participation=10.0, slippage=2.0, per_root=20.0, most=150.0))
    return done.select("id", "reason", "filled", *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("fill_price", "commission", "tax")])  # ties as in SQL


@query("exe_01_cost_chain", """WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'etf' WHEN c_mktsegment = 'MACHINERY' THEN 'bond' ELSE 'stock' END AS asset,
  CASE WHEN c_acctbal > 0 THEN c_acctbal WHEN c_acctbal > -500 THEN 'NaN'::DOUBLE END AS rule FROM customer)
SELECT c_custkey, CASE WHEN asset = 'bond' THEN 1.5::DOUBLE WHEN rule > 0 AND NOT isnan(rule) THEN rule ELSE 2.5::DOUBLE END AS commission_bps,
  CASE WHEN asset = 'bond' THEN 'asset' WHEN rule > 0 AND NOT isnan(rule) THEN 'rule' ELSE 'default' END AS commission_bps_from,
  CASE asset WHEN 'stock' THEN 7.0::DOUBLE WHEN 'etf' THEN 0 ELSE 5 END AS sell_tax_bps, CASE asset WHEN 'stock' THEN 'run' ELSE 'default' END AS sell_tax_bps_from FROM c""")
def exe_01(spark, sf_dir):
    asset = F.when(F.col("c_mktsegment") == "BUILDING", "etf").when(F.col("c_mktsegment") == "MACHINERY", "bond").otherwise("stock")
    rule = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).when(F.col("c_acctbal") > -500, F.lit(float("nan")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", asset.alias("asset_type"), rule.alias("commission_bps"))
    out = exe.resolve_costs(rows, {"sell_tax_bps": 7.0}, {"bond": {"commission_bps": 1.5}})
    return out.select("c_custkey", "commission_bps", "commission_bps_from", "sell_tax_bps", "sell_tax_bps_from")


#: Account values per segment: a running sum of orders.
_NAV = """nav AS (SELECT run, d, 1e6 + sum(v) OVER (PARTITION BY run ORDER BY d) AS nav FROM (SELECT o_custkey % 5 AS run, o_orderdate::DATE AS d, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END) / 100, 2) AS v FROM orders GROUP BY 1, 2)),
r AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, max(nav) OVER (PARTITION BY run ORDER BY d ROWS UNBOUNDED PRECEDING) AS high, row_number() OVER w AS n FROM nav WINDOW w AS (PARTITION BY run ORDER BY d)),
dd AS (SELECT *, nav / high - 1 AS dd FROM r)"""


def _nav(spark, sf_dir):
    from pyspark.sql import Window as W

    # In whole cents, so that neither sums nor the rounding of halves depend on the order of rows.
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    signed = F.sum(F.when(F.col("o_orderkey") % 2 == 0, cents).otherwise(-cents))
    value = F.signum(signed) * F.floor((F.abs(signed) + 50) / 100) / 100
    daily = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("run"), F.col("o_orderdate").cast("date").alias("d")).agg(value.alias("v"))
    return daily.select("run", "d", (F.lit(1e6) + F.sum("v").over(W.partitionBy("run").orderBy("d"))).alias("nav"))


@query("ana_01_performance", f"""WITH {_NAV},
i AS (SELECT *, sum((dd >= 0)::INT) OVER (PARTITION BY run ORDER BY d ROWS UNBOUNDED PRECEDING) AS island FROM dd),
l AS (SELECT run, max(c) AS longest FROM (SELECT run, island, count(*) AS c FROM i WHERE dd < 0 GROUP BY 1, 2) GROUP BY run),
t AS (SELECT run, arg_min(n, (dd, n)) AS low, arg_min(high, (dd, n)) AS peak FROM dd GROUP BY run),
b AS (SELECT dd.run, min(n - low) AS back FROM dd JOIN t USING (run) WHERE n >= low AND nav >= peak GROUP BY 1),
f AS (SELECT run, arg_max(nav, d) / arg_min(nav, d) - 1 AS tr, count(r) AS days, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(CASE WHEN r IS NOT NULL THEN pow(least(r, 0), 2) END)) AS dn, min(dd) AS mdd FROM dd GROUP BY run)
SELECT f.run, round(tr, 6) AS total_return, round(s * sqrt(252.0::DOUBLE), 6) AS volatility, round(m / s * sqrt(252.0::DOUBLE), 4) AS sharpe, round(mdd, 6) AS max_drawdown, coalesce(longest, 0)::BIGINT AS drawdown_days, back::BIGINT AS recovery_days FROM f LEFT JOIN l USING (run) LEFT JOIN b USING (run)""")
def ana_01(spark, sf_dir):
    p = ana.performance(_nav(spark, sf_dir))
    return p.select("run", F.round("total_return", 6).alias("total_return"), F.round("volatility", 6).alias("volatility"), F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 6).alias("max_drawdown"), "drawdown_days", "recovery_days")


@query("ana_02_benchmark", f"""WITH {_NAV}, k AS (SELECT d, nav / lag(nav) OVER (ORDER BY d) - 1 AS b FROM nav WHERE run = 0),
x AS (SELECT run, r, b FROM r JOIN k USING (d) WHERE r IS NOT NULL AND b IS NOT NULL AND run > 0)
SELECT run, round(exp(sum(ln(1 + b))) - 1, 5) AS benchmark_return, round(stddev_samp(r - b) * sqrt(252.0::DOUBLE), 6) AS tracking_error FROM x GROUP BY run""")
def ana_02(spark, sf_dir):
    nav = _nav(spark, sf_dir)
    out = ana.against_benchmark(nav.where("run > 0"), nav.where("run = 0"))
    return out.select("run", F.round("benchmark_return", 5).alias("benchmark_return"), F.round("tracking_error", 6).alias("tracking_error"))


@query("ana_04_security_pnl", with_views("SELECT i, d, coalesce(lag(volume) OVER w * (close - lag(close) OVER w), 0) AS pnl FROM bars WINDOW w AS (PARTITION BY i ORDER BY d)", BARS))
def ana_04(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", F.col("volume").alias("quantity"), F.col("close").alias("price"))
    return ana.security_pnl(rows).select("i", "d", "pnl")


@query("ana_06_industry_pnl", with_views("""p AS (SELECT i, d, coalesce(lag(volume) OVER w * (close - lag(close) OVER w), 0) AS pnl FROM bars WINDOW w AS (PARTITION BY i ORDER BY d)),
j AS (SELECT p.i, p.d, p.pnl, m.industry, row_number() OVER (PARTITION BY p.i, p.d ORDER BY m.start DESC NULLS LAST, m.industry DESC) AS n FROM p LEFT JOIN membership m ON p.i = m.i AND m.start <= p.d AND (m."end" IS NULL OR m."end" >= p.d))
SELECT d, coalesce(industry, 'UNKNOWN') AS industry, round(sum(pnl) + 1e-6, 3) AS pnl FROM j WHERE n = 1 GROUP BY 1, 2""", BARS, MEMBERSHIP))
def ana_06(spark, sf_dir):
    rows = bars(spark, sf_dir).select("i", "d", F.col("volume").alias("quantity"), F.col("close").alias("price"))
    pnl = ana.security_pnl(rows).select("i", "d", "pnl")
    return ana.industry_pnl(pnl, membership(spark, sf_dir)).select("d", "industry", F.round(F.col("pnl") + F.lit(1e-6), 3).alias("pnl"))


@query("ana_08_yearly", f"WITH {_NAV} SELECT run, year(d)::INT AS year, round(exp(sum(ln(1 + r))) - 1, 5) AS total_return, count(*) AS days FROM r WHERE r IS NOT NULL GROUP BY 1, 2")
def ana_08(spark, sf_dir):
    return ana.yearly(_nav(spark, sf_dir)).select("run", "year", F.round("total_return", 5).alias("total_return"), "days")


@query("ana_08_without_best_days", f"WITH {_NAV} SELECT run, round(exp(sum(CASE WHEN n > 10 THEN ln(1 + r) ELSE 0 END)) - 1, 5) AS total_return FROM (SELECT run, r, row_number() OVER (PARTITION BY run ORDER BY r DESC, d) AS n FROM r WHERE r IS NOT NULL) GROUP BY run")
def ana_08_best(spark, sf_dir):
    return ana.without_best_days(_nav(spark, sf_dir), 10).select("run", F.round("total_return", 5).alias("total_return"))


RUNS = {
    1: bt.Rules(impact=Impact(participation=100.0)),
    2: bt.Rules(timing="next_close", impact=Impact(participation=100.0)),
    3: bt.Rules(timing="same_close", sell_delay=0, impact=Impact(participation=100.0, per_root=0.0)),
    4: bt.Rules(impact=Impact(participation=100.0), sleeves={"high": 0.6, "low": 0.4}),
}


def _backtest(spark, sf_dir):
    """Months' best five by return, with three timings; and two sleeves, one of which holds the worst five."""
    goals = stored(_targets(spark, sf_dir))  # read, as the bars and the calendar are, for several parts of the panel
    every = goals.withColumn("run", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]))).withColumn("sleeve", F.lit("main"))
    worst = _signal(spark, sf_dir).withColumn("score", -F.col("score")).join(goals.select("d").distinct(), "d")
    two = goals.withColumn("sleeve", F.lit("high")).unionByName(por.top_k_equal(worst, 5).withColumn("sleeve", F.lit("low"))).withColumn("run", F.lit(4).cast("long"))
    targets = stored(every.unionByName(two))
    return bt.run_backtests(bars(spark, sf_dir), targets, actions(spark, sf_dir), instruments(spark, sf_dir), RUNS, stored(calendar(spark, sf_dir)))


@query("bt_01_ledgers")
def bt_01(spark, sf_dir):
    return _backtest(spark, sf_dir)


@query("bt_10_reconciliation", with_views("""s AS (SELECT unnest([1, 2, 3, 4, 4])::BIGINT AS run, unnest(['main', 'main', 'main', 'high', 'low']) AS sleeve)
SELECT run, sleeve, (SELECT count(*) FROM cal) AS sessions, 0::BIGINT AS broken FROM s""", CALENDAR))
def bt_10(spark, sf_dir):
    rows = stored(_backtest(spark, sf_dir))  # several ledgers are read from it
    broken = bt.reconcile(rows, RUNS).groupBy("run", "sleeve").agg(F.count(F.lit(1)).alias("n"))
    told = bt.ledger(rows, "nav").groupBy("run", "sleeve").agg(F.countDistinct("d").alias("sessions"))
    return told.join(broken, ["run", "sleeve"], "left").select("run", "sleeve", "sessions", F.coalesce("n", F.lit(0)).alias("broken"))
