"""Adjustment, statements, quality checks and ingestion transforms, each against its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import adjustment as adj
from tidemark.operators import financial as fin
from tidemark.operators import intervals as iv
from tidemark.operators import quality as dq
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, INSTRUMENTS, MEMBERSHIP, METRICS, actions, bars, calendar, instruments, membership, metrics, table, with_views

_STEPS = """ev AS (SELECT i, ex AS d, sum(cash) AS cash, sum(CASE WHEN kind = 'rights_issue' THEN share * price ELSE 0 END) AS paid_in,
  list({'k': kind, 's': share} ORDER BY id) AS es FROM actions WHERE active GROUP BY 1, 2),
dv AS (SELECT i, d, cash, paid_in, list_reduce(list_prepend(1.0::DOUBLE, list_transform(es, lambda e: CASE WHEN e.k = 'bonus' THEN 1 + e.s WHEN e.k = 'split' THEN e.s WHEN e.k = 'rights_issue' THEN -e.s ELSE 1 END)),
  lambda a, x: CASE WHEN x < 0 THEN a - x ELSE a * x END) AS divisor FROM ev),
st AS (SELECT b.*, lag(close) OVER (PARTITION BY b.i ORDER BY b.d) AS before, cash, paid_in, divisor FROM bars b LEFT JOIN dv ON b.i = dv.i AND b.d = dv.d),
sp AS (SELECT *, CASE WHEN divisor IS NOT NULL AND before IS NOT NULL AND (before - cash + paid_in) / divisor > 0 THEN before / ((before - cash + paid_in) / divisor) ELSE 1 END AS step FROM st),
fa AS (SELECT *, exp(sum(ln(step)) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING)) AS factor FROM sp)"""


@query("adj_01_event_factor", with_views(f"{_STEPS}\nSELECT i, d, round(step, 8) AS step, round(ln(factor), 6) AS factor FROM fa", BARS, ACTIONS))
def adj_01(spark, sf_dir):
    f = adj.adjustment_factors(bars(spark, sf_dir), actions(spark, sf_dir))
    return f.select("i", "d", F.round("step", 8).alias("step"), F.round(F.ln("factor"), 6).alias("factor"))


@query("adj_02_compare_vendor", with_views("""v AS (SELECT i, d, close AS factor FROM bars), n AS (SELECT i, d, factor / first_value(factor) OVER (PARTITION BY i ORDER BY d) AS own FROM v),
m AS (SELECT i, d, factor * 2 / first_value(factor * 2) OVER (PARTITION BY i ORDER BY d) AS vendor FROM v) SELECT i, d, round(own, 8) AS own, abs(own - vendor) <= 1e-10 + 1e-4 * abs(vendor) AS same FROM n JOIN m USING (i, d)""", BARS))
def adj_02(spark, sf_dir):
    own = bars(spark, sf_dir).select("i", "d", F.col("close").alias("factor"))
    found = adj.compare_factors(own, own.withColumn("factor", F.col("factor") * 2))
    return found.select("i", "d", F.round("own", 8).alias("own"), "same")


@query("adj_03_adjusted_bars", with_views(f"{_STEPS}\nSELECT i, d, round(ln(close * factor), 5) AS close_post, round(ln(coalesce(lag(close * factor) OVER (PARTITION BY i ORDER BY d), open * factor)), 5) AS pre_close_post FROM fa", BARS, ACTIONS))
def adj_03(spark, sf_dir):
    rows = adj.adjusted(adj.adjustment_factors(bars(spark, sf_dir), actions(spark, sf_dir)))
    return rows.select("i", "d", F.round(F.ln("close_post"), 5).alias("close_post"), F.round(F.ln("pre_close_post"), 5).alias("pre_close_post"))


@query("adj_04_vendor_factor", with_views("""v AS (SELECT i, d, volume AS f FROM bars WHERE paused)
SELECT i, d, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(f IGNORE NULLS) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS factor FROM bars LEFT JOIN v USING (i, d)""", BARS))
def adj_04(spark, sf_dir):
    b = bars(spark, sf_dir)
    return adj.vendor_adjusted(b, b.where("paused").select("i", "d", F.col("volume").alias("factor"))).select("i", "d", "factor")


#: Cumulative facts per instrument and quarter, from orders: revenue (status O) and costs (status F).
_FACTS = """q AS (SELECT i, code AS item, (period + INTERVAL 1 DAY + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period, round(sum(value), 2) AS v FROM metrics WHERE code IN ('O', 'F') GROUP BY 1, 2, 3),
f AS (SELECT i, item, period, (period + 40 + (i % 7)::INT * 10)::DATE AS available, sum(v) OVER (PARTITION BY i, item, year(period) ORDER BY period) AS value FROM q)"""


def _facts(spark, sf_dir):
    from pyspark.sql import Window as W

    q = metrics(spark, sf_dir).where("code in ('O', 'F')").groupBy("i", F.col("code").alias("item"), F.last_day(F.add_months(F.date_add("period", 1), 2)).alias("period")).agg(F.round(F.sum("value"), 2).alias("v"))
    year = W.partitionBy("i", "item", F.year("period")).orderBy("period")
    return q.select("i", "item", "period", F.date_add("period", (40 + F.col("i") % 7 * 10).cast("int")).alias("available"), F.sum("v").over(year).alias("value"))


_QUARTERS = f"""{_FACTS},
sq AS (SELECT a.i, a.item, a.period, a.available, a.value AS ytd, CASE WHEN month(a.period) = 3 THEN a.value ELSE a.value - b.value END AS single FROM f a LEFT JOIN f b ON a.i = b.i AND a.item = b.item AND b.period = last_day((a.period - INTERVAL 3 MONTH)::DATE)),
tt AS (SELECT a.*, a.single + b.single + c.single + e.single AS ttm FROM sq a LEFT JOIN sq b ON a.i = b.i AND a.item = b.item AND b.period = last_day((a.period - INTERVAL 3 MONTH)::DATE)
  LEFT JOIN sq c ON a.i = c.i AND a.item = c.item AND c.period = last_day((a.period - INTERVAL 6 MONTH)::DATE) LEFT JOIN sq e ON a.i = e.i AND a.item = e.item AND e.period = last_day((a.period - INTERVAL 9 MONTH)::DATE))"""


@query("fin_05_quarters_ttm_yoy", with_views(f"{_QUARTERS}\nSELECT a.i, a.item, a.period, round(a.ytd, 2) AS ytd, round(a.single, 2) AS single_quarter, round(a.ttm, 2) AS ttm, round(a.ttm / b.ttm - 1, 6) AS ttm_yoy FROM tt a LEFT JOIN tt b ON a.i = b.i AND a.item = b.item AND b.period = last_day((a.period - INTERVAL 12 MONTH)::DATE)", METRICS))
def fin_05(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    known = fin.knowledge(f, f, ["i"], 9)
    out = fin.derived(known, ["i"])
    # An event tells about its own period for the items it carries.
    own = f.select("i", "item", "period", "available")
    return out.join(own, ["i", "item", "period", "available"]).select("i", "item", "period", *[F.round(c, 2).alias(c) for c in ("ytd", "single_quarter", "ttm")], F.round("ttm_yoy", 6).alias("ttm_yoy"))


@query("fin_02_revisions", with_views("SELECT id, row_number() OVER (PARTITION BY i, code, period ORDER BY available, basis, id) AS revision_sequence FROM metrics", METRICS))
def fin_02(spark, sf_dir):
    return fin.revision_sequence(metrics(spark, sf_dir), ["i", "code", "period"], ["available", "basis", "id"]).select("id", "revision_sequence")


@query("fin_01_melt", "SELECT c_custkey, item, value FROM (UNPIVOT (SELECT c_custkey, c_acctbal, c_nationkey::DOUBLE AS c_nationkey FROM customer) ON c_acctbal, c_nationkey INTO NAME item VALUE value)")
def fin_01(spark, sf_dir):
    wide = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return fin.statements_to_facts(wide, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("fin_03_knowledge", with_views(f"""{_FACTS}
SELECT e.i, e.period, e.available, f.item, count(DISTINCT f.period) AS known FROM (SELECT DISTINCT i, period, available FROM f) e JOIN f ON f.i = e.i AND f.available <= e.available GROUP BY 1, 2, 3, 4""", METRICS))
def fin_03(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    return fin.knowledge(f, f, ["i"]).select("i", "period", "available", "item", F.size("known").cast("long").alias("known"))


@query("fin_07_ratios", with_views(f"""{_QUARTERS},
w AS (SELECT i, period, max(ttm) FILTER (WHERE item = 'O') AS revenue, max(ttm) FILTER (WHERE item = 'F') AS cost FROM tt GROUP BY 1, 2)
SELECT i, period, CASE WHEN revenue > 0 THEN round((revenue - cost) / revenue, 6) END AS margin FROM w""", METRICS))
def fin_07(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    out = fin.derived(fin.knowledge(f, f, ["i"], 9), ["i"]).join(f.select("i", "item", "period", "available"), ["i", "item", "period", "available"])
    pick = lambda item: F.max(F.when(F.col("item") == item, F.col("ttm")))
    wide = out.groupBy("i", "period").agg(pick("O").alias("revenue"), pick("F").alias("cost"))
    return wide.select("i", "period", F.when(F.col("revenue") > 0, F.round((F.col("revenue") - F.col("cost")) / F.col("revenue"), 6)).alias("margin"))


@query("dq_03_prices", with_views("SELECT count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS not_positive, count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS outside_range, count(*) FILTER (WHERE volume < 0 OR amount < 0) AS negative_flow FROM bars", BARS))
def dq_03(spark, sf_dir):
    return dq.counts(bars(spark, sf_dir), dq.price_rules())


@query("dq_04_orphans", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dq_04(spark, sf_dir):
    return dq.orphans(table(spark, sf_dir, "lineitem"), "l_partkey", table(spark, sf_dir, "part").where("p_size > 5"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("dq_07_flow_balance", "SELECT count(*) FILTER (WHERE NOT abs(l_extendedprice - l_tax - l_discount) <= 0.01 + 1e-6 * abs(l_discount)) AS l_discount_unbalanced FROM lineitem")
def dq_07(spark, sf_dir):
    return dq.counts(table(spark, sf_dir, "lineitem"), dq.flow_rules([("l_extendedprice", "l_tax", "l_discount")]))


@query("dq_08_revision_gaps", with_views("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY i, code, basis ORDER BY available, id) AS n, (id % 3) + 1 AS s FROM metrics) WHERE n <> s", METRICS))
def dq_08(spark, sf_dir):
    rows = metrics(spark, sf_dir).withColumn("s", F.col("id") % 3 + 1)
    return dq.revision_gaps(rows, ["i", "code", "basis"], ["available", "id"], "s").select("id")


@query("dq_09_factor_contract", with_views("SELECT count(*) AS rows, count(DISTINCT i) AS instruments, count(DISTINCT d) AS dates, count(*) - count(value) AS missing, min(value) AS low, max(value) AS high FROM (SELECT d, i, close AS value FROM bars)", BARS))
def dq_09(spark, sf_dir):
    return dq.check_factor(bars(spark, sf_dir).select("d", "i", F.col("close").alias("value")))


@query("dq_12_quarantine", "SELECT c_custkey, CASE WHEN c_acctbal < -990 THEN 'deep' ELSE 'rich' END AS reason FROM customer WHERE c_acctbal < -990 OR c_acctbal > 9990")
def dq_12(spark, sf_dir):
    _, bad = dq.quarantine(table(spark, sf_dir, "customer"), {"deep": F.col("c_acctbal") < -990, "rich": F.col("c_acctbal") > 9990}, share=0.01)
    return bad.select("c_custkey", "reason")


@query("ing_07_abutting_windows", "SELECT o_custkey, day, o_orderstatus, lead(day) OVER (PARTITION BY o_custkey ORDER BY day) AS effective_to FROM (SELECT o_custkey, o_orderdate::DATE AS day, o_orderstatus, row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def ing_07(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_orderstatus")
    return iv.abutting(log, ["o_custkey"], "day", "o_orderkey").select("o_custkey", "day", "o_orderstatus", "effective_to")


@query("ing_12_filled_halts", with_views("""x AS (SELECT i, d, close, volume, false AS halted FROM bars UNION ALL
  SELECT n.i, c.d, NULL, 0, true FROM cal c CROSS JOIN instruments n WHERE c.d >= listed AND (delisted IS NULL OR c.d < delisted) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.i = n.i AND b.d = c.d))
SELECT * FROM (SELECT i, d, last_value(close IGNORE NULLS) OVER (PARTITION BY i ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, volume, halted FROM x) WHERE close IS NOT NULL""", BARS, CALENDAR, INSTRUMENTS))
def ing_12(spark, sf_dir):
    return iv.filled_halts(bars(spark, sf_dir), calendar(spark, sf_dir), instruments(spark, sf_dir)).select("i", "d", "close", "volume", "halted")


@query("ing_16_members_to_intervals", with_views("SELECT i, min(d) AS effective_from, max(d) AS effective_to FROM (SELECT b.i, b.d, idx - row_number() OVER (PARTITION BY b.i ORDER BY idx) AS run FROM bars b JOIN cal USING (d)) GROUP BY i, run", BARS, CALENDAR))
def ing_16(spark, sf_dir):
    return iv.members_to_intervals(bars(spark, sf_dir).select("i", "d"), calendar(spark, sf_dir), ["i"], "d")


@query("ing_17_codes_to_intervals", with_views("""c AS (SELECT i, d, (volume > 50)::VARCHAR AS code FROM bars),
g AS (SELECT *, CASE WHEN code IS NOT DISTINCT FROM lag(code) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM c WINDOW w AS (PARTITION BY i ORDER BY d)),
r AS (SELECT *, sum(c) OVER (PARTITION BY i ORDER BY d ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT i, code, min(d) AS effective_from, max(d) AS effective_to FROM r GROUP BY i, code, run""", BARS))
def ing_17(spark, sf_dir):
    daily = bars(spark, sf_dir).select("i", "d", (F.col("volume") > 50).cast("string").alias("code"))
    return iv.codes_to_intervals(daily, "i", "d", "code")


@query("ing_20_calendar_exchanges", with_views("SELECT d, x AS exchange FROM cal CROSS JOIN (SELECT unnest(['XSHG', 'XSHE']) AS x)", CALENDAR))
def ing_20(spark, sf_dir):
    return calendar(spark, sf_dir).select("d", F.explode(F.array(F.lit("XSHG"), F.lit("XSHE"))).alias("exchange"))
