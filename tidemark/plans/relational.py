"""Scans, filters, joins, aggregates, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_backward, interval_join, latest_by, metric_panel, valid_at
from tidemark.functions.scalar import content_hash, prior_year, ratio
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, GRID, INSTRUMENTS, MEMBERSHIP, METRICS, actions, bars, calendar, grid, instruments, membership, metrics, table, with_views
from tidemark.sources.snapshot import scan


@query("src_01_pit_scan", with_views("SELECT d, i, close, volume FROM bars WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND i IN (1, 2, 3)", BARS))
def src_01(spark, sf_dir):
    rows = scan(bars(spark, sf_dir), day="d", instrument="i", start="1996-01-01", end="1996-12-31", instruments=[1, 2, 3], cutoff="1997-01-01", fields=["close", "volume"])
    return rows.select("d", "i", "close", "volume")


@query("src_01_visible_rows", with_views("SELECT i, code, period, available, id, value FROM metrics WHERE (available IS NULL OR available <= DATE '1998-06-30') AND i < 5", METRICS))
def src_01_visible(spark, sf_dir):
    rows = scan(metrics(spark, sf_dir), instrument="i", visible="available", cutoff="1998-06-30", instruments=[0, 1, 2, 3, 4])
    return rows.select("i", "code", "period", "available", "id", "value")


@query("src_02_raw_bars", with_views("SELECT d, i, open, high, low, close FROM bars WHERE d <= DATE '1997-03-31' AND d >= DATE '1997-01-01'", BARS))
def src_02(spark, sf_dir):
    return scan(bars(spark, sf_dir), day="d", instrument="i", start="1997-01-01", end="1997-03-31", cutoff="1997-03-31").select("d", "i", "open", "high", "low", "close")


@query("prj_03_unit_scaling", "SELECT p_partkey, p_size * 10000.0::DOUBLE AS shares, round(p_retailprice * 0.01::DOUBLE, 6) AS ratio FROM part")
def prj_03(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.lit(10000.0)).alias("shares"), F.round(F.col("p_retailprice") * F.lit(0.01), 6).alias("ratio"))


@query("prj_04_typed_coercion", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events")
def prj_04(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), "value")


@query("flt_02_valid_closed", with_views("SELECT id, i, industry FROM membership WHERE start <= DATE '1998-01-01' AND (\"end\" IS NULL OR \"end\" >= DATE '1998-01-01') AND known <= DATE '1998-01-01'", MEMBERSHIP))
def flt_02(spark, sf_dir):
    day = F.lit("1998-01-01").cast("date")
    return membership(spark, sf_dir).where(valid_at(day, "start", "end", known="known", cutoff=day)).select("id", "i", "industry")


@query("flt_03_valid_open", with_views("SELECT id, i FROM membership WHERE start <= DATE '1998-01-01' AND (\"end\" IS NULL OR \"end\" > DATE '1998-01-01')", MEMBERSHIP))
def flt_03(spark, sf_dir):
    return membership(spark, sf_dir).where(valid_at(F.lit("1998-01-01").cast("date"), "start", "end", closed=False)).select("id", "i")


@query("flt_04_listing_window", with_views("SELECT b.i, b.d, close FROM bars b JOIN instruments n ON b.i = n.i WHERE b.d >= listed AND (delisted IS NULL OR b.d < delisted)", BARS, INSTRUMENTS))
def flt_04(spark, sf_dir):
    return bars(spark, sf_dir).join(instruments(spark, sf_dir), "i").where(valid_at(F.col("d"), "listed", "delisted", closed=False)).select("i", "d", "close")


@query("flt_07_share_selector", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT starts_with(c_custkey::VARCHAR, '9') AND NOT starts_with(c_custkey::VARCHAR, '2')")
def flt_07(spark, sf_dir):
    code = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~code.startswith("9") & ~code.startswith("2")).select("c_custkey", "c_mktsegment")


@query("flt_11_positive_domain", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(1.0::DOUBLE / c_acctbal, 8) END AS yield FROM customer")
def flt_11(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.round(F.lit(1.0) / F.col("c_acctbal"), 8)).alias("yield"))


@query("flt_12_first_match", "SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'valid' END AS status FROM orders")
def flt_12(spark, sf_dir):
    status = F.when(F.col("o_totalprice") > 400000, "large").when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("valid")
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("join_01_inner_on_keys", with_views("SELECT i, d, 0.6::DOUBLE * a.close + 0.4::DOUBLE * b.amount AS value FROM bars a JOIN (SELECT i, d, amount FROM bars WHERE volume > 20) b USING (i, d)", BARS))
def join_01(spark, sf_dir):
    b = bars(spark, sf_dir)
    other = b.where("volume > 20").select("i", "d", "amount")
    return b.select("i", "d", "close").join(other, ["i", "d"]).select("i", "d", (F.lit(0.6) * F.col("close") + F.lit(0.4) * F.col("amount")).alias("value"))


@query("join_03_left", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def join_03(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("join_04_shifted_dates", with_views("SELECT b.i, b.d, e.close AS entry, x.close AS exit FROM bars b JOIN cal c ON b.d = c.d LEFT JOIN cal c1 ON c1.idx = c.idx + 1 LEFT JOIN cal c2 ON c2.idx = c.idx + 2 LEFT JOIN bars e ON e.i = b.i AND e.d = c1.d LEFT JOIN bars x ON x.i = b.i AND x.d = c2.d", BARS, CALENDAR))
def join_04(spark, sf_dir):
    b = bars(spark, sf_dir).join(calendar(spark, sf_dir), "d").select("i", "d", "idx", "close")
    # Exact sessions ahead: the next rows count only if their session numbers say so; no join is needed.
    w = W.partitionBy("i").orderBy("idx")
    ahead = lambda k: F.coalesce(*[F.when(F.lead("idx", j).over(w) == F.col("idx") + k, F.lead("close", j).over(w)) for j in range(1, k + 1)])
    return b.select("i", "d", ahead(1).alias("entry"), ahead(2).alias("exit"))


@query("join_05_asof_backward", with_views("SELECT b.i, b.d, m.value FROM bars b ASOF LEFT JOIN (SELECT i, available, max(value) AS value FROM metrics GROUP BY 1, 2) m ON b.i = m.i AND b.d >= m.available", BARS, METRICS))
def join_05(spark, sf_dir):
    return asof_backward(bars(spark, sf_dir).select("i", "d"), metrics(spark, sf_dir), ["i"], "d", "available", ["value"])


_PANEL = """SELECT g.d, k.i, k.code, m.value FROM grid g CROSS JOIN (SELECT DISTINCT i, code FROM metrics) k LEFT JOIN LATERAL (
  SELECT value FROM metrics m WHERE m.i = k.i AND m.code = k.code AND m.available <= g.d AND m.period <= g.d
  ORDER BY period DESC, available DESC, id DESC LIMIT 1) m ON true"""


@query("join_06_metric_panel", with_views(_PANEL, METRICS, CALENDAR, GRID))
def join_06(spark, sf_dir):
    m = metrics(spark, sf_dir)
    cells = m.select("i", "code").distinct().crossJoin(F.broadcast(grid(spark, sf_dir)))  # keys x month ends, as asked for
    return metric_panel(m, cells, ["i", "code"], "d", "period", "available", "id", "value").select("d", "i", "code", "value")


@query("join_06_latest_metrics", with_views("SELECT i, code, basis, period, available, id, value FROM (SELECT *, row_number() OVER (PARTITION BY i, code, basis ORDER BY period DESC, available DESC, id DESC) AS n FROM metrics WHERE available <= DATE '1998-12-31' AND period <= DATE '1998-12-31') WHERE n = 1", METRICS))
def join_06_latest(spark, sf_dir):
    day = F.lit("1998-12-31").cast("date")
    return latest_by(metrics(spark, sf_dir), ["i", "code", "basis"], ["period", "available", "id"], (F.col("available") <= day) & (F.col("period") <= day))


@query("join_07_capital_asof", with_views("SELECT i, arg_max(value, (period, available, id)) AS value FROM metrics WHERE available <= DATE '1999-06-30' AND period <= DATE '1999-06-30' AND code = 'O' GROUP BY i", METRICS))
def join_07(spark, sf_dir):
    rows = metrics(spark, sf_dir).where((F.col("available") <= "1999-06-30") & (F.col("period") <= "1999-06-30") & (F.col("code") == "O"))
    return rows.groupBy("i").agg(F.max_by("value", F.struct("period", "available", "id")).alias("value"))


@query("join_08_interval_join", with_views("""SELECT i, d, coalesce(industry, 'UNKNOWN') AS industry FROM (SELECT b.i, b.d, m.industry, row_number() OVER (PARTITION BY b.i, b.d ORDER BY m.start DESC NULLS LAST, m.industry DESC) AS n
FROM bars b LEFT JOIN membership m ON b.i = m.i AND m.start <= b.d AND (m."end" IS NULL OR m."end" >= b.d)) WHERE n = 1""", BARS, MEMBERSHIP))
def join_08(spark, sf_dir):
    days = bars(spark, sf_dir).select("i", "d")
    return interval_join(days, membership(spark, sf_dir), ["i"], "d", "start", "end", ["industry"], {"industry": "UNKNOWN"})


@query("join_09_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_09_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(big, "c_custkey", "left_semi").select("c_custkey")


@query("join_09_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_09_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("join_10_dictionary", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_10(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # 25 and 5 rows; Spark checks their size itself
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


_TREE = "tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent FROM part)"


@query("join_11_hierarchy", f"WITH RECURSIVE {_TREE}, up AS (SELECT id, id AS top, parent FROM tree UNION ALL SELECT u.id, t.id, t.parent FROM up u JOIN tree t ON u.parent = t.id) SELECT id, top FROM up WHERE parent IS NULL")
def join_11(spark, sf_dir):
    from tidemark.operators.intervals import root_of

    tree = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).cast("long").alias("parent"))
    return root_of(tree, "id", "parent").select("id", "top")


def _mean(rows: str) -> str:
    # Whole ten-thousandths are summed, so that the mean does not depend on the order of rows.
    return f"SELECT d, sum(round(close * 10000)::BIGINT)::DOUBLE / count(*) AS r FROM bars WHERE {rows} GROUP BY d"


@query("join_12_benchmark_returns", with_views(f"""SELECT a.d, a.r AS own, b.r AS bench
FROM ({_mean("i < 10")}) a JOIN ({_mean("i >= 10")}) b USING (d)""", BARS))
def join_12(spark, sf_dir):
    b = bars(spark, sf_dir)
    mean = F.sum(F.round(F.col("close") * 10000).cast("long")).cast("double") / F.count(F.lit(1))
    own, bench = (b.where(rows).groupBy("d").agg(mean.alias(name)) for rows, name in (("i < 10", "own"), ("i >= 10", "bench")))
    return own.join(bench, "d")


@query("join_13_gaps", with_views("SELECT n.i, c.d FROM cal c CROSS JOIN instruments n WHERE c.d >= listed AND (delisted IS NULL OR c.d < delisted) AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.i = n.i AND b.d = c.d)", BARS, CALENDAR, INSTRUMENTS))
def join_13(spark, sf_dir):
    from tidemark.operators.intervals import missing_sessions

    return missing_sessions(bars(spark, sf_dir), calendar(spark, sf_dir), instruments(spark, sf_dir))


@query("join_14_range_expansion", with_views("SELECT m.id, c.d FROM (SELECT * FROM membership WHERE \"end\" IS NOT NULL) m JOIN cal c ON c.d >= m.start AND c.d < m.\"end\"", CALENDAR, MEMBERSHIP))
def join_14(spark, sf_dir):
    from tidemark.operators.intervals import expand_sessions

    halts = membership(spark, sf_dir).where(F.col("end").isNotNull())
    return expand_sessions(halts, calendar(spark, sf_dir), "start", "end").select("id", "d")


@query("join_15_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s.s_suppkey AND l_discount > 0.09)")
def join_15(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(hit, "s_suppkey", "left_semi").select("s_suppkey")


@query("join_16_outer_alignment", with_views("SELECT i, d, round(a.close / nullif(b.amount, 0), 8) AS value FROM (SELECT i, d, close FROM bars WHERE i < 20) a FULL JOIN (SELECT i, d, amount FROM bars WHERE i > 3) b USING (i, d)", BARS))
def join_16(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.where("i < 20").select("i", "d", "close").join(b.where("i > 3").select("i", "d", "amount"), ["i", "d"], "full").select("i", "d", F.round(ratio(F.col("close"), F.col("amount")), 8).alias("value"))


@query("join_17_row_equality", "SELECT count(*)::BIGINT AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (l_linestatus IS DISTINCT FROM o_orderstatus) OR (l_shipdate::DATE < o_orderdate::DATE)")
def join_17(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    bad = ~F.col("l_linestatus").eqNullSafe(F.col("o_orderstatus")) | (F.col("l_shipdate").cast("date") < F.col("o_orderdate").cast("date"))
    return rows.agg(F.count_if(bad).alias("bad"))


@query("agg_01_daily_sums", with_views("SELECT d, round(sum(amount), 2) AS nav, sum(volume) AS cash FROM bars GROUP BY d", BARS))
def agg_01(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("d").agg(F.round(F.sum("amount"), 2).alias("nav"), F.sum("volume").alias("cash"))


@query("agg_02_distinct_counts", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderdate::DATE) AS days FROM orders GROUP BY 1")
def agg_02(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.col("o_orderdate").cast("date")).alias("days"))


@query("agg_03_concentration", with_views("SELECT d, round(max(amount / total), 8) AS top FROM (SELECT d, amount, sum(amount) OVER (PARTITION BY d) AS total FROM bars) GROUP BY d", BARS))
def agg_03(spark, sf_dir):
    share = F.col("amount") / F.sum("amount").over(W.partitionBy("d"))
    return bars(spark, sf_dir).withColumn("s", share).groupBy("d").agg(F.round(F.max("s"), 8).alias("top"))


@query("agg_04_sum_and_first", "SELECT l_partkey, sum(l_quantity) AS quantity, arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS price FROM lineitem GROUP BY 1")
def agg_04(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("price"))


@query("agg_05_conditional", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_rows, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 0), 2) AS big FROM lineitem GROUP BY 1")
def agg_05(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_rows"), F.round(F.coalesce(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("big"))


@query("agg_06_group_statistics", "SELECT p_size, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, max(p_retailprice) AS top FROM part GROUP BY 1")
def agg_06(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.percentile("p_retailprice", F.lit(0.5)), 6).alias("median"), F.max("p_retailprice").alias("top"))


@query("agg_08_numeric_quality", "SELECT count(*) AS rows, count(*) - count(c_acctbal) AS nulls, min(c_acctbal) AS low, max(c_acctbal) AS high, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS spread FROM customer")
def agg_08(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("rows"), F.count_if(x.isNull()).alias("nulls"), F.min(x).alias("low"), F.max(x).alias("high"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("spread"))


_Q = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@query("agg_09_distribution", "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 6) AS q{k}" for k, q in enumerate(_Q)) + ", round(avg(o_totalprice), 4) AS mean FROM orders")
def agg_09(spark, sf_dir):
    x = F.col("o_totalprice")
    all_q = table(spark, sf_dir, "orders").agg(F.percentile(x, F.array(*map(F.lit, _Q))).alias("q"), F.round(F.avg(x), 4).alias("mean"))
    return all_q.select(*[F.round(F.col("q")[k], 6).alias(f"q{k}") for k in range(len(_Q))], "mean")


@query("agg_10_by_year", "SELECT year(o_orderdate)::INT AS year, count(*) AS rows, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS spread, round(avg((o_totalprice > 150000)::INT), 8) AS share FROM orders GROUP BY 1")
def agg_10(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("spread"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("int")), 8).alias("share"))


@query("agg_12_null_coverage", with_views("SELECT round(count(\"end\") / count(*)::DOUBLE, 8) AS ends, round(count(known) / count(*)::DOUBLE, 8) AS known FROM membership", MEMBERSHIP))
def agg_12(spark, sf_dir):
    return membership(spark, sf_dir).agg(*[F.round(F.count(c) / F.count(F.lit(1)).cast("double"), 8).alias(n) for c, n in (("end", "ends"), ("known", "known"))])


@query("agg_14_argmax", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1")
def agg_14(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("agg_15_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_15(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("agg_16_compounding", with_views("SELECT i, round(exp(sum(ln(1 + r))), 6) AS growth FROM (SELECT i, d, close / lag(close) OVER (PARTITION BY i ORDER BY d) - 1 AS r FROM bars) WHERE r IS NOT NULL GROUP BY i", BARS))
def agg_16(spark, sf_dir):
    from tidemark.functions.windows import change, series

    r = bars(spark, sf_dir).withColumn("r", change(F.col("close"), 1, series("i", "d"))).where("r is not null")
    return r.groupBy("i").agg(F.round(F.product(1 + F.col("r")), 6).alias("growth"))


@query("agg_17_covariance", with_views("SELECT a.i AS x, b.i AS y, round(CASE WHEN a.i = b.i THEN 1.0 ELSE 0.9 END * covar_samp(a.close, b.close), 2) AS cov FROM bars a JOIN bars b USING (d) GROUP BY 1, 2 HAVING count(*) > 1", BARS))
def agg_17(spark, sf_dir):
    b = bars(spark, sf_dir)
    pairs = b.select("d", F.col("i").alias("x"), F.col("close").alias("cx")).join(b.select("d", F.col("i").alias("y"), F.col("close").alias("cy")), "d")
    cov = F.covar_samp("cx", "cy") * F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.9)
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.round(cov, 2).alias("cov")).where("n > 1").drop("n")


_WIDE = ", ".join(f"max(close) FILTER (WHERE i = {k}) AS c{k}" for k in range(25))


@query("agg_18_pivot", with_views(f"SELECT d, {_WIDE} FROM bars GROUP BY d", BARS))
def agg_18(spark, sf_dir):
    # One column per nation; the names are given, so no pass over the data looks for them.
    wide = bars(spark, sf_dir).groupBy("d").pivot("i", list(range(25))).agg(F.max("close"))
    return wide.select("d", *[F.col(str(k)).alias(f"c{k}") for k in range(25)])


@query("agg_19_unpivot", with_views("SELECT i, d, field, value FROM (UNPIVOT (SELECT i, d, open, close FROM bars) ON open, close INTO NAME field VALUE value)", BARS))
def agg_19(spark, sf_dir):
    return bars(spark, sf_dir).select("i", "d", "open", "close").unpivot(["i", "d"], ["open", "close"], "field", "value").where("value is not null")


@query("agg_21_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg_21(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg_23_content_hash")
def agg_23(spark, sf_dir):
    return content_hash(table(spark, sf_dir, "orders"))


_TOP100 = "top AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)"


@query("agg_24_lift", f"WITH {_TOP100} SELECT o_orderpriority, round((SELECT count(*) FROM top t WHERE t.o_orderpriority = o.o_orderpriority) / 100.0::DOUBLE / (count(*)::DOUBLE / (SELECT count(*) FROM orders)), 6) AS lift FROM orders o GROUP BY 1")
def agg_24(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    top = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("best"))
    every = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(W.partitionBy()))
    return every.join(top, "o_orderpriority", "left").select("o_orderpriority", F.round(F.coalesce("best", F.lit(0)) / F.lit(100.0) / (F.col("n").cast("double") / F.col("total")), 6).alias("lift"))


@query("top_01_total_order", with_views("SELECT i, d, close, row_number() OVER (PARTITION BY d ORDER BY close DESC, i) AS place FROM bars", BARS))
def top_01(spark, sf_dir):
    return bars(spark, sf_dir).select("i", "d", "close", F.row_number().over(W.partitionBy("d").orderBy(F.desc("close"), "i")).alias("place"))


@query("top_02_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_02(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("top_03_per_date", with_views("SELECT d, i, ret FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY ret DESC, i) AS n FROM (SELECT i, d, round(close / lag(close, 20) OVER (PARTITION BY i ORDER BY d) - 1, 6) AS ret FROM bars) WHERE ret IS NOT NULL) WHERE n <= 3", BARS))
def top_03(spark, sf_dir):
    from tidemark.operators.factors import momentum_top

    return momentum_top(bars(spark, sf_dir), 20, 3)


@query("top_05_last_n", with_views("SELECT i, d, amount FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d DESC) AS n FROM bars) WHERE n <= 20", BARS))
def top_05(spark, sf_dir):
    last = F.row_number().over(W.partitionBy("i").orderBy(F.desc("d")))
    return bars(spark, sf_dir).withColumn("n", last).where("n <= 20").select("i", "d", "amount")


@query("top_06_without_best", with_views("SELECT i, round(sum(ln(close)), 4) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY close DESC, d) AS n FROM bars) WHERE n > 10 GROUP BY i", BARS))
def top_06(spark, sf_dir):
    best = F.row_number().over(W.partitionBy("i").orderBy(F.desc("close"), "d"))
    return bars(spark, sf_dir).withColumn("n", best).where("n > 10").groupBy("i").agg(F.round(F.sum(F.ln("close")), 4).alias("rest"))


@query("set_01_union_by_name", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def set_01(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("set_02_difference", "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_02(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_nationkey").subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("set_03_intersection", "SELECT o_orderdate::DATE AS d FROM orders INTERSECT SELECT l_shipdate::DATE FROM lineitem")
def set_03(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).intersect(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")))


@query("set_04_key_equality", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS only_left, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS only_right")
def set_04(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"))


@query("fn_dates", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, week(o_orderdate)::INT AS w, (date_trunc('quarter', o_orderdate::DATE) - INTERVAL 1 DAY)::DATE AS q, (o_orderdate::DATE - INTERVAL 12 MONTH)::DATE AS prior FROM orders")
def fn_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.weekofyear(d).alias("w"), F.date_sub(F.trunc(d, "quarter"), 1).alias("q"), prior_year(d).alias("prior"))


@query("fn_strings", "SELECT p_partkey, upper(p_type) AS kind, split_part(p_brand, '#', 2) AS brand, regexp_matches(p_name, '(?i)green|steel') AS hit, concat_ws(':', p_brand, p_size::VARCHAR) AS id FROM part")
def fn_strings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_type").alias("kind"), F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand"), F.col("p_name").rlike("(?i)green|steel").alias("hit"), F.concat_ws(":", "p_brand", F.col("p_size").cast("string")).alias("id"))


@query("fn_math", "SELECT o_orderkey, round(ln(o_totalprice), 8) AS a, round(sqrt(o_totalprice), 8) AS b, floor(o_totalprice / 100)::BIGINT AS c, round(log2(1 + o_totalprice), 8) AS e, least(greatest(o_totalprice, 1000), 200000) AS f FROM orders")
def fn_math(spark, sf_dir):
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.ln(x), 8).alias("a"), F.round(F.sqrt(x), 8).alias("b"), F.floor(x / 100).cast("long").alias("c"), F.round(F.log2(1 + x), 8).alias("e"), F.least(F.greatest(x, F.lit(1000.0)), F.lit(200000.0)).alias("f"))
