"""Market-shaped views over the star-schema tables, as DataFrames and as the same definitions in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (i, d, open, high, low, close, volume, amount, paused): one instrument per supplier nation."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    # Money is summed in whole cents, so that sums do not depend on the order of rows.
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)
    grouped = rows.groupBy(F.col("s_nationkey").cast("long").alias("i"), F.col("l_shipdate").cast("date").alias("d")).agg(
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        cents.alias("amount"),
        F.bool_or(F.col("l_returnflag") == "R").alias("paused"),
    )
    return grouped.select("i", "d", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount", "paused")


BARS = """bars0 AS (SELECT s_nationkey::BIGINT AS i, l_shipdate::DATE AS d, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(l_quantity) AS volume, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS amount, bool_or(l_returnflag = 'R') AS paused
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
bars AS (SELECT i, d, (high + low) / 2 AS open, high, low, amount / volume AS close, volume, amount, paused FROM bars0)"""


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of five instruments (supplier nation modulo 5), which trade on nearly every session; paused only if all is."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.lit(100.0)
    grouped = rows.groupBy((F.col("s_nationkey") % 5).cast("long").alias("i"), F.col("l_shipdate").cast("date").alias("d")).agg(
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum("l_quantity").alias("volume"),
        cents.alias("amount"),
        F.bool_and(F.col("l_returnflag") == "R").alias("paused"),
    )
    return grouped.select("i", "d", ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", (F.col("amount") / F.col("volume")).alias("close"), "volume", "amount", "paused")


#: The same, under the name ``bars``, so that one text of SQL serves either view.
DENSE = """bars0 AS (SELECT (s_nationkey % 5)::BIGINT AS i, l_shipdate::DATE AS d, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  sum(l_quantity) AS volume, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS amount, bool_and(l_returnflag = 'R') AS paused
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
bars AS (SELECT i, d, (high + low) / 2 AS open, high, low, amount / volume AS close, volume, amount, paused FROM bars0)"""


def valuation(bars: DataFrame) -> DataFrame:
    """(d, i, dividend_yield, market_cap, circulating_cap, pe, pb) made from bars; some multiples are negative."""
    c = F.col("close")
    return bars.select(
        "d",
        "i",
        (F.col("volume") / 10000).alias("dividend_yield"),
        (c * 1e6).alias("market_cap"),
        (c * (F.lit(5e5) + F.col("i") * 1e4)).alias("circulating_cap"),
        (c / 50 - 25).alias("pe"),
        (c / 777 - 1).alias("pb"),
    )


VALUATION = """valuation AS (SELECT d, i, volume / 10000 AS dividend_yield, close * 1e6::DOUBLE AS market_cap,
  close * (5e5::DOUBLE + i * 1e4::DOUBLE) AS circulating_cap, close / 50 - 25 AS pe, close / 777 - 1 AS pb FROM bars)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions (d, idx), numbered from 1; one row per trading day, so the numbering in one task stays small."""
    days = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return days.withColumn("idx", F.row_number().over(W.orderBy("d")).cast("long"))


CALENDAR = "cal AS (SELECT d, row_number() OVER (ORDER BY d) AS idx FROM (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem))"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows (i, code, basis, period, available, id, value) from orders; late revisions occur naturally."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).cast("long").alias("i"),
        F.col("o_orderstatus").alias("code"),
        F.col("o_orderpriority").alias("basis"),
        F.date_sub(F.trunc(day, "quarter"), 1).alias("period"),
        F.date_add(day, (F.col("o_orderkey") % 120).cast("int")).alias("available"),
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("value"),
    )


METRICS = """metrics AS (SELECT (o_custkey % 25)::BIGINT AS i, o_orderstatus AS code, o_orderpriority AS basis,
  (date_trunc('quarter', o_orderdate::DATE) - INTERVAL 1 DAY)::DATE AS period,
  (o_orderdate::DATE + (o_orderkey % 120)::INT)::DATE AS available, o_orderkey AS id, o_totalprice AS value FROM orders)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends of the calendar (d): its last session of each month."""
    return calendar(spark, sf_dir).groupBy(F.trunc("d", "month").alias("m")).agg(F.max("d").alias("d")).select("d")


GRID = "grid AS (SELECT max(d) AS d FROM cal GROUP BY date_trunc('month', d))"


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership (universe, i, industry, start, end, known) of instruments, from customers' first and last orders."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"))
    rows = table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") % 25).cast("long").alias("i"),
        F.col("c_mktsegment").alias("industry"),
        "start",
        F.when(F.col("c_custkey") % 7 != 0, F.col("end")).alias("end"),
        F.date_add("start", (F.col("c_custkey") % 30).cast("int")).alias("known"),
    )


MEMBERSHIP = """membership AS (SELECT c_custkey AS id, (c_custkey % 25)::BIGINT AS i, c_mktsegment AS industry, s AS start,
  CASE WHEN c_custkey % 7 <> 0 THEN e END AS "end", (s + (c_custkey % 30)::INT)::DATE AS known
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments (i, name, listed, delisted): nations with a listing window around the calendar."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        n.alias("i"),
        F.col("n_name").alias("name"),
        F.date_add(F.lit("1995-01-01").cast("date"), (n * 17).cast("int")).alias("listed"),
        F.when(n % 5 == 0, F.date_add(F.lit("2000-01-01").cast("date"), (n * 11).cast("int"))).alias("delisted"),
    )


INSTRUMENTS = """instruments AS (SELECT n_nationkey::BIGINT AS i, n_name AS name, (DATE '1995-01-01' + (n_nationkey * 17)::INT)::DATE AS listed,
  CASE WHEN n_nationkey % 5 = 0 THEN (DATE '2000-01-01' + (n_nationkey * 11)::INT)::DATE END AS delisted FROM nation)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corporate actions (id, i, kind, ex, announced, cash, share, price, active) from the dearer orders."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    kind = F.when(k % 5 == 0, "bonus").when(k % 5 == 1, "split").when(k % 5 == 2, "rights_issue").otherwise("cash_dividend")
    rows = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 300000)
    return rows.select(
        k.alias("id"),
        (F.col("o_custkey") % 25).cast("long").alias("i"),
        kind.alias("kind"),
        day.alias("ex"),
        F.date_sub(day, (k % 20).cast("int")).alias("announced"),
        F.when(kind == "cash_dividend", (k % 50).cast("double")).otherwise(0.0).alias("cash"),
        F.when(kind == "split", 2.0).when(kind == "cash_dividend", 0.0).otherwise(0.1).alias("share"),
        F.when(kind == "rights_issue", 500.0).alias("price"),
        (k % 11 != 0).alias("active"),
    )


ACTIONS = """actions0 AS (SELECT o_orderkey AS k, o_custkey, o_orderdate::DATE AS day,
  CASE WHEN o_orderkey % 5 = 0 THEN 'bonus' WHEN o_orderkey % 5 = 1 THEN 'split' WHEN o_orderkey % 5 = 2 THEN 'rights_issue' ELSE 'cash_dividend' END AS kind
  FROM orders WHERE o_totalprice > 300000),
actions AS (SELECT k AS id, (o_custkey % 25)::BIGINT AS i, kind, day AS ex, (day - (k % 20)::INT)::DATE AS announced,
  CASE WHEN kind = 'cash_dividend' THEN (k % 50)::DOUBLE ELSE 0 END AS cash,
  CASE WHEN kind = 'split' THEN 2.0::DOUBLE WHEN kind = 'cash_dividend' THEN 0 ELSE 0.1::DOUBLE END AS share,
  CASE WHEN kind = 'rights_issue' THEN 500.0::DOUBLE END AS price, k % 11 <> 0 AS active FROM actions0)"""


def with_views(body: str, *views: str) -> str:
    """SQL text: the definitions of ``views``, then ``body`` (which may start with more definitions and a comma)."""
    head = "WITH " + ",\n".join(views)
    return f"{head},\n{body}" if body.lstrip().lower().split("(", 1)[0].strip().endswith(" as") else f"{head}\n{body}"
