"""Publishing and guarded reads of a snapshot made of the test tables, and factors through the engine's cache."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.functions.stored import shared_root
from tidemark.functions.windows import change, series
from tidemark.operators import adjustment as adj
from tidemark.operators import ingest as ing
from tidemark.operators.engine import Factor, FactorEngine
from tidemark.operators.quality import balance_gaps
from tidemark.plans.registry import query
from tidemark.plans.views import ACTIONS, BARS, CALENDAR, actions, bars, calendar, instruments, membership, table, with_views
from tidemark.sources.snapshot import list_snapshots, publish

EXCHANGE = "XSHG"
LAST = dt.date(2001, 6, 30)


def _root(spark) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/snapshots-{uuid.uuid4().hex}"


def tables(spark, sf_dir) -> dict:
    """The canonical tables of a snapshot, from the views that the other queries use."""
    name = lambda c="i": F.col(c).cast("string")
    own = bars(spark, sf_dir)
    raw = own.select(F.col("d").alias("trade_date"), name().alias("instrument_id"), "open", "high", "low", "close", F.coalesce(F.lag("close").over(series("i", "d")), "open").alias("pre_close"), F.col("volume").cast("long").alias("volume"), "amount", "paused", F.lit(None).cast("double").alias("limit_up"), F.lit(None).cast("double").alias("limit_down"))
    inst = instruments(spark, sf_dir).select(name().alias("instrument_id"), F.col("name").alias("symbol"), F.lit(EXCHANGE).alias("exchange"), F.lit("stock").alias("asset_type"), F.col("listed").alias("list_date"), F.col("delisted").alias("delist_date"), F.lit(100).cast("long").alias("lot_size"), F.lit(1).cast("long").alias("sell_delay_days"))
    event = actions(spark, sf_dir).select(
        name("id").alias("event_id"), name().alias("instrument_id"), F.col("kind").alias("event_type"), F.date_sub("ex", 1).alias("record_date"), F.col("ex").alias("ex_date"), F.date_add("ex", 5).alias("pay_date"),
        F.col("cash").alias("cash_per_share"), F.col("share").alias("share_ratio"), F.when(F.col("active"), "active").otherwise("cancelled").alias("status"), F.col("announced").alias("announced_at"),
    )
    held = membership(spark, sf_dir)
    span = [F.col("start").alias("effective_from"), F.col("end").alias("effective_to"), F.col("known").alias("known_at")]
    return {
        "instruments": inst,
        "trade_calendar": calendar(spark, sf_dir).select(F.col("d").alias("trade_date"), F.lit(EXCHANGE).alias("exchange")),
        "daily_raw": raw,
        "corporate_actions": event,
        "universe_membership": held.select(F.concat(F.lit("u"), name("id")).alias("universe_id"), name().alias("instrument_id"), *span),
        "industry_membership": held.select(F.concat(F.lit("c"), name("id")).alias("classification"), F.col("industry").alias("industry_id"), name().alias("instrument_id"), *span),
        "market_rules": ing.demo_rules(calendar(spark, sf_dir), [EXCHANGE], ["stock", "etf"]),
    }


def _snapshot(spark, sf_dir):
    return publish(spark, tables(spark, sf_dir), _root(spark), "one")


@query("snk_01_publish", with_views("""SELECT 'daily_raw' AS name, count(*) AS n FROM bars UNION ALL SELECT 'trade_calendar', count(*) FROM cal UNION ALL SELECT 'corporate_actions', count(*) FROM actions
UNION ALL SELECT 'instruments', count(*) FROM nation UNION ALL SELECT 'market_rules', 2""", BARS, CALENDAR, ACTIONS))
def snk_01(spark, sf_dir):
    snap = _snapshot(spark, sf_dir)
    wanted = ("daily_raw", "trade_calendar", "corporate_actions", "instruments", "market_rules")
    return spark.createDataFrame([(k, snap.manifest["tables"][k]["rows"]) for k in wanted], "name string, n long")


@query("src_08_trading_bars", with_views("SELECT d AS trade_date, i::VARCHAR AS instrument_id, close FROM bars WHERE d <= DATE '2001-06-30' AND d >= DATE '1996-01-01'", BARS))
def src_08(spark, sf_dir):
    view = _snapshot(spark, sf_dir).trading(LAST)
    return view.bars(dt.date(1996, 1, 1), LAST, fields=["close"])


@query("src_06_events_by_cutoff", with_views("SELECT id::VARCHAR AS event_id, ex AS ex_date FROM actions WHERE announced <= DATE '2001-06-30'", ACTIONS))
def src_06(spark, sf_dir):
    return _snapshot(spark, sf_dir).research(LAST).table("corporate_actions").select("event_id", "ex_date")


@query("src_10_list_snapshots", "SELECT 'one' AS name")
def src_10(spark, sf_dir):
    root = _root(spark)
    publish(spark, tables(spark, sf_dir), root, "one")
    return spark.createDataFrame([(x,) for x in list_snapshots(root)], "name string")


@query("snk_06_factor_cache", with_views("""r AS (SELECT i, d, close / lag(close, 5) OVER (PARTITION BY i ORDER BY d) - 1 AS v FROM bars WHERE d <= DATE '2001-06-30'),
c AS (SELECT d FROM cal ORDER BY d LIMIT 1 OFFSET 40) SELECT d, i, round(v, 6) AS value FROM r WHERE v IS NOT NULL AND d >= (SELECT d FROM c)""", BARS, CALENDAR))
def snk_06(spark, sf_dir):
    """Computed once into the cache, then required from it."""
    days = [r.d for r in calendar(spark, sf_dir).collect()]  # sessions
    five = Factor("return_5", lambda c, _: c.bars.select("d", "i", change(F.col("close"), 5, series("i", "d")).alias("value")).where("value is not null"), lookback=len(days))
    engine = FactorEngine(spark, bars(spark, sf_dir), days, "test", _root(spark))
    start = sorted(days)[40]
    engine.compute(five, start, LAST)
    return engine.compute(five, start, LAST, policy="require").select("d", "i", F.round("value", 6).alias("value"))


@query("src_03_adjusted_bars", with_views("SELECT i, d, close FROM bars WHERE NOT paused", BARS))
def src_03(spark, sf_dir):
    """Adjusted by factors of 1, adjusted bars are the raw ones: the scan's columns and keys."""
    own = bars(spark, sf_dir).where("not paused")
    return adj.adjusted(own.withColumn("factor", F.lit(1.0))).select("i", "d", F.col("close_post").alias("close"))


@query("agg_20_balance_gaps", """WITH w AS (SELECT l_orderkey AS report, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_extendedprice END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_extendedprice END) AS c FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
SELECT report FROM w WHERE abs(a - b - c) > greatest(1.0, a * 1e-6)""")
def agg_20(spark, sf_dir):
    item = F.element_at(F.array(F.lit("total_assets"), F.lit("total_liability"), F.lit("total_equity")), F.col("l_linenumber"))
    facts = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("report"), item.alias("item"), F.col("l_extendedprice").alias("value"))
    return balance_gaps(facts, "report", "item", "value").select("report")
