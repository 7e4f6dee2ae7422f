"""Canonical tables from source-shaped views of the test tables, statement rules and run analysis, each against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import analysis as ana
from tidemark.operators import financial as fin
from tidemark.operators import ingest as ing
from tidemark.operators import intervals as iv
from tidemark.plans.finance import _FACTS, _facts
from tidemark.plans.registry import query
from tidemark.plans.views import BARS, CALENDAR, INSTRUMENTS, MEMBERSHIP, METRICS, bars, calendar, instruments, membership, metrics, table, with_views


@query("ing_06_listings", """WITH s AS (SELECT c_custkey AS security_id, c_custkey % 700 AS instrument, CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE 'Y' END AS exchange,
  CASE WHEN c_custkey % 5 = 0 THEN 'B' ELSE 'E' END AS asset_class, CASE WHEN c_custkey % 4 = 0 THEN 'CNY' WHEN c_custkey % 4 = 1 THEN 'USD' END AS currency, c_nationkey AS listed FROM customer),
e AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY listed DESC, security_id DESC) AS n FROM s WHERE exchange IN ('X', 'Y') AND asset_class = 'E' AND coalesce(currency, 'CNY') = 'CNY')
SELECT instrument, security_id, listed FROM e WHERE n = 1 AND security_id IN (SELECT o_custkey FROM orders)""")
def ing_06(spark, sf_dir):
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(
        k.alias("security_id"),
        (k % 700).alias("instrument"),
        F.when(k % 3 == 0, "X").otherwise("Y").alias("exchange"),
        F.when(k % 5 == 0, "B").otherwise("E").alias("asset_class"),
        F.when(k % 4 == 0, "CNY").when(k % 4 == 1, "USD").alias("currency"),
        F.col("c_nationkey").alias("listed"),
        F.lit(0).alias("updated"),
    )
    traded = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("security_id"))
    return ing.listings(s, traded, ["X", "Y"]).select("instrument", "security_id", "listed")


@query("ing_08_universe_windows", with_views("""SELECT i, listed AS effective_from, CASE WHEN delisted IS NOT NULL THEN coalesce((SELECT max(d) FROM cal WHERE d < delisted), (delisted - 1)::DATE) END AS effective_to FROM instruments""", CALENDAR, INSTRUMENTS))
def ing_08(spark, sf_dir):
    return ing.universe_windows(instruments(spark, sf_dir), calendar(spark, sf_dir)).select("i", "effective_from", "effective_to")


@query("ing_09_demo_rules", with_views("""SELECT 'demo-' || x || '-' || a AS rule_id, (SELECT min(d) FROM cal) AS effective_from, 3.0::DOUBLE AS commission_bps, 5.0::DOUBLE AS sell_tax_bps
FROM (SELECT unnest(['XSHG', 'XSHE']) AS x) CROSS JOIN (SELECT unnest(['stock', 'etf']) AS a)""", CALENDAR))
def ing_09(spark, sf_dir):
    return ing.demo_rules(calendar(spark, sf_dir), ["XSHG", "XSHE"], ["stock", "etf"]).select("rule_id", "effective_from", "commission_bps", "sell_tax_bps")


_SOURCES = """src AS (SELECT o_orderkey AS id, o_custkey % 25 AS i, o_orderstatus AS status, o_orderdate::DATE AS day, o_orderkey AS k FROM orders),
ev AS (SELECT 'dividends:' || id AS source_record_id, i, 'cash_dividend' AS kind, day AS ex, (day - 10)::DATE AS announced, (k % 7)::DOUBLE AS cash, 0::DOUBLE AS share FROM src WHERE status = 'F' AND k % 7 > 0 AND k % 11 <> 0
  UNION ALL SELECT 'dividends:' || id, i, 'bonus', day, (day - 10)::DATE, 0, (k % 3 + coalesce(CASE WHEN k % 4 > 0 THEN k % 4 END, 0)) / 10.0::DOUBLE FROM src WHERE status = 'F' AND k % 3 + k % 4 > 0 AND k % 11 <> 0
  UNION ALL SELECT 'splits:' || id, i, CASE WHEN k % 5 / 2.0::DOUBLE >= 1 THEN 'split' ELSE 'merge' END, CASE WHEN k % 2 = 0 THEN day ELSE (day - 3)::DATE END, (day - 20)::DATE, 0, k % 5 / 2.0::DOUBLE FROM src WHERE status = 'O' AND k % 5 > 0
  UNION ALL SELECT 'rights:' || id, i, 'rights_issue', day, (day - 30)::DATE, 0, 0.3::DOUBLE FROM src WHERE status = 'P' AND k % 2 = 1 AND k % 9 <> 0)"""


@query("ing_10_corporate_actions", f"WITH {_SOURCES}\nSELECT source_record_id, i, kind, ex, announced, cash, round(share, 6) AS share FROM ev")
def ing_10(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 25).alias("i"), "o_orderstatus", day.alias("day"), k.alias("k"))
    k = F.col("k")
    dividends = o.where("o_orderstatus = 'F'").select(
        "id", "i", F.col("day").alias("ex"), F.date_sub("day", 1).alias("record"), F.date_add("day", 3).alias("pay"), F.date_add("day", 4).alias("listed_on"),
        F.when(k % 11 != 0, F.date_sub("day", 10)).alias("implemented"), (k % 7).cast("double").alias("cash"), (k % 3 / 10).alias("bonus"), F.when(k % 4 > 0, k % 4 / 10).alias("transfer"),
    )
    splits = o.where("o_orderstatus = 'O'").select("id", "i", F.when(k % 2 == 0, F.col("day")).alias("resumed"), F.date_sub("day", 3).alias("base"), F.date_sub("day", 20).alias("published"), (k % 5 / 2).alias("ratio"))
    rights = o.where("o_orderstatus = 'P'").select(
        "id", "i", (k % 2 == 1).alias("allotted"), F.col("day").alias("ex"), F.date_sub("day", 1).alias("record"), F.date_add("day", 9).alias("pay"),
        F.date_sub("day", 30).alias("published"), F.lit(0.3).alias("ratio"), F.when(k % 9 != 0, F.lit(5.0)).alias("price"),
    )
    return ing.corporate_actions(dividends, splits, rights).select("source_record_id", "i", "kind", "ex", "announced", "cash", F.round("share", 6).alias("share"))


_CHANGES = """ch AS (SELECT o_orderkey AS id, o_custkey % 25 AS i, o_orderdate::DATE AS changed, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderdate::DATE + (o_orderkey % 9)::INT)::DATE END AS published, o_totalprice AS total FROM orders WHERE o_orderkey % 2 = 0),
fr AS (SELECT o_custkey % 25 AS i, o_orderdate::DATE AS changed, o_orderkey AS id, o_totalprice / 2 AS free FROM orders WHERE o_orderkey % 2 = 1),
cap AS (SELECT c.id, any_value(c.i) AS i, any_value(c.changed) AS effective_from, any_value(coalesce(c.published, c.changed)) AS available, any_value(c.total) AS total, arg_max(f.free, (f.changed, f.id)) AS free
  FROM ch c LEFT JOIN fr f ON f.i = c.i AND f.changed <= c.changed GROUP BY c.id)"""


def _capital(spark, sf_dir, cal=None):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 25).alias("i"), day.alias("changed"), F.when(k % 3 > 0, F.date_add(day, (k % 9).cast("int"))).alias("published"), F.col("o_totalprice").alias("total"))
    return ing.share_capital(o.where("id % 2 = 0"), o.where("id % 2 = 1").select("i", "changed", "id", (F.col("total") / 2).alias("free")), cal)


@query("ing_11_share_capital", f"WITH {_CHANGES}\nSELECT id, effective_from, available, total, free FROM cap")
def ing_11(spark, sf_dir):
    return _capital(spark, sf_dir).select("id", "effective_from", "available", "total", "free")


@query("ing_24_capital_next_session", with_views(f"""{_CHANGES}
SELECT id, coalesce((SELECT min(d) FROM cal WHERE d > cap.available), CASE WHEN dayofweek(available) = 5 THEN available + 3 WHEN dayofweek(available) = 6 THEN available + 2 ELSE available + 1 END)::DATE AS available FROM cap""", CALENDAR))
def ing_24(spark, sf_dir):
    return _capital(spark, sf_dir, calendar(spark, sf_dir)).select("id", "available")


@query("ing_13_daily_valuation", with_views(f"""{_CHANGES},
cp AS (SELECT b.i, b.d, arg_max(cap.total, (effective_from, id)) AS a_shares FROM bars b JOIN cap ON cap.i = b.i AND cap.effective_from <= b.d GROUP BY 1, 2)
SELECT b.d, b.i, round(close / 77, 6) AS pe, CASE WHEN NOT paused THEN round(volume / 100, 6) END AS dividend_yield, a_shares, CASE WHEN b.i % 3 > 0 THEN round(a_shares * close / 777, 2) END AS a_market_cap FROM bars b LEFT JOIN cp USING (i, d)""", BARS))
def ing_13(spark, sf_dir):
    b = bars(spark, sf_dir)
    base = b.select("d", "i", (F.col("close") / 77).alias("pe"), (F.col("close") * 1e6).alias("market_cap"))
    capital = _capital(spark, sf_dir).select("i", "id", "effective_from", F.col("total").alias("a_shares"))
    out = ing.daily_valuation(base, b.where("not paused").select("d", "i", F.col("volume").alias("yield_percent")), b.where("i % 3 > 0").select("d", "i", "close"), capital)
    return out.select("d", "i", F.round("pe", 6).alias("pe"), F.round("dividend_yield", 6).alias("dividend_yield"), "a_shares", F.round(F.col("a_market_cap") / 777, 2).alias("a_market_cap"))


@query("ing_14_visible_from", "SELECT event_id, greatest(ts::DATE, (ts + INTERVAL 8 HOUR)::DATE) AS available FROM events")
def ing_14(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ing.visible_from(F.col("ts").cast("date"), F.col("ts")).alias("available"))


@query("ing_18_per_ten_actions", """WITH r AS (SELECT o_orderkey AS id, o_custkey % 25 AS i, o_orderdate::DATE AS ex, o_orderkey AS k FROM orders)
SELECT id, i, kind, ex, round(cash, 6) AS cash, round(share, 6) AS share FROM (SELECT id, i, 'cash_dividend' AS kind, ex, k % 4 / 10.0::DOUBLE AS cash, 0 AS share FROM r WHERE k % 4 > 0
UNION ALL SELECT id, i, 'bonus', ex, 0, (k % 3 + k % 2) / 10.0::DOUBLE FROM r WHERE k % 3 + k % 2 > 0
UNION ALL SELECT id, i, CASE WHEN k % 5 / 2.0::DOUBLE > 1 THEN 'split' ELSE 'merge' END, ex, 0, k % 5 / 2.0::DOUBLE FROM r WHERE k % 5 > 0 AND k % 5 <> 2)""")
def ing_18(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 25).alias("i"), F.col("o_orderdate").cast("date").alias("ex"),
        (k % 4).cast("double").alias("cash_10"), (k % 3).cast("double").alias("bonus_10"), (k % 2).cast("double").alias("transfer_10"), (k % 5 / 2).alias("fund_factor"),
    )
    return ing.per_ten_actions(rows).select("id", "i", "kind", "ex", F.round("cash", 6).alias("cash"), F.round("share", 6).alias("share"))


@query("ing_19_settlement_delay", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 2 WHEN regexp_matches(p_type, 'BRASS|STEEL') THEN 0 WHEN regexp_matches(p_type, 'ECONOMY|SMALL') THEN 1 END AS delay FROM part")
def ing_19(spark, sf_dir):
    delay = ing.settlement_delay(F.col("p_type"), F.col("p_brand"), {"Brand#11": 2}, ("BRASS", "STEEL"), ("ECONOMY", "SMALL"))
    return table(spark, sf_dir, "part").select("p_partkey", delay.alias("delay"))


_PULLED = "p AS (SELECT l_shipdate::DATE AS d, l_orderkey * 10 + l_linenumber AS i, CASE WHEN l_linenumber % 4 > 0 THEN l_extendedprice END AS close, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity ELSE l_quantity + 0.5 END AS volume, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS factor FROM lineitem)"


def _pulled(spark, sf_dir):
    n = F.col("l_linenumber")
    close = F.when(n % 4 > 0, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_orderkey") * 10 + n).alias("i"), close.alias("open"), close.alias("close"), F.when(n % 3 > 0, F.col("l_quantity")).otherwise(F.col("l_quantity") + 0.5).alias("volume"), F.when(n % 2 == 0, F.col("l_tax")).alias("factor"))


@query("ing_21_split_prices", f"WITH {_PULLED} SELECT 'bars' AS part, count(*) AS n, sum(volume) AS total FROM p WHERE close IS NOT NULL AND volume = round(volume) UNION ALL SELECT 'factors', count(*), round(sum(factor), 4) FROM p WHERE close IS NOT NULL AND factor IS NOT NULL UNION ALL SELECT 'bad', count(*), sum(volume) FROM p WHERE close IS NOT NULL AND volume <> round(volume)")
def ing_21(spark, sf_dir):
    good, factors, bad = ing.split_prices(_pulled(spark, sf_dir))
    told = lambda df, name, x: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(x), 4).alias("total"))
    return told(good, "bars", "volume").unionByName(told(factors, "factors", "factor")).unionByName(told(bad, "bad", "volume"))


@query("ing_23_record_ids", """SELECT c_custkey, sha256('{"p0":"' || c_custkey || '","p1":"' || c_mktsegment || '"}') AS record FROM customer""")
def ing_23(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", ing.record_id(F.col("c_custkey"), F.col("c_mktsegment")).alias("record"))


@query("ing_25_clipped", with_views("""SELECT id, greatest(start, DATE '1998-01-01') AS start, CASE WHEN "end" < DATE '2000-12-31' THEN "end" END AS "end" FROM membership WHERE start <= DATE '2000-12-31' AND ("end" IS NULL OR "end" >= DATE '1998-01-01')""", MEMBERSHIP))
def ing_25(spark, sf_dir):
    return ing.clipped(membership(spark, sf_dir), ["id"], "start", "end", "1998-01-01", "2000-12-31").select("id", "start", "end")


@query("fin_10_year_to_date", with_views("SELECT id, period FROM metrics WHERE id % 7 = 0 OR id % 12 + 1 = month(period)", METRICS))
def fin_10(spark, sf_dir):
    rows = metrics(spark, sf_dir).withColumn("months", F.when(F.col("id") % 7 != 0, F.col("id") % 12 + 1))
    return ing.year_to_date_only(rows, "period", "months").select("id", "period")


@query("fin_11_vendor_metrics", with_views("""m AS (SELECT *, row_number() OVER (PARTITION BY i, period ORDER BY available DESC, id DESC) AS n FROM metrics WHERE id % 3 > 0)
SELECT i, period, metric, round(value, 4) AS value FROM (SELECT i, period, 'price' AS metric, value * 0.01 AS value FROM m WHERE n = 1 UNION ALL SELECT i, period, 'id', id * 10000.0 FROM m WHERE n = 1 AND id % 2 = 0)""", METRICS))
def fin_11(spark, sf_dir):
    rows = metrics(spark, sf_dir).select("id", "i", "period", "available", (F.col("id") % 3 > 0).alias("merged"), F.col("value").alias("price"), F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("number"))
    out = ing.vendor_metrics(rows, {"price": 0.01, "number": 10000.0})
    return out.select("i", "period", F.when(F.col("metric") == "number", "id").otherwise(F.col("metric")).alias("metric"), F.round("value", 4).alias("value"))


@query("fin_01_published_facts", with_views("""x AS (SELECT o_orderkey, o_orderdate::DATE AS published, CASE WHEN o_orderstatus = 'F' THEN 'balance' ELSE 'income' END AS statement, o_totalprice, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 100 END AS eps FROM orders)
SELECT o_orderkey, item, unit, CASE WHEN statement = 'balance' THEN 'instant' ELSE 'ytd' END AS basis, value,
coalesce((SELECT min(d) FROM cal WHERE d > published), CASE WHEN dayofweek(published) = 5 THEN published + 3 WHEN dayofweek(published) = 6 THEN published + 2 ELSE published + 1 END)::DATE AS available
FROM (SELECT o_orderkey, published, statement, 'o_totalprice' AS item, 'CNY' AS unit, o_totalprice AS value FROM x UNION ALL SELECT o_orderkey, published, statement, 'eps', 'CNY/share', eps FROM x WHERE eps IS NOT NULL)""", CALENDAR))
def fin_01_published(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("published"), F.when(F.col("o_orderstatus") == "F", "balance").otherwise("income").alias("statement"), "o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 100).alias("eps"))
    out = fin.published_facts(o, calendar(spark, sf_dir), ["o_orderkey", "published", "statement"], ["o_totalprice", "eps"])
    return out.select("o_orderkey", "item", "unit", "basis", "value", "available")


def _items(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    return f.withColumn("item", F.when(F.col("item") == "O", "total_assets").otherwise("total_liability"))


@query("fin_04_instant_metrics", with_views(f"""{_FACTS},
e AS (SELECT DISTINCT i, period, available FROM f),
a AS (SELECT e.*, (SELECT max(value) FROM f WHERE f.i = e.i AND f.item = 'O' AND f.period = e.period AND f.available <= e.available) AS assets, (SELECT max(value) FROM f WHERE f.i = e.i AND f.item = 'F' AND f.period = e.period AND f.available <= e.available) AS debts FROM e),
s AS (SELECT a.i, a.period, arg_max(m.value, (m.period, m.available, m.id)) AS shares FROM a JOIN metrics m ON m.i = a.i AND m.code = 'P' AND m.period <= a.period AND m.available <= a.available GROUP BY 1, 2)
SELECT i, period, metric, round(value, 6) AS value FROM (SELECT i, period, 'total_assets' AS metric, assets AS value FROM a UNION ALL SELECT i, period, 'total_liability', debts FROM a
UNION ALL SELECT i, period, 'debt_to_assets', debts / assets FROM a WHERE assets > 0 UNION ALL SELECT i, period, 'shares', shares FROM s) WHERE value IS NOT NULL""", METRICS))
def fin_04(spark, sf_dir):
    f = _items(spark, sf_dir)
    capital = metrics(spark, sf_dir).where("code = 'P'").select("i", F.col("period").alias("effective_from"), "available", "id", F.col("value").alias("total"))
    known = fin.knowledge(f, f, ["i"], 1)
    # Equity of one unit shows the shares themselves through book value per share.
    one = f.select("i", "period", "available").distinct().select("i", "period", "available", F.lit("equities_parent_company_owners").alias("item"), F.map_from_arrays(F.array("period"), F.array(F.lit(1.0))).alias("known"))
    out = fin.instant_metrics(known.unionByName(one), ["i"], capital).where("metric <> 'equity_parent'")
    value = F.when(F.col("metric") == "book_value_per_share", 1 / F.col("value")).otherwise(F.col("value"))
    name = F.when(F.col("metric") == "book_value_per_share", "shares").otherwise(F.col("metric"))
    return out.select("i", "period", name.alias("metric"), F.round(value, 6).alias("value"))


@query("fin_08_yearly_growth", with_views(f"""{_FACTS},
sq AS (SELECT a.i, a.item, a.period, a.value AS ytd, CASE WHEN month(a.period) = 3 THEN a.value ELSE a.value - b.value END AS single FROM f a LEFT JOIN f b ON a.i = b.i AND a.item = b.item AND b.period = last_day((a.period - INTERVAL 3 MONTH)::DATE))
SELECT a.i, a.item, a.period, round(a.ytd / nullif(b.ytd, 0) - 1, 6) AS ytd_yoy, round(a.single / nullif(b.single, 0) - 1, 6) AS single_quarter_yoy FROM sq a LEFT JOIN sq b ON a.i = b.i AND a.item = b.item AND b.period = last_day((a.period - INTERVAL 12 MONTH)::DATE)""", METRICS))
def fin_08(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    out = fin.yearly_growth(fin.knowledge(f, f, ["i"], 9), ["i"]).join(f.select("i", "item", "period", "available"), ["i", "item", "period", "available"])
    return out.select("i", "item", "period", F.round("ytd_yoy", 6).alias("ytd_yoy"), F.round("single_quarter_yoy", 6).alias("single_quarter_yoy"))


@query("fin_09_lineage", with_views(f"""{_FACTS},
e AS (SELECT DISTINCT i, period, available FROM f)
SELECT e.i, e.period, f.item, '["' || string_agg(f.i || '-' || f.item || '-' || f.period, '","' ORDER BY f.period) || '"]' AS reports
FROM e JOIN f ON f.i = e.i AND f.available <= e.available AND f.period IN (e.period, last_day((e.period - INTERVAL 3 MONTH)::DATE), last_day((e.period - INTERVAL 6 MONTH)::DATE), last_day((e.period - INTERVAL 9 MONTH)::DATE), last_day((e.period - INTERVAL 12 MONTH)::DATE)) GROUP BY 1, 2, 3""", METRICS))
def fin_09(spark, sf_dir):
    f = _facts(spark, sf_dir).withColumn("report", F.concat_ws("-", "i", "item", "period"))
    return fin.source_reports(f, f, ["i"]).select("i", "period", "item", "reports")


_VALUES = "nav AS (SELECT o_orderdate::DATE AS d, o_custkey % 4 AS strategy, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 AS nav FROM orders GROUP BY 1, 2)"


def _values(spark, sf_dir):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d"), (F.col("o_custkey") % 4).alias("strategy")).agg(cents.alias("nav"))


@query("ana_05_strategy_pnl", f"""WITH {_VALUES}, full_days AS (SELECT d FROM nav GROUP BY d HAVING count(*) = 4)
SELECT d, strategy, round(pnl, 2) AS pnl FROM (SELECT d, strategy, nav - lag(nav) OVER (PARTITION BY strategy ORDER BY d) AS pnl FROM nav JOIN full_days USING (d)) WHERE pnl IS NOT NULL""")
def ana_05(spark, sf_dir):
    nav = _values(spark, sf_dir)
    whole = nav.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("d")  # every strategy has a value every day
    return ana.strategy_pnl(nav.join(whole, "d"), 1e-4).select("d", "strategy", F.round("pnl", 2).alias("pnl"))


@query("ana_03_attribution", f"""WITH {_VALUES}, a AS (SELECT d, sum(nav) AS nav FROM nav GROUP BY d),
c AS (SELECT o_orderdate::DATE AS d, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 100 AS price, sum(o_orderkey % 13)::DOUBLE AS action FROM orders GROUP BY 1)
SELECT d, round(account, 2) AS account, price, action, round(account - price - action, 2) AS residual FROM (SELECT d, nav - lag(nav) OVER (ORDER BY d) AS account FROM a) JOIN c USING (d)""")
def ana_03(spark, sf_dir):
    total = _values(spark, sf_dir).groupBy("d").agg(F.sum("nav").alias("nav"))
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    price = o.groupBy("d").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / 100).alias("pnl"))
    out = ana.attribution(total, {"price": price, "action": o.select("d", (F.col("o_orderkey") % 13).cast("double").alias("pnl"))})
    return out.select("d", F.round("account", 2).alias("account"), "price", "action", F.round("residual", 2).alias("residual"))


@query("ana_07_delisting", "SELECT count(DISTINCT l_suppkey) FILTER (WHERE l_shipdate::DATE = last AND l_returnflag = 'R') AS frozen, coalesce(sum(l_quantity) FILTER (WHERE l_shipdate::DATE = last AND l_returnflag = 'R'), 0) AS frozen_value, max(l_linenumber) AS stalest FROM lineitem, (SELECT max(l_shipdate)::DATE AS last FROM lineitem)")
def ana_07(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), F.col("l_suppkey").alias("i"), F.when(F.col("l_returnflag") == "R", "delisted_illiquid").alias("status"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("stale"))
    return ana.delisting_summary(rows)


@query("dq_05_overlaps", with_views("""SELECT id, next_start FROM (SELECT id, start, "end", lead(start) OVER (PARTITION BY i, industry, id % 50 ORDER BY start, "end" NULLS LAST) AS next_start FROM membership) WHERE next_start IS NOT NULL AND ("end" IS NULL OR next_start <= "end")""", MEMBERSHIP))
def dq_05(spark, sf_dir):
    rows = membership(spark, sf_dir).withColumn("bucket", F.col("id") % 50)
    return iv.overlaps(rows, ["i", "industry", "bucket"], "start", "end", tie="id").select("id", "next_start")
