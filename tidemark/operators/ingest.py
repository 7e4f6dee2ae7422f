"""From source-shaped tables to the canonical ones.

Sources give rows as they were recorded: several versions of a listing, events of different kinds in one row, values
in percent or per ten shares. Every function here is one lazy plan; what is dropped can be had by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.asof import asof_backward, latest_by
from tidemark.functions.scalar import finite, ratio, record_id
from tidemark.operators.intervals import next_session

#: Marks in the names of exchange-traded funds that settle on the same day, and on the next one.
SAME_DAY_MARKS = ("跨境", "海外", "恒生", "标普", "纳指", "日经", "德国", "法国", "黄金", "商品", "原油", "债券", "货币")
NEXT_DAY_MARKS = ("沪深", "中证", "上证", "深证", "创业", "科创", "红利", "央企", "国企", "A股", "股票")

#: The demo market rules, in basis points and currency units.
DEMO_RULE = {"commission_bps": 3.0, "minimum_commission": 5.0, "sell_tax_bps": 5.0, "buy_tax_bps": 0.0, "transfer_fee_bps": 0.1, "currency": "CNY"}


def lineage(prefix: str, source_id: Column, updated: Column) -> list[Column]:
    """The columns that say where a row came from and when the source changed it (UTC)."""
    return [F.concat(F.lit(f"{prefix}:"), source_id.cast("string")).alias("source_record_id"), updated.cast("timestamp").alias("source_updated_at")]


def listings(securities: DataFrame, bars: DataFrame, exchanges: list[str]) -> DataFrame:
    """The last version of every listing in equities of the exchanges, without retired tickers that never had a bar.

    Columns in: security_id, instrument, exchange, asset_class, currency, listed, delisted, updated. A relisting that
    shares an owner but has bars of its own stays.
    """
    c = F.col
    equities = securities.where(c("exchange").isin(exchanges) & (c("asset_class") == "E") & (F.coalesce("currency", F.lit("CNY")) == "CNY"))
    last = latest_by(equities, ["instrument"], ["listed", "updated", "security_id"])
    return last.join(bars.select("security_id").distinct(), "security_id", "left_semi")


def far_future_as_open(day: Column, year: int = 2200) -> Column:
    """Sources mark what has not ended with a date far away."""
    return F.when(F.year(day) < year, day)


def universe_windows(instruments: DataFrame, calendar: DataFrame) -> DataFrame:
    """(i, effective_from, effective_to, known): membership from listing to the last session before delisting.

    Where the calendar has none, the day before delisting ends it.
    """
    ends = instruments.select("i", "listed", "delisted", F.date_sub("delisted", 1).alias("__last"))
    sessions = calendar.select(F.lit(0).alias("__k"), F.col("d").alias("session"))
    met = asof_backward(ends.withColumn("__k", F.lit(0)), sessions.withColumnRenamed("session", "at").withColumn("session", F.col("at")), ["__k"], "__last", "at", ["session"])
    to = F.when(F.col("delisted").isNotNull(), F.coalesce("session", "__last"))
    return met.select("i", F.col("listed").alias("effective_from"), to.alias("effective_to"), F.col("listed").alias("known"))


def _event(kind, ex: str, announced: str, when: Column, cash=None, share=None, price=None, record=None, pay=None) -> Column:
    day = lambda x: (F.col(x) if x else F.lit(None)).cast("date")
    number = lambda x: (F.lit(0.0) if x is None else x).cast("double")
    fields = [
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        (ex if isinstance(ex, Column) else day(ex)).cast("date").alias("ex"),
        day(announced).alias("announced"),
        day(record).alias("record"),
        day(pay).alias("pay"),
        number(cash).alias("cash"),
        number(share).alias("share"),
        (F.lit(None) if price is None else price).cast("double").alias("price"),
    ]
    return F.when(when, F.struct(*fields))


def _events(rows: DataFrame, table: str, events: list[Column]) -> DataFrame:
    """One row per event that a source row holds, if it has an ex date and was announced."""
    told = rows.select("id", "i", F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select("id", "i", "e.*")
    told = told.where("ex is not null and announced is not null and i is not null")
    return told.select(record_id(F.lit(table), F.col("id"), F.col("kind")).alias("event_id"), F.concat(F.lit(f"{table}:"), F.col("id").cast("string")).alias("source_record_id"), "i", "kind", "record", "ex", "pay", "announced", "cash", "share", "price")


def corporate_actions(dividends: DataFrame, splits: DataFrame, rights: DataFrame) -> DataFrame:
    """Events from the three sources; a dividend row may hold cash and shares, other rows at most one event.

    dividends: id, i, ex, record, pay, listed_on, implemented (which gates visibility), cash, bonus, transfer.
    splits: id, i, resumed, base, published, ratio. rights: id, i, allotted, ex, record, pay, published, ratio, price.
    """
    n = lambda x: F.coalesce(finite(F.col(x)), F.lit(0.0))
    stock = n("bonus") + n("transfer")
    paid = _events(dividends, "dividends", [
        _event("cash_dividend", "ex", "implemented", n("cash") > 0, cash=n("cash"), record="record", pay="pay"),
        _event("bonus", "ex", "implemented", stock > 0, share=stock, record="record", pay="listed_on"),
    ])
    kind = F.when(n("ratio") >= 1, "split").otherwise("merge")
    cut = _events(splits, "splits", [_event(kind, F.coalesce("resumed", "base"), "published", n("ratio") > 0, share=n("ratio"), record="base")])
    offered = F.coalesce(F.col("allotted"), F.lit(False)) & (n("ratio") > 0) & finite(F.col("price")).isNotNull()
    issued = _events(rights, "rights", [_event("rights_issue", "ex", "published", offered, share=n("ratio"), price=F.col("price"), record="record", pay="pay")])
    return paid.unionByName(cut).unionByName(issued)


def per_ten_actions(rows: DataFrame) -> DataFrame:
    """(id, i, kind, ex, cash, share): plans quoted per ten shares, and fund splits quoted as a factor.

    Columns in: id, i, ex, cash_10, bonus_10, transfer_10, fund_factor; a fund's factor f gives f - 1 new shares each.
    """
    n = lambda x: F.coalesce(finite(F.col(x)), F.lit(0.0))
    share = (n("bonus_10") + n("transfer_10")) / 10
    events = F.array(
        F.when(n("cash_10") > 0, F.struct(F.lit("cash_dividend").alias("kind"), (n("cash_10") / 10).alias("cash"), F.lit(0.0).alias("share"))),
        F.when(share > 0, F.struct(F.lit("bonus").alias("kind"), F.lit(0.0).alias("cash"), share.alias("share"))),
        F.when((n("fund_factor") > 0) & (n("fund_factor") != 1), F.struct(F.when(n("fund_factor") > 1, "split").otherwise("merge").alias("kind"), F.lit(0.0).alias("cash"), n("fund_factor").alias("share"))),
    )
    return rows.where("ex is not null").select("id", "i", "ex", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("id", "i", "e.kind", "ex", "e.cash", "e.share")


def share_capital(changes: DataFrame, free: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Capital events (id, i, effective_from, available, total, free) with the free shares known at the change.

    ``changes``: id, i, changed, published, total; ``free``: i, changed, id, free. Visible when published, or changed
    where that is unknown; with a calendar, from the session after.
    """
    rows = asof_backward(changes, free.select("i", F.col("changed").alias("at"), F.struct("id", "free").alias("best")), ["i"], "changed", "at", ["best"])
    rows = rows.select("id", "i", F.col("changed").alias("effective_from"), F.coalesce("published", "changed").alias("available"), "total", F.col("best.free").alias("free"))
    return rows if calendar is None else next_session(rows.withColumnRenamed("available", "__told"), calendar, "__told", "available").select(*rows.columns)


def daily_valuation(base: DataFrame, dividends: DataFrame, market: DataFrame, capital: DataFrame) -> DataFrame:
    """(d, i, pe, market_cap, dividend_yield, a_shares, a_market_cap, available): a day's multiples with what the other
    sources know; yields come in percent, share counts are those in force."""
    rows = base.join(dividends.select("d", "i", "yield_percent"), ["d", "i"], "left").join(market.select("d", "i", "close"), ["d", "i"], "left")
    rows = asof_backward(rows, capital.select("i", F.col("effective_from").alias("from"), F.struct("id", "a_shares").alias("best")), ["i"], "d", "from", ["best"])
    shares = F.col("best.a_shares")
    return rows.select("d", "i", "pe", "market_cap", (F.col("yield_percent") / 100).alias("dividend_yield"), shares.alias("a_shares"), (shares * F.col("close")).alias("a_market_cap"), F.col("d").alias("available"))


def visible_from(day: Column, updated: Column, zone: str = "Asia/Shanghai") -> Column:
    """A row counts from its day, or from the local day of its last update where that is later."""
    return F.greatest(day, F.from_utc_timestamp(updated, zone).cast("date"))


def settlement_delay(name: Column, code: Column, overrides: dict[str, int] | None = None, same_day: tuple[str, ...] = SAME_DAY_MARKS, next_day: tuple[str, ...] = NEXT_DAY_MARKS) -> Column:
    """Days until bought funds may be sold: an override, else by marks in the name (same day first); null is undecided."""
    chain = F.when(F.lit(False), F.lit(0))
    for key, days in (overrides or {}).items():
        chain = chain.when(code == key, F.lit(days))
    holds = lambda marks: name.rlike("|".join(marks))
    return chain.when(holds(same_day), F.lit(0)).when(holds(next_day), F.lit(1))


def split_prices(pulled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, factors, bad) of pulled rows (d, i, open, close, volume, factor): rows without any price are no bars, and
    bars whose volume is not whole shares are bad."""
    some = pulled.where(F.coalesce("open", "close").isNotNull())
    whole = F.coalesce(F.col("volume") == F.round("volume"), F.lit(False))
    return some.where(whole).drop("factor"), some.where("factor is not null").select("d", "i", "factor"), some.where(~whole)


def clipped(intervals: DataFrame, keys: list[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """Intervals cut to a window; an end at or beyond the window's last day is open, and what lies outside is gone."""
    a, z = F.lit(first).cast("date"), F.lit(last).cast("date")
    rows = intervals.where((F.col(start) <= z) & (F.col(end).isNull() | (F.col(end) >= a)))
    others = [c for c in intervals.columns if c not in (start, end)]
    return rows.select(*others, F.greatest(F.col(start), a).alias(start), F.when(F.col(end) < z, F.col(end)).alias(end))


def demo_rules(calendar: DataFrame, exchanges: list[str], assets: list[str]) -> DataFrame:
    """One rule per exchange and asset type, valid from the calendar's first session."""
    span = calendar.agg(F.min("d").alias("effective_from"))
    cross = span.select(F.explode(F.array(*map(F.lit, exchanges))).alias("exchange"), "effective_from").select("*", F.explode(F.array(*map(F.lit, assets))).alias("asset_type"))
    rule = F.concat_ws("-", F.lit("demo"), "exchange", "asset_type")
    return cross.select(rule.alias("rule_id"), "exchange", "asset_type", "effective_from", F.lit(None).cast("date").alias("effective_to"), *[F.lit(v).alias(k) for k, v in DEMO_RULE.items()])


def vendor_metrics(rows: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(i, period, available, metric, value) of merged statements: the last version per period, each times its scale.

    Columns in: id, i, period, available, merged, and one per metric.
    """
    merged = latest_by(rows.where("merged"), ["i", "period"], ["available", "id"])
    long = merged.unpivot(["i", "period", "available"], list(scales), "metric", "raw").where("raw is not null")
    scale = F.element_at(F.create_map(*[x for k, v in scales.items() for x in (F.lit(k), F.lit(v))]), F.col("metric"))
    return long.select("i", "period", "available", "metric", (F.col("raw") * scale).alias("value"))


def year_to_date_only(rows: DataFrame, period: str, months: str) -> DataFrame:
    """Rows that cover the year so far: those whose length in months is the month of their end, or unknown."""
    return rows.where(F.col(months).isNull() | (F.col(months) == F.month(period)))


def share_of(top: Column, *below: tuple[Column, float]) -> Column:
    """``top`` by the first known of several denominators, each with a divisor of its own."""
    return F.coalesce(*[ratio(top, x / F.lit(by)) for x, by in below])
