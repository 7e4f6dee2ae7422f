"""Financial statements to metrics, as known at each disclosure.

Facts are cumulative over the fiscal year. For every disclosure event of an instrument the facts known by then are
taken, the latest version each; single quarters, trailing twelve months, ratios and growth follow from the map
``period -> value`` of that event, by exact quarters and never by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import ratio
from tidemark.operators.intervals import next_session


def statements_to_facts(statements: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """Wide statements as rows (keys, item, value), without nulls."""
    return statements.unpivot(keys, items, "item", "value").where("value is not null")


def revision_sequence(reports: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return reports.withColumn("revision_sequence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def knowledge(events: DataFrame, facts: DataFrame, keys: list[str], quarters: int | None = None) -> DataFrame:
    """(keys, period, available, item, known): for each event, the latest known value of every item and period.

    With ``quarters``, of that many quarter ends up to the event's: both sides then meet on instrument and quarter, and
    the work per event does not grow with the history (trailing growth needs nine). Versions collapse to the largest
    (available, report) before they become a map.
    """
    e = events.select(*keys, "period", "available").distinct()
    f = facts.select(*keys, F.col("period").alias("fact_period"), F.col("available").alias("fact_available"), "report", "item", "value")
    if quarters is None:
        met = e.join(f, keys)
    else:
        met = e.withColumn("fact_period", F.explode(F.array(*[quarter_back(F.col("period"), k) for k in range(quarters)]))).join(f, [*keys, "fact_period"])
    best = met.where("fact_available <= available").groupBy(*keys, "period", "available", "item", "fact_period").agg(F.max_by("value", F.struct("fact_available", "report")).alias("value"))
    return best.groupBy(*keys, "period", "available", "item").agg(F.map_from_entries(F.collect_list(F.struct("fact_period", "value"))).alias("known"))


def quarter_back(period: Column, n: int) -> Column:
    return F.last_day(F.add_months(period, -3 * n))


def at(known: Column, period: Column) -> Column:
    return F.try_element_at(known, period)


def single_quarter(known: Column, period: Column) -> Column:
    """The year to date in the first quarter, else its difference to the quarter before; null if either is missing."""
    return F.when(F.month(period) == 3, at(known, period)).otherwise(at(known, period) - at(known, quarter_back(period, 1)))


def ttm(known: Column, period: Column) -> Column:
    """The sum of four single quarters, all of which must be known."""
    return sum((single_quarter(known, quarter_back(period, k)) for k in range(1, 4)), single_quarter(known, period))


def growth(value_now: Column, value_then: Column) -> Column:
    return ratio(value_now, value_then) - 1


def derived(known_sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period, available, item, ytd, single_quarter, ttm, ttm_yoy) per event and item."""
    k, p = F.col("known"), F.col("period")
    year_ago = quarter_back(p, 4)
    return known_sets.select(*keys, "period", "available", "item", at(k, p).alias("ytd"), single_quarter(k, p).alias("single_quarter"), ttm(k, p).alias("ttm"), growth(ttm(k, p), ttm(k, year_ago)).alias("ttm_yoy"))


def ratios(wide: DataFrame) -> DataFrame:
    """Margins, coverage and returns from ttm columns revenue, operating_profit, gross_profit, net_profit, ocf, capex and balances."""
    c = F.col
    by_revenue = lambda x: F.when(c("revenue") > 0, c(x) / c("revenue"))
    mean_of = lambda x: F.when(c(x) + c(f"{x}_prior") > 0, (c(x) + c(f"{x}_prior")) / 2)
    return wide.select(
        "*",
        by_revenue("net_profit").alias("net_margin"),
        by_revenue("operating_profit").alias("operating_margin"),
        by_revenue("gross_profit").alias("gross_margin"),
        ratio(c("ocf"), c("net_profit")).alias("ocf_to_net_profit"),
        (c("ocf") - c("capex")).alias("free_cash_flow"),
        (c("net_profit") / mean_of("total_assets")).alias("roa"),
        (c("net_profit") / mean_of("equity")).alias("roe"),
        ratio(c("total_liability"), c("total_assets")).alias("debt_to_assets"),
    )


#: Items that are told per share or as a ratio; all others are in the currency.
PER_SHARE, RATIO = ("basic_eps", "diluted_eps", "eps"), ("roe", "roa", "gross_margin")


def unit_and_basis(item: Column, statement: Column) -> tuple[Column, Column]:
    """How an item is measured: balances at a moment, all else over the year so far."""
    unit = F.when(item.isin(*PER_SHARE), "CNY/share").when(item.isin(*RATIO), "ratio").otherwise(F.lit("CNY"))
    return unit, F.when(statement == "balance", "instant").otherwise(F.lit("ytd"))


def published_facts(statements: DataFrame, calendar: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """Wide statements (keys with ``statement`` and ``published``) as facts that count from the session after."""
    long = statements_to_facts(statements, keys, items)
    unit, basis = unit_and_basis(F.col("item"), F.col("statement"))
    return next_session(long.withColumn("unit", unit).withColumn("basis", basis), calendar, "published", "available")


def instant_metrics(known_sets: DataFrame, keys: list[str], capital: DataFrame | None = None) -> DataFrame:
    """(keys, period, available, metric, value) of an event's own period.

    Balances as told, per-share earnings with a fallback, leverage where assets are positive, the current ratio unless
    the firm shows items of finance houses, and book value by the shares in force (``capital``: i, effective_from,
    available, id, total).
    """
    told = known_sets.select(*keys, "period", "available", "item", at(F.col("known"), F.col("period")).alias("value"))
    of = lambda *items: F.coalesce(*[F.max(F.when(F.col("item") == x, F.col("value"))) for x in items])
    wide = told.groupBy(*keys, "period", "available").agg(
        of("total_assets").alias("total_assets"),
        of("total_liability").alias("total_liability"),
        of("equities_parent_company_owners").alias("equity_parent"),
        of("total_owner_equities", "total_sheet_owner_equities").alias("total_equity"),
        of("basic_eps", "eps").alias("basic_eps"),
        of("diluted_eps").alias("diluted_eps"),
        of("total_current_assets").alias("ca"),
        of("total_current_liability").alias("cl"),
        of("interest_income", "premiums_earned", "commission_income").isNotNull().alias("finance"),
    )
    c = F.col
    wide = wide.withColumn("debt_to_assets", F.when(c("total_assets") > 0, c("total_liability") / c("total_assets")))
    wide = wide.withColumn("current_ratio", F.when(~c("finance") & (c("cl") > 0), c("ca") / c("cl")))
    names = ["total_assets", "total_liability", "equity_parent", "total_equity", "basic_eps", "diluted_eps", "debt_to_assets", "current_ratio"]
    if capital is not None:
        best = F.max_by("total", F.struct("effective_from", "capital_at", "id"))
        held = capital.select(*keys, "effective_from", c("available").alias("capital_at"), "id", "total")
        met = wide.select(*keys, "period", "available").join(held, keys).where("effective_from <= period and capital_at <= available")
        shares = met.groupBy(*keys, "period", "available").agg(best.alias("shares"))
        wide = wide.join(shares, [*keys, "period", "available"], "left").withColumn("book_value_per_share", F.when(c("shares") > 0, c("equity_parent") / c("shares")))
        names.append("book_value_per_share")
    return wide.unpivot([*keys, "period", "available"], names, "metric", "value").where("value is not null")


def yearly_growth(known_sets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, period, available, item, ytd_yoy, single_quarter_yoy, ttm_yoy): each against the same quarter a year ago."""
    k, p = F.col("known"), F.col("period")
    then = quarter_back(p, 4)
    pairs = {"ytd_yoy": at, "single_quarter_yoy": single_quarter, "ttm_yoy": ttm}
    return known_sets.select(*keys, "period", "available", "item", *[growth(f(k, p), f(k, then)).alias(name) for name, f in pairs.items()])


def source_reports(events: DataFrame, facts: DataFrame, keys: list[str], quarters: int = 5) -> DataFrame:
    """(keys, period, available, item, reports): the sorted reports whose values an event's metrics of an item rest on.

    The versions in force of the last ``quarters`` quarter ends, so lineage does not depend on the order of metrics.
    """
    e = events.select(*keys, "period", "available").distinct()
    e = e.withColumn("fact_period", F.explode(F.array(*[quarter_back(F.col("period"), k) for k in range(quarters)])))
    f = facts.select(*keys, F.col("period").alias("fact_period"), F.col("available").alias("fact_available"), "report", "item")
    met = e.join(f, [*keys, "fact_period"]).where("fact_available <= available")
    best = met.groupBy(*keys, "period", "available", "item", "fact_period").agg(F.max(F.struct("fact_available", "report")).alias("best"))
    return best.groupBy(*keys, "period", "available", "item").agg(F.to_json(F.array_sort(F.collect_set("best.report"))).alias("reports"))
