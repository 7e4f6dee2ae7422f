"""Which instruments may be traded on a day, and why the others may not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalar import finite
from tidemark.functions.windows import ewm, median, rolling, series


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that fails (is not true), or null."""
    chain = None
    for name, passed in rules.items():
        fails = ~F.coalesce(passed, F.lit(False))
        chain = F.when(fails, name) if chain is None else chain.when(fails, name)
    return chain


def standard_universe(days: DataFrame, instruments: DataFrame, bars: DataFrame, membership: DataFrame | None = None, minimum_days: int = 0, window: int = 20, minimum_amount: float = 0.0) -> DataFrame:
    """(d, i, reason) per decision day (d) and instrument (i, listed, delisted); a null reason means eligible.

    With ``membership`` (i, start, end, known) only members known on the day appear. The median amount is that of the
    last ``window`` bars up to the day. Instruments are few beside bars, so they are paired with the decision days; the
    history of each cell comes from one line per instrument on which bars and days are laid together.
    """
    cells = instruments.select("i", "listed", "delisted").join(days.select("d").distinct())
    if membership is not None:
        m = membership.select(F.col("i").alias("mi"), "start", "end", "known")
        held = (F.col("i") == F.col("mi")) & (F.col("start") <= F.col("d")) & (F.col("end").isNull() | (F.col("end") >= F.col("d"))) & (F.col("known") <= F.col("d"))
        cells = cells.join(m, held, "left_semi")
    w = series("i", "d", "cell")
    line = bars.select("i", "d", "amount", F.lit(0).alias("cell")).unionByName(cells.select("i", "d", F.lit(None).cast("double").alias("amount"), F.lit(1).alias("cell")))
    seen = F.sum(1 - F.col("cell")).over(w.rowsBetween(W.unboundedPreceding, 0))
    own = W.partitionBy("i", "cell").orderBy("d")
    with_median = line.withColumn("seen", seen).withColumn("mid", F.when(F.col("cell") == 0, median(F.col("amount")).over(own.rowsBetween(1 - window, 0))))
    known = with_median.withColumn("mid", F.last("mid", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("cell = 1")
    rows = cells.join(known.select("i", "d", "seen", "mid"), ["i", "d"])
    rules = {
        "listed_days": F.col("listed").isNull() | (F.datediff("d", "listed") >= minimum_days),
        "delisted": F.col("delisted").isNull() | (F.col("delisted") > F.col("d")),
        "history": F.col("seen") >= max(1, window),
        "liquidity": F.col("mid") >= minimum_amount,
    }
    return rows.select("d", "i", first_reason(rules).alias("reason"))


def crossing_universe(bars: DataFrame, calendar: DataFrame, instruments: DataFrame, treated: DataFrame, span: int = 20, minimum_sessions: int = 120, minimum_price: float | None = None, minimum_amount: float = 5e7) -> DataFrame:
    """(d, i, reason) per bar: null where the close crosses its exponential mean from below and nothing excludes it.

    ``treated`` (i, start, end, known) lists special treatment; an end is not part of it. Reasons come in the order of
    the rules, so their counts per day are a waterfall.
    """
    w = series("i", "d")
    rows = ewm(bars.select("i", "d", "close", "amount", "volume", "paused"), "i", "d", {"mean": ("close", span)})
    rows = rows.withColumn("mean", F.when(F.row_number().over(w) >= span, F.col("mean")))
    rows = rows.withColumn("before", F.lag("close").over(w)).withColumn("mean_before", F.lag("mean").over(w)).withColumn("mid", rolling(median, F.col("amount"), 20, w))
    # Sessions since listing: the day's number minus that of the last session before listing.
    marks = instruments.select("i", F.date_sub("listed", 1).alias("d"), F.lit(None).cast("long").alias("idx")).unionByName(calendar.select(F.lit(None).cast("long").alias("i"), "d", "idx"))
    ahead = F.coalesce(F.max("idx").over(W.orderBy("d").rangeBetween(W.unboundedPreceding, 0)), F.lit(0))  # calendar and instruments only
    listing = marks.withColumn("ahead", ahead).where("i is not null").select("i", "ahead").join(instruments.select("i", "delisted"), "i")
    rows = rows.join(calendar, "d").join(listing, "i")
    t = treated.select(F.col("i").alias("ti"), "start", "end", "known")
    held = (F.col("i") == F.col("ti")) & (F.col("start") <= F.col("d")) & (F.col("end").isNull() | (F.col("end") > F.col("d"))) & (F.col("known") <= F.col("d"))
    flagged = rows.select("i", "d").join(t, held, "left_semi").withColumn("special", F.lit(True))
    rows = rows.join(flagged, ["i", "d"], "left")
    ready = F.col("before").isNotNull() & F.col("mean").isNotNull() & F.col("mean_before").isNotNull()
    rules = {
        "not_alive": F.col("delisted").isNull() | (F.col("delisted") > F.col("d")),
        "insufficient_listing": F.col("idx") - F.col("ahead") >= minimum_sessions,
        "special_treatment": F.col("special").isNull(),
        "paused": ~F.coalesce("paused", F.lit(True)),
        "zero_volume": F.coalesce("volume", F.lit(0.0)) > 0,
        "price": F.lit(True) if minimum_price is None else F.col("close") >= minimum_price,
        "liquidity_or_warmup": F.col("mid") >= minimum_amount,
        "not_ready": ready,
        "no_cross": (F.col("before") <= F.col("mean_before")) & (F.col("close") > F.col("mean")),
    }
    return rows.select("d", "i", first_reason(rules).alias("reason"))


def waterfall(universe: DataFrame) -> DataFrame:
    """(d, rows, eligible, reason counts as a map) of (d, i, reason)."""
    per = universe.groupBy("d", "reason").agg(F.count(F.lit(1)).alias("n"))
    excluded = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))
    return per.groupBy("d").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("eligible"), F.map_from_entries(F.array_sort(excluded)).alias("excluded"))


def clean_panel(panel: DataFrame, features: list[str], valid: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid label and finite features, the others with their ``exclusion_reason``)."""
    good = F.coalesce(F.col(valid), F.lit(False))
    whole = reduce(lambda a, b: a & b, (finite(F.col(c).cast("double")).isNotNull() for c in features), F.lit(True))
    reason = F.when(~good & ~whole, "invalid_label_and_nonfinite_feature").when(~good, "invalid_label").when(~whole, "nonfinite_feature")
    marked = panel.withColumn("exclusion_reason", reason)
    return marked.where("exclusion_reason is null").drop("exclusion_reason"), marked.where("exclusion_reason is not null")
