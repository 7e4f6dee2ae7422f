"""Window expressions over per-instrument series.

A rolling window of ``n`` rows ends at the current row. It gives null unless at least ``need`` of its values are not
null (all ``n`` by default). Every window here takes the caller's keys and a total order, so results do not depend on
how rows arrive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(keys: list[str] | str, *order: str) -> WindowSpec:
    """The rows of one key in order."""
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(*order)


def lag_by(x: Column, k: int, w: WindowSpec) -> Column:
    """The value ``k`` rows back (ahead for negative ``k``)."""
    return F.lag(x, k).over(w) if k >= 0 else F.lead(x, -k).over(w)


def change(x: Column, k: int, w: WindowSpec) -> Column:
    """Relative change over ``k`` rows; null where the earlier value is null or zero."""
    return F.try_divide(x, F.lag(x, k).over(w)) - F.lit(1.0)


def last_rows(w: WindowSpec, n: int, until: int = 0) -> WindowSpec:
    return w.rowsBetween(until - n + 1, until)


def rolling(aggregate, x: Column, n: int, w: WindowSpec, need: int | None = None, until: int = 0) -> Column:
    """``aggregate(x)`` over the last ``n`` rows that end ``-until`` rows back."""
    frame = last_rows(w, n, until)
    return F.when(F.count(x).over(frame) >= (n if need is None else need), aggregate(x).over(frame))


def median(x: Column) -> Column:
    """The exact median, usable over any frame."""
    return F.percentile(x, F.lit(0.5))


def rolling_corr(x: Column, y: Column, n: int, w: WindowSpec) -> Column:
    """Correlation over ``n`` full rows; null where a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    frame = last_rows(w, n)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when((F.count(a).over(frame) >= n) & (spread > 0), F.try_divide(F.covar_pop(a, b).over(frame), spread))


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))


def running(aggregate, x: Column, w: WindowSpec) -> Column:
    return aggregate(x).over(w.rowsBetween(W.unboundedPreceding, 0))


def rank_share(x: Column, keys: list[str] | str) -> Column:
    """Rank with ties averaged, divided by the number of values that are not null."""
    keys = [keys] if isinstance(keys, str) else keys
    ordered = W.partitionBy(*keys).orderBy(x.asc_nulls_last())
    tied = W.partitionBy(*keys, x)
    mean_rank = F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), mean_rank / F.count(x).over(W.partitionBy(*keys)))


def rank_share_first(x: Column, keys: list[str] | str, tie: str) -> Column:
    """Rank with ties in the order of ``tie``, divided by the number of values."""
    keys = [keys] if isinstance(keys, str) else keys
    order = W.partitionBy(*keys).orderBy(x.asc_nulls_last(), F.col(tie))
    return F.when(x.isNotNull(), F.row_number().over(order) / F.count(x).over(W.partitionBy(*keys)))


def winsorised(x: Column, keys: list[str] | str, low: float = 0.01, high: float = 0.99) -> Column:
    own = W.partitionBy(*([keys] if isinstance(keys, str) else keys))
    ends = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(own)
    return F.when(x.isNotNull(), F.least(F.greatest(x, ends[0]), ends[1]))


def zscore(x: Column, keys: list[str] | str) -> Column:
    """Population z-score; 0 where the spread is 0."""
    own = W.partitionBy(*([keys] if isinstance(keys, str) else keys))
    spread = F.stddev_pop(x).over(own)
    return F.when(x.isNotNull(), F.when(spread > 0, (x - F.avg(x).over(own)) / spread).otherwise(F.lit(0.0)))


def ewm(df: DataFrame, key: str, order: str, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """``df`` with exponential means ``e_t = a x_t + (1 - a) e_(t-1)``, ``a = 2 / (span + 1)``, seeded by the first row.

    ``spans`` maps each new column to (value column, span). The recursion has no window form: each key's rows meet in
    one batch, in order, and one pass per column goes over them. Rows whose value is null repeat the last mean, and
    the weight of what lies before them decays on; (key, order) must be unique.
    """
    values = sorted({v for v, _ in spans.values()})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{key}` {kinds[key]}", f"`{order}` {kinds[order]}", *[f"`{name}` double" for name in spans]])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        for name, (value, span) in spans.items():
            rows[name] = rows[value].astype(float).ewm(span=span, adjust=False).mean()
        return rows[[key, order, *spans]]

    made = df.select(key, order, *[F.col(v).cast("double").alias(v) for v in values]).groupBy(key).applyInPandas(fold, schema)
    return df.join(made, [key, order])


def runs(flag: Column, w: WindowSpec) -> Column:
    """A number per run of equal ``flag`` values, for islands."""
    changed = F.when(flag.eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return changed


def streak(df: DataFrame, sign: str, key: str, order: str, out: str, cap: int = 10, up: bool = True) -> DataFrame:
    """Adds how many rows in a row ``sign`` has been positive (negative with ``up=False``), at most ``cap``."""
    w = series(key, order)
    hit = F.coalesce(F.col(sign) > 0 if up else F.col(sign) < 0, F.lit(False))
    group = F.sum(F.when(hit, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("__hit", hit).withColumn("__group", group)
    inner = W.partitionBy(key, "__group").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return marked.withColumn(out, F.least(F.sum(F.col("__hit").cast("int")).over(inner), F.lit(cap)).cast("long")).drop("__hit", "__group")
