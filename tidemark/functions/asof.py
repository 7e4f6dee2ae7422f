"""As-of and temporal-validity joins, each with one shuffle per side and no row blow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` at or before its time, null where there is none.

    Both sides are laid in one line per key, right rows first within a time, and the last right row is carried on.
    Right rows that share key and time: the largest ``values`` win.
    """
    l_cols = left.columns
    packed = F.struct(*values)
    one = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.struct(*l_cols).alias("__left"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("__right"))
    two = right.select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), packed.alias("__right"))
    line = W.partitionBy(*by).orderBy("__at", "__side", "__right").rowsBetween(W.unboundedPreceding, 0)
    joined = one.unionByName(two).withColumn("__last", F.last("__right", ignorenulls=True).over(line)).where("__side = 1")
    return joined.select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def latest_by(df: DataFrame, keys: list[str], order: list[str], visible: Column | None = None) -> DataFrame:
    """Per key the row with the largest ``order``, among visible rows."""
    rows = df if visible is None else df.where(visible)
    best = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def metric_steps(metrics: DataFrame, keys: list[str], period: str, available: str, tie: str, value: str) -> DataFrame:
    """(keys, eligible, period, value): the step function of the value known over time.

    A row counts from ``greatest(available, period)`` on, and among rows that count the largest
    (period, available, tie) wins, so a late revision of an old period never replaces a newer one.
    """
    rank = F.struct(period, available, tie, value)
    rows = metrics.where(F.col(available).isNotNull() & F.col(period).isNotNull()).select(*keys, F.greatest(available, period).alias("eligible"), rank.alias("__rank"))
    line = W.partitionBy(*keys).orderBy("eligible", "__rank")
    best = F.max("__rank").over(line.rowsBetween(W.unboundedPreceding, 0))
    last = F.lead("eligible").over(line)
    steps = rows.withColumn("__best", best).withColumn("__next", last).where("__next is null or __next > eligible")
    return steps.select(*keys, "eligible", F.col(f"__best.{period}").alias(period), F.col(f"__best.{value}").alias(value))


def metric_panel(metrics: DataFrame, grid: DataFrame, keys: list[str], day: str, period: str, available: str, tie: str, value: str) -> DataFrame:
    """``grid`` (keys and ``day``) with the value known on each day."""
    steps = metric_steps(metrics, keys, period, available, tie, value)
    return asof_backward(grid, steps, keys, day, "eligible", [period, value])


def valid_at(day: Column, start: str, end: str, closed: bool = True, known: str | None = None, cutoff: Column | None = None) -> Column:
    """Whether an interval holds ``day``; the end counts if ``closed``, a null end is open."""
    ends = F.col(end).isNull() | ((F.col(end) >= day) if closed else (F.col(end) > day))
    test = (F.col(start) <= day) & ends
    return test & (F.col(known) <= cutoff) if known else test


def validity_steps(intervals: DataFrame, by: list[str], start: str, end: str, values: list[str], closed: bool = True) -> DataFrame:
    """(by, __at, __hit, values): from each day on, the values of the interval in force, of several the latest start's.

    A key's intervals are swept once with a heap; they are few beside the rows that meet them. Of equal starts the
    larger values win; an interval without a start is never in force.
    """
    import heapq
    from datetime import timedelta

    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema}
    n, late = len(by), timedelta(days=1 if closed else 0)

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        key = tuple(rows.iloc[0, :n])
        spans = [(a, None if z is None or z != z else z + late, tuple(v)) for a, z, *v in rows.iloc[:, n:].itertuples(index=False, name=None)]
        spans.sort(key=lambda x: (x[0], [(v is not None, v) for v in x[2]]))
        days = sorted({a for a, _, _ in spans} | {z for _, z, _ in spans if z is not None})
        out, held, k = [], [], 0
        for day in days:
            while k < len(spans) and spans[k][0] <= day:
                heapq.heappush(held, -k)  # the last in order wins
                k += 1
            while held and spans[-held[0]][1] is not None and spans[-held[0]][1] <= day:
                heapq.heappop(held)
            out.append((*key, day, bool(held), *(spans[-held[0]][2] if held else [None] * len(values))))
        return pd.DataFrame(out, columns=[*by, "__at", "__hit", *values])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`__at` {kinds[start]}", "`__hit` boolean", *[f"`{c}` {kinds[c]}" for c in values]])
    rows = intervals.where(F.col(start).isNotNull()).select(*by, start, end, *values)
    return rows.groupBy(*by).applyInPandas(sweep, schema)


def interval_join(rows: DataFrame, intervals: DataFrame, by: list[str], day: str, start: str, end: str, values: list[str], missing: dict[str, str] | None = None, closed: bool = True) -> DataFrame:
    """``rows`` with the ``values`` of the interval that holds the day; of several the latest start wins.

    Intervals of one key may overlap. They become steps first, so a row meets one step and not all intervals of its key.
    """
    steps = validity_steps(intervals, by, start, end, values, closed)
    steps = steps.select(*by, "__at", "__hit", *[F.col(v).alias(f"__{v}") for v in values])
    found = asof_backward(rows, steps, by, day, "__at", ["__hit", *[f"__{v}" for v in values]])
    missing = missing or {}
    return found.select(*rows.columns, *[F.coalesce(F.when(F.col("__hit"), F.col(f"__{v}")), F.lit(missing.get(v))).alias(v) for v in values])
