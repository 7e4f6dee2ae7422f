"""Scalar expressions with the null rules of the engine: no NaN, no infinity, no division by zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """``x``, with NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    """``a / b`` where ``b`` is known and not zero, else ``otherwise``."""
    return F.when(b.isNotNull() & (b != 0), a / b).otherwise(F.lit(otherwise))


def positive_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def close_to(a: Column, b: Column, rtol: float = 1e-9, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def nulls_for_odd_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of all double columns as null, as at every boundary of the engine."""
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def prior_year(day: Column) -> Column:
    """The same day a year before; 29 February becomes the 28th."""
    return F.add_months(day, -12)


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, hash): independent of the order of rows."""
    cols = columns or tuple(df.columns)
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def record_id(*parts: Column) -> Column:
    """A stable id of a row's parts: SHA-256 of their JSON."""
    return F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)])), 256)
