"""Where tables come from: directories of files, SQL databases, paged services, files of signals."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ContractError
from tidemark.sources import schema as S


def read_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every canonical table found in ``folder`` as ``name.parquet``, ``name.csv`` or a Parquet directory ``name``."""
    found = {}
    for name in S.TABLES:
        if os.path.exists(p := os.path.join(folder, f"{name}.parquet")) or os.path.isdir(p := os.path.join(folder, name)):
            found[name] = spark.read.parquet(p)
        elif os.path.exists(p := os.path.join(folder, f"{name}.csv")):
            found[name] = spark.read.csv(p, header=True)
    missing = [t for t in S.REQUIRED if t not in found]
    if missing:
        raise ContractError(f"{folder} lacks {missing}")
    return found


def read_sql(spark: SparkSession, url: str, tables: dict[str, str] | None = None, queries: dict[str, str] | None = None, predicates: dict[str, list[str]] | None = None, **options: str) -> dict[str, DataFrame]:
    """Tables over JDBC, from a mapped table or a query each; ``predicates`` read one partition per condition."""
    found = {}
    for name, sql in (queries or {}).items():
        found[name] = spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    for name, source in (tables or {}).items():
        if name in found:
            continue
        parts = (predicates or {}).get(name)
        found[name] = spark.read.jdbc(url, source, predicates=parts, properties=options) if parts else spark.read.format("jdbc").options(url=url, dbtable=source, **options).load()
    return found


def month_chunks(column: str, first: str, last: str, watermark: str | None = None) -> list[str]:
    """One condition per month from ``first`` to ``last`` (``YYYY-MM``), each with the frozen update watermark."""
    y, m = map(int, first.split("-"))
    end_y, end_m = map(int, last.split("-"))
    out = []
    while (y, m) <= (end_y, end_m):
        ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
        text = f"{column} >= '{y:04d}-{m:02d}-01' AND {column} < '{ny:04d}-{nm:02d}-01'"
        out.append(text + (f" AND UPDATE_TIME <= '{watermark}'" if watermark else ""))
        y, m = ny, nm
    return out


def id_chunks(column: str, ids: list[int], size: int = 100) -> list[str]:
    """One condition per group of ``size`` ids, in ascending order."""
    ordered = sorted(set(ids))
    return [f"{column} IN ({', '.join(map(str, ordered[a : a + size]))})" for a in range(0, len(ordered), size)]


def pages(fetch: Callable[[int, int], list[dict]], limit: int = 5000, key: str = "id") -> Iterator[dict]:
    """All rows of a service that returns rows with ``key > last``; a page that does not advance is an error."""
    last = -1
    while True:
        page = sorted(fetch(last, limit), key=lambda r: r[key])
        seen = None
        for row in page:
            if row[key] != seen:
                yield row
            seen = row[key]
        if len(page) < limit:
            return
        if page[-1][key] <= last:
            raise ContractError("a page did not advance")
        last = page[-1][key]


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """A file of signals (signal_date, instrument_id, score), best first within each date."""
    df = spark.read.parquet(path) if path.endswith(".parquet") or os.path.isdir(path) else spark.read.csv(path, header=True, schema="signal_date date, instrument_id string, score double")
    from tidemark.operators.quality import check_signals

    return check_signals(df)


def write_panel(factors: dict[str, DataFrame], path: str) -> DataFrame:
    """Factors (d, i, value) as one wide table, one row per key that any of them has."""
    names = list(factors)
    long = None
    for name, df in factors.items():
        one = df.select("d", "i", F.lit(name).alias("name"), "value")
        long = one if long is None else long.unionByName(one)
    wide = long.groupBy("d", "i").pivot("name", names).agg(F.max("value"))
    wide.write.parquet(path)
    return wide.sparkSession.read.parquet(path)
