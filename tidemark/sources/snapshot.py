"""Immutable snapshots of canonical tables, and point-in-time reads of them.

A snapshot is a directory of Parquet tables (daily ones partitioned by year) and a manifest. Reads are lazy; guards
run on the driver. Every read of time-varying data takes a cutoff: rows become visible on their table's visibility
date, and daily bars on their own date.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ContractError, FutureDataError, SchemaVersionError
from tidemark.functions.asof import latest_by, metric_panel, valid_at
from tidemark.functions.scalar import content_hash
from tidemark.sources import schema as S
from tidemark.sources.files import Files, join

VERSION = 1
Day = dt.date | str | None


def _day(x: Day) -> dt.date | None:
    return dt.date.fromisoformat(x) if isinstance(x, str) else x


def scan(df: DataFrame, day: str | None = None, instrument: str | None = None, visible: str | None = None, start: Day = None, end: Day = None, cutoff: Day = None, instruments: list | None = None, dates: list | None = None, fields: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """``df`` restricted by plain predicates on its columns, all of which reach the scan.

    A row is visible if its ``visible`` date is null or not after the cutoff; rows with a ``day`` are never later than
    the cutoff. Key columns come first in any choice of fields.
    """
    start, end, cutoff = _day(start), _day(end), _day(cutoff)
    if end and cutoff and end > cutoff:
        raise FutureDataError(f"end {end} is after the cutoff {cutoff}")
    if dates is not None and not day:
        raise ContractError("a list of dates needs a table with a date")
    rows = df
    if day:
        last = min((x for x in (end, cutoff) if x), default=None)
        rows = rows.where(F.col(day) >= F.lit(start)) if start else rows
        rows = rows.where(F.col(day) <= F.lit(last)) if last else rows
        if "year" in df.columns:  # the partition column, so that whole years are left out
            rows = rows.where(F.col("year") >= start.year) if start else rows
            rows = rows.where(F.col("year") <= last.year) if last else rows
        rows = rows.where(F.col(day).isin([_day(x) for x in dates])) if dates is not None else rows
    if instruments is not None and instrument:
        rows = rows.where(F.col(instrument).isin(list(instruments)))
    if visible and cutoff:
        rows = rows.where(F.col(visible).isNull() | (F.col(visible) <= F.lit(cutoff)))
    if fields is None:
        return rows
    first = keys if keys is not None else [c for c in (day, instrument) if c]
    return rows.select(*first, *[f for f in fields if f not in first])


class Snapshot:
    """A published snapshot, opened for reading."""

    def __init__(self, spark: SparkSession, path: str, verify: bool = False):
        self.spark, self.path = spark, path
        try:
            self.manifest = json.loads(Files(spark).read(join(path, "manifest.json")))
        except Py4JJavaError:
            raise ContractError(f"{path} has no manifest") from None
        if self.manifest.get("schema_version") != VERSION:
            raise SchemaVersionError(f"schema version {self.manifest.get('schema_version')} is not {VERSION}")
        if verify:
            for name, facts in self.manifest["tables"].items():
                if content_hash(self._read(name).drop("year")).first().hash != facts["content"]:
                    raise ContractError(f"the rows of {name} are not those of its manifest")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(join(self.path, name))

    def table(self, name: str, start: Day = None, end: Day = None, instruments: list[str] | None = None, cutoff: Day = None, fields: list[str] | None = None, dates: list | None = None) -> DataFrame:
        if name not in S.TABLES or name not in self.manifest["tables"]:
            raise ContractError(f"no table {name}")
        if name in S.DYNAMIC and cutoff is None:
            raise FutureDataError(f"{name} needs a cutoff")
        if cutoff is not None and end is not None and _day(end) > _day(cutoff):
            raise FutureDataError(f"end {end} is after the cutoff {cutoff}")
        df = self._read(name)
        unknown = [f for f in fields or [] if f not in {x.name for x in S.TABLES[name]} or f not in df.columns]
        if unknown:
            raise ContractError(f"{name} has no {unknown}")
        day = "trade_date" if "trade_date" in df.columns else None
        rows = scan(df, day, "instrument_id" if "instrument_id" in df.columns else None, S.VISIBLE.get(name), start, end, cutoff, instruments, dates, fields, S.KEYS[name])
        return rows.drop("year")

    def bars(self, adjusted: bool, start: Day, end: Day, cutoff: Day, instruments: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
        if cutoff is None:
            raise FutureDataError("bars need a cutoff")
        covered = self.manifest.get("coverage", {}).get("instruments")
        if covered is not None and instruments is not None and set(instruments) - set(covered):
            raise ContractError(f"no prices for {sorted(set(instruments) - set(covered))}")
        wanted = [f for f in fields if f not in S.KEYS["daily_raw"]] if fields else None
        return self.table("daily_post_adjusted" if adjusted else "daily_raw", start, end, instruments, cutoff, wanted)

    def market_rule(self, day: Day, exchange: str, asset_type: str):
        """The one rule in force; any other number is an error."""
        rules = self.table("market_rules").where((F.col("exchange") == exchange) & (F.col("asset_type") == asset_type))
        found = rules.where(valid_at(F.lit(_day(day)), "effective_from", "effective_to")).limit(2).collect()
        if len(found) != 1:
            raise ContractError(f"{len(found)} rules for {exchange} {asset_type} on {day}")
        return found[0]

    def research(self, cutoff: Day) -> View:
        return View(self, cutoff, {"daily_raw"})

    def trading(self, cutoff: Day) -> View:
        return View(self, cutoff, {"daily_post_adjusted"})

    def financial(self, cutoff: Day) -> FinancialView:
        if "fundamental_metrics" not in self.manifest["tables"]:
            raise ContractError("this snapshot has no financial tables")
        return FinancialView(self, cutoff, set())


class View:
    """Reads bound to a cutoff; research never sees raw prices, trading never adjusted ones."""

    def __init__(self, snapshot: Snapshot, cutoff: Day, hidden: set[str]):
        self.snapshot, self.cutoff, self.hidden = snapshot, cutoff, hidden

    def table(self, name: str, **how) -> DataFrame:
        if name in self.hidden:
            raise ContractError(f"{name} is not part of this view")
        return self.snapshot.table(name, cutoff=self.cutoff, **how)

    def bars(self, start: Day, end: Day, **how) -> DataFrame:
        return self.snapshot.bars("daily_raw" in self.hidden, start, end, self.cutoff, **how)


class FinancialView(View):
    """As-of reads of reports, facts, metrics and share capital."""

    def _guard(self, as_of: Day) -> dt.date:
        if _day(as_of) > _day(self.cutoff):
            raise FutureDataError(f"{as_of} is after the cutoff {self.cutoff}")
        return _day(as_of)

    def facts(self, period: Day = None, items: list[str] | None = None) -> DataFrame:
        rows = self.table("financial_facts")
        rows = rows.where(F.col("fiscal_period_end") == F.lit(_day(period))) if period else rows
        return rows.where(F.col("item_code").isin(items)) if items is not None else rows

    def latest_metrics(self, as_of: Day, codes: list[str] | None = None) -> DataFrame:
        day = F.lit(self._guard(as_of))
        rows = self.table("fundamental_metrics")
        rows = rows.where(F.col("metric_code").isin(codes)) if codes is not None else rows
        seen = (F.col("available_at") <= day) & (F.col("fiscal_period_end") <= day)
        return latest_by(rows, ["instrument_id", "metric_code", "basis"], ["fiscal_period_end", "available_at", "metric_id"], seen)

    def metric_panel(self, code: str, basis: str, cells: DataFrame) -> DataFrame:
        """``cells`` (instrument_id, trade_date) with the value of one metric as known on each day."""
        rows = self.table("fundamental_metrics").where((F.col("metric_code") == code) & (F.col("basis") == basis))
        if not rows.where(F.col("available_at") < F.col("fiscal_period_end")).isEmpty():
            raise ContractError(f"{code}: available before the end of its period")
        return metric_panel(rows, cells, ["instrument_id"], "trade_date", "fiscal_period_end", "available_at", "metric_id", "value")

    def share_capital(self, as_of: Day) -> DataFrame:
        day = F.lit(self._guard(as_of))
        seen = (F.col("effective_from") <= day) & (F.col("available_at") <= day)
        return latest_by(self.table("share_capital"), ["instrument_id"], ["effective_from", "available_at", "capital_event_id"], seen)


def list_snapshots(root: str) -> list[str]:
    files = Files(SparkSession.active())
    return [x for x in files.names(root) if files.exists(join(root, x, "manifest.json"))]


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str, lineage: dict | None = None, coverage: list[str] | None = None) -> Snapshot:
    """Checks and writes a snapshot; nothing appears under its name unless all of it was written.

    ``root`` is a folder that the driver and all executors share.
    """
    from tidemark.operators.quality import normalise

    files = Files(spark)
    target, staging = join(root, name), join(root, f".{name}-{uuid.uuid4().hex}")
    if files.exists(target):
        raise ContractError(f"{target} exists; snapshots are never changed")
    missing = [t for t in S.REQUIRED if t not in tables]
    if missing:
        raise ContractError(f"missing tables: {missing}")
    facts = {}
    try:
        for t, df in tables.items():
            checked = normalise(df, t)
            if "trade_date" in checked.columns and t != "trade_calendar":
                # Ranges of days and keys, not years: a year of the whole market would be one task.
                order = ["trade_date", *[k for k in S.KEYS[t] if k != "trade_date"]]
                dealt = checked.withColumn("year", F.year("trade_date")).repartitionByRange(*order).sortWithinPartitions("year", *order)
                dealt.write.partitionBy("year").parquet(join(staging, t))
            else:
                checked.write.parquet(join(staging, t))
            back = spark.read.parquet(join(staging, t)).drop("year")
            h = content_hash(back).first()
            facts[t] = {"rows": h.rows, "content": h.hash, "schema": S.schema_hash(checked.schema)}
        manifest = {"schema_version": VERSION, "name": name, "tables": facts, "lineage": lineage or {}}
        if coverage is not None:
            manifest["coverage"] = {"instruments": sorted(coverage)}
        manifest["fingerprint"] = S.hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
        files.write(join(staging, "manifest.json"), json.dumps(manifest, sort_keys=True))
        files.move(staging, target)
    except BaseException:
        files.remove(staging)
        raise
    return Snapshot(spark, target)
