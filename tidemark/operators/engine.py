"""A graph of factors with a content-addressed cache.

A factor names itself, its version, its lookback in sessions and the factors it needs; computing one resolves the graph
depth first. A result's key covers the dataset's fingerprint, the definition, the source of the factor's module, the
keys of what it needs, cutoff and instruments; the date range is part of the entry, so a request inside a stored range
is a slice of it. Entries appear by rename, whole or not at all.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import inspect
import json
import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import CacheMissError, FactorError, FutureDataError
from tidemark.operators.quality import check_factor
from tidemark.sources.files import Files, join


@dataclass(frozen=True)
class Factor:
    """``compute(context, needed)`` returns rows (d, i, value) for ``context.start`` to ``context.end``."""

    name: str
    compute: Callable
    version: str = "1"
    lookback: int = 0
    needs: tuple[Factor, ...] = field(default_factory=tuple)

    def definition(self) -> dict:
        module = sys.modules.get(self.compute.__module__)
        try:
            source = inspect.getsource(module if module is not None else self.compute)
        except (OSError, TypeError):
            source = repr(self.compute)
        return {"name": self.name, "version": self.version, "lookback": self.lookback, "source": hashlib.sha256(source.encode()).hexdigest()}


@dataclass(frozen=True)
class Context:
    """What a factor may read: ``bars`` up to the cutoff, from ``start`` minus its lookback to ``end``."""

    bars: DataFrame
    start: dt.date
    end: dt.date


def ordered(factor: Factor) -> list[Factor]:
    """The graph below ``factor``, needed ones first; cycles and two versions of a name are errors."""
    out: dict[str, Factor] = {}
    path: list[str] = []

    def visit(f: Factor) -> None:
        if f.name in path:
            raise FactorError(f"factors need each other: {' > '.join([*path, f.name])}")
        if f.name in out:
            if out[f.name].version != f.version:
                raise FactorError(f"two versions of {f.name}")
            return
        path.append(f.name)
        for n in f.needs:
            visit(n)
        path.pop()
        out[f.name] = f

    visit(factor)
    return list(out.values())


class FactorEngine:
    """Computes factors over bars (d, i, ...) of a dataset, with a cache folder that driver and executors share."""

    def __init__(self, spark: SparkSession, bars: DataFrame, sessions: list[dt.date], fingerprint: str, cache: str | None = None):
        self.spark, self.bars, self.sessions, self.fingerprint, self.cache = spark, bars, sorted(sessions), fingerprint, cache
        self.files = Files(spark)

    def back(self, day: dt.date, n: int) -> dt.date:
        """The session ``n`` before the first one on or after ``day``."""
        at = next((k for k, d in enumerate(self.sessions) if d >= day), len(self.sessions) - 1)
        return self.sessions[max(0, at - n)]

    def key(self, factor: Factor, cutoff: dt.date, instruments: tuple | None) -> str:
        parts = {"data": self.fingerprint, "factor": factor.definition(), "needs": [self.key(n, cutoff, instruments) for n in factor.needs], "cutoff": str(cutoff), "instruments": instruments}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def _stored(self, key: str) -> list[tuple[dt.date, dt.date, str]]:
        if not self.cache:
            return []
        folder = join(self.cache, key)
        spans = [x.split("_") for x in self.files.names(folder) if not x.startswith(".")]
        return [(dt.date.fromisoformat(a), dt.date.fromisoformat(b), join(folder, f"{a}_{b}")) for a, b in spans]

    def compute(self, factor: Factor, start: dt.date, end: dt.date, cutoff: dt.date | None = None, instruments: list | None = None, policy: str = "use") -> DataFrame:
        """Rows of ``factor``. ``policy``: use the cache, ``require`` an entry, or ``refresh`` it."""
        cutoff = cutoff or end
        if end > cutoff:
            raise FutureDataError(f"end {end} is after the cutoff {cutoff}")
        scope = tuple(sorted(instruments)) if instruments is not None else None
        ordered(factor)
        key = self.key(factor, cutoff, scope)
        inside = [p for a, b, p in self._stored(key) if a <= start and end <= b]
        if inside and policy != "refresh":
            return self.spark.read.parquet(inside[0]).where(F.col("d").between(start, end))
        if policy == "require":
            raise CacheMissError(f"no entry of {factor.name} for {start} to {end}")
        needed = [self.compute(n, self.back(start, factor.lookback), end, cutoff, instruments, policy) for n in factor.needs]
        rows = self.bars.where(F.col("d").between(self.back(start, factor.lookback), min(end, cutoff)))
        rows = rows.where(F.col("i").isin(list(scope))) if scope is not None else rows
        found = factor.compute(Context(rows, start, end), needed).select("d", "i", "value").where(F.col("d").between(start, end))
        if not self.cache:
            return found
        target = join(self.cache, key, f"{start}_{end}")
        staging = join(self.cache, key, f".{uuid.uuid4().hex}")
        found.write.parquet(staging)
        written = self.spark.read.parquet(staging)
        try:
            check_factor(written, list(scope) if scope is not None else None)
        except BaseException:
            self.files.remove(staging)
            raise
        self.files.remove(target)
        self.files.move(staging, target)
        return self.spark.read.parquet(target)

    def purge(self, keep: list[str]) -> int:
        """Removes all entries but those with the given keys; how many went."""
        gone = [k for k in self.files.names(self.cache) if k not in keep] if self.cache else []
        for k in gone:
            self.files.remove(join(self.cache, k))
        return len(gone)
