"""Data-quality checks: each counts violations in one pass, or lists the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ContractError, StrategyError
from tidemark.functions.scalar import close_to
from tidemark.sources import schema as S


def _coerced(x: Column, have: T.DataType, want: T.DataType) -> Column:
    if isinstance(want, T.BooleanType) and not isinstance(have, T.BooleanType):
        text = F.lower(x.cast("string"))
        return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    if isinstance(want, T.LongType) and isinstance(have, (T.DoubleType, T.FloatType, T.StringType)):
        number = x.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("long"))
    return x.try_cast(want)


def normalise(df: DataFrame, name: str) -> DataFrame:
    """``df`` cast to the contract of table ``name``; ContractError with all violations if it does not hold.

    Checked in one aggregation: values lost in casting, nulls, allowed values, minima and infinite numbers; then unique
    keys. Unknown and missing columns are errors too.
    """
    contract = {f.name: f for f in S.TABLES[name]}
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"unknown column {c}" for c in have if c not in contract] + [f"missing column {c}" for c, f in contract.items() if c not in have and f.metadata.get("required", True)]
    if wrong:
        raise ContractError(f"{name}: {'; '.join(wrong)}")
    fields = [f for c, f in contract.items() if c in have]
    cast = df.select(*[_coerced(F.col(f.name), have[f.name], f.dataType).alias(f.name) for f in fields], *[F.col(f.name).isNotNull().alias(f"__had_{f.name}") for f in fields])
    rules: dict[str, Column] = {}
    for f in fields:
        x = F.col(f.name)
        rules[f"{f.name}: not a {f.dataType.simpleString()}"] = x.isNull() & F.col(f"__had_{f.name}")
        if not f.nullable:
            rules[f"{f.name}: null"] = x.isNull()
        if f.metadata.get("enum"):
            rules[f"{f.name}: not allowed"] = x.isNotNull() & ~x.isin(f.metadata["enum"])
        if f.metadata.get("minimum") is not None:
            rules[f"{f.name}: too small"] = x < f.metadata["minimum"]
        if isinstance(f.dataType, T.DoubleType):
            rules[f"{f.name}: not finite"] = F.isnan(x) | (F.abs(x) == float("inf"))
    found = cast.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(f"r{k}") for k, r in enumerate(rules.values())]).first()
    broken = [f"{label} ({found[k]})" for k, label in enumerate(rules) if found[k]]
    if not cast.groupBy(*S.KEYS[name]).count().where("count > 1").isEmpty():
        broken.append(f"keys {S.KEYS[name]} repeat")
    if broken:
        raise ContractError(f"{name}: {'; '.join(broken)}")
    return cast.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields])


def counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each rule."""
    return df.agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(k) for k, r in rules.items()])


def price_rules() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "not_positive": (o <= 0) | (h <= 0) | (l <= 0) | (c <= 0),
        "outside_range": (h < F.greatest(o, c, l)) | (l > F.least(o, c, h)),
        "negative_flow": (F.col("volume") < 0) | (F.col("amount") < 0),
    }


def flow_rules(triples: list[tuple[str, str, str]]) -> dict[str, Column]:
    """Inflow minus outflow must be the net flow, wherever all three are known."""
    return {f"{n}_unbalanced": ~close_to(F.col(i) - F.col(o), F.col(n), 1e-6, 0.01) for i, o, n in triples}


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return df.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def revision_gaps(reports: DataFrame, keys: list[str], order: list[str], sequence: str) -> DataFrame:
    """Rows whose revision number is not their place in order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return reports.withColumn("place", place).where(~F.col("place").eqNullSafe(F.col(sequence)))


def balance_gaps(facts: DataFrame, report: str, item: str, value: str) -> DataFrame:
    """Reports whose assets differ from liabilities plus equity by more than max(1, a millionth of assets)."""
    pick = lambda code: F.max(F.when(F.col(item) == code, F.col(value))).alias(code)
    wide = facts.groupBy(report).agg(pick("total_assets"), pick("total_liability"), pick("total_equity"))
    gap = F.abs(F.col("total_assets") - F.col("total_liability") - F.col("total_equity"))
    return wide.where(gap > F.greatest(F.lit(1.0), F.col("total_assets") * 1e-6))


def check_factor(df: DataFrame, instruments: list | None = None) -> DataFrame:
    """Diagnostics of a factor (d, i, value); ContractError if keys repeat or values are infinite."""
    own = df.select("d", "i", "value")
    bad = own.agg(F.count_if(F.isnan("value") | (F.abs("value") == float("inf"))).alias("odd"), F.count_if(~F.col("i").isin(instruments) if instruments is not None else F.lit(False)).alias("strange")).first()
    if bad.odd or bad.strange or not own.groupBy("d", "i").count().where("count > 1").isEmpty():
        raise ContractError(f"factor output: {bad.odd} infinite values, {bad.strange} other instruments, or repeated keys")
    return own.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("i").alias("instruments"), F.countDistinct("d").alias("dates"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("low"), F.max("value").alias("high"))


def check_signals(df: DataFrame, cutoff_columns: list[str] | None = None) -> DataFrame:
    """Signals in order (date, score descending, id); StrategyError for nulls, repeated keys or cutoffs after the date."""
    rules = [F.col(c).isNull() for c in ("signal_date", "instrument_id", "score")] + [F.isnan("score")] + [F.col(c) > F.col("signal_date") for c in cutoff_columns or []]
    bad = df.where(reduce(lambda a, b: a | b, rules))
    if not bad.isEmpty() or not df.groupBy("signal_date", "instrument_id").count().where("count > 1").isEmpty():
        raise StrategyError("signals are incomplete, repeated or from the future")
    return df.orderBy("signal_date", F.desc("score"), "instrument_id")


def quarantine(df: DataFrame, rules: dict[str, Column], least: int = 100, share: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their first reason); ContractError if more than max(least, share of rows) are bad."""
    reason = F.coalesce(*[F.when(r, F.lit(k)) for k, r in rules.items()])
    marked = df.withColumn("reason", reason)
    n = marked.agg(F.count(F.lit(1)).alias("all"), F.count("reason").alias("bad")).first()
    if n.bad > max(least, share * n["all"]):
        raise ContractError(f"{n.bad} of {n['all']} rows are bad")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
