"""Labels, leak-free splits, cross-sectional transforms and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.windows import rank_share, winsorised


def forward_labels(prices: DataFrame, offset: int, horizon: int, cutoff: str | None = None, price: str = "close") -> DataFrame:
    """(d, i, label, label_start, label_end): return from the ``offset``-th to the ``offset + horizon``-th next row."""
    w = W.partitionBy("i").orderBy("d")
    entry, leave = F.lead(price, offset).over(w), F.lead(price, offset + horizon).over(w)
    rows = prices.select("d", "i", (F.try_divide(leave, entry) - 1).alias("label"), F.lead("d", offset).over(w).alias("label_start"), F.lead("d", offset + horizon).over(w).alias("label_end")).where("label is not null")
    return rows.where(F.col("label_end") <= F.lit(cutoff).cast("date")) if cutoff else rows


def session_labels(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(d, i, label, status): next session's open to the close of the one after; the status says what is missing."""
    p = prices.join(calendar, "d")
    w = W.partitionBy("i").orderBy("idx")
    at = lambda c, k: F.coalesce(*[F.when(F.lead("idx", j).over(w) == F.col("idx") + k, F.lead(c, j).over(w)) for j in range(1, k + 1)])
    rows = p.select("d", "i", "idx", at("open", 1).alias("entry"), at("close", 2).alias("leave"))
    last = calendar.agg(F.max("idx").alias("last"))
    status = F.when(F.col("idx") + 2 > F.col("last"), "beyond_calendar").when(F.col("entry").isNull(), "no_entry").when(F.col("leave").isNull(), "no_exit").when(F.col("entry") <= 0, "bad_entry").otherwise("valid")
    marked = rows.join(F.broadcast(last)).withColumn("status", status)
    return marked.select("d", "i", F.when(F.col("status") == "valid", F.col("leave") / F.col("entry") - 1).alias("label"), "status")


def date_chunks(df: DataFrame, k: int, day: str = "d") -> DataFrame:
    """(day, chunk): the distinct dates in ``k`` consecutive chunks, the first ones one longer where they do not divide."""
    days = df.select(day).distinct()
    n, order = F.count(F.lit(1)).over(W.partitionBy()), F.row_number().over(W.orderBy(day)) - 1
    placed = days.withColumn("n", n).withColumn("at", order)
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    edge = extra * (small + 1)
    return placed.select(day, F.when(F.col("at") < edge, F.floor(F.col("at") / (small + 1))).otherwise(extra + F.floor((F.col("at") - edge) / small)).cast("int").alias("chunk"))


def purged_folds(df: DataFrame, k: int, embargo: int, day: str = "d", end: str = "label_end") -> DataFrame:
    """(fold, part, rows...): for every chunk but the first, it and the earlier rows whose labels end before it.

    The last ``embargo`` training dates before the chunk are left out.
    """
    chunks = date_chunks(df, k, day)
    order = W.orderBy(day)
    numbered = chunks.withColumn("at", F.row_number().over(order))
    starts = numbered.groupBy("chunk").agg(F.min("at").alias("first_at"), F.min(day).alias("first_day")).where("chunk > 0").select(F.col("chunk").alias("fold"), "first_at", "first_day")
    rows = df.join(F.broadcast(numbered), day)  # one row per date
    met = rows.join(F.broadcast(starts), F.col("fold") >= F.col("chunk"))  # at most k copies of a row, one per fold
    part = F.when(F.col("chunk") == F.col("fold"), "validation").when((F.col(end) < F.col("first_day")) & (F.col("at") < F.col("first_at") - embargo), "train")
    return met.withColumn("part", part).where("part is not null").select("fold", "part", *df.columns)


def relevance(x: Column, keys: list[str] | str) -> Column:
    """Grades 0 to 4 by fifths of the rank."""
    return F.least(F.ceil(5 * rank_share(x, keys)) - 1, F.lit(4)).cast("int")


def ndcg(df: DataFrame, k: int, day: str = "d", score: str = "score", grade: str = "relevance", tie: str = "i") -> DataFrame:
    """(day, ndcg): gain 2^grade - 1, discount log2(place + 1), 0 where the best order gains nothing."""
    by_score = F.row_number().over(W.partitionBy(day).orderBy(F.desc(score), tie))
    by_grade = F.row_number().over(W.partitionBy(day).orderBy(F.desc(grade), tie))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(place) + 1.0)))
    both = df.withColumn("__s", by_score).withColumn("__g", by_grade).groupBy(day).agg(gain("__s").alias("got"), gain("__g").alias("best"))
    return both.select(day, F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(F.lit(0.0)).alias("ndcg"))


def standardise(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with nulls as the training median and values by training mean and spread (0 spread counts as 1)."""
    mid = train.agg(*[F.percentile(c, F.lit(0.5)).alias(f"med_{c}") for c in columns])
    filled = train.join(F.broadcast(mid)).select(*[F.coalesce(c, f"med_{c}").alias(c) for c in columns])
    facts = filled.agg(*[F.avg(c).alias(f"avg_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns])
    out = rows.join(F.broadcast(mid)).join(F.broadcast(facts))
    scaled = {c: (F.coalesce(F.col(c), F.col(f"med_{c}")) - F.col(f"avg_{c}")) / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(F.lit(1.0)) for c in columns}
    return out.select(*[scaled.get(c, F.col(c)).alias(c) for c in rows.columns])


def new_leader(df: DataFrame, day: str = "d", who: str = "i", score: str = "score") -> DataFrame:
    """``df`` with ``is_new_top1``: the day's best, where the best of the last scored day was another."""
    best = df.where(F.col(score).isNotNull()).groupBy(day).agg(F.min_by(who, F.struct(-F.col(score), F.col(who))).alias("__top"))
    w = W.orderBy(day)  # one row per day
    led = best.withColumn("__before", F.lag("__top").over(w))
    hit = (F.col(who) == F.col("__top")) & F.col("__before").isNotNull() & (F.col("__top") != F.col("__before"))
    return df.join(led, day, "left").withColumn("is_new_top1", F.coalesce(hit, F.lit(False)).cast("int")).drop("__top", "__before")


def prepare_daily(df: DataFrame, columns: list[str], day: str = "d") -> DataFrame:
    """Columns winsorised within each day."""
    return df.select(*[winsorised(F.col(c), day).alias(c) if c in columns else F.col(c) for c in df.columns])


def fit_ridge(train: DataFrame, columns: list[str], label: str, strength: float = 1e-3) -> list[float]:
    """Weights (intercept last) of a ridge regression from one aggregation of cross products."""
    import numpy as np

    names = [*columns, "__one"]
    rows = train.select(*columns, label).where(F.col(label).isNotNull()).withColumn("__one", F.lit(1.0))
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    r = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{k}") for k, (a, b) in enumerate(pairs)], *[F.sum(F.col(a) * F.col(label)).alias(f"y{k}") for k, a in enumerate(names)]).first()
    gram = np.zeros((len(names), len(names)))
    for k, (a, b) in enumerate(pairs):
        gram[names.index(a), names.index(b)] = gram[names.index(b), names.index(a)] = r[f"x{k}"] or 0.0
    return np.linalg.solve(gram + strength * np.eye(len(names)), np.array([r[f"y{k}"] or 0.0 for k in range(len(names))])).tolist()


def predict_linear(rows: DataFrame, columns: list[str], weights: list[float], out: str = "score") -> DataFrame:
    return rows.withColumn(out, sum((F.col(c) * F.lit(w) for c, w in zip(columns, weights, strict=False)), F.lit(weights[-1])))


def rolling_years(rows: DataFrame, first: int, last: int, years: int = 3, day: str = "d", end: str = "label_end") -> DataFrame:
    """(test_year, part, rows...): each year after the first ``years`` with the ones before it as its training rows.

    A training row's label must end before the test year begins; test years without rows of both parts are left out.
    A row meets at most ``years + 1`` test years, which it names itself, so nothing is joined.
    """
    own = F.year(day)
    copies = F.explode(F.array(*[F.struct((own + k).alias("test_year"), F.lit("test" if k == 0 else "train").alias("part")) for k in range(years + 1)]))
    met = rows.withColumn("__f", copies).select("__f.*", *rows.columns)
    met = met.where(F.col("test_year").between(first + years, last) & (own >= first))
    met = met.where((F.col("part") == "test") | (F.col(end) < F.make_date(F.col("test_year"), F.lit(1), F.lit(1))))
    full = met.groupBy("test_year").agg(F.countDistinct("part").alias("parts")).where("parts = 2").select("test_year")
    return met.join(F.broadcast(full), "test_year")  # one row per year


def held_out_sessions(rows: DataFrame, keys: list[str], sessions: int = 126, embargo: int = 2, day: str = "d", end: str = "label_end") -> DataFrame:
    """``rows`` with ``role``: the last ``sessions`` dates of each fold validate, the ``embargo`` dates before them are
    left out, as are rows whose label ends on or after the first validation date; the others fit."""
    own = W.partitionBy(*keys)
    back = F.dense_rank().over(own.orderBy(F.desc(day)))
    marked = rows.withColumn("__back", back)
    marked = marked.withColumn("__start", F.min(F.when(F.col("__back") <= sessions, F.col(day))).over(own))
    role = F.when(F.col("__back") <= sessions, "validation").when(F.col("__back") <= sessions + embargo, "embargo").when(F.col(end) >= F.col("__start"), "purged").otherwise("fit")
    return marked.withColumn("role", role).drop("__back", "__start")


def grade_means(rows: DataFrame, grade: str, value: str) -> DataFrame:
    """(grade, n, mean) of a value per grade."""
    return rows.groupBy(grade).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def importance(rows: DataFrame) -> DataFrame:
    """(feature, mean, std, models) of (model, feature, gain): how features count over models; ``models`` use it."""
    return rows.groupBy("feature").agg(F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("std"), F.count_if(F.col("gain") != 0).alias("models"))
