"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources share all words by weight; none may take more than ``cap`` times its own words, and what it cannot take goes
to the others by weight. Within a source the documents lie in a line, each as long as its expected number of copies
(target / size of the source); one random offset is added and a document is emitted once per whole number that its
stretch covers. Documents lie in order of size, so the words taken stay close to the target: the error is about one
document of each size class.

The line of one source may hold a third of all rows, so positions come from three levels: a document's rank within its
bucket (a narrow size class and one of ``spread`` id classes), the bucket's offset within its source (a running sum
over buckets, not rows), and the source's offset. One shuffle moves (id, source, size) only.

Defined results: null text has size 0; null is a source of its own and comes last; sources without words get target
0 and are not taken; an empty table gives no rows; rows with one id are placed in any order among themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import n_words

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7) -> DataFrame:
    """(source, key, source_size, target, rate, offset) from (source, key, source_size), one row per source.

    The reshared targets are min(cap * size, weight * level); the level follows from running sums over the sources in
    order of cap * size / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.select("source", "key", "source_size", (F.row_number().over(order) - 1).alias("rank"))
    choice = F.lit(None)
    for i, w in reversed(list(enumerate(weights))):
        choice = F.when(F.col("rank") % len(weights) == i, F.lit(w)).otherwise(choice)
    ranked = ranked.withColumn("weight", choice.cast("long")).withColumn("most", F.col("source_size") * cap)
    line = W.orderBy((F.col("most") / F.col("weight").cast("double")), "rank")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    levels = ranked.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("filled"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
        F.sum("source_size").over(everything).alias("total"),
        F.row_number().over(line).alias("place"),
    )
    # The level of the first source that stays below its cap if all before it are full.
    level = (F.col("total") - F.col("filled")).cast("double") / F.col("left_weight").cast("double")
    levels = levels.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    levels = levels.withColumn("level", F.min_by("level", F.when(F.col("fits"), F.col("place"))).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    mixed = ((F.col("rank").cast("long") + 1) * 40503 + seed * 30011) % 65521
    return levels.select(
        "source",
        "key",
        "source_size",
        F.round(target, 6).alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        ((mixed * mixed % 65521 + 0.5) / 65536).alias("offset"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int, seed: int, spread: int, carry: list[str]) -> DataFrame:
    """Rows (id, size, source_size, target, copies, ...carried columns)."""
    source, size = F.col(f"`{source_col}`"), n_words(F.col(f"`{text_col}`"))
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),  # never null, so that joins and windows share one shuffle
        size.alias("size"),
        *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carry)],
    )
    grade = F.floor(16 * F.log2(F.col("size") + F.lit(1.0)) + F.lit(1e-6)).cast("int")
    part = F.pmod(F.coalesce(F.col("id"), F.lit(0)).cast("long") % 1000003 * 7919, F.lit(spread)).cast("int")
    narrow = narrow.withColumn("grade", grade).withColumn("part", part)
    bucket = ["key", "grade", "part"]
    counted = narrow.groupBy("source", *bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    goal = targets(counted.groupBy("source", "key").agg(F.sum("words").alias("source_size")), weights, cap, seed)
    along = W.partitionBy("key").orderBy("grade", "part").rowsBetween(W.unboundedPreceding, -1)
    buckets = counted.select(*bucket, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("ahead"))
    buckets = buckets.join(goal.select("key", "source_size", "target", "rate", "offset"), "key")
    ranked = narrow.drop("source").withColumn("nth", F.row_number().over(W.partitionBy(*bucket).orderBy("size", "id")) - 1)
    at = F.col("ahead") + F.col("nth")
    copies = F.floor((at + 1) * F.col("rate") + F.col("offset")) - F.floor(at * F.col("rate") + F.col("offset"))
    return ranked.join(buckets, bucket).withColumn("copies", copies.cast("long"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7, spread: int = 64) -> DataFrame:
    """(id, size, source_size, target, taken) for every row: ``taken`` is its words times its copies in the mix."""
    placed = _placed(docs, id_col, text_col, source_col, weights, cap, seed, spread, [])
    return placed.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, seed: int = 7, spread: int = 64) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    placed = _placed(docs, id_col, text_col, source_col, weights, cap, seed, spread, docs.columns)
    again = placed.where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(docs.columns)])
