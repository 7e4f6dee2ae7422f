"""Exact dedup by skew-safe combining, in DataFrame operations only.

Copies meet in three steps, each of which compares full texts and not only digests: within each input partition
(Spark's partial aggregation, for the salt is the partition's number modulo the number of salts), then within each
(digest, salt), then among the salts' winners of a digest. So a text that a third of all rows share reaches the last
step as one row per salt.

Defined results: null text counts as empty; equal texts are those with equal bytes after normalisation (none by
default); of equal texts the largest id stays (null ids lose to all others); ids need not be unique. Empty input
gives empty output. Very long texts are compared whole. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, join_hot, n_partitions


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "utf-8"), 256))


def _winners(rows: DataFrame, best: Column, salts: int) -> DataFrame:
    """One row (digest, text, best, size) per distinct text of rows (digest, text, ...)."""
    local = rows.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy("digest", "salt", "text").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("size"))
    return salted.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("size").alias("size"))


def _salts(docs: DataFrame) -> int:
    return max(16, min(4096, n_partitions(docs.sparkSession)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, digest: Callable[[Column], Column] = sha256_of, salts: int | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``digest`` only deals rows out; texts with one digest but different bytes stay apart. Rows that repeat both the
    id and the text of the one that stays are the same document and are all marked kept.
    """
    shape = normalise or (lambda c: c)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), shape(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"))
    base = base.withColumn("digest", digest(F.col("text")))
    found = _winners(base, F.col("id"), salts or _salts(docs))
    per_digest = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("digest_size"), F.max("best").alias("best"), F.max("size").alias("size"))
    groups = cut(per_digest)
    total = docs.count()
    hot = max(1000, 4 * n_partitions(docs.sparkSession))
    joined = join_hot(base.select("id", "digest", F.sha2(F.encode("text", "utf-8"), 256).alias("sha")), groups.where("n = 1"), "digest", "digest_size", total, hot)
    out = joined.select("id", "best", "size", "sha")
    shared = groups.where("n > 1").select("digest")
    if not shared.isEmpty():  # different texts share a digest: tell them apart by their bytes
        apart = found.join(shared, "digest", "left_semi").select(F.col("digest").alias("d"), F.col("text").alias("t"), "best", "size")
        clash = base.join(shared, "digest", "left_semi").join(apart, (F.col("digest") == F.col("d")) & (F.col("text") == F.col("t")))
        out = out.unionByName(clash.select("id", "best", "size", F.sha2(F.encode("text", "utf-8"), 256).alias("sha")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("best").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("best")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns.

    Whole rows travel through the combining, so nothing is joined back. Ties on the id fall to the larger remaining
    columns, in their order; columns without an order (maps) come from one of the tied rows.
    """
    order = [id_col, *[c for c in docs.columns if c not in (id_col, text_col)]]
    kinds = {f.name: f.dataType for f in docs.schema}
    tied, loose = [c for c in order if _orderable(kinds[c])], [c for c in order if not _orderable(kinds[c])]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(tied)], F.col(f"`{text_col}`").isNotNull().alias("said"))
    base = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), row.alias("row"), F.struct(*[F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(loose)], F.lit(0).alias("none")).alias("loose"))
    base = base.withColumn("digest", sha256_of(F.col("text")))
    if loose:
        base = base.withColumn("salt", F.spark_partition_id() % (salts or _salts(docs)))
        some = base.groupBy("digest", "salt", "text").agg(F.max("row").alias("best"), F.max_by("loose", "row").alias("loose"))
        found = some.groupBy("digest", "text").agg(F.max_by("loose", "best").alias("loose"), F.max("best").alias("best"))
    else:
        found = _winners(base, F.col("row"), salts or _salts(docs)).withColumn("loose", F.struct(F.lit(0).alias("none")))
    back = {c: F.col(f"best.c{i}") for i, c in enumerate(tied)} | {c: F.col(f"loose.l{i}") for i, c in enumerate(loose)}
    back[text_col] = F.when(F.col("best.said"), F.col("text"))
    return found.select(*[back[c].alias(c) for c in docs.columns])
