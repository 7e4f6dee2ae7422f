"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.workers import ship_package  # noqa: F401  (the operators take it from here)

#: White space of the contracts: space and \t \n \v \f \r.
SPACE = " \\t-\\r"
#: Bytes of an Arrow batch; a task holds a few of them. Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one where a local session names none, as in tests.

    On a cluster a folder of the driver's machine would be of no use to the others, so there it must be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and reread, so that lost executors cost no recomputation.

    A written table rather than ``checkpoint()``, which computes its last stage twice.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text) -> F.Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text column."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def n_words(text) -> F.Column:
    """Number of words of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]++")), F.lit(0)).cast("long")


def text_slices(batches, column: int, rows: int = 256, size: int = 1 << 21):
    """Pieces of Arrow batches of at most ``rows`` rows, and of about ``size`` characters of a text column unless one
    text is longer."""
    for b in batches:
        ends = pc.cumulative_sum(pc.fill_null(pc.utf8_length(b.column(column)), 0).cast("int64")).to_numpy()
        a = 0
        while a < b.num_rows:
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size)) + 1
            z = min(a + rows, max(a + 1, z), b.num_rows)
            yield b.slice(a, z - a)
            a = z


def give_back() -> None:
    """Returns to the system what Arrow's pool and the C library keep of freed memory, where they can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for Arrow batches, whose worker gives back freed memory every ``BATCH_BYTES`` of input and at the end.

    Workers live on between tasks and stages; what the allocators keep of one stage's peak would add to the next one's.
    """

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            seen += b.nbytes
            yield b
            del b
            if seen >= BATCH_BYTES:
                give_back()
                seen = 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        give_back()

    return whole


def map_arrow(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory: batches of about ``BATCH_BYTES``, however long the texts are
    (unless the session says otherwise), and workers that give back what they freed."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(lean(run), schema)


def map_batches(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """``map_arrow(df, run, schema)`` for columns of any names; ``run`` goes by positions, not by names."""
    names = [f.name for f in schema]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(schema)])
    return map_arrow(df.toDF(*[f"c{k}" for k in range(len(df.columns))]), run, plain).toDF(*names)


def hash_sample(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """At most ``k`` rows of ``rows``: those with the smallest hashes of ``keys``, the same in every run.

    Rows are first thinned by hash to about ``4 * k`` in all, so what meets to be ordered does not grow with the
    number of partitions. ``keys`` should tell rows apart.
    """
    n = rows.count()
    h = F.xxhash64(*[F.col(f"`{c}`") for c in keys])
    if n > 4 * k:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 4 * k / n))
    return rows.orderBy(h, *[F.col(f"`{c}`") for c in keys]).limit(k)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, hot: int) -> DataFrame:
    """Inner join of many rows of ``left`` with one row of ``right`` per ``key``, even where one key holds a third of ``left``.

    ``right[weight]`` is the number of rows of ``left`` with that key, ``total`` the number of all rows. Keys with at
    least ``total / hot`` rows are at most ``hot`` by construction, so those rows of ``right`` are broadcast; all
    others meet in a shuffle whose largest key is then small. Both sides must call the key ``key`` (a binary column).
    """
    rest = [c for c in right.columns if c != key]
    names = {c: f"__hot_{c}" for c in rest}
    few = right.where(F.col(weight) * hot >= total).select(F.col(key), *[F.col(c).alias(n) for c, n in names.items()], F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(few), key, "left")
    # A hot row needs no partner any more; a key of its own spreads such rows over all tasks.
    marked = marked.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.concat(F.col(key), F.encode(F.monotonically_increasing_id().cast("string"), "utf-8"))))
    many = right.where(F.col(weight) * hot < total).select(F.col(key).alias("__key"), *rest, F.lit(True).alias("__cold"))
    out = marked.join(many, "__key", "left").where("__hot or __cold")
    return out.select(*left.columns, *[F.when(F.col("__hot"), F.col(names[c])).otherwise(F.col(c)).alias(c) for c in rest])
