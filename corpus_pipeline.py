"""A corpus pipeline over the table ``documents``: each stage works on all that the one before kept.

Language ID drops documents whose language is rejected; exact dedup keeps the largest id of equal texts; the n-gram
Jaccard join (five words, similarity 0.8) keeps the smallest id of each group; mixing repeats and leaves out documents
to meet the sources' target weights; BPE adds the ids of each text.

Defined results: documents with null or empty text, or without letters, are rejected by the first stage; rows that
repeat a text count once; an empty table gives an empty table; other columns pass through all stages, but columns named
``ids`` or ``n_tokens`` are replaced by the last one; ties fall as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, dedup, langid, mixing, ssjoin
from tidemark.llm.common import cut
from tidemark.llm.queries import vocabulary


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.keep_one(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ssjoin.keep_one_of_each_group(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_column(docs, vocabulary("byte_bpe_50k.json"))
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("source_mix", mix_sources),
    ("bpe_encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs


#: Training a language model and joining by signatures have no SQL form.
ORACLE_SQL = None
