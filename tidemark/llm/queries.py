"""The queries of the text operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import binrec, bpe, chat, dedup, langid, mixing, quality, secret_scan, ssjoin, toxicity
from tidemark.llm.common import shared_path


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; a parameter of the operators that use one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "ids")
    files = binrec.write_ids(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return binrec.read_ids(spark, files, folder)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.chat_report(spark, told.unionByName(extra))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssjoin.similarity_groups(_table(spark, sf_dir, "documents"), shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe_codec, op2_secret_scan, op3_quality_rules, op4_language_id, op5_token_records, op6_toxicity, op7_chat_format, op8_source_mix, op9_jaccard_join, op10_exact_dedup)}

#: Words of a text in DuckDB.
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+'))"

ORACLES: dict[str, str] = {
    "op8_source_mix": f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
g AS (SELECT *, floor(16 * log2(size + 1.0::DOUBLE) + 1e-6)::BIGINT AS grade,
  (((coalesce(doc_id, 0) % 1000003 * 7919) % 64) + 64) % 64 AS part FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM g GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][(rank % 3 + 1)::INT]::BIGINT AS weight, 3 * source_size AS most FROM r),
l AS (SELECT *, coalesce(sum(most) OVER b, 0)::BIGINT AS filled, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS left_weight,
  (sum(source_size) OVER ())::BIGINT AS total, row_number() OVER (ORDER BY most::DOUBLE / weight::DOUBLE, rank) AS place FROM w
  WINDOW b AS (ORDER BY most::DOUBLE / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - filled)::DOUBLE / left_weight::DOUBLE AS level FROM l),
f AS (SELECT level FROM v WHERE level * weight <= most ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM f) * weight, most::DOUBLE)) AS goal,
  ((((rank + 1) * 40503 + 7 * 30011) % 65521) * (((rank + 1) * 40503 + 7 * 30011) % 65521) % 65521 + 0.5::DOUBLE) / 65536::DOUBLE AS shift FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade, part, size, doc_id) - 1 AS spot FROM g),
j AS (SELECT p.doc_id, p.size, t.source_size, round(t.goal, 6) AS target, p.spot, t.shift,
  CASE WHEN t.source_size > 0 THEN t.goal / t.source_size ELSE 0 END AS rate FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor((spot + 1) * rate + shift) - floor(spot * rate + shift)))::BIGINT AS taken FROM j""",
    "op9_jaccard_join": None,
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op7_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS said,
  regexp_replace(text, '(~*)(<\|turn\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>)', '~\1\2', 'g') AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>') + length(said) + 1 + length(body) + length('<|end|>') + 2)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
