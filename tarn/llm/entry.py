"""The queries of the ten operators, with their production parameters, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import jaccard, langid, lines, mixing, packing, pii, quality, sharding, tokens, topk

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard(table(spark, sf_dir, "documents"), 24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.clean_pages(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.decided(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=("doc_id",))
    return rows.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


#: In the order of their numbers.
QUERIES = (op1_sharding, op2_ngram_jaccard_join, op3_quality_rules, op4_best_fit_packing, op5_exact_top_k, op6_line_dedup, op7_token_counts, op8_pii, op9_mixing, op10_language_id)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _quoted(text: str) -> str:
    """An SQL expression for a string, of which line breaks and other control characters are written as chr()."""
    return " || ".join(f"chr({ord(x)})" if len(x) == 1 and ord(x) < 32 else "'" + x.replace("'", "''") + "'" for x in re.split("([\x00-\x1f])", text) if x) or "''"


def _line_dedup_sql() -> str:
    text = "html"
    for pattern, into in lines.HTML_STEPS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(into)}, 'g')"
    for name, into in lines.ENTITIES:
        text = f"replace({text}, {_quoted(name)}, {_quoted(into)})"
    return _sql("oracle_lines.sql").replace("{text}", text).replace("{blank}", f"({_quoted(lines.BLANK)})")


def _sql(name: str) -> str:
    return Path(__file__).with_name(name).read_text()


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; tests/llm hold the others against brute-force versions."""
    return {"op2_ngram_jaccard_join": _sql("oracle_jaccard.sql"), "op5_exact_top_k": _sql("oracle_topk.sql"), "op6_line_dedup": _line_dedup_sql(), "op9_mixing": _sql("oracle_mix.sql")}
