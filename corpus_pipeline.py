"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. All
of them take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of
any name, as their operators' docstrings in ``tarn.llm`` define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import jaccard, lines, mixing, packing, quality
from tarn.llm.entry import WORD_BPE
from tarn.llm.scratch import Scratch, passing

#: A source has many sites' texts, so a line that is boilerplate is on a much smaller share of them than on a web host's pages.
SOURCE_RATIO = 0.001


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base or a rule learned from ``labels`` rejects.

    Null and empty texts have no word and go; very long texts are judged whole; repeated rows fare alike; an empty
    table gives no rows; all columns stay as they are.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that are on more than a thousandth of a source's distinct texts, and on five at least; every document stays.

    A null source has no boilerplate; null texts stay null; very long texts are cut whole; equal texts count once and
    fare alike; an empty table gives no rows; columns other than the text and n_chars stay as they are.
    """
    return lines.clean_documents(docs, ratio=SOURCE_RATIO)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near duplicates.

    Null texts are nobody's duplicates and all stay; texts without words are one class; very long texts are compared
    whole; of rows alike in id and text one stays; null ids come last; an empty table gives no rows; all columns stay.
    """
    return jaccard.one_of_each(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target and its key, by quality from ``labels``, say: not at all, once or twice.

    A null source is one like others; null and empty texts have size 0 and follow their keys; very long texts count
    whole; rows alike in id, text and source fare alike; an empty table gives no rows; all columns stay as they are.
    """
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 4096 tokens.

    Null and empty texts are the end token alone; only longer documents are cut; repeated rows are placed each on its
    own, equal lengths in order of id and piece; an empty table gives no rows; other columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and the tokenizer are beyond SQL; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``; each stage's result is written before the next one reads it.

    What a stage has written on its way, and what it has read, is deleted once its result is there. Awkward rows and
    empty tables are as in the stages.
    """
    scratch, before = Scratch(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with passing() as kept:
            docs = scratch.save(stage(spark, docs, sf_dir))
            kept.append(docs)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
