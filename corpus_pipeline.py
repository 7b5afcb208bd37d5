"""The training-data operators' queries, and the pipeline that chains five of them.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it left. A
stage's result is written to the shared folder and read back as the next one's documents, so a
lost executor costs no more than its own tasks of the stage at work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbrel.llm import (
    ann, filter_audit, langid, mixing, near_dup, packing, quality, quality_rules, sharding, source_audit, substring_dup, suffix_dup, url_filter,
)
from timbrel.llm.common import settle, table

_MODULES = (mixing, url_filter, ann, quality, quality_rules, suffix_dup, packing, near_dup, substring_dup, langid, source_audit, filter_audit, sharding)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Every row is scored by its whole text, however long; null and empty texts by the voters' mean
    label. Repeated rows and ids are scored each; an empty table, or one without labels, stays.
    """
    return quality.keep_good(docs, quality.learnable(table(spark, sf_dir, "labels")))


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null and empty texts and rows with a null id stay; rows that share an id are judged by their
    texts, and rows alike in both stay together. An empty table gives none.
    """
    return near_dup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that an earlier document holds; what is left empty goes.

    Null texts, texts without words and rows with a null id stay as they are. n_chars is that of
    the text before. An empty table gives none.
    """
    return substring_dup.cut_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source; documents without words are taken once at most. An empty table
    gives none.
    """
    return mixing.mix_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a null or empty text is the end id alone. An empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", first_of_near_duplicates),
    ("substring dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]
#: SQL can express neither the classifier nor the tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**{k: v for m in _MODULES for k, v in m.QUERIES.items()}, "pipeline": run}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
