"""Corpus preparation: quality rules, line dedup, n-gram Jaccard join, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``. Between two
stages the rows are written to the checkpoint folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcspan.llm import jaccard_join, line_dedup, packing, pii, quality_rules
from arcspan.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands let pass."""
    return quality_rules.reject(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the boilerplate lines of their source."""
    return line_dedup.drop(docs)


#: Words in a shingle and least similarity of near duplicates here; the defaults of ``jaccard_join`` are those of op3's query.
SHINGLE, PERCENT = 5, 80


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return jaccard_join.dedup(docs, SHINGLE, PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data masked."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: No SQL expresses compression ratios, a trained span classifier or token ids; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
