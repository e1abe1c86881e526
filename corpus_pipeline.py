"""A training corpus from ``documents`` in five stages.

1. quality_rules: documents that the base rule or the robust outlier test rejects go.
2. line_dedup: of equal and near-equal lines the first occurrence stays; ``text`` and ``n_chars`` follow.
3. near_dedup: of each class of near-duplicates (exact Jaccard similarity of five-word shingle sets, 0.8 at least) one stays.
4. mixing: sources approach weights in proportion to the root of their documents; copies lie in a global random order.
5. packing: token sequences of 2048, a row per piece of a document.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows of the stage before; all but the last keep the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import line_edit_join, packing, poisson_mixing, quality_mcd, simhash_trees
from sparkveil.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_mcd.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_edit_join.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_trees.keep_one_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return poisson_mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", pack)]

#: SQL can't state the robust estimates, fingerprints or token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
