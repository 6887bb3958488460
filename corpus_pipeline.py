"""A corpus pipeline of five stages, each an operator of ``shapewright.llm``.

Every stage is a function of (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes each stage's result to the shared folder and
reads it back for the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.llm import mixing, packing, quality, simhash, suffix_dedup, tokens
from shapewright.llm._common import ship, written

#: The stages' decisions hang on trained models and hashes that SQL doesn't have.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among docs, doesn't reject."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs.select(*COLUMNS), model).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash, that of the smallest doc_id."""
    return simhash.distinct_documents(docs.select(*COLUMNS))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that start earlier elsewhere; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard by shard in random order."""
    return mixing.shuffled(mixing.mixed(docs.select(*COLUMNS))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its place in a sequence of tokens."""
    ship(spark)
    return packing.pack(written(packing.pieces(docs, tokens.vocabulary_path()), "pieces"))


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("suffix-array dedup", no_repeats),
    ("source mixing", mixed_sources),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
