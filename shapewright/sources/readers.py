"""Documents from files, one row for each: path and document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """A JSON document in each file."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """A JSON document in each line."""
    return spark.read.text(list(paths)).select(F.input_file_name().alias("path"), F.col("value").alias("document"))


def cbor_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """A CBOR item in each file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("content").alias("document"))


def csv_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV text in each file; quoted line ends rule out reading by lines."""
    return json_documents(spark, *paths)


def write_by_validity(df: DataFrame, path: str) -> None:
    """Checked rows as Parquet, valid and invalid ones in folders of their own."""
    df.write.partitionBy("valid").parquet(path)
