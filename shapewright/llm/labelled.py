"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on at most: those of the smallest hashes.
TRAIN_ROWS = 6000


def held_out(doc_id="doc_id"):
    """Whether a document may not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> tuple[list[bytes], list[int]]:
    """Whole texts and labels of a bounded sample of the labelled documents that may be learnt from.

    The sample is the ``rows`` labelled documents of the smallest hash of doc_id. Labels other than 0 and 1, and rows with a null
    doc_id, are left out; of rows that share a doc_id, and of its labels, the smallest counts.
    """
    good = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    some = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # `rows` narrow rows are sent
    table = picked.orderBy("doc_id").select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label").toArrow()
    return table.column("text").to_pylist(), table.column("label").to_pylist()
