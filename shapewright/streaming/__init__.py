"""Streams of documents: checks have no state, so a stream is checked like a table; quarantine parts its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.conformance import validate


def validate_stream(stream: DataFrame, schema, on: str, **how) -> DataFrame:
    """The stream with ``valid``."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return validate(stream, schema, on, **how)


def quarantine(checked: DataFrame, good: str, bad: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write valid rows of a checked stream to one folder and the others to another, each batch of rows once."""

    def part(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("valid").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter("NOT valid").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    writer = checked.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
