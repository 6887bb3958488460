"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators import shipping

#: Bytes of text that one step of a Python operator holds at a time.
BLOCK_BYTES = 4 << 20
#: Bytes of rows that Spark sends to Python at a time; its default is 64 MB.
SENT_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one in the warehouse, or without a cluster a temporary one."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        local = spark.sparkContext.master.startswith("local")
        there = _own_dir() if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.shared-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the Python driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is temporary anyhow
        pass


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, and lost executors don't matter."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unwritten(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads again."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            _drop(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and have Spark send rows to Python in batches of ``SENT_BYTES``."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT_BYTES)
    shipping.ship(spark)


_caches: list[dict] = []


def sole(*mine: dict) -> None:
    """Empty the caches of other operators in this process: a worker that serves several of them holds one's cache at a time.

    What their Arrow batches have left goes back to the system, too.
    """
    others = [cache for cache in _caches if not any(cache is m for m in mine)]
    for cache in others:
        cache.clear()
    if others:
        pa.default_memory_pool().release_unused()
    _caches[:] = mine


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text each; a longer text is a slice by itself."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        n = len(column)
        if n == 0:
            continue
        ends = np.cumsum([0 if v is None else v for v in pc.binary_length(column).to_pylist()])
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def sort_ranges(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df in n ranges of keys, sorted in each."""
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
