"""Exact top-k search by inner product, a block at a time.

Vectors are sorted by id and cut into blocks of ``BLOCK`` rows; a block's forward index is its matrix of whole numbers, and its summary
is each dimension's maximum and minimum. For a query, a block's bound is the sum over dimensions of the better of weight times
maximum and weight times minimum. Each query goes through the blocks of a cell by falling bound and stops once the bound is
below its k-th score, so no row that could be in the result is passed over. Cells of ``CELL`` blocks meet all query blocks in tasks of
their own; a task holds one cell, and query blocks stream by. Each query then merges k rows from each cell, those of ``NEAR`` cells first.

A null vector or id, and a vector with a null or non-finite component, takes no part. Vectors of different lengths aren't compared.
Rows that share an id are all candidates, but not for the query of that id, which takes the smallest of its vectors. Scores beyond
a long become its largest or smallest value. Ties go to the smaller id, then any of the equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, ship, written

BLOCK, CELL, QUERIES = 256, 32, 512
#: Cells whose finds are merged before those of all.
NEAR = 1024
SCALE = 64

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_BLOCK_SCHEMA = "dim int, ids binary, matrix binary"


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v of the rows that take part; v as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def blocked(vectors: DataFrame, rows: int) -> DataFrame:
    """dim, ids, matrix: blocks of ascending ids, each in one task's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, some: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in some], np.int64)
            matrix = np.floor(SCALE * np.array([v for _, v in some], np.float64).reshape(len(some), dim))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], ["dim", "ids", "matrix"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = held.setdefault(len(v), [])
                some.append((i, v))
                if len(some) == rows:
                    yield out(len(v), held.pop(len(v)))
        for dim, some in held.items():
            yield out(dim, some)

    return vectors.mapInArrow(run, _BLOCK_SCHEMA)


class Cell:
    """Blocks of one length of vector, searched together."""

    def __init__(self, dim: int):
        self.dim, self.ids, self.matrices = dim, [], []

    def add(self, ids: bytes, matrix: bytes) -> None:
        i = np.frombuffer(ids, np.int64)
        self.ids.append(i)
        self.matrices.append(np.frombuffer(matrix, np.float64).reshape(len(i), self.dim))

    def close(self) -> None:
        # positions follow the ids over the whole cell, so that a smaller position breaks a tie
        ids = np.concatenate(self.ids)
        order = np.argsort(ids, kind="stable")
        matrix = np.concatenate(self.matrices)[order]
        self.all = ids[order]
        self.starts = list(range(0, len(ids), BLOCK))
        self.blocks = [matrix[a : a + BLOCK] for a in self.starts]
        self.high = np.array([b.max(axis=0, initial=-np.inf) if self.dim else np.zeros(0) for b in self.blocks]).reshape(len(self.blocks), self.dim)
        self.low = np.array([b.min(axis=0, initial=np.inf) if self.dim else np.zeros(0) for b in self.blocks]).reshape(len(self.blocks), self.dim)
        self.bits = max(1, len(ids) - 1).bit_length()
        self.largest = float(np.abs(matrix).max(initial=0))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """(score, id) of each query's k best here."""
        if self.dim * self.largest * float(np.abs(queries).max(initial=0)) >= 2 ** min(53, 62 - self.bits):
            return [self._exactly(i, q, k) for i, q in zip(ids.tolist(), queries, strict=True)]
        n, nb = len(ids), len(self.blocks)
        bound = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        order = np.argsort(-bound, axis=1, kind="stable")
        least = np.iinfo(np.int64).min
        best = np.full((n, k), least, np.int64)  # score and position in one number
        left, right = np.searchsorted(self.all, ids, "left"), np.searchsorted(self.all, ids, "right")
        top = (1 << self.bits) - 1
        alive = np.arange(n)
        for wave in range(nb):
            chosen = order[alive, wave]
            kth = best[alive].min(axis=1)
            kth_score = np.where(kth == least, -np.inf, (kth >> self.bits).astype(np.float64))
            going = bound[alive, chosen] >= kth_score
            alive, chosen = alive[going], chosen[going]
            if not len(alive):
                break
            for b in np.unique(chosen).tolist():
                mine = alive[chosen == b]
                scores = (queries[mine] @ self.blocks[b].T).astype(np.int64)
                at = self.starts[b]
                keys = (scores << self.bits) | (top - np.arange(at, at + scores.shape[1]))
                for row in np.flatnonzero((left[mine] < right[mine]) & (right[mine] > at) & (left[mine] < at + scores.shape[1])).tolist():
                    q = mine[row]
                    keys[row, max(0, left[q] - at) : max(0, right[q] - at)] = least
                both = np.concatenate([best[mine], keys], axis=1)
                best[mine] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both
        best = -np.sort(-best.astype(np.int64), axis=1) if n else best
        return [[(int(x >> self.bits), int(self.all[top - (x & top)])) for x in row[row != least].tolist()] for row in best]

    def _exactly(self, i: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """For numbers beyond a double's exact range."""
        q = [int(x) for x in query]
        rows = ((sum(a * int(b) for a, b in zip(q, row, strict=True)), int(j)) for at, block in zip(self.starts, self.blocks, strict=True) for j, row in zip(self.all[at : at + BLOCK], block, strict=True) if j != i)
        return sorted(((max(-(1 << 63), min((1 << 63) - 1, s)), j) for s, j in rows), key=lambda x: (-x[0], x[1]))[:k]


def search(candidates: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of candidates for each row of queries, both (key, vector)."""
    spark = candidates.sparkSession
    ship(spark)
    n = partitions(spark)
    index = written(blocked(whole_vectors(candidates, key, vector).repartitionByRange(n, "id").sortWithinPartitions("id"), BLOCK), "blocks")
    asked = whole_vectors(queries, key, vector).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(blocked(asked.repartitionByRange(max(1, n // 4), "id").sortWithinPartitions("id"), QUERIES), "queries")
    per_dim = index.groupBy("dim").agg(F.count("*").alias("n")).collect()  # a row for each length of vector
    cells, first = {}, 0
    for r in per_dim:
        cells[r["dim"]] = (first, -(-r["n"] // CELL))
        first += cells[r["dim"]][1]
    if not first:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    of = F.create_map(*(F.lit(x) for d, (a, c) in cells.items() for x in (d, a)))
    number = F.create_map(*(F.lit(x) for d, (a, c) in cells.items() for x in (d, c)))
    first_id = F.hex("ids")
    # blocks are dealt to cells by a hash: which cell a block is in changes no result
    dealt = index.select((of[F.col("dim")] + F.pmod(F.xxhash64(first_id), number[F.col("dim")])).cast("int").alias("cell"), F.lit(0).alias("kind"), "dim", "ids", "matrix")
    sent = asked.filter(F.col("dim").isin([d for d in cells])).withColumn("cell", F.explode(F.sequence(of[F.col("dim")], of[F.col("dim")] + number[F.col("dim")] - 1))).select(F.col("cell").cast("int"), F.lit(1).alias("kind"), "dim", "ids", "matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, closed = None, None, False
        for batch in batches:
            for c, kind, dim, ids, matrix in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != at:
                    at, cell, closed = c, Cell(dim), False
                if kind == 0:
                    cell.add(ids, matrix)
                    continue
                if not cell.ids:
                    continue
                if not closed:
                    cell.close()
                    closed = True
                asks = np.frombuffer(ids, np.int64)
                found = cell.search(asks, np.frombuffer(matrix, np.float64).reshape(len(asks), dim), k)
                packed = [np.array(f, np.int64).reshape(-1, 2).tobytes() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(asks), pa.array(np.full(len(asks), c // NEAR)), pa.array(packed, pa.binary())], ["query_id", "near", "found"])

    local = dealt.unionByName(sent).repartition(max(1, min(n, first)), "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "query_id bigint, near bigint, found binary")

    def merge_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_best(lists, k).tobytes() for lists in batch.column(1).to_pylist()], pa.binary())], ["query_id", "found"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, rank, ids, scores = [], [], [], []
            for query, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _best(lists, k)
                q.extend([query] * len(rows))
                rank.extend(range(1, len(rows) + 1))
                ids.extend(rows[:, 1].tolist())
                scores.extend(rows[:, 0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "rank", "vec_id", "score"])

    near = local.groupBy("query_id", "near").agg(F.collect_list("found").alias("lists")).select("query_id", "lists").mapInArrow(merge_near, "query_id bigint, found binary")
    return near.groupBy("query_id").agg(F.collect_list("found").alias("lists")).mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score bigint")


def _best(lists: list[bytes], k: int) -> np.ndarray:
    """The k best of lists of (score, id)."""
    rows = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists])
    return rows[np.lexsort((rows[:, 1], -rows[:, 0]))][:k]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: rows of ``embeddings`` whose vec_id is divisible by 20 against all rows, the 20 best each."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)
