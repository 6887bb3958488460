"""Token-id output as a content-addressed store.

Files, all Parquet, below one folder:

``chunks``    digest, n_ids, data: each distinct run of ids once; data are little-endian ids, 2 bytes each where the vocabulary
              has at most 65,536 ids, else 4.
``recipes``   shard, row, doc_id, first, n_tokens, refs, sizes: shards hold ascending ranges of doc_id and rows ascend in each; refs is the
              document's chunk digests (16 bytes each) in order, sizes their numbers of ids (2 bytes each); first counts the ids that
              precede it in its shard. Row -1 of a shard is its footer: first is its number of documents, n_tokens that of ids, refs the
              Merkle root over its recipes.
``manifest``  shard, n_docs, n_tokens, first, root: the shards' footers, and the number of ids before each. Shard -1 has the sums and the
              Merkle root over the other rows.

A rolling hash over the last 16 ids cuts a document's ids where its low bits are zero, so that equal passages give equal chunks
whatever precedes them. Reading verifies the manifest, footers, recipes and chunks, and that each recipe finds its chunks; what doesn't
fit raises an error.

Null text is an empty text. Rows with a null doc_id come first, equal doc_ids keep each its own recipe. Other columns play no part.
An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, raw, ship, table_path
from .tokens import encoder, vocabulary_path

WINDOW, LEAST, MOST, MASK = 16, 64, 1024, (1 << 8) - 1
DIGEST = 16
#: Words that a worker of this operator keeps the ids of.
CACHE_WORDS = 1_200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each id."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_TABLE = _mixed(np.arange(1 << 16))


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of one document's ids end; the last end is len(ids)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    rolling = (_TABLE[ids] if len(_TABLE) > int(ids.max()) else _mixed(ids)).copy()  # sum of the last WINDOW values, each shifted once for each id since
    back = 1
    while back < WINDOW:
        rolling[back:] += rolling[:-back] << np.uint64(back)
        back *= 2
    places = np.flatnonzero((rolling >> np.uint64(WINDOW)) & np.uint64(MASK) == 0) + 1
    ends, at = [], 0
    for place in places.tolist():
        while place - at > MOST:
            at += MOST
            ends.append(at)
        if place - at >= LEAST:
            at = place
            ends.append(at)
    while n - at > MOST:
        at += MOST
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, refs, sizes, and fresh: the chunks that this task has not sent before."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, CACHE_WORDS)
        end = end_id.to_bytes(encode.width, "little")
        sent: set[bytes] = set()
        for batch in blocks(batches):
            counts, refs, lengths, until = [], [], [], [0]
            keys: list[bytes] = []
            sizes: list[int] = []
            chunks: list[bytes] = []
            width = encode.width
            for text in raw(batch.column(1)):
                data = encode.ids(text) + end
                ref, at = [], 0
                ends = cuts(np.frombuffer(data, encode.dtype))
                lengths.append(np.diff(ends, prepend=0).astype("<u2").tobytes())
                for to in ends:
                    chunk = data[at * width : to * width]
                    key = digest(chunk)
                    ref.append(key)
                    if key not in sent:
                        sent.add(key)
                        keys.append(key)
                        sizes.append(to - at)
                        chunks.append(chunk)
                    at = to
                if len(sent) > 1_000_000:
                    sent.clear()
                counts.append(at)
                refs.append(b"".join(ref))
                until.append(len(keys))
            fresh = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(chunks, pa.binary())], ["digest", "n_ids", "data"])
            fresh = pa.ListArray.from_arrays(pa.array(until, pa.int32()), fresh)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(refs, pa.binary()), pa.array(lengths, pa.binary()), fresh], ["doc_id", "n_tokens", "refs", "sizes", "fresh"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, refs binary, sizes binary, fresh array<struct<digest: binary, n_ids: int, data: binary>>")


def _merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


class _Tree:
    """A Merkle root over any number of leaves in memory that grows with their number's logarithm."""

    def __init__(self) -> None:
        self.levels: list[list[bytes]] = []

    def add(self, leaf: bytes) -> None:
        for level in self.levels:
            level.append(leaf)
            if len(level) < 64:
                return
            leaf = _merkle(level)
            level.clear()
        self.levels.append([leaf])

    def root(self) -> bytes:
        carry: list[bytes] = []
        for level in self.levels:
            carry = [_merkle(level + carry)] if level or carry else []
        return carry[0] if carry else digest(b"")


def _leaf(*values) -> bytes:
    """The digest of a row's values."""
    return digest(repr(values).encode())


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> str:
    """Encode the whole texts of docs(doc_id, text), append end_id to each, and write the store; returns its folder."""
    spark = docs.sparkSession
    ship(spark)
    path = path or vocabulary_path()
    kind = dict(docs.dtypes)["doc_id"]
    made = encoded(docs, path, end_id)
    at = table_path(spark, "encoded")
    made.write.option("compression", "zstd").parquet(at)
    made = spark.read.schema(made.schema).parquet(at)

    chunks = made.select(F.explode("fresh").alias("c")).select("c.*").dropDuplicates(["digest"])
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, first, tree = TaskContext.get().partitionId(), 0, 0, _Tree()
        names = ["shard", "row", "doc_id", "first", "n_tokens", "refs", "sizes"]
        last = None
        for batch in batches:
            counts = batch.column(1).to_numpy()
            n = len(counts)
            before = first + np.cumsum(counts) - counts
            for leaf in zip(batch.column(0).to_pylist(), before.tolist(), counts.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tree.add(_leaf(*leaf))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), batch.column(0), pa.array(before), *batch.columns[1:]], names)
            row, first, last = row + n, first + int(counts.sum()), batch
        if row:
            nothing = pa.nulls(1, last.column(0).type)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1]), nothing, pa.array([row]), pa.array([first]), pa.array([tree.root()], pa.binary()), pa.array([b""], pa.binary())], names)

    ordered = made.select("doc_id", "n_tokens", "refs", "sizes").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(in_order, f"shard int, row bigint, doc_id {kind}, first bigint, n_tokens bigint, refs binary, sizes binary").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    first, rows = 0, []
    for shard, n_docs, n_tokens, root in _footers(spark, folder):
        rows.append((shard, n_docs, n_tokens, first, root))
        first += n_tokens
    rows.append((-1, sum(r[1] for r in rows), first, 0, _merkle([_leaf(*r) for r in rows])))
    spark.createDataFrame(rows, "shard int, n_docs bigint, n_tokens bigint, first bigint, root binary").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def _footers(spark: SparkSession, folder: str) -> list[tuple]:
    """(shard, n_docs, n_tokens, root) of each shard, as many as the store was written with partitions."""
    rows = spark.read.parquet(f"{folder}/recipes").filter("row = -1").select("shard", "first", "n_tokens", "refs").collect()
    return sorted((r.shard, r.first, r.n_tokens, bytes(r.refs)) for r in rows)


def verified_manifest(spark: SparkSession, folder: str) -> dict[int, int]:
    """The number of ids before each shard. A manifest that doesn't fit its root or the shards' footers raises."""
    rows = sorted((r.shard, r.n_docs, r.n_tokens, r.first, bytes(r.root)) for r in spark.read.parquet(f"{folder}/manifest").collect())
    if not rows or rows[0][0] != -1 or rows[0][1:] != (sum(r[1] for r in rows[1:]), sum(r[2] for r in rows[1:]), 0, _merkle([_leaf(*r) for r in rows[1:]])):
        raise ValueError("the manifest doesn't match its root")
    if [(s, d, t, root) for s, d, t, _, root in rows[1:]] != _footers(spark, folder):
        raise ValueError("shards' footers don't match the manifest")
    return {r[0]: r[3] for r in rows[1:]}


def _shift_tables() -> np.ndarray:
    """[k, byte place, byte]: what appending 2**k zero bytes does to a CRC-32, as lookups by byte."""

    def table(rows: np.ndarray) -> np.ndarray:  # rows[i]: the image of bit i
        out = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                out[place] ^= np.where(np.arange(256) >> bit & 1, rows[8 * place + bit], 0).astype(np.uint32)
        return out

    rows = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint32)  # one zero bit
    tables = []
    for k in range(3 + 40):
        t = table(rows)
        if k >= 3:
            tables.append(t)
        rows = _shifted(t, rows)
    return np.stack(tables)


def _shifted(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc_before(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The share of crc in the CRC-32 of a longer string that has so many bytes after it."""
    crc, zeros = crc.astype(np.uint32), zeros.copy()
    k = 0
    while zeros.any():
        odd = np.flatnonzero(zeros & 1)
        crc[odd] = _shifted(tables[k], crc[odd])
        zeros >>= 1
        k += 1
    return crc


def _verified_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunks as they are; one that fails its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest(data) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't match its digest")
            yield batch

    return spark.read.parquet(f"{folder}/chunks").select("digest", "n_ids", "data").mapInArrow(run, "digest binary, n_ids int, data binary")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n_ids, crc of the ids as little-endian unsigned 32-bit integers; a chunk that fails its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for key, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest(data) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't match its digest")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(crcs, pa.int64())], ["digest", "n_ids", "crc"])

    return spark.read.parquet(f"{folder}/chunks").select("digest", "n_ids", "data").mapInArrow(run, "digest binary, n_ids int, crc bigint")


def _exploded(spark: SparkSession, folder: str) -> DataFrame:
    """shard, row, doc_id, start, n_tokens, digest, n_ids, place, after: a row for each chunk of each verified recipe; after counts the ids behind it."""
    before = verified_manifest(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    kind = dict(recipes.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, docs, tokens, footer = None, _Tree(), 0, 0, None

        def close() -> None:
            if shard is not None and footer != (docs, tokens, tree.root()):
                raise ValueError(f"the recipes of shard {shard} don't match its root")

        for batch in batches:
            table = [c.to_pylist() for c in batch.columns]
            rows = []
            for i, (s, row, doc, first, n, refs, sizes) in enumerate(zip(*table, strict=True)):
                if s != shard:
                    close()
                    shard, tree, docs, tokens, footer = s, _Tree(), 0, 0, None
                if row == -1:
                    footer = (first, n, refs)
                    continue
                if first != tokens or row != docs:
                    raise ValueError(f"row {row} of shard {s} isn't where it was")
                tree.add(_leaf(doc, first, n, refs, sizes))
                docs, tokens = docs + 1, tokens + n
                rows.append(i)
            if not rows:
                continue
            ids = [np.frombuffer(table[6][i], "<u2").astype(np.int64) for i in rows]
            n = np.array([len(x) for x in ids], np.int64)
            n_ids = np.concatenate(ids)
            ends = np.cumsum(n)
            total = np.add.reduceat(n_ids, ends - n)
            n_tokens = batch.column(4).to_numpy()[rows]
            if (total != n_tokens).any() or sum(len(table[5][i]) for i in rows) != DIGEST * ends[-1]:
                raise ValueError(f"a recipe of shard {shard} has not the ids that it says")
            which = np.repeat(np.arange(len(rows)), n)
            sums = np.cumsum(n_ids)
            after = sums[ends - 1][which] - sums
            keys = pa.Array.from_buffers(pa.binary(DIGEST), len(which), [None, pa.py_buffer(b"".join(table[5][i] for i in rows))]).cast(pa.binary())
            start = batch.column(3).to_numpy()[rows] + np.array([before[table[0][i]] for i in rows])
            at = np.array(rows)[which]
            columns = [batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(start[which]), pa.array(n_tokens[which]), keys, pa.array(n_ids.astype(np.int32)), pa.array(np.arange(len(which)) - (ends - n)[which]), pa.array(after)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "row", "doc_id", "start", "n_tokens", "digest", "n_ids", "place", "after"])
        close()

    # the rows of a shard may come from several splits of its file: one task gets them all, in order, the footer first
    narrow = recipes.select("shard", "row", "doc_id", "first", "n_tokens", "refs", "sizes").repartition(partitions(spark), "shard").sortWithinPartitions("shard", "row")
    return narrow.mapInArrow(run, f"shard int, row bigint, doc_id {kind}, start bigint, n_tokens bigint, digest binary, n_ids int, place bigint, after bigint")


def _found(parts: DataFrame, chunks: DataFrame, value: str) -> DataFrame:
    """parts with their chunks' ``value``; a chunk that is missing or has another number of ids raises."""
    joined = parts.join(chunks.withColumnRenamed("n_ids", "_has"), "digest", "left")
    wrong = F.col("_has").isNull() | (F.col("_has") != F.col("n_ids"))
    return joined.withColumn(value, F.when(wrong, F.raise_error(F.concat(F.lit("no such chunk: "), F.hex("digest")))).otherwise(F.col(value)))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: the documents' ids, put together from the store."""
    ship(spark)
    parts = _found(_exploded(spark, folder), _verified_chunks(spark, folder), "data")
    whole = parts.groupBy("shard", "row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "n_ids", "data"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["data"], f"<u{len(p['data']) // p['n_ids']}").astype(np.int64) for p in r]) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(run, f"doc_id {dict(whole.dtypes)['doc_id']}, ids array<bigint>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the store's files.

    Each distinct chunk is read, verified and summed once; a document's CRC-32 is the exclusive or of its chunks' CRC-32s, each
    carried over the bytes that follow it. So no ids travel, and a chunk that a third of the documents share costs a row each.
    """
    ship(spark)
    parts = _found(_exploded(spark, folder), read_chunks(spark, folder), "crc").select("shard", "row", "doc_id", "start", "n_tokens", "crc", "after")
    kind = dict(parts.dtypes)["doc_id"]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for batch in batches:
            share = crc_before(batch.column(5).to_numpy(), batch.column(6).to_numpy() * 4, tables)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(share.astype(np.int64))], ["shard", "row", "doc_id", "start", "n_tokens", "share"])

    shares = parts.mapInArrow(carried, f"shard int, row bigint, doc_id {kind}, start bigint, n_tokens bigint, share bigint")
    return shares.groupBy("shard", "row", "doc_id", "start", "n_tokens").agg(F.bit_xor("share").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document of ``documents`` through the store and back."""
    folder = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), table_path(spark, "store"))
    return read_digests(spark, folder)
