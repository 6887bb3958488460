"""Document fingerprints: SimHash, and all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its words and its pairs of neighbouring words. A term's weight grows with the logarithm of how often the text has it, so that
repeated lines don't drown the rest, and a pair weighs twice as much as a word, as texts of one language share many words. Each term's 64-bit hash
votes for or against each bit with that weight; a bit is 1 where more than half of all weight is for it. A text without words has fingerprint 0.

The bits are cut into ``BLOCKS`` blocks. Two fingerprints within ``RADIUS`` bits agree on at least BLOCKS - RADIUS blocks, so there is a table for each choice
of so many blocks, in which fingerprints are sorted with the chosen blocks first, and a query meets those that share these bits. Only
different fingerprints are in tables. A bucket of more than ``LOT`` of them is dealt to several tasks, each of which gets the bucket's queries. A pair
counts in the first of its tables only.

Null text is empty. A row's next document is that of the greatest smaller doc_id, after the last that of the greatest; null ids
come last. Of rows that share a doc_id the one with the least text is the next document, and each of them has the same next one. Equal rows
give equal rows. Other columns play no part. An empty table gives no rows; a table of one id is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, ship, written

BITS, BLOCKS, RADIUS = 64, 5, 3
#: Different fingerprints of one bucket for each task.
LOT = 50_000
#: Terms whose votes are added at a time.
CHUNK = 16_384
_PAIR, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def fingerprints(texts: pa.Array) -> list[int]:
    """64 bits for each of an array of texts; equal texts have equal ones. All sums are of whole numbers, so their order plays no part."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy()]
    ends = lists.offsets.to_numpy()
    return [_voted(own[a:b]) for a, b in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True)]


def _voted(own: np.ndarray) -> int:
    """The fingerprint of a text whose words have these hashes; 0 is no word."""
    own = own[own > 0]
    if not len(own):
        return 0
    (h, n), (h2, n2) = (np.unique(x, return_counts=True) for x in (own, _mixed(own[:-1] * _PAIR + own[1:])))
    h, w = np.concatenate([h, h2]), np.concatenate([1 + np.log2(n) // 1, 2 + 2 * (np.log2(n2) // 1)]).astype(np.float32)
    votes = np.zeros(BITS)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += w[at : at + CHUNK] @ bits.astype(np.float32)
    return int(np.packbits(2 * votes > w.sum(dtype=np.float64)).view(">u8")[0])


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, other: str) -> str:
    """text with its last third replaced by the beginning of other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _routed(docs: DataFrame) -> DataFrame:
    """bucket, role, doc_id, text: ranges of ids; role 0 is the last document before a range, which before the lowest one is the very last."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit((i + 1) / n) for i in range(n))), 1000 * n)).first()[0] or []
    bounds = np.array(sorted(set(found[:-1])), np.int64)  # a row for each partition
    place = lambda ids: np.searchsorted(bounds, ids, side="left")
    cuts = F.array(*(F.lit(int(b)) for b in bounds)).cast("array<bigint>")
    ends = docs.select("doc_id").groupBy(F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col("doc_id"))), F.lit(0)).alias("bucket")).agg(F.max("doc_id").alias("last")).orderBy("bucket").collect()
    ranges = [r["bucket"] for r in ends]
    lasts = np.array([r["last"] for r in ends if r["last"] is not None], np.int64)
    following = np.array([b for r, b in zip(ends, [*ranges[1:], *ranges[:1]], strict=True) if r["last"] is not None], np.int64)
    nameless = [b for r, b in zip(ends, [*ranges[1:], *ranges[:1]], strict=True) if r["last"] is None]  # nulls alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            own = np.where(null, 0, place(values))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.ones(len(own), np.int32)), ids, batch.column(1)], ["bucket", "role", "doc_id", "text"])
            at = np.searchsorted(lasts, values)
            last = ~null & (at < len(lasts)) & (lasts[np.minimum(at, len(lasts) - 1)] == values) if len(lasts) else np.zeros(len(own), bool)
            to = np.where(last, following[np.minimum(at, len(lasts) - 1)], 0) if len(lasts) else np.zeros(len(own), np.int64)
            if nameless:
                to, last = np.where(null, nameless[0], to), last | null
            pick = pa.array(np.flatnonzero(last))
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(to[last].astype(np.int32)), pa.array(np.zeros(len(pick), np.int32)), ids.take(pick), batch.column(1).take(pick)], ["bucket", "role", "doc_id", "text"])

    return docs.mapInArrow(run, "bucket int, role int, doc_id bigint, text string")


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp (longs with the fingerprints' bits), near_edited, near_next."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.uint64(), pa.uint64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = at = None  # of the row before
        least = before = ("", 0)  # text and fingerprint of the least row of this id, and of the id before
        for batch in blocks(batches):
            rows, others = [], []
            texts = batch.column(3)
            for b, role, i, text, fp in zip(*(c.to_pylist() for c in batch.columns), fingerprints(texts), strict=True):
                if b != bucket:
                    bucket, at, least = b, (role, i), (text, fp)
                elif (role, i) != at:
                    at, before, least = (role, i), least, (text, fp)
                if role:
                    others.append(edited(text, before[0]))
                    rows.append((i, len(text), hashlib.sha256(others[-1].encode()).hexdigest(), fp, likeness(fp, before[1])))
            if rows:
                ids, sizes, shas, fps, near_next = zip(*rows, strict=True)
                new = fingerprints(pa.array(others, texts.type))
                columns = (ids, sizes, shas, fps, new, [likeness(x, y) for x, y in zip(fps, new, strict=True)], near_next)
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([a.view(pa.int64()) if a.type == pa.uint64() else a for a in arrays], names)

    rows = _routed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "role", "doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, near_edited double, near_next double")


def _edges(blocks_: int) -> list[tuple[int, int]]:
    """Blocks of bits: first from the left, width."""
    cuts = [BITS * i // blocks_ for i in range(blocks_ + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _masks(radius: int, blocks_: int) -> list[int]:
    """The bits that each table compares."""
    return [sum(((1 << w) - 1) << (BITS - a - w) for a, w in some) for some in combinations(_edges(blocks_), blocks_ - radius)]


def _found(fps: DataFrame, queries: DataFrame, radius: int, blocks_: int, pairs: bool) -> DataFrame:
    """Pairs, or counts for each query, of different fingerprints of fps(fp, n) within the radius of queries(fp); n is how many rows have one."""
    spark = fps.sparkSession
    ship(spark)
    n = partitions(spark)
    masks = _masks(radius, blocks_)
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)))
    asked = queries.select("fp").distinct().select("fp", F.posexplode(keys).alias("t", "bucket"))
    held = fps.select("fp", "n", F.posexplode(keys).alias("t", "bucket"))
    # buckets that are asked for and larger than a lot
    large = held.groupBy("t", "bucket").agg(F.count("*").alias("size")).filter(F.col("size") > LOT).select("t", "bucket", F.ceil(F.col("size") / LOT).cast("int").alias("lots"))
    asked = asked.join(large, ["t", "bucket"], "left").select("t", "bucket", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"), F.lit(0).alias("kind"), "fp", F.lit(0).cast("bigint").alias("n"))
    held = held.join(large, ["t", "bucket"], "left").select("t", "bucket", F.pmod(F.xxhash64("fp"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"), F.lit(1).alias("kind"), "fp", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine, counts = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            if counts is not None and counts.any():
                some = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.array(mine)[some]), pa.array(counts[some])], ["fp", "n"])

        for batch in batches:
            t, bucket, lot, kind, fp, n_ = (c.to_numpy() for c in batch.columns)
            new = np.append(True, (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1]) | (lot[1:] != lot[:-1]) | (kind[1:] != kind[:-1]))
            cuts = np.flatnonzero(new).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(t)], strict=True):
                here = (int(t[lo]), int(bucket[lo]), int(lot[lo]))
                if here != key:
                    yield from told()
                    key, mine, counts = here, [], None
                if kind[lo] == 0:
                    mine += fp[lo:hi].tolist()
                    continue
                if not mine:
                    continue
                asks, counts = np.array(mine, np.int64), np.zeros(len(mine), np.int64) if counts is None else counts
                for a in range(0, len(asks), 1024):
                    differ = (asks[a : a + 1024, None] ^ fp[None, lo:hi]).view(np.uint64)
                    i, j = np.nonzero((np.bitwise_count(differ) <= radius) & (differ > 0))
                    some = differ[i, j]
                    first = np.ones(len(i), bool)
                    for m in masks[: here[0]]:  # agreed on in a table before
                        first &= (some & np.uint64(m)) > 0
                    i, j, some = i[first], j[first], some[first]
                    if pairs and len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(asks[a + i]), pa.array(fp[lo + j]), pa.array(np.bitwise_count(some).astype(np.int32))], ["fp", "other", "bits"])
                    elif len(i):
                        np.add.at(counts, a + i, n_[lo + j])
        if not pairs:
            yield from told()

    rows = asked.unionByName(held).repartition(n, "t", "bucket", "lot").sortWithinPartitions("t", "bucket", "lot", "kind")
    return rows.mapInArrow(run, "fp bigint, other bigint, bits int" if pairs else "fp bigint, n bigint")


def neighbours(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, other, bits: for each different fp of queries the other fps within the radius, and in how many bits they differ."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be less than the number of blocks")
    return _found(fps.select("fp", F.lit(1).cast("bigint").alias("n")).distinct(), queries, radius, blocks, True)


def near_counts(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, n: for each different fp of queries how many rows of fps lie within the radius, those of the same fp included."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be less than the number of blocks")
    classes = written(fps.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    own = classes.join(queries.select("fp").distinct(), "fp", "left_semi")
    return own.unionByName(_found(classes, queries, radius, blocks, False)).groupBy("fp").agg(F.sum("n").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: fingerprints of all ``documents`` and their edited texts.

    n_near, for every document whose id is divisible by 100 (null for others): how many other documents have fingerprints within the radius.
    """
    marked = written(with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet")), "marked")
    asked = F.col("doc_id") % 100 == 0
    near = near_counts(marked.select("fp"), marked.filter(asked).select("fp"))
    counted = marked.filter(asked).select("doc_id", "fp").distinct().join(near, "fp").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp"), (F.col("n") - 1).alias("n_near"))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    found = marked.join(counted, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_fp")), "left")
    return found.select("doc_id", "n_chars", "edited_sha256", digits("fp").alias("fingerprint"), digits("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_near")
