"""SimHash near-duplicates by a binary trie's join with itself.

A fingerprint has 64 bits. Equal fingerprints are one class (partial aggregation meets copies before any shuffle), and only classes
are joined. Two fingerprints within ``BUDGET`` differing bits agree on at least ``RUNS - BUDGET`` of ``RUNS`` runs of bits, so each class goes to
a table for each choice of so many runs (15 tables, by some 21 bits each), with the chosen runs' bits first, and meets the classes that share
them: the tries below a common prefix, two million of them to a table. There pairs of trie nodes
are walked down together, bit by bit; a pair gets an error for each level on which its sides part, and is dropped beyond the budget. Pairs
of few leaves are compared at once. A bucket returns a spanning star of what it linked, never its pairs.

Null text is empty: no words, fingerprint zero, linked like any other. A row with a null doc_id gets its fingerprint and the component
of its class. Equal rows give equal rows. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, raw, ship, sole, written
from .graph import components

WORDS, SEED, BITS, BUDGET = 4, 42, 64, 4
#: Runs of bits that tables are chosen from, more than the budget.
RUNS = 6
#: Classes that a task joins at a time, in whole buckets.
CHUNK = 200_000
_LEAF = 64


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The fingerprints of whole texts."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owners: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        if not hashes:
            return
        h = np.array(hashes, np.uint64)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        n = np.array(counts)
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        whole.setdefault(owners[-1], np.zeros(BITS, np.int64))
        for o, c, s in zip(owners, counts, sums, strict=True):
            if o in whole:
                whole[o] += s
                size[o] = size.get(o, 0) + c
            else:
                out[o] = np.packbits(2 * s > c).view(">u8")[0]
        for o in [o for o in whole if o != owners[-1]]:
            out[o] = np.packbits(2 * whole.pop(o) > size.pop(o)).view(">u8")[0]
        hashes.clear(), owners.clear(), counts.clear()

    whole: dict[int, np.ndarray] = {}  # sums of the text that goes on in the next part
    size: dict[int, int] = {}
    for i, text in enumerate(texts):
        parts = text.lower().split()  # of bytes: A-Z only, and ASCII white space
        if not parts:
            continue
        ends = []
        at = -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        norm = b" ".join(parts)
        if len(parts) <= words:
            spans = [(0, len(norm))]
        else:
            spans = list(zip([0, *[e + 1 for e in ends[: len(ends) - words]]], ends[words - 1 :], strict=True))
        for k in range(0, len(spans), 65_536):
            some = [digest(norm[a:b], SEED) for a, b in spans[k : k + 65_536]]
            hashes += some
            owners.append(i)
            counts.append(len(some))
            if len(hashes) >= 65_536:
                flush()
    flush()
    for o in list(whole):
        out[o] = np.packbits(2 * whole.pop(o) > size.pop(o)).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's bits)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(raw(batch.column(1))).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give both ends of each pair the smaller label until labels agree; labels point at smaller places."""
    while len(a):
        la, lb = labels[a], labels[b]
        off = la != lb
        if not off.any():
            return
        a, b, la, lb = a[off], b[off], la[off], lb[off]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def join_trie(values: np.ndarray, starts: np.ndarray, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Labels of distinct sorted values after linking pairs of one bucket that differ in at most ``budget`` bits.

    values: sorted, of 64 bits; starts: where each bucket begins; a bucket's values share their first ``depth`` bits.
    """
    n = len(values)
    labels = np.arange(n)
    ends = np.append(starts[1:], n)
    many = ends - starts > 1
    a0, a1 = starts[many], ends[many]
    b0, b1, errors = a0, a1, np.zeros(len(a0), np.int64)  # a node with itself

    def leaves(x0, x1, y0, y1) -> None:
        """Compare the leaves of node pairs; pairs already linked need no comparison."""
        w, m = y1 - y0, (x1 - x0) * (y1 - y0)
        done = 0
        total = np.cumsum(m)
        while done < len(m):
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + (1 << 21), side="right")))
            pair = np.repeat(np.arange(done, to), m[done:to])
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(m[done:to]) - m[done:to], m[done:to])
            i, j = x0[pair] + nth // w[pair], y0[pair] + nth % w[pair]
            new = (i < j) & (labels[i] != labels[j])
            i, j = i[new], j[new]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            _union(labels, i[near], j[near])
            done = to

    for level in range(depth, BITS):
        if not len(a0):
            break
        small = (a1 - a0) * (b1 - b0) <= _LEAF
        if small.any():
            leaves(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, errors = (x[~small] for x in (a0, a1, b0, b1, errors))
            if not len(a0):
                break
        ones = np.concatenate([[0], np.cumsum(values >> np.uint64(63 - level) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [
            (a0, am, b0, bm, errors),
            (am, a1, bm, b1, errors),
            (a0, am, bm, b1, errors + 1),
            tuple(x[~own] for x in (am, a1, b0, bm, errors + 1)),
        ]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
        # nodes whose leaves all are linked already go: their first and last label and the range's sum tell
        keep = (a1 > a0) & (b1 > b0) & (errors <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, errors = (x[keep] for x in (a0, a1, b0, b1, errors))
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        linked = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (labels[a0] == labels[b0])
        if linked.any():
            a0, a1, b0, b1, errors = (x[~linked] for x in (a0, a1, b0, b1, errors))
    if len(a0):
        leaves(a0, a1, b0, b1)
    return labels


def _tables(budget: int, runs: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each table the runs of bits (first from the left, width) in its order, and how many bits its chosen ones have."""
    edges = [BITS * i // runs for i in range(runs + 1)]
    every = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    chosen = combinations(every, runs - budget)
    return [([*some, *(r for r in every if r not in some)], sum(w for _, w in some)) for some in chosen]


def _turned(fp, order: list[tuple[int, int]]):
    """fp with its runs of bits in another order."""
    out, to = F.lit(0).cast("bigint"), 0
    for first, width in order:
        to += width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftleft(fp, first), BITS - width), BITS - to))
    return out


def links(classes: DataFrame, budget: int = BUDGET, runs: int = RUNS) -> DataFrame:
    """a, b: pairs of classes(fp, id), by id, that connect what lies within the budget; a spanning star for each group in a bucket."""
    n = partitions(classes.sparkSession)
    tables = _tables(budget, runs)
    widths = [w for _, w in tables]
    turned = F.array(*(_turned(F.col("fp"), order) for order, _ in tables))
    each = classes.select("id", F.posexplode(turned).alias("t", "v"))
    bucket = F.expr(f"shiftrightunsigned(v, {BITS} - element_at(array({', '.join(map(str, widths))}), t + 1))")
    rows = each.select("t", bucket.alias("bucket"), "v", "id")

    def linked(t: int, values: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(values)
        values, ids = values[order], ids[order]
        head = values >> np.uint64(BITS - widths[t])
        starts = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
        labels = join_trie(values, starts, widths[t], budget)
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        root = least[labels]
        far = root != ids
        return ids[far], root[far]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            for t, parts in held.items():
                a, b = linked(t, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held.clear()

        for batch in batches:
            t, bucket, v, i = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)], strict=True):
                key = (int(t[lo]), int(bucket[lo]))
                if count >= CHUNK and key != last:
                    yield from flush()
                    count = 0
                held.setdefault(key[0], []).append((v[lo:hi].view(np.uint64), i[lo:hi]))
                count, last = count + hi - lo, key
        yield from flush()

    return rows.repartition(n, "t", "bucket").sortWithinPartitions("t", "bucket").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links lead to."""
    spark = docs.sparkSession
    ship(spark)
    marked = written(with_fingerprint(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("id"))
    classes = written(classes, "classes")
    roots = components(links(classes.filter(F.col("id").isNotNull()), budget))
    named = classes.join(roots, classes["id"] == roots["node"], "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    named = written(named, "components")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the smallest doc_id; all columns stay.

    Of rows that share a doc_id one stays. Rows with a null doc_id can't stand for a group and stay as they are.
    """
    from pyspark.sql import Window

    first = near_duplicates(docs).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_first")).distinct()
    own = docs.join(first, F.col("doc_id").cast("bigint") == F.col("_first")).drop("_first")
    columns = docs.columns
    once = own.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*columns)))).filter("_nth = 1").drop("_nth")
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: fingerprints and components of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
