"""Removal of repeated byte strings by external induced sorting of suffixes, in shards.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a smaller doc_id, or before in the same
one. Equal strings must meet in one shard, and no shard may hold the corpus. So each string is keyed by the least hash of its
substrings of ``GRAM`` bytes: equal strings have equal keys, and strings that follow each other mostly share one, so a document falls
into spans, runs of starts with one key. Four steps:

1. Which keys do two spans have? Keys alone travel, counted for each block of documents.
2. Spans with such keys go to their key's shard. A key with more than ``FREQUENT_BYTES`` of spans is split: its spans are cut and keyed again by
   substrings of ``FINE_GRAM`` bytes. A block sends equal spans once, the earliest; the later ones are removed at once.
3. A shard gets its spans in the order of documents and orders their suffixes (``suffixes``): of starts whose first ``LENGTH`` letters agree
   all but the earliest are removed. Equal spans are dropped before as far as ``REMEMBERED`` digests tell. A shard of more than
   ``SHARD_HELD`` bytes is laid on disk, its text and spans, and sorted from there, whatever its size.
4. Blocks of documents get their removed starts back and cut their texts.

A document's block is a hash of its doc_id. There are as many shards as the texts have ``SHARD_BYTES``. Shards, blocks and what they are told
stream through tasks in sorted order, so that memory grows with a block's keys only.

Null text is empty. Of documents with equal doc_ids those with the smaller hash of their text come first, then those with the smaller
hash of their other columns; a null doc_id comes before all others. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, partitions, ship, written
from .suffixes import PART, Disk, Later, suffix_order

LENGTH, GRAM = 100, 40
#: Substrings that key the spans of a frequent key again, and the bytes of a key's spans from which on it counts as frequent.
FINE_GRAM, FREQUENT_BYTES = 90, 4 << 20
#: Bytes of text for each shard; a shard of ordinary texts gets about as many bytes of spans.
SHARD_BYTES = 8 << 20
#: Keys or bytes of spans that a task holds before it passes them on.
FLUSH_KEYS, FLUSH_BYTES = 500_000, 4 << 20
#: Bytes of a shard's spans that are held before they go to disk, and digests of spans that are remembered.
SHARD_HELD, REMEMBERED = 12 << 20, 400_000

_RANDOM = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 16, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            _powers[i] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)), dtype=np.uint64)
    return _powers[0], _powers[1]


def spans(text: bytes, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key and first start of each span, and whether it may hold equal strings; the starts go to len(text) - LENGTH."""
    n = len(text)
    if n < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    x = _RANDOM[np.frombuffer(text, np.uint8)]
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * up[:n], out=sums[1:])
    grams = n - gram + 1
    h = (sums[gram:] - sums[:-gram]) * down[:grams]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h &= ~np.uint64(1)
    wide = LENGTH - gram + 1
    whole = -(-grams // wide) * wide
    padded = np.full(whole, np.iinfo(np.uint64).max)
    padded[:grams] = h
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)  # of the block's values so far
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - LENGTH + 1
    before, after = behind[:starts], ahead[wide - 1 : wide - 1 + starts]
    least = np.minimum(before, after)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    key = least[first]
    double = np.diff(np.append(first, starts)) > wide
    # a least value that is there twice: within a block, or in two blocks that a string reaches over
    tie = padded[1:grams] == ahead[: grams - 1]
    tie[wide - 1 :: wide] = False
    back = padded[: grams - 1] == behind[1:grams]
    back[wide - 1 :: wide] = False
    over = before == after
    over[::wide] = False
    if tie.any() or back.any() or over.any():
        values, counts = np.unique(h, return_counts=True)
        double |= counts[np.searchsorted(values, key)] > 1
    return key, first, double


def _order_of_text():
    """What documents of one doc_id are ordered by."""
    return F.xxhash64(F.coalesce(F.col("data"), F.lit(b"")))


def _documents(docs: DataFrame, n: int) -> DataFrame:
    """block, doc_id, data, rest: the documents, dealt by doc_id; rest is a struct of what other columns they have."""
    others = [c for c in docs.columns if c not in ("text", "doc_id")]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("data"), rest.alias("rest"))


def _cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each run of equal values."""
    if not len(values):
        return []
    at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(at[:-1], at[1:], strict=True))


#: A key in a block: the key (its last bit: frequent), the block, how many spans have it there.
_KEY = np.dtype([("key", "<u8"), ("block", "<i4"), ("n", "<i4")])


def _shared_keys(docs: DataFrame, n: int, shards: int, frequent_bytes: int) -> DataFrame:
    """block, data: keys of the block's documents that may have equal strings, as unsigned 64-bit integers; the last bit: frequent.

    Those that occur in two spans or more, or in a span that may hold equal strings itself.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        blocks: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, block = np.concatenate(keys), np.concatenate(blocks)
            keys.clear(), blocks.clear()
            order = np.lexsort((block, key))
            key, block = key[order], block[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
            rows = np.empty(len(first), _KEY)
            rows["key"], rows["block"], rows["n"] = key[first], block[first], np.diff(np.append(first, len(key)))
            shard = _shard_of(rows["key"], shards)
            order = np.argsort(shard, kind="stable")
            rows, shard = rows[order], shard[order]
            cuts = _cuts(shard)
            return pa.RecordBatch.from_arrays([pa.array(shard[[a for a, _ in cuts]].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in cuts], pa.binary())], ["shard", "data"])

        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key, _, double = spans(text.as_py() or b"")
                key = np.concatenate([key, key[double]])
                keys.append(key)
                blocks.append(np.full(len(key), block, np.int32))
                held += len(key)
                if held >= FLUSH_KEYS:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list[bytes]) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(parts), _KEY)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            key = rows["key"]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = np.diff(np.append(first, len(key)))
            total = np.add.reduceat(rows["n"].astype(np.int64), first)
            frequent = np.repeat(total * (2 * LENGTH - GRAM) > frequent_bytes, several)
            shared = np.repeat(total > 1, several)
            key, block = (key | frequent.astype(np.uint64))[shared], rows["block"][shared]
            order = np.argsort(block, kind="stable")
            key, block = key[order], block[order]
            cuts = _cuts(block)
            return pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in cuts], pa.int32()), pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary())], ["block", "data"])

        at, parts = None, []
        for batch in batches:
            for shard, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and parts:
                    yield told(parts)
                    parts = []
                at = shard
                parts.append(data)
        if parts:
            yield told(parts)

    sent = _documents(docs, n).select("block", "data").mapInArrow(send, "shard int, data binary")
    return sent.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(reply, "block int, data binary")


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return ((key >> np.uint64(24)) % np.uint64(shards)).astype(np.int64)


#: Spans for shards, and, without a piece, runs of starts that a block removes itself.
_SPANS = "shard int, block int, doc bigint, nth int, start bigint, n bigint, key bigint, piece binary"


def _sent_spans(docs: DataFrame, n: int, shards: int, frequent_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shared, told = None, np.zeros(0, np.uint64), []
        last, nth = None, 0
        seen: set[bytes] = set()
        rows: list[tuple] = []
        held = 0
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _SPANS.split(", ")])
            rows.clear()
            return made

        for batch in batches:
            for block, kind, doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if block != at:
                    at, told, shared, last = block, [], np.zeros(0, np.uint64), None
                    seen.clear()
                if kind == 0:
                    told.append(np.frombuffer(value.as_py(), np.uint64))
                    continue
                nth = nth + 1 if last == (doc,) else 0
                last = (doc,)
                if told:
                    shared, told = np.unique(np.concatenate(told)), []
                    plain = shared & ~np.uint64(1)
                if not len(shared):
                    continue
                data = value.as_py() or b""
                key, first, double = spans(data)
                if not len(key):
                    continue
                place = np.minimum(np.searchsorted(plain, key), len(plain) - 1)
                ends = np.append(first[1:], len(data) - LENGTH + 1)
                mine = np.flatnonzero(plain[place] == key)
                some = [(key[mine], first[mine], ends[mine], double[mine])]
                frequent = (shared[place[mine]] & np.uint64(1)) > 0
                if frequent.any():
                    some = [tuple(x[~frequent] for x in some[0])]
                    for i in mine[frequent].tolist():
                        a, b = int(first[i]), int(ends[i])
                        k, f, d = spans(data[a : b + LENGTH - 1], FINE_GRAM)
                        some.append((~k & ~np.uint64(1), a + f, np.append(a + f[1:], b), d))
                for keys, firsts, until, doubles in some:
                    shard = _shard_of(keys, shards).tolist()
                    names = (keys | doubles.astype(np.uint64)).view(np.int64).tolist()
                    for s, k, a, b in zip(shard, names, firsts.tolist(), until.tolist(), strict=True):
                        piece = data[a : b + LENGTH - 1]
                        name = blake2b(piece, digest_size=16).digest()
                        if name in seen:
                            rows.append((-1, block, doc, nth, a, b - a, k, None))
                        else:
                            seen.add(name)
                            rows.append((s, block, doc, nth, a, b - a, k, piece))
                            held += len(piece)
                        held += 60
                if len(seen) > REMEMBERED:
                    seen.clear()
                if held > FLUSH_BYTES:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    told = _shared_keys(docs, n, shards, frequent_bytes).select("block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), "data")
    both = told.unionByName(_documents(docs, n).select("block", F.lit(1).alias("kind"), "doc_id", "data"))
    return both.repartition(n, "block").sortWithinPartitions("block", "kind", "doc_id", _order_of_text()).mapInArrow(run, _SPANS)


#: Where a span of a shard is from.
_FROM = np.dtype([("block", "<i4"), ("doc", "<i8"), ("null", "?"), ("nth", "<i4"), ("start", "<i8")])
#: A run of removed starts.
_RUNS = "block int, doc_id bigint, nth int, start bigint, n bigint"


class Shard:
    """A shard's distinct spans in the order of documents, in memory or on disk."""

    def __init__(self) -> None:
        self.names: set[bytes] = set()
        self.rows: list[tuple] = []
        self.pieces: list[bytes] = []
        self.keys: list[int] = []
        self.held = 0
        self.text: Disk | None = None

    def add(self, row: tuple, key: int, piece: bytes) -> bool:
        """Whether the span, (block, doc_id, nth, start), is new as far as is remembered; others are repeated."""
        name = blake2b(piece, digest_size=16).digest()
        if name in self.names:
            return False
        if len(self.names) < REMEMBERED:
            self.names.add(name)
        self.rows.append(row)
        self.pieces.append(piece)
        self.keys.append(key)
        self.held += len(piece)
        if self.held > SHARD_HELD:
            self._lay(range(len(self.rows)))
        return True

    def _lay(self, chosen) -> None:
        """Append chosen spans to the files."""
        if self.text is None:
            self.text, self.rows_laid, self.begins = Disk("<u2"), Disk(_FROM), Disk()
        pieces = [self.pieces[i] for i in chosen]
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        text = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.uint16) + np.uint16(2)
        ends = np.cumsum(sizes)
        text[ends - 1] = 1
        self.begins.append(self.text.n + ends - sizes)
        self.text.append(text)
        self.rows_laid.append(np.array([(b, doc or 0, doc is None, nth, start) for b, doc, nth, start in (self.rows[i] for i in chosen)], _FROM))
        self.rows, self.pieces, self.keys, self.held = [], [], [], 0

    def later_starts(self) -> Iterator[pa.RecordBatch]:
        """Runs of starts whose strings start earlier in the shard, as _RUNS."""
        if self.text is None:  # all are here: a span without another of its key has no equal string elsewhere
            plain = np.array(self.keys, np.int64) & ~np.int64(1)
            _, which, count = np.unique(plain, return_inverse=True, return_counts=True)
            chosen = np.flatnonzero((count[which] > 1) | (np.array(self.keys, np.int64) & 1 > 0)).tolist() if self.keys else []
        else:
            chosen = range(len(self.rows))
        if chosen:
            self._lay(chosen)
        self.names.clear()
        if self.text is None:
            return
        end = self.text.n
        self.text.append(np.zeros(1, np.uint16))
        self.begins.append(np.array([end]))
        text, begins, rows = self.text.mapped(), self.begins.mapped(), self.rows_laid.mapped()
        bits = PART.bit_length()
        later = Later((end >> bits) + 1)
        for places in _not_first(suffix_order(text, 258, LENGTH), begins):
            order = np.argsort(places >> bits, kind="stable")
            later.push((places >> bits)[order], places[order])
        for r in range((end >> bits) + 1):
            places = np.sort(later.all(r))
            if not len(places):
                continue
            owner = np.searchsorted(begins, places, side="right") - 1
            cut = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(owner) != 0)))
            mine = rows[owner[cut]]
            doc = pa.array(mine["doc"], mask=mine["null"])
            start = mine["start"] + places[cut] - begins[owner[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(mine["block"]), doc, pa.array(mine["nth"]), pa.array(start), pa.array(np.diff(np.append(cut, len(places))))], ["block", "doc_id", "nth", "start", "n"])


def _not_first(ordered: Iterator[tuple[np.ndarray, np.ndarray]], begins: np.ndarray) -> Iterator[np.ndarray]:
    """Of suffixes whose whole strings lie in their spans, all but the one of the smallest place among those that share ``LENGTH`` letters."""
    least = -1  # the smallest place so far of the group that the last block ended in
    for places, shared in ordered:
        group = np.cumsum(shared < LENGTH)
        ending = int(group[-1])
        owner = np.minimum(np.searchsorted(begins, places, side="right"), len(begins) - 1)
        inside = np.flatnonzero(places + LENGTH < begins[owner])
        places, group = places[inside], group[inside]
        if least >= 0:
            places, group = np.append(least, places), np.append(0, group)
        if ending or not len(places):
            least = least if not ending else -1
        if not len(places):
            continue
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        smallest = np.minimum.reduceat(places, first)
        if group[-1] == ending:
            least = int(smallest[-1])
        yield places[places != np.repeat(smallest, np.diff(np.append(first, len(group))))]


def _removed(sent: DataFrame, n: int) -> DataFrame:
    """Runs of removed starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, Shard()
        for batch in batches:
            again = []
            for s, block, doc, nth, start, count, key, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != at:
                    yield from shard.later_starts()
                    at, shard = s, Shard()
                if not shard.add((block, doc, nth, start), key, piece):
                    again.append((block, doc, nth, start, count))
            if again:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*again, strict=True), kinds, strict=True)], ["block", "doc_id", "nth", "start", "n"])
        yield from shard.later_starts()

    far = sent.filter("piece IS NOT NULL").repartition(n, "shard").sortWithinPartitions("shard", "doc", "nth", "start").mapInArrow(run, _RUNS)
    own = sent.filter("piece IS NULL").select("block", F.col("doc").alias("doc_id"), "nth", "start", "n")
    return far.unionByName(own)


def covered(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings at these runs of (start, number) cover."""
    out: list[list[int]] = []
    for start, n in sorted(runs):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


#: What deduplicated() returns of the remaining bytes.
_KEPT = {"bytes": lambda left: left, "text": lambda left: left.decode(errors="ignore"), "sha256": lambda left: sha256(left).hexdigest()}


def deduplicated(docs: DataFrame, kept: str = "bytes", frequent_bytes: int = FREQUENT_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, their SHA-256, or as text), rest (a struct of the other columns of docs)."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(n, min(1 << 30, -(-total // SHARD_BYTES)))
    sent = written(_sent_spans(docs.select("doc_id", "text"), n, shards, frequent_bytes), "spans")
    documents = _documents(docs, n)
    kind_of_kept, form = ("binary" if kept == "bytes" else "string"), _KEPT[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth = None, -1
        removed: dict[int, list[tuple[int, int]]] = {}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary() if kept == "bytes" else pa.string())

        for batch in batches:
            rows: list[tuple] = []
            places: list[int] = []
            held = 0

            def flush(batch=batch, rows=rows, places=places) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                made = pa.RecordBatch.from_arrays([*columns, batch.column(6).take(pa.array(places))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])
                rows.clear(), places.clear()
                return made

            numbers = [batch.column(c).to_pylist() for c in range(5)]
            for i, (doc, kind, of, start, count) in enumerate(zip(*numbers, strict=True)):
                if last != (doc,):
                    last, nth = (doc,), -1
                    removed.clear()
                if kind == 0:
                    removed.setdefault(of, []).append((start, count))
                    continue
                nth += 1
                data = batch.column(5)[i].as_py() or b""
                gone = covered(removed.get(nth, []))
                parts, to = [], 0
                for a, b in gone:
                    parts.append(data[to:a])
                    to = b
                parts.append(data[to:])
                left = b"".join(parts)
                rows.append((doc, len(data), len(data) - len(left), len(gone), form(left)))
                places.append(i)
                held += 200 if kept == "sha256" else len(left) + 200
                if held > BLOCK_BYTES:
                    yield flush()
                    held = 0
            if rows:
                yield flush()

    rest = dict(documents.dtypes)["rest"]
    hashes = [_order_of_text()] + ([F.xxhash64(F.to_json("rest"))] if rest != "string" else [])
    told = _removed(sent, n).select("block", "doc_id", F.lit(0).alias("kind"), "nth", "start", "n", F.lit(None).cast("binary").alias("data"), F.lit(None).cast(rest).alias("rest"))
    both = told.unionByName(documents.select("block", "doc_id", F.lit(1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n"), "data", "rest"))
    ordered = both.repartition(n, "block").sortWithinPartitions("block", "doc_id", "kind", *hashes)
    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept {kind_of_kept}, rest {rest}"
    return ordered.select("doc_id", "kind", "nth", "start", "n", "data", "rest").mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the remaining texts, all columns kept.

    A character that lost some of its bytes loses the rest. Documents of which nothing remains go; those that were empty stay.
    """
    found = deduplicated(docs, kept="text").filter("n_removed = 0 OR n_removed < n_bytes")
    of = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    of |= {c: F.col(f"rest.`{c}`") for c in docs.columns if c not in of}
    return found.select(*(of[c].cast(t).alias(c) for c, t in docs.dtypes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what whole texts of ``documents`` keep."""
    found = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kept="sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))
