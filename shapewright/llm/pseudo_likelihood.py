"""Language-model scores by masked pseudo-likelihood.

A window network predicts every word of a text from the ``SIDE`` words on both sides, the word itself left out: embeddings of the
neighbours, a tanh layer, a softmax over the ``HEAD`` most frequent slots and ``CLASSES`` classes of the others, and one over the ``EACH`` slots of the
word's class. A document's score is the sum of the conditional log-probabilities of its words.

Words are counted exactly, in numbers that grow with the input: a row for each distinct word (its 64-bit hash). The ``OWN`` most frequent words have
slots of their own; the others share the rest of the slots by hash, and a word's share of its slot is that of its count, so that all
words' probabilities sum to one. Classes are built by the slots' frequency. Inputs are slots, too. So the network has a fixed size.

Texts are encoded once, as blocks of word numbers with the block's distinct words. Blocks ask for their words' counts in packs by hash, and
get numbers back. The network is trained in rounds over all blocks: each task takes gradient steps (Adagrad, a rate for each embedding and
class) from the shared weights on runs of ``RUN`` words, others in each round, so that each word of the corpus is a target once. A step's runs
are from all over a block, and the words of a run share their neighbours. Weights are averaged by numbers of words, in a tree over tasks and in
a fixed order. The driver holds a row for each own word and slot.

Null and empty texts have no words: score 0, mean 0. Equal rows give equal rows. Other columns play no part. An empty table gives no
rows. Words that a model hasn't counted count half a time.
"""

from __future__ import annotations

import copy
import ctypes
import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, raw, ship, sole, unwritten, written

HEAD, CLASSES, EACH, OWN = 32, 65, 256, 8192
SLOTS = HEAD + CLASSES * EACH
SIDE, DIM, HIDDEN = 2, 16, 16
ROUNDS, BATCH, RATE, SEED = 2, 8192, 0.11, 5
#: Words of a step that stand together, so that they share neighbours.
RUN = 32
#: Rows of a softmax that are worked on at a time: they stay in a core's own cache, and products of up to 10^6 terms (224 * 17 * 256)
#: are made without copying what is multiplied.
ROWS = 224
#: The same for the first layer's products (768 * 80 * 16).
NEAR = 768
#: The first of the tables that are sums of squares.
SUMS = 7
#: Bytes of text in a block, and of keys for each shard of counts.
TEXT_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
#: Tasks whose weights are summed together, and numbers in a message.
GROUP, PART = 64, 1 << 16
_STRIPPED = b".,;:!?*&%$#|\"'()"


def _core(word: bytes) -> bytes:
    return word.lower().strip(_STRIPPED) or word


def _values(words: pa.Array) -> list[bytes]:
    """to_pylist() of an array without nulls, in less time."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """How many words each text has, the number of each word's core form, and these forms, in the order of their first words."""
    parts = [pa.array(text.split(), pa.binary()) for text in texts]
    words = pa.concat_arrays(parts).dictionary_encode()
    cores = pa.array(list(map(_core, _values(words.dictionary))), pa.binary()).dictionary_encode()
    return np.array([len(p) for p in parts], np.int32), cores.indices.to_numpy()[words.indices.to_numpy()], _values(cores.dictionary)


def slots_of(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Slots before they are sorted into classes: ``own`` are the keys, rising, that have the first ones."""
    out = len(own) + (keys % np.uint64(SLOTS - len(own))).astype(np.int64)
    if len(own):
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        mine = own[at] == keys
        out[mine] = at[mine]
    return out


class Model:
    """Weights, the own words' keys, and each slot's place in the classes and its count."""

    def __init__(self, own: np.ndarray, mass: np.ndarray):
        mass = mass + 0.5  # the share of words that weren't counted
        self.own, self.mass = own, mass
        #: slot -> place by falling count: the first HEAD by themselves, then EACH a class
        self.place = np.empty(SLOTS, np.int64)
        order = np.lexsort((np.arange(SLOTS), -mass))
        self.place[order] = np.arange(SLOTS)
        ranked = mass[order][HEAD:].reshape(CLASSES, EACH)
        of_class = ranked.sum(axis=1)
        top = np.append(mass[order][:HEAD], of_class)
        rng = np.random.default_rng(SEED)
        self.weights = [
            rng.normal(0, 0.3, (SLOTS + 1, DIM)).astype(np.float32),  # by place; the last is the edge of a text
            rng.normal(0, (2 * SIDE * DIM) ** -0.5, (2 * SIDE * DIM, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            np.zeros((HIDDEN, HEAD + CLASSES), np.float32),
            np.log(top / top.sum()).astype(np.float32),
            np.zeros((CLASSES, HIDDEN, EACH), np.float32),
            np.log(ranked / of_class[:, None]).astype(np.float32),
            np.zeros(SLOTS + 1, np.float32),  # sums of squares: of embeddings,
            np.zeros((CLASSES, 2), np.float32),  # of classes' softmax,
            np.zeros(4, np.float32),  # and of the other weights
        ]

    def _hidden(self, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embeddings of the places in ``span``; the first layer's weights, zero for a word itself; the layer for all but SIDE places at both ends."""
        e, w1, b1 = self.weights[:3]
        x, wide = e.take(span, axis=0), np.zeros((2 * SIDE + 1, DIM, HIDDEN), np.float32)
        wide[SIDE + _AROUND] = w1.reshape(-1, DIM, HIDDEN)
        h = np.empty((len(span) - 2 * SIDE, HIDDEN), np.float32)
        for rows, near in _near(x):
            np.matmul(near, wide.reshape(-1, HIDDEN), out=h[rows])
        h += b1
        return x, wide, np.tanh(h, out=h)

    @staticmethod
    def _by_class(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """An order by what the first softmax is over; that and numbers within classes in this order; (class, first, end) in it."""
        of = _CLASS.take(places)
        order = np.argsort(of, kind="stable")
        ends = np.cumsum(np.bincount(of, minlength=HEAD + CLASSES))[HEAD - 1 :].tolist()
        groups = [(c, a, b) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
        return order, of.take(order).astype(np.int64), _INSIDE.take(places.take(order)), groups

    def _parts(self, n: int, of: np.ndarray, inside: np.ndarray, groups: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """Both softmaxes of n sorted words, ROWS at a time: class or -1 for the first one, weights with constants, first, end, targets in the outputs laid flat."""
        wc, bc, ws, bs = self.weights[3:7]
        both = np.vstack([wc, bc])
        flat = _nth(n) * (HEAD + CLASSES) + of
        for a, b in _cut(0, n):
            yield -1, both, a, b, flat[a:b] - a * (HEAD + CLASSES)
        flat = _nth(n) * EACH + inside
        for c, first, end in groups:
            both = np.concatenate([ws[c], bs[c : c + 1]])
            for a, b in _cut(first, end):
                yield c, both, a, b, flat[a:b] - a * EACH

    def _gradients(self, h1: np.ndarray, sorted_by: tuple, lowered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exponentials' sums; gradients of the hidden layer, the first softmax and the groups' softmaxes."""
        n, groups = len(h1), sorted_by[2]
        totals, back = np.empty((2, n), np.float32), np.zeros((n, HIDDEN), np.float32)
        top, inner = np.zeros((HIDDEN + 1, HEAD + CLASSES), np.float32), _room(len(groups) * (HIDDEN + 1), EACH, "gradients").reshape(-1, HIDDEN + 1, EACH)
        of, k = -1, -1
        for c, both, a, b, targets in self._parts(n, *sorted_by):
            some = h1[a:b]
            p, total, _ = _exp(some, both, lowered)
            totals[min(c, 0) + 1, a:b] = total
            p.reshape(-1)[targets] -= total  # (p - total * target) / total is the gradient
            share = (1 / total)[:, None]
            back[a:b] += (p @ both[:HIDDEN].T) * share
            if c < 0:
                top += (some * share).T @ p
            elif c == of:
                inner[k] += (some * share).T @ p
            else:
                of, k = c, k + 1
                np.matmul((some * share).T, p, out=inner[k])
        totals[1, : groups[0][1] if groups else n] = 1
        return totals, back, top, inner

    def learn(self, windows: np.ndarray, places: np.ndarray) -> None:
        """A gradient step towards the words at ``places`` between the slots in ``windows``."""
        self.learn_at(*_apart(windows, places))

    def learn_at(self, laid: np.ndarray, at: np.ndarray) -> None:
        """A gradient step towards the words at ``at``, rising, of ``laid`` texts. A word's embedding is read and moved once for all its neighbours."""
        span, at = laid[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0]
        order, of, inside, groups = self._by_class(span.take(at + SIDE))
        e, w1, b1, wc, bc, ws, bs, seen_e, seen_s, seen = self.weights
        x, wide, h = self._hidden(span)
        at = at.take(order)
        h1 = _with_one(h.take(at, axis=0))
        with np.errstate(all="ignore"):
            totals, back, top, inner = self._gradients(h1, (of, inside, groups), False)
            if not _kept(totals):
                _, back, top, inner = self._gradients(h1, (of, inside, groups), True)
        if groups:
            own = slice(None) if len(groups) == CLASSES else np.array([c for c, _, _ in groups])
            gw, gb = inner[:, :HIDDEN], inner[:, HIDDEN]
            seen_s[own] += np.stack([np.einsum("cij,cij->c", gw, gw) / (HIDDEN * EACH), np.einsum("cj,cj->c", gb, gb) / EACH], axis=1)
            rate = RATE / np.sqrt(seen_s[own] + 1e-12)
            gw *= rate[:, :1, None]
            gb *= rate[:, 1:]
            ws[own] -= gw
            bs[own] -= gb
        back *= 1 - np.square(h1[:, :HIDDEN])
        asked = np.zeros((len(span) + 2 * SIDE, HIDDEN), np.float32)
        of_words = asked[2 * SIDE : 2 * SIDE + len(h)]
        of_words[at] = back
        g1, gx = np.zeros((len(wide) * DIM, HIDDEN), np.float32), np.empty_like(x)
        for rows, near in _near(x):
            g1 += near.T @ of_words[rows]
        g1 = g1.reshape(wide.shape)[SIDE + _AROUND].reshape(w1.shape)
        turned = np.ascontiguousarray(wide[::-1].swapaxes(1, 2)).reshape(-1, DIM)
        for rows, near in _near(asked):
            np.matmul(near, turned, out=gx[rows])
        for k, (w, g) in enumerate(((w1, g1), (b1, _ones(len(back)) @ back), (wc, top[:HIDDEN]), (bc, top[HIDDEN]))):
            seen[k] += np.vdot(g, g) / g.size
            w -= g * np.float32(RATE / np.sqrt(seen[k] + 1e-12))
        flat = span.astype(np.uint16)  # SLOTS fit; such numbers are sorted by their digits
        order = np.argsort(flat, kind="stable")
        rows = flat.take(order)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        rows = rows.take(first)
        g = np.add.reduceat(gx.take(order, axis=0), first, axis=0)
        squares = seen_e.take(rows) + np.einsum("ij,ij->i", g, g) / DIM
        seen_e[rows] = squares
        g *= (RATE / np.sqrt(squares + 1e-12))[:, None]
        e[rows] = e.take(rows, axis=0) - g

    def log_probability(self, windows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of slots at ``places`` between the slots in ``windows``."""
        return self.log_probability_at(*_apart(windows, places))

    def log_probability_at(self, laid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the slots at ``at``, rising, of ``laid`` texts."""
        span, at = laid[at[0] - SIDE : at[-1] + SIDE + 1], at - at[0]
        order, *sorted_by = self._by_class(span.take(at + SIDE))
        h1 = _with_one(self._hidden(span)[2].take(at.take(order), axis=0))

        def found(lowered: bool) -> tuple[np.ndarray, np.ndarray]:
            own, totals = np.zeros(len(h1), np.float32), np.ones((2, len(h1)), np.float32)
            for c, both, a, b, targets in self._parts(len(h1), *sorted_by):
                _, totals[min(c, 0) + 1, a:b], z = _exp(h1[a:b], both, lowered, targets)
                own[a:b] += z
            return own, totals

        with np.errstate(all="ignore"):
            own, totals = found(False)
            if not _kept(totals):
                own, totals = found(True)
        out = np.empty(len(own), np.float64)
        out[order] = own - np.log(totals).sum(axis=0)
        return out

    def share(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-probabilities of words in their slots: all the counted ones' and the others' half sum to one."""
        return np.log(np.maximum(counts, 0.5) / self.mass[slots])


_AROUND = np.array([k for k in range(-SIDE, SIDE + 1) if k])
#: Each place's output of the first softmax and, past the HEAD, its number in its class.
_CLASS = np.minimum(np.arange(SLOTS), HEAD + (np.arange(SLOTS) - HEAD) // EACH).astype(np.uint8)
_INSIDE = ((np.arange(SLOTS) - HEAD) % EACH).astype(np.int64)
_rooms: dict[tuple[int, str], np.ndarray] = {}
_one, _counting = np.ones(BATCH, np.float32), np.arange(BATCH)


def _near(x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Each row of x but SIDE ones at both ends with its SIDE neighbours before and after as one row, without copying: which rows, and these."""
    wide, n = 2 * SIDE + 1, len(x) - 2 * SIDE
    for lo in range(0, n, NEAR * wide):
        hi = min(n, lo + NEAR * wide)
        for r in range(lo, min(lo + wide, hi)):
            some = -(-(hi - r) // wide)
            yield slice(r, hi, wide), x[r : r + some * wide].reshape(some, -1)


def _cut(first: int, end: int) -> Iterator[tuple[int, int]]:
    """Parts of at most ROWS rows, nearly equal."""
    parts = -(-(end - first) // ROWS)
    cuts = [first + (end - first) * k // parts for k in range(parts + 1)]
    return zip(cuts, cuts[1:], strict=False)


def _room(rows: int, wide: int, use: str = "") -> np.ndarray:
    """An array that is used again and again: new large ones cost more than what is done in them."""
    if (wide, use) not in _rooms or len(_rooms[wide, use]) < rows:
        _rooms[wide, use] = np.empty((max(rows, ROWS), wide), np.float32)
    return _rooms[wide, use][:rows]


def _apart(windows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows and the words between them laid out one after the other, and where these words are."""
    laid = np.insert(windows, [SIDE], np.reshape(places, (-1, 1)), axis=1).reshape(-1)
    return laid, SIDE + (2 * SIDE + 1) * np.arange(len(places))


def _with_one(h: np.ndarray) -> np.ndarray:
    """h and a column of ones, which weights' last row, the constants, is multiplied with."""
    out = np.ones((len(h), h.shape[1] + 1), np.float32)
    out[:, :-1] = h
    return out


def _exp(h1: np.ndarray, w: np.ndarray, lowered: bool, targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """exp(z) for z = h1 @ w, lowered by its rows' maxima or not; its rows' sums; z at the ``targets`` in its flat form."""
    q = np.matmul(h1, w, out=_room(len(h1), w.shape[1]))
    if lowered:
        q -= q.max(axis=1)[:, None]
    z = None if targets is None else q.reshape(-1)[targets]
    np.exp(q, out=q)
    return q, q @ _ones(w.shape[1]), z


def _kept(totals: np.ndarray) -> bool:
    """Whether exponentials that weren't lowered kept within the numbers' range."""
    return bool(1e-30 < totals.min() and totals.max() < 1e30)


def _nth(n: int) -> np.ndarray:
    return _counting[:n] if n <= len(_counting) else np.arange(n)


def _ones(n: int) -> np.ndarray:
    return _one[:n] if n <= len(_one) else np.ones(n, np.float32)


def _settled() -> None:
    """Let numpy's matrix products use this task's core alone, and keep freed memory for the next step, where the libraries can be told.

    Results don't change; a step takes half the time, as getting the same megabytes anew costs more than what is done in them.
    """
    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 64 << 20)  # from which size on memory is mapped
        libc.mallopt(-1, 64 << 20)  # how much free memory is kept


def _places(n: np.ndarray) -> np.ndarray:
    """The places of words of texts of n words each, with edges around every text."""
    begins = SIDE + np.cumsum(n + SIDE) - (n + SIDE)
    return np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _steps(laid: np.ndarray, at: np.ndarray, turn: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Round ``turn``'s steps over the words ``at`` of ``laid`` texts: at most BATCH words, as runs of RUN from all over the texts, and their neighbours.

    All steps of all rounds together have each word once.
    """
    first = np.arange(0, len(at), RUN)
    end = np.minimum(first + RUN, len(at))
    steps = rounds * -(-len(first) // (rounds * (BATCH // RUN)))
    for step in range(turn, min(steps, len(first)), rounds):
        a, b = first[step::steps], end[step::steps]
        begin, wide = at[a] - SIDE, at[b - 1] - at[a] + 2 * SIDE + 1
        moved = begin - (np.cumsum(wide) - wide)  # what a run's places are lowered by
        n = b - a
        words = at[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        yield laid[np.repeat(moved, wide) + np.arange(wide.sum())], words - np.repeat(moved, n)


def encoded(docs: DataFrame) -> DataFrame:
    """Blocks of documents, written: block, ids (doc_ids), sizes (numbers of words), keys and counts of distinct words, data (which word each is)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, limit=TEXT_BYTES):
            sizes, data, cores = _numbered(raw(batch.column(1)))
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, cores), np.uint64, len(cores))
            n = np.bincount(data, minlength=len(keys))
            order = np.argsort(-n, kind="stable")  # small numbers for frequent words
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order))
            data = number[data].astype("<u2" if len(keys) <= 1 << 16 else "<u4")
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            columns = [pa.array([block]), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, keys[order], n[order].astype("<u4"), data))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "sizes", "keys", "counts", "data"])
            block += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, f"block bigint, ids array<{kind}>, sizes binary, keys binary, counts binary, data binary"), "encoded")


def counted(blocks_of: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Counts of all words of encoded() blocks, written: kind 0: a shard's counts for a block's keys, in the block's order; kind 1: keys and counts.

    With ``other``, counts are those of an earlier counted(), and the blocks only ask.
    """
    n, told = partitions(blocks_of.sparkSession), other is not None
    shards = _shards(blocks_of)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u4")
                for shard, at in _dealt(keys, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block]), pa.array([keys[at].tobytes()], pa.binary()), pa.array([counts[at].astype("<i8").tobytes()], pa.binary())], ["shard", "block", "keys", "counts"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<i8")
                for shard, at in _dealt(keys, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([-1]), pa.array([keys[at].tobytes()], pa.binary()), pa.array([counts[at].tobytes()], pa.binary())], ["shard", "block", "keys", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            keys = [np.frombuffer(k, np.uint64) for _, k, _ in held]
            counts = [np.frombuffer(c, "<i8") for _, _, c in held]
            of = np.repeat([b for b, _, _ in held], [len(k) for k in keys])
            every, which = np.unique(np.concatenate(keys), return_inverse=True)
            counting = of < 0 if told else np.ones(len(of), bool)
            total = np.bincount(which[counting], np.concatenate(counts)[counting], len(every))
            ends = np.cumsum([len(k) for k in keys]).tolist()
            for (b, k, _), end in zip(held, ends, strict=True):
                if b >= 0:
                    yield row(0, b, at, b"", total[which[end - len(k) // 8 : end]])
            if not told:
                yield row(1, -1, at, every.tobytes(), total)

        def row(kind: int, block: int, shard: int, keys: bytes, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block]), pa.array([shard], pa.int32()), pa.array([keys], pa.binary()), pa.array([total.astype("<i8" if kind else "<f4").tobytes()], pa.binary())], ["kind", "block", "shard", "keys", "counts"])

        for batch in batches:
            for shard, block, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    yield from close()
                    at, held = shard, []
                held.append((block, keys, counts))
        yield from close()

    schema = "shard int, block bigint, keys binary, counts binary"
    asked = blocks_of.select("block", "keys", "counts").mapInArrow(sent, schema)
    if other is not None:
        asked = asked.unionByName(other.filter("kind = 1").select("keys", "counts").mapInArrow(packs, schema))
    return written(asked.repartition(n, "shard").sortWithinPartitions("shard", "block").mapInArrow(summed, "kind int, block bigint, shard int, keys binary, counts binary"), "counts")


def _shards(blocks_of: DataFrame) -> int:
    """Shards of counts: by the bytes of what blocks ask."""
    total = blocks_of.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    return max(partitions(blocks_of.sparkSession), -(-total * 3 // 2 // SHARD_BYTES))


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards of keys, rising, and which keys each has."""
    shard = ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(shard[order]) != 0, True)) + 1 if len(keys) else []
    a = 0
    for b in ends:
        yield int(shard[order[a]]), order[a:b]
        a = b


def blank(counts: DataFrame) -> Model:
    """The model of counted(), before it has learnt."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, n = np.frombuffer(keys, np.int64), np.frombuffer(n, "<i8")
                some = np.lexsort((keys.view(np.uint64), -n))[:OWN]
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some])], ["key", "n"])

    words = counts.filter("kind = 1").select("keys", "counts")
    first = words.mapInArrow(most, "key bigint, n bigint").orderBy(F.desc("n"), "key").limit(OWN).collect()
    own = np.sort(np.array([r["key"] for r in first], np.int64).view(np.uint64))

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += np.bincount(slots_of(np.frombuffer(keys, np.uint64), own), np.frombuffer(n, "<i8"), SLOTS).astype(np.int64)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["slot", "n"])

    mass = np.zeros(SLOTS)
    for r in words.mapInArrow(masses, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        mass[r["slot"]] = r["n"]
    return Model(own, mass)


def looked_up(blocks_of: DataFrame, counts: DataFrame) -> DataFrame:
    """encoded() with the counts of each block's words in ``counts`` (4 bytes each), written."""
    n = partitions(blocks_of.sparkSession)
    ids = dict(blocks_of.dtypes)["ids"]
    nothing = F.lit(None)
    mine = blocks_of.select("block", F.lit(1).alias("kind"), F.lit(0).alias("shard"), "ids", "sizes", "keys", nothing.cast("binary").alias("counts"), "data")
    told = counts.filter("kind = 0").select("block", F.lit(0).alias("kind"), "shard", nothing.cast(ids).alias("ids"), nothing.cast("binary").alias("sizes"), nothing.cast("binary").alias("keys"), "counts", nothing.cast("binary").alias("data"))
    shards = _shards(blocks_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for batch in batches:
            for i, (block, kind, shard, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 6)), strict=True)):
                if block != at:
                    at, parts = block, []
                if kind == 0:
                    parts.append((shard, np.frombuffer(counts, "<f4")))
                    continue
                keys = np.frombuffer(batch.column(5)[i].as_py(), np.uint64)
                order = np.argsort(((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64), kind="stable")
                found = np.zeros(len(keys), "<f4")
                found[order] = np.concatenate([np.zeros(0, "<f4"), *(p for _, p in parts)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (3, 4, 5)), pa.array([found.tobytes()], pa.binary()), batch.column(7).slice(i, 1)], ["ids", "sizes", "keys", "counts", "data"])

    both = told.unionByName(mine).repartition(n, "block").sortWithinPartitions("block", "kind", "shard")
    return written(both.mapInArrow(run, f"ids {ids}, sizes binary, keys binary, counts binary, data binary"), "known")


def _read(batch: pa.RecordBatch, model: Model) -> Iterator[tuple]:
    """For each block: doc_ids, places of slots with edges between texts, where words are, numbers of words, which word each is, words' shares."""
    for i in range(batch.num_rows):
        ids = batch.column(0).slice(i, 1).flatten()
        sizes, keys, counts, data = (batch.column(c)[i].as_py() for c in range(1, 5))
        keys = np.frombuffer(keys, np.uint64)
        slots = slots_of(keys, model.own)
        n = np.frombuffer(sizes, np.int32).astype(np.int64)
        which = np.frombuffer(data, "<u2" if len(keys) <= 1 << 16 else "<u4")
        at = _places(n)
        laid = np.full(SIDE + int((n + SIDE).sum()), SLOTS, np.int32)
        laid[at] = model.place[slots].astype(np.int32)[which]
        yield ids, laid, at, n, which, model.share(slots, np.frombuffer(counts, "<f4"))


def trained(docs: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` rounds over docs(doc_id, text); it knows where its words' counts are."""
    there = encoded(docs)
    counts = counted(there)
    model = learned(looked_up(there, counts), blank(counts), rounds)
    model.table = counts.inputFiles()
    return model


def _message(moved: list[np.ndarray]) -> list[bytes]:
    """What tables have learnt, in parts. Half a number's bytes are enough for weights, which move little; sums of squares grow, and travel whole."""
    flat = [m.reshape(-1) for m in moved]
    kinds = ((np.clip(np.concatenate(flat[:SUMS]), -6e4, 6e4), np.float16), (np.concatenate(flat[SUMS:]), np.float32))
    return [some[a : a + PART].astype(kind).tobytes() for some, kind in kinds for a in range(0, len(some), PART)]


def _halved(tables: list[np.ndarray]) -> int:
    """Parts of a message whose numbers are halves."""
    return -(-sum(w.size for w in tables[:SUMS]) // PART)


def learned(known: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` rounds over looked_up()."""
    spark = known.sparkSession
    schema = "part int, task bigint, n bigint, data binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # about 7 MB, whatever the input

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            _settled()
            own = copy.copy(sent.value)  # other tasks of this worker begin with the shared weights, too
            own.weights = [w.copy() for w in own.weights]
            steps = 0
            for batch in batches:
                for _, laid, at, *_ in _read(batch, own):
                    for near, mine in _steps(laid, at, turn, rounds):
                        own.learn_at(near, mine)
                        steps += len(mine)
            if steps:
                parts = _message([w - s for w, s in zip(own.weights, sent.value.weights, strict=True)])
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), task)), pa.array(np.full(len(parts), steps)), pa.array(parts, pa.binary())], ["part", "task", "n", "data"])

        halved = _halved(model.weights)

        def added(divide: bool):
            """Sums of messages that stand together, times their numbers of words; or their mean."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                key, n, values = None, 0, None

                def out() -> pa.RecordBatch:
                    data = (values / n).astype(np.float32) if divide else values
                    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([n]), pa.array([data.tobytes()], pa.binary())], ["part", "task", "n", "data"])

                for batch in batches:
                    for part, task, some, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        new = (part, -1 if divide else task // GROUP)
                        if new != key:
                            if key is not None:
                                yield out()
                            key, n, values = new, 0, 0.0
                        form = "<f8" if divide else "<f2" if part < halved else "<f4"
                        values = values + np.frombuffer(data, form).astype(np.float64) * (1 if divide else some)
                        n += some
                if key is not None:
                    yield out()

            return run

        n = partitions(spark)
        near = known.mapInArrow(run, schema).repartition(n, "part", F.expr(f"task div {GROUP}")).sortWithinPartitions("part", "task").mapInArrow(added(False), schema)
        whole = near.repartition(n, "part").sortWithinPartitions("part", "task").mapInArrow(added(True), schema)
        rows = sorted((r["part"], bytes(r["data"])) for r in whole.collect())  # the weights, once
        if not rows:
            return model
        moved, at = np.concatenate([np.frombuffer(d, np.float32) for _, d in rows]), 0
        model = copy.copy(model)
        for i, w in enumerate(model.weights):
            model.weights[i] = w + moved[at : at + w.size].reshape(w.shape)
            at += w.size
        for i in range(SUMS, len(model.weights)):
            model.weights[i] = np.maximum(model.weights[i], 0)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, score (summed log-probabilities) and mean_score, by a trained() model."""
    there = encoded(docs)
    counts = docs.sparkSession.read.schema("kind int, block bigint, shard int, keys binary, counts binary").parquet(*model.table)
    return scores(looked_up(there, counted(there, counts)), model)


def scores(known: DataFrame, model: Model) -> DataFrame:
    """scored() of looked_up()."""
    spark = known.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = known.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settled()
        for batch in batches:
            for ids, laid, at, n, which, share in _read(batch, sent.value):
                values = share[which].astype(np.float64)
                for lo in range(0, len(at), 4 * BATCH):
                    mine = at[lo : lo + 4 * BATCH]
                    values[lo : lo + len(mine)] += sent.value.log_probability_at(laid, mine)
                sums = np.concatenate([[0.0], np.cumsum(values)])
                ends = np.cumsum(n)
                score = np.minimum(0, sums[ends] - sums[ends - n])
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(score), pa.array(score / np.maximum(1, n))], ["doc_id", "n_words", "score", "mean_score"])

    return known.mapInArrow(run, f"doc_id {kind}, n_words bigint, score double, mean_score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: pseudo-log-likelihood of all ``documents`` under a model of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    there = encoded(docs)
    counts = counted(there)
    known = looked_up(there, counts)
    unwritten(there)
    model = blank(counts)
    unwritten(counts)
    return scores(known, learned(known, model))
