"""Best-fit packing of documents into token sequences by bin completion.

Lengths are all that packing needs, and there are at most ``capacity`` of them. So the driver gets a histogram (one row for each
length, 2,048 at most, whatever the input) and completes bins on it by branch and bound: take the largest length left, enumerate the
undominated fillings around it in the order of their waste, and branch over them and over how many bins are filled so, from as many as the
counts allow down to one. Paths that leave the first branches least come first. A branch is cut when its waste so far exceeds what a solution of a bin less than the incumbent may have; best-fit
solutions of what is left are incumbents at every node. The enumeration is lazy and complete. The search ends at the lower bound, when it
has been through all branches, or after ``nodes`` nodes or ``STEPS`` times as many partial fillings, its only limits: then the best solution so
far is taken.

Executors then number the pieces of each length and look up their place in the solution. No task holds more than its range of pieces.

Null text is an empty document. Equal rows are packed each. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, raw, ship, written
from .tokens import encoder, vocabulary_path

CAPACITY = 2048
#: Nodes of the search over fillings: at a node for each step of a solution, enough for some tens of solutions of a hard histogram.
NODES = 3_000
#: Partial fillings that the enumeration may look at for each of these nodes, on the average.
STEPS = 200

Step = tuple[int, tuple[tuple[int, int], ...]]  # how many bins, their (length, copies)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: Martello and Toth's second bound over all thresholds."""
    lengths = np.array(sorted(counts, reverse=True), np.int64)
    number = np.array([counts[int(x)] for x in lengths], np.int64)
    if not len(lengths):
        return 0
    total = int((lengths * number).sum())
    best = -(-total // capacity)
    for k in {0, *(int(x) for x in lengths if 2 * x <= capacity)}:
        big = lengths > capacity - k
        half = (lengths > capacity / 2) & ~big
        small = (lengths >= k) & (2 * lengths <= capacity)
        free = int(number[half].sum()) * capacity - int((lengths * number)[half].sum())
        more = max(0, -(-(int((lengths * number)[small].sum()) - free) // capacity))
        best = max(best, int(number[big].sum() + number[half].sum()) + more)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Step]:
    """Best-fit decreasing over a histogram: bins that are alike are filled alike, all at once."""
    left: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}  # room -> contents -> bins
    rooms = 0  # a bit for each room that some bin has
    for length in sorted(counts, reverse=True):
        need = counts[length]
        while need:
            fitting = rooms >> length
            if not fitting:
                fit = capacity // length
                whole, rest = divmod(need, fit)
                for bins, copies in ((whole, fit), (1 if rest else 0, rest)):
                    if bins:
                        room = capacity - copies * length
                        held = left.setdefault(room, {})
                        held[((length, copies),)] = held.get(((length, copies),), 0) + bins
                        rooms |= 1 << room
                break
            at = length + (fitting & -fitting).bit_length() - 1
            held = left[at]
            contents, bins = held.popitem()
            fit = min(at // length, need)
            used = min(bins, need // fit)
            if used < bins:
                held[contents] = bins - used
            if not held:
                rooms &= ~(1 << at)
            new = (*contents, (length, fit))
            target = left.setdefault(at - fit * length, {})
            target[new] = target.get(new, 0) + used
            rooms |= 1 << (at - fit * length)
            need -= fit * used
    return [(bins, contents) for held in left.values() for contents, bins in held.items()]


class _Spent(Exception):
    """The search has looked at as many partial fillings as it may."""


def fillings(first: int, counts: dict[int, int], capacity: int, most: int, steps: Iterator[int] | None = None) -> Iterator[tuple[int, dict[int, int]]]:
    """The undominated fillings around one piece of length ``first``: (waste, copies of each length), least waste first, long pieces first.

    None wastes more than ``most``. With ``steps``, each partial filling takes one of them, and _Spent is raised when there are none. A filling is dominated if a piece that is left could take the place of one or several of its pieces that aren't longer together, or of
    nothing, and still fit. Sets of lengths are bits of whole numbers; what the k shortest lengths can add up to is such a set, so that the
    enumeration runs into no dead ends.
    """
    room = capacity - first
    free = {x: n - (x == first) for x, n in counts.items() if x <= room and n > (x == first)}
    lengths = sorted(free)
    every, reach = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        sums, left, step = reach[-1], min(free[x], room // x), 1
        while left:
            step = min(step, left)
            sums |= sums << (step * x) & every
            left, step = left - step, step * 2
        reach.append(sums)
    there = sum(1 << x for x in lengths)

    def dominated(one: int, several: int, left: int, waste: int) -> bool:
        """By sums of one of the pieces, and of two or more, and by the lengths that are left. Shorter pieces that are taken later change nothing."""
        longer, width = left >> 1 if waste else 0, 1  # sums that a piece of up to `waste` more is left for
        while width < waste:
            step = min(width, waste - width)
            longer |= longer >> step
            width += step
        return bool(one & longer or several & (longer | left))

    def adding_up(k: int, total: int, waste: int, one: int, several: int, left: int) -> Iterator[tuple[tuple[int, int], ...]]:
        """Fillings by the k shortest lengths of just ``total`` that aren't dominated beside those taken so far."""
        if steps is not None and next(steps, None) is None:
            raise _Spent
        if not total:
            if not left & ((1 << (waste + 1)) - 1):  # else one more piece fits
                yield ()
            return
        for i in range(min(k, bisect_right(lengths, total)) - 1, -1, -1):
            if not reach[i + 1] >> total & 1:
                return
            x, sums_of_one, sums_of_several, n = lengths[i], one, several, 0
            while n < min(free[x], total // x):
                n += 1
                sums_of_several |= (sums_of_several | sums_of_one) << x
                sums_of_one |= 1 << x
                after = left & ~(1 << x) if n == free[x] else left
                if dominated(sums_of_one, sums_of_several, after, waste):
                    if n < free[x] and not dominated(sums_of_one, sums_of_several, left & ~(1 << x), waste):
                        continue  # it may be right to use up the length
                    break
                if reach[i] >> (total - n * x) & 1:
                    for rest in adding_up(i, total - n * x, waste, sums_of_one, sums_of_several, after):
                        yield ((x, n), *rest)

    for waste in range(min(room, most) + 1):
        if reach[-1] >> (room - waste) & 1:
            for filling in adding_up(len(lengths), room - waste, waste, 0, 0, there):
                yield waste, dict(filling)


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Step]:
    """Few bins for a histogram of lengths: bin completion with best-fit incumbents."""
    counts = {int(x): int(n) for x, n in counts.items() if n > 0}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    bound = lower_bound(counts, capacity)
    size = lambda steps: sum(n for n, _ in steps)
    best = best_fit(counts, capacity)
    bins_best, total = size(best), sum(x * n for x, n in counts.items())

    def allowed(waste: int) -> int:
        """What a solution of one bin less than the incumbent may waste yet."""
        return (bins_best - 1) * capacity - total - waste

    def children(left: dict[int, int], waste: int) -> Iterator[tuple[int, dict[int, int], int]]:
        """(bins, what is in each, waste of each)."""
        first = max(left)
        for each, filling in fillings(first, left, capacity, allowed(waste), partial):
            use = {**filling, first: filling.get(first, 0) + 1}
            for times in range(min(left[x] // n for x, n in use.items()), 0, -1):
                if times * each <= allowed(waste):
                    yield times, use, each

    partial = iter(range(nodes * STEPS))
    spent, off, cut = 0, -1, True
    while cut and bins_best > bound and spent < nodes:
        # a search of limited discrepancy: the branches of a path may be `off` from the first ones in all
        off, cut = off + 1, False
        steps: list[Step] = []
        bins = 0
        stack = [(counts, 0, children(counts, 0), iter(range(off + 1)), off)]  # what is left, waste so far, branches, their numbers, how much may be off
        while stack and bins_best > bound and spent < nodes:
            left, waste, branches, numbers, may = stack[-1]
            nth = next(numbers, None)
            try:
                branch = None if nth is None else next(branches, None)
            except _Spent:
                return best
            cut |= nth is None
            if branch is None or allowed(waste) < 0:
                stack.pop()
                if steps:
                    bins -= steps.pop()[0]
                continue
            times, use, each = branch
            if times * each > allowed(waste):
                continue
            spent += 1
            steps.append((times, tuple(sorted(use.items(), reverse=True))))
            bins += times
            after = {x: n - times * use.get(x, 0) for x, n in left.items() if n > times * use.get(x, 0)}
            rest = best_fit(after, capacity)
            if bins + size(rest) < bins_best:
                best, bins_best = steps + rest, bins + size(rest)
            if after:
                so_far = waste + times * each
                stack.append((after, so_far, children(after, so_far), iter(range(may - nth + 1)), may - nth))
            else:
                bins -= steps.pop()[0]
    return best


def places(steps: list[Step], capacity: int = CAPACITY) -> np.ndarray:
    """length, rank of its first piece, bins' first number, copies in a bin, offset in it: one row for each length of each step."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for bins, contents in steps:
        offset = 0
        merged: dict[int, int] = {}
        for length, copies in contents:
            merged[length] = merged.get(length, 0) + copies
        for length, copies in merged.items():
            rows.append((length, used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids with end_id, cut into runs of ``capacity`` where they are longer."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        end = end_id.to_bytes(encode.width, "little")
        for batch in blocks(batches):
            which, piece, length, crc = [], [], [], []
            for row, text in enumerate(raw(batch.column(1))):
                ids = np.frombuffer(encode.ids(text) + end, encode.dtype).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    which.append(row)
                    piece.append(k)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            number = np.array(piece, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """cut(length, ...) with sequence_id and offset. Any other columns of cut are kept; equal rows are placed each.

    A column of cut named sequence_id, offset, _part or _place raises ValueError.
    """
    spark = cut.sparkSession
    ship(spark)
    kept = cut.columns
    if {"sequence_id", "offset", "_part", "_place"} & set(kept):
        raise ValueError("cut has columns that pack() adds")
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    keys = ["length", *(c for c in kept if c != "length")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))], [*kept, "_part", "_place"])
            at += n

    # ranges of (length, key): pieces of a length that is very common go to several tasks
    ranged = cut.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ranged = written(ranged.mapInArrow(number, f"{schema}, _part int, _place bigint"), "ranged")
    counts = {r["length"]: r["n"] for r in ranged.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each task
    whole = counts.pop(capacity, 0)
    table = places(complete_bins(counts, capacity, nodes), capacity)
    before, at = np.zeros(max(sizes, default=0) + 1, np.int64), 0
    for part in sorted(sizes):
        before[part] = at
        at += sizes[part]
    ordered = sorted({**counts, **({capacity: whole} if whole else {})}.items())
    lengths = np.array([x for x, _ in ordered], np.int64)
    firsts = np.cumsum([0, *(n for _, n in ordered)])[:-1].astype(np.int64)
    # pieces of full length have sequences of their own, after the others
    if whole:
        table = np.vstack([table, [[capacity, 0, sum(counts.values()), 1, 0]]]).astype(np.int64)
    starts = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(kept.index("length")).to_numpy()
            rank = before[batch.column(len(kept)).to_numpy()] + batch.column(len(kept) + 1).to_numpy()
            rank = rank - firsts[np.searchsorted(lengths, length)]
            row = table[np.searchsorted(starts, length * (1 << 44) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], [*kept, "sequence_id", "offset"])

    return ranged.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` in sequences of at most 2,048 tokens."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(written(pieces(docs, vocabulary_path()), "pieces"))  # else sampling for ranges would encode all texts twice
