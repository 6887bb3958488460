"""Order of suffixes and their common prefixes by induced sorting in external memory.

Suffixes are S or L by whether they are smaller or larger than the next one. The leftmost S suffixes (half of all at most) are named by
their substrings; the names are a shorter text, whose suffixes are ordered in the same way; from their order a pass upwards over the
letters induces the L suffixes, and a pass downwards the S suffixes. What a pass induces waits in a priority queue by letter as a tuple: a
place and how many letters it shares with the tuple before it of the same letter, which is one more than the least shared length among
the inducers from one's to the other's. Names' order passes shared numbers of names up; letters after them are compared.

The queue keeps tuples by ranges of letters. No letter of a range can induce another of it, so a range is drained at once, sorted by letter;
a letter that follows itself is a range by itself and drained in waves.

Texts, what passes give, and what exceeds ``HELD`` bytes of queued tuples are files in the executor's spill folder, read ``PART`` numbers at a
time, texts by mapping them. They are a task's own and are made again with it. Memory doesn't grow with the text but for a few numbers
for each different letter.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of tuples that a queue holds before they go to disk.
HELD = 24 << 20
#: Numbers that a step works on.
PART = 1 << 17
#: A text of at most so many names is ordered in memory.
BASE = 1 << 19
#: Shared lengths are counted up to this; tuples are place * 256 + shared length.
_MOST = 255

Block = tuple[np.ndarray, np.ndarray]  # places and shared lengths


class Disk:
    """Numbers in an unnamed file, appended and read by slices."""

    def __init__(self, dtype="<i8") -> None:
        self.file = tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None)
        self.dtype, self.n = np.dtype(dtype), 0

    def append(self, values: np.ndarray) -> None:
        self.file.seek(self.n * self.dtype.itemsize)
        self.file.write(values.astype(self.dtype, copy=False).tobytes())
        self.n += len(values)

    def read(self, lo: int, hi: int) -> np.ndarray:
        self.file.seek(lo * self.dtype.itemsize)
        return np.frombuffer(self.file.read((hi - lo) * self.dtype.itemsize), self.dtype)

    def blocks(self) -> Iterator[np.ndarray]:
        for a in range(0, self.n, PART):
            yield self.read(a, min(self.n, a + PART))

    def mapped(self) -> np.ndarray:
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,)).view(np.ndarray) if self.n else np.zeros(0, self.dtype)


class Later:
    """A priority queue over ranges: what is pushed comes out by range, and in a range in the order it came."""

    def __init__(self, ranges: int) -> None:
        self.parts: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in range(ranges)]
        self.file: Disk | None = None
        self.held = 0

    def push(self, which: np.ndarray, values: np.ndarray) -> None:
        """Queue values for ranges; those of one range stand together."""
        if not len(values):
            return
        cuts = np.flatnonzero(which[1:] != which[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            self.parts[which[a]].append(values[a:b].copy())
        self.held += values.nbytes
        if self.held > HELD:
            self.file = self.file or Disk()
            for spilled, parts in zip(self.spilled, self.parts, strict=True):
                if parts:
                    first = self.file.n
                    for p in parts:
                        self.file.append(p)
                    spilled.append((first, self.file.n))
                    parts.clear()
            self.held = 0

    def take(self, r: int) -> Iterator[np.ndarray]:
        """What range r has now, a part at a time."""
        spilled, parts = self.spilled[r], self.parts[r]
        self.spilled[r], self.parts[r] = [], []
        self.held -= sum(p.nbytes for p in parts)
        for lo, hi in spilled:
            for a in range(lo, hi, PART):
                yield self.file.read(a, min(hi, a + PART))
        if parts:
            whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
            for a in range(0, len(whole), PART):
                yield whole[a : a + PART]

    def all(self, r: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.take(r)])


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] for each pair, both ends included."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << k) + 1])
    return out


def _split(tuples: np.ndarray) -> Block:
    return tuples >> 8, tuples & _MOST


class _Letters:
    """What a text says of its letters, and the ranges for both passes."""

    def __init__(self, text: np.ndarray, m: int):
        counts, twice = np.zeros(m, np.int64), np.zeros(m, bool)
        below, above = np.full(m, -1), np.full(m, m)
        for a in range(0, len(text), PART):
            t = text[a : a + PART + 1].astype(np.int64)
            counts += np.bincount(t[:PART], minlength=m)
            u, v = t[:-1], t[1:]
            np.maximum.at(below, u[u > v], v[u > v])
            np.minimum.at(above, u[u < v], v[u < v])
            twice[u[u == v]] = True
        self.twice = twice
        #: number of the range of each letter, and the first letter of each range and m
        self.up, self.up_starts = _ranges(below, twice, counts)
        down, starts = _ranges(m - 1 - above[::-1], twice[::-1], counts[::-1])
        self.down, self.down_starts = down[::-1].copy(), [m - s for s in starts]  # range i: letters from down_starts[i + 1] to before down_starts[i]


def _ranges(before: np.ndarray, twice: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Runs of letters that don't induce each other and have ``PART`` suffixes at most, or a letter by itself."""
    starts, held = [0], 0
    alone = True
    for c, (b, t, n) in enumerate(zip(before.tolist(), twice.tolist(), counts.tolist(), strict=True)):
        if c and (t or alone or b >= starts[-1] or held + n > PART):
            starts.append(c)
            held = 0
        alone, held = t, held + n
    number = np.zeros(len(before), np.int32)
    number[starts[1:]] = 1
    return np.cumsum(number), [*starts, len(before)]


class _Deal:
    """Gives what inducers induce to a queue, with the least shared length since each letter was given something."""

    def __init__(self, text: np.ndarray, m: int, number: np.ndarray, ranges: int):
        self.text, self.number, self.queue = text, number, Later(ranges)
        self.least = np.full(m, -1, np.int16)  # so that the first of a letter shares nothing

    def give(self, places: np.ndarray, shared: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Queue the suffixes one to the left of inducers in order, where ``wanted`` (letters, which inducers) holds."""
        if not len(places):
            return
        at = np.flatnonzero(places > 0)
        letters = self.text[places[at] - 1]
        fit = wanted(letters, at)
        at, letters = at[fit], letters[fit]
        lowest = shared.min()
        if not len(at):
            np.minimum(self.least, lowest, out=self.least)
            return
        order = np.argsort(letters, kind="stable")
        at, letters = at[order], letters[order]
        first = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]))
        lo = np.append(0, at[:-1] + 1)
        lo[first] = 0
        given = letters[first]
        tail = at[np.append(first[1:], len(at)) - 1] + 1
        inside = np.flatnonzero(tail < len(places))
        least = _least(shared, np.append(lo, tail[inside]), np.append(at, np.full(len(inside), len(places) - 1))).astype(np.int16)
        own = least[: len(at)]
        own[first] = np.minimum(own[first], self.least[given])
        np.minimum(self.least, lowest, out=self.least)
        self.least[given] = _MOST
        self.least[given[inside]] = least[len(at) :]
        self.queue.push(self.number[letters], (places[at] - 1) << 8 | np.minimum(own + 1, _MOST))


def _run(text: np.ndarray, place: int) -> int:
    """How often the letter at a place is repeated from there on."""
    near = text[place : place + _MOST]
    other = np.flatnonzero(near != near[0])
    return int(other[0]) if len(other) else len(near)


def _all_waves(text: np.ndarray, part: np.ndarray, c: int, wave: int) -> Iterator[np.ndarray]:
    """A wave and all that it leads to in the runs of letter c, some waves at a time."""
    held, n = [], 0
    while len(part):
        held.append(part)
        n += len(part)
        if n > PART:
            yield np.concatenate(held)
            held, n = [], 0
        wave += 1
        places, shared = _split(part)
        at = np.flatnonzero(places > 0)
        at = at[text[places[at] - 1] == c]
        if wave > _MOST:  # these share more letters than are counted
            own = np.full(len(at), _MOST)
        elif len(at) == len(places):
            own = np.minimum(shared + 1, _MOST)
        else:
            own = np.minimum(_least(shared, np.append(0, at[:-1] + 1), at) + 1, _MOST)
        own[:1] = min(wave, _MOST)
        part = (places[at] - 1) << 8 | own
    if held:
        yield np.concatenate(held)


def _waves(text: np.ndarray, deal: _Deal, r: int, c: int, out: Disk, upwards: bool) -> int | None:
    """Drain the queue of one letter, which may feed itself; the last place that came."""
    last, wave = None, 0
    with_own = (lambda x, at: x >= c) if upwards else (lambda x, at: x <= c)
    without = (lambda x, at: x > c) if upwards else (lambda x, at: x < c)
    while True:
        parts = deal.queue.take(r)
        first = next(parts, None)
        if first is None:
            return last
        if len(first) <= PART // 4 or wave > _MOST:  # a part may be followed by others, and these come first in the next wave
            rest = next(parts, None)
            if rest is None:
                for part in _all_waves(text, first, c, wave):
                    out.append(part)
                    deal.give(*_split(part), without)
                    last = int(part[-1] >> 8)
                return last
            several = (p for some in ((first, rest), parts) for p in some)
        else:
            several = (p for some in ((first,), parts) for p in some)
        for part in several:
            out.append(part)
            last = int(part[-1] >> 8)
            deal.give(*_split(part), with_own)
        wave += 1


def _induce(text: np.ndarray, m: int, letters: _Letters, seeds: Later) -> Disk:
    """All suffixes in falling order, each with what it shares with the one before, from the leftmost S suffixes.

    Seeds wait by the ranges upwards, in order. If they are in the order of their first letters only, what comes out is in the order of
    their substrings.
    """
    up = Disk()
    starts = letters.up_starts
    n_large = np.zeros(m + 1, np.int64)
    deal = _Deal(text, m, letters.up, len(starts) - 1)
    for r in range(len(starts) - 1):
        if starts[r + 1] - starts[r] == 1:
            c, was = starts[r], up.n
            last = _waves(text, deal, r, c, up, True)
            n_large[c] = up.n - was
            for part in seeds.take(r):
                places, shared = _split(part)
                shared = shared.copy()
                if last is None or last >= 0:
                    shared[0] = 0 if last is None else min(_run(text, last), _run(text, int(places[0])), _MOST)
                    last = -1
                deal.give(places, shared, lambda x, at, c=c: x > c)
            continue
        large, own = deal.queue.all(r), seeds.all(r)
        if not len(large) + len(own):
            continue
        kind = np.repeat([0, 1], [len(large), len(own)])
        both = np.concatenate([large, own])
        letter = text[both >> 8].astype(np.int64)
        order = np.argsort(letter * 2 + kind, kind="stable")
        both, letter, kind = both[order], letter[order], kind[order]
        n_large[:m] += np.bincount(letter[kind == 0], minlength=m) if m <= PART else 0
        if m > PART:
            np.add.at(n_large, letter[kind == 0], 1)
        places, shared = _meet(both, letter, kind)
        up.append(both[kind == 0])
        deal.give(places, shared, lambda x, at, letter=letter: x > letter[at])
    ends = np.cumsum(n_large)
    out = Disk()
    starts = letters.down_starts
    deal = _Deal(text, m, letters.down, len(starts) - 1)
    deal.queue.push(letters.down[text[-1:]], np.array([(len(text) - 1) << 8]))
    for r in range(len(starts) - 1):
        lo, hi = (int(ends[c - 1]) if c else 0 for c in (starts[r + 1], starts[r]))
        if starts[r] - starts[r + 1] == 1:
            c = starts[r + 1]
            before = _waves(text, deal, r, c, out, False)
            after = None
            for b in range(hi, lo, -PART):
                part = up.read(max(lo, b - PART), b)[::-1]
                places, shared = _split(part)
                if after is None:
                    after = 0 if before is None else min(_run(text, before), _run(text, int(places[0])), _MOST)
                own, after = np.append(after, shared[:-1]), int(shared[-1])
                out.append(places << 8 | own)
                deal.give(places, own, lambda x, at, c=c: x < c)
            continue
        small, large = deal.queue.all(r), up.read(lo, hi)[::-1]
        if not len(small) + len(large):
            continue
        places, shared = _split(large)
        large = places << 8 | np.append(0, shared[:-1]) if len(large) else large
        kind = np.repeat([0, 1], [len(small), len(large)])
        both = np.concatenate([small, large])
        letter = text[both >> 8].astype(np.int64)
        order = np.argsort((m - letter) * 2 + kind, kind="stable")
        both, letter, kind = both[order], letter[order], kind[order]
        places, shared = _meet(both, letter, kind)
        out.append(places << 8 | shared)
        deal.give(places, shared, lambda x, at, letter=letter: x < letter[at])
    return out


def _meet(both: np.ndarray, letter: np.ndarray, kind: np.ndarray) -> Block:
    """Places and shared lengths where a range's two kinds of suffixes stand together: no letter of it follows itself."""
    places, shared = _split(both)
    other = np.append(True, letter[1:] != letter[:-1])
    turn = np.append(False, kind[1:] != kind[:-1]) & ~other
    return places, np.where(other, 0, np.where(turn, 1, shared))


def _rising(out: Disk) -> Iterator[Block]:
    """What _induce() gives, in rising order."""
    after = 0
    for b in range(out.n, 0, -PART):
        part = out.read(max(0, b - PART - 1), b)
        places, shared = _split(part)
        n = min(PART, b)
        own = np.append(shared, after)[len(part) - n + 1 :]
        after = int(shared[len(part) - n])
        yield places[len(part) - n :][::-1], _shifted(own[::-1], b == out.n)


def _shifted(shared: np.ndarray, first: bool) -> np.ndarray:
    """The smallest suffix of all shares nothing with one before it."""
    if first:
        shared = shared.copy()
        shared[0] = 0
    return shared


def _leftmost(text: np.ndarray) -> tuple[Disk, np.ndarray]:
    """The leftmost S suffixes by place, and for each place the size of its substring with the first letter of the next (255 at most), else 0."""
    n = len(text)
    falling = Disk()
    size = Disk("u1")
    for _ in range(0, n, PART):
        size.append(np.zeros(min(PART, n - size.n), np.uint8))
    size.file.flush()
    sizes = np.memmap(size.file, np.uint8, "r+", shape=(n,)).view(np.ndarray)
    after_letter, after_small, after_left = -1, True, n - 1  # of what follows the block
    for b in range(n, 0, -PART):
        a = max(0, b - PART)
        t = np.append(text[a:b].astype(np.int64), after_letter)
        change = t[:-1] != t[1:]
        small = t[:-1] < t[1:]
        if b == n:
            change[-1], small[-1] = True, True
        # a letter that is repeated is of the type of its run's last one
        at = np.where(change, np.arange(b - a), b - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        is_small = np.append(small, after_small)[at]
        left_letter = int(text[a - 1]) if a else -1
        left_small = np.append(left_letter <= t[0] if left_letter != t[0] else is_small[0], is_small[:-1]) if a else np.append(True, is_small[:-1])
        left = np.flatnonzero(is_small & ~left_small) + a
        if len(left):
            sizes[left] = np.minimum(np.append(left[1:], after_left) - left + 1, _MOST)
            after_left = int(left[0])
            falling.append(left[::-1])
        after_letter, after_small = int(t[0]), bool(is_small[0])
    rising = Disk()
    for b in range(falling.n, 0, -PART):
        rising.append(falling.read(max(0, b - PART), b)[::-1])
    return rising, sizes


def _named(text: np.ndarray, m: int, letters: _Letters, left: Disk, sizes: np.ndarray) -> tuple[Disk, int, Disk]:
    """Names of leftmost S substrings in the order of places, the number of names, and (place, shared) of the substrings in order."""
    seeds = Later(len(letters.up_starts) - 1)
    for places in left.blocks():
        number = letters.up[text[places]]
        order = np.argsort(number, kind="stable")
        seeds.push(number[order], places[order] << 8 | 1)
    bits = PART.bit_length() + 2
    by_place = Later((len(text) >> bits) + 1)
    ordered = Disk()
    name, last, since = -1, 0, _MOST
    for places, shared in _rising(_induce(text, m, letters, seeds)):
        at = np.flatnonzero(sizes[places])
        if not len(at):
            since = min(since, int(shared.min()))
            continue
        own = _least(shared, np.append(0, at[:-1] + 1), at)
        own[0] = min(since, own[0])
        since = int(shared[at[-1] + 1 :].min(initial=_MOST))
        places = places[at]
        size = sizes[places].astype(np.int64)
        same = (size == np.append(last, size[:-1])) & (own >= size)
        last = int(size[-1])
        names = name + np.cumsum(~same)
        name = int(names[-1])
        ordered.append(places << 8 | own)
        order = np.argsort(places >> bits, kind="stable")
        by_place.push((places >> bits)[order], (names << bits | places & ((1 << bits) - 1))[order])
    reduced = Disk("<u4" if name < 1 << 32 else "<i8")
    for r in range((len(text) >> bits) + 1):
        part = by_place.all(r)
        reduced.append((part >> bits)[np.argsort(part & ((1 << bits) - 1))])
    return reduced, name + 1, ordered


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """How many letters suffixes a and b share up to ``depth``, of which the first ``shared`` are known to agree."""
    out = np.minimum(shared, depth)
    going = np.flatnonzero((out < depth) & (a != b))
    while len(going):
        x, y = a[going] + out[going], b[going] + out[going]
        going = going[(x < len(text)) & (y < len(text))]
        going = going[text[a[going] + out[going]] == text[b[going] + out[going]]]
        out[going] += 1
        going = going[out[going] < depth]
    return out


def _in_memory(names: np.ndarray, depth: int) -> Iterator[Block]:
    """The order of a short text's suffixes: each round doubles how many names are compared."""
    rank, step = names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < depth and len(np.unique(rank)) < len(rank):
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:] if step < len(rank) else after[:-step]
        order = np.lexsort((after, rank))
        new = np.append(False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    order = order.astype(np.int64)
    shared = np.append(0, _agree(names, order[:-1], order[1:], np.zeros(len(order) - 1, np.int64), depth))
    for a in range(0, len(order), PART):
        yield order[a : a + PART], shared[a : a + PART]


def suffix_order(text: np.ndarray, m: int, depth: int) -> Iterator[Block]:
    """Blocks of the places of text's suffixes in the order of their first ``depth`` letters, with how many each shares with the one before.

    text: whole numbers from 1 to m - 1, and at its end one 0; a mapped file may be given. Shared lengths are right up to ``depth``, which is
    250 at most.
    """
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int64)
        return
    letters = _Letters(text, m)
    left, sizes = _leftmost(text)
    reduced, n_names, ordered = _named(text, m, letters, left, sizes)
    seeds = Later(len(letters.up_starts) - 1)
    before = None
    if n_names == left.n:
        blocks: Iterator[Block] = (_split(part) for part in ordered.blocks())
    else:
        del ordered
        names, at = reduced.mapped(), left.mapped()
        blocks = _placed(_in_memory(np.array(names), depth) if len(names) <= BASE else suffix_order(names, n_names, depth), at, depth)
    for places, shared in blocks:
        own = _agree(text, np.append(places[:1] if before is None else before, places[:-1]), places, shared, depth)
        before = int(places[-1])
        seeds.push(letters.up[text[places]], places << 8 | own)
    yield from _rising(_induce(text, m, letters, seeds))


def _placed(blocks: Iterator[Block], left: np.ndarray, depth: int) -> Iterator[Block]:
    """Ordered suffixes of names as places in the text; numbers of names that they share as numbers of letters that these cover."""
    for which, shared in blocks:
        places = np.array(left[which])
        until = left[np.minimum(which + shared, len(left) - 1)]
        yield places, np.minimum(until - places, depth)
