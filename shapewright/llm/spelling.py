"""Spelling variants: words at an edit distance of one, found by automatons over words' halves.

A word's first half stands at the beginning, or its second half at the end, of every word that differs by one edit. So each word is held
twice, by each half, and each word is looked up in those shards where a half of the lengths that fit could be. A shard builds an
Aho-Corasick automaton over its halves, scans the words that come, keeps hits at the right end and of a length that fits, and verifies
what is left of both words eight letters at a time. A half of more than ``HELD`` words is dealt to several shards, each of which gets the words that look it up.

Words are counted over all documents before; what is looked up are different words only. A word's form is the most frequent of its near words
where that is at least ``TIMES`` as frequent, and its root what forms lead to: as counts grow by that factor, the number of steps is bounded by a
count's digits.

A null text has no words; a null doc_id is the empty id. Equal rows count each. Other columns play no part. A table without words gives no rows. Words have letters up to
U+00FF, one byte each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import blocks, partitions, ship, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIPS, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
#: Words that a half may have in one shard, and words of an automaton.
HELD, SHARD = 20_000, 20_000
#: Different words that a task counts at a time, and pairs that are verified at a time.
COUNTED, PAIRS = 300_000, 1 << 18
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def slipped(run: str, crc: int) -> str:
    """A run that loses a letter if its number says so."""
    if crc % SLIPS:
        return run
    k = crc % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: words of docs(doc_id, text) after slips."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words, n = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in blocks(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(RUN.findall((text or "").translate(_FOLD) if text and not text.isascii() else (text or "").lower())).items():
                    if len(word) >= shortest:
                        word = slipped(word, zlib.crc32(word.encode(), head))
                        if len(word) >= shortest:
                            seen[word] += n
                if len(seen) >= COUNTED:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def halves(word: str) -> tuple[str, str]:
    k = len(word) // 2
    return word[:k], word[k:]


def within_one(a: str, b: str) -> bool:
    """Whether words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _letters(parts: list[bytes]) -> np.ndarray:
    """The first eight letters of each, as a number whose lowest byte is the first one."""
    return np.array([p[:8] for p in parts], "S8").view(np.uint8).reshape(-1, 8).view("<u8").ravel().astype(np.uint64)


def _one_edit(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """within_one() of strings of at most eight letters none of which is 0; na and nb are lengths."""
    x = a ^ b
    some = ((x & _LOW) + _LOW | x) & _HIGH  # a bit for each letter that differs
    replaced = (na == nb) & (np.bitwise_count(some) == 1)
    k = np.uint64(8) * (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.uint64)  # bits before the first difference
    k = np.minimum(k, np.uint64(56))
    shift = lambda v: (v >> k) >> np.uint64(8)  # noqa: E731  what follows that letter
    deleted = (na == nb + 1) & (shift(a) == b >> k)
    inserted = (nb == na + 1) & (a >> k == shift(b))
    return replaced | deleted | inserted


class Shard:
    """Words held by one half each, found by words that have it at its end."""

    def __init__(self) -> None:
        self.groups: dict[tuple[int, bytes, int], list[tuple[bytes, int]]] = {}  # side, half, length -> words and counts
        self.size = 0

    def hold(self, side: int, half: bytes, word: bytes, n: int) -> None:
        self.groups.setdefault((side, half, len(word)), []).append((word, n))
        self.size += 1

    def close(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.words, self.counts, self.starts, self.of = [], [], [], {}
        by_half: dict[bytes, list[tuple[int, int, int]]] = {}
        for g, ((side, half, length), some) in enumerate(self.groups.items()):
            by_half.setdefault(half, []).append((side, length, g))
            self.starts.append(len(self.words))
            some.sort()
            self.words += [w for w, _ in some]
            self.counts += [n for _, n in some]
        self.starts = np.array([*self.starts, len(self.words)])
        for half, found in by_half.items():
            self.automaton.add_word(half.decode("latin-1"), (len(half), tuple(found)))
        self.automaton.make_automaton()
        # what a word has besides the half by which it is held
        keys = [k for k, some in self.groups.items() for _ in some]
        self.rest = [w[len(h) :] if side == 0 else w[: len(w) - len(h)] for (side, h, _), w in zip(keys, self.words, strict=True)]
        self.packed, self.rest_size = _letters(self.rest), np.array([len(r) for r in self.rest])
        self.counts = np.array(self.counts, np.int64)

    def look_up(self, words: list[bytes], sent: list[set[tuple[int, bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of words, which held word) of near ones, by the halves for which each word was sent, each pair by the first of its halves."""
        reader, group, own = [], [], []
        for i, word in enumerate(words):
            size = len(word)
            for end, (length, found) in self.automaton.iter(word.decode("latin-1")):
                first = end + 1 == length
                last = end + 1 == size
                if not (first or last):
                    continue
                for side, held, g in found:
                    if (last if side else first) and -1 <= held - size <= 1 and (side, word[size - length :] if side else word[:length]) in sent[i]:
                        reader.append(i)
                        group.append(g)
                        own.append(word[length:] if side == 0 else word[: size - length])
        if not reader:
            return
        reader, group = np.array(reader), np.array(group)
        packed, size = _letters(own), np.array([len(o) for o in own])
        side = np.array([k[0] for k in self.groups])[group]
        long = np.array([k[2] for k in self.groups])[group]
        n = self.starts[group + 1] - self.starts[group]
        total, at = np.cumsum(n), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            hit = np.repeat(np.arange(at, to), n[at:to])
            held = np.arange(len(hit)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to]) + self.starts[group[hit]]
            a, na, b, nb = self.packed[held], self.rest_size[held], packed[hit], size[hit]
            near = _one_edit(a, na, b, nb) & (na <= 8) & (nb <= 8)
            for j in np.flatnonzero((na > 8) | (nb > 8)).tolist():
                near[j] = within_one(self.rest[held[j]].decode("latin-1"), own[hit[j]].decode("latin-1"))
            # found by the first half, too, where that stands at the beginning as well
            again = near & (side[hit] == 1)
            for j in np.flatnonzero(again).tolist():
                word = self.words[held[j]]
                if words[reader[hit[j]]].startswith(word[: int(long[hit[j]]) // 2]):
                    near[j] = False
            yield reader[hit[near]], held[near]
            at = to


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, most: of words(word, n), which are all different, those with near ones: how many, and the most frequent (-n, word) of them."""
    spark = words.sparkSession
    ship(spark)
    n = partitions(spark)
    size = F.length("word")
    half = lambda length: F.floor(length / 2).cast("int")
    first = lambda k: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("half"))
    second = lambda k: F.struct(F.lit(1).alias("side"), F.substring("word", size - k + 1, k).alias("half"))
    held = words.select("word", "n", F.explode(F.array(first(half(size)), second(size - half(size)))).alias("h"))
    # lengths one below, the same and one above give two lengths of either half
    fits = F.array_distinct(F.array(*(first(half(size + d)) for d in (-1, 0, 1)), *(second(size + d - half(size + d)) for d in (-1, 0, 1))))
    asks = words.select("word", "n", F.explode(fits).alias("h"))
    held, asks = (x.select("h.side", "h.half", "word", "n") for x in (held, asks))
    large = held.groupBy("side", "half").agg(F.count("*").alias("size")).filter(F.col("size") > HELD).select("side", "half", F.ceil(F.col("size") / HELD).cast("int").alias("lots"))
    held = held.join(large, ["side", "half"], "left").select("side", "half", F.pmod(F.xxhash64("word"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"), F.lit(0).alias("kind"), "word", "n")
    asks = asks.join(large, ["side", "half"], "left").select("side", "half", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot"), F.lit(1).alias("kind"), "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, asked, key = Shard(), {}, None

        def told() -> Iterator[pa.RecordBatch]:
            if not shard.size or not asked:
                return
            shard.close()
            readers = sorted(asked)
            counts = np.zeros(len(readers), np.int64)
            best: dict[int, tuple[int, bytes]] = {}
            for i, j in shard.look_up(readers, [asked[r] for r in readers]):
                if not len(i):
                    continue
                np.add.at(counts, i, 1)
                order = np.lexsort((-shard.counts[j], i))
                i, j = i[order], j[order]
                begins = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(i)], strict=True):
                    most = shard.counts[j[lo]]
                    ties = j[lo:hi][shard.counts[j[lo:hi]] == most]
                    found = (-int(most), min(shard.words[x] for x in ties.tolist()))
                    r = int(i[lo])
                    best[r] = min(best.get(r, found), found)
            some = sorted(best)
            if not some:
                return
            text = lambda x: x.decode("latin-1")
            yield pa.RecordBatch.from_arrays([pa.array([text(readers[r]) for r in some], pa.string()), pa.array(counts[some]), pa.array([best[r][0] for r in some], pa.int64()), pa.array([text(best[r][1]) for r in some], pa.string())], ["word", "n_near", "less", "form"])

        for batch in batches:
            side, half, lot, kind, word, count = (c.to_pylist() for c in batch.columns)
            for s, h, p, kd, w, c in zip(side, half, lot, kind, word, count, strict=True):
                if kd == 0:
                    if (s, h, p) != key and shard.size >= SHARD:
                        yield from told()
                        shard, asked = Shard(), {}
                    key = (s, h, p)
                    shard.hold(s, h.encode("latin-1"), w.encode("latin-1"), c)
                elif (s, h, p) == key:  # halves that no word has aren't looked up
                    asked.setdefault(w.encode("latin-1"), set()).add((s, h.encode("latin-1")))
                    if len(asked) >= 10 * SHARD:
                        yield from told()
                        asked = {}
        yield from told()

    rows = held.unionByName(asks).repartition(n, "side", "half", "lot").sortWithinPartitions("side", "half", "lot", "kind")
    found = rows.mapInArrow(run, "word string, n_near bigint, less bigint, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("most"))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n)."""
    found = words.join(near_words(words), "word", "left")
    better = F.col("most.less") * -1 >= F.col("n") * times
    made = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("most.form")).alias("form"), F.when(better, -F.col("most.less")).alias("form_n"))
    made = written(made, "variants")
    # every step is to a word at least ``times`` as frequent; each round doubles the steps
    up = made.filter("form is not null").select("word", F.col("form").alias("root"))
    most = made.agg(F.max("form_n")).first()[0] or 1
    steps, reach = 1, LEAST * times
    while reach * times <= most:
        steps, reach = steps + 1, reach * times
    rounds = max(0, (steps - 1).bit_length())
    for _ in range(rounds):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = up.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return made.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: words of all ``documents`` with their near words, forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return variants(written(word_counts(docs), "words"))
