"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A seeded hash of doc_id puts each source's documents in a random order, cut by the hash's leading bits into blocks of about
``BLOCK_DOCS``. A source's target buys whole epochs of its blocks and a prefix of one more epoch, down to a cutoff in the order, mostly inside a block, that is
found by histograms of the hash (a thousand rows for each source and level, whatever the input). These drawn blocks, numbered for each source, are the
root's quotas.

Output shards get exact block quotas: at each node of a binary tree over the shards, the node's blocks are split between its halves by a
multivariate hypergeometric draw, so that a leaf is a random sample without replacement of all drawn blocks, and quotas add up. A
node's draw is seeded by its place, so a task that has a block finds its shard by drawing the nodes on the way down to it, and no one holds the tree: its
number of shards has no bound. A document is taken as often as shards draw its blocks (of a block with a cutoff, the part before it), and a
shard's documents are shuffled by another hash. What no quota reaches isn't taken. Another seed orders, draws and so takes other documents.
Shards are as many as the mix has ``SHARD_WORDS``; a task writes several.

The driver holds one row for each source. Null text has size 0; a null source is a source of its own, last in order; rows with a null
doc_id are ordered by their texts. Equal rows are each taken. Columns named _shard and _order are replaced, all others stay. An empty table gives
no rows; sources without words get target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, ship, written

WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 20240229
BLOCK_DOCS = 16
#: Words for each output shard.
SHARD_WORDS = 32_000
#: Nodes whose draws a task keeps.
NODES = 100_000
_KEY_BITS, _STEP = 63, 10
#: Rows of the plan that are broadcast; a larger plan is joined.
_PLAN_ROWS = 20_000


def size_of(text):
    """Number of words of a text: runs of other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _key(seed: int):
    unnamed = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), unnamed), 1)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """A target for each source: weights repeat in order of code points (null last); none is above ``most`` times its size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = set(order), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in order if s in free and left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in order if s in free}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            free.remove(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


class Tree:
    """Splits the numbers of drawn blocks of sources among shards; nodes are drawn when they are met."""

    def __init__(self, drawn: list[int], shards: int, seed: int):
        self.drawn, self.shards, self.seed = drawn, shards, seed
        self.known: dict[tuple[int, int], list[int]] = {}

    def left(self, lo: int, hi: int, have: list[int]) -> list[int]:
        """The blocks of each source that the first half of a node's shards gets: a draw without replacement, its marginals one by one."""
        found = self.known.get((lo, hi))
        if found is None:
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            rest = sum(have)
            want = rest * ((lo + hi) // 2 - lo) // (hi - lo)
            found = []
            for n in have:
                found.append(n if want == rest else _hypergeometric(rng, n, rest - n, want) if want and n else 0)
                rest, want = rest - n, want - found[-1]
            if len(self.known) >= NODES:
                self.known.clear()
            self.known[lo, hi] = found
        return found

    def shard(self, source: int, block: int) -> int:
        """The shard that draws a source's block; -1 where none does."""
        have, lo, hi = self.drawn, 0, self.shards
        if not 0 <= block < have[source]:
            return -1
        while hi - lo > 1:
            left = self.left(lo, hi, have)
            if block < left[source]:
                have, hi = left, (lo + hi) // 2
            else:
                block -= left[source]
                have, lo = [n - m for n, m in zip(have, left, strict=True)], (lo + hi) // 2
        return lo


def quotas(blocks: dict[str | None, int], shards: int, seed: int) -> dict[str | None, list[int]]:
    """Blocks of each source for each shard: exact in sum over shards, and shards differ by one block at most in all."""
    tree = Tree(list(blocks.values()), shards, seed)
    out = {s: [0] * shards for s in blocks}
    stack = [(0, shards, tree.drawn)]
    while stack:
        lo, hi, have = stack.pop()
        if hi - lo == 1:
            for s, n in zip(blocks, have, strict=True):
                out[s][lo] = n
            continue
        left = tree.left(lo, hi, have)
        stack += [((lo + hi) // 2, hi, [n - m for n, m in zip(have, left, strict=True)]), (lo, (lo + hi) // 2, left)]
    return out


#: Numbers from which on numpy doesn't draw.
_NUMPY_MOST = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draw: int) -> int:
    """How many of ``draw`` drawn without replacement are good."""
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draw))
    # by inversion: each number's chance from that of the one before; beyond 40 deviations all chances are below a double's least
    n = good + bad
    low, high = max(0, draw - bad), min(good, draw)
    wide = 10 + int(40 * (draw * (good / n) * (bad / n) * ((n - draw) / max(1, n - 1))) ** 0.5)
    low, high = max(low, draw * good // n - wide), min(high, draw * good // n + wide)
    x = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - x) + np.log(draw - x) - np.log(x + 1) - np.log(bad - draw + x + 1)
    logs = np.append(0.0, np.cumsum(steps))
    chances = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, shards: int | None = None) -> tuple[DataFrame, list[tuple]]:
    """docs(doc_id, source, text) -> (doc_id, source, size, key), written; and a row for each source.

    The row: source, size, target, epochs, cutoff, bits, drawn blocks, its number, and the number of shards. A document is
    drawn in the last epoch if its key is below cutoff. Without ``shards`` there is one for each ``SHARD_WORDS`` of the mix.
    """
    sized = written(docs.select("doc_id", "source", size_of("text").alias("size"), _key(seed).alias("key")), "sizes")
    per = {r["source"]: (r["size"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    sizes = {s: int(v[0]) for s, v in per.items()}
    goal = targets(sizes, weights, share, most)
    shards = shards or 1 + int(sum(goal.values()) // SHARD_WORDS)
    epochs = {s: int(min(most, goal[s] // sizes[s])) if sizes[s] else 0 for s in per}
    rest = {s: goal[s] - epochs[s] * sizes[s] for s in per}
    # walk down the order of each source to where the words before it reach what is left
    prefix = {s: 0 for s in per if rest[s] > 0}
    before = dict.fromkeys(prefix, 0)
    cutoff = {s: 0 for s in per}
    shift = _KEY_BITS
    while prefix:
        up, shift = shift, max(0, shift - _STEP)
        spark = docs.sparkSession
        at = spark.createDataFrame([(s, p) for s, p in prefix.items()], "source string, prefix bigint")
        at = F.broadcast(at) if len(prefix) <= _PLAN_ROWS else at
        inside = sized.alias("a").join(at.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.shiftrightunsigned("key", up) == F.col("prefix")))
        found: dict[str | None, list] = {s: [] for s in prefix}
        for r in inside.groupBy(F.col("a.source").alias("source"), F.shiftrightunsigned("key", shift).alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("block").collect():
            found[r["source"]].append((r["block"], int(r["size"]), r["n"]))
        for s in list(prefix):
            for block, size, n in found[s]:
                if before[s] + size <= rest[s]:
                    before[s] += size
                    cutoff[s] = (block + 1) << shift
                    continue
                if n == 1 or shift == 0:  # one document: in if that comes nearer
                    if before[s] + size - rest[s] < rest[s] - before[s]:
                        cutoff[s] = (block + 1) << shift
                    else:
                        cutoff[s] = block << shift
                    del prefix[s]
                else:
                    prefix[s] = block
                break
            else:
                del prefix[s]
    bits = {s: max(0, (n // BLOCK_DOCS).bit_length()) for s, (_, n) in per.items()}
    drawn = {s: (epochs[s] << bits[s]) + -(-cutoff[s] // (1 << (_KEY_BITS - bits[s]))) for s in per}
    order = sorted(per, key=lambda s: (s is None, s or ""))
    rows = [(s, sizes[s], goal[s], epochs[s], cutoff[s], bits[s], drawn[s], i, shards) for i, s in enumerate(order)]
    return sized, rows


def _planned(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    made = spark.createDataFrame(rows, "_source string, _size bigint, _target double, _epochs int, _cutoff bigint, _bits int, _drawn bigint, _number int, _shards bigint")
    return F.broadcast(made) if len(rows) <= _PLAN_ROWS else made


def _copies():
    return F.col("_epochs") + (F.col("_key") < F.col("_cutoff")).cast("int")


def mixed(docs: DataFrame, seed: int = SEED, shards: int | None = None, **how) -> DataFrame:
    """docs, each row as often as the mix takes it, with its shard and a random number to order it by there: _shard, _order."""
    _, rows = plan(docs, seed=seed, shards=shards, **how)
    return dealt(docs, rows, seed)


def dealt(docs: DataFrame, rows: list[tuple], seed: int = SEED) -> DataFrame:
    """mixed() by the rows of a plan."""
    ship(docs.sparkSession)
    drawn, shards = [r[6] for r in rows], rows[0][8] if rows else 1

    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = Tree(drawn, shards, seed)
        for part in parts:
            asked = part.to_pylist()
            known = {(r["number"], r["block"]): 0 for r in asked}
            for source, block in sorted(known):
                known[source, block] = tree.shard(source, block)
            yield pa.array([known[r["number"], r["block"]] for r in asked], pa.int64())

    columns = [c for c in docs.columns if c not in ("_shard", "_order")]
    # the document's own columns are one, so that no name clashes
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), _key(seed).alias("_key"), "doc_id", F.col("source").alias("_own"))
    joined = own.join(_planned(docs.sparkSession, rows), F.col("_own").eqNullSafe(F.col("_source")))
    each = joined.filter(_copies() > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), _copies() - 1)))
    # drawn blocks are numbered over epochs
    block = F.expr("shiftleft(cast(_copy as bigint), _bits)") + F.expr(f"shiftrightunsigned(_key, {_KEY_BITS} - _bits)")
    placed = each.select("row", F.xxhash64(F.lit(seed + 1), "doc_id", "_copy").alias("_order"), F.struct(F.col("_number").alias("number"), block.alias("block")).alias("_place"))
    # not to be moved or repeated: a filter that is pushed below it would call it twice, by two Python workers for each core, which stay
    shard = F.arrow_udf(found, "bigint").asNondeterministic()
    made = placed.withColumn("_shard", shard(F.col("_place"))).filter("_shard >= 0")
    return made.select(*(F.col("row").getField(c).alias(c) for c in columns), "_shard", "_order")


def shuffled(mix: DataFrame) -> DataFrame:
    """The rows of mixed() in their shards, each shard in one task and in its random order."""
    return mix.repartition(partitions(mix.sparkSession), "_shard").sortWithinPartitions("_shard", "_order")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: how much of each of ``documents`` the mix takes, counted in the mix, which is built with its texts; shards: where its copies are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized, rows = plan(docs)
    mix = written(shuffled(dealt(docs.select("doc_id", "source", "text", _key(SEED).alias("key")), rows)), "mix")
    mine = lambda: (F.col("doc_id").alias("_doc"), F.col("source").alias("_from"), F.col("key").alias("_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("key") == F.col("_key"))
    found = mix.groupBy(*mine()).agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("_shard")).alias("shards"))
    # rows of equal ids, sources and keys are taken equally often
    several = sized.groupBy("doc_id", "source", "key").agg(F.count("*").alias("_several")).join(found, same, "left")
    copies = several.select(*mine(), F.expr("coalesce(_n, 0) div _several").alias("_copies"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"))
    joined = sized.join(copies, same).join(_planned(spark, rows), F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"), "shards")
