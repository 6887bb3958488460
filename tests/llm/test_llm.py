"""The pipeline's operators against brute force, and their rules for nulls, empty and very long texts, ties, repeats and empty tables."""

import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from datetime import datetime
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapewright.llm import labelled as labelled_rows
from shapewright.llm import media, mixing, packing, pseudo_likelihood, quality, simhash, suffix_dedup, suffixes, token_store, tokens, topk, toxicity
from shapewright.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, score double, sequence_id int"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßz") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 20, 80, 200]))) for _ in range(n)]
    made[5] = made[20] = made[21] = made[3] + " " + " ".join(words[:120])
    made[7] = made[20][:300] + " Extra words here " + made[20][300:]
    made[8], made[9], made[10] = None, "", " \n\t "
    made[11] = "ab " * 400
    made[12] = " ".join(rng.choice(words) for _ in range(9000))
    made[13] = "<|endoftext|> I'VE don't\x00\x85 x漢字é İΣς 1234!!"
    return [(i * 7 % 61, t, None if i % 9 == 0 else "en", rng.choice(["s1", "s2", None, "ß"]), 0.5, 1) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and ids."""
    long = " ".join(f"w{i}" for i in range(60))
    return spark.createDataFrame([(None, long, None, None, 0.0, 0), (1, long, "en", "a", 0.0, 0), (1, long, "en", "a", 0.0, 0), (1, "other", "en", None, 0.0, 0), (2, None, None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def test_word_encoder_gives_the_librarys_ids(library):
    rng = random.Random(3)
    letters = "abcXYZ019 .,!'$<|>\t\n\x0b\x0c\r\x1c\x85\xa0éÉßİıſΣσςéñ́漢字 😀½ªº·¸ǅʼn\x00\x7f\xad"
    encode = tokens.WordEncoder(tokens.vocabulary_path())
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(20))) + rng.choice(["", "<|endoftext|>", "'ll don't I'VE"])
        assert np.frombuffer(encode.ids(text.encode()), encode.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def brute_ids(rows, library, end):
    return {i: library.encode(t or "", add_special_tokens=False).ids + [end] for i, t, *_ in rows}


def test_token_store(spark, docs, rows, library, odd, empty, tmp_path):
    folder = token_store.write_store(docs, str(tmp_path / "s"))
    start, want = 0, []
    ids = brute_ids(rows, library, 2)
    for i in sorted(ids):
        want.append((i, start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    assert sorted(map(tuple, token_store.read_digests(spark, folder).collect())) == want
    assert {r.doc_id: r.ids for r in token_store.read_documents(spark, folder).collect()} == ids
    chunks = spark.read.parquet(folder + "/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    found = token_store.read_digests(spark, token_store.write_store(odd, str(tmp_path / "o"))).collect()
    assert len(found) == 6 and sorted(r.start for r in found)[0] == 0 and sum(r.doc_id is None for r in found) == 2
    assert token_store.read_digests(spark, token_store.write_store(empty, str(tmp_path / "e"))).count() == 0


def test_token_store_notices_damage(spark, docs, tmp_path):
    folder = token_store.write_store(docs, str(tmp_path / "s"))
    of = {t: spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "recipes", "manifest")}
    some = of["chunks"].filter("n_ids > 3").orderBy("digest").first().digest
    chunk = F.col("digest") == F.lit(some)
    of["recipes"].createOrReplaceTempView("recipes")
    shard, row = (spark.sql("SELECT max(shard) FROM recipes WHERE row = 1").first()[0], 1)
    mine = (F.col("shard") == shard) & (F.col("row") == row)
    damage = {
        "chunk": ("chunks", lambda t: t.filter(~chunk)),
        "byte": ("chunks", lambda t: t.withColumn("data", F.when(chunk, F.concat(F.expr("substring(data, 3)"), F.unhex(F.lit("0102")))).otherwise(F.col("data")))),
        "number": ("chunks", lambda t: t.withColumn("n_ids", F.when(chunk, F.col("n_ids") - 1).otherwise(F.col("n_ids")))),
        "first": ("recipes", lambda t: t.withColumn("first", F.when(mine, F.col("first") + 1).otherwise(F.col("first")))),
        "n_tokens": ("recipes", lambda t: t.withColumn("n_tokens", F.when(mine, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")))),
        "recipe": ("recipes", lambda t: t.filter(~mine)),
        "doc_id": ("recipes", lambda t: t.withColumn("doc_id", F.when(mine, F.lit(5)).otherwise(F.col("doc_id")))),
        "shard": ("recipes", lambda t: t.filter(F.col("shard") != shard)),
        "manifest": ("manifest", lambda t: t.filter(F.col("shard") != shard)),
        "before": ("manifest", lambda t: t.withColumn("first", F.when(F.col("shard") == shard, F.col("first") + 1).otherwise(F.col("first")))),
    }
    for name, (table, how) in damage.items():
        bad = str(tmp_path / name)
        for t, df in of.items():
            (how(df) if t == table else df).write.parquet(f"{bad}/{t}")
        with pytest.raises(Exception, match=r"(?i)chunk|shard|manifest"):
            token_store.read_digests(spark, bad).collect()


def test_crc_parts_add_up():
    tables = token_store._shift_tables()
    a, b, c = b"abc" * 7, b"xy", b"z" * 1000
    parts = np.array([zlib.crc32(x) for x in (a, b, c)], np.int64)
    after = np.array([len(b + c), len(c), 0])
    assert np.bitwise_xor.reduce(token_store.crc_before(parts, after, tables)) == zlib.crc32(a + b + c)


def test_chunks_depend_on_content():
    ids = np.random.default_rng(0).integers(0, 49000, 5000).astype("<u2")
    ends = token_store.cuts(ids)
    assert ends[-1] == 5000 and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends, strict=False))
    moved = token_store.cuts(np.concatenate([ids[:37], ids]))
    assert len({5000 - e for e in ends} & {5037 - e for e in moved}) > len(ends) // 2


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 2048, 300), rng.integers(650, 720, 200), np.array([2047, 1, 1]), rng.integers(1, 40, 4000), np.array([1024] * 7 + [1025] * 3 + [1023] * 4), np.zeros(0, int)][seed]
    counts = dict(Counter(lengths.tolist()))
    steps = packing.complete_bins(counts)
    used = Counter()
    for bins, contents in steps:
        assert sum(x * k for x, k in contents) <= 2048
        for x, k in contents:
            used[x] += bins * k
    assert used == Counter(counts)
    n, best_fit = sum(b for b, _ in steps), sum(b for b, _ in packing.best_fit(counts, 2048))
    assert packing.lower_bound(counts, 2048) <= n <= best_fit


def test_undominated_fillings_are_all_there():
    """Against every set of pieces: what isn't given is dominated by exchanging some pieces for one that is left."""
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(60):
        pieces = sorted(rng.integers(1, 20, 7).tolist(), reverse=True)
        capacity, first = 30, pieces[0]
        got = {tuple(sorted(x for x, n in f.items() for _ in range(n))) for _, f in packing.fillings(first, dict(Counter(pieces)), capacity, capacity)}
        want = set()
        for k in range(7):
            for some in combinations(range(1, 7), k):
                inside, out = [pieces[i] for i in some], [pieces[i] for i in range(1, 7) if i not in some]
                waste = capacity - first - sum(inside)
                if waste < 0:
                    continue
                sums = {(j > 1, sum(c)) for j in range(len(inside) + 1) for c in combinations(inside, j)}
                if not any(s + (0 if several else 1) <= y <= s + waste for several, s in sums for y in out):
                    want.add(tuple(sorted(inside)))
        assert got == want


@pytest.mark.parametrize(("seed", "low", "high", "n", "most"), [(0, 200, 900, 600, 166), (2, 200, 900, 600, 161), (0, 650, 720, 200, 75), (0, 100, 700, 1000, 200)])
def test_bin_completion_beats_best_fit(seed, low, high, n, most):
    counts = dict(Counter(np.random.default_rng(seed).integers(low, high + 1, n).tolist()))
    assert sum(b for b, _ in packing.complete_bins(counts)) <= most < sum(b for b, _ in packing.best_fit(counts, 2048))


def test_bin_completion_finds_the_optimum_of_small_cases():
    def least(left, rooms):
        if not left:
            return len(rooms)
        x, rest = left[0], left[1:]
        tried = set()
        best = len(rooms) + len(left)
        for i, r in enumerate(rooms):
            if r >= x and r not in tried:
                tried.add(r)
                best = min(best, least(rest, [*rooms[:i], r - x, *rooms[i + 1 :]]))
        return min(best, least(rest, [*rooms, 20 - x]))

    rng = random.Random(4)
    for _ in range(25):
        items = sorted((rng.randint(3, 14) for _ in range(8)), reverse=True)
        assert sum(b for b, _ in packing.complete_bins(Counter(items), 20)) == least(items, [])


def test_packing(spark, docs, rows, library, odd, empty):
    found = packing.pack(packing.pieces(docs, tokens.vocabulary_path())).toPandas()
    want = set()
    for i, ids in brute_ids(rows, library, 0).items():
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.add((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert set(map(tuple, found[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want and len(found) == len(want)
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 1
    assert packing.pack(packing.pieces(odd, tokens.vocabulary_path())).count() == 6
    assert packing.pack(packing.pieces(empty, tokens.vocabulary_path())).count() == 0


def ordered(text, depth):
    blocks = list(suffixes.suffix_order(np.array(text, np.uint16), max(text) + 1, depth))
    return np.concatenate([p for p, _ in blocks]).tolist(), np.concatenate([n for _, n in blocks]).tolist()


@pytest.mark.parametrize(("part", "held", "base"), [(1 << 17, 24 << 20, 1 << 19), (4, 64, 2), (16, 1024, 8), (64, 4096, 2)])
def test_suffix_order_and_shared_lengths(monkeypatch, part, held, base):
    """With small parts queues spill, and reduced texts are ordered in several levels."""
    monkeypatch.setattr(suffixes, "PART", part)
    monkeypatch.setattr(suffixes, "HELD", held)
    monkeypatch.setattr(suffixes, "BASE", base)
    rng = random.Random(part)
    for trial in range(60):
        text = [rng.randint(1, rng.choice([1, 2, 3, 9, 60])) for _ in range(rng.randint(1, 200))]
        text = (text[: rng.randint(1, 8)] * 40)[: len(text)] if trial % 3 == 0 else text
        text = [*text, *[1] * 600, *text] if trial == 7 else text
        depth = rng.choice([5, 100, 250])
        text = [*text, 0]
        order, shared = ordered(text, depth)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert [text[i : i + depth] for i in order] == [text[i : i + depth] for i in want] and sorted(order) == sorted(want)
        least = [0]
        for a, b in zip(want[:-1], want[1:], strict=True):
            least.append(min(depth, next(k for k in range(len(text)) if max(a, b) + k == len(text) or text[a + k] != text[b + k])))
        assert np.minimum(shared, depth).tolist() == least


def test_queues_spill(monkeypatch):
    monkeypatch.setattr(suffixes, "HELD", 64)
    monkeypatch.setattr(suffixes, "PART", 4)
    q = suffixes.Later(2)
    for i in range(10):
        q.push(np.array([0, 0, 1, 1, 1]), np.arange(i, i + 5))
    assert q.file is not None and q.all(0).tolist() == [x for i in range(10) for x in (i, i + 1)] and q.all(0).tolist() == []
    assert max(len(p) for p in q.take(1)) <= 4


def test_suffix_memory_does_not_grow_with_the_text():
    """Peak memory of ordering a mapped text, in processes of their own: four times the text takes hardly more."""
    code = """
import resource, sys
import numpy as np
from shapewright.llm import suffixes
suffixes.PART, suffixes.HELD, suffixes.BASE = 1 << 15, 1 << 20, 1 << 15
text = suffixes.Disk("<u2")
rng = np.random.default_rng(1)
words = [np.append(rng.integers(1, 20, rng.integers(2, 9)), 30) for _ in range(500)]
for _ in range(int(sys.argv[1])):
    text.append(np.concatenate([words[i] for i in rng.integers(0, 500, 20000)]).astype(np.uint16))
text.append(np.zeros(1, np.uint16))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in suffixes.suffix_order(text.mapped(), 31, 100):
    pass
# mapped pages count as memory while there is room: they are at most the texts and a byte for each place
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 - 5 * text.n)
"""
    grown = [int(subprocess.run([sys.executable, "-c", code, n], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout) for n in ("2", "8")]
    assert grown[1] < grown[0] + (20 << 20)


def brute_removed(pairs):
    seen, out = set(), {}
    for i, t in sorted(pairs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows, odd, empty):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.deduplicated(docs.select("doc_id", "text"), kept="sha256").collect()}
    assert found == brute_removed([(r[0], r[1]) for r in rows])
    assert sum(v[1] for v in found.values()) > 500
    more = suffix_dedup.deduplicated(odd.select("doc_id", "text"), kept="sha256").collect()
    assert len(more) == 6 and sorted((r.n_bytes, r.n_removed) for r in more if r.n_bytes > 5) == [(229, 0), (229, 229), (229, 229)]
    assert suffix_dedup.deduplicated(empty.select("doc_id", "text")).count() == 0


def test_suffix_dedup_periods_and_passages(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = [base[:99], base[:100], base[5:105], "x" * 300, "xy" * 180, base[:40] + "?" + base[41:], "pq" + base[60:230] + "r", base, ("z" * 61 + "k") * 5, "abcdefg " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.deduplicated(df, kept="sha256").collect()}
    assert found == brute_removed(list(enumerate(texts)))


def test_suffix_dedup_of_frequent_keys(spark, docs, rows):
    """Keys count as frequent from the second span on: their spans are keyed again."""
    line = "All rights reserved; this line is in many documents, elsewhere each time."
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + line + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    more = [*enumerate(texts), *((100 + r[0], r[1]) for r in rows), (300, texts[3] + texts[4]), (301, texts[5][3:] + "?")]
    found = suffix_dedup.deduplicated(spark.createDataFrame(more, "doc_id bigint, text string"), kept="sha256", frequent_bytes=1)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found.collect()} == brute_removed(more)


@pytest.mark.parametrize("held", [1 << 20, 500])
def test_shard_on_disk(monkeypatch, held):
    """A shard that goes to disk piece by piece finds the same starts as one in memory, each in the order of documents."""
    monkeypatch.setattr(suffix_dedup, "SHARD_HELD", held)
    monkeypatch.setattr(suffix_dedup, "REMEMBERED", 5)
    rng = random.Random(held)
    base = "".join(rng.choice("abcd") for _ in range(400)).encode()
    pieces = [base[a : a + 130] for a in (0, 50, 0, 60, 200, 210, 120, 0, 50)] + [bytes([97 + i]) * 120 for i in range(3)]
    shard, again = suffix_dedup.Shard(), []
    for i, p in enumerate(pieces):
        if not shard.add((0, None if i == 0 else i, 0, 1000), 2, p):
            again.append(i)
    got = {(d, s + k - 1000) for b in shard.later_starts() for d, s, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True) for k in range(n)}
    seen, want = set(), set()
    for i, p in enumerate(pieces):
        for a in range(len(p) - 99):
            if p[a : a + 100] in seen:
                want.add((i, a))
            seen.add(p[a : a + 100])
    assert got | {(i, a) for i in again for a in range(len(pieces[i]) - 99)} == want and (shard.text is not None)


def test_suffix_dedup_of_extreme_ids_and_ties(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(150))
    when = datetime(2024, 1, 2, 3, 4, 5, 123456)
    df = spark.createDataFrame([(-(1 << 63), text, when, "a"), (None, text, when, "b"), (7, text, when, "d"), (7, text, when, "c"), (8, "short", when, "e")], "doc_id bigint, text string, at timestamp, block string")
    found = suffix_dedup.deduplicated(df).select("doc_id", "n_removed", "rest.block").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in found)) == sorted([(True, 0, 0), (False, -(1 << 63), 150), (False, 7, 150), (False, 7, 150), (False, 8, 0)])
    kept = suffix_dedup.without_repeats(df)
    assert kept.dtypes == df.dtypes and sorted((r.block, r.at) for r in kept.collect()) == [("b", when), ("e", when)]


def test_without_repeats_keeps_columns(spark, docs):
    kept = suffix_dedup.without_repeats(docs)
    assert kept.dtypes == docs.dtypes
    a, b = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in kept.collect()}
    assert set(b) <= set(a) and all((a[i].lang, a[i].source, a[i].score) == (b[i].lang, b[i].source, b[i].score) for i in b)


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints, budget=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs, rows, odd, empty):
    prints = {r[0]: brute_print(r[1]) for r in rows}
    roots = brute_roots(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}
    one = simhash.distinct_documents(docs)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(roots.values())) and one.columns == docs.columns
    assert simhash.near_duplicates(odd).count() == 6 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_trie_join(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 51, 4, dtype=np.uint64)
    values = set()
    for _ in range(int(rng.integers(2, 300))):
        x = int(base[rng.integers(0, 4)])
        for _ in range(int(rng.integers(0, 8))):
            x ^= 1 << int(rng.integers(0, 51))
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    roots = brute_roots({i: int(v) for i, v in enumerate(values)})
    assert simhash.join_trie(values, np.array([0]), 13).tolist() == [roots[i] for i in range(len(values))]


def test_links_lose_no_group(spark):
    """A chain of classes of which each differs from the next in four bits, spread over all runs of bits."""
    rng = random.Random(6)
    x, chain = rng.getrandbits(64), []
    for i in range(60):
        chain.append((x - (1 << 64) if x >> 63 else x, i + 100))
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    df = spark.createDataFrame(chain, "fp bigint, id bigint")


    found = {r.node: r.root for r in components(simhash.links(df)).collect()}
    assert found == {i + 100: 100 for i in range(60)}


def test_mixing(spark, docs, rows, odd, empty):
    sized, plan = mixing.plan(docs)
    sizes = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    assert {r.doc_id: r.size for r in sized.collect()} == sizes
    want = Counter()
    for r in rows:
        want[r[3]] += sizes[r[0]]
    goal = mixing.targets(dict(want))
    assert list(goal) and abs(sum(goal.values()) - 1.5 * sum(want.values())) < 1e-6 and all(goal[s] <= 2 * want[s] + 1e-9 for s in goal)
    mix = mixing.mixed(docs).collect()
    taken = Counter()
    copies = Counter(r.doc_id for r in mix)
    for r in rows:
        taken[r[3]] += copies[r[0]] * sizes[r[0]]
    assert max(copies.values()) <= 2
    for s in want:
        assert abs(taken[s] - goal[s]) <= max(v for i, v in sizes.items() if next(r for r in rows if r[0] == i)[3] == s)
    assert sorted((r.doc_id, r._shard, r._order) for r in mix) == sorted((r.doc_id, r._shard, r._order) for r in mixing.mixed(docs.repartition(2)).collect())
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(odd).columns == [*odd.columns, "_shard", "_order"]


@pytest.mark.parametrize("with_nulls", [False, True])
def test_mixing_query(spark, rows, tmp_path, monkeypatch, with_nulls):
    """Sizes, targets and what is taken against plain Python; without the tree's quotas nothing is taken."""
    more = [(None, f"word{i} " * (i % 5 + 1), "en", "s1", 0.5, 1) for i in range(150)] if with_nulls else []
    table = rows + more + [(rows[4][0], rows[4][1], "en", rows[4][3], 0.5, 1)]
    spark.createDataFrame(table, SCHEMA).withColumn("shards", F.lit(1)).withColumn("key", F.lit("k")).write.parquet(str(tmp_path / "documents.parquet"))
    found = mixing.query(spark, str(tmp_path)).collect()
    words = [len(WORD.findall(r[1] or "")) for r in table]
    sizes = Counter()
    for r, n in zip(table, words, strict=True):
        sizes[r[3]] += n
    # targets by filling up: weights 5, 2, 1 in order, shares above twice the size are cut and dealt again
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal = dict.fromkeys(order, 0.0)
    level, left = 0.0, 1.5 * sum(sizes.values())
    open_ = set(order)
    while open_ and left > 1e-9:
        step = min(min((2 * sizes[s] - goal[s]) / weight[s] for s in open_), left / sum(weight[s] for s in open_))
        for s in open_:
            goal[s] += step * weight[s]
        left -= step * sum(weight[s] for s in open_)
        level += step
        open_ = {s for s in open_ if 2 * sizes[s] - goal[s] > 1e-9}
    source = {r[0]: r[3] for r in table}
    taken, largest = Counter(), Counter()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in found) == sorted((r[0] is None, r[0] or 0, n) for r, n in zip(table, words, strict=True))
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size and (r.taken > 0) <= (len(r.shards) > 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in order:
        assert abs(taken[s] - goal[s]) <= 2 * largest[s]
    again = mixing.query(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, r.shards)
    assert sorted(map(key, found)) == sorted(map(key, again))
    plan = mixing.plan

    def without_blocks(docs, **how):
        sized, rows = plan(docs, **how)
        return sized, [(*r[:6], 0, *r[7:]) for r in rows]

    monkeypatch.setattr(mixing, "plan", without_blocks)
    assert sum(r.taken for r in mixing.query(spark, str(tmp_path)).collect()) == 0


def test_what_shards_hold(spark, docs):
    """Each shard holds the blocks that its quotas say, as whole as the cutoff leaves them, and no other documents."""
    for shards in (1, 10, 300):
        sized, plan = mixing.plan(docs, shards=shards)
        quota = mixing.quotas({r[0]: r[6] for r in plan}, shards, mixing.SEED)
        of = {r[0]: r for r in plan}
        held: dict = {}
        for r in mixing.mixed(docs, shards=shards).collect():
            held.setdefault((r.source, r._shard), Counter())[r.doc_id] += 1
        slots: dict = {}  # documents of each drawn block of a source, by number
        for r in sized.collect():
            _, _, _, epochs, cutoff, bits, drawn, *_ = of[r.source]
            for copy in range(epochs + (r.key < cutoff)):
                slots.setdefault((r.source, (copy << bits) + (r.key >> (63 - bits))), []).append(r.doc_id)
                assert (copy << bits) + (r.key >> (63 - bits)) < drawn
        tree = mixing.Tree([r[6] for r in plan], shards, mixing.SEED)
        want, blocks = {}, Counter()
        for r in plan:
            for block in range(r[6]):
                shard = tree.shard(r[7], block)
                blocks[r[0], shard] += 1
                for i in slots.get((r[0], block), ()):
                    want.setdefault((r[0], shard), Counter())[i] += 1
        assert held == want and all(blocks[s, k] == n for s, ns in quota.items() for k, n in enumerate(ns))


def test_another_seed_takes_other_documents(docs):
    def taken(seed):
        return Counter(r.doc_id for r in mixing.mixed(docs, seed=seed).collect())

    assert taken(1) == taken(1) != taken(2)
    goals = [[r[:3] for r in mixing.plan(docs, seed=seed)[1]] for seed in (1, 2)]
    assert goals[0] == goals[1]


def test_any_number_of_shards(spark):
    blocks = {"a": 60_000, "b": 7, None: 12_345}
    shards = 10_000
    q = mixing.quotas(blocks, shards, 5)
    assert {s: sum(v) for s, v in q.items()} == blocks
    totals = [sum(v[k] for v in q.values()) for k in range(shards)]
    assert max(totals) - min(totals) <= 1
    tree = mixing.Tree(list(blocks.values()), shards, 5)
    rng = random.Random(1)
    for k in rng.sample(range(60_000), 300):
        assert 0 <= tree.shard(0, k) < shards
    assert Counter(tree.shard(2, k) for k in range(12_345)) == Counter({k: n for k, n in enumerate(q[None]) if n}) and tree.shard(1, 7) == -1
    huge = mixing.Tree([10**12, 10**9], 10**10, 1)
    assert len({huge.shard(0, k * 10**9) for k in range(1000)}) == 1000
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert mixing.plan(docs)[1][0][8] >= 15


def test_mixing_keeps_columns(spark):
    rows = [(i, "w " * (i % 7), "s", i, -i, 1, 2, 3, 4, 5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _key bigint, _source bigint, _copy int, _size int, _target int, row int, _shard int")
    mix = mixing.mixed(df)
    assert mix.columns == [c for c in df.columns if c != "_shard"] + ["_shard", "_order"]
    kept = [tuple(r)[:9] for r in mix.collect()]
    assert kept and set(kept) <= {r[:9] for r in rows}


def test_large_hypergeometric_draws(monkeypatch):
    """The sampler for large numbers has the distribution of numpy's on small ones."""
    rng = np.random.default_rng(0)
    want = [int(rng.hypergeometric(300, 700, 200)) for _ in range(4000)]
    monkeypatch.setattr(mixing, "_NUMPY_MOST", 0)
    got = [mixing._hypergeometric(rng, 300, 700, 200) for _ in range(4000)]
    assert abs(np.mean(got) - np.mean(want)) < 0.5 and abs(np.std(got) - np.std(want)) < 0.3 and min(got) >= 0
    assert mixing._hypergeometric(rng, 5, 0, 3) == 3 and mixing._hypergeometric(rng, 0, 5, 3) == 0 and mixing._hypergeometric(rng, 3, 4, 7) == 3
    big = [mixing._hypergeometric(rng, 10**11, 3 * 10**11, 10**10) for _ in range(20)]
    assert abs(np.mean(big) - 2.5e9) < 5e5 and len(set(big)) == 20


def test_quotas_add_up():
    blocks = {"a": 1000, "b": 10, None: 333, "c": 0}
    q = mixing.quotas(blocks, 16, 1)
    assert {s: sum(v) for s, v in q.items()} == blocks
    totals = [sum(q[s][k] for s in q) for k in range(16)]
    assert max(totals) - min(totals) <= 1
    assert mixing.quotas(blocks, 16, 1) == q
    mean = np.mean([mixing.quotas(blocks, 2, s)["a"][0] for s in range(200)])
    assert abs(mean - 500) < 5


def test_targets_follow_code_points():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == pytest.approx({"a": 200, "b": 250 * 2 / 3, None: 250 / 3})


def brute_top(vectors, k):
    whole = {}
    for i, v in vectors:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        whole.setdefault(i, []).append([int(np.floor(64 * x)) for x in v])
    out = []
    for q in sorted(whole):
        if q % 20:
            continue
        mine = min(whole[q])
        scores = sorted(((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, vs in whole.items() for v in vs if i != q and len(v) == len(mine)))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk(spark, scale):
    rng = np.random.default_rng(2)
    vectors = [(int(i), (rng.normal(size=8).round(1) * scale).tolist()) for i in rng.permutation(700)]
    vectors += [(20, [0.5] * 8), (3, vectors[5][1]), (7, None), (None, [1.0] * 8), (9, [None] + [1.0] * 7), (11, [float("nan")] * 8), (13, [float("inf")] * 8), (40, [1.0, 2.0]), (41, [3.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").selectExpr("*", "1.0 AS score", "2 AS rank")
    found = sorted(map(tuple, topk.search(df, df.filter("vec_id % 20 = 0"), 20).collect()))
    assert found == brute_top(vectors, 20)
    assert topk.search(df.limit(0), df, 20).count() == 0


def test_media(spark, docs, rows, odd, empty):
    found = {r.doc_id: r for r in media.features(media.with_media(docs)).collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = media.padded(b)
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.width % 8 == 0 and r.feature.startswith(f"{r.width}x{r.height}:") and len(p) % 64 == 0
    same = Counter((r.feature, r.media_sha256) for r in media.features(media.with_media(odd)).collect())
    assert sorted(same.values()) == [1, 2, 3] and media.features(media.with_media(empty)).count() == 0


def test_jpeg_bytes_round_trip():
    rng = np.random.default_rng(1)
    data = []
    for n in (0, 1, 64, 65, 640, 5000, 200_000):
        for zeros in (0, 0.9, 0.99):
            some = rng.integers(0, 256, n, dtype=np.uint8)
            some[rng.random(n) < zeros] = 0
            data.append(media.padded(some.tobytes()))
    streams = media.encode(data)
    assert streams[4] == media.encode(data[4:5])[0]
    assert [media.payload(i, c) for i, c in media.read(streams)] == data


def test_jpeg_decodes_runs_and_differences():
    """A hand-made grey stream of two blocks without restarts: DC 40 then 35, one AC after a run of two zeros."""
    bits = ""
    bits += "10" + format(40, "06b") + "0" + "1" + "10"  # DC size 6; AC run 2, size 1, value 1; end of block
    bits += "0" + format(7 - 5, "03b") + "10"  # DC difference -5 of size 3; end of block
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    dc = b"\0" + bytes([1, 1] + [0] * 14) + bytes([3, 6])
    ac = b"\x10" + bytes([1, 1] + [0] * 14) + bytes([0x21, 0x00])
    head = media._segment(0xDB, b"\0" + b"\x08" * 64) + media._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x11\0") + media._segment(0xC4, dc + ac) + media._segment(0xDA, b"\x01\x01\0\0\x3f\0")
    image, c = media.read([b"\xff\xd8" + head + scan + b"\xff\xd9"])[0]
    assert c[:, 0].tolist() == [40, 35] and c[0, 3] == 1 and np.count_nonzero(c) == 3
    assert media.thumbnail(image, c).tolist() == [[168, 163]]
    with pytest.raises(ValueError):
        media.read([b"\xff\xd8" + head + scan[:1] + b"\xff\xd9"])


def labelled(seed=0, n=500):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "th", "on", "ti", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    texts, quality_, toxic = [], [], []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w]
        mean = rng.random() < 0.3
        if mean:
            w.insert(rng.randrange(len(w)), rng.choice(["stupid", "moron", "clown"]))
        texts.append(" ".join(w).encode())
        quality_.append(int(not bad))
        toxic.append(int(mean))
    return texts, quality_, toxic


def test_quality_learns():
    texts, y, _ = labelled()
    model = quality.Model()
    model.fit(texts[:400], y[:400], epochs=60)
    assert np.mean((model.scores(texts[400:]) >= 0.7) == np.array(y[400:])) > 0.95
    assert 0 <= model.scores([b""])[0] <= 1 and model.temperature > 0


def test_toxicity_learns_and_tolerates_gaps():
    texts, _, y = labelled(1, 600)
    model = toxicity.Model()
    model.fit(texts[:450], y[:450])
    assert np.mean((model.scores(texts[450:]) >= 0.3) == np.array(y[450:])) > 0.95
    clean = [t for t, l in zip(texts[450:], y[450:], strict=True) if not l][:10]
    for form in (b"stupid", b"s t u p i d", b"st-up.id", b"stuppid", b"STUPID!!", b"s.t.u.p.i.d", b"stup1d"):
        hit = model.scores([t + b" " + form + b" anti" for t in clean])
        assert np.mean(hit >= 0.3) > 0.8, form
    assert np.mean(model.scores(clean) >= 0.3) < 0.2
    k = toxicity.kernel(["stupid", "stuxpid", "anther"], ["stupid"])[:, 0]
    assert k[0] == pytest.approx(1) and k[0] > k[1] > 0.4 > k[2]


def test_classifiers_over_tables(spark, docs, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(61)] + [(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        model = module.fit(docs, labels)
        for df, n in ((docs, 60), (odd, 6), (empty, 0)):
            found = quality.scored_digest(df, model, module.THRESHOLD).collect()
            assert len(found) == n
            for r in found:
                assert 0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD)
                assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if module is quality:
            assert quality.scored(docs, model).columns == [c for c in docs.columns if c != "score"] + ["score"] and quality.scored(odd, model).count() == 6
        none = module.fit(docs, labels.limit(0))
        assert none.scores([b"x"]).tolist() == [0.5]


def test_training_leaves_held_out_rows_alone(spark, docs):
    from shapewright.llm.labelled import training

    labels = spark.createDataFrame([(i, 1, 0) for i in range(61)], "doc_id bigint, quality int, toxic int")
    texts, y = training(docs, labels, "quality")
    assert len(texts) == sum(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in docs.collect()) and set(y) == {1}
    assert 0 < len(training(docs, labels, "quality", rows=5)[0]) <= 5


def test_mixing_query_counts_the_built_mix(spark, odd, tmp_path, monkeypatch):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    whole = mixing.shuffled
    monkeypatch.setattr(mixing, "shuffled", lambda mix: seen.append(mix.columns) or whole(mix))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        found = mixing.query(spark, folder).collect()
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        sized, rows = mixing.plan(docs)
        limit = {r[0]: (r[3], r[4]) for r in rows}
        want = [(r.doc_id, r["size"], r["size"] * (limit[r.source][0] + (r.key < limit[r.source][1]))) for r in sized.collect()]
        assert sorted(map(str, ((r.doc_id, r["size"], r.taken) for r in found))) == sorted(map(str, want))
    assert len(seen) == 2 and all({"_shard", "_order"} <= set(c) for c in seen)


def test_toxicity_scores_decorated_spelled_strings():
    model = toxicity.Model()
    model.scores_of = toxicity._Scores(np.zeros(toxicity._LETTERS**3), 0.0)
    model.scores_of.of = lambda strings: np.array([float(s == toxicity.string_of(b"idiot")) for s in strings])
    for text in (b"*i* *d* *i* *o* *t*", b"i d i o t", b"-i- d. *i* o! t"):
        toxicity._scored_by.clear()
        assert model.features([text])[0][0] == 1


def test_pseudo_likelihood(spark, docs, odd, empty):
    model = pseudo_likelihood.trained(docs)
    found = {r.doc_id: r for r in pseudo_likelihood.scored(docs, model).collect()}
    for r in docs.collect():
        assert found[r.doc_id].n_words == len((r.text or "").encode().split()) and found[r.doc_id].score <= 0
        assert (found[r.doc_id].score == 0) == (found[r.doc_id].n_words == 0)
    assert pseudo_likelihood.scored(odd, model).count() == 6
    blank = pseudo_likelihood.trained(empty)
    assert pseudo_likelihood.scored(empty, blank).count() == 0


def test_pseudo_likelihood_learns_both_sides():
    rng = np.random.default_rng(0)
    order = np.concatenate([np.concatenate([[4 * j, 4 * j + 1, 4 * j + 2, 4 * j + 3] for j in rng.permutation(3)]) for _ in range(400)])
    model = pseudo_likelihood.Model(np.zeros(0, np.uint64), np.bincount(order, minlength=pseudo_likelihood.SLOTS))
    laid = model.place[order].astype(np.int32)
    at = np.arange(2, len(laid) - 2)
    windows = laid[at[:, None] + pseudo_likelihood._AROUND]
    before = model.log_probability(windows, laid[at]).mean()
    for _ in range(15):
        for lo in range(0, len(at), 256):
            model.learn(windows[lo : lo + 256], laid[at[lo : lo + 256]])
    assert model.log_probability(windows, laid[at]).mean() > before + 1.5


def test_pseudo_likelihood_learns_from_every_word(spark):
    cycle = " ".join(f"w{i}" for i in range(12))  # a stride of 12 or 24 words would see w0 alone as a target
    docs = spark.createDataFrame([(i, cycle) for i in range(40_000)], "doc_id bigint, text string").coalesce(1)
    found = pseudo_likelihood.scored(docs, pseudo_likelihood.trained(docs)).first()
    assert found.n_words == 12 and found.mean_score > np.log(1 / 12) + 0.5


def test_pseudo_likelihood_against_a_plain_pass(spark, docs):
    """Scores as sums over words, each by plain softmaxes over all slots; counts are exact."""
    model = pseudo_likelihood.trained(docs.select("doc_id", "text"))
    e, w1, b1, wc, bc, ws, bs = (w.astype(np.float64) for w in model.weights[:7])
    head, each = pseudo_likelihood.HEAD, pseudo_likelihood.EACH
    texts = {r.doc_id: (r.text or "").encode().split() for r in docs.collect()}
    counts = Counter(pseudo_likelihood._core(w) for t in texts.values() for w in t)
    import xxhash

    def slot(word):
        return int(pseudo_likelihood.slots_of(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64), model.own)[0])

    assert sum(counts.values()) == model.mass.sum() - pseudo_likelihood.SLOTS / 2
    found = {r.doc_id: r for r in pseudo_likelihood.scored(docs, model).collect()}
    for i in sorted(texts)[:12]:
        cores = [pseudo_likelihood._core(w) for w in texts[i]][:300]
        if len(cores) != len(texts[i]):
            continue
        places = [model.place[slot(c)] for c in cores]
        padded = [pseudo_likelihood.SLOTS] * 2 + places + [pseudo_likelihood.SLOTS] * 2
        score = 0.0
        for k, (core, place) in enumerate(zip(cores, places, strict=True)):
            h = np.tanh(np.concatenate([e[padded[k + 2 + d]] for d in (-2, -1, 1, 2)]) @ w1 + b1)
            z = h @ wc + bc
            of = place if place < head else head + (place - head) // each
            score += z[of] - np.log(np.exp(z).sum())
            if place >= head:
                q = h @ ws[of - head] + bs[of - head]
                score += q[(place - head) % each] - np.log(np.exp(q).sum())
            score += np.log(counts[core] / model.mass[slot(core)])
        assert found[i].score == pytest.approx(score, rel=1e-4, abs=1e-3)


def test_pseudo_likelihood_counts_words_exactly_and_tells_words_apart(spark):
    docs = spark.createDataFrame([(0, " ".join(f"x{i}" for i in range(60_000))), (1, "x1 x1 X2."), (2, None)], "doc_id bigint, text string")
    there = pseudo_likelihood.encoded(docs)
    counts = pseudo_likelihood.counted(there)
    rows = [(k, n) for r in counts.filter("kind = 1").collect() for k, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["counts"], "<i8").tolist(), strict=True)]
    assert len(rows) == len(dict(rows)) == 60_000 and Counter(n for _, n in rows) == {1: 59_998, 2: 1, 3: 1}
    # of equal counts, told apart by their neighbours only
    rng = np.random.default_rng(0)
    pairs = [f"a{i} b{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(pairs[j] for j in rng.permutation(400))) for i in range(1200)], "doc_id bigint, text string").coalesce(1)
    found = pseudo_likelihood.scored(docs, pseudo_likelihood.trained(docs)).first()
    assert found.mean_score > np.log(1 / 800) + 0.1


def test_pseudo_likelihood_reruns_agree(spark, docs):
    a, b = (sorted(tuple(r) for r in pseudo_likelihood.scored(docs, pseudo_likelihood.trained(docs)).select(F.coalesce("doc_id", F.lit(-1)), "score").collect()) for _ in range(2))
    assert a == b


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(1)
    model = pseudo_likelihood.Model(np.zeros(0, np.uint64), rng.integers(0, 9, pseudo_likelihood.SLOTS))
    model.weights = [w + rng.normal(0, 0.2, w.shape).astype(np.float32) for w in model.weights]
    every = np.arange(pseudo_likelihood.SLOTS)
    window = np.tile([1, 2, 3, pseudo_likelihood.SLOTS], (len(every), 1))
    assert np.exp(model.log_probability(window, every)).sum() == pytest.approx(1, abs=1e-3)


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (5, 5), (None, 4), (6, None), (9, 8), (9, 8)], "a bigint, b bigint")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def test_training_rows_of_odd_tables(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    docs = spark.createDataFrame([(ids[0], "a"), (ids[0], "b"), (ids[1], None), (None, "c"), (ids[2], "d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[0], 0), (ids[1], 1), (None, 1), (ids[2], None), (ids[3], 1)], "doc_id bigint, toxic int")
    assert sorted(zip(*labelled_rows.training(docs, labels, "toxic"), strict=True)) == [(b"", 1), (b"a", 0)]
    assert labelled_rows.training(docs.limit(0), labels, "toxic") == ([], [])


@pytest.mark.parametrize("rows_of", ["odd", "none"])
def test_pipeline_of_odd_tables(spark, odd, empty, tmp_path, rows_of):
    import corpus_pipeline

    docs = (odd if rows_of == "odd" else empty).select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows_of == "odd" or out == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        docs.write.parquet(path := str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    texts = docs.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert out.groupby("sequence_id").length.sum().max() <= 2048
    assert Counter(out[out.piece == 0].doc_id) == Counter(r.doc_id for r in texts)
    assert len(ids[2]) == len(set(brute_roots({r.doc_id: brute_print(r.text) for r in spark.read.parquet(str(tmp_path / "quality-classifier")).collect()}).values()))


def test_query_names():
    from shapewright import llm

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.queries()) == list(range(1, 14))
