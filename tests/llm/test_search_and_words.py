"""Collocations, fingerprints and spelling variants against brute force, and their rules for odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shapewright.llm import _common, collocations, fingerprints, mixing, pseudo_likelihood, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, rank int, n long, word string, fp string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=80, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["of", "the", "The", "a\x00b", "a\x01", "a", "×÷"]
    weights = [1] * 40 + [12, 12, 3, 1, 1, 2, 1]
    made = []
    for _ in range(n):
        parts = rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 120]))
        made.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0b", "!"]) for w in parts))
    made[4], made[5], made[6], made[7] = None, "", " \n ", made[3]
    made[8] = " ".join(rng.choices(words, weights, k=20_000))
    return [(i * 7 % 83, t, rng.choice(["en", "en", "de", None, "und"]), None, 1, 2, "x", "y") for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# collocations


def brute_counts(rows, longest=4):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return f, total


def brute_collocations(rows, least, top, shadow):
    f, total = brute_counts(rows)
    found = {}
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], score)
    out = []
    inside = Counter()
    for (lang, w), (a, *_) in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for lang in total:
        mine = [(-s, -a, " ".join(w).encode(), l_, r) for (g, w), (a, l_, r, s) in found.items() if g == lang and not (inside[g, w] and 100 * inside[g, w] >= shadow * a)]
        for rank, (s, a, phrase, l_, r) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l_, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("heavy", [400, 20, 3])
def test_collocations(docs, rows, heavy, monkeypatch):
    monkeypatch.setattr(collocations, "HEAVY", heavy)  # the smaller, the more prefixes are spread
    for least, top, shadow in ((5, 2000, 80), (2, 30, 50)):
        got = sorted(tuple(r) for r in collocations.collocations(docs, least, top, shadow).collect())
        assert got == brute_collocations(rows, least, top, shadow)


def test_phrase_counts(docs, rows):
    f, total = brute_counts(rows)
    want = {(lang, len(w), " ".join(w), n) for (lang, w), n in f.items() if n >= 3} | {(lang, 0, "", n) for lang, n in total.items() if n}
    assert {tuple(r) for r in collocations.phrase_counts(docs, 3).collect()} == want


def test_wide_vocabularies_are_cut(monkeypatch):
    monkeypatch.setattr(collocations, "_WIDE", 4)
    texts = [b"a b c d e f g h i j k l m n o p q r s t. u v w x y z", b"a b c"]
    parts = list(collocations._numbered(*collocations._tokens(texts), 3))
    got = [tuple(names[i].as_py() for i in row if i) for names, rows in parts for row in rows.T]
    words = "a b c d e f g h i j k l m n o p q r s t".split(), "u v w x y z".split(), "a b c".split()
    assert got == [tuple(x.encode() for x in w[i : i + 3]) for w in words for i in range(len(w))]


# fingerprints


def one(text):
    return fingerprints.fingerprints(pa.array([text]))[0]


def test_fingerprints_vote():
    """Against votes counted one by one."""
    rng = random.Random(1)
    for n in (0, 1, 2, 30, 3000):
        text = " ".join(rng.choice(["aa", "bb", "Cc", "é", "ddd"]) + rng.choice(["", "x", "y"]) for _ in range(n))
        words = text.lower().split()
        h = {w: fingerprints.xxhash.xxh64_intdigest(w.encode()) for w in words}
        pairs = Counter(int(fingerprints._mixed(np.array([h[a]], np.uint64) * fingerprints._PAIR + np.array([h[b]], np.uint64))[0]) for a, b in zip(words, words[1:], strict=False))
        votes = [0] * 64
        for counts, weight in ((Counter(h[w] for w in words), 1), (pairs, 2)):
            for x, k in counts.items():
                for b in range(64):
                    votes[b] += weight * k.bit_length() * (1 if x >> b & 1 else -1)
        assert one(text) == sum(1 << b for b in range(64) if votes[b] > 0)


def brute_edits(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append(t or "")
    order = sorted(by, key=lambda i: -1e9 if i is None else i)
    following = {i: min(by[order[k - 1]], key=str.encode) for k, i in enumerate(order)}
    out = []
    for i, t, *_ in rows:
        t, other = t or "", following[i]
        k = len(t) // 3
        new = t[: len(t) - k] + other[:k]
        fp, new_fp, other_fp = one(t), one(new), one(other)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp, new_fp, like(fp, new_fp), like(fp, other_fp)))
    return sorted(out, key=repr)


def test_edited_texts(spark, docs, rows, empty):
    got = lambda df: sorted(((r[0], r[1], r[2], r[3] % (1 << 64), r[4] % (1 << 64), r[5], r[6]) for r in fingerprints.with_edited(df).collect()), key=repr)
    assert got(docs) == brute_edits(rows)
    odd = [(None, "b c", None), (None, "a b c d", None), (3, "x y z w", None), (3, "x y z w", None), (3, "q r", None), (9, None, None), (1, "", None)]
    assert got(spark.createDataFrame(odd, "doc_id bigint, text string, fp string")) == brute_edits(odd)
    for some in ([(None, "a b c", None)], [(5, "a b c d e f", None)]):
        assert got(spark.createDataFrame(some, "doc_id bigint, text string, fp string")) == brute_edits(some)
    assert got(empty) == []


def test_neighbours(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)] + base[:9] * 3
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    asked = spark.createDataFrame([(x,) for x in signed[::5]], "fp bigint")
    for lot in (fingerprints.LOT, 3):
        monkeypatch.setattr(fingerprints, "LOT", lot)
        for radius, cut in ((3, 5), (0, 1), (2, 3), (4, 6)):
            want = {(a, b, ((a ^ b) % (1 << 64)).bit_count()) for a in set(signed[::5]) for b in set(signed) if 0 < ((a ^ b) % (1 << 64)).bit_count() <= radius}
            got = [tuple(r) for r in fingerprints.neighbours(df, asked, radius, cut).collect()]
            assert len(got) == len(set(got)) and set(got) == want
            near = {r.fp: r.n for r in fingerprints.near_counts(df, asked, radius, cut).collect()}
            assert near == {a: sum(((a ^ b) % (1 << 64)).bit_count() <= radius for b in signed) for a in set(signed[::5])}


# spelling


def brute_words(rows, shortest, least):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= least}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(words, times=10):
    near = {w: [v for v in words if brute_near(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_word_counts(spark, docs, rows, empty):
    for shortest, least in ((1, 1), (7, 2), (3, 2)):
        assert {r.word: r.n for r in spelling.word_counts(docs, shortest, least).collect()} == brute_words(rows, shortest, least)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    odd = [(None, "Abcdefgh abcdefgh"), (1, "abcdefgh"), (1, "abcdefgh"), (2, None)]
    assert {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(odd, "doc_id bigint, text string")).collect()} == brute_words(odd, 7, 2)


@pytest.mark.parametrize(("held", "shard"), [(20_000, 20_000), (2, 5), (1, 1)])
def test_variants(spark, held, shard, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = random.Random(5)
    words = {}
    for _ in range(60):
        w = "".join(rng.choice("aabé÷ÿ") for _ in range(rng.choice([7, 7, 8, 9, 15, 16, 17, 18, 24])))
        words[w] = rng.choice([2, 3, 20, 21, 30, 300, 4000])
        for _ in range(4):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            if len(v) >= 7:
                words[v] = rng.choice([2, 3, 20, 21, 30, 300, 4000])
                w = rng.choice([w, v])
    got = sorted((tuple(r) for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint")).collect()), key=lambda r: r[0])
    assert got == brute_variants(words)


def test_one_edit():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))).encode() for _ in range(120)]
    a, b = zip(*[(x, y) for x in texts for y in texts], strict=True)
    got = spelling._one_edit(spelling._letters(list(a)), np.array([len(x) for x in a]), spelling._letters(list(b)), np.array([len(x) for x in b]))
    assert got.tolist() == [brute_near(x.decode(), y.decode()) for x, y in zip(a, b, strict=True)] == [spelling.within_one(x.decode(), y.decode()) for x, y in zip(a, b, strict=True)]


def test_sums_of_squares_travel_whole():
    """What a task has learnt arrives as it was where it is a sum of squares, however large, and nearly so for weights."""
    rng = np.random.default_rng(1)
    sizes = [(300, 16), (16, 16), (16,), (16, 192), (192,), (64, 16, 256), (64, 256), (16_513,), (64, 2), (4,)]
    moved = [rng.normal(size=n).astype(np.float32) * (1e7 if i >= pseudo_likelihood.SUMS else 1) for i, n in enumerate(sizes)]
    parts, halved = pseudo_likelihood._message(moved), pseudo_likelihood._halved(moved)
    got = np.concatenate([np.frombuffer(p, "<f2" if i < halved else "<f4").astype(np.float32) for i, p in enumerate(parts)])
    at = sum(m.size for m in moved[: pseudo_likelihood.SUMS])
    assert (got[at:] == np.concatenate([m.reshape(-1) for m in moved[pseudo_likelihood.SUMS :]])).all()
    assert np.allclose(got[:at], np.concatenate([m.reshape(-1) for m in moved[: pseudo_likelihood.SUMS]]), rtol=1e-3, atol=1e-4)


def test_probabilities_hold_where_exponentials_would_overflow():
    """Large weights aren't clipped: a lead of ten counts as such at any height, and a step leaves finite weights."""
    model = pseudo_likelihood.Model(np.zeros(0, np.uint64), np.arange(pseudo_likelihood.SLOTS, 0, -1))
    window = np.full((2, 4), pseudo_likelihood.SLOTS)
    for high in (70, 200, -200):
        model.weights[4][:] = high
        model.weights[4][0] = high + 10
        rest = np.log(np.exp(10) + len(model.weights[4]) - 1)
        assert np.allclose(model.log_probability(window, np.array([0, 1])), [10 - rest, -rest], atol=1e-3)
    model.learn(window, np.array([0, pseudo_likelihood.SLOTS - 1]))
    assert all(np.isfinite(w).all() for w in model.weights)


def test_a_word_costs_few_exponentials(monkeypatch):
    """A step's and a score's exponentials for each word, where words are as frequent as a text's."""
    rng = np.random.default_rng(3)
    mass = 1e6 / np.arange(1, pseudo_likelihood.SLOTS + 1) ** 0.9
    model = pseudo_likelihood.Model(np.zeros(0, np.uint64), mass)
    words = rng.choice(pseudo_likelihood.SLOTS, (4096, 5), p=mass / mass.sum())
    made, exp = [], np.exp
    monkeypatch.setattr(pseudo_likelihood.np, "exp", lambda z, *a, **b: made.append(np.size(z)) or exp(z, *a, **b))
    model.learn(words[:, :4], words[:, 4])
    model.log_probability(words[:, :4], words[:, 4])
    assert sum(made) < 2 * 300 * len(words)


def laid_texts(rng, sizes):
    """Slots of texts of these sizes with edges around them, and where words are."""
    at = pseudo_likelihood._places(np.array(sizes))
    laid = np.full(pseudo_likelihood.SIDE + int((np.array(sizes) + pseudo_likelihood.SIDE).sum()), pseudo_likelihood.SLOTS, np.int32)
    laid[at] = np.minimum(rng.zipf(1.2, len(at)) - 1, pseudo_likelihood.SLOTS - 1)
    return laid, at


@pytest.mark.parametrize("sizes", [[1], [0, 3, 0], [40_000], [1] * 700, [31, 32, 33, 1, 0, 64, 20_000, 2]])
def test_steps_have_each_word_once_and_read_neighbours_together(sizes):
    """Each word is a target in one step of one round, between its own neighbours, and takes little more than one embedding in long texts."""
    laid, at = laid_texts(np.random.default_rng(4), sizes)
    laid[at] = np.arange(len(at)) % pseudo_likelihood.SLOTS  # told apart by their neighbours
    around = pseudo_likelihood._AROUND
    found, read = [], 0
    for turn in range(3):
        for near, mine in pseudo_likelihood._steps(laid, at, turn, 3):
            assert 0 < len(mine) <= pseudo_likelihood.BATCH and (np.diff(mine) > 0).all()
            found += np.column_stack([near[mine], near[mine[:, None] + around]]).tolist()
            read += len(near)
    assert sorted(found) == sorted(np.column_stack([laid[at], laid[at[:, None] + around]]).tolist())
    if max(sizes) > 10_000:
        assert read < 1.2 * len(at)


def test_a_step_is_the_plain_gradients():
    """A step over laid texts against plain softmaxes and Adagrad in double precision; ties of neighbours, repeats, both orders of calling."""
    rng = np.random.default_rng(5)
    model = pseudo_likelihood.Model(np.zeros(0, np.uint64), 1e6 / np.arange(1, pseudo_likelihood.SLOTS + 1))
    model.weights = [w + rng.normal(0, 0.2, w.shape).astype(np.float32) if i < pseudo_likelihood.SUMS else w for i, w in enumerate(model.weights)]
    laid, at = laid_texts(rng, [5, 1, 0, 900, 2])
    windows, places = laid[at[:, None] + pseudo_likelihood._AROUND], laid[at]
    assert np.allclose(model.log_probability_at(laid, at), model.log_probability(windows, places), atol=1e-4)
    e, w1, b1, wc, bc, ws, bs = (w.astype(np.float64) for w in model.weights[:7])
    grads = [np.zeros_like(w) for w in (e, w1, b1, wc, bc, ws, bs)]
    head, each = pseudo_likelihood.HEAD, pseudo_likelihood.EACH
    for window, place in zip(windows, places, strict=True):
        x = e[window].reshape(-1)
        h = np.tanh(x @ w1 + b1)
        p = np.exp(h @ wc + bc)
        p /= p.sum()
        p[place if place < head else head + (place - head) // each] -= 1
        back = wc @ p
        grads[3] += np.outer(h, p)
        grads[4] += p
        if place >= head:
            c = (place - head) // each
            q = np.exp(h @ ws[c] + bs[c])
            q /= q.sum()
            q[(place - head) % each] -= 1
            back += ws[c] @ q
            grads[5][c] += np.outer(h, q)
            grads[6][c] += q
        back *= 1 - h * h
        grads[1] += np.outer(x, back)
        grads[2] += back
        np.add.at(grads[0], window, (w1 @ back).reshape(len(window), -1))
    axes = (1, None, None, None, None, (1, 2), 1)
    want = [w - pseudo_likelihood.RATE * g / np.sqrt(np.mean(g * g, axis=a, keepdims=True) + 1e-12) for w, g, a in zip((e, w1, b1, wc, bc, ws, bs), grads, axes, strict=True)]
    before = [w.copy() for w in model.weights]
    model.learn_at(laid, at)
    for got, w in zip(model.weights, want, strict=False):
        assert np.allclose(got, w, atol=2e-3)
    assert np.abs(model.weights[5] - before[5]).max() > 0.1
    after, model.weights = model.weights, before
    model.learn(windows, places)
    assert all(np.allclose(a, b, rtol=1e-3, atol=2e-3) for a, b in zip(model.weights, after, strict=True))


def test_words_are_numbered_by_their_first_core_form():
    """Against a dictionary of words, over texts of odd bytes, empty texts and none but those."""
    rng = random.Random(1)
    for longest in [0] * 3 + [30] * 100:
        texts = [bytes(rng.choice(b"aAb,.( \x00\xff\xc3\xa9\x85\xa0\n") for _ in range(rng.randint(0, longest))) for _ in range(rng.randint(1, 6))]
        forms = {}
        data = [forms.setdefault(pseudo_likelihood._core(w), len(forms)) for text in texts for w in text.split()]
        sizes, got, cores = pseudo_likelihood._numbered(texts)
        assert (sizes.tolist(), got.tolist(), cores) == ([len(t.split()) for t in texts], data, list(forms))


def test_mixing_calls_its_function_in_one_place(spark):
    """Two Python operators in a stage need two workers for each core, which live on and gather every later operator's memory."""
    docs = spark.createDataFrame([(i, "a b c", "abc"[i % 3]) for i in range(60)], "doc_id bigint, text string, source string")
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_workers_caches_of_other_operators_go(monkeypatch):
    """What one operator keeps in a worker is dropped when another begins, and Arrow's freed memory is given back."""
    freed = []
    monkeypatch.setattr(_common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: freed.append(1)})())
    mine, other = {1: 1}, {2: 2}
    _common.sole(mine)
    freed.clear()
    _common.sole(mine)
    assert mine and not freed
    _common.sole(other)
    assert not mine and other and freed
    _common.sole()
