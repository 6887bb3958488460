"""Toxicity: a subsequence string-kernel machine with Nystroem landmarks.

The kernel compares two strings by the subsequences of three letters that they share, with gaps: each occurrence that spans s
letters weighs DECAY ** s, up to a span of SPAN. So strings with inserted or missing letters stay close. A string is a word's letters, lower
case, with digits read as the letters they stand for; single letters that follow each other are one string, so that spaced-out insults count.

Labels are of documents; the machine learns on their sentences. A sentence is represented by its most toxic string. Landmarks are
strings that labelled documents differ in, and common ones. In each round sentences of toxic documents give their best string and
other documents all strings that come close; the hinge loss is minimised over Nystroem features. As a kernel with explicit features,
the machine folds into one weight for each gapped triple of letters, so a string is scored by some fifty lookups. A logistic
layer over a document's best strings and its number of words gives the probability.

Null and empty texts are scored as a document without strings. Equal rows give equal rows. Other columns play no part. An empty
table gives no rows; without labels of both kinds every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ._common import sole
from .labelled import TRAIN_ROWS, training

DECAY, SPAN, LONGEST = 0.7, 5, 28
LANDMARKS, ROUNDS, THRESHOLD, SEED = 240, 4, 0.3, 11
CACHE_WORDS = 600_000
#: Log-likelihood ratio from which a string tells toxic sentences.
PROOF = 9.0

_LETTERS = 64
_DIGITS = str.maketrans("013457", "oieast")
_OTHER = re.compile(r"[\W_0-9]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Offsets of the second and third letter of a subsequence.
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def string_of(word: bytes) -> str:
    text = word.decode().lower()
    if text.isalpha():
        return text
    if text.isascii() and not text.isalnum():
        core = text.strip(".,;:!?*&%$#|\"'()")
        if core.isalpha():
            return core
    letters = _OTHER.sub("", text.translate(_DIGITS)) if any(c.isalpha() for c in text) else ""
    return letters


class _Strings(dict):
    """word -> its string, the same object for equal strings."""

    def __init__(self) -> None:
        super().__init__()
        self.same: dict[str, str] = {}

    def __missing__(self, word: bytes) -> str:
        s = string_of(word)
        self[word] = found = self.same.setdefault(s, s)
        return found


def _spelled(strings: list[str]) -> np.ndarray:
    """Letters of strings as numbers: 63 for the beginning, which counts as a letter, then 1 to 62, and 0 beyond the end."""
    longest = max(map(len, strings), default=0) + 1
    text = "".join([("\1" + s).ljust(longest + SPAN - 1, "\0") for s in strings])
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(strings), -1)
    return np.where(points < 2, points * (_LETTERS - 1), np.where((points >= 97) & (points <= 122), points - 96, 27 + points * 7 % 36))


def _triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """codes and weights of all gapped triples, a row for each string; weight 0 pads. A row's weights have norm 1."""
    x = _spelled(strings)
    long = x.shape[1] - SPAN + 1
    codes, weights = [], []
    for a, b in _GAPS:
        n = max(0, long - b)
        third = x[:, b : n + b]
        codes.append((x[:, :n] * _LETTERS + x[:, a : n + a]) * _LETTERS + third)
        weights.append(np.where(third > 0, DECAY ** (b + 1), 0.0))
    w = np.hstack(weights)
    return np.hstack(codes), w / np.maximum(np.sqrt((w * w).sum(axis=1, keepdims=True)), 1e-9)


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, strings x landmarks."""
    lc, lw = _triples(landmarks)
    names, where = np.unique(lc, return_inverse=True)
    table = np.zeros((len(names) + 1, len(landmarks)))
    np.add.at(table, (where.reshape(lc.shape), np.arange(len(landmarks))[:, None]), lw)
    out = np.zeros((len(strings), len(landmarks)))
    for lo in range(0, len(strings), 512):
        c, w = _triples(strings[lo : lo + 512])
        at = np.searchsorted(names, c)
        at[(at == len(names)) | (names[np.minimum(at, len(names) - 1)] != c)] = len(names)
        for k in range(c.shape[1]):
            some = np.flatnonzero(w[:, k])
            out[lo + some] += w[some, k, None] * table[at[some, k]]
    return out


class _Scores(dict):
    """string -> its score; short strings score the least."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias, self.least = weights, bias, -3.0

    def of(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.least)
        order = sorted((i for i, s in enumerate(strings) if 3 <= len(s) <= LONGEST), key=lambda i: len(strings[i]))
        for lo in range(0, len(order), 1024):
            some = order[lo : lo + 1024]
            c, w = _triples([strings[i] for i in some])
            out[some] = (w * self.weights[c]).sum(axis=1) + self.bias
        for i, s in enumerate(strings):
            if len(s) > LONGEST:  # the best of overlapping windows
                windows = [s[k : k + LONGEST] for k in range(0, len(s) - SPAN, LONGEST // 2)]
                out[i] = self.of(windows).max()
        return out


def _joined(words: list[bytes]) -> list[bytes]:
    """Strings that runs of single letters spell."""
    out, run = [], []
    for w in [*words, b"-----"]:
        if len(w) > 4:
            if run:
                if len(run) >= 3:
                    out.append(b"".join(run))
                run = []
            continue
        core = w.strip(b".,;:!?*-_|")
        n = len(core)
        if n == 1 or (1 < n <= 4 and len(core.decode()) == 1):
            run.append(core)
            continue
        if len(run) >= 3:
            out.append(b"".join(run))
        run = []
    return out


_scored: dict[bytes, float] = {}
_scored_by: list = []


def _known(model: Model) -> dict[bytes, float]:
    """This process's scores of words by the model that it used last."""
    if not _scored_by or _scored_by[0] is not model:
        _scored.clear()
        _scored_by[:] = [model]
    sole(_scored)
    return _scored


class Model:
    def __init__(self) -> None:
        self.base: float | None = 0.5

    def fit(self, texts: list[bytes], labels: list[int]) -> None:
        y = np.array(labels)
        if not 0 < y.sum() < len(y):
            self.base = float(y.mean()) if len(y) else 0.5
            return
        self.base = None
        rng = np.random.default_rng(SEED)
        # strings of each document's sentences
        sentences: list[list[list[str]]] = []
        shared = _Strings()
        for text in texts:
            own = []
            for s in _SENTENCE.split(text.decode()):
                words = s.encode().split()
                strings = {x for x in map(shared.__getitem__, words + _joined(words)) if 3 <= len(x) <= LONGEST}
                if strings:
                    own.append(sorted(strings))
            sentences.append(own)
        del shared
        # counted by distinct sentences, so that copies of a document count once
        in_toxic, in_clean = Counter(), Counter()
        seen: set[tuple[str, ...]] = set()
        for t, own in zip(y, sentences, strict=True):
            for strings in own:
                if (key := tuple(strings)) not in seen:
                    seen.add(key)
                    (in_toxic if t else in_clean).update(strings)
        n1, n0 = max(1, sum(in_toxic.values())), max(1, sum(in_clean.values()))
        part = n1 / (n1 + n0)

        def evidence(s: str) -> float:
            """Log-likelihood ratio of the string's own share of toxic sentences against the overall one; below 0 if it is less."""
            k, n = in_toxic[s], in_toxic[s] + in_clean[s]
            if k <= part * n:
                return -1.0
            return k * np.log(k / n / part) + ((n - k) * np.log((1 - k / n) / (1 - part)) if k < n else 0.0)

        proof = {s: evidence(s) for s in in_toxic}
        rank = sorted(in_toxic, key=lambda s: (-proof[s], s))
        strong = {s for s in rank if proof[s] > PROOF and in_toxic[s] > 0.6 * (in_toxic[s] + in_clean[s])}
        telling = [s for s in rank if s in strong][: LANDMARKS // 2]
        common = [s for s, _ in sorted(in_clean.items(), key=lambda kv: (-kv[1], kv[0]))[: LANDMARKS - len(telling)]]
        landmarks = [*dict.fromkeys(telling + common)]
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks) + 1e-3 * np.eye(len(landmarks)))
        self.map = vectors / np.sqrt(np.maximum(values, 1e-6))
        lc, lw = _triples(landmarks)

        def fold(w: np.ndarray, bias: float) -> _Scores:
            """The machine as one weight for each triple."""
            alpha = self.map @ w
            table = np.zeros(_LETTERS**3)
            np.add.at(table, lc, lw * alpha[:, None])
            return _Scores(table, bias)

        everything = sorted(set(in_toxic) | set(in_clean))
        place = {s: i for i, s in enumerate(everything)}
        prior = np.array([proof[s] if s in strong else -10.0 for s in everything])
        clean = np.array([place[s] for s in sorted(in_clean)])
        score = prior
        negatives = set(rng.choice(clean, min(3000, len(clean)), replace=False).tolist())
        for step in range(ROUNDS):
            witness: Counter = Counter()
            for t, own in zip(y, sentences, strict=True):
                if not t or not own:
                    continue
                best = [max((place[s] for s in s_), key=lambda i: (score[i], -i)) for s_ in own]
                chosen = [i for i in best if score[i] > 0] or ([max(best, key=lambda i: (score[i], -i))] if step else [])
                witness.update(i for i in chosen if in_clean[everything[i]] <= in_toxic[everything[i]] / 2)
            hard = clean[np.argsort(-score[clean], kind="stable")[:2000]] if step else clean[:0]
            negatives |= set(hard.tolist())
            negatives -= set(witness)
            pos, neg = sorted(witness), sorted(negatives)
            if not pos or not neg:
                break
            phi = kernel([everything[i] for i in pos + neg], landmarks) @ self.map
            target = np.array([1.0] * len(pos) + [-1.0] * len(neg))
            weight = np.concatenate([np.log1p([witness[i] for i in pos]), np.log1p([in_clean[everything[i]] for i in neg])])
            weight[: len(pos)] *= 0.5 / weight[: len(pos)].sum()
            weight[len(pos) :] *= 0.5 / weight[len(pos) :].sum()
            w, bias = _hinge(phi, target, weight)
            self.scores_of = fold(w, bias)
            score = self.scores_of.of(everything)
        else:
            score = self.scores_of.of(everything)
        if not hasattr(self, "scores_of"):
            self.scores_of = _Scores(np.zeros(_LETTERS**3), 0.0)
        x = self.features(texts)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.logit = _logistic((x - self.mean) / self.scale, y)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Best three strings' scores, how many are above the margin, and the number of words."""
        known, scorer = _known(self), self.scores_of
        lists, missing = [], set()
        for text in texts:
            words = text.split()
            n = len(words)
            distinct = set(words)
            if sum(len(w) <= 4 for w in words) >= 3:  # longer ones aren't letters for _joined()
                distinct.update(_joined(words))
            lists.append((distinct, n))
            missing.update(w for w in distinct if w not in known)
        if missing:
            if len(known) + len(missing) > CACHE_WORDS:
                known.clear()
                missing = set().union(*(d for d, _ in lists))
            order = list(missing)
            known.update(zip(order, scorer.of([string_of(w) for w in order]).tolist(), strict=True))
        out = np.empty((len(texts), 5))
        for i, (distinct, n) in enumerate(lists):
            values = sorted(map(known.__getitem__, distinct))
            top = (values[:-4:-1] + [scorer.least] * 3)[:3]
            out[i] = (*(max(-3.0, min(3.0, v)) for v in top), min(5, sum(v > 0 for v in values[-8:])), np.log1p(n))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.logit[:-1] + self.logit[-1], -50, 50)))


def _hinge(phi: np.ndarray, target: np.ndarray, weight: np.ndarray, c: float = 1000.0, steps: int = 500) -> tuple[np.ndarray, float]:
    """Linear machine under a smoothed, weighted hinge loss, by accelerated gradient steps."""
    x = np.hstack([phi, np.ones((len(phi), 1))])
    w = np.zeros(x.shape[1])
    v, t = w.copy(), 1.0
    rate = 1 / (1 + 2 * c * np.linalg.norm((x * weight[:, None]).T @ x, 2))
    for _ in range(steps):
        slack = np.maximum(0, 1 - target * (x @ v))
        grad = np.append(v[:-1], 0.0) - 2 * c * x.T @ (weight * target * slack)
        new = v - rate * grad
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Newton steps for a logistic layer."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + decay * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + decay * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model, fitted on the driver on at most ``rows`` labelled documents."""
    model = Model()
    model.fit(*training(docs, labels, "toxic", rows))
    sole()
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every whole text of ``documents``."""
    from .quality import scored_digest

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored_digest(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), THRESHOLD)
