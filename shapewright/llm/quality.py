"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Every word is a hashed form and a shape (runs of upper case, lower case, digits; other characters as they are). Each form and shape has a
sparse random index vector. A word's vector is its own index vector plus those of the words and shapes around it in the training
texts. A document pools (averages) the vectors of all its words, forms and shapes apart, beside four plain ratios. The network's
logit is divided by a temperature fitted on training rows that the network didn't see.

Null and empty texts are scored as a document without words. Equal rows give equal rows. Other columns play no part. An empty
table gives no rows; without labels of both kinds every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import blocks, raw, ship, sole
from .labelled import TRAIN_ROWS, held_out, training

FORMS, SHAPES, DIM, SHAPE_DIM, HIDDEN = 1 << 14, 1 << 9, 64, 32, 32
THRESHOLD, SEED = 0.7, 7
CACHE_WORDS = 300_000
_AROUND = 2
_RUNS = ((re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^Xx9])\1+"), rb"\1"))


class Words(dict):
    """word (bytes) -> form + FORMS * shape."""

    def __missing__(self, word: bytes) -> int:
        shape = word
        for pattern, to in _RUNS:
            shape = pattern.sub(to, shape)
        form = word.lower().strip(b".,;:!?*&%$#|\"'()")
        code = zlib.crc32(form) % FORMS + FORMS * (zlib.crc32(shape) % SHAPES)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code
        return code


_words = Words()


def index_vectors(n: int, dim: int, seed: int, ones: int = 6) -> np.ndarray:
    """Sparse ternary vectors."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    for sign in (1, -1):
        for _ in range(ones // 2):
            out[np.arange(n), rng.integers(0, dim, n)] = sign
    return out


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words, where each text begins, and four ratios of each text."""
    sole(_words)
    parts, sizes, plain = [], [], []
    for text in texts:
        words = text.split()
        n = len(words)
        c = np.fromiter(map(_words.__getitem__, words), np.int64, n)
        parts.append(c)
        sizes.append(n)
        m = max(1, n)
        plain.append((np.log1p(n) / 10, len(set(words)) / m, np.count_nonzero(c[1:] == c[:-1]) / m, len(text) / m / 10 if n else 0.0))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum([0, *sizes]), np.array(plain, np.float32).reshape(-1, 4)


class Model:
    """Word vectors and the network."""

    def __init__(self) -> None:
        self.forms = index_vectors(FORMS, DIM, SEED)
        self.shapes = index_vectors(SHAPES, SHAPE_DIM, SEED + 1)
        self.base: float | None = 0.5

    def learn_words(self, word_codes: np.ndarray, starts: np.ndarray) -> None:
        """Random indexing: add up the index vectors around each occurrence, normalise, and keep the own one in front."""
        own, shape_index = self.forms.copy(), index_vectors(SHAPES, DIM, SEED + 2)
        around = np.zeros_like(own)
        form, shape = word_codes % FORMS, word_codes // FORMS
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        step = 1 << 15
        for lo in range(0, len(form), step):
            hi = min(len(form), lo + step)
            for back in range(1, _AROUND + 1):
                a = np.arange(max(lo, back), hi)
                a = a[text[a] == text[a - back]]
                np.add.at(around, form[a], own[form[a - back]] + shape_index[shape[a - back]])
                np.add.at(around, form[a - back], own[form[a]] + shape_index[shape[a]])
        size = np.linalg.norm(around, axis=1, keepdims=True)
        self.forms = own / 6**0.5 + np.divide(around, size, out=np.zeros_like(around), where=size > 0)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text."""
        c, starts, plain = codes(texts)
        sums = np.zeros((len(texts), DIM + SHAPE_DIM), np.float32)
        some = np.flatnonzero(np.diff(starts))
        form, shape = c % FORMS, c // FORMS
        step = 1 << 15
        for lo in range(0, len(c), step):
            hi = min(len(c), lo + step)
            first = int(np.searchsorted(starts, lo, side="right")) - 1
            last = int(np.searchsorted(starts, hi, side="left"))
            mine = some[(some >= first) & (some < last)]
            at = np.maximum(starts[mine], lo) - lo
            sums[mine, :DIM] += np.add.reduceat(self.forms[form[lo:hi]], at, axis=0)
            sums[mine, DIM:] += np.add.reduceat(self.shapes[shape[lo:hi]], at, axis=0)
        return np.hstack([sums / np.maximum(1, np.diff(starts))[:, None], plain])

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 150, rate: float = 0.01, decay: float = 1e-3) -> None:
        y = np.array(labels, np.float32)
        if not 0 < y.sum() < len(y):
            self.base = float(y.mean()) if len(y) else 0.5
            return
        self.base = None
        c, starts, _ = codes(texts)
        self.learn_words(c, starts)
        x = self.pooled(texts)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        tune, train = order[: len(y) // 5], order[len(y) // 5 :]
        shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
        p = [rng.normal(0, s[0] ** -0.5, s).astype(np.float32) if len(s) == 2 or i == 2 else np.zeros(s, np.float32) for i, s in enumerate(shape)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        t = 0
        for _ in range(epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), 256):
                b = train[lo : lo + 256]
                h = np.tanh(x[b] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[b]) / len(b)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [x[b].T @ back + decay * p[0], back.sum(axis=0), h.T @ e + decay * p[2], e.sum()]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = (p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.params = p
        logits = np.tanh(x[tune] @ p[0] + p[1]) @ p[2] + p[3]
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, np.where(y[tune] > 0, -1, 1) * logits / g)) for g in grid] if len(tune) else [0]
        self.temperature = float(grid[int(np.argmin(loss))])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        x = (self.pooled(texts) - self.mean) / self.scale
        p = self.params
        z = (np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model, fitted on the driver on at most ``rows`` labelled documents."""
    model = Model()
    model.fit(*training(docs, labels, "quality", rows))
    sole()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score; docs may have any other columns, and a score that they have is replaced."""
    spark = docs.sparkSession
    docs = docs.drop("score")
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # tables of fixed size: about 4 MB
    columns = docs.columns
    at = columns.index("text")
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(raw(batch.column(at))), pa.float64())], [*columns, "score"])

    return docs.mapInArrow(run, f"{schema}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored_digest(docs, model, THRESHOLD)


def scored_digest(docs: DataFrame, model, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted: without the texts, which stay with the executors."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            score = sent.value.scores(raw(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
