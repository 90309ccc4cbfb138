"""Quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Every word is two terms: its lower-cased core and its shape (case, signs around it, whether it repeats one of the three words before). Terms
are hashed into tables of fixed size. Random indexing gives each term a sparse random index vector; a term's
context vector is the sum of the index vectors around it, over all documents. That sum is one pass whose partial tables are
combined by a grouped sum, so it follows the corpus, while what is broadcast has a fixed size.

A document is the mean of its terms' vectors. A two-layer network (numpy, trained by full-batch gradient steps with a fixed
seed) learns the label; a temperature fitted on a part that it has not seen calibrates its probabilities. It is trained on at most
``MAX_LABELLED`` labelled rows, those with the smallest hashes of their ids.

Learning uses only rows whose crc32 of the id is not divisible by ``FOLDS``; labels, language, source and ids are no input of a score.

Defined results: null, empty and blank texts have the zero vector and so one common score. A null id is held out. Repeated rows get equal
scores; a document with several labels counts with each. Without labels of both kinds every score is the share of label 1, or
one half without any. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import saved
from .text import CACHE, byte_words, extended, pieces

MAX_LABELLED = 20_000
FOLDS = 5
THRESHOLD = 0.3
DIM, NONZERO, REACH = 32, 4, 2
WORDS, SHAPES = 4096, 512
HIDDEN, STEPS, RATE, DECAY = 32, 600, 0.02, 1e-3


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's digits modulo the number of folds; 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def index_vectors(seed: int = 7) -> np.ndarray:
    """A sparse ternary vector per term of both tables; the same everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((WORDS + SHAPES, DIM), np.int8)
    for row in out:
        at = rng.choice(DIM, NONZERO, replace=False)
        row[at] = rng.choice([-1, 1], NONZERO)
    return out


class Terms(dict):
    """Word to (number of its core) * SHAPES + (number of its shape); bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        text = word.decode("utf-8", "replace")
        kinds = []
        for c in text:
            k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if not kinds or kinds[-1] != k:
                kinds.append(k)
        shape = "".join(kinds[:8])
        low = text.lower().strip("#*$%&|<>!.,;:?\"'()[]{}")
        n = xxhash.xxh32_intdigest(low.encode()) % WORDS * SHAPES + xxhash.xxh32_intdigest(shape.encode()) % (SHAPES // 2)
        self[word] = n
        return n


def terms(text: str | None, known: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words' cores, and of their shapes behind them; a repeated word's shape is another one."""
    w = byte_words(text)
    p = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
    core, shape = p // SHAPES, p % SHAPES
    again = np.zeros(len(p), bool)
    for k in (1, 2, 3):
        again[k:] |= p[k:] == p[:-k]
    return core, WORDS + shape + again * (SHAPES // 2)


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Sum of the index vectors within ``REACH`` words of each term, over all documents; scaled to length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = Terms(), index_vectors()
        size = WORDS + SHAPES
        # Pairs of a term and a position of its neighbour's vector, counted in blocks.
        place = np.array([np.flatnonzero(r) for r in index])
        sign = np.take_along_axis(index, place, 1).astype(np.float64)
        sums = np.zeros(size * DIM)

        def add(a, b):
            flat = (a[:, None] * DIM + place[b]).ravel()
            np.add(sums, np.bincount(flat, sign[b].ravel(), size * DIM), out=sums)
        held: list[list[np.ndarray]] = [[], []]
        n = 0

        def flush():
            for side in held:
                t = np.concatenate(side)
                for k in range(1, REACH + 1):
                    a, b = t[k:], t[:-k]
                    inside = (a >= 0) & (b >= 0)
                    a, b = a[inside], b[inside]
                    add(a, b)
                    add(b, a)
        gap = np.full(REACH, -1)
        for whole in batches:
            for batch in pieces(whole, "text"):
                for t in batch.column("text"):
                    for side, x in zip(held, terms(t.as_py(), known)):
                        side += [x, gap]
                    n += len(x)
                    if n > 100_000:
                        flush()
                        held, n = [[], []], 0
        if n:
            flush()
        full = np.flatnonzero(sums.reshape(size, DIM).any(axis=1))
        table = sums.reshape(size, DIM)[full].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(c) for c in table.T]], ["term", *[f"v{i}" for i in range(DIM)]])

    parts = docs.select("text").mapInArrow(run, "term int, " + ", ".join(f"v{i} bigint" for i in range(DIM)))
    # At most WORDS + SHAPES rows reach the driver.
    t = parts.groupBy("term").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toArrow()
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    out[t.column("term").to_numpy()] = np.column_stack([t.column(f"v{i}").to_numpy() for i in range(DIM)])
    long = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(long > 0, long, 1)


def pooled(text: str | None, known: Terms, vectors: np.ndarray) -> np.ndarray:
    """Mean of the context vectors of a text's cores, beside that of its shapes."""
    out = np.zeros(2 * DIM, np.float32)
    for k, t in enumerate(terms(text, known)):
        if len(t):
            seen = np.bincount(t, minlength=WORDS + SHAPES)
            at = np.flatnonzero(seen)
            out[k * DIM:(k + 1) * DIM] = seen[at] @ vectors[at] / len(t)
    return out


class Network:
    """Two layers with a temperature; ``fit`` is deterministic."""

    def __init__(self):
        self.share, self.layers, self.heat = 0.5, None, 1.0

    def _logit(self, x):
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def fit(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, seed: int = 11) -> Network:
        """``apart`` marks rows that only set the temperature."""
        if len(y):
            self.share = float(y.mean())
        if not len(y) or self.share in (0.0, 1.0):
            return self
        if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
            apart = np.zeros(len(y), bool)
        xt, yt = x[~apart].astype(np.float64), y[~apart].astype(np.float64)
        self.mean, self.scale = xt.mean(0), xt.std(0) + 1e-6
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
        z = (xt - self.mean) / self.scale
        m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
        for step in range(1, STEPS + 1):
            h = np.tanh(z @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - yt) / len(yt)
            back = d[:, None] * w[2] * (1 - h * h)
            g = [z.T @ back + DECAY * w[0], back.sum(0), h.T @ d + DECAY * w[2], d.sum()]
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.layers = w
        if apart.any():
            logit, ya = self._logit(x[apart].astype(np.float64)), y[apart]
            heats = np.geomspace(1, 16, 61)  # a perfect fit is no reason to sharpen
            loss = [np.mean(np.logaddexp(0, np.where(ya == 1, -1, 1) * logit / t)) for t in heats]
            self.heat = float(heats[int(np.argmin(loss))])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self._logit(x.astype(np.float64)) / self.heat, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Term vectors of the corpus and the network trained on labelled rows outside the held-out fold."""
    vectors = context_vectors(docs)
    # The smallest hashes are a fixed sample of bounded size, so the list may be broadcast and the vectors collected.
    some = (labels.filter(F.col(label).isin(0, 1) & (fold() != 0)).select("doc_id", F.col(label).alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled))
    some = saved(some, "quality-labels")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = Terms(), shared.value
        for b in batches:
            x = [pooled(t.as_py(), known, v).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(run, "doc_id bigint, y int, x binary")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(max_labelled).toArrow())
    x = np.array([np.frombuffer(r.as_buffer(), np.float32) for r in rows.column("x")]).reshape(-1, 2 * DIM)
    y = rows.column("y").to_numpy()
    apart = np.array([xxhash.xxh32_intdigest(str(i)) % 5 == 0 for i in rows.column("doc_id").to_pylist()], bool)
    return vectors, Network().fit(x, y, apart)


def score(docs: DataFrame, vectors: np.ndarray, network: Network, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus the probability of label 1 for each row."""
    shared, keep = docs.sparkSession.sparkContext.broadcast((vectors, network)), list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms()
        v, net = shared.value
        for whole in batches:
            for b in pieces(whole, text):
                x = np.array([pooled(t.as_py(), known, v) for t in b.column(text)]).reshape(-1, 2 * DIM)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(net.score(x), pa.float64())], [*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, extended(docs, keep, "score double"))
