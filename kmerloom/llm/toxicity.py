"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, materialise

#: Bounds of the fit, which is one task's work: labelled rows, and characters of all their texts.
MAX_ROWS, MAX_CHARS = 6_000, 16_000_000
#: What the task of the fit returns.
FITTED = pa.schema([("bias", pa.float64()), ("bits", pa.int32()), ("orders", pa.list_(pa.int32())), ("weights", pa.binary())])


@dataclass
class CharModel:
    """sigmoid(bias + sum of weights of the distinct n-grams of a text); n-grams are hashed into 2**bits cells."""

    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    bias: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def cells(self, text: str) -> Iterator[np.ndarray]:
        """Cells of the n-grams of the whole text, with repeats: letters lower-cased, a space at both ends."""
        a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        a = np.where((a == 9) | (a == 10) | (a == 13), np.uint64(32), a)
        h, n = np.zeros(len(a), np.uint64), 0
        for k in range(1, max(self.orders) + 1):
            if len(a) < k:
                return
            h = h[: len(a) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + a[k - 1 :] + np.uint64(1)
            if k in self.orders:
                n += 1
                yield ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def score(self, text: str | None) -> float:
        if text is None or not len(self.weights):
            return self._sigmoid(self.bias)
        total = self.bias
        kept = []
        for c in self.cells(text):
            w = self.weights[c]
            kept.append(c[w != 0])
        if kept:
            total += float(self.weights[np.unique(np.concatenate(kept))].astype(np.float64).sum())
        return self._sigmoid(total)

    @staticmethod
    def _sigmoid(x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(texts: list[str], labels: np.ndarray, features: int = 40_000, epochs: int = 250, ridge: float = 2e-4, **shape) -> CharModel:
    """Presence of n-grams, scaled by log((p + 1) / (q + 1)) of the two classes' document counts, then logistic
    regression by full-batch accelerated gradient descent. Only the `features` cells of largest evidence (ratio
    times root of count) have a weight. With one class the model is that class's rate; without text it rejects nothing.
    """
    m, y = CharModel(**shape), labels.astype(np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    m.bias = float(np.log(rate / (1 - rate))) if len(y) else -30.0
    if not len(y) or y.min() == y.max():
        return m
    size = 1 << m.bits
    pos, neg, sets = np.zeros(size), np.zeros(size), []
    for t, k in zip(texts, y, strict=True):
        c = list(m.cells(t or ""))
        u = np.unique(np.concatenate(c)).astype(np.int32) if c else np.zeros(0, np.int32)
        sets.append(u)
        (pos if k else neg)[u] += 1
    r = np.log(((pos + 1) / (y.sum() + 2)) / ((neg + 1) / ((1 - y).sum() + 2)))
    weight_of = np.abs(r) * np.sqrt(pos + neg) * (pos + neg >= 3)
    top = np.argsort(-weight_of, kind="stable")[:features]
    top = top[weight_of[top] > 0]
    column = np.full(size, -1, np.int32)
    column[top] = np.arange(len(top))
    rows = [column[u][column[u] >= 0] for u in sets]
    idx = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    del sets, rows
    scale = r[top]
    # Classes weigh alike and the bias stays that of equal classes: with a rare class's own rate, texts of one toxic passage
    # among much other text would fall below 0.5.
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(top)), 0.0
    vw, vb, t = w.copy(), b, 1.0
    norm = np.bincount(of, scale[idx] ** 2, len(y)).max() * 0.25 + 1
    step = 4.0 / norm
    for _ in range(epochs):
        z = vb + np.bincount(of, (scale * vw)[idx], len(y))
        g = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = scale * np.bincount(idx, g[of], len(top)) + ridge * vw
        nw, nb = vw - step * gw, vb - step * norm * 0.05 * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    m.bias, m.weights = float(b), np.zeros(size, np.float32)
    m.weights[top] = (scale * w).astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, k: int = 5, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, **how) -> CharModel:
    """Fit on labelled documents whose fold of `k` is not 0: the documented bound is the first `max_rows` by
    md5 of the id, less those whose texts don't fit in `max_chars` with the ones before (never a part of a text).
    Where texts are labelled and none fits it fails, rather than give all texts one score.

    A document that `labels` lists more than once counts with its largest label, one that `docs` lists more than once with
    the text of the smallest hash; null labels and texts don't count. The driver sees ids and lengths of the
    chosen rows and, at the end, the weights; texts meet in one task.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    key = F.md5(F.col("doc_id").cast("string").cast("binary"))
    # The rows are chosen by id before any text moves.
    ids = marks.where(fold(F.col("doc_id"), k) != 0).orderBy(key, "doc_id").limit(max_rows)
    lean = docs.where("text is not null").select("doc_id", F.col("text").alias("_t")).join(F.broadcast(ids), "doc_id")
    picked = materialise(lean.groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"), F.min_by("_t", F.xxhash64("_t")).alias("_t")), "labelled")
    chosen, used, every = [], 0, sorted(tuple(r) for r in picked.select(key, "doc_id", F.length("_t")).collect())  # max_rows at most
    for _, i, n in every:
        if used + n <= max_chars:
            used += n
            chosen.append((i,))
    if every and not chosen:
        raise ValueError(f"no labelled text fits in {max_chars} characters")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t) for p in parts for i, y, t in zip(*(p.column(c).to_pylist() for c in ("doc_id", "_toxic", "_t")), strict=True))
        m = fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), **how)
        yield pa.RecordBatch.from_pydict({"bias": [m.bias], "bits": pa.array([m.bits], pa.int32()), "orders": [list(m.orders)], "weights": [m.weights.tobytes()]}, schema=FITTED)

    if not chosen:
        return fit([], np.zeros(0, np.int64), **how)
    own = spark.createDataFrame(chosen, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}")
    r = picked.join(F.broadcast(own), "doc_id").repartition(1).mapInArrow(run, "bias double, bits int, orders array<int>, weights binary").first()
    discard(picked)
    return CharModel(tuple(r["orders"]), r["bits"], r["bias"], np.frombuffer(bytes(r["weights"]), np.float32))


def score(docs: DataFrame, model: CharModel, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """doc_id, `keep`, and the score, as column `name`, of each row's whole text; a null text scores as the bias does, an empty one as a space."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes times 2**bits

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in parts:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.float64())  # one text at a time

    return docs.select("doc_id", *keep, run(F.col("text")).alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: trained outside fold 0 of 5, applied to all."""
    s = score(docs.select(*dict.fromkeys(("doc_id", "text", *keep))), train(docs, labels), keep)
    return s.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), *keep)
