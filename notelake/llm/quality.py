"""Document quality by Bradley-Terry ranking: from pairs of a preferred and a rejected text, logistic loss on the difference of
their features gives weights; a quantile of the training scores is the threshold, at which the score is 0.5.

Features are shares of kinds of bytes, words and lines; labels, lang, source and doc_id aren't among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

TRAIN_ROWS = 20_000  # most labelled rows that the model is fitted on, those with the smallest hash of the id
PAIRS = 60_000  # most preference pairs
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    size = max(1, len(data))
    words = data.split()
    lines = data.split(b"\n")
    upper, digits = count[65:91].sum(), count[48:58].sum()
    letters = max(1.0, upper + count[97:123].sum())
    n = max(1, len(words))
    rest = [
        upper / letters, digits / size, count[128:].sum() / size, np.log1p(len(words)), np.log1p(len(lines)), len(words) / size,
        len(set(words)) / n, len(set(lines)) / len(lines), min(40.0, size / n), min(2000.0, size / len(lines)) / 2000,
        sum(map(bytes.isupper, words)) / n,
    ]
    signs = count[_SIGNS]
    return np.array([*rest, signs.sum() / size, *(signs / n)], np.float32)


N_FEATURES = 12 + len(_SIGNS)


def _featured(batches):
    for batch in batches:
        x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, N_FEATURES)
        offsets = np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel())), batch.column("quality")], names=["doc_id", "x", "quality"])


class Model:
    """score = 1 / (1 + exp(threshold - weights . standardised features))."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 25) -> Model:
    """Weights by Newton's method over preference pairs; without both classes all documents score 0.5 or more, or less."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-4)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = Model(mean, scale, np.zeros(len(mean)), 1.0 if len(x) and not good.any() else 0.0)
    if not len(x) or good.all() or not good.any():
        return model
    rng = np.random.default_rng(0)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    n = min(pairs, 20 * max(len(a), len(b)))
    z = np.clip((x - mean) / scale, -8, 8)
    d = z[a[rng.integers(len(a), size=n)]] - z[b[rng.integers(len(b), size=n)]]
    w = model.weights
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-6)[:, None]).T @ d / n + ridge * np.eye(len(w)), d.T @ (1 - p) / n - ridge * w)
        w = w + step * min(1.0, 5 / max(1e-9, np.linalg.norm(step)))
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    order = np.argsort(model.raw(x), kind="stable")
    s, right = model.raw(x)[order], good[order]
    correct = np.concatenate([[0], np.cumsum(~right)]) + np.concatenate([np.cumsum(right[::-1])[::-1], [0]])
    best = np.flatnonzero(correct >= correct.max())  # the quantile with the fewest errors; the middle one of a run of ties
    at = int(best[len(best) // 2])
    model.threshold = float((s[max(0, at - 1)] + s[min(len(s) - 1, at)]) / 2)
    return model


def held_out(doc_id) -> F.Column:
    """Whether a row is kept out of training: crc32 of the id as text leaves remainder 1 by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows that aren't held out, at most train_rows of them: labels (doc_id, quality) of docs (doc_id, text).

    The labels with the smallest hash of the id are broadcast, so no text is shuffled; rows that repeat an id are cut to the bound as well.
    """
    bounded(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).distinct()
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    made = docs.join(F.broadcast(known), "doc_id").mapInArrow(_featured, "doc_id long, x array<float>, quality int")
    train = made.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(train_rows).select("x", "quality").toArrow()
    x = train.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(float) if train.num_rows else np.zeros((0, N_FEATURES))
    return fit(x, train.column("quality").to_numpy() >= 1)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Null and empty texts have the features of no text and a score. Repeated rows are scored each. Null labels aren't used; of an id
    with both labels, both are. Without labels the scores are 0.5. Texts are taken whole. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = trained(docs, labels, train_rows)
    out = docs.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score 0.5 or more: a filter, without a join or a shuffle of texts."""
    model = trained(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).to_pylist()], np.float32).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
