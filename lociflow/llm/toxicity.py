"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import mixed
from lociflow.llm.model import fitted, fold, scored, scored_rows, sigmoid, training_rows

BITS = 18
SIZES = (4, 5)
MAX_TRAIN = 5000
EPOCHS, RATE, L2 = 6, 0.15, 1e-4
STEP = np.uint64(0x9E3779B97F4A7C15)


def _texts(column):
    """Lower-cased code points of each text."""
    for text in column.to_pylist():
        yield np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _buckets(points: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of all n-grams of a text; pieces of a very long one are taken in turn."""
    for at in range(0, max(1, len(points)), 1 << 18):
        piece = points[at:at + (1 << 18) + max(SIZES) - 1].astype(np.uint64)
        for n in SIZES:
            if len(piece) >= n:
                h = np.full(len(piece) - n + 1, n, np.uint64)
                for j in range(n):
                    h = h * STEP + piece[j:len(piece) - n + 1 + j]
                seen[mixed(h) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def features(column):
    seen = np.zeros(1 << BITS, bool)
    for points in _texts(column):
        yield _buckets(points, seen), None


def fit(rows, y) -> np.ndarray:
    """Weight and ratio of every bucket, the bias, and 1 if both classes were there, without which nothing is learned. Presence is scaled by the log ratio of smoothed counts in the
    two classes; logistic regression on the scaled features by AdaGrad in a fixed order."""
    n = 1 << BITS
    if len(set(np.asarray(y).tolist())) < 2:
        return np.zeros(2 * n + 2)
    counts = np.ones((2, n))
    for (i, _), label in zip(rows, y):
        counts[int(label), i] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    # A bucket seen once or twice says nothing; its ratio is shrunk towards none.
    total = counts.sum(0) - 2
    ratio *= total / (total + 5)
    w, seen2, bias = np.zeros(n), np.full(n, 1e-8), 0.0
    bias2 = 1e-8
    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i = rows[k][0]
            x = ratio[i]
            norm = 1 / np.sqrt(max(1.0, float(x @ x)))
            g = sigmoid((w[i] @ x) * norm + bias) - y[k]
            grad = g * norm * x + L2 * w[i]
            seen2[i] += grad * grad
            w[i] -= RATE * grad / np.sqrt(seen2[i])
            bias2 += g * g
            bias -= RATE * g / np.sqrt(bias2)
    return np.concatenate([w, ratio, [bias, 1.0]])


def scorer(model: np.ndarray):
    n = 1 << BITS
    product, square, bias = model[:n] * model[n:2 * n], model[n:2 * n] ** 2, model[2 * n]

    def score(column):
        seen = np.zeros(n, bool)
        out = np.empty(len(column))
        for k, points in enumerate(_texts(column)):
            i = _buckets(points, seen)
            out[k] = product[i].sum(dtype=np.float64) / np.sqrt(max(1.0, square[i].sum(dtype=np.float64))) + bias
        return sigmoid(out)
    return score


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The model from at most ``max_train`` labelled documents outside the held-out fold; ``labels(doc_id, toxic)``."""
    return fitted(training_rows(docs, labels, "toxic", max_train, id_col, text_col), features, fit)


def score_toxicity(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text and nothing else.

    Null and empty texts score like a text without n-grams; repeated rows each get a row; a null identifier stays
    null and is held out. Very long texts are scored whole, a piece at a time; an empty table gives none. Labels of one class only, or
    none, give 0.5 everywhere.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(named, ["doc_id"], "text", scorer(model))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, in all their columns, whatever these are called, without a shuffle.

    A model that has not seen both classes knows nothing: then all rows stay, with a warning. Null and empty texts score
    by the bias alone; repeated rows share their fate; very long texts are scored whole; an empty table stays empty.
    """
    if not model[-1]:
        warnings.warn("no labels of both classes: no document is dropped as toxic", stacklevel=2)
        return docs
    return scored_rows(docs, text_col, scorer(model)).where("score < 0.5").select("row.*")
