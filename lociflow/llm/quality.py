"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lociflow.llm.bytesplit import ALNUM, Words, chunks
from lociflow.llm.model import fitted, fold, scored, sigmoid, training_rows

BITS = 18
SIZES = (1, 2)
MAX_TRAIN = 12000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 3.0, 1.0, 0.1, 0.0
#: Marks count as words as well: everything but white space that is no letter or digit.
MARK = ~ALNUM
MARK[[32, *range(9, 14)]] = False


def features(column):
    """Buckets of the word and mark n-grams of each text and their counts as logarithms, scaled to length one."""
    shift = np.uint64(64 - BITS)
    for _, data, at in chunks(column):
        kinds = [Words(data, at, ALNUM, lower=False), Words(data, at, MARK, lower=False)]
        grams = [(kinds[0].grams(n), n) for n in SIZES] + [(kinds[1].grams(1), 9)]
        starts = [(k.of, k) for k in kinds]
        where = [np.searchsorted(first, starts[0 if n < 9 else 1][0]) for (_, first), n in grams]
        ids = [((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift for (h, _), n in grams]
        for d in range(len(at) - 1):
            i, n = np.unique(np.concatenate([x[w[d]:w[d + 1]] for x, w in zip(ids, where)]), return_counts=True)
            v = np.log1p(n).astype(np.float32)
            yield i.astype(np.int64), v / max(1e-9, float(np.sqrt(v @ v)))


def fit(rows, y) -> np.ndarray:
    """Per-coordinate FTRL-proximal; the last weight is the bias, which is not regularised."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        l1 = np.where(i == size - 1, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))
    order = np.random.RandomState(7)
    for _ in range(EPOCHS if len(rows) else 0):
        for k in order.permutation(len(rows)):
            i, v = np.append(rows[k][0], size - 1), np.append(rows[k][1] if rows[k][1] is not None else [], 1.0)
            w = weights(i)
            g = (sigmoid(w @ v) - y[k]) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(size))


def scorer(model: np.ndarray):
    def score(column):
        return sigmoid(np.array([model[i] @ v + model[-1] for i, v in features(column)], np.float64))
    return score


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The model from at most ``max_train`` labelled documents outside the held-out fold; ``labels(doc_id, quality)``."""
    return fitted(training_rows(docs, labels, "quality", max_train, id_col, text_col), features, fit)


def score_quality(docs: DataFrame, model: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, a sparse dot product over its whole text.

    Null and empty texts get the bias alone; repeated rows each get a row; a null identifier stays null and is held
    out. No labelled row at all gives 0.5 everywhere.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(named, ["doc_id"], "text", scorer(model))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
