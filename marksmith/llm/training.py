"""The bounded sample of labelled rows on which the classifiers are trained, and shared arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

#: Labelled documents that a classifier is trained on at most (the rows with the smallest hash of their id).
TRAIN_DOCS = 4000
#: Bytes of text that such a sample holds at most: documents that would go beyond it are left out, in the same order.
TRAIN_BYTES = 64 << 20
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod FOLDS; a null id counts as the empty text. Fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """(text, label) of at most ``limit`` labelled documents outside fold 0, and at most TRAIN_BYTES of text, in order of id."""
    chosen = (
        labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(fold(F.col("doc_id")) != 0)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # at most ``limit`` ids, so this side is small whatever the tables' size
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    # at most ``limit`` rows, so one task sums up their sizes
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = rows.withColumn("upto", F.sum(F.octet_length("text")).over(upto)).where(F.col("upto") <= TRAIN_BYTES)
    return [(r["text"], r["label"]) for r in sorted(small.collect(), key=lambda r: r["doc_id"])]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The logit that parts the labels with the best F1, in the middle of the gap where it lies."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order].astype(bool)
    hits = y.cumsum()
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # ties stay together
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1)
