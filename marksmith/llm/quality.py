"""Quality: a linear-chain conditional random field labels every line good or bad.

A line's features are shares of character classes, its length, word length, repeated words and repeated
lines, and the same of the lines beside it. Forward-backward gives each line's marginal, and a
document's badness is the mean of its lines' marginals weighted by their length, calibrated to a score.

Labels are of documents, so training first fits a logistic model with each line labelled as its
document, then relabels as good the lines of bad documents that this model finds good (all but the
worst line), and fits the field to those sequences. The id, source, lang and labels are not inputs.

Defined results: null and empty texts are one empty line. Texts may be of any length, and lines too; equal texts
get equal scores, and rows that repeat an id are scored one by one. With no labelled rows of both kinds every
score is 1. An empty table gives an empty table. Only the id and the text are read, so extra columns may have
any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches, texts
from .training import Adam, best_threshold, fold, labelled_sample, logit, sigmoid

THRESHOLD = 0.3
#: Character classes, as bytes of UTF-8; what is in none of them is a letter.
CLASSES = (b" \t\r", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",;:", b"!?", b"|", b"#$%&*", b"(){}[]<>=+-/\\_\"'@^~`")
FEATURES = len(CLASSES) + 7
EPOCHS_LINES, EPOCHS_FIELD, RATE, DECAY = 200, 40, 0.05, 1e-3
#: Labelled documents to train on at most.
TRAIN_DOCS = 2000
STEP_CHARS = 2 << 20

_CLASS_OF = np.full(256, len(CLASSES), dtype=np.uint8)
for _k, _bytes in enumerate(CLASSES):
    _CLASS_OF[list(_bytes)] = _k


def line_features(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', lines' lengths, where each document's lines start)."""
    lines: list[str] = []
    starts = [0]
    repeats: list[float] = []
    words: list[tuple[int, int]] = []
    for text in found:
        own = text.split("\n")
        count = Counter(own)
        repeats += [float(count[x] > 1 and x != "") for x in own] if len(count) < len(own) else [0.0] * len(own)
        for x in own:
            parts = x.split()
            words.append((len(parts), len(set(parts))))
        lines += own
        starts.append(len(lines))
    data = np.frombuffer(("\n".join(lines) + "\n").encode(), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - begins).astype(np.float64)
    kinds = _CLASS_OF[data]
    line_of = np.repeat(np.arange(len(ends)), ends - begins + 1)
    width = len(CLASSES) + 1
    counts = np.bincount(line_of * width + kinds, minlength=len(ends) * width).reshape(-1, width).astype(np.float64)
    counts[:, len(CLASSES)] -= 1  # the line end
    n_words, n_distinct = np.array(words, dtype=np.float64).reshape(-1, 2).T
    own = np.empty((len(ends), FEATURES))
    own[:, :width] = counts / np.maximum(size, 1)[:, None]
    own[:, width] = np.log1p(size) / 5
    own[:, width + 1] = np.minimum(size / np.maximum(n_words, 1), 40) / 10
    own[:, width + 2] = 1 - n_distinct / np.maximum(n_words, 1)
    own[:, width + 3] = repeats
    own[:, width + 4] = size == 0
    own[:, width + 5] = 1
    begin = np.array(starts[:-1], dtype=np.int64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begin], after[np.array(starts[1:]) - 1] = 0, 0
    return np.concatenate([own, before, after], axis=1), size + 1, begin


def forward_backward(unary: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One chain: P(bad) of each line, and P(state, next state) summed over the chain; unary are log-odds of bad."""
    n = len(unary)
    e = np.exp(turn)
    (gg, gb), (bg, bb) = e.tolist()
    odds = [math.exp(min(max(u, -30.0), 30.0)) for u in unary.tolist()]
    ahead = [0.5] * n  # share of bad in the forward message
    g, b = 1.0, odds[0]
    for k in range(n):
        if k:
            g, b = g * gg + b * bg, (g * gb + b * bb) * odds[k]
        total = g + b
        g, b = g / total, b / total
        ahead[k] = b
    marginal, pairs = [0.0] * n, [0.0] * 4
    g, b = 0.5, 0.5
    for k in range(n - 1, -1, -1):
        f = ahead[k]
        x, y = (1 - f) * g, f * b
        marginal[k] = y / (x + y)
        if k:
            p = ahead[k - 1]
            quad = ((1 - p) * gg * g, (1 - p) * gb * odds[k] * b, p * bg * g, p * bb * odds[k] * b)
            total = sum(quad)
            pairs = [a + q / total for a, q in zip(pairs, quad)]
            g, b = gg * g + gb * odds[k] * b, bg * g + bb * odds[k] * b
            total = g + b
            g, b = g / total, b / total
    return np.array(marginal), np.array(pairs).reshape(2, 2)


@dataclass
class Field:
    line: np.ndarray  # weights of a line's and its neighbours' features, for bad
    turn: np.ndarray  # state x next state
    slope: float = 1.0
    shift: float = 0.0

    def badness(self, found: list[str]) -> np.ndarray:
        """Mean marginal of bad over each document's lines, weighted by length."""
        x, size, begin = line_features(found)
        unary = x @ self.line
        marginal = np.concatenate([forward_backward(part, self.turn)[0] for part in np.split(unary, begin[1:])])
        return np.add.reduceat(marginal * size, begin) / np.add.reduceat(size, begin)

    def scores(self, found: list[str]) -> np.ndarray:
        bad = np.clip(self.badness(found), 1e-6, 1 - 1e-6)
        return sigmoid(self.slope * (self.shift - np.log(bad / (1 - bad))) + logit(THRESHOLD))


def train(rows: list[tuple[str, int]]) -> Field | None:
    """A field fitted to (text, quality) rows; None without both labels."""
    good = np.array([y for _, y in rows])
    if len(set(good.tolist())) < 2:
        return None
    found = [t for t, _ in rows]
    x, size, begin = line_features(found)
    of = np.repeat(np.arange(len(rows)), np.diff(np.append(begin, len(x))))
    bad = (good[of] == 0).astype(np.float64)
    share = size / np.add.reduceat(size, begin)[of]  # every document weighs the same within its class
    weight = np.where(bad == 1, share / (good == 0).sum(), share / (good == 1).sum())
    line = np.zeros(x.shape[1])
    adam = Adam({"line": line}, RATE)
    for _ in range(EPOCHS_LINES):
        adam.step({"line": x.T @ ((sigmoid(x @ line) - bad) * weight) + DECAY * line})
    p = sigmoid(x @ line)
    worst = np.maximum.reduceat(p, begin)
    state = ((bad == 1) & ((p >= 0.5) | (p >= worst[of]))).astype(int)
    turn = np.zeros((2, 2))
    adam = Adam({"line": line, "turn": turn}, RATE / 2)
    chains = np.split(np.arange(len(x)), begin[1:])
    seen = np.zeros((2, 2))
    for c in chains:
        np.add.at(seen, (state[c][:-1], state[c][1:]), 1)
    class_weight = np.where(state == 1, 0.5 / max(1, state.sum()), 0.5 / max(1, (1 - state).sum()))
    for _ in range(EPOCHS_FIELD):
        unary = x @ line
        marginal, expected = np.empty(len(x)), np.zeros((2, 2))
        for c in chains:
            marginal[c], pairs = forward_backward(unary[c], turn)
            expected += pairs
        adam.step({"line": x.T @ ((marginal - state) * class_weight) + DECAY * line, "turn": (expected - seen) / len(x) + DECAY * turn})
    net = Field(line, turn)
    worse = np.clip(net.badness(found), 1e-6, 1 - 1e-6)
    odds = np.log(worse / (1 - worse))
    net.shift = best_threshold(odds, 1 - good)
    return net


SCORED = "doc_id long, score double"


def score_documents(docs: DataFrame, net: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            begin, size, out = 0, 0, []
            for k, text in enumerate(found):
                size += len(text)
                if size > STEP_CHARS or k == len(found) - 1:
                    out += net.scores(found[begin : k + 1]).tolist() if net else [1.0] * (k + 1 - begin)
                    begin, size = k + 1, 0
            yield from record_batches(list(zip(ids, out)), SCORED)

    return texts(docs, id_col, text_col).mapInArrow(run, SCORED)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by a field trained on ``labels``."""
    scored = score_documents(docs, train(labelled_sample(docs, labels, label_col, limit=TRAIN_DOCS)))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
