"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of three rows of a hashed table: those of the word and of its first four
and five letters, so that derived forms share what is learnt. Filters of several widths run over the
whole text, each filter's maximum over all positions is kept, and a logistic layer scores them. The rows
start from each bucket's smoothed log-odds in the training rows, and random numbers. The threshold is calibrated by
language, told from the text's own function words: the logit is shifted so that 0.5 is the language's
best threshold on training rows that the weights were not fitted to. The id, source, lang column and
labels are not inputs of a score.

Defined results: null and empty texts have no words and get the score of an empty window. Texts may be of any
length; equal texts get equal scores, and rows that repeat an id are scored one by one. With no labelled rows of
both kinds every score is 0. An empty table gives an empty table. Only the id and the text are read, so extra
columns may have any names; ``drop_toxic`` returns them as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batches, texts
from .training import Adam, best_threshold, fold, labelled_sample, sigmoid

BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
EPOCHS, BATCH_DOCS, RATE, DECAY, DROPPED_WORDS = 8, 32, 0.01, 1e-4, 0.2
#: Positives that a language needs among the calibration rows for a threshold of its own.
LEAST_POSITIVES = 8
PAD, PARTS = 0, 3
#: Words that a worker remembers.
MEMO_WORDS = 100_000

#: Frequent function words that tell the language.
LANGUAGE_WORDS = {
    "en": ("the", "and", "of", "to", "is", "that", "with", "for", "was", "are"),
    "de": ("der", "die", "das", "und", "ist", "mit", "nicht", "ein", "den", "auf"),
    "fr": ("le", "la", "les", "des", "et", "une", "dans", "que", "pour", "avec"),
    "es": ("el", "los", "las", "del", "y", "una", "en", "por", "para", "con"),
}
LANGUAGES = (*LANGUAGE_WORDS, "other")


def plain(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>#$%&*|/\\-_=+~`^")


def buckets(word: str) -> tuple[int, ...]:
    """The rows of a plain lower-case word; PAD for those that it lacks."""
    if not word:
        return (PAD,) * PARTS
    keys = [word, "4" + word[:4] if len(word) > 4 else "", "5" + word[:5] if len(word) > 5 else ""]
    return tuple(1 + zlib.crc32(k.encode()) % (BUCKETS - 1) if k else PAD for k in keys)


class Vocabulary(dict):
    """Words, as split at white space, to rows of a growing table; forgotten when it is full, between documents' batches."""

    def __init__(self) -> None:
        super().__init__()
        # words not taken over yet; row 0 is the padding
        self.size, self.rows, self.votes = 1, [(PAD,) * PARTS], [len(LANGUAGE_WORDS)]

    def __missing__(self, word: str) -> int:
        bare = plain(word)
        self.rows.append(buckets(bare))
        self.votes.append(_LANGUAGE_OF.get(bare, len(LANGUAGE_WORDS)))
        self[word] = found = self.size
        self.size += 1
        return found

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows and votes of words met since the last call."""
        out = np.array(self.rows, dtype=np.int32).reshape(-1, PARTS), np.array(self.votes, dtype=np.int8)
        self.rows, self.votes = [], []
        return out

    def ids(self, text: str) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


_LANGUAGE_OF = {w: k for k, words in enumerate(LANGUAGE_WORDS.values()) for w in words if sum(w in x for x in LANGUAGE_WORDS.values()) == 1}


def language(votes: np.ndarray) -> int:
    """Index into LANGUAGES of the language with the most function words; the last when there are none."""
    counts = np.bincount(votes, minlength=len(LANGUAGES))[: len(LANGUAGE_WORDS)]
    return int(counts.argmax()) if counts.any() else len(LANGUAGES) - 1


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One row of ids with enough padding before each document that no window meets two, and where documents start."""
    gap = max(WIDTHS) - 1
    sizes = np.array([len(d) + gap for d in docs])
    starts = np.concatenate([[0], sizes.cumsum()])
    ids = np.zeros(starts[-1] + gap, dtype=np.int32)
    for d, at in zip(docs, starts):
        ids[at + gap : at + gap + len(d)] = d
    return ids, starts[:-1]


@dataclass
class Cnn:
    weights: dict[str, np.ndarray]
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def added(self, rows: np.ndarray) -> dict[int, list[np.ndarray]]:
        """What each word (its rows of the hashed table) adds to each filter at each place of the filter."""
        e = self.weights["embedding"][rows].sum(axis=1)
        return {w: [(e @ self.weights[f"filter{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}

    def logits(self, docs: list[np.ndarray], added: dict[int, list[np.ndarray]]) -> np.ndarray:
        ids, starts = laid_out(docs)
        n = len(ids) - max(WIDTHS) + 1
        pooled = []
        for w in WIDTHS:
            total = added[w][0][ids[:n]]
            for j in range(1, w):
                total += added[w][j][ids[j : j + n]]
            pooled.append(np.maximum.reduceat(total, starts, axis=0))
        h = np.maximum(np.concatenate(pooled, axis=1) + self.weights["bias"], 0)
        return h @ self.weights["out"] + self.weights["out_bias"][0]


class Scorer:
    """A network with the words that a worker has met."""

    def __init__(self, net: Cnn | None):
        self.net, self.words = net, Vocabulary()
        self.added: dict[int, list[np.ndarray]] = {w: [np.zeros((0, FILTERS), dtype=np.float32)] * w for w in WIDTHS}
        self.votes = np.zeros(0, dtype=np.int8)

    def __call__(self, found: list[str]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(found))
        if len(self.words) > MEMO_WORDS:
            self.__init__(self.net)
        docs = [self.words.ids(t) for t in found]
        fresh, votes = self.words.taken()
        if len(fresh):
            more = self.net.added(fresh)
            for w in WIDTHS:
                self.added[w] = [np.concatenate(pair) for pair in zip(self.added[w], more[w])]
            self.votes = np.concatenate([self.votes, votes])
        spoken = [language(self.votes[d]) for d in docs]
        return sigmoid(self.net.logits(docs, self.added) - self.net.shift[spoken])


def gradients(weights: dict[str, np.ndarray], parts: np.ndarray, batch: list[np.ndarray], labels: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    """Of the sum of the documents' log losses, each times its importance, by every weight; the padding's row stays 0."""
    e = weights["embedding"]
    ids, starts = laid_out(batch)
    n = len(ids) - max(WIDTHS) + 1
    ends = np.append(starts[1:], n)
    used, where = np.unique(ids, return_inverse=True)
    rows_e = e[parts[used]].sum(axis=1)
    pooled, at = [], []
    for w in WIDTHS:
        total = sum((rows_e @ weights[f"filter{w}"][j])[where[j : j + n]] for j in range(w))
        best = np.stack([a + total[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
        at.append(best)
        pooled.append(np.take_along_axis(total, best, axis=0))
    z = np.concatenate(pooled, axis=1) + weights["bias"]
    h = np.maximum(z, 0)
    error = (sigmoid(h @ weights["out"] + weights["out_bias"][0]) - labels) * importance
    back = error[:, None] * weights["out"] * (z > 0)
    grads = {"out": h.T @ error, "out_bias": np.array([error.sum()]), "bias": back.sum(axis=0), "embedding": np.zeros_like(e)}
    for i, w in enumerate(WIDTHS):
        f, g = weights[f"filter{w}"], back[:, i * FILTERS : (i + 1) * FILTERS]
        grads[f"filter{w}"] = np.zeros_like(f)
        for j in range(w):
            top = parts[ids[at[i] + j]]  # document x filter x part
            grads[f"filter{w}"][j] = np.einsum("dfk,df->kf", e[top].sum(axis=2), g)
            np.add.at(grads["embedding"], top, (g[:, :, None] * f[j].T[None])[:, :, None])
    grads["embedding"][PAD] = 0
    return grads


def train(rows: list[tuple[str, int]], seed: int = 7) -> Cnn | None:
    """A network fitted to (text, label) rows; every fifth row only sets the thresholds. None without both labels."""
    words = Vocabulary()
    docs, labels = [words.ids(t) for t, _ in rows], np.array([y for _, y in rows], dtype=np.float64)
    parts, votes = words.taken()
    kept_out = np.arange(len(rows)) % 5 == 4
    fit = np.flatnonzero(~kept_out)
    if len(set(labels[fit])) < 2:
        return None
    rng = np.random.default_rng(seed)
    # documents of each label that hold the bucket
    seen = np.zeros((2, BUCKETS))
    for k in fit:
        seen[int(labels[k]), np.unique(parts[docs[k]])] += 1
    totals = np.array([(labels[fit] == 0).sum(), (labels[fit] == 1).sum()])
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    sure = np.where(seen.sum(axis=0) >= 3, np.clip(odds, -2, 6), 0) * np.minimum(1, seen.sum(axis=0) / 10)
    e = rng.normal(0, 0.05, (BUCKETS, DIMS))
    e[:, 0] = sure / 3
    e[PAD] = 0
    weights = {"embedding": e, "bias": np.full(FILTERS * len(WIDTHS), 0.0), "out": np.full(FILTERS * len(WIDTHS), 0.2), "out_bias": np.array([-1.0])}
    for w in WIDTHS:
        f = rng.normal(0, 0.1, (w, DIMS, FILTERS))
        f[0, 0] += 0.5
        weights[f"filter{w}"] = f
    net, adam = Cnn(weights), Adam(weights, RATE)
    weight_of = np.where(labels == 1, totals.sum() / (2 * totals[1]), totals.sum() / (2 * totals[0]))
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH_DOCS)):
            batch = [np.where(rng.random(len(docs[k])) < DROPPED_WORDS, PAD, docs[k]).astype(np.int32) for k in some]
            grads = gradients(weights, parts, batch, labels[some], weight_of[some] / len(some))
            for name in ("out", *(f"filter{w}" for w in WIDTHS)):
                grads[name] += DECAY * weights[name]
            adam.step(grads)
    logits, spoken = net.logits(docs, net.added(parts)), np.array([language(votes[d]) for d in docs])
    judged = kept_out if labels[kept_out].sum() >= LEAST_POSITIVES else np.ones(len(rows), dtype=bool)
    common = best_threshold(logits[judged], labels[judged])
    for k in range(len(LANGUAGES)):
        own = judged & (spoken == k)
        net.shift[k] = best_threshold(logits[own], labels[own]) if labels[own].sum() >= LEAST_POSITIVES else common
    weights["embedding"] = e.astype(np.float32)
    return net


SCORED = "doc_id long, score double"
#: Characters of text that are scored together.
STEP_CHARS = 1 << 20


def in_steps(scorer: Scorer, found: list[str]) -> np.ndarray:
    """Scores of all texts, some STEP_CHARS characters at a time."""
    out, begin, size = [np.zeros(0)], 0, 0
    for k, text in enumerate(found):
        size += len(text)
        if size > STEP_CHARS or k == len(found) - 1:
            out.append(scorer(found[begin : k + 1]))
            begin, size = k + 1, 0
    return np.concatenate(out)


def score_documents(docs: DataFrame, net: Cnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            yield from record_batches(list(zip(ids, in_steps(scorer, found).tolist())), SCORED)

    return texts(docs, id_col, text_col).mapInArrow(run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by a network trained on ``labels``."""
    scored = score_documents(docs, train(labelled_sample(docs, labels, label_col)))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are; one pass over the documents, no join."""
    net = train(labelled_sample(docs, labels, "toxic", id_col, text_col))
    if net is None:
        return docs

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for batch in batches:
            yield pd.Series(in_steps(scorer, batch.tolist()))

    return docs.where(score(F.coalesce(docs[text_col], F.lit(""))) < threshold)
