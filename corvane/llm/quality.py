"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space.

Terms are hashed: each word, and each word's shape (case pattern, punctuation around it, length class), beside a
few pseudo-terms that hold whole-text ratios.  A truncated singular value decomposition of the weighted terms of
a bounded labelled sample gives the space; the sample's vectors are broadcast (their number is at most
``2 * per_class``), and every document's cosine to each of them is computed exactly, block by block.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import BATCH_ROWS, held_out, labelled_sample, small_batches

WORD_BINS, SHAPE_BINS, RATIOS = 512, 512, 6
TERMS = WORD_BINS + SHAPE_BINS + RATIOS
_MARKS = string.punctuation + "«»“”„‘’…–—¡¿"
_MEMO = 150_000


def _term(word: str) -> int:
    """The word's two bins as one number."""
    core = word.strip(_MARKS)
    at = word.find(core) if core else len(word)
    before, after = word[:at], word[at + len(core) :]
    case = "0" if not core else "U" if len(core) > 1 and core.isupper() else "T" if core[0].isupper() else "d" if core[0].isdigit() else "l"
    shape = f"{before[:3]}\t{case}{min(len(core), 16).bit_length()}\t{after[:3]}"
    return xxhash.xxh32_intdigest(core.lower(), 1) % WORD_BINS * SHAPE_BINS + xxhash.xxh32_intdigest(shape, 2) % SHAPE_BINS


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = found = _term(word)
        return found


def term_matrix(texts, memo: dict) -> np.ndarray:
    """One row of term weights for each text; a text without words (or a null one) has zeros."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for row, text in zip(out, texts):
        words = (text or "").split()
        if not words:
            continue
        n, ids = len(words), np.fromiter(map(memo.__getitem__, words), dtype=np.int64)
        row[:WORD_BINS] = np.sqrt(np.bincount(ids // SHAPE_BINS, minlength=WORD_BINS) / n)
        row[WORD_BINS : WORD_BINS + SHAPE_BINS] = np.sqrt(np.bincount(ids % SHAPE_BINS, minlength=SHAPE_BINS) / n)
        lines = [x for x in text.split("\n") if x]
        row[-RATIOS:] = [
            (ids[1:] == ids[:-1]).mean() if n > 1 else 0,  # a word right after itself
            1 - len(set(words)) / n if n > 5 else 0,
            1 - len(set(lines)) / max(1, len(lines)),
            sum(map(len, words)) / n / 100,
            1 / (1 + n),
            sum(text.count(c) for c in "#*$%&|<>") / len(text),
        ]
    return out


@dataclass
class Model:
    weight: np.ndarray  # of each term
    space: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # of the labelled texts, of unit length
    labels: np.ndarray
    votes: np.ndarray  # how many labelled rows a text of the sample stands for
    prior: float
    neighbours: int = 25

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weight) @ self.space
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(norm > 1e-9, norm, 1)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the prior for a text without terms or without a neighbour of positive similarity."""
        out = np.full(len(terms), self.prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for at in range(0, len(terms), BATCH_ROWS):
            cosine = self.project(terms[at : at + BATCH_ROWS]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 8 * self.votes[near]
            total = weight.sum(axis=1)
            out[at : at + BATCH_ROWS] = np.where(total > 1e-12, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return out.clip(0, 1)


def fit(sample: list[tuple[str, int]], sizes: tuple[int, int], rank: int = 48) -> Model:
    """sizes: labelled training rows of each class, sampled or not.  An empty sample gives every text 0.5."""
    texts, labels = [t for t, _ in sample], np.array([y for _, y in sample], dtype=float)
    terms = term_matrix(texts, _Memo())
    df = (terms > 0).sum(axis=0)
    weight = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) + 0.2
    weight[WORD_BINS:] *= 2
    weight[-RATIOS:] = 6
    x = terms * weight
    values, space = np.linalg.eigh((x.T @ x).astype(float))
    picked = np.bincount(labels.astype(int), minlength=2)
    share = np.array([s / max(1, p) for s, p in zip(sizes, picked)])
    model = Model(weight, space[:, ::-1][:, :rank].astype(np.float32), np.zeros((0, rank), np.float32), labels, share[labels.astype(int)] if len(labels) else labels, sizes[1] / sum(sizes) if sum(sizes) else 0.5)
    model.vectors = model.project(terms)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class; a text stands for all training rows of its class."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(label).count().collect()
    sizes = {int(r[0]): int(r[1]) for r in rows}
    return fit(labelled_sample(docs, labels, label, per_class), (sizes.get(0, 0), sizes.get(1, 0)))


def score_column(spark, model: Model, text) -> F.Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Memo()
        for batch in batches:
            yield pd.Series(shared.value.scores(term_matrix(batch.tolist(), memo)), index=batch.index)

    return score(text)


def score_documents(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score beside its own columns; null and empty texts get the prior, very long ones count
    whole, repeated rows get a score each; an input column of the name of ``column`` is replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn(column, score_column(docs.sparkSession, model, F.col("text")))
