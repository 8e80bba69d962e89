"""A quality classifier by voting of nearest neighbours in a latent-semantic space.

A text becomes weighted counts of terms: runs of three character classes, hashed words, and how often its words and lines return.
A truncated singular value decomposition of the labelled texts' matrix gives the latent space. The labelled vectors go to every
task, where documents are compared with all of them by products of blocks; the labels of the nearest ones, weighted by similarity, vote.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.durable import checkpointed

# Classes of bytes, 15 and one for the rest: small and capital letters, digits, blanks, line breaks, bytes beyond ASCII, kinds of marks.
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "", ".", ",;:", "!", "?", "'\"`-", "()[]{}<>/\\", "|", "#*", "$%&@")
_GROUPS = 16
WORD_BUCKETS = 2_048
RETURNS = 8  # powers of two in which the returns of words and of lines are counted
TERMS = _GROUPS ** 3 + WORD_BUCKETS + 2 * RETURNS


def _classes() -> np.ndarray:
    of = {c: k for k, marks in enumerate(_CLASSES) for c in marks}
    return np.array([of.get(chr(c), _GROUPS - 1) if c < 128 else _CLASSES.index("") for c in range(256)], dtype=np.int64)


CLASS_OF = _classes()


def _returns(counts: np.ndarray) -> np.ndarray:
    """How many parts belong to values that occur once, twice, up to 4 times, up to 8 times and so on."""
    steps = np.minimum(RETURNS - 1, np.ceil(np.log2(counts)).astype(np.int64))
    return np.bincount(steps, weights=counts, minlength=RETURNS)


def _times(parts: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    found = Counter(parts)
    return list(found), np.fromiter(found.values(), dtype=np.int64, count=len(found))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a whole text and their damped counts, in four parts of equal say; nothing for null, blank or empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n_words = _times(raw.lower().split())
    if not words:
        return np.empty(0, dtype=np.int64), np.empty(0)
    kinds = CLASS_OF[np.frombuffer(b"\n " + raw + b" \n", dtype=np.uint8)]
    runs = np.bincount(kinds[:-2] * _GROUPS ** 2 + kinds[1:-1] * _GROUPS + kinds[2:], minlength=_GROUPS ** 3)
    buckets = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % WORD_BUCKETS
    lines = _times(x for x in raw.split(b"\n") if x.strip())[1]
    parts = (runs, np.bincount(buckets, weights=n_words, minlength=WORD_BUCKETS), _returns(n_words), _returns(lines))
    ids = [np.flatnonzero(part) for part in parts]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return (np.concatenate([i + at for i, at in zip(ids, starts, strict=True)]), np.concatenate([_part(part[i]) for part, i in zip(parts, ids, strict=True)]))


def _part(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: a part of unit length, whatever the text's length."""
    return np.sqrt(counts / counts.sum())


@dataclass
class Model:
    """The latent space and the labelled vectors in it."""

    kept: np.ndarray  # for each term its row of ``axes``, or -1
    axes: np.ndarray  # terms x dimensions, weights included
    vectors: np.ndarray  # labelled rows, of unit length
    labels: np.ndarray  # 0 or 1
    prior: float

    def place(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            ids, counts = terms(text)
            rows = self.kept[ids]
            out[i] = counts[rows >= 0] @ self.axes[rows[rows >= 0]]
        return _unit(out)

    def score(self, texts: Sequence[str | None], neighbours: int = 15, block: int = 512) -> np.ndarray:
        """Shares of label 1 among the nearest labelled vectors, by similarity; the overall share where a text has no known term."""
        out = np.full(len(texts), self.prior)
        k = min(neighbours, len(self.labels))
        for at in range(0, len(texts) if k else 0, block):
            placed = self.place(texts[at:at + block])
            cosines = placed @ self.vectors.T
            # Ties at the edge go to the first rows of the model, which is sorted.
            near = _nearest(cosines, k)
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0.0).astype(np.float64) ** 4
            total = weight.sum(axis=1)
            told = total > 0
            votes = (weight * self.labels[near]).sum(axis=1)
            out[at:at + block][told] = votes[told] / total[told]
        return np.clip(out, 0.0, 1.0)


def _nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row, the earlier one on ties."""
    if k >= cosines.shape[1]:
        return np.tile(np.arange(cosines.shape[1]), (len(cosines), 1))
    edge = -np.partition(-cosines, k - 1, axis=1)[:, k - 1:k]
    chosen = cosines >= edge
    for row in np.flatnonzero(chosen.sum(axis=1) > k):
        level = np.flatnonzero(cosines[row] == edge[row])
        chosen[row, level[k - int((cosines[row] > edge[row]).sum()):]] = False
    return np.nonzero(chosen)[1].reshape(len(cosines), k)


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def fit(rows: Sequence[tuple[str, int]], dimensions: int = 48) -> Model:
    """The latent space of labelled texts: log-entropy weights, then a randomised singular value decomposition (fixed seed).

    Equal texts count once for each label. Without rows every text scores 0.5.
    """
    rows = sorted(set(rows))
    labels = np.array([y for _, y in rows], dtype=np.float64)
    counted = [terms(text) for text, _ in rows]
    present = np.unique(np.concatenate([ids for ids, _ in counted])) if rows else np.empty(0, dtype=np.int64)
    kept = np.full(TERMS, -1, dtype=np.int64)
    kept[present] = np.arange(len(present))
    if not len(present):
        return Model(kept, np.zeros((0, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0), float(labels.mean()) if rows else 0.5)
    matrix = np.zeros((len(rows), len(present)), dtype=np.float32)
    for i, (ids, counts) in enumerate(counted):
        matrix[i, kept[ids]] = counts
    share = matrix / matrix.sum(axis=0)
    spread = -(share * np.log(np.where(share > 0, share, 1.0))).sum(axis=0) / np.log(max(2, len(rows)))
    weights = np.maximum(0.05, 1.0 - spread).astype(np.float32)
    weighed = matrix * weights
    size = min(dimensions, *weighed.shape)
    rng = np.random.default_rng(7)
    basis = weighed @ rng.standard_normal((weighed.shape[1], min(size + 16, *weighed.shape))).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(weighed @ (weighed.T @ np.linalg.qr(basis)[0]))[0]
    axes = np.linalg.svd(basis.T @ weighed, full_matrices=False)[2][:size].T
    axes = (weights[:, None] * axes).astype(np.float32)
    return Model(kept, axes, _unit(matrix @ axes), labels, float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 4_000, train_chars: int = 20_000) -> Model:
    """Fit on at most ``train_docs`` labelled documents of at most ``train_chars`` characters, picked by a hash of the id.

    Rows with a null id, text or label teach nothing; a document with several labels is good only if all say so, and of several texts
    of one id the least in order counts. Ids are picked before any text is read, so the rows that leave their tasks
    are bounded by both numbers, whatever repeats. Every document is scored, of any length.
    """
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    picked = checkpointed(marked.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(train_docs))
    texts = docs.select("doc_id", "text").where(f"length(text) BETWEEN 1 AND {train_chars}").join(F.broadcast(picked), "doc_id")
    drawn = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return fit([(r["text"], int(r["quality"] > 0)) for r in drawn.collect()])


def quality(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The score, 0 to 1, of every whole text; empty and null texts get the share of label 1 among the labelled.

    The model is bounded by its training sample and goes to the executors as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(shared.value.score([None if pd.isna(x) else x for x in series]), dtype="float64")

    return scored(F.col(text))
