"""Hashed sparse features and follow-the-regularised-leader updates, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import U, Words, chained, mix, runs_of_text

BITS = 18
_SIGNS = np.zeros(256, bool)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_NOTHING = mix(np.zeros(1, U))[0]
_SAME = U(0x1CE4E5B9)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int64)


def word_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all words, of pairs of neighbours, and of the signs that words end or begin with.

    A word followed by itself is one and the same pair for all words.
    """
    words = Words(texts)
    doc, h, signs = words.doc(), words.hashes(), words.hashes(_SIGNS)
    own = runs_of_text(words.first, 2)
    pair = np.where(h[:-1] == h[1:], _SAME, chained(h, 2)) if len(h) > 1 else np.empty(0, U)
    marked = signs != _NOTHING
    of = np.concatenate([doc, doc[:-1][own] if len(h) > 1 else doc[:0], doc[marked]])
    return of, buckets(np.concatenate([h, pair[own], mix(signs[marked] ^ _SAME)]))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the distinct words of each text, without case and punctuation; by text."""
    words = Words(texts)
    h = words.hashes(~_SIGNS)
    some = h != _NOTHING
    key = np.unique((words.doc()[some].astype(U) << U(BITS)) | (h[some] >> U(64 - BITS)))
    return (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64)


class Leader:
    """FTRL-proximal weights: each coordinate's rate falls with its own gradients, L1 keeps it at 0."""

    def __init__(self, alpha: float, l1: float, l2: float, beta: float = 1.0):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        kept = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -kept / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, gradient: np.ndarray) -> None:
        """``at`` holds distinct coordinates."""
        w, n = self.weights(at), self.n[at]
        more = n + gradient**2
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def held_out(fold: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``fold`` modulo 5; a missing id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of about ``rows`` labelled documents at most, chosen by a hash of the doc_id.

    ``rows`` bounds what a model is fitted on. The chosen ids, at most twice as
    many, are small enough for a broadcast. An id with several labels has their mean.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.avg(F.col(label)).alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = chosen.limit(2 * rows)  # hashes give about ``rows``; this states the bound
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
