"""Toxicity (operator 5): cumulative-link ordinal regression on sparse text features.

Grades 0 to 3 share one weight vector: P(grade >= k) is the logistic of the text's
linear score minus the threshold of grade k, and thresholds increase. Labels only
say whether a text is toxic; the grade of a toxic training text is how many
words it has that stand out in toxic texts: 1 up to a few, 3 for many. Features are
distinct words, so that a hint counts the same in texts of any length, and L1 keeps
words that say nothing at weight 0.

The model is fitted in one task on a bounded sample of labelled rows. Its weights,
at most 2 ** BITS numbers, go to the scoring tasks, which read every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparse import BITS, Leader, distinct_words, labelled_sample
from .tables import read
from .words import columns

#: Labelled rows that the model is fitted on, at most about so many.
FIT_ROWS = 16_384
GRADES = 3
EPOCHS = 4
#: Chance of any toxic grade from which a text counts as toxic.
CUT = 0.5
_ALPHA, _L1, _L2 = 0.3, 0.3, 0.01
_SPECIAL = 1 << BITS  # rows of the model that hold thresholds
_STANDS_OUT, _LEAST_TEXTS = 3.0, 4


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grades(toxic: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Severity of training texts: 0 of harmless ones, else by how many outstanding words they have."""
    inside, outside = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for t, at in zip(toxic, rows):
        (inside if t else outside)[at] += 1
    n = max(1, toxic.sum())
    ratio = np.log((inside + 0.1) / (n + 0.2)) - np.log((outside + 0.1) / (max(1, len(toxic) - n) + 0.2))
    outstanding = (ratio > _STANDS_OUT) & (inside >= _LEAST_TEXTS)
    hits = np.array([outstanding[at].sum() for at in rows])
    steps = np.unique(np.quantile(hits[toxic], [1 / 3, 2 / 3])) if toxic.any() else np.empty(0)
    return np.where(toxic, 1 + np.searchsorted(steps, hits, "left"), 0)


def _fitted(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["order", "doc_id"], ignore_index=True)
    of, bucket = distinct_words(pa.array(part["text"], pa.string()))
    edges = np.searchsorted(of, np.arange(len(part) + 1))
    rows = [bucket[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]
    grade = grades(part["y"].to_numpy() >= 0.5, rows)
    leader = Leader(_ALPHA, _L1, _L2)
    # Thresholds as the first one and the logarithms of the gaps above it, so they stay in order.
    shape, seen = np.zeros(GRADES), np.ones(GRADES)
    for _ in range(EPOCHS):
        for k, at in zip(grade, rows):
            theta = shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))])
            above = _logistic(leader.weights(at).sum() - theta)  # P(grade >= 1 .. GRADES)
            chance = np.concatenate([[1.0], above, [0.0]])
            slope = np.concatenate([[0.0], above * (1 - above), [0.0]])
            own = max(chance[k] - chance[k + 1], 1e-9)
            g = -(slope[k] - slope[k + 1]) / own  # of the loss by the score
            leader.update(at, np.full(len(at), g))
            by_theta = np.zeros(GRADES + 2)
            by_theta[k] += slope[k] / own
            by_theta[k + 1] -= slope[k + 1] / own
            tail = np.cumsum(by_theta[1 : GRADES + 1][::-1])[::-1]
            step = tail * np.concatenate([[1.0], np.exp(shape[1:])])
            seen += step**2
            shape -= 0.3 * step / np.sqrt(seen)
    theta = shape[0] + np.concatenate([[0], np.cumsum(np.exp(shape[1:]))])
    w = leader.weights()
    at = np.flatnonzero(w)
    return pd.DataFrame(
        {
            "bucket": np.concatenate([at, _SPECIAL + np.arange(GRADES)]).astype(np.int64),
            "weight": np.concatenate([w[at], theta]),
        }
    )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all buckets and the thresholds. Without labelled rows nothing counts as toxic."""
    sample = labelled_sample(docs, labels, label, rows).withColumn("order", F.xxhash64("doc_id", F.lit(13)))
    one = sample.select("doc_id", "text", "y", "order", F.lit(0).alias("all")).groupBy("all")
    found = one.applyInPandas(_fitted, "bucket long, weight double").toArrow()
    weights = np.zeros(_SPECIAL + GRADES)
    weights[_SPECIAL:] = 35.0
    weights[found.column("bucket").to_numpy()] = found.column("weight").to_numpy()
    return weights[:_SPECIAL].astype(np.float32), weights[_SPECIAL:]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, expected_severity and p_toxic of each row; null and empty texts have no words to count."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, theta = held.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                doc_id, texts = columns(batch.slice(at, 1000), "doc_id", "text")
                of, bucket = distinct_words(texts)
                linear = np.bincount(of, weights[bucket], len(texts))
                above = _logistic(linear[:, None] - theta)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(above.sum(1)), pa.array(above[:, 0])],
                    names=["doc_id", "expected_severity", "p_toxic"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of every document and whether it counts as toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= CUT)
