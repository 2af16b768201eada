"""Quality classifier (operator 2): hashed word n-grams, logistic regression by FTRL-proximal.

The model is fitted on a bounded sample of the labelled rows, split into SHARDS
parts. Each part is one task: it reads its rows in a fixed order for EPOCHS
rounds with per-coordinate FTRL updates. The parts' weights are averaged (parameter
mixing) and sent to the scoring tasks: at most 2 ** BITS numbers. A text's score is
the logistic of the bias and the mean weight of its n-grams, a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparse import BITS, Leader, held_out, labelled_sample, word_ngrams
from .tables import read
from .words import columns

#: Labelled rows that the model is fitted on, at most about so many.
FIT_ROWS = 16_384
SHARDS = 4
EPOCHS = 4
#: Scores from here on predict label 1.
CUT = 0.3
HELD_OUT_FOLD = 0
_SCALE = 20.0  # the n-grams of a text share this much
_ALPHA, _L1, _L2 = 0.5, 0.002, 0.01
_BIAS = 1 << BITS


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fitted(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["order", "doc_id"], ignore_index=True)
    y = part["y"].to_numpy()
    of, bucket = word_ngrams(pa.array(part["text"], pa.string()))
    by_text = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[by_text], np.arange(len(part) + 1))
    rows = []
    for lo, hi in zip(edges[:-1], edges[1:]):
        at, n = np.unique(bucket[by_text[lo:hi]], return_counts=True)
        rows.append((at, _SCALE * n / max(1, hi - lo)))
    leader, bias, seen = Leader(_ALPHA, _L1, _L2), 0.0, 1.0
    for _ in range(EPOCHS):
        for i, (at, x) in enumerate(rows):
            g = float(_logistic(np.array(leader.weights(at) @ x + bias))) - y[i]
            leader.update(at, g * x)
            seen += g * g
            bias -= 0.1 * g / seen**0.5
    w = leader.weights()
    at = np.flatnonzero(w)
    return pd.DataFrame(
        {"bucket": np.concatenate([at, [_BIAS]]), "weight": np.concatenate([w[at], [bias]])}
    ).astype({"bucket": "int64"})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the bias. Without labelled rows all are 0 and scores are 0.5."""
    sample = labelled_sample(docs, labels, label, rows).withColumn("order", F.xxhash64("doc_id", F.lit(11)))
    shard = F.pmod("order", F.lit(SHARDS)).alias("shard")
    parts = sample.select("doc_id", "text", "y", "order", shard).groupBy("shard")
    found = parts.applyInPandas(_fitted, "bucket long, weight double").groupBy("bucket")
    weights = np.zeros(_BIAS + 1)
    mixed = found.agg(F.sum("weight").alias("w")).toArrow()
    weights[mixed.column("bucket").to_numpy()] = mixed.column("w").to_numpy() / SHARDS
    return weights[:_BIAS].astype(np.float32), float(weights[_BIAS])


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of each row of ``docs``; a null or empty text has no n-grams and scores by the bias."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                doc_id, texts = columns(batch.slice(at, 1000), "doc_id", "text")
                of, bucket = word_ngrams(texts)
                total = np.bincount(of, weights[bucket], len(texts))
                n = np.bincount(of, minlength=len(texts))
                score = _logistic(_SCALE * total / np.maximum(n, 1) + bias)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by a model that never saw the labels of the held-out fold."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out(HELD_OUT_FOLD))
    out = scored(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        held_out(HELD_OUT_FOLD).alias("held_out"),
        "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"),
    )
