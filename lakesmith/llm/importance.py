"""Importance resampling towards a target distribution (operator 11).

Hashed word runs of all documents and of the target texts are counted; a bucket's
gain is the log ratio of its smoothed shares. The gains, one array of BUCKETS
numbers, go to every task, which scores its documents as mean gains. Gumbel noise
from a hash of the doc_id turns "the highest scores" into a draw without
replacement in proportion to exp(weight).

The cutoff is found by weighted median-of-medians selection. Each partition gives
the median key of its remaining candidates and how many they are. The median of
these, weighted by the numbers, has at least a quarter of all candidates on either
side, so each round discards a guaranteed share, until the exact key of the last
winner is known. Only one row for each partition reaches the driver. The winners
alone are sorted, by ranges of the key.

Keys are (score falling, doc_id rising with null last, n_features, row number of the
written table), so no two are equal and no group of equal scores is ever cut at random.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .crc import START, advanced
from .tables import Workspace, read
from .words import Words, columns, portions, runs_of_text

BUCKETS = 10_000
#: Added to a bucket's count; all buckets together get BUCKETS.
PRIOR = 1
#: Words in a run, at most.
LONGEST = 1
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Once so few candidates are left, the driver sorts their keys itself.
FEW = 4096

_KEY = ["k_score", "k_null", "k_id", "k_features", "k_row"]
_KEY_TYPE = ", ".join(f"{k} long" for k in _KEY)

_PARTS = np.ones(256, bool)
_PARTS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = False
_BLANK = np.array([0x20], np.uint8)


def buckets(texts: pa.Array, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of all runs of 1 to ``longest`` words, and the number of words of each text.

    Words are runs of ASCII letters (lower-cased), digits and all other characters beyond ASCII.
    """
    words = Words(texts, space=_PARTS)
    doc, n = words.doc(), len(words)
    state = np.full(n, START)
    of, found = [], []
    for k in range(min(longest, n)):
        start, end = words.start[k:], words.end[k:]
        if k:
            blank = np.zeros(len(start), np.int64)
            state = advanced(state[:-1], _BLANK, blank, blank + 1)
        state = advanced(state, words.data, start, end)
        own = runs_of_text(words.first, k + 1)
        of.append(doc[: n - k][own])
        found.append((~state[own] % np.uint32(BUCKETS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *of]), np.concatenate([none, *found]), np.diff(words.first)


def counted(texts: DataFrame, longest: int = LONGEST) -> np.ndarray:
    """How many features of all rows' ``text`` fall into each bucket. Each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in portions(batch, "text"):
                total += np.bincount(buckets(part.column(0), longest)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()  # BUCKETS at most
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, target over corpus, for each bucket."""
    s_all, t_all = float(corpus.sum()) + BUCKETS * PRIOR, float(target.sum()) + BUCKETS * PRIOR
    ratio = ((t + PRIOR) * s_all / ((s + PRIOR) * t_all) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain, 0 without features) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            for part in portions(batch, "text"):
                doc_id, texts = columns(part, "doc_id", "text")
                of, found, words = buckets(texts, longest)
                n = np.bincount(of, minlength=len(part))
                edges = np.zeros(len(found) + 1, np.int64)
                by_text = of if longest == 1 else np.sort(of, kind="stable")
                found = found if longest == 1 else found[np.argsort(of, kind="stable")]
                np.cumsum(gain[found], out=edges[1:])
                ends = np.searchsorted(by_text, np.arange(len(part) + 1))
                total = np.diff(edges[ends])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the doc_id; a missing id counts as empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    share = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def _bound(key: Sequence[int]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(_KEY, key)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of this partition's keys and the lower median of them."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches if len(batch)]
    if parts:
        keys = [np.concatenate(c) for c in zip(*parts)]
        n = len(keys[0])
        at = np.lexsort(keys[::-1])[(n - 1) // 2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(v)], pa.int64()) for v in (n, *(k[at] for k in keys))], names=["n", *_KEY]
        )


def cutoff(keys: DataFrame, take: int, work: Workspace, few: int = FEW) -> tuple[int, ...]:
    """The ``take``-th smallest key of a written table of distinct keys (``take`` from 1 to their number)."""
    key = F.struct(*_KEY)
    left, kept, round_no, written = keys, None, 0, None
    while True:
        round_no += 1
        found = left.mapInArrow(_medians, f"n long, {_KEY_TYPE}").collect()  # a row for each partition
        medians = sorted((tuple(r[1:]), r[0]) for r in found)
        n = sum(c for _, c in medians)
        if written is None:
            written = n
        if n <= few:
            return tuple(sorted(tuple(r) for r in left.select(*_KEY).collect())[take - 1])
        before = 0
        for pivot, c in medians:
            before += c
            if 2 * before >= n:
                break
        below = left.where(key <= _bound(pivot)).count()
        if below == take:
            return pivot
        if below > take:
            left, n = left.where(key < _bound(pivot)), below - 1
        else:
            left, n, take = left.where(key > _bound(pivot)), n - below, take - below
        if 4 * n <= written:  # later rounds read what is left only
            left, written = work.keep(left, f"left-{round_no}"), n
            if kept:
                work.drop(kept)
            kept = f"left-{round_no}"


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    few: int = FEW,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn), a row for each row of ``docs``.

    ``target`` has a column ``text``. Of the N rows with at least ``least_words``
    words, floor(``percent`` * N / 100) with the highest scores are drawn and
    ranked from 1; ties go to the smaller doc_id, a null doc_id coming last.
    Repeated rows are documents of their own and share their noise. Null and
    empty texts have no features, a weight of 0 and are not drawn. Empty tables
    of target texts or documents count 0 in every bucket.
    """
    work = Workspace(docs.sparkSession, "importance")
    gain = gains(counted(docs, longest), counted(target, longest))
    score = F.col("weight") + noise(F.col("doc_id"), seed)
    rows = weighed(docs, gain, longest).withColumn("score", score).withColumn("row", F.monotonically_increasing_id())
    scored = work.keep(rows, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    take = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not take:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    parts = [
        -F.col("score"),
        F.col("doc_id").isNull().cast("long"),
        F.coalesce("doc_id", F.lit(0).cast("long")),
        F.col("n_features"),
        F.col("row"),
    ]
    keyed = [p.alias(k) for k, p in zip(_KEY, parts)]
    last = cutoff(able.select(*keyed), take, work, few)
    drawn = (F.col("n_words") >= least_words) & (F.struct(*keyed) <= _bound(last))
    ranged = scored.where(drawn).select(*out, *keyed).repartitionByRange(*_KEY)
    winners = work.keep(ranged.withColumn("part", F.spark_partition_id()), "winners")
    counts = sorted(tuple(r) for r in winners.groupBy("part").count().collect())  # a row for each partition
    starts, before = [], 0
    for part, n in counts:
        starts.append((part, before))
        before += n
    starts = docs.sparkSession.createDataFrame(starts, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*_KEY))
    ranked = winners.join(F.broadcast(starts), "part").select(*out, (F.col("before") + within).alias("rank"))
    return scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")).unionByName(ranked)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weight towards the texts of ``benchmark``, its score and its rank among those drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, read(spark, sf_dir, "benchmark").select("text"))


OP11_SQL = r"""
WITH lowered AS (
    SELECT 0 AS side, doc_id AS id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
    UNION ALL
    SELECT 1, item_id,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    FROM benchmark),
texts AS (SELECT row_number() OVER () AS row_no, side, id, text FROM lowered),
words AS MATERIALIZED (
    SELECT row_no, side, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
spelled AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM words)),
bits AS (
    SELECT word, flatten(list_transform(range(length(digits) // 2), lambda i: [
        16 * (strpos('0123456789ABCDEF', substr(digits, 2 * i + 1, 1)) - 1)
           + strpos('0123456789ABCDEF', substr(digits, 2 * i + 2, 1)) - 1, 0, 0, 0, 0, 0, 0, 0])) AS steps
    FROM spelled),
hashed AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, steps), lambda c, b:
        CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END),
        4294967295::BIGINT) % 10000 AS bucket
    FROM bits),
counted AS (
    SELECT bucket, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t
    FROM words JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counted),
gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain
    FROM counted, sums),
weights AS (
    SELECT row_no, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
    FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row_no),
drawn AS (SELECT row_no, id, ('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT AS h FROM texts WHERE side = 0),
scored AS (
    SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000.0 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM drawn LEFT JOIN weights USING (row_no)),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
           count(*) FILTER (WHERE n_features >= 20) OVER () AS able
    FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank
FROM ranked
"""
