"""Quality rules (operator 3): plain counts and a hashed n-gram log-likelihood ratio.

Tokens (runs of letters and digits, runs of other signs) and pairs of neighbouring
tokens are hashed into a fixed number of buckets. Two multinomials over the buckets, one of trusted documents and one of all
documents, give each n-gram a weight, the logarithm of the ratio of its two
probabilities. A document's ratio is the sum of its n-grams' weights over their
number; documents below a threshold are rejected. Nothing is drawn at random.

DataFrame functions only: the weights, as many as there are buckets whatever the
corpus, come back to the driver and enter the scoring expression as a constant
array, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

BUCKETS = 10_000
#: Least mean log-likelihood ratio of an n-gram, in nats, of a document that is kept.
THRESHOLD = -0.25
#: Added to each bucket's count, as a share of the mean count of a bucket.
SMOOTHING = 0.1
MIN_WORDS = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]++|[^\p{L}\p{N}\x20\x09-\x0D]++"), 0
    )


def _grams(array: str, buckets: int) -> Column:
    """Buckets of the tokens and of each token with its follower (the last: with none).

    ``array`` must be a column, not an expression: a lambda would evaluate that again for each word.
    """
    return F.expr(
        f"concat(transform({array}, w -> pmod(xxhash64(w), {buckets}L)),"
        f" transform({array}, (w, i) -> pmod(xxhash64(w, get({array}, i + 1), 2), {buckets}L)))"
    )


def bucket_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The weight of each bucket: all documents against those that ``labels`` marks as of quality 1.

    Counts cover every word of every document. Without trusted documents all
    weights are 0 and the ratio says nothing.
    """
    trusted = labels.where("quality = 1").select("doc_id").distinct().withColumn("_trusted", F.lit(1))
    # Labels grow with the documents, so they are never broadcast.
    known = docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id", "left")
    split = known.select(_tokens(F.col("text")).alias("_tokens"), F.coalesce("_trusted", F.lit(0)).alias("_trusted"))
    pairs = split.select(
        "_trusted", F.expr("inline(arrays_zip(_tokens, slice(_tokens, 2, greatest(size(_tokens) - 1, 0))))")
    ).toDF("_trusted", "a", "b")
    grams = pairs.select(
        "_trusted",
        F.expr(f"stack(2, pmod(xxhash64(a), {buckets}L), pmod(xxhash64(a, b, 2), {buckets}L))").alias("bucket"),
    )
    counts = (
        grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_trusted").alias("n_trusted")).collect()
    )
    everywhere, in_trusted = sum(r.n for r in counts), sum(r.n_trusted for r in counts)
    weights = [0.0] * buckets
    if not in_trusted:
        return weights
    found = {r.bucket: r for r in counts}
    more_all, more_trusted = SMOOTHING * everywhere / buckets, SMOOTHING * in_trusted / buckets
    for b in range(buckets):
        n, t = (found[b].n, found[b].n_trusted) if b in found else (0, 0)
        weights[b] = math.log((t + more_trusted) / in_trusted) - math.log((n + more_all) / everywhere)
    return weights


def quality_columns(
    docs: DataFrame, weights: list[float], threshold: float = THRESHOLD, name: str = "_q"
) -> DataFrame:
    """``docs`` with a struct ``name`` of n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, llr and kept.

    A null or empty text has no words, hence fails the base rule; its ratio is 0.
    Columns of ``docs`` other than ``text`` are untouched, whatever their names:
    helper columns start with the given name.
    """
    w, windows, ordered, starts = (f"{name}_{x}" for x in ("words", "windows", "sorted", "starts"))
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(w, words(F.col("text")))
    # Hashes of all three-word windows: where they all differ, so do the windows.
    out = out.withColumn(
        windows,
        F.expr(
            f"transform(slice({w}, 1, greatest(size({w}) - 2, 0)),"
            f" (x, i) -> xxhash64(x, get({w}, i + 1), get({w}, i + 2)))"
        ),
    )
    # Other texts sort the windows themselves, so that equal ones are neighbours;
    # words hold no blanks, so joined windows differ where their words do.
    out = out.withColumn(
        ordered,
        F.expr(
            f"CASE WHEN size(array_distinct({windows})) < size({windows})"
            f" THEN array_sort(transform(slice({w}, 1, greatest(size({w}) - 2, 0)),"
            f" (x, i) -> struct(concat_ws(' ', x, get({w}, i + 1), get({w}, i + 2)) AS x, i AS i)))"
            f" ELSE cast(array() AS array<struct<x: string, i: int>>) END"
        ),
    )
    out = out.withColumn(
        starts,
        F.expr(
            f"array_sort(transform(filter({ordered}, (r, k) -> r.x <=> get({ordered}, k - 1).x"
            f" OR r.x <=> get({ordered}, k + 1).x), r -> r.i))"
        ),
    )
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    tokens, grams = f"{name}_tokens", f"{name}_grams"
    out = out.withColumn(tokens, _tokens(F.col("text")))
    out = out.withColumn(grams, _grams(tokens, len(weights)))
    out = out.withColumn(
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.expr(
                r"aggregate(array(filter(split(coalesce(text, ''), '\n'), x -> x RLIKE '[^\x20\x09-\x0D]')),"
                r" 0L, (a, x) -> cast(size(x) - size(array_distinct(x)) AS bigint))"
            ).alias("n_dup_lines"),
            # A window covers three words, fewer where the next repeated one begins earlier.
            F.expr(
                f"aggregate(transform({starts}, (p, k) -> least(3, coalesce(get({starts}, k + 1) - p, 3))),"
                " 0L, (a, x) -> a + x)"
            ).alias("n_repeat_words"),
            F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g.cast("int"))).alias("sum"),
            F.size(grams).alias("n_grams"),
        ),
    )
    q = F.col(name)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    llr = q["sum"] / F.greatest(q["n_grams"], F.lit(1))
    # Always true. A filter on the result would otherwise be moved below the arrays that it
    # is computed from, and their expressions evaluated again for each word; row numbers,
    # which must be drawn before rows are dropped, keep it above.
    drawn = F.monotonically_increasing_id() >= 0
    out = out.withColumn(
        name,
        F.struct(
            *[q[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            llr.alias("llr"),
            (~failed & (llr >= threshold) & drawn).alias("kept"),
        ),
    )
    return out.drop(w, windows, ordered, starts, tokens, grams)


def judged(docs: DataFrame, labels: DataFrame, name: str = "_q") -> DataFrame:
    """``quality_columns`` with weights counted from the same documents."""
    return quality_columns(docs, bucket_weights(docs, labels), name=name)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the base counts and rules and the verdict."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, read(spark, sf_dir, "labels")).select("doc_id", "_q.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    kept = judged(docs, read(spark, sf_dir, "labels"))
    return kept.where("_q.kept").select(*docs.columns)
