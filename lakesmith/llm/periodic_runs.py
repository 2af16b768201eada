"""Periodic runs (operator 13): maximal repetitions of words, found at every scale.

A run is a stretch that repeats a period of q words at least EXPONENT times. Periods
are searched by octaves P <= q < 2P. For each octave a document is exploded into
overlapping tiles: one at every boundary b that is a multiple of 2P, from b - 2P to
b + 4P. A run of period q has 3q or more positions that equal the one q further on,
so at some boundary the P words from b equal those from b + q. Rolling hashes of P
words find such tiles and periods for whole batches at once; a false one of these is
harmless. In a tile that has some, two Z-functions, of the words behind the boundary
and of those before it in reverse, give exactly how far each period holds, up to 2P
back and 3P ahead.

That leaves fragments (document, period, interval). Neighbouring boundaries' fragments
of one run touch, so all fragments of a document and period are stitched into maximal
intervals: those of one task's tiles before they are shuffled, and all of them by
document and period afterwards. The same stretch found with several periods is one run
of the smallest.

Tiles are made in the task that read the document, as they have three times its
words for each octave; only fragments and the documents that have some are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read
from .words import _BASE, _SPACE, U, Words, columns, mix, portions

#: A run has at least so many times its period, and so many words.
EXPONENT = 4
LEAST = 6

#: A text's words are in ``marked`` if it has intervals, else in ``plain``.
_FOUND = "plain string, marked string, periods array<long>, starts array<long>, ends array<long>"


def z_function(word: list[int], n: int) -> list[int]:
    """For k below ``n``: how many words from ``word[k]`` on equal those from ``word[0]`` on."""
    size = len(word)
    z = [0] * n
    z[0] = size
    lo = hi = 0
    for k in range(1, n):
        m = min(hi - k, z[k - lo]) if k < hi else 0
        while k + m < size and word[m] == word[k + m]:
            m += 1
        z[k] = m
        if k + m > hi:
            lo, hi = k, k + m
    return z


def _solved(words: list[int], b: int, scale: int, periods: list[int]) -> list[tuple[int, int, int]]:
    """Fragments (period, start, end) of matching positions around boundary ``b``.

    Position i matches for period q if words i and i + q are equal. A fragment goes
    2 * scale back at most, as the boundary before has the rest, and 3 * scale
    ahead, as a run may end so far behind the last boundary that finds it.
    """
    top = max(periods)
    ahead = z_function(words[b : b + 5 * scale], top + 1)
    left = words[max(0, b - 2 * scale) : b][::-1]
    right = words[b : b + top][::-1]
    # Read backwards, the words before b + q are compared with those before b.
    back = z_function([*left, -1, *right, *left], len(left) + 1 + top)
    behind = len(left) + 1 + top
    return [(q, b - (back[behind - q] if left else 0), b + min(ahead[q], 3 * scale)) for q in periods]


def _stitched(fragments: np.ndarray) -> np.ndarray:
    """Fragments (document, period, start, end) with those that touch made one."""
    f = fragments[np.lexsort(fragments.T[2::-1])]
    # Along a document and period, ends rise with starts: all are windows on disjoint intervals.
    new = np.ones(len(f), bool)
    new[1:] = (f[1:, 0] != f[:-1, 0]) | (f[1:, 1] != f[:-1, 1]) | (f[1:, 2] > f[:-1, 3])
    at = np.flatnonzero(new)
    out = f[at]
    out[:, 3] = np.maximum.reduceat(f[:, 3], at) if len(f) else out[:, 3]
    return out


def fragments(words: Words, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, period, start, end) of stitched intervals of matching positions in each text."""
    n = np.diff(words.first)
    # All texts that a period of the octave fits into, one after the other.
    code, size, number = words.hashes(), n, np.arange(len(n))
    kept = np.ones(len(code), bool)
    found = []
    rolled, scale = code, 1
    spelled: dict[int, list[int]] = {}
    begin = words.first[:-1]
    while True:
        fits = size >= exponent * scale
        if not fits.any():
            break
        if not fits.all():
            kept = np.repeat(fits, size)
            code, rolled = code[kept], rolled[kept]
            size, number = size[fits], number[fits]
        first = np.cumsum(size) - size
        place = np.arange(len(code)) - np.repeat(first, size)
        # Position b + q of a tile's boundary b: its offset within 2 * scale is q.
        q = place & (2 * scale - 1)
        inside = (place & scale).astype(bool) & (place + scale <= np.repeat(size, size))
        at = np.flatnonzero(inside)
        at = at[rolled[at] == rolled[at - q[at]]]
        if len(at):
            of = np.searchsorted(first, at, "right") - 1
            tile = at - q[at] - first[of]
            edges = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (tile[1:] != tile[:-1])]))
            rows = []
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                text = int(number[of[lo]])
                if text not in spelled:
                    own = slice(begin[text], begin[text] + n[text])
                    spelled[text] = _codes(words, own)
                for fragment in _solved(spelled[text], int(tile[lo]), scale, q[at[lo:hi]].tolist()):
                    rows.append((text, *fragment))
            found.append(_stitched(np.array(rows, np.int64)))
        # Hashes of 2 * scale words from those of scale words; those that leave a text are never compared.
        after = np.zeros_like(rolled)
        after[: len(rolled) - scale] = rolled[scale:]
        rolled = mix(rolled * U(_BASE) + after + U(scale))
        scale *= 2
    return np.concatenate([np.zeros((0, 4), np.int64), *found])


def _codes(words: Words, own: slice) -> list[int]:
    """A number for each distinct word of one text, by its bytes."""
    start, end = words.start[own], words.end[own]
    data = words.data[start[0] : end[-1]].tobytes()
    codes: dict[bytes, int] = {}
    bounds = zip((start - start[0]).tolist(), (end - start[0]).tolist())
    return [codes.setdefault(data[lo:hi], len(codes)) for lo, hi in bounds]


def _plain(words: Words) -> pa.Array:
    """Each text's words joined by one space."""
    size = words.end - words.start + 1
    last = words.first[1:][np.diff(words.first) > 0] - 1
    size[last] -= 1
    edges = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(edges[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[np.delete(edges[1:], last) - 1] = False
    out[inside] = words.data[~_SPACE[words.data]]
    return pa.StringArray.from_buffers(
        len(words.first) - 1, pa.py_buffer(edges[words.first].astype(np.int32)), pa.py_buffer(out)
    )


def _tiled(exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text"):
                doc_id, texts = columns(part, "doc_id", "text")
                words = Words(texts, lower=False)
                rows = fragments(words, exponent)
                # An interval that ends here is whole: tiles at all boundaries of the text have been solved.
                rows = rows[rows[:, 3] - rows[:, 2] >= (exponent - 1) * rows[:, 1]]
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                edges = np.searchsorted(rows[:, 0], np.arange(len(part) + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(rows[:, k]))) for k in (1, 2, 3)
                ]
                some, plain, none = pa.array(np.diff(edges) > 0), _plain(words), pa.scalar(None, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pc.if_else(some, none, plain), pc.if_else(some, plain, none), *lists],
                    names=["doc_id", "plain", "marked", "periods", "starts", "ends"],
                )

    return run


def runs(intervals: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """row, start, length and period of the runs that the intervals (row, period, start, end) add up to.

    Intervals that touch or overlap are stitched. Stretches found with several periods have the smallest.
    """
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(order))
    whole = marked.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.where(F.col("end") - F.col("start") >= (exponent - 1) * F.col("period"))
    length = F.col("end") - F.col("start") + F.col("period")
    least_period = whole.groupBy("row", "start", length.alias("length")).agg(F.min("period").alias("period"))
    return least_period.where(F.col("length") >= least)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that no run repeats, of texts whose words are parted by one space."""
    for batch in batches:
        doc_id, marked, found = columns(batch, "doc_id", "marked", "runs")
        out = []
        for text, own in zip(marked.to_pylist(), found.to_pylist()):
            words = text.split(" ")
            edge = np.zeros(len(words) + 1, np.int64)
            for r in own:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            out.append(" ".join(w for w, d in zip(words, gone.tolist()) if not d))
        yield pa.RecordBatch.from_arrays([doc_id, found, pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])


_RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, period, length; in this order) and the collapsed text of each row of ``docs``.

    In the collapsed text, the words that follow a run's first period are gone and
    the others are joined by one space. Null and empty texts have no runs and an
    empty collapsed text. Repeated rows are documents of their own; null doc_ids
    stay null. A very long text is solved by one task, in n log n steps for n words.
    ``exponent`` is 4 at least: fewer repeats may lie between two boundaries.
    """
    if exponent < 4:
        raise ValueError("exponent must be 4 or more")
    work = Workspace(docs.sparkSession, "periodic-runs")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tiled(exponent), f"doc_id long, {_FOUND}")
    tiled = work.keep(rows.withColumn("row", F.monotonically_increasing_id()), "tiled")
    no_runs = F.expr(f"cast(array() AS {_RUNS})")
    none = tiled.where("plain IS NOT NULL").select("doc_id", no_runs.alias("runs"), F.col("plain").alias("collapsed"))
    some = tiled.where("marked IS NOT NULL")
    each = some.select("row", F.explode(F.arrays_zip("periods", "starts", "ends")).alias("f"))
    intervals = each.select("row", *[F.col(f"f.{c}s").alias(c) for c in ("period", "start", "end")])
    by_row = runs(intervals, exponent, least).groupBy("row")
    by_row = by_row.agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    joined = some.select("row", "doc_id", "marked").join(by_row, "row", "left")
    joined = joined.select("doc_id", "marked", F.coalesce("runs", no_runs).alias("runs"))
    return none.unionByName(joined.mapInArrow(_kept, f"doc_id long, runs {_RUNS}, collapsed string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; in a tenth of the documents, by crc32(doc_id), the words from some place on repeat.

    With h the CRC, g = h / 10 (floored) and n words: if h % 10 = 0, word i from a = g % n on
    is word a + (i - a) % p with p = 1 + (n - a) / (3 + g % 8) (floored). A null doc_id has no CRC.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.coalesce((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def place(i: Column, n: Column) -> Column:
        g = F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        shown = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i, n)))
        return F.array_join(shown, " ")

    # A lambda over an array of one list of words: the list is made once.
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(chosen, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's runs, the one of greatest exponent, and digests of all of them and of the collapsed text."""
    docs = planted(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out = collapsed(docs)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *_best(), *_shown())


def _best() -> list[Column]:
    """The run of greatest length / period, compared as whole numbers; ties go to the smallest start, then period."""
    better = "x.length * y.period > y.length * x.period"
    best = F.expr(f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (y, x) -> IF({better}, x, y))")
    return [
        *[best[n].alias(n) for n in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
    ]


def _shown() -> list[Column]:
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return [F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")]
