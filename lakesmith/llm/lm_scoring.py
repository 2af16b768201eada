"""LM scoring (operator 1): prediction by partial matching over bytes, and a unigram base.

A text is its words, lower-cased, with one blank between words and one end sign.
The model is a trie of byte contexts of up to ORDER bytes, pretrained on all
training texts. A byte is predicted in the longest context; if it was never seen
there, an escape leads to the next shorter one, in which the bytes seen in the
longer one are excluded, and finally to equal chances. Counts lose half a
sighting to the escape (method D). A text's score is the sum of log10 chances.

How it is distributed:

* Training tasks count runs of ORDER + 1 bytes and words of their texts in numpy and
  send one array for each part of the key space; parts are summed in groups whose
  number grows with the texts. All training texts are counted whole.
* The table of counts is parted by the last SUFFIX bytes of the contexts, so a part has
  all longer contexts that a run may meet; shorter ones, which the alphabet bounds and
  not the texts, are sent to all tasks.
* A run's chance follows from the run alone. Those of the runs counted most often, as
  many as fit NODES entries, are a cache in the scoring task; all others, seen or not,
  are numbered once for each text, predicted from the whole trie of their part, and
  joined back. So scores follow from all counts at any size.
* Words counted often enough to fit WORDS entries are looked up in the scoring task;
  all other words meet their counts in a join, so the base is exact at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, built, read
from .words import U, Words, columns, mix

ORDER = 5
#: Entries of the scoring tasks' cache of runs.
NODES = 2 << 20
#: Contexts of fewer bytes are held by every task, longer ones by the part of their last SUFFIX bytes.
SUFFIX = 3
WORDS = 1 << 20
#: Bytes of text for each part of the key space.
PART_BYTES = 16 << 20
_START, _END = 0xFE, 0xFF  # bytes that UTF-8 never holds
_TOKENS = ORDER + 1  # kind of the word counts; kinds 0 to ORDER are context lengths
_END_WORD = U(0x7F4A7C15E0D9)
_SLICE = 1 << 20
_THRESHOLDS = sorted({int(round(2 ** (i / 2))) for i in range(100)})
#: Spreads the last bytes of a context, without overflow in 63 bits.
_SPREAD = 0x2545F4914F
_COUNTS = "kind int, part int, keys binary, counts binary"


def _mask(order: int) -> U:
    return U((1 << (8 * (order + 1))) - 1)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of runs of SUFFIX + 1 bytes or more; as ``_PART`` in SQL."""
    suffix = (keys >> U(8)) & U((1 << (8 * SUFFIX)) - 1)
    return ((suffix * U(_SPREAD)) >> U(14)) % U(parts)


_PART = f"cast(shiftright((shiftright(run, 8) & {(1 << (8 * SUFFIX)) - 1}L) * {_SPREAD}L, 14) % {{parts}} AS int)"


def normalized(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after ORDER start signs and before an end sign, and where each begins."""
    n, size = len(words.first) - 1, words.end - words.start
    count = np.diff(words.first)
    length = ORDER + 1 + np.maximum(count - 1, 0)
    np.add.at(length, words.doc(), size)
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(at[-1]), ord(" "), np.uint8)
    out[(at[:-1, None] + np.arange(ORDER)).ravel()] = _START
    out[at[1:] - 1] = _END
    # Each word moves as far as the blanks and signs before it add up to.
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    doc = words.doc()
    rank = np.arange(len(size)) - words.first[doc]
    begin = at[doc] + ORDER + rank + before - before[words.first[doc]] if len(size) else before
    inside = np.repeat(begin - before, size) + np.arange(int(size.sum()))
    source = np.repeat(words.start - before, size) + np.arange(int(size.sum()))
    out[inside] = words.data[source]
    return out, at


def runs(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ORDER + 1 bytes that begin in lo .. hi - 1, and which are predictions of a text."""
    hi = min(hi, len(data) - ORDER)
    key = np.zeros(hi - lo, U)
    for k in range(ORDER + 1):
        key <<= U(8)
        key |= data[lo + k : hi + k]
    return key, data[lo + ORDER : hi + ORDER] != _START


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def _counted(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {ORDER: [], _TOKENS: []}

        def add(kind: int, keys: np.ndarray) -> None:
            found = np.unique(keys, return_counts=True)
            kept[kind].append((found[0], found[1].astype(np.int64)))
            if sum(len(x[0]) for x in kept[kind][1:]) > max(1 << 19, len(kept[kind][0][0]) // 2):
                kept[kind] = [summed(*map(np.concatenate, zip(*kept[kind])))]

        for batch in batches:
            for at in range(0, len(batch), 1000):
                words = Words(batch.column(0).slice(at, 1000))
                add(_TOKENS, np.concatenate([words.hashes(), np.full(len(words.first) - 1, _END_WORD)]))
                data, begin = normalized(words)
                for lo in range(0, max(0, len(data) - ORDER), _SLICE):
                    key, own = runs(data, begin, lo, lo + _SLICE)
                    add(ORDER, key[own])
        levels = {k: summed(*map(np.concatenate, zip(*v))) for k, v in kept.items() if v}
        if ORDER in levels:
            for order in range(ORDER - 1, -1, -1):
                keys, counts = levels[order + 1]
                levels[order] = summed(keys & _mask(order), counts)
        for kind, (keys, counts) in levels.items():
            part = _part(keys, parts) if SUFFIX <= kind <= ORDER else mix(keys) % U(parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                own = order[edges[p] : edges[p + 1]]
                if len(own):
                    yield pa.RecordBatch.from_pylist(
                        [{"kind": kind, "part": p, "keys": keys[own].tobytes(), "counts": counts[own].tobytes()}],
                        pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]),
                    )

    return run


def _arrays(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, U), np.frombuffer(counts, np.int64)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    both = [_arrays(k, c) for k, c in zip(group["keys"], group["counts"])]
    keys, counts = summed(*map(np.concatenate, zip(*both)))
    return pd.DataFrame(
        {
            "kind": [group["kind"].iloc[0]],
            "part": [group["part"].iloc[0]],
            "keys": [keys.tobytes()],
            "counts": [counts.tobytes()],
        }
    )


def _contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each context begins in the sorted keys, and which one each key is of."""
    context = keys >> U(8)
    first = np.concatenate([[True], context[1:] != context[:-1]]) if len(keys) else np.empty(0, bool)
    return np.flatnonzero(first), np.cumsum(first) - 1


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part of the longest runs and of the words: its sum, and how many keys reach each threshold."""
    for batch in batches:
        for row in batch.to_pylist():
            _, counts = _arrays(row["keys"], row["counts"])
            reach = (len(counts) - np.searchsorted(np.sort(counts), _THRESHOLDS)).tolist()
            yield pa.RecordBatch.from_pydict(
                {
                    "tokens": pa.array([row["kind"] == _TOKENS]),
                    "sum": pa.array([int(counts.sum())]),
                    "reach": pa.array([reach], pa.list_(pa.int64())),
                }
            )


def _held(nodes: int, words: int):
    """What tasks hold: words counted often, short contexts, and the chances of runs counted often (log10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                keys, counts = _arrays(row["keys"], row["counts"])
                if row["kind"] == _TOKENS:
                    keep = counts >= words
                    keys, counts = keys[keep], counts[keep]
                elif row["kind"] == ORDER:
                    # A part has all runs of a context: their sum is the context's.
                    begin, of = _contexts(keys)
                    value = np.log10((counts - 0.5) / np.add.reduceat(counts, begin)[of])
                    keep = counts >= nodes
                    keys, counts = keys[keep], value[keep].astype(np.float32)
                row |= {"keys": keys.tobytes(), "counts": counts.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return run


def _seldom(words: int):
    """Rows (word, c) of the words that the scoring tasks do not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _arrays(row["keys"], row["counts"])
                keep = counts < words
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[keep].view(np.int64)), pa.array(counts[keep])], names=["word", "c"]
                )

    return run


class Lookup:
    """A hash table from 64-bit keys to numbers, asked for whole arrays; built where it is first used."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.table = keys, values, None

    def _build(self) -> None:
        bits = max(4, int(2 * len(self.keys)).bit_length())
        self.shift = U(64 - bits)
        slots, row = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(self.keys), dtype=np.int32)
        place = ((self.keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        while len(left):
            free = row[place[left]] < 0
            row[place[left[free]]] = left[free]  # of those that meet, the last stays
            left = left[row[place[left]] != left]
            place[left] = (place[left] + 1) & (len(row) - 1)
        full = row >= 0
        slots[full] = self.keys[row[full]]
        self.table = (slots, row)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key in ``values``, -1 where there is none."""
        if self.table is None:
            self._build()
        slots, row = self.table
        place = ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = row[place]
        left = np.flatnonzero((out >= 0) & (slots[place] != keys))
        while len(left):
            place[left] = (place[left] + 1) & (len(row) - 1)
            out[left] = row[place[left]]
            left = left[(out[left] >= 0) & (slots[place[left]] != keys[left])]
        return out


class Trie:
    """The pretrained contexts. ``levels[o]``: sorted keys (o context bytes, then the byte) and counts.

    Values have a 0 at the end, where Lookup's -1 leads.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.symbols, self.contexts = [], []
        closed = lambda x: np.append(x.astype(np.float64), 0.0)
        for order, (keys, counts) in enumerate(levels):
            begin, _ = _contexts(keys)
            total = np.add.reduceat(counts, begin) if len(begin) else np.empty(0)
            kinds = np.diff(np.concatenate([begin, [len(keys)]])) if len(begin) else np.empty(0)
            if order and len(keys):
                # What the next shorter context has counted of the bytes seen in this one.
                below_keys, below = levels[order - 1]
                shared = np.add.reduceat(below[np.searchsorted(below_keys, keys & _mask(order - 1))], begin)
            else:
                shared = np.zeros(len(begin))
            self.contexts.append((Lookup(keys[begin] >> U(8), None), closed(total), closed(kinds), closed(shared)))
            self.symbols.append((Lookup(keys, None), closed(counts)))

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the chance of the last byte of each run after its first ORDER bytes."""
        return self._escaped(key)

    def _escaped(self, key: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(key)), np.arange(len(key))
        total_out = np.zeros(len(key))  # of the context, counted for excluded bytes
        kinds_out = np.zeros(len(key))
        for order in range(ORDER, -1, -1):
            run = key[left] & _mask(order)
            find, total, kinds, shared = self.contexts[order]
            at = find(run >> U(8))
            known = at >= 0
            t = np.where(known, total[at] - total_out[left], 0)
            d = np.where(known, kinds[at] - kinds_out[left], 0)
            symbol, counts = self.symbols[order]
            row = np.where(known, symbol(run), -1)
            hit = row >= 0
            out[left[hit]] += np.log10((counts[row[hit]] - 0.5) / t[hit])
            escape = ~hit & (d > 0)
            out[left[escape]] += np.log10(0.5 * d[escape] / t[escape])
            total_out[left] = np.where(known, shared[at], 0)
            kinds_out[left] = np.where(known, kinds[at], 0)
            left = left[~hit]
        out[left] -= np.log10(256 - kinds_out[left])
        return out


class Model:
    """All that a scoring task holds: the chances of frequent runs and the counts of frequent words."""

    def __init__(self, parts: tuple):
        runs_held, words, self.floor = parts
        self.runs, self.words = Lookup(*runs_held), Lookup(*words)


def _predicted(low):
    """Rows (run, value): log10 of the chances of a part's runs, from all counts of the part."""

    def run(asked: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        levels = list(low.value) + [(np.empty(0, U), np.empty(0, np.int64))] * (ORDER + 1 - SUFFIX)
        for kind, keys, n in zip(counts["kind"], counts["keys"], counts["counts"]):
            levels[kind] = _arrays(keys, n)
        runs_asked = asked["run"].to_numpy(np.int64)
        value = Trie(levels).log10(runs_asked.view(U)) if len(runs_asked) else np.empty(0)
        return pd.DataFrame({"run": runs_asked, "value": value})

    return run


def _scored(held):
    fields = pa.schema(
        [
            ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
            ("base", pa.float64()), ("score", pa.float64()), ("word", pa.int64()), ("run", pa.int64()),
            ("n", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = built(held, Model)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rid, doc_id, texts = columns(batch.slice(at, 1000), "rid", "doc_id", "text")
                words = Words(texts)
                n_docs = len(texts)
                doc = np.concatenate([words.doc(), np.arange(n_docs)])
                h = np.concatenate([words.hashes(), np.full(n_docs, _END_WORD)])
                row = model.words(h)
                known = row >= 0
                value = np.zeros(len(h))
                if known.any():
                    value[known] = np.log10(model.words.values[row[known]] + 0.5)
                value -= model.floor
                value[~known] = 0
                n_known = np.bincount(doc[known], minlength=n_docs)
                base = np.bincount(doc, value, n_docs)
                data, begin = normalized(words)
                score, undecided = np.zeros(n_docs), []
                for lo in range(0, max(0, len(data) - ORDER), _SLICE):
                    key, own = runs(data, begin, lo, lo + _SLICE)
                    place = np.flatnonzero(own)
                    of, key = np.searchsorted(begin, place + lo, "right") - 1, key[place]
                    row = model.runs(key)
                    hit = row >= 0
                    score += np.bincount(of[hit], model.runs.values[row[hit]].astype(np.float64), n_docs)
                    undecided.append((of[~hit], key[~hit]))
                none = [None] * n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        rid, doc_id, pa.array(np.diff(words.first) + 1), pa.array(n_known), pa.array(base),
                        pa.array(score), *[pa.array(none, pa.int64())] * 3,
                    ],
                    schema=fields,
                )
                # Words whose counts and runs whose chances come by a join, once for each text.
                of, key = map(np.concatenate, zip(*undecided)) if undecided else (np.empty(0, np.int64), np.empty(0, U))
                for column, doc_of, asked in (("word", doc[~known], h[~known]), ("run", of, key)):
                    if not len(asked):
                        continue
                    by = np.lexsort((asked, doc_of))
                    doc_of, asked = doc_of[by], asked[by]
                    first = np.flatnonzero(
                        np.concatenate([[True], (doc_of[1:] != doc_of[:-1]) | (asked[1:] != asked[:-1])])
                    )
                    rows = {
                        "rid": rid.take(pa.array(doc_of[first])),
                        column: pa.array(asked[first].view(np.int64)),
                        "n": pa.array(np.diff(np.append(first, len(asked)))),
                    }
                    yield pa.RecordBatch.from_arrays(
                        [rows[f.name] if f.name in rows else pa.nulls(len(first), f.type) for f in fields], schema=fields
                    )

    return run


def _threshold(sizes: list, most: int) -> int:
    """The least count of which at most ``most`` keys are counted as often or more."""
    return next((t for t, n in zip(_THRESHOLDS, sizes) if n <= most), _THRESHOLDS[-1] + 1)


def trained(work: Workspace, texts: DataFrame) -> tuple[tuple, list, DataFrame, DataFrame, int, int]:
    """Of all ``texts``: the parts of the ``Model``, the levels of short contexts, the counts (word, c)
    of the words that the model does not hold, all counts, the number of their parts, and all words' number.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(size / PART_BYTES))
    counted = texts.select("text").mapInArrow(_counted(parts), _COUNTS)
    counts = work.keep(counted.groupBy("kind", "part").applyInPandas(_merged, _COUNTS), "counts")
    per_part = counts.where(f"kind IN ({ORDER}, {_TOKENS})").mapInArrow(
        _sizes, "tokens boolean, sum long, reach array<long>"
    )
    sums = [F.sum(F.get("reach", F.lit(i))).alias(f"r{i}") for i in range(len(_THRESHOLDS))]
    found = {r["tokens"]: r for r in per_part.groupBy("tokens").agg(F.sum("sum").alias("sum"), *sums).collect()}
    reach = {k: [r[f"r{i}"] for i in range(len(_THRESHOLDS))] for k, r in found.items()}
    total, distinct = (found[True]["sum"], reach[True][0]) if True in found else (0, 0)
    least = {False: _threshold(reach.get(False, []), NODES), True: _threshold(reach.get(True, []), WORDS)}
    few = counts.where(f"kind < {SUFFIX} OR kind IN ({ORDER}, {_TOKENS})")
    held = few.mapInArrow(_held(least[False], least[True]), _COUNTS).toArrow()
    by_kind: dict[int, list] = {k: [(np.empty(0, U), np.empty(0, np.int64))] for k in (*range(SUFFIX), _TOKENS)}
    by_kind[ORDER] = [(np.empty(0, U), np.empty(0, np.float32))]
    for kind, keys, n in zip(*(held.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
        by_kind[kind].append((np.frombuffer(keys, U), np.frombuffer(n, by_kind[kind][0][1].dtype)))
    del held
    low = [summed(*map(np.concatenate, zip(*by_kind[o]))) for o in range(SUFFIX)]
    words = summed(*map(np.concatenate, zip(*by_kind[_TOKENS])))
    often = tuple(map(np.concatenate, zip(*by_kind[ORDER])))
    rest = counts.where(f"kind = {_TOKENS}").mapInArrow(_seldom(least[True]), "word long, c long")
    floor = math.log10(total + 0.5 * (distinct + 1)) if total else 0.0
    return (often, words, floor), low, rest, counts, parts, total


def scored(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score, a row for each row of ``docs``.

    A null text is an empty one: only its end is scored. Without training texts
    all chances are equal and the base is 0.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lm-scoring")
    model, low, seldom, counts, parts, total = trained(work, training)
    floor = model[2]
    run = _scored(spark.sparkContext.broadcast(model))
    predicted = _predicted(spark.sparkContext.broadcast(low))
    del model, low
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    schema = "rid long, doc_id long, n_tokens long, n_known long, base double, score double, word long, run long, n long"
    out = work.keep(rows.mapInArrow(run, schema), "scored")
    rare = out.where("word IS NOT NULL").select("rid", "word", "n").join(seldom, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * (F.log10(c + 0.5) - floor)).alias("more_base"),
    )
    asked = out.where("run IS NOT NULL").select("rid", "run", "n")
    distinct = asked.select("run").distinct().withColumn("part", F.expr(_PART.format(parts=parts)))
    long_contexts = counts.where(f"kind BETWEEN {SUFFIX} AND {ORDER}")
    values = distinct.groupBy("part").cogroup(long_contexts.groupBy("part")).applyInPandas(
        predicted, "run long, value double"
    )
    # Both grow with the documents: no broadcast, whatever their number here.
    joined = asked.join(work.keep(values, "values").hint("merge"), "run")
    joined = joined.groupBy("rid").agg(F.sum(F.col("n") * F.col("value")).alias("more_score"))
    whole = out.where("word IS NULL AND run IS NULL").join(rare, "rid", "left").join(joined, "rid", "left")
    return whole.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the model of the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    result = scored(docs, docs.where(~out))
    return result.select("doc_id", out.alias("held_out"), *result.columns[1:])
