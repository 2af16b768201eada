"""Benchmark decontamination (operator 8): CGK embedding, bit-sampling LSH, exact edit distance.

Texts and items are sequences of words, lower-cased, without ASCII punctuation. A
document is contaminated by an item of n words if some run of its words has an
edit distance of at most n / 5 (similarity 0.8) to the item.

Windows of an item's size are compared with it by the CGK walk: both sequences are
walked with the same random bits, standing still or stepping on by the word under
the foot. The walks of sequences of small edit distance fall in step again after
each edit, so their outputs have a small Hamming distance. Each of REPEATS walks
samples SAMPLED places of its output; equal samples in any of them make a
candidate, and the exact edit distance over the surroundings decides.

Only windows that can be within the distance are embedded: of n words with e edits
some run of (n - e) / (e + 1) words is unchanged, which is three words or more from
six words on. A window stands wherever such a run of an item occurs in a text, and
every text is searched whole. This filter loses nothing.

Documents are never shuffled. Items reach the tasks in blocks of bounded size, one
pass over the documents each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import built, read
from .words import U, Words, chained, columns, mix, runs_of_text

#: One edit is allowed for so many words of an item.
WORDS_PER_EDIT = 5
REPEATS, SAMPLED = 48, 3
#: Bytes of items that are held by a task at once.
ITEM_BYTES = 8 << 20
_BITS = 20

_COUNTS = np.ones(256, bool)
_COUNTS[[c for c in range(33, 127) if not chr(c).isalnum()]] = False
_EMPTY = mix(np.zeros(1, U))[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words that hold more than punctuation, and where each text's begin."""
    words = Words(texts)
    h = words.hashes(_COUNTS)
    at = np.flatnonzero(h != _EMPTY)
    return h[at], np.searchsorted(at, words.first)


def allowed(n: int) -> int:
    return n // WORDS_PER_EDIT


def seed_length(n: int) -> int:
    """A run of so many unchanged words is left in any sequence within the allowed distance."""
    e = allowed(n)
    return min(3, -(-(n - e) // (e + 1)))


def walked(rows: np.ndarray, length: np.ndarray, walk: int) -> np.ndarray:
    """Samples of one CGK walk over rows of word hashes, padded; ``length`` has their sizes.

    A walk of 3n steps for n words; the sampled steps are those of the item's own size.
    """
    n, width = rows.shape
    steps = 3 * int(length.max(initial=1))
    factors = mix(np.arange(steps, dtype=U) + U((walk + 1) << 20)) | U(1)
    padded = np.zeros((n, width + 1), U)
    padded[:, :width] = rows
    flat, base = padded.ravel(), np.arange(n) * (width + 1)
    place, last = base.copy(), base + length
    seen = np.empty((steps, n), U)
    for step in range(steps):
        here = flat[place]
        seen[step] = here
        place += ((here * factors[step]) >> U(63)).astype(np.int64)
        np.minimum(place, last, out=place)
    out = np.zeros(n, U)
    for k in range(SAMPLED):
        pick = mix(np.array([walk * SAMPLED + k + 1], U))[0] % (U(3) * length.astype(U))
        out += seen[pick.astype(np.int64), np.arange(n)] * U(2 * k + 3)
    return out


def least_distance(item: list[int], region: list[int]) -> int:
    """The least edit distance between the item and any run of the region (bit-parallel)."""
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best = score
    for w in region:
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        best = min(best, score)
    return best


class Items:
    """A block of items: their words, seeds and samples."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        h, first = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.words = [], []
        for item, lo, hi in zip(ids, first[:-1], first[1:]):
            if hi > lo and item is not None:
                self.ids.append(item)
                self.words.append(h[lo:hi])
        self.size = np.array([len(w) for w in self.words], np.int64)
        width = int(self.size.max(initial=1))
        padded = np.zeros((len(self.words), width), U)
        for row, w in zip(padded, self.words):
            row[: len(w)] = w
        self.width = width
        self.samples = np.array([walked(padded, self.size, r) for r in range(REPEATS)]) if len(self.words) else None
        self.seeds = {}
        for length in (1, 2, 3):
            found = [
                (key, item, offset)
                for item, w in enumerate(self.words)
                if seed_length(len(w)) == length
                for offset, key in enumerate(chained(w, length).tolist())
            ]
            if found:
                found.sort()
                key = np.array([x[0] for x in found], U)
                table = np.zeros(1 << _BITS, bool)
                table[key >> U(64 - _BITS)] = True
                rest = np.array([x[1:] for x in found], np.int64)
                self.seeds[length] = (table, key, rest[:, 0], rest[:, 1])

    def windows(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, begin) of every window of an item's size that a seed of it points to."""
        found = []
        for length, (table, keys, item, offset) in self.seeds.items():
            runs = chained(h, length)
            at = np.flatnonzero(table[runs >> U(64 - _BITS)] & runs_of_text(first, length))
            lo = np.searchsorted(keys, runs[at], "left")
            n = np.searchsorted(keys, runs[at], "right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(at, n)
            doc = np.searchsorted(first, place, "right") - 1
            found.append(np.stack([doc, item[row], place - offset[row]]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, 1), axis=1))

    def candidates(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """The windows whose samples agree with their item's in some walk."""
        doc, item, begin = self.windows(h, first)
        keep = np.zeros(len(doc), bool)
        for at in range(0, len(doc), 4096):
            part = slice(at, at + 4096)
            size = self.size[item[part]]
            place = begin[part, None] + np.arange(self.width)
            inside = (place >= first[doc[part]][:, None]) & (place < first[doc[part] + 1][:, None])
            inside &= np.arange(self.width) < size[:, None]
            rows = np.where(inside, h[np.clip(place, 0, len(h) - 1)], U(0))
            for r in range(REPEATS):
                left = np.flatnonzero(~keep[part])
                if not len(left):
                    break
                same = walked(rows[left], size[left], r) == self.samples[r][item[part][left]]
                keep[at + left[same]] = True
        return list(zip(doc[keep].tolist(), item[keep].tolist(), begin[keep].tolist()))

    def matches(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each text, the items found in it with their least edit distance."""
        h, first = word_hashes(texts)
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        if not self.ids or not len(h):
            return out
        # Windows of one item that lie close together are verified as one region.
        regions: list[list[int]] = []
        for doc, item, begin in self.candidates(h, first):
            slack = 2 * allowed(int(self.size[item]))
            if regions and regions[-1][:2] == [doc, item] and begin - regions[-1][3] <= slack:
                regions[-1][3] = begin
            else:
                regions.append([doc, item, begin, begin])
        for doc, item, begin, last in regions:
            n = int(self.size[item])
            e = allowed(n)
            lo, hi = max(begin - 2 * e, int(first[doc])), min(last + n + 2 * e, int(first[doc + 1]))
            d = least_distance(self.words[item].tolist(), h[lo:hi].tolist())
            if d <= e:
                out[doc][self.ids[item]] = min(d, out[doc].get(self.ids[item], d))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, name: str = "_items") -> DataFrame:
    """``docs`` with an array ``name`` of (item_id, distance), by item_id; empty where nothing is found.

    Null and empty texts contain nothing; items without words match nothing.
    Items with one id count as variants of one item. Other columns pass unchanged.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = total // ITEM_BYTES + 1
    found = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    out = docs.withColumn(name, F.expr("cast(array() AS array<struct<item_id: bigint, distance: int>>)"))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        held = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def searched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = built(held, lambda value: Items(*value))
            for batch in batches:
                for at in range(0, max(1, len(batch)), 1000):
                    part = batch.slice(at, 1000)
                    texts, before = columns(part, "text", name)
                    hits = []
                    for old, new in zip(before.to_pylist(), items.matches(texts)):
                        for x in old:
                            new[x["item_id"]] = min(x["distance"], new.get(x["item_id"], x["distance"]))
                        hits.append([{"item_id": i, "distance": d} for i, d in sorted(new.items())])
                    arrays = [
                        pa.array(hits, found) if f.name == name else part.column(i)
                        for i, f in enumerate(part.schema)
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=part.schema.names)

        out = out.mapInArrow(searched, out.schema)
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the benchmark items that it contains, over whole texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        (F.size("_items") > 0).alias("contaminated"),
        F.col("_items.item_id").alias("item_ids"),
        F.col("_items.distance").alias("distances"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    out = contaminated(docs, read(spark, sf_dir, "benchmark"), "_items")
    return out.where(F.size("_items") == 0).select(*docs.columns)
