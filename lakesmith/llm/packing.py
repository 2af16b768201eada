"""Packing documents into training sequences (operator 12): hierarchical packing at several context sizes.

A document is its token ids and an end id. What fills whole windows of the longest
size goes there at once; the rest of each document is routed to the shortest tier
(context size) that holds it. Tiers are packed from the longest to the shortest.
Each of a tier's pieces opens a window, and the gap behind it is filled from
shorter tiers: by the longest piece that still fits, again and again. Only
where none fits is a piece cut, the shortest that is longer than the gap; what is
left of it is routed anew. So windows are full, and a full window of a shorter
tier is a sequence of its own that needs no padding.

Every task packs the documents it reads, block by block, and hands the one window
that it cannot fill to the next block; the last one is cut at powers of two. No
token is shuffled. Sequences are then dealt to steps: each tier's sequences go
round all steps in turn, so all steps have the same mix of tiers to one sequence
of each. For that only a row for each task and tier is gathered.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, built, read
from .words import _LOWER, _SPACE, Words, columns, portions

#: Context sizes, powers of two.
TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of a step.
STEP_TOKENS = 1 << 18
#: Tokens that are packed at a time.
BLOCK = 1 << 20
#: Bytes of text that are tokenized at a time.
PORTION = 1 << 20
#: Words whose ids a worker keeps.
CACHE = 1 << 18

_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i], start[i] + 1, ... of all runs, one after the other."""
    edges = np.cumsum(length)
    at = np.arange(int(edges[-1]) if len(edges) else 0)
    return at + np.repeat(start - (edges - length), length)


class Encoder:
    """Token ids of texts by a ``tokenizers`` file whose tokens never span white space.

    Distinct words are encoded once. White space parts words; signs that end a
    word behind a letter or digit are a word of their own. Words of ASCII are
    lower-cased, as the tokenizer does itself. Words are handed over many at a
    time, parted by one of the special tokens, which the tokenizer finds before
    anything else; a word that may hold such a token goes alone.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        special = sorted((i, t.content) for i, t in self.model.get_added_tokens_decoder().items() if t.special)
        self.gap, self.between = special[-1]
        self.known: dict[str, int] = {}
        self.ids, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        alone = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        many = words.filter(pa.array(~alone)).to_numpy(zero_copy_only=False).tolist()
        joined = [self.between.join(many[i : i + 500]) for i in range(0, len(many), 500)]
        found = [np.array([*e.ids, self.gap], np.int32) for e in self._run(joined)]
        flat = np.concatenate([np.zeros(0, np.int32), *found])
        ends = np.flatnonzero(flat == self.gap)
        own = [np.array(e.ids, np.int32) for e in self._run(words.filter(pa.array(alone)).to_pylist())]
        length = np.zeros(len(words), np.int64)
        length[~alone] = np.diff(ends, prepend=-1) - 1
        length[alone] = [len(x) for x in own]
        out = np.empty(int(length.sum()), np.int32)
        start = np.cumsum(length) - length
        out[_ragged(start[~alone], length[~alone])] = flat[flat != self.gap]
        if own:
            out[_ragged(start[alone], length[alone])] = np.concatenate(own)
        return out, length

    def _run(self, texts: list[str]) -> list:
        return self.model.encode_batch_fast(texts, add_special_tokens=False)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with END behind each, and where each text's ids begin (and the last's end)."""
        words = Words(texts, lower=False)
        start, end = words.start, words.end
        high = np.concatenate([[0], np.cumsum((words.data >= 0x80) | (words.data == ord("<")), dtype=np.int64)])
        plain = high[start] == high[end]
        inside = np.zeros(len(words.data) + 1, np.int8)
        inside[start[plain]] += 1
        inside[end[plain]] -= 1
        data = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, _LOWER[words.data], words.data)
        core = end.copy()
        for _ in range(3):
            core -= (core - start > 1) & _TAIL[data[core - 1]]
        core = np.where(_PLAIN[data[core - 1]], core, end)
        cut = np.flatnonzero(core < end)
        starts = np.insert(start, cut + 1, core[cut])
        ends = np.insert(core, cut + 1, end[cut])
        first = words.first + np.searchsorted(cut, words.first)
        length = ends - starts
        offsets = np.concatenate([[0], np.cumsum(length)])
        kept = data[~_SPACE[data]]
        spelled = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(kept))
        distinct = spelled.dictionary_encode()
        vocabulary = distinct.dictionary
        spellings = vocabulary.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.known.get, spellings, repeat(-1)), np.int64, len(vocabulary))
        fresh = vocabulary.filter(pa.array(place < 0))
        ids, n = self._encoded(fresh)
        all_ids = np.concatenate([self.ids, ids])
        edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(n)])
        new = np.arange(len(self.known), len(self.known) + len(fresh))
        if len(self.known) + len(fresh) <= CACHE:
            self.known.update(zip(spellings[place < 0], new.tolist()))
            self.ids, self.edges = all_ids, edges
        place[place < 0] = new
        word = place[distinct.indices.to_numpy()]
        n_ids = edges[word + 1] - edges[word]
        flat = all_ids[_ragged(edges[word], n_ids)]
        before = np.concatenate([[0], np.cumsum(n_ids)])[first]
        out = np.empty(len(flat) + len(texts), np.int32)
        begin = before + np.arange(len(texts) + 1)
        ends_at = begin[1:] - 1
        mask = np.ones(len(out), bool)
        mask[ends_at] = False
        out[mask], out[ends_at] = flat, END
        return out, begin


class Shelf:
    """Pieces by length. Finds the longest of at most some length, the shortest of more, in any range."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.some = 0  # bit n: there are pieces of length n

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.some |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        pile = self.by_length[length]
        doc, start = pile.pop()
        if not pile:
            self.some ^= 1 << length
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, or 0."""
        return max(0, (self.some & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self, over: int) -> int:
        """The least length above ``over``, or 0."""
        rest = self.some >> (over + 1)
        return (rest & -rest).bit_length() + over if rest else 0


Piece = tuple[int, int, int]


def packed_block(pieces: list[Piece], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows as (tier, pieces (document, start, length)), and the pieces of one window that is not full."""
    longest = max(tiers)
    out: list[tuple[int, list[Piece]]] = []
    shelf = Shelf(longest)
    for doc, start, length in pieces:
        while length >= longest:
            out.append((longest, [(doc, start, longest)]))
            start, length = start + longest, length - longest
        if length:
            shelf.put(doc, start, length)
    sizes = sorted(tiers)
    while shelf.some:
        n = shelf.longest(longest)
        tier = next(t for t in sizes if t >= n)
        window, gap = [shelf.take(n)], tier - n
        while gap and shelf.some:
            fits = shelf.longest(gap)
            if fits:
                window.append(shelf.take(fits))
                gap -= fits
                continue
            doc, start, length = shelf.take(shelf.shortest(gap))
            window.append((doc, start, gap))
            shelf.put(doc, start + gap, length - gap)
            gap = 0
        if gap:
            return out, window
        out.append((tier, window))
    return out, []


def at_powers(pieces: list[Piece]) -> list[tuple[int, list[Piece]]]:
    """The pieces, cut so that they fill sequences of falling powers of two."""
    left, out = sum(p[2] for p in pieces), []
    rest = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, length = rest.pop()
            if length > gap:
                rest.append((doc, start + gap, length - gap))
                length = gap
            window.append((doc, start, length))
            gap -= length
        out.append((size, window))
        left -= size
    return out


_PIECES = pa.list_(
    pa.struct(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64()), ("doc_tokens", pa.int64())]
    )
)
_SEQUENCES = (
    "part int, sequence_id long, tier int, number long, input_ids array<int>, "
    "pieces array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint, doc_tokens: bigint>>"
)


class Packer:
    """Buffers the documents of a task and packs them block by block."""

    def __init__(self, part: int, tiers: tuple[int, ...]):
        self.part, self.tiers, self.made, self.by_tier = part, tiers, 0, dict[int, int]()
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int]] = []  # doc_id, doc_tokens
        self.at: list[int] = []  # where a document's token 0 lies, or would lie, in the block's ids
        self.pieces: list[Piece] = []
        self.held = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, begin: np.ndarray) -> None:
        for doc_id, lo, hi in zip(doc_ids, begin[:-1].tolist(), begin[1:].tolist()):
            self.pieces.append((len(self.docs), 0, hi - lo))
            self.docs.append((doc_id, hi - lo))
            self.at.append(self.held + lo)
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        windows, rest = packed_block(self.pieces, self.tiers)
        if last:
            windows, rest = windows + at_powers(rest), []
        ids = np.concatenate([np.zeros(0, np.int32), *self.ids])
        batch = self._rows(windows, ids)
        docs, at, pieces, kept, held = [], [], [], [], 0
        for doc, start, length in rest:  # what one window lacks to be full goes on with the next block
            begin = self.at[doc] + start
            pieces.append((len(docs), start, length))
            docs.append(self.docs[doc])
            at.append(held - start)
            kept.append(ids[begin : begin + length])
            held += length
        self.docs, self.at, self.pieces, self.ids, self.held = docs, at, pieces, kept, held
        return batch

    def _rows(self, windows: list[tuple[int, list[Piece]]], ids: np.ndarray) -> pa.RecordBatch:
        flat = [p for _, window in windows for p in window]
        counts = np.array([len(window) for _, window in windows], np.int64)
        doc, start, length = (np.array([p[k] for p in flat], np.int64) for k in range(3))
        begin = np.array([self.at[p[0]] for p in flat], np.int64) + start
        all_ids = ids[_ragged(begin, length)]
        tier = np.array([t for t, _ in windows], np.int64)
        window_start = np.cumsum(tier) - tier
        offset = np.cumsum(length) - length - np.repeat(window_start, counts)
        numbers = []
        for t, _ in windows:
            numbers.append(self.by_tier.get(t, 0))
            self.by_tier[t] = numbers[-1] + 1
        own = pa.StructArray.from_arrays(
            [
                pa.array([self.docs[d][0] for d in doc.tolist()], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array(offset),
                pa.array([self.docs[d][1] for d in doc.tolist()], pa.int64()),
            ],
            names=["doc_id", "start", "length", "offset", "doc_tokens"],
        )
        lists = pa.ListArray.from_arrays
        edge = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        names = np.arange(self.made, self.made + len(windows)) + (self.part << 32)
        self.made += len(windows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(windows), self.part, np.int32)),
                pa.array(names.astype(np.int64)),
                pa.array(tier.astype(np.int32)),
                pa.array(numbers, pa.int64()),
                lists(edge(tier), pa.array(all_ids)),
                lists(edge(counts), own),
            ],
            names=["part", "sequence_id", "tier", "number", "input_ids", "pieces"],
        )


def packed(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Sequences: part, sequence_id, tier, number (within part and tier), input_ids and pieces.

    All windows are full: ``tier`` is the number of ids. ``pieces`` has in the
    order of their offsets what lies in a sequence: doc_id, start (the document's
    ids before it), length, offset and doc_tokens (of the whole document). Null
    and empty texts are the end id alone. Repeated rows are documents of their
    own; null doc_ids stay null. An empty table gives no sequences. A very long
    text is tokenized whole and then cut. ``part`` is the task that read the documents.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = built(held, Encoder)
        packer = Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for portion in portions(batch, "text", PORTION):
                doc_id, texts = columns(portion, "doc_id", "text")
                packer.add(doc_id.to_pylist(), *encoder(texts))
                if packer.held >= BLOCK:
                    yield packer.flush(False)
        if packer.held:
            yield packer.flush(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SEQUENCES)


def stepped(rows: DataFrame, sequences: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``rows`` (with part, tier and number, as ``sequences`` has them) with the step each sequence is trained in.

    A tier's sequences are dealt to all steps in turn, so steps differ by one
    sequence of a tier at most. What is joined has a row for each part and tier.
    """
    counts = sequences.groupBy("part", "tier").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum(F.col("n") * F.col("tier")).alias("n")).first()["n"] or 0
    steps = max(1, -(-total // step_tokens))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    step = (F.col("_before") + F.col("number")) % F.lit(steps)
    return rows.join(starts, ["part", "tier"]).withColumn("step", step).drop("_before")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with the CRC of its ids."""
    names = ["doc_id", "start", "length", "offset", "doc_tokens"]
    for batch in batches:
        ids, pieces = columns(batch, "input_ids", "pieces")
        flat, at = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(ids))])
        of = pc.list_parent_indices(pieces).to_numpy()
        own = dict(zip(names, pieces.flatten().flatten()))
        begin = at[of] + own["offset"].to_numpy()
        crc = [zlib.crc32(flat[lo:hi]) for lo, hi in zip(begin.tolist(), (begin + own["length"].to_numpy()).tolist())]
        rest = [batch.column(batch.schema.get_field_index(n)).take(pa.array(of)) for n in ("part", "sequence_id", "tier", "number")]
        yield pa.RecordBatch.from_arrays(
            [*own.values(), pa.array(crc, pa.int64()), *rest],
            names=[*names, "ids_crc32", "part", "sequence_id", "tier", "number"],
        )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document, where it lies, and the step of its sequence."""
    import public_tokenizers

    work = Workspace(spark, "packing")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sequences = work.keep(packed(docs, public_tokenizers.path("word_bpe_49k.json")), "sequences")
    pieces = sequences.mapInArrow(
        _digests,
        "doc_id long, start long, length long, offset long, doc_tokens long, ids_crc32 long, "
        "part int, sequence_id long, tier int, number long",
    )
    return stepped(pieces, sequences).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"
    )
