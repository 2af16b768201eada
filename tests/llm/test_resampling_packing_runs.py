"""Operators 11 to 13 against plain versions, over tables with everything that may go wrong."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesmith.llm import importance, packing, periodic_runs
from lakesmith.llm.crc import crc32
from lakesmith.llm.tables import Workspace
from lakesmith.llm.words import Words, portions

from . import brute
from .conftest import prose

tokenizers = pytest.importorskip("tokenizers")
WORD_BPE = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def same_multiset(a, b):
    assert Counter(a) == Counter(b)


def items(spark, folder):
    return [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


# 11: importance resampling


@given(st.lists(st.binary(max_size=90), max_size=30))
def test_crc_of_many_runs(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    start = end - np.array([len(p) for p in parts], np.int64)
    assert crc32(data, start, end).tolist() == [zlib.crc32(p) for p in parts]


def test_importance_equals_the_plain_version(spark, odd, documents):
    rows = importance.op11_importance(spark, odd).collect()
    same_multiset([tuple(r) for r in rows], brute.importance(documents, items(spark, odd)))


@pytest.mark.parametrize("longest", [2, 3])
def test_runs_of_several_words(spark, odd, documents, longest):
    docs, target = (spark.read.parquet(f"{odd}/{n}.parquet") for n in ("documents", "benchmark"))
    rows = importance.resampled(docs, target, longest, least_words=5, percent=40, few=1).collect()
    same_multiset([tuple(r) for r in rows], brute.importance(documents, items(spark, odd), longest, 5, 40))


def test_importance_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    found = importance.op11_importance(spark, folder)
    plain = db.execute(f"SELECT {', '.join(found.columns)} FROM ({importance.OP11_SQL})").fetchall()
    same_multiset([tuple(r) for r in found.collect()], plain)


def test_importance_of_empty_tables(spark, empty):
    assert importance.op11_importance(spark, empty).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_selection_finds_every_cutoff(spark, parts):
    rng = random.Random(parts)
    keys = [(-rng.randint(0, 9), int(rng.random() < 0.2), rng.randint(0, 30), 3, i) for i in range(500)]
    # One partition holds the smallest keys, so its median is far from the others'.
    frame = spark.createDataFrame(sorted(keys), importance._KEY_TYPE).repartitionByRange(parts, "k_score")
    work = Workspace(spark, "selection")
    frame = work.keep(frame, f"keys-{parts}")
    for take in (1, 2, 137, 250, 499, 500):
        assert importance.cutoff(frame, take, Workspace(spark, "cut"), few=1) == sorted(keys)[take - 1]


def test_equal_documents_share_weight_not_rank(spark):
    docs = spark.createDataFrame([(i, prose(1, 30)) for i in range(300)] + [(None, prose(1, 30))] * 100, "doc_id long, text string")
    rows = importance.resampled(docs, docs.limit(0)).collect()
    assert len({r.weight for r in rows}) == 1
    drawn = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 41))
    assert [r.score for r in drawn] == sorted((r.score for r in rows), reverse=True)[:40]


def test_portions_keep_all_rows():
    texts = [None, "", "x" * 50, "y", "z" * 10, "u" * 200, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    cut = [p.column(0).to_pylist() for p in portions(batch, "text", 30)]
    assert [t for p in cut for t in p] == texts and max(map(len, cut)) > 1 and len(cut) > 2


# 12: packing


ODD_TEXTS = st.lists(
    st.sampled_from(["it's", "don't,", "a.b.", "...", "x!?;", "J̌", "İ", "é,", "<|endoftext|>", "<|", "A<|startoftext|>b", "漢字。"])
    | st.text(max_size=12)
    | st.sampled_from([" ", "\n", " ", " ", "\x0b", "word", "Word.", "42,", "'S", "s'"]),
    max_size=12,
).map(lambda parts: "".join(p + (" " if i % 2 else "") for i, p in enumerate(parts)))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(WORD_BPE)


@pytest.fixture(scope="module")
def direct():
    model = tokenizers.Tokenizer.from_file(WORD_BPE)
    return lambda text: [*model.encode(text or "", add_special_tokens=False).ids, packing.END]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(ODD_TEXTS | st.none(), max_size=6))
def test_ids_are_those_of_the_tokenizer(encoder, direct, texts):
    ids, begin = encoder(pa.array(texts, pa.string()))
    assert [ids[lo:hi].tolist() for lo, hi in zip(begin[:-1], begin[1:])] == [direct(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(lengths=st.lists(st.integers(1, 150) | st.just(33), max_size=60))
def test_blocks_fill_all_windows_but_one(lengths):
    tiers = (8, 16, 32)
    windows, rest = packing.packed_block([(i, 0, n) for i, n in enumerate(lengths)], tiers)
    assert all(sum(p[2] for p in pieces) == tier and tier in tiers for tier, pieces in windows)
    assert sum(p[2] for p in rest) < max(tiers)
    ends = packing.at_powers(rest)
    assert all(sum(p[2] for p in pieces) == size and size & (size - 1) == 0 for size, pieces in ends)
    assert len({size for size, _ in ends}) == len(ends)
    covered = defaultdict(list)
    for _, pieces in windows + ends:
        for doc, start, length in pieces:
            assert length > 0
            covered[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[doc]):
            assert start == at
            at += length
        assert at == n


def test_documents_are_cut_only_where_nothing_fits():
    pieces = [(0, 0, 20), (1, 0, 12), (2, 0, 7), (3, 0, 5)]
    windows, rest = packing.packed_block(pieces, (8, 16, 32))
    assert (32, [(0, 0, 20), (1, 0, 12)]) in windows  # a long window's gap takes a shorter tier's piece whole
    assert (8, [(2, 0, 7), (3, 0, 1)]) in windows and rest == [(3, 1, 4)]


@pytest.mark.parametrize("block", [packing.BLOCK, 3000])
def test_packing_equals_direct_tokenization(spark, odd, documents, direct, block, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", block)
    monkeypatch.setattr(packing, "PORTION", 5000)
    rows = packing.op12_packing(spark, odd).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
    for pieces in sequences.values():
        at = 0
        for offset, length, tier in sorted(pieces):
            assert offset == at and length > 0 and tier <= 2048 and tier & (tier - 1) == 0
            at += length
        assert at == pieces[0][2]
    # Pieces of one document may be told apart from those of a repeated row only by their ids.
    want, got = Counter(), Counter()
    for doc_id, text, _ in documents:
        want[doc_id] += len(direct(text))
    for r in rows:
        got[r.doc_id] += r.length
    assert want == got
    named = Counter(i for i, _, _ in documents)
    ids = {i: np.array(direct(t), "<u4") for i, t, _ in documents if named[i] == 1}
    for r in rows:
        if r.doc_id in ids:
            own = ids[r.doc_id]
            assert r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())


def test_sequences_hold_the_ids_and_steps_are_level(spark, direct):
    docs = [(i, prose(i, 20 + i * 37 % 900)) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    sequences = packing.packed(frame, WORD_BPE).persist()
    ids = {i: direct(t) for i, t in docs}
    for r in sequences.collect():
        assert len(r.input_ids) == r.tier
        for p in r.pieces:
            own = ids[p.doc_id][p.start : p.start + p.length]
            assert r.input_ids[p.offset : p.offset + p.length] == own
    steps = packing.stepped(sequences.select("part", "tier", "number"), sequences, 16384).collect()
    by_tier = defaultdict(Counter)
    for r in steps:
        by_tier[r.tier][r.step] += 1
    n = 1 + max(r.step for r in steps)
    assert n > 5 and len(steps) == sequences.count()
    for counts in by_tier.values():
        assert max(counts.values()) - (min(counts.values()) if len(counts) == n else 0) <= 1
    sequences.unpersist()


def test_packing_of_empty_tables(spark, empty):
    assert packing.op12_packing(spark, empty).count() == 0


# 13: periodic runs


def test_z_function():
    word = [1, 1, 2, 1, 1, 2, 1, 1, 1]
    want = []
    for k in range(len(word)):
        m = 0
        while k + m < len(word) and word[m] == word[k + m]:
            m += 1
        want.append(m)
    assert periodic_runs.z_function(word, len(word)) == want


def _found(texts):
    rows = periodic_runs.fragments(Words(pa.array(texts, pa.string()), lower=False))
    out = [{} for _ in texts]
    for text, q, start, end in rows.tolist():
        if end - start >= 3 * q and end - start + q >= 6:
            at = (start, end - start + q)
            out[text][at] = min(q, out[text].get(at, q))
    return [sorted((start, q, n) for (start, n), q in o.items()) for o in out]


_UNIT = st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=12) | st.lists(st.sampled_from("abcdef"), max_size=40), st.integers(1, 9))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(_UNIT, max_size=6), min_size=1, max_size=4))
def test_fragments_are_all_runs(texts):
    lists = [[w for unit, n in units for w in unit * n] for units in texts]
    assert _found([" ".join(w) for w in lists]) == [brute.periodic_runs(w) for w in lists]


def test_runs_of_the_odd_table(spark, odd, documents):
    rows = periodic_runs.op13_periodic_runs(spark, odd).collect()
    same_multiset([tuple(r) for r in rows], [brute.collapsed(i, t) for i, t, _ in documents])
    assert sum(r.n_runs > 0 for r in rows) > 2


def test_runs_of_a_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = periodic_runs.op13_periodic_runs(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    same_multiset([tuple(r) for r in rows], [brute.collapsed(r.doc_id, r.text) for r in docs])


def test_stitching_of_intervals_from_different_tasks(spark):
    pieces = [(1, 5, 0, 30), (1, 5, 30, 44), (1, 5, 46, 70), (1, 10, 0, 39), (2, 5, 44, 46), (2, 1, 0, 4), (3, 1, 2, 7)]
    frame = spark.createDataFrame(pieces, "row long, period long, start long, end long")
    found = sorted(tuple(r) for r in periodic_runs.runs(frame).select("row", "start", "length", "period").collect())
    assert found == [(1, 0, 49, 5), (1, 46, 29, 5), (3, 2, 6, 1)]


def test_collapsed_texts(spark):
    docs = [(1, "so  ha ha ha\nha ha ha end"), (2, "a b a b a b a b c"), (3, "a b c a b c a b c"), (4, None), (4, ""), (None, "x " * 7)]
    out = periodic_runs.collapsed(spark.createDataFrame(docs, "doc_id long, text string"))
    got = sorted((repr(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    want = [
        ("1", [(1, 1, 6)], "so ha end"),
        ("2", [(0, 2, 8)], "a b c"),
        ("3", [], "a b c a b c a b c"),
        ("4", [], ""),
        ("4", [], ""),
        ("None", [(0, 1, 7)], "x"),
    ]
    assert got == want
    with pytest.raises(ValueError):
        periodic_runs.collapsed(out, exponent=3)


def test_runs_of_empty_tables(spark, empty):
    assert periodic_runs.op13_periodic_runs(spark, empty).count() == 0

