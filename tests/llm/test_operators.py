"""Every operator against a plain version of its contract, on odd and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesmith.llm import (
    decontamination,
    line_templates,
    lm_scoring,
    mixing,
    near_duplicates,
    personal_data,
    quality_classifier,
    quality_rules,
    sharding,
    toxicity,
)
from lakesmith.llm.queries import QUERIES
from lakesmith.llm.words import Words, chained

from . import brute
from .conftest import ITEM, WORDS, edited, prose, run


def same_multiset(mine, theirs):
    assert Counter(map(repr, mine)) == Counter(map(repr, theirs))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_row_for_each_row(spark, odd, documents, name):
    got = QUERIES[name](spark, odd).select("doc_id").collect()
    same_multiset([r.doc_id for r in got], [d[0] for d in documents])


def test_words_of_a_batch():
    texts = [None, "", " ", "a B\tc\x0bd", "é漢 x\x1fy", "z" * 10, "a b"]
    words = Words(pa.array(texts))
    assert np.diff(words.first).tolist() == [len(brute.words(t)) for t in texts]
    hashes = words.hashes()
    flat = [w for t in texts for w in brute.words(t, True)]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a == b)
    assert len(chained(hashes, 3)) == len(flat) - 2 and len(chained(hashes[:1], 2)) == 0


def test_hashes_do_not_depend_on_slices(monkeypatch):
    from lakesmith.llm import words as module

    texts = pa.array([prose(1, 500), "w" * 5000, prose(2, 300)])
    whole = Words(texts).hashes()
    monkeypatch.setattr(module, "_SPAN", 64)
    assert (Words(texts).hashes() == whole).all()


# 1: LM scoring


@pytest.mark.parametrize("held", [lm_scoring.WORDS, 10])
def test_unigram_base(spark, odd, documents, monkeypatch, held):
    monkeypatch.setattr(lm_scoring, "WORDS", held)  # few: most words meet their counts in the join
    got = lm_scoring.op1_lm_scoring(spark, odd).collect()
    mine = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    same_multiset(mine, [(*r[:5], round(r[5], 6)) for r in brute.unigram(documents)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def _ppm(train, text, order):
    """Plain PPM with escape method D and exclusion over nested contexts."""
    counts = defaultdict(Counter)
    sign = lambda t: [lm_scoring._START] * order + list(" ".join(brute.words(t, True)).encode()) + [lm_scoring._END]
    for t in train:
        b = sign(t)
        for i in range(order, len(b)):
            for o in range(order + 1):
                counts[tuple(b[i - o : i])][b[i]] += 1
    total, b = 0.0, sign(text)
    for i in range(order, len(b)):
        out = set()
        for o in range(order, -1, -1):
            seen = counts.get(tuple(b[i - o : i]))
            if not seen:
                out = set()
                continue
            t = sum(n for s, n in seen.items() if s not in out)
            d = sum(s not in out for s in seen)
            if b[i] in seen:
                total += math.log10((seen[b[i]] - 0.5) / t)
                break
            if d:
                total += math.log10(0.5 * d / t)
            out = set(seen)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_scores_are_those_of_plain_ppm(spark, odd, documents):
    train = [t for i, t, _ in documents if brute.fold(i) != 1]
    got = {r.doc_id: r.score for r in lm_scoring.op1_lm_scoring(spark, odd).collect() if r.doc_id is not None}
    for doc_id, text, _ in documents:
        if doc_id is not None and len(text or "") < 3000:
            assert got[doc_id] == pytest.approx(_ppm(train, text, lm_scoring.ORDER), abs=1e-3)


def test_scores_follow_from_all_counts(spark, monkeypatch):
    """Whatever part of the model the tasks hold: all of it, a few runs or none."""
    train = [prose(40 + i, 30) for i in range(12)]
    texts = [*train[:4], *[prose(70 + i, 20) for i in range(4)], "", "zzz é漢 zzz", train[0] + " qqq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    for held in (lm_scoring.NODES, 40, 0):
        monkeypatch.setattr(lm_scoring, "NODES", held)
        for r in lm_scoring.scored(docs, training).collect():
            assert r.score == pytest.approx(_ppm(train, texts[r.doc_id], lm_scoring.ORDER), abs=1e-3)


def test_chances_sum_to_one():
    trie_keys = {}
    for o in range(lm_scoring.ORDER, -1, -1):
        trie_keys[o] = Counter()
    text = bytes([lm_scoring._START] * lm_scoring.ORDER) + b"abracadabra abra" + bytes([lm_scoring._END])
    for i in range(lm_scoring.ORDER, len(text)):
        for o in trie_keys:
            trie_keys[o][int.from_bytes(text[i - o : i + 1], "big")] += 1
    levels = [
        (np.array(sorted(trie_keys[o]), np.uint64), np.array([trie_keys[o][k] for k in sorted(trie_keys[o])]))
        for o in range(lm_scoring.ORDER + 1)
    ]
    trie = lm_scoring.Trie(levels)
    for context in (b"abrac", b"zzzzz", b"zzabr", b"\xfe\xfe\xfe\xfea"):
        key = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.log10(key)).sum() == pytest.approx(1, abs=1e-5)


# 2 and 5: classifiers


def _labelled(spark, folder, bad):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        spoiled = i % 4 == 0
        w = prose(i, 60).split()
        docs.append((i, " ".join(bad(w, rng) if spoiled else w)))
        labels.append((i, int(not spoiled), int(spoiled)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_quality_of_held_out_documents(spark, tmp_path):
    _labelled(spark, tmp_path, lambda w, rng: [x + rng.choice(["%%%", "$$"]) for x in w])
    got = [r for r in quality_classifier.op2_quality_classifier(spark, str(tmp_path)).collect()]
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.held_out == (brute.fold(r.doc_id) == 0) for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_severity_grows_with_toxic_words(spark, tmp_path):
    bad = ["vile", "nasty", "awful"]
    _labelled(spark, tmp_path, lambda w, rng: w + [rng.choice(bad) for _ in range(rng.randint(1, 6))])
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    right = sum(r.toxic == (i % 4 == 0) for i, r in got.items())
    assert right >= 0.97 * len(got)
    assert all(0 <= r.expected_severity <= toxicity.GRADES for r in got.values())


# 3: quality rules


def test_quality_counts(spark, odd, documents):
    got = quality_rules.op3_quality_rules(spark, odd).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same_multiset([(r.doc_id, *[r[f] for f in fields]) for r in got], [(d[0], *brute.quality(d[1])) for d in documents])
    assert all(not r.kept or not r.base_failed for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[3] and not kept[34] and not kept[35]


def test_weights_are_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "c c c c"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    weights = quality_rules.bucket_weights(docs, labels, 64)
    grams = {}
    for name, pair in (("a", None), ("b", None), ("c", None)):
        grams[name] = spark.sql(f"SELECT pmod(xxhash64('{name}'), 64L)").first()[0]
    assert weights[grams["a"]] > 0 > weights[grams["c"]]
    none = quality_rules.bucket_weights(docs, labels.where("quality = 7"), 64)
    assert none == [0.0] * 64


# 4: personal data


def _joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_base_spans(spark, odd, documents):
    got = personal_data.op4_personal_data(spark, odd).collect()
    mine = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got]
    theirs = []
    for doc_id, text, _ in documents:
        spans = brute.personal(text)
        n = [sum(s[0] == k for s in spans) for k in personal_data.KINDS]
        theirs.append((doc_id, *n, hashlib.sha256(_joined(spans).encode()).hexdigest()))
    same_multiset(mine, theirs)


TRICKY = [
    "mail a@b.c%d@e.f x", "++1 (2) 33-4455-666 +49 1", "1.2.3.4.5.6.7.8 256.1.1.1 007.01.1.255",
    "4111 1111 1111 1111, 4111111111111112", "é x@y.z ü 10.0.0.1", "a@b@c.d.e@f.g..h@i.j", "1 2 3 4 5 6 7 8 9 " * 300,
    "+" * 50 + "1" + "(" * 400, "9" * 3000, "x" * 3000 + "@y.com", "+1 ( 5 5 5 ) 1 2 3 4 5", "a@b.c" * 40,
]


def test_tricky_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = personal_data.with_spans(docs, "p").collect()
    for r in got:
        mine = [(personal_data.KINDS[s.kind], s.start, s.end) for s in r.p if s.base]
        assert mine == brute.personal(r.text), r.text[:60]


def test_context_and_checks_decide_candidates(spark):
    texts = [f"please call me on phone (212) 555-{1000 + i} today" for i in range(30)]
    texts += [f"order {100 + i}-222-{1000 + i}x" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.p for r in personal_data.with_spans(docs, "p").collect()}
    assert all(len(got[i]) == 1 for i in range(30)) and not any(got[i] for i in range(30, 60))


# 6: near duplicates


def test_components(spark, odd, documents):
    same_multiset(run(near_duplicates.op6_near_duplicates, spark, odd), brute.near_components(documents))


def test_followers_that_match_each_other_only(spark, tmp_path):
    """A crowd around one text, with pairs that are similar to each other but not to most others."""
    rng = random.Random(3)
    base = prose(77, 150).split()
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([2, 5, 9, 12])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        docs.append((i, " ".join(w), None))
        if i % 10 == 0:
            w[rng.randrange(len(w))] = "twin"
            docs.append((1000 + i, " ".join(w), None))
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same_multiset(run(near_duplicates.op6_near_duplicates, spark, str(tmp_path)), brute.near_components(docs))


def test_pairs_beside_a_common_passage(spark, tmp_path):
    """Texts that share a passage which fills their bands, in pairs just over the limit; some are much longer."""
    rng = random.Random(3)
    made = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage, docs = made(150), []
    for i in range(150):
        common = passage + made(29 if i % 3 else 150)
        docs += [(2 * i, " ".join(common + made(22))), (2 * i + 1, " ".join(common + made(22)))]
    docs.append((1000, " ".join(passage)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = run(near_duplicates.op6_near_duplicates, spark, str(tmp_path))
    same_multiset(got, brute.near_components([(d, t, None) for d, t in docs]))
    assert sum(r[3] for r in got) == 151


def test_keys_are_those_of_exceeding_registers():
    lead = np.full((3, near_duplicates.REGISTERS), 5, np.uint16)
    row = lead.copy()
    row[1, :4] = 6
    row[2] = 7
    keys = near_duplicates._keys(np.array([9, 9, 9]), row, lead)
    assert (keys != 0).sum(1).tolist() == [0, 4, near_duplicates.REGAINED]



def test_marks_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 40, 400):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        bits = int.from_bytes((near_duplicates.marks(a) ^ near_duplicates.marks(b)).tobytes(), "little").bit_count()
        assert 0 < bits <= len(np.setxor1d(a, b))
        assert (near_duplicates.marks(a, b) == (near_duplicates.marks(a) ^ near_duplicates.marks(b))).all()


def test_followers_meet_once(spark, tmp_path):
    """Under two leaders, in any round; those whose marks differ by more than a link allows do not meet."""
    base, other = list(range(1000, 1030)), list(range(2000, 2030))
    rows = [
        (lead, b, 100, d, [], near_duplicates.marks(np.array(d, np.uint64)).tolist())
        for lead in (1, 2)
        for b, d in ((10, base), (11, base + [5]), (12, base[:15] + other), (13, base + [6, 7]))
    ]
    schema = "a long, b long, n long, more array<long>, less array<long>, marks array<long>"
    followers = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([], "node long, label long")
    linker = object.__new__(near_duplicates._Linker)
    met = linker.meeting(followers, labels, None, 1)
    assert sorted((r.x, r.y) for r in met.collect()) == [(10, 11), (10, 13), (11, 13)]
    assert sorted((r.a, r.b) for r in linker.alike(followers, met).collect()) == [(10, 11), (10, 13), (11, 13)]
    assert linker.meeting(followers, labels, met, 2).isEmpty()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = x[:3000], x[1000:4000]
    sketch = near_duplicates.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(sketch[0], sketch[1]) == sketch[2]).all()
    j = near_duplicates.estimated(sketch[:1], sketch[1:2], np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 0.5) < 0.2


# 7: line templates


def test_recurring_lines_and_templates(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for r in line_templates.without_recurring(docs, "cut").collect():
        if r.doc_id is not None and 60 <= r.doc_id < 67:
            assert list(r.cut.dropped) == [0] and r.cut.text == r.text.split("\n", 1)[1]
        elif r.doc_id is not None and r.doc_id < 20:
            assert list(r.cut.dropped) == [] and r.cut.text == r.text
        assert r.key == "k" and r.cut.n_lines == (0 if r.text is None else len(r.text.split("\n")))


def _dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: list(r.cut.dropped) for r in line_templates.without_recurring(docs, "cut").collect()}


def test_long_lines_recur_from_two_documents_on(spark):
    long, short = prose(21, 60), "a short line of some words"
    near = edited(prose(22, 60), 30)
    texts = [f"{long}\n{short}\nown", f"{long}\n{short}", prose(22, 60), near, prose(23, 60), f"{prose(24, 60)}\n{prose(24, 60)}"]
    assert _dropped(spark, texts) == {0: [0], 1: [0], 2: [0], 3: [0], 4: [], 5: []}


def test_rows_of_numbers_are_compared_unmasked(spark):
    rows = [f"{i} {7 * i} {i * i} 0\ntotal 17 of 20 for 99\nrow {i} of the list" for i in range(10, 18)]
    assert all(gone == [1, 2] for gone in _dropped(spark, rows).values())


def test_templates_of_a_busy_leaf(spark):
    """Six lines of one template go, whatever else has their length and first words."""
    rng = random.Random(70)
    names = [f"{a} {b}" for a in ("anna", "bert", "cleo") for b in ("lund", "moss")]
    words = WORDS + ["".join(rng.choices("abdeil", k=2)) for _ in range(30)]
    six = [f"this page was last changed by {x} of the crew" for x in names]
    for others in (0, 3000):
        busy = ["this page was " + " ".join(rng.choices(words, k=8)) for _ in range(others)]
        texts = [f"{x}\nown {prose(700 + i, 3)}" for i, x in enumerate(six)] + busy
        gone = _dropped(spark, texts)
        assert [gone[i] for i in range(6)] == [[0]] * 6
        assert sum(len(gone[i]) for i in range(6, len(texts))) <= 0.002 * others
        assert gone == dict(enumerate(brute.recurring_lines(texts)))


def test_lines_equal_a_plain_version(spark, documents):
    rng = random.Random(71)
    made = []
    for _ in range(400):
        lines = []
        for _ in range(rng.randint(0, 6)):
            first = rng.choice(["see also the", "read more of", "on 12 may"])
            lines.append(first + " " + " ".join(rng.choices(WORDS[:7], k=rng.choice([0, 1, 3, 5, 6]))) + rng.choice(["", " 4", "\t"]))
        made.append("\n".join(lines))
    made += [t for i, t, _ in documents if i is not None]
    assert _dropped(spark, made) == dict(enumerate(brute.recurring_lines(made)))


def test_digest_of_what_is_left(spark, odd, documents):
    texts = {i: t for i, t, _ in documents if i is not None}
    for r in line_templates.op7_line_templates(spark, odd).where("doc_id IS NOT NULL").collect():
        text = texts[r.doc_id]
        if text is None:
            assert r.kept_sha256 is None
        else:
            left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in set(r.dropped))
            assert r.kept_sha256 == hashlib.sha256(left.encode()).hexdigest()


# 8: decontamination


def _plain(text):
    signs = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    return [w for w in (re.sub(f"[{re.escape(signs)}]", "", w) for w in brute.words(text, True)) if w]


def test_contaminated_documents(spark, odd, documents, monkeypatch):
    items = [(r.item_id, _plain(r.text)) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect() if r.item_id]
    theirs = []
    for doc_id, text, _ in documents:
        own = _plain(text)
        near = {i: brute.edit_distance_within(w, own) for i, w in items if w}
        hit = {i for i, w in items if w and brute.edit_distance_within(w, own) <= len(w) // 5}
        theirs.append((doc_id, sorted(hit)))
        del near
    assert [t for t in theirs if t[1]] == [(36, [1]), (37, [1])]
    for size in (decontamination.ITEM_BYTES, 100):  # one block of items, and several
        monkeypatch.setattr(decontamination, "ITEM_BYTES", size)
        got = decontamination.op8_decontamination(spark, odd).collect()
        same_multiset([(r.doc_id, sorted(r.item_ids)) for r in got], theirs)


def test_recall_at_the_limit():
    rng = random.Random(8)
    items = [prose(2000 + i, rng.randint(8, 60)) for i in range(30)]
    held = decontamination.Items(list(range(30)), items)
    found, texts, of = 0, [], []
    for k in range(300):
        i = rng.randrange(30)
        w = items[i].split()
        for _ in range(decontamination.allowed(len(w))):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.33:
                w[at] = f"zz{rng.randrange(999)}"
            elif kind < 0.66:
                del w[at]
            else:
                w.insert(at, f"yy{rng.randrange(999)}")
        texts.append(prose(k, rng.randrange(30)) + " " + " ".join(w) + " " + prose(k + 1, 20))
        of.append(i)
    for i, hits in zip(of, held.matches(pa.array(texts))):
        found += i in hits
    assert found >= 0.97 * len(texts)
    assert not any(held.matches(pa.array([prose(5000 + k, 200) for k in range(50)])))


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontamination.least_distance(a, b) == brute.edit_distance_within(a, b)


# 9: mixing


def test_targets_and_what_is_taken(spark, odd, documents):
    size = defaultdict(int)
    for _, text, source in documents:
        size[source] += len(brute.words(text))
    names = sorted((s for s in size if s is not None), key=lambda s: s) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    rows = mixing.op9_mixing(spark, odd).collect()
    again = mixing.op9_mixing(spark, odd).collect()
    same_multiset([(r.doc_id, r.taken) for r in rows], [(r.doc_id, r.taken) for r in again])
    by_target = {round(t, 6): s for s, t in target.items()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and round(r.target, 6) in by_target
    same_multiset([(r.doc_id, r.size) for r in rows], [(i, len(brute.words(t))) for i, t, _ in documents])
    # One source has a document of most of its words: no whole number of copies comes nearer.
    largest = max(r.size for r in rows)
    by_source = Counter()
    for r in rows:
        by_source[round(r.target, 6)] += r.taken
    for goal, taken in by_source.items():
        assert abs(taken - goal) <= largest / 2


def test_rates_solve_the_constraint(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 4}") for i in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    # Two sources share one target, so sums go by source.
    sums = mixing.mixed(frame).groupBy("_key", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(sums) == 4
    for r in sums:
        assert r.taken == pytest.approx(r.target, rel=0.005)


def test_mix_repeats_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixing_stage(spark, docs, odd)
    assert out.columns == docs.columns
    taken = sum(r.taken for r in mixing.op9_mixing(spark, odd).collect())
    assert sum(len(brute.words(r.text)) for r in out.select("text").collect()) == taken


# 10: sharding


def test_differencing_balances_and_keeps_groups():
    rng = np.random.default_rng(4)
    parts = np.zeros((500, 8), np.int64)
    parts[:, 0] = rng.integers(1, 10_000, 500)
    places, sums = sharding.differenced(parts)
    again = np.bincount(places[:, 0], parts[:, 0], 8)
    assert (again == sums).all() and np.ptp(sums) <= 3
    assert all(sorted(p) == list(range(8)) for p in places.tolist())


def test_shards(spark, odd, documents):
    rows = sharding.op10_sharding(spark, odd).collect()
    size = lambda t: 16 + len((t or "").encode())
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    same_multiset([(r.doc_id, r["size"], r.text_crc32) for r in rows], [(i, size(t), crc(t)) for i, t, _ in documents])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_large_groups_are_split_and_shards_balanced(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 200)  # several blocks
    docs = [(i, "hot " * 50 if i % 3 == 0 else prose(i, 5 + i % 60)) for i in range(3000)]
    rows = sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 8


@pytest.mark.parametrize("copies", [150, 600])
def test_a_large_group_among_many_blocks(spark, monkeypatch, copies):
    """A group below a shard's share and above what any one block can level."""
    monkeypatch.setattr(sharding, "BLOCK", 400)
    docs = [(i, prose(i, 3 + i % 20)) for i in range(6000)] + [(10_000 + i, "much the same " * 4) for i in range(copies)]
    rows = sharding.sharded(spark.createDataFrame(docs, "doc_id long, text string"), 6).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r["size"]
    assert len(rows) == len(docs) and len({r.shard for r in rows if r.doc_id >= 10_000}) == 1
    assert max(sums.values()) - min(sums.values()) < 0.01 * sum(sums.values()) / 6
