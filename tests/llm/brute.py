"""Plain single-machine versions of the contracts, for comparison."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(_LOWER) if lower else text)


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def unigram(documents):
    counts = Counter()
    for doc_id, text, _ in documents:
        if fold(doc_id) != 1:
            counts.update(words(text, True))
            counts[None] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text, _ in documents:
        tokens = [*words(text, True), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        out.append((doc_id, fold(doc_id) == 1, len(tokens), sum(counts[t] > 0 for t in tokens), total, base))
    return out


def quality(text):
    found = words(text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered), failed


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else ({tuple(w)} if w else set())


def near_components(documents):
    """(doc_id, n_shingles, component_id, kept) for each row, by comparing all pairs."""
    sets = [shingles(text) for _, text, _ in documents]
    parent = list(range(len(documents)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_id = {}
    for i, (doc_id, _, _) in enumerate(documents):
        if doc_id is not None:
            parent[root(i)] = root(by_id.setdefault(doc_id, i))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(documents):
        if doc_id is not None:
            ids[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _, _) in enumerate(documents):
        component = min(ids[root(i)], default=None)
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    """Base spans in the order of the contract."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m)]


def edit_distance_within(item, text):
    """The least edit distance between ``item`` and any run of ``text`` (lists of words)."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        above, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (w != t))
    return min(row)


_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def importance(documents, items, longest=1, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of each row, in its order; ties beyond the doc_id go to fewer features."""

    def features(text):
        w = _ALNUM.findall((text or "").translate(_LOWER))
        runs = [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
        return len(w), [zlib.crc32(r.encode()) % 10000 for r in runs]

    texts = [features(text) for _, text, _ in documents]
    s, t = (Counter(b for _, found in group for b in found) for group in (texts, map(features, items)))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10000) / ((s[b] + 1.0) * (t_all + 10000))))
    out = []
    for (doc_id, _, _), (_, found) in zip(documents, texts):
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = [i for i, (n, _) in enumerate(texts) if n >= least]
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0, out[i][1]))
    rank = {i: k for k, i in enumerate(able[: len(able) * percent // 100], 1)}
    return [(*row, rank.get(i)) for i, row in enumerate(out)]


def periodic_runs(found):
    """(start, period, length) of the runs of a list of words, by comparing it with itself at every period."""
    least = {}
    for q in range(1, len(found) // 4 + 1):
        same = [x == y for x, y in zip(found, found[q:])] + [False]
        start = 0
        for i, s in enumerate(same):
            if not s:
                if i > start and i - start + q >= max(6, 4 * q):
                    least.setdefault((start, i - start + q), q)
                start = i + 1
    return sorted((start, q, n) for (start, n), q in least.items())


def collapsed(doc_id, text):
    """The row of a document."""
    w = words(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = periodic_runs(w)
    gone = {i for start, q, n in runs for i in range(start + q, start + n)}
    best = None
    for start, q, n in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (start, n, q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{start},{n},{q}\n" for start, q, n in runs)
    return doc_id, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def recurring_lines(texts, docs=5, long_docs=2):
    """Per text the numbers of the lines that go: whole recurring lines and those of a node's template."""
    split = lambda x: [t for t in re.split("[ \\t-\\r]+", x) if t]
    lines = []
    for doc, text in enumerate(texts):
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            masked = WORD.sub(lambda w: "<*>" if re.search("[0-9]", w[0]) else w[0], line)
            tokens = split(masked)
            if len(tokens) < 3:
                continue
            plain = masked != line and 2 * sum(t != "<*>" for t in tokens) < len(tokens)
            lines.append((doc, no, line if plain else masked, plain, tuple(tokens)))
    least = lambda n: long_docs if n >= 50 else docs
    gone, by_form, leaves = set(), defaultdict(list), defaultdict(set)
    for doc, no, whole, plain, tokens in lines:
        by_form[whole, plain, tokens].append((doc, no))
        if not plain:
            leaves[len(tokens), tokens[:3]].add((whole, plain, tokens))
    for (_, _, tokens), at in by_form.items():
        if len({d for d, _ in at}) >= least(len(tokens)):
            gone.update(at)

    def visit(node, n, level):
        total = sum(len(by_form[f]) for f in node)
        if len(node) < 2 or total < least(n):
            return
        same = Counter()
        for f in node:
            for p in range(3, n):
                same[p, f[2][p]] += len(by_form[f])
        agree = {f: 3 + sum(1 < same[p, f[2][p]] >= 0.8 * total for p in range(3, n)) for f in node}
        most = max(agree.values())
        fits = [f for f in node if agree[f] >= 0.9 * most and agree[f] >= 0.6 * n]
        at = [x for f in fits for x in by_form[f]]
        if len({d for d, _ in at}) >= least(n):
            gone.update(at)
        if level == 3:
            return
        below = defaultdict(list)
        for f in set(node) - set(fits):
            for i in range(3):
                rare = [
                    (k, xxhash.xxh64(f[2][p].encode(), 42).intdigest() & ((1 << 40) - 1), f[2][p])
                    for p in range(3, n)
                    if p % 3 == i and (k := same[p, f[2][p]]) >= least(n) and k < 0.8 * total
                ]
                if rare:
                    below[min(rare)].append(f)
        for key, forms in below.items():
            visit(list(dict.fromkeys(forms)), n, level + 1)

    for (n, _), node in leaves.items():
        visit(list(node), n, 0)
    return [sorted(no for d, no in gone if d == doc) for doc in range(len(texts))]
