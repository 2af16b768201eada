"""PII (operator 4): labelers vote on spans, EM weighs the labelers, a span classifier decides.

Base spans are those of four fixed patterns that pass their checks; they always
stay. Looser patterns, and base matches that fail their check, are further
candidates. Five labelers vote yes, no or abstain on every candidate: the strict
pattern, a check of the digits or the host, a gazetteer of prefixes and endings,
cue words before the span, and the signs around it. How often each pattern of votes
occurs in all documents is all that training needs: at most 3 ** 5 counts for each
kind come to the driver. Expectation-maximisation estimates each labeler's
reliability and how likely each pattern is personal data; a logistic span
classifier is trained on these soft labels and accepts candidates from 0.5 on.

DataFrame functions only. Texts with neither a digit nor an at sign have no
candidates and are only read. Spans are rows: their positions are running sums of
the lengths between and of the matches, so texts of any length take linear time,
and patterns are written so that no text makes them retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, read

KINDS = ("email", "ip", "card", "phone")

# The base patterns, without the retries that the plain forms allow.
_NAME = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The looser patterns.
LOOSE = {
    "email": rf"(?<![{_NAME}])[{_NAME}]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{13,15}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Cue words for each kind, words that speak against it, and gazetteers.
CUES = {
    "email": "mail|email|e-mail|contact|write|reply|correo|kontakt",
    "ip": "ip|address|host|server|adresse|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|account",
    "phone": "phone|tel|call|mobile|fax|telefon|telefono|contact|cell",
}
AGAINST = "isbn|issn|version|section|figure|order|sku|doi|page|build"
GAZETTEER = {
    "email": r"(?i)[.)\]]\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|br|example)$",
    "ip": r"^(?!10\.|127\.|0\.|192\.168\.|2(?:2[4-9]|[34][0-9]|5[0-5])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^(?:\+(?:1|33|34|44|49|55|351|39|52|7|81|86|91)|\(?[2-9])",
}
LABELERS = 5
CONTEXT = 40
ROUNDS = 60
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(span: str) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: str) -> Column:
    """Whether a string of digits (a column) passes Luhn's check."""
    return F.expr(
        f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (a, i) -> a + CASE"
        f" WHEN (length({digits}) - i) % 2 = 0 THEN cast(substring({digits}, i, 1) AS int)"
        f" WHEN substring({digits}, i, 1) >= '5' THEN 2 * cast(substring({digits}, i, 1) AS int) - 9"
        f" ELSE 2 * cast(substring({digits}, i, 1) AS int) END) % 10 = 0"
    )


def spans(docs: DataFrame) -> DataFrame:
    """All matches of all patterns: _key, _doc, kind, loose, start, end, span, before, after, checked, base."""
    some = docs.select(
        F.xxhash64("doc_id", "text").alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_doc"), "text"
    ).where(F.col("text").rlike("[0-9@]|[\\[(]at[\\])]"))
    forms = []
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for number, kind in enumerate(KINDS):
            found = F.regexp_extract_all("text", F.lit(patterns[kind]), 0)
            between = F.split("text", patterns[kind], -1)
            forms.append(
                F.struct(
                    F.lit(number).alias("kind"), F.lit(loose).alias("loose"), found.alias("m"), between.alias("g")
                )
            )
    each = some.select("_key", "_doc", F.explode(F.array(*forms)).alias("f")).where(F.size("f.m") > 0)
    each = each.select("_key", "_doc", "f.kind", "f.loose", F.col("f.m").alias("m"), F.col("f.g").alias("g"))
    # Between two matches only the nearest signs are kept.
    parts = F.transform(
        "g", lambda g: F.struct(F.char_length(g).alias("n"), F.substr(g, F.greatest(F.char_length(g) - CONTEXT + 1, F.lit(1))).alias("left"), F.substring(g, 1, 1).alias("right"))
    )
    each = each.select("_key", "_doc", "kind", "loose", "m", parts.alias("g"))
    rows = each.select(
        "_key",
        "_doc",
        "kind",
        "loose",
        F.posexplode(F.arrays_zip("m", "g", F.slice("g", 2, F.size("g") - 1).alias("h"))).alias("i", "x"),
    ).where("x.m IS NOT NULL")
    size = F.char_length("x.m")
    # Repeated rows find the same spans.
    rows = rows.select(
        "_key", "_doc", "kind", "loose", "i", F.col("x.m").alias("span"), size.alias("size"),
        F.col("x.g.n").alias("gap"), F.col("x.g.left").alias("before"), F.col("x.h.right").alias("after"),
    ).dropDuplicates(["_key", "_doc", "kind", "loose", "i"])
    along = Window.partitionBy("_key", "_doc", "kind", "loose").orderBy("i")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.withColumn("_digits", _digits("span"))
    n = F.length("_digits")
    checked = (
        F.when(F.col("kind") == 0, F.col("span").rlike(r"[A-Za-z]{2,}$"))
        .when((F.col("kind") == 1) & ~F.col("loose"), F.col("span").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(F.col("kind") == 1, F.lit(True))
        .when(F.col("kind") == 2, (n >= F.when(F.col("loose"), 13).otherwise(16)) & (n <= 19) & _luhn("_digits"))
        .otherwise((n >= 8) & (n <= 15))
    )
    valid = F.when(F.col("kind") == 0, True).otherwise(F.col("checked"))
    rows = rows.withColumn("checked", checked).withColumn("base", ~F.col("loose") & valid)
    # A run of digits that is no card, number or address in length is no candidate at all.
    return rows.where(F.col("base") | F.col("loose") | ((F.col("kind") == 2) & (n >= 13) & (n <= 19)) | (F.col("kind") == 1))


def _votes(kind: str) -> list[Column]:
    """The labelers' votes on the rows of one kind: '1', '0' or '-'."""
    glued = r"[A-Za-z0-9_]"
    vote = lambda yes, no: F.when(yes, "1").when(no, "0").otherwise("-")
    before = F.lower("before")
    listed = F.col("span").rlike(GAZETTEER[kind])
    return [
        vote(F.col("base"), F.lit(False)),
        vote(F.col("checked"), ~F.col("checked")),
        vote(listed, ~listed),
        vote(before.rlike(rf"(?<![a-z])(?:{CUES[kind]})(?![a-z])"), before.rlike(rf"(?<![a-z])(?:{AGAINST})(?![a-z])")),
        vote(~F.col("before").rlike(glued + "$") & ~F.col("after").rlike("^" + glued),
             F.col("before").rlike(glued + "$") | F.col("after").rlike("^" + glued)),
    ]


def with_votes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``votes``, the kind's number and a sign for each labeler."""
    by_kind = F.coalesce(
        *[F.when(F.col("kind") == k, F.concat(F.lit(str(k)), *_votes(kind))) for k, kind in enumerate(KINDS)]
    )
    return rows.withColumn("votes", by_kind)


def reliabilities(counts: dict[str, int], kind: int) -> tuple[float, list[dict[str, list[float]]], dict[str, float]]:
    """EM over the vote patterns of one kind.

    Returns the share of personal data, each labeler's chances of its votes on
    other and on personal spans, and each pattern's posterior.
    """
    own = {p: n for p, n in counts.items() if p[0] == str(kind)}
    posterior = {p: (p[1:].count("1") + 0.5) / (p[1:].count("1") + p[1:].count("0") + 1) for p in own}
    share, tables = 0.5, []
    for _ in range(ROUNDS):
        mass = [sum(n * (1 - posterior[p]) for p, n in own.items()), sum(n * posterior[p] for p, n in own.items())]
        share = (mass[1] + 1) / (sum(mass) + 2)
        tables = []
        for j in range(LABELERS):
            seen = {v: [1e-2, 1e-2] for v in "10-"}
            for p, n in own.items():
                seen[p[1 + j]][0] += n * (1 - posterior[p])
                seen[p[1 + j]][1] += n * posterior[p]
            total = [sum(seen[v][c] for v in "10-") for c in (0, 1)]
            tables.append({v: [seen[v][c] / total[c] for c in (0, 1)] for v in "10-"})
        for p in own:
            odds = math.log(share) - math.log(1 - share)
            for j in range(LABELERS):
                chance = tables[j][p[1 + j]]
                odds += math.log(chance[1]) - math.log(chance[0])
            posterior[p] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
    return share, tables, posterior


def span_classifier(counts: dict[str, int], rounds: int = 400) -> dict[str, float]:
    """Each pattern's score by a logistic classifier of the votes, trained on the EM posteriors."""
    scores = {}
    for kind in range(len(KINDS)):
        own = {p: n for p, n in counts.items() if p[0] == str(kind)}
        if not own:
            continue
        _, _, soft = reliabilities(counts, kind)
        features = lambda p: [1.0] + [float(p[1 + j] == v) for j in range(LABELERS) for v in "10"]
        x = {p: features(p) for p in own}
        w, total = [0.0] * (1 + 2 * LABELERS), sum(own.values())
        # Votes count for the classifier as they do for their labelers before it has seen any pattern.
        for j in range(LABELERS):
            w[1 + 2 * j], w[2 + 2 * j] = 0.5, -0.5
        score = lambda p: 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(a * b for a, b in zip(w, x[p]))))))
        for _ in range(rounds):
            slope = [0.01 * v / total for v in w]
            for p, n in own.items():
                gap = n * (score(p) - soft[p]) / total
                slope = [g + gap * f for g, f in zip(slope, x[p])]
            w = [v - 1.0 * g for v, g in zip(w, slope)]
        scores |= {p: score(p) for p in own}
    return scores


def found_spans(docs: DataFrame) -> DataFrame:
    """(_key, _doc, _spans): the base spans and accepted candidates of documents that have any.

    ``_spans`` holds (kind, start, end, base) in order of kind and start.
    """
    work = Workspace(docs.sparkSession, "personal-data")
    rows = work.keep(with_votes(spans(docs)).select("_key", "_doc", "kind", "start", "end", "base", "votes"), "spans")
    counts = {r["votes"]: r["count"] for r in rows.groupBy("votes").count().collect()}
    accepted = [p for p, s in span_classifier(counts).items() if s >= 0.5]
    by_start = Window.partitionBy("_key", "_doc").orderBy("start")
    rows = rows.withColumns(
        {
            "_before": F.max(F.when(F.col("base"), F.col("end"))).over(
                by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "_after": F.min(F.when(F.col("base"), F.col("start"))).over(
                by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing)
            ),
        }
    )
    # A candidate that shares signs with a base span adds nothing.
    free = (F.coalesce("_before", F.lit(0)) <= F.col("start")) & (
        F.col("_after").isNull() | (F.col("_after") >= F.col("end"))
    )
    chosen = F.col("votes").isin(accepted) if accepted else F.lit(False)
    kept = rows.where(F.col("base") | (chosen & free))
    return kept.groupBy("_key", "_doc").agg(
        F.sort_array(F.collect_set(F.struct("kind", "start", "end", "base"))).alias("_spans")
    )


def with_spans(docs: DataFrame, name: str = "_pii") -> DataFrame:
    """``docs`` with an array ``name`` of (kind, start, end, base); empty for null and empty texts.

    Positions are code points from 0, ends exclusive. Other columns pass unchanged.
    """
    found = found_spans(docs).withColumnsRenamed({"_key": f"{name}_key", "_doc": f"{name}_doc", "_spans": name})
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    match = (F.xxhash64(docs["doc_id"], docs["text"]) == F.col(f"{name}_key")) & (doc == F.col(f"{name}_doc"))
    out = docs.join(found.hint("merge"), match, "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    return out.withColumn(name, F.coalesce(name, empty)).select(*docs.columns, name)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: base counts and their digest, and all spans."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = found_spans(docs)
    # Ids and hashes are joined, never texts.
    keyed = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_doc")
    )
    out = keyed.join(found.hint("merge"), ["_key", "_doc"], "left")
    empty = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")
    out = out.withColumn("_spans", F.coalesce("_spans", empty)).withColumn("_base", F.filter("_spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"),
    )
