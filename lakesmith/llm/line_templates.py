"""Line dedup (operator 7): a fixed-depth template tree; recurring templates are dropped.

Each line with words is parsed down a tree of fixed depth: by its number of tokens,
then by its first DEPTH tokens, a token with a digit counting as a variable field.
A leaf's template keeps the tokens that most of its lines have at a place; the
other places are variable fields as well. Lines that do not fit it go on to nodes
below: for every SPREAD-th place they are put under the rarest token there that
enough lines of the node have, so that a few lines of one template leave the many
others of a busy leaf behind; each node has its template again, LEVELS deep. Lines
recur if lines of the same masked tokens, or lines that fit their node's template,
occur in MIN_DOCS documents or more; of lines of LONG_TOKENS tokens or more, which do
not repeat by chance, in LONG_DOCS. A line that is mostly variable fields, as a row of
a table of numbers, is compared unmasked and only as a whole. Recurring lines are
dropped from every document, whatever their number.

DataFrame functions only. Texts are parsed once; lines with the same masked tokens
are one form from then on, and tokens are hashes. A node's counts are summed per
(node, place, token) before they are shuffled and joined by the same three, so a line
that a third of all documents share costs one row for each task, and the lines of a
busy leaf spread over as many tasks as it has tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, listed, read

DEPTH = 3
#: Lines with fewer tokens are never dropped.
MIN_TOKENS = 3
#: Documents in which a recurring line or template occurs at least; in which a long one does.
MIN_DOCS, LONG_DOCS = 5, 2
#: Lines of so many tokens are long.
LONG_TOKENS = 50
#: A place is constant if this share of a leaf's lines agrees there.
AGREE = 0.8
#: A line fits if this share of the constant places agrees, and this share of places is constant.
FITS, CONSTANT = 0.9, 0.6

#: Levels of nodes below a leaf, and the nodes that a line goes on to.
LEVELS, SPREAD = 3, 3
#: Lines with a lesser share of tokens without a digit are compared unmasked.
LITERAL = 0.5

_SPACE = r"\x20\x09-\x0D"


def _masked(line: str) -> Column:
    """The line with each token that holds a digit replaced; one linear pass, lines without digits untouched."""
    field = rf"(?<![^{_SPACE}])(?=[^{_SPACE}0-9]*+[0-9])[^{_SPACE}]++"
    return F.when(F.col(line).rlike("[0-9]"), F.regexp_replace(line, field, "<*>")).otherwise(F.col(line))


def _tokens(line: str) -> Column:
    return F.array_remove(F.split(line, rf"[{_SPACE}]+"), "")


def parsed(docs: DataFrame) -> DataFrame:
    """A row for each line: _doc, _text, _no, n, leaf, _h, _c, plain, masked.

    ``plain``: too few tokens are without a digit; ``masked`` is then the line itself.
    ``_doc`` and ``_text`` tell documents apart: the doc_id, and a hash of it and the text.
    ``leaf``, ``_h`` and ``_c`` are hashes, the latter two of ``masked``.
    """
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_doc"),
        F.xxhash64("doc_id", "text").alias("_text"),
        F.posexplode(F.split(F.col("text"), "\n")).alias("_no", "line"),
    )
    masked = lines.withColumn("masked", _masked("line"))
    tokens = masked.withColumn("_tokens", _tokens("masked")).withColumn("n", F.size("_tokens"))
    leaf = F.xxhash64("n", F.concat_ws(" ", F.slice("_tokens", 1, DEPTH)))
    literal = F.size(F.array_remove("_tokens", "<*>"))
    plain = (F.col("masked") != F.col("line")) & (literal < LITERAL * F.col("n"))
    whole = F.when(plain, F.col("line")).otherwise(F.col("masked"))
    lines = tokens.select(
        "_doc", "_text", "_no", "n", leaf.alias("leaf"), plain.alias("plain"), whole.alias("masked")
    )
    return lines.withColumns({"_h": F.xxhash64("masked"), "_c": F.crc32("masked")})


def _least(n: str = "n") -> Column:
    """Documents in which a line of ``n`` tokens has to occur."""
    return F.when(F.col(n) >= LONG_TOKENS, LONG_DOCS).otherwise(MIN_DOCS)


_FORM = ["leaf", "_h", "_c"]


def _tree(work: Workspace, lines: DataFrame) -> list[DataFrame]:
    """Tables of (node, leaf, _h, _c, n): the forms that fit the template of a node, level by level."""
    free = lines.where("NOT plain")
    leaves = free.groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("all"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
    # A leaf with one form needs no template.
    leaves = work.keep(leaves.where((F.col("all") >= _least()) & (F.col("lo") != F.col("hi"))).select("leaf", "all"), "leaves")
    several = free.join(listed(leaves.select("leaf")), "leaf", "left_semi")
    forms = work.keep(several.groupBy(*_FORM, "n", "masked").agg(F.count(F.lit(1)).alias("k")), "forms")
    form = F.xxhash64(*_FORM).alias("form")
    # The first DEPTH tokens are the leaf's own.
    places = forms.select(form, F.posexplode(_tokens("masked")).alias("place", "token")).where(F.col("place") >= DEPTH)
    places = work.keep(places.select("form", "place", F.xxhash64("token").alias("token")), "places")
    nodes = forms.join(leaves, "leaf").select(F.col("leaf").alias("node"), form, "n", "k", "all")
    found = []
    for level in range(LEVELS + 1):
        nodes = work.keep(nodes, f"nodes-{level}")
        if level and nodes.isEmpty():
            break
        inner = nodes.where(f"n > {DEPTH}").join(places, "form")
        key = ["node", "place", "token"]
        counted = inner.groupBy(*key).agg(F.sum("k").alias("same"))
        # Counts of one line can be neither constant nor a node.
        held = inner.join(counted.where("same > 1"), key)
        own = F.col("same") >= AGREE * F.col("all")
        # The count before a hash of the token: the least is the rarest.
        rare = F.shiftleft(F.least("same", F.lit((1 << 22) - 1)), 40).bitwiseOR(F.col("token").bitwiseAND((1 << 40) - 1))
        split = ~own & (F.col("same") >= _least())
        below = [F.min(F.when(split & (F.col("place") % SPREAD == i), rare)).alias(f"_{i}") for i in range(SPREAD)]
        known = held.groupBy("node", "form").agg(F.count_if(own).alias("agree"), *below)
        known = nodes.join(known, ["node", "form"], "left").withColumn("agree", F.coalesce("agree", F.lit(0)) + F.least("n", F.lit(DEPTH)))
        known = work.keep(known, f"known-{level}")
        most = known.groupBy("node").agg(F.max("agree").alias("most"))
        fits = (F.col("agree") >= FITS * F.col("most")) & (F.col("agree") >= CONSTANT * F.col("n"))
        told = known.join(most, "node").withColumn("fits", fits)
        found.append(told.where("fits").select("node", "form"))
        next_ = [F.when(F.col(f"_{i}").isNotNull(), F.xxhash64("node", f"_{i}")) for i in range(SPREAD)]
        on = told.where("NOT fits").select("form", "n", "k", F.explode(F.array_compact(F.array(*next_))).alias("node"))
        size = on.groupBy("node", "n").agg(F.sum("k").alias("all"), F.count(F.lit(1)).alias("_forms"))
        size = size.where((F.col("_forms") > 1) & (F.col("all") >= _least())).select("node", "all")
        nodes = on.join(size, "node").select("node", "form", "n", "k", "all")
    named = forms.select(*_FORM, "n", form)
    return [f.join(named, "form").select("node", *_FORM, "n") for f in found]


def recurring(work: Workspace, docs: DataFrame) -> DataFrame:
    """(_doc, _text, dropped): the numbers of the lines to drop, for documents that have any."""
    # A filter before the table is written would mask and split each line a second time.
    lines = work.keep(parsed(docs), "lines").where(F.col("n") >= MIN_TOKENS)
    narrow = lines.drop("masked")
    pairs = narrow.select(*_FORM, "n", "plain", "_doc", "_text").distinct()
    repeated = pairs.groupBy(*_FORM, "n", "plain").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= _least())
    exact = repeated.select(*_FORM, "plain")
    general = None
    for fits in _tree(work, lines):
        general = fits if general is None else general.unionByName(fits)
    general = work.keep(general, "fits")
    reached = general.join(narrow.where("NOT plain").select(*_FORM, "_doc", "_text"), _FORM)
    reached = reached.select("node", "n", "_doc", "_text").distinct().groupBy("node", "n").agg(F.count(F.lit(1)).alias("_docs"))
    wide = general.join(reached.where(F.col("_docs") >= _least()).select("node"), "node", "left_semi")
    gone = exact.unionByName(wide.select(*_FORM, F.lit(False).alias("plain"))).distinct()
    gone = narrow.join(gone, [*_FORM, "plain"], "left_semi")
    return work.keep(
        gone.groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("_no")).alias("dropped")), "dropped"
    )


def without_recurring(docs: DataFrame, name: str = "_lines") -> DataFrame:
    """``docs`` with a struct ``name`` of n_lines, dropped (line numbers from 0) and text (what is left).

    A null text has no lines and stays null; an empty one has one empty line. Other
    columns of ``docs`` pass unchanged. Repeated rows are one document.
    """
    work = Workspace(docs.sparkSession, "line-templates")
    gone = recurring(work, docs).withColumnsRenamed({c: f"{name}{c}" for c in ("_doc", "_text", "dropped")})
    work.drop("lines", "fits", "leaves", "forms", "places")
    for level in range(LEVELS + 1):
        work.drop(f"nodes-{level}", f"known-{level}")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    keyed = docs.withColumns({f"{name}_k": F.xxhash64("doc_id", "text"), f"{name}_d": doc})
    match = (F.col(f"{name}_k") == F.col(f"{name}_text")) & (F.col(f"{name}_d") == F.col(f"{name}_doc"))
    both = keyed.join(gone.hint("merge"), match, "left")
    dropped = F.coalesce(f"{name}dropped", F.array().cast("array<int>"))
    # A column of its own, so that the lambda below does not split the text for each line.
    both = both.withColumn(f"{name}_all", F.split("text", "\n"))
    lines = F.col(f"{name}_all")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    kept = F.when(F.size(dropped) == 0, F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    out = both.withColumn(
        name,
        F.struct(
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
            dropped.alias("dropped"),
            kept.alias("text"),
        ),
    )
    return out.select(*docs.columns, name)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses, and a digest of what is left of its text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_recurring(docs)
    return out.select(
        "doc_id",
        "_lines.n_lines",
        F.size("_lines.dropped").alias("n_dropped"),
        F.col("_lines.dropped").alias("dropped"),
        F.char_length("_lines.text").alias("kept_chars"),
        F.sha2("_lines.text", 256).alias("kept_sha256"),
    )
