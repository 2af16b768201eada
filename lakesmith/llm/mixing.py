"""Mixing sources to target weights (operator 9): entropy balancing of document rates.

Each source has a target of tokens (words). Rates of its documents are as near to
1 as the target allows, in the sense of the entropy sum of w log w - w, under
sum of size * w = target and w <= 2. The optimum is an exponential tilt,
w = min(2, exp(t * size / mean size)), with one dual variable t per source. The
dual is convex; Newton steps, kept inside a shrinking bracket, solve all sources
at once. A step is an aggregate over (source, size) cells, which hold the
documents' whole contribution, so a hot source is summed before it is shuffled.

Rates then become copies. From a source's largest documents to its smallest, each
size gets the whole number of copies nearest to its rates and to the tokens that
rounding has left over so far. So the source ends within half of a small document
of its target, unless all its documents are taken MOST times. A source's (size)
cells, not its documents, are one group here. Within a cell, documents come in
the order of a hash. No random numbers are drawn.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, numbered, read

#: Weights of the sources in the order of their names, repeated; their total against all sizes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
STEPS = 40
TOLERANCE = 1e-10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key() -> Column:
    """The source as a text that tells a null apart."""
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``sources`` (source, source_size) with each one's target.

    Sources are weighed in the order of their names, null last. No target is
    above MOST times the source's size: all others then have one tokens-per-weight
    level in common, found by raising it until it no longer changes. Ordering
    the names takes one task, of a row for each source, not for each document.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place).cast("double"))
    cap = F.col("source_size") * MOST
    level, last = -1.0, None
    while level != last:
        last = level
        full = cap < F.col("weight") * F.lit(max(level, 0.0)) if level >= 0 else F.lit(False)
        sums = weighed.agg(
            F.sum(F.col("source_size") * share).alias("all"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("full"),
            F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("weight"),
        ).first()
        if not sums["weight"]:
            break
        level = max(last, (sums["all"] - sums["full"]) / sums["weight"])
    return weighed.withColumn("target", F.least(cap, F.col("weight") * F.lit(max(level, 0.0))))


def _rate(t: str, c: str) -> Column:
    return F.least(F.lit(MOST), F.exp(F.least(F.col(t) * F.col(c), F.lit(1.0))))


def _solved(work: Workspace, cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, t, scale): the dual variable of each source and the mean size that scales it."""
    state = sources.select(
        "key",
        "target",
        "scale",
        F.lit(0.0).alias("t"),
        F.lit(-1e6).alias("lo"),
        # exp(t c) is at least MOST at every document where t is the largest scale over the least size.
        (F.lit(2.0) * F.greatest(F.col("scale"), F.lit(1.0))).alias("hi"),
        (F.col("target") >= MOST * F.col("source_size")).alias("done"),
    )
    state = work.keep(state.withColumn("t", F.when(F.col("done"), F.col("hi")).otherwise(F.col("t"))), "dual-0")
    for step in range(1, STEPS + 1):
        # Only what a step needs is joined: cells of sources that are not solved yet.
        active = cells.join(state.where("NOT done").select("key", "t", "scale"), "key")
        c = active.withColumn("c", F.col("size") / F.col("scale"))
        w = _rate("t", "c")
        free = w < MOST
        sums = c.groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * w).alias("has"),
            F.sum(F.when(free, F.col("n") * F.col("size") * F.col("c") * w).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("has") - F.col("target")
        lo = F.when(gap < 0, F.col("t")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("t")).otherwise(F.col("hi"))
        moved = state.join(sums, "key", "left").select(
            "key", "target", "scale", "t", "done", gap.alias("gap"), "slope", lo.alias("lo"), hi.alias("hi")
        )
        newton = F.col("t") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        near = F.col("done") | (F.abs("gap") <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0)))
        nxt = moved.select(
            "key",
            "target",
            "scale",
            F.when(near, F.col("t")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("t"),
            "lo",
            "hi",
            near.alias("done"),
        )
        state = work.keep(nxt, f"dual-{step}")
        work.drop(f"dual-{step - 1}")
        if state.where("NOT done").isEmpty():
            break
    return state.select("key", "t", "scale")


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers of copies for the cells of one source."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    copies, left = [], 0.0
    for size, n, w in zip(cells["size"], cells["n"], cells["w"]):
        wanted = n * w
        m = int(min(max(round(wanted + left / size if size else wanted), 0), MOST * n))
        left += (wanted - m) * size
        copies.append(m)
    return cells[["key", "size", "n"]].assign(m=np.array(copies, np.int64))


def mixed(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken, a row for each row of ``docs``, and its ``carried`` columns.

    A null text has size 0; documents of size 0 take part with a rate of 1 and
    bring no words. A null source is a source of its own, ordered last.
    Repeated rows are documents of their own; rows that agree in doc_id, source
    and size are interchangeable here.
    """
    work = Workspace(docs.sparkSession, "mixing")
    rows = work.keep(docs.select("doc_id", "source", *carried, _source_key().alias("key"), n_words(F.col("text")).alias("size")), "rows")
    cells = work.keep(
        rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("n")), "cells"
    )
    whole = cells.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("_docs"),
    )
    sources = work.keep(
        targets(whole).withColumn("scale", F.col("source_size") / F.greatest("_docs", F.lit(1))).drop("_docs"),
        "sources",
    )
    sources = sources.withColumn("scale", F.greatest("scale", F.lit(1.0)))
    dual = _solved(work, cells.drop("source"), sources)
    rated = cells.drop("source").join(dual, "key").withColumn("c", F.col("size") / F.col("scale"))
    rated = rated.withColumn("w", _rate("t", "c"))
    copies = rated.select("key", "size", "n", "w").groupBy("key").applyInPandas(
        _rounded, "key string, size long, n long, m long"
    )
    plan = work.keep(copies.join(sources.select("key", "source_size", "target"), "key"), "plan")
    ranked = numbered(
        rows.select("doc_id", *carried, "key", "size"), ["key", "size"], [F.col("doc_id")], rows.count(), "_k"
    )
    got = F.floor(F.col("m") / F.col("n")) + F.when(F.col("_k") < F.col("m") % F.col("n"), 1).otherwise(0)
    out = ranked.join(plan, ["key", "size"]).select(
        "doc_id", "size", "source_size", "target", got.cast("long").alias("copies"), F.col("key").alias("_key"), *carried
    )
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).drop("_key")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the columns of ``docs``.

    Rows that agree in doc_id, source and text get the copies of all of them
    together, dealt evenly; which of them gets one more makes no difference but in other columns.
    """
    work = Workspace(spark, "mixing-stage")
    of_text = {"_mix_hash": F.xxhash64("text"), "_mix_crc": F.coalesce(F.crc32("text"), F.lit(-1))}
    own = docs.withColumns({**of_text, "_mix_key": _source_key()})
    plan = mixed(own.select("doc_id", "source", "text", *of_text), tuple(of_text))
    same = ["doc_id", "_key", *of_text]
    plan = plan.groupBy(*same).agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows"))
    plan = work.keep(plan.where("_mix_copies > 0").withColumnsRenamed({c: f"_plan_{c}" for c in same}), "copies")
    match = own["doc_id"].eqNullSafe(plan["_plan_doc_id"]) & (own["_mix_key"] == plan["_plan__key"])
    for c in of_text:
        match &= own[c] == plan[f"_plan_{c}"]
    met = own.join(plan, match)

    def repeated(rows: DataFrame, copies: Column) -> DataFrame:
        times = F.explode(F.sequence(F.lit(1), copies.cast("int")))
        return rows.where(copies > 0).withColumn("_mix_copy", times).select(*docs.columns)

    # Texts are shuffled once, for the join; only repeated rows are numbered as well.
    alone = repeated(met.where("_mix_rows = 1"), F.col("_mix_copies"))
    several = plan.where("_mix_rows > 1")
    if several.isEmpty():
        return alone
    order = Window.partitionBy("doc_id", "_mix_key", *of_text).orderBy("_mix_crc")
    numbered_rows = met.where("_mix_rows > 1").withColumn("_mix_row", F.row_number().over(order))
    extra = F.when(F.col("_mix_row") <= F.col("_mix_copies") % F.col("_mix_rows"), 1).otherwise(0)
    return alone.unionByName(repeated(numbered_rows, F.floor(F.col("_mix_copies") / F.col("_mix_rows")) + extra))
