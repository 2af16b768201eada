"""Sharding (operator 10): byte balance of indivisible groups by Karmarkar-Karp differencing.

Documents of equal texts are one group and go to one shard. A group starts as a
partial partition that has its bytes in one part and nothing in the others. Again
and again the two partial partitions of largest spread are combined, the largest
part of one with the smallest of the other, until one is left: its parts are the
shards.

No task holds more than a block of groups. Groups are taken by size, in classes
from the largest to the smallest. A class is dealt to blocks, and the shards' sums so
far, divided by the number of blocks, are one more partial partition in each of
them: its parts name the shards, and the block's groups fill what earlier
classes have left uneven. A class has enough groups of like size in each block to
do so closely; what its blocks leave over together is the next class's to
level. The last block is a RESERVE of the smallest class, so that the end is as even
as if all had been one block. Only one number for each shard is handed on.

A group with more bytes than a shard's equal share cannot be balanced whole: it is
split into the least number of pieces that can. At most one such group per shard
can exist.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Workspace, numbered, read

SHARDS = 40
#: Bytes that every document counts besides those of its text.
OVERHEAD = 16
#: Groups that one task differences.
BLOCK = 20_000
#: Parts that a large group's doc_ids are dealt to before it is split.
CELLS = 4096

def differenced(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine rows of part sums (each row a partial partition) until one is left.

    Returns for each row which shard each of its parts goes to, and the shards' sums.
    Ties of spread go by the order of the rows.
    """
    n, k = parts.shape
    sums: list[np.ndarray | None] = [row.astype(np.int64) for row in parts]
    nodes: list[tuple[int, np.ndarray, int, np.ndarray] | None] = [None] * n
    heap = [(int(row.min() - row.max()), i) for i, row in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        up, down = np.argsort(sums[a], kind="stable"), np.argsort(-sums[b], kind="stable")
        total = sums[a][up] + sums[b][down]
        nodes.append((a, up, b, down))
        sums[a] = sums[b] = None
        sums.append(total)
        heapq.heappush(heap, (int(total.min() - total.max()), len(sums) - 1))
    root = len(sums) - 1
    places: list[np.ndarray | None] = [None] * len(sums)
    places[root] = np.arange(k)
    for node in range(root, n - 1, -1):
        a, up, b, down = nodes[node]
        for child, order in ((a, up), (b, down)):
            places[child] = np.empty(k, np.int64)
            places[child][order] = places[node]
        places[node] = None
    return np.array(places[:n]), sums[root]


def _difference_block(sums: list[int]):
    """The shard of each group of a block, given what the shards have already (for this block)."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["bytes", "order", "item"], ascending=[False, True, True], ignore_index=True)
        parts = np.zeros((len(block) + 1, len(sums)), np.int64)
        parts[0] = sums
        parts[1:, 0] = block["bytes"]
        places, _ = differenced(parts)
        shard = np.empty(len(sums), np.int32)
        shard[places[0]] = np.arange(len(sums))
        return block[["item", "bytes"]].assign(shard=shard[places[1:, 0]])

    return one


def _runs(classes: list[tuple[int, int]], block: int) -> list[tuple[int, int, int]]:
    """(first class, last class, groups) of classes (number, groups) that are taken together: those that fit one block."""
    out: list[tuple[int, int, int]] = []
    for number, n in sorted(classes):
        if out and out[-1][2] + n <= block:
            first, _, before = out.pop()
            out.append((first, number, before + n))
        else:
            out.append((number, number, n))
    return out


def balanced(work: Workspace, units: DataFrame, shards: int) -> DataFrame:
    """(item, shard) of each row of a written table ``item, bytes, order``.

    The sizes of a class differ by a factor that leaves at most half a block of groups
    for the first class, whose groups are the only ones that may near a shard's share.
    """
    factor = max(2.0, BLOCK / (2 * shards))
    total = units.agg(F.sum("bytes")).first()[0] or 0
    step = F.floor(F.log(F.lit(max(1.0, total / shards)) / F.col("bytes")) / F.log(F.lit(factor)))
    sized = units.withColumn("class", F.greatest(step, F.lit(0)).cast("int"))
    classes = [tuple(r) for r in sized.groupBy("class").count().collect()]  # as many as the sizes' digits
    sums, out = np.zeros(shards, np.int64), []
    grid = 1 << 30
    runs = [(first, last, n, 0, grid) for first, last, n in _runs(classes, BLOCK)]
    if runs and runs[-1][2] > BLOCK:
        first, last, n, _, _ = runs.pop()
        kept = grid * BLOCK // (2 * n)
        runs += [(first, last, n, kept, grid), (first, last, BLOCK // 2, 0, kept)]
    for number, (first, last, n, lo, hi) in enumerate(runs):
        draw = F.pmod(F.xxhash64("order", "item", F.lit(2)), F.lit(grid))
        own = sized.where(F.col("class").between(first, last) & (draw >= lo) & (draw < hi))
        blocks = 1 if number == len(runs) - 1 else max(1, -(-n // BLOCK))
        block = F.pmod(F.xxhash64("order", "item", F.lit(1)), F.lit(blocks)).cast("int")
        dealt = own.withColumn("block", block).groupBy("block")
        found = dealt.applyInPandas(_difference_block((sums // blocks).tolist()), "item long, bytes long, shard int")
        out.append(work.keep(found, f"class-{number}"))
        for shard, more in out[-1].groupBy("shard").agg(F.sum("bytes")).collect():
            sums[shard] += more
    none = units.select("item", F.lit(0).alias("shard")).limit(0)
    return reduce(DataFrame.unionByName, (f.select("item", "shard") for f in out), none)


def group_key(text: Column) -> dict[str, Column]:
    """What tells texts apart: a 64-bit hash, a CRC and the length; a null text is a group of its own."""
    return {
        "hash": F.xxhash64(text),
        "crc": F.coalesce(F.crc32(text), F.lit(-1)).cast("long"),
        "length": F.coalesce(F.octet_length(text), F.lit(-1)).cast("long"),
    }


KEY = ["hash", "crc", "length", "piece"]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot, a row for each row of ``docs``, and the group's key.

    A null text has no bytes and no CRC; all rows of null text are one group.
    Repeated rows are documents of their own in the same group. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "sharding")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    rows = work.keep(
        docs.select("doc_id", size.alias("size"), *[c.alias(n) for n, c in group_key(F.col("text")).items()]), "rows"
    )
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    share = max(1, math.ceil((whole["bytes"] or 0) / shards))
    keys = KEY[:3]
    groups = rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    pieces = F.least(F.ceil(F.col("bytes") / share), F.col("n")).alias("pieces")
    # Fewer rows than shards: their bytes exceed a share each.
    large = F.broadcast(work.keep(groups.where(F.col("bytes") > share).select(*keys, "n", pieces), "large"))
    # Copies have one size, so pieces of equal numbers of rows have equal bytes. A doc_id stays in one piece.
    held = rows.join(large, keys).withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)))
    cells = held.groupBy(*keys, "n", "pieces", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    piece = F.floor(start * F.col("pieces") / F.col("n")).cast("int").alias("piece")
    cells = work.keep(cells.select(*keys, "_cell", piece), "cells")  # CELLS for each of at most as many groups as shards
    split = held.join(F.broadcast(cells), [*keys, "_cell"]).select("doc_id", "size", *keys, "piece")
    others = rows.join(large, keys, "left_anti").select("doc_id", "size", *keys, F.lit(0).alias("piece"))
    rows = work.keep(others.unionByName(split), "pieced")
    units = rows.groupBy(*KEY).agg(F.sum("size").alias("bytes"))
    units = work.keep(units.withColumn("item", F.monotonically_increasing_id()), "units")
    items = units.select("item", "bytes", F.xxhash64(*KEY).alias("order"))
    placed = work.keep(units.join(balanced(work, items, shards), "item").select(*KEY, "shard"), "placed")
    at = work.keep(rows.join(placed, KEY).select("doc_id", "size", *KEY, "shard"), "at")
    work.drop("rows", "pieced", "units")
    order = [F.col("doc_id"), F.col("hash"), F.col("crc")]
    out = numbered(at, ["shard"], order, whole["n"], "slot")
    return out.withColumn("text_crc32", F.when(F.col("crc") >= 0, F.col("crc")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it."""
    out = sharded(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` with the shard that each row goes to; it takes the place of a column ``shard``."""
    placed = sharded(docs.select("doc_id", "text"))
    work = Workspace(spark, "sharding-stage")
    # A group lies in one shard unless it was split; then its doc_ids tell the pieces apart.
    at = work.keep(placed.select("doc_id", "hash", "crc", "length", "shard").distinct(), "at")
    at = at.withColumnsRenamed({c: f"_shard_{c}" for c in ("doc_id", "hash", "crc", "length", "shard")})
    own = docs.withColumns({f"_own_{n}": c for n, c in group_key(F.col("text")).items()})
    match = own["doc_id"].eqNullSafe(at["_shard_doc_id"])
    for n in ("hash", "crc", "length"):
        match &= own[f"_own_{n}"] == at[f"_shard_{n}"]
    kept = [c for c in docs.columns if c != "shard"]
    return own.join(at, match).select(*kept, F.col("_shard_shard").alias("shard"))
