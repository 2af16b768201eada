"""Reading tables, keeping intermediate results in the shared folder, numbering rows."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task sorts when rows of a group are numbered.
ROWS_PER_BLOCK = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors reach.

    A local session without the setting gets a folder of its own, once.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="lakesmith-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: A list of so many 64-bit ids, 64 MB as a hash table, is sent to all tasks; a longer one is shuffled.
SENT_IDS = 4_000_000


def listed(ids: DataFrame) -> DataFrame:
    """A written list of 64-bit ids, marked for a broadcast if its length allows it, else for a merge join."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


class Workspace:
    """Intermediate tables of one call, written to the shared folder.

    A written table cuts the lineage and survives the loss of executors.
    ``drop`` deletes tables that no later step reads; those that the returned
    frame still reads stay until the owner of the folder clears it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def built(held: Broadcast, make: Callable[[Any], Any]) -> Any:
    """What ``make`` builds of a broadcast value, once in each Python worker.

    Workers keep broadcasts between tasks. Values of plain and numpy types need
    no module of this package to be read.
    """
    if not hasattr(held, "_built"):
        held._built = make(held.value)
    return held._built


def numbered(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    rows: int,
    name: str = "number",
) -> DataFrame:
    """``df`` with the number of each row within its group, gapless from 0.

    Rows of a group are dealt to blocks by a hash of ``order``; a block's rows
    are numbered by ``order`` after those of the blocks before it. So no task
    sorts more than a block, however large a group is. ``rows``: how many ``df``
    has. ``df`` is read twice: pass a written table. Group columns must not be null.
    """
    blocks = max(16, math.ceil(rows / ROWS_PER_BLOCK))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    keys = [*groups, "_block"]
    before = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys).orderBy(*order)
    placed = dealt.join(starts, keys).withColumn(name, F.col("_start") + F.row_number().over(own) - 1)
    return placed.drop("_block", "_start")
