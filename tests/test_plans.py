"""What the plans must and must not contain to hold at scale."""

import datetime as dt
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesmith.operators.dedupe import dedupe, dedupe_counts, key_duplicates
from lakesmith.operators.inventory import bucket_usage, classify_objects, loose_samples, table_roots
from lakesmith.operators.upsert import upsert
from lakesmith.plans.load import in_window
from lakesmith.queries import REGISTERED
from lakesmith.queries.inputs import load
from lakesmith.sinks.files import materialize

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """No broadcast, as for large inputs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


WRITERS = {"write_merge", "write_slice", "write_append", "write_dedupe", "compact", "upsert_stream", "growth", "load_cycle"}


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - WRITERS))
def test_no_nested_loops_and_no_python(spark, shuffled, name):
    text = plan(REGISTERED[name][0](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "InPandas" not in text


def test_merge_reads_only_the_keys_twice(spark, shuffled):
    target, source = spark.read.parquet(f"{SMALL}/orders.parquet"), load(spark, SMALL, "orders")
    text = plan(upsert(target, source.withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"]))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas.count("o_orderkey:bigint") >= 1
    assert not [s for s in schemas if s.startswith("o_orderkey:bigint,") and s.count(":") in (2, 3)]


def test_since_filter_reaches_the_scan(spark):
    events = load(spark, SMALL, "events")
    text = plan(dedupe(events, ["user_id"], "value", "ts", "2024-01-15"))
    assert "GreaterThanOrEqual(ts,2024-01-15T00:00)" in text.replace(" ", "")


def test_window_of_a_load_reaches_the_scan(spark):
    text = plan(in_window(load(spark, SMALL, "events"), "ts", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)))
    pushed = re.search(r"PushedFilters: \[(.*)", text).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_window_over_instants_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    hours = spark.range(48).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "id")
    hours.write.parquet(path)
    start, end = dt.datetime(1970, 1, 1, 3), dt.datetime(1970, 1, 1, 5)
    found = in_window(spark.read.parquet(path), "ts", start, end)
    assert sorted(r["id"] for r in found.collect()) == [6, 7, 8]
    pushed = re.search(r"PushedFilters: \[(.*)", plan(found)).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


def test_counts_are_combined_before_the_shuffle(spark):
    lines = load(spark, SMALL, "lineitem")
    for df in (dedupe_counts(lines, ["l_orderkey"], None), key_duplicates(lines, ["l_orderkey"])):
        text = plan(df)
        assert text.count("HashAggregate(keys=[l_orderkey") == 2
        assert "ReadSchema: struct<l_orderkey:bigint>" in text


def _below(text, node):
    """The lines of the first such node and of all it reads."""
    lines = text.splitlines()
    at = next(i for i, x in enumerate(lines) if node in x)
    depth = re.search(r"\w", lines[at]).start()
    end = next((i for i in range(at + 1, len(lines)) if re.search(r"\w", lines[i]).start() <= depth), len(lines))
    return lines[at:end]


def test_objects_are_never_exploded(spark, shuffled):
    """Only the places of tables are exploded to prefixes; objects are sorted in ranges."""
    objects = spark.read.parquet(_inventory(spark))
    roots = materialize(table_roots(objects), "roots")
    for df in (bucket_usage(objects, roots), loose_samples(objects, roots), classify_objects(objects, roots)):
        text = plan(df)
        assert "hashpartitioning(__range#" in text and "path_prefixes" not in text
        found = _below(text, "Generate explode")
        assert not [x for x in found if "FileScan" in x and "key" in x]
    assert "hashpartitioning(bucket#" not in plan(classify_objects(objects, roots)).split("Window")[0]


def test_objects_are_summed_per_folder_before_they_are_shuffled(spark, shuffled):
    objects = spark.read.parquet(_inventory(spark))
    text = plan(bucket_usage(objects, materialize(table_roots(objects), "roots")))
    assert re.search(r"HashAggregate\(keys=\[bucket#\d+, \w+#\d+\], functions=\[partial_count", text)


def _inventory(spark):
    from lakesmith.session import scratch_dir

    path = scratch_dir(spark, "inventory")
    load(spark, SMALL, "objects").write.parquet(path)
    return path


# -- a third of all rows on one key ------------------------------------------------


def test_hot_key_is_ranked_before_the_shuffle(spark):
    """Each map task sends one row of the hot key."""
    from lakesmith.operators.dedupe import latest_per_key

    df = spark.range(0, 90_000, 1, 9).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    out = latest_per_key(df, ["k"], "v")
    assert out.count() == 60_001
    assert out.filter("k = -1").first()["v"] == 89_997
    node = out._jdf.queryExecution().executedPlan()
    out.collect()
    text = node.toString()
    assert text.index("WindowGroupLimit", text.index("Exchange")) > 0


@pytest.mark.parametrize("unique", [True, False])
def test_hot_null_keys_are_dealt_to_many_tasks(spark, shuffled, unique):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        null = F.lit(None).cast("long")
        keyed = F.when(F.col("id") % 3 == 0, null).otherwise(F.col("id")).alias("k")
        target = spark.range(30_000).select(keyed, F.col("id").alias("v"))
        source = spark.range(3_000).select(keyed, (-F.col("id")).alias("v"))
        out = upsert(target, source, ["k"], target_keys_unique=unique)
        rows = out.withColumn("p", F.spark_partition_id()).filter("k is null").collect()
        assert len(rows) == 11_000 and out.count() == 31_000
        sizes = Counter(r["p"] for r in rows)
        assert len(sizes) >= 8 and max(sizes.values()) < 2_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
