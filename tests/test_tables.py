"""Alignment, dedupe, upsert and the table writes, against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesmith.operators import align
from lakesmith.operators.dedupe import dedupe, dedupe_counts, key_duplicates, latest_per_key
from lakesmith.operators.reconcile import count_reconcile
from lakesmith.operators.upsert import partition_predicate, replace_slice, upsert
from lakesmith.sinks.tables import append, compact, dedupe_table, merge, overwrite
from lakesmith.sources.tables import count_rows, is_table, open_table, read_columns


def rows(df, *order):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted([tuple(r) for r in (df.select(*order) if order else df).collect()], key=key)


# -- alignment -----------------------------------------------------------------


def test_align_names(spark):
    df = spark.createDataFrame([(1, 2)], "ID int, Other int")
    assert align.align_column_case(df, ["id", "x"]).columns == ["id", "Other"]
    assert align.resolve_columns(["Id", "b"], ["ID"]) == ["Id"]
    with pytest.raises(ValueError, match="no column 'z'"):
        align.resolve_columns(["Id"], ["z"])


def test_frame_for_write(spark):
    df = spark.createDataFrame([(1, "x", 5)], "ID long, name string, extra int")
    target = T._parse_datatype_string("name string, id long, gone double")
    with pytest.raises(ValueError, match="gone"):
        align.frame_for_write(df, target)
    out = align.frame_for_write(df, target, fill_missing_columns=True)
    assert out.columns == ["name", "id", "gone"] and rows(out) == [("x", 1, None)]


def test_align_to_table_and_losses(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "n string, extra string").withColumn(
        "v", F.lit(None)
    )
    target = T._parse_datatype_string("n int, missing date")
    out = align.align_to_table(df, target)
    assert [f.dataType.simpleString() for f in out.schema] == ["int", "date", "string", "string"]
    assert rows(out, "extra", "n") == [("a", 1), ("b", None), ("c", None)]
    assert rows(align.cast_losses(df, target)) == [("n", 1)]


def test_void_and_timestamps(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 3, tzinfo=dt.timezone.utc),)], "t timestamp").withColumn(
        "v", F.lit(None)
    )
    assert align.void_columns(df.schema) == ["v"]
    out = align.business_timestamps_to_ntz(align.coerce_void_fields(df))
    assert [f.dataType.simpleString() for f in out.schema] == ["timestamp_ntz", "string"]
    assert out.first()["t"] == dt.datetime(2026, 1, 1)


def test_drop_void_columns(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    with pytest.raises(RuntimeError, match="key"):
        align.drop_void_columns(df, ["K"], required=["k"])
    with pytest.raises(RuntimeError):
        align.drop_void_columns(df, ["v"], required=["k"], strategy="fail")
    with pytest.raises(RuntimeError, match="drop"):
        align.drop_void_columns(df, ["v"], required=["k"])
    assert align.drop_void_columns(df, ["V"], required=["k"], strategy="force").columns == ["k"]
    assert align.drop_void_columns(df.filter("v is null"), ["v"], required=["k"]).columns == ["k"]


# -- dedupe --------------------------------------------------------------------


def _random_versions(spark, n=2000, seed=5):
    rng = random.Random(seed)
    data = [
        (
            None if rng.random() < 0.3 else rng.randint(0, 40),
            rng.choice(["a", "b", None]),
            None if rng.random() < 0.2 else rng.randint(0, 30),
            i,
            None if rng.random() < 0.1 else dt.datetime(2022, 1, 1) + dt.timedelta(days=rng.randint(0, 800)),
        )
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "k int, g string, _extracted_at int, id int, dt_atualz timestamp_ntz")


def test_dedupe_against_brute_force(spark):
    data, df = _random_versions(spark)
    kept = [r for r in data if r[4] is not None and r[4] >= dt.datetime(2023, 1, 1)]
    best = {}
    for r in kept:
        rank = (r[2] is not None, r[2] if r[2] is not None else 0, -r[3])
        if (r[0], r[1]) not in best or rank > best[(r[0], r[1])][0]:
            best[(r[0], r[1])] = (rank, r)
    expected = sorted(v[1][3] for v in best.values())
    got = sorted(r["id"] for r in dedupe(df.repartition(7), ["K", "g"]).collect())
    assert got == expected
    counts = dedupe_counts(df, ["k", "g"]).first().asDict()
    assert counts == {
        "before": len(data), "after": len(best), "removed": len(data) - len(best),
        "purged_pre": len(data) - len(kept), "deduped": len(kept) - len(best),
    }


def test_dedupe_is_repeatable_and_limits_before_the_shuffle(spark):
    _, df = _random_versions(spark)
    once = latest_per_key(df, ["k", "g"])
    assert rows(once) == rows(latest_per_key(once, ["k", "g"])) == rows(latest_per_key(df.repartition(3), ["k", "g"]))
    plan = once._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_shuffle


def test_key_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, None), (None, None), (2, 3)], "a int, b int")
    assert key_duplicates(df, ["A", "b"]).first().asDict() == {"total": 5, "unique": 3, "duplicates": 2}
    assert key_duplicates(df.filter("false"), ["a"]).first().asDict() == {"total": 0, "unique": 0, "duplicates": 0}


def test_since_on_zoned_column(spark):
    stamps = [dt.datetime(2023, 1, 1, h, tzinfo=dt.timezone.utc) for h in (0, 2, 3, 4)] + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "k int, dt_atualz timestamp")
    # midnight in Sao Paulo is 03:00 UTC
    assert rows(dedupe(df, ["k"], None), "k") == [(2,), (3,)]
    text = spark.createDataFrame([(1, "31/12/2022"), (2, "2023-01-01"), (3, "junk")], "k int, dt_atualz string")
    assert rows(dedupe(text, ["k"], None), "k") == [(2,)]


# -- upsert --------------------------------------------------------------------


def _upsert_by_hand(target, source, in_scope=lambda row: True):
    by_key = {s[:2]: s for s in source if None not in s[:2]}
    matched = set()
    out = []
    for t in target:
        new = by_key.get(t[:2]) if in_scope(t) and None not in t[:2] else None
        if new:
            matched.add(new[:2])
        out.append(new or t)
    return out + [s for s in source if None in s[:2] or s[:2] not in matched]


def _upsert_data(seed):
    rng = random.Random(seed)
    pick = lambda n: None if rng.random() < 0.25 else rng.randint(0, n)
    target = [(pick(20), rng.choice(["p", "q", "r"]), i, "old") for i in range(300)]
    source, seen = [], set()
    for i in range(200):
        row = (pick(30), rng.choice(["p", "q", None]), 1000 + i, "new")
        if row[:2] not in seen or None in row[:2]:
            seen.add(row[:2])
            source.append(row)
    return target, source


SCHEMA = "k int, part string, n int, v string"


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_upsert_against_brute_force(spark, seed, broadcast):
    target, source = _upsert_data(seed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
        out = upsert(t, s.select("v", "n", F.col("k").alias("K"), "part"), ["k", "part"])
        expected = spark.createDataFrame(_upsert_by_hand(target, source), SCHEMA)
        assert rows(out) == rows(expected)
        # repeated targets are each updated; a second run only repeats the NULL keys
        again = upsert(out, s.filter("k is not null and part is not null"), ["k", "part"])
        assert rows(again) == rows(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_unique_target_takes_the_short_plan(spark):
    target = [(i, "p", i, "old") for i in range(50)] + [(None, "p", -1, "old")]
    source = [(i, "p", i, "new") for i in range(40, 60)] + [(None, "p", -2, "new")]
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
    assert rows(upsert(t, s, ["k"], target_keys_unique=True)) == rows(upsert(t, s, ["k"]))


def test_upsert_keeps_missing_columns(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, keep int")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert rows(upsert(t, s, ["k"])) == [(1, "a", 10), (2, "B", 20), (3, "C", None), (None, "N", None)]
    with pytest.raises(ValueError, match="missing in the target"):
        upsert(t, s.withColumn("extra", F.lit(1)), ["k"])


def test_upsert_scope(spark):
    target = [(k, p, 0, "old") for k in range(5) for p in "pqr"]
    source = [(k, "p" if k % 2 else "q", 1, "new") for k in range(7)]
    t, s = spark.createDataFrame(target, SCHEMA), spark.createDataFrame(source, SCHEMA)
    scope = partition_predicate(s, "PART")
    by_key = {r[0]: r for r in source}
    expected = [by_key[r[0]] if r[1] in "pq" else r for r in target] + source[5:]
    assert rows(upsert(t, s, ["k"], scope=scope)) == rows(spark.createDataFrame(expected, SCHEMA))


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_partition_values_are_compared_in_the_targets_type(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        t = spark.createDataFrame([(i, i % 2000) for i in range(3000)], "k int, p int")
        s = spark.createDataFrame([(i, f"{i % 2000:06d}") for i in range(1500)], "k int, p string")
        assert rows(upsert(t, s, ["k"], partition_col="p")) == rows(t)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_upsert_version_guard(spark):
    t = spark.createDataFrame([(1, 5, "a", "old"), (2, 5, "b", "old"), (3, None, None, "old"), (4, 5, "a", "old")], "k int, n int, m string, v string")
    s = spark.createDataFrame([(1, 4, "z", "new"), (2, 5, "c", "new"), (3, None, "a", "new"), (4, None, "z", "new"), (5, None, None, "new")], "k int, n int, m string, v string")
    out = upsert(t, s, ["k"], version_col=["n", "M"], target_keys_unique=True)
    assert rows(out, "k", "v") == [(1, "old"), (2, "new"), (3, "new"), (4, "old"), (5, "new")]


def test_a_write_after_a_broken_replacement_keeps_the_rows(spark, tmp_path):
    path = tmp_path / "t"
    merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), str(path), merge_keys=["k"])
    path.rename(tmp_path / "t__previous-0")  # stopped between setting the table aside and the new one's arrival
    merge(spark.createDataFrame([(2, "B")], "k int, v string"), str(path), merge_keys=["k"])
    assert rows(spark.read.parquet(str(path))) == [(1, "a"), (2, "B")]


def test_partition_predicate(spark):
    one = spark.createDataFrame([("hra", 1), (" ", 2), (None, 3)], "origem string, id int")
    assert partition_predicate(one, "origem").sql() == "target.`origem` = 'hra'"
    two = spark.createDataFrame([("hra", 1), ("hbl ", 2)], "origem string, id int")
    assert partition_predicate(two, "origem").sql() == "target.`origem` IN ('hbl', 'hra')"
    assert partition_predicate(two.withColumn("origem", F.lit("a b")), "origem").sql() is None
    assert partition_predicate(one, "other").sql() is None


def test_replace_slice_keeps_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    n = spark.createDataFrame([("1", "new")], "k string, v string")
    assert rows(replace_slice(t, n, "k = 1")) == [(1, "new"), (2, "c"), (None, "b")]
    with pytest.raises(Exception, match="outside the slice"):
        replace_slice(t, n, "k = 2").collect()
    assert rows(replace_slice(t, n.filter("false"), "k = 1")) == [(2, "c"), (None, "b")]


def test_count_reconcile(spark):
    a = spark.createDataFrame([("x", 10), ("y", 5), ("z", 1)], "table_name string, rows long")
    b = spark.createDataFrame([("x", 10), ("y", 2), ("w", 4)], "table_name string, rows long")
    assert rows(count_reconcile(a, b)) == [("w", 0, 4, -4), ("y", 5, 2, 3), ("z", 1, 0, 1)]
    assert rows(count_reconcile(a, b, 3)) == [("w", 0, 4, -4)]


# -- table writes --------------------------------------------------------------


def test_overwrite_and_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not is_table(spark, path) and count_rows(spark, path) == 0
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert overwrite(df.filter("false"), path) == 0 and not is_table(spark, path)
    assert overwrite(df, path) == 3 and count_rows(spark, path) == 3
    assert overwrite(df.filter("k = 1").withColumn("v", F.lit("z")), path, predicate="k = 1") == 1
    assert rows(open_table(spark, path)) == [(1, "z"), (2, "b"), (None, "c")]
    assert overwrite(df.filter("false"), path, predicate="k = 2") == 0
    assert rows(open_table(spark, path)) == [(1, "z"), (None, "c")]
    # a full overwrite takes the new schema
    assert overwrite(df.select("v"), path) == 3
    assert open_table(spark, path).columns == ["v"]
    assert rows(read_columns(spark, path, ["V"])) == [("a",), ("b",), ("c",)]


def test_overwrite_one_partition_leaves_the_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("007", 1), ("8", 2)], "origem string, n int")
    overwrite(df, path, partition_by=["origem"])
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "origem=8").glob("*.parquet")}
    new = spark.createDataFrame([("007", 5), ("007", 6)], "origem string, n int")
    assert overwrite(new, path, predicate={"origem": "007"}) == 2
    assert rows(open_table(spark, path), "origem", "n") == [("007", 5), ("007", 6), ("8", 2)]
    assert kept == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "origem=8").glob("*.parquet")}
    assert overwrite(new.filter("false"), path, predicate={"origem": "8"}) == 0
    assert rows(open_table(spark, path), "origem", "n") == [("007", 5), ("007", 6)]


def test_slice_heals_untyped_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1,), (2,)], "k int").withColumn("v", F.lit(None)).write.parquet(path)
    new = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(RuntimeError, match="without a type"):
        append(new, path)
    overwrite(new, path, predicate="k = 1")
    assert rows(open_table(spark, path)) == [(1, "x"), (2, None)]
    assert open_table(spark, path).schema["v"].dataType == T.StringType()


def test_append(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    assert append(df, path) == 1
    assert append(spark.createDataFrame([("b", 2, 9)], "V string, K int, extra int"), path) == 1
    with pytest.raises(ValueError):
        append(df.select("k"), path)
    assert append(df.select("k"), path, fill_missing_columns=True) == 1
    assert append(df.filter("false"), path) == 0
    assert rows(open_table(spark, path)) == [(1, "a"), (1, None), (2, "b")]


def test_merge_cycle(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b")], "k int, v string")
    assert merge(df.filter("false"), path, merge_keys=["k"]) == 0
    assert merge(df, path, merge_keys=["k"]) == 3  # creation does not look at keys
    with pytest.raises(ValueError, match="more than once"):
        merge(df, path, merge_keys=["k"])
    new = spark.createDataFrame([(1, "n"), (3, "c"), (None, "x"), (None, "y")], "k int, v string")
    assert merge(new, path, merge_keys=["K"]) == 4
    assert rows(open_table(spark, path)) == [(1, "n"), (1, "n"), (2, "b"), (3, "c"), (None, "x"), (None, "y")]


def test_merge_evaluates_its_source_once(spark, tmp_path):
    """A source that differs on every evaluation still merges as one set of rows."""
    path = str(tmp_path / "t")
    merge(spark.range(100).select("id", F.lit(0.0).alias("v")), path, merge_keys=["id"])
    unstable = spark.range(200).select((F.col("id") + F.floor(F.rand() * 3) * 200).alias("id"), F.rand().alias("v"))
    assert merge(unstable, path, merge_keys=["id"]) == 200
    table = open_table(spark, path)
    assert table.filter("v > 0").count() == 200
    assert table.select("id").distinct().count() == table.count()
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("extra", [[], [(9, " p", "blank")]])
def test_merge_in_partitions(spark, tmp_path, extra):
    path = str(tmp_path / "t")
    schema = "k int, part string, v string"
    first = [(1, "p", "a"), (2, "q", "b"), (3, "r", "c")]
    merge(spark.createDataFrame(first, schema), path, merge_keys=["k"], partition_col="part")
    kept = {f.name for f in (tmp_path / "t" / "part=r").glob("*.parquet")}
    # key 1 moves from p to q, key 3 exists outside the scope and stays as well
    second = [(1, "q", "A"), (4, "p", "D"), (3, "p", "C")] + extra
    merge(spark.createDataFrame(second, schema), path, merge_keys=["k"], partition_col="part")
    expected = [(1, "q", "A"), (2, "q", "b"), (3, "p", "C"), (3, "r", "c"), (4, "p", "D")] + extra
    assert rows(open_table(spark, path), "k", "part", "v") == sorted(expected)
    same = kept == {f.name for f in (tmp_path / "t" / "part=r").glob("*.parquet")}
    assert same == (not extra)


def test_merge_with_untyped_column(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a")], "k int, v string").withColumn("u", F.lit(None)).write.parquet(path)
    new = spark.createDataFrame([(1, "b", None), (2, "c", None)], "k int, v string, u string")
    assert merge(new, path, merge_keys=["k"]) == 2
    assert rows(open_table(spark, path)) == [(1, "b", None), (2, "c", None)]


def test_dedupe_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(RuntimeError):
        dedupe_table(spark, path, key_cols=["k"])
    overwrite(spark.createDataFrame([(1, 1), (1, 2), (2, None)], "k int, _extracted_at int"), path)
    dry = dedupe_table(spark, path, key_cols=["k"], dry_run=True)
    assert dry["removed"] == 1 and count_rows(spark, path) == 3
    assert dedupe_table(spark, path, key_cols=["k"])["after"] == 2
    assert rows(open_table(spark, path)) == [(1, 2), (2, None)]
    assert dedupe_table(spark, path, key_cols=["k"])["removed"] == 0


@pytest.mark.parametrize("partitioned", [False, True])
def test_compact(spark, tmp_path, partitioned):
    path = str(tmp_path / "t")
    df = spark.range(1000).withColumn("p", F.concat(F.lit("x"), F.col("id") % 2)).repartition(20)
    df.write.partitionBy(*(["p"] if partitioned else [])).parquet(path)
    before = rows(open_table(spark, path), "id", "p")
    counts = compact(spark, path)
    assert counts["files_before"] == (40 if partitioned else 20)
    assert counts["files_after"] == (2 if partitioned else 1)
    assert rows(open_table(spark, path), "id", "p") == before
    assert compact(spark, str(tmp_path / "none")) == {}
