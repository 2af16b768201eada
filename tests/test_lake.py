"""Inventory, logs, health rules, reports, cursors, maintenance, streaming."""

import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lakesmith.operators import commitlog, cursor, health, inventory, maintain, ordered, report, targets
from lakesmith.plans.health import health_scan
from lakesmith.plans.load import incremental_load, window_filter
from lakesmith.plans.reports import failures_report, growth_report
from lakesmith.session import scratch_dir
from lakesmith.sinks.tables import overwrite
from lakesmith.sources import control, listing, logs, snapshots
from lakesmith.sources.tables import open_table
from lakesmith.streaming.upsert_stream import drop_overlap, incremental_upsert_stream

UTC = dt.timezone.utc


def rows(df, *order):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted([tuple(r) for r in (df.select(*order) if order else df).collect()], key=key)


# -- inventory -----------------------------------------------------------------

TEMP = ("/_tmp/", "/tmp/", "/.trash/", "/_staging/", "/staging/", "/__pycache__/")


def _random_objects(seed, n=1500):
    rng = random.Random(seed)
    names = ["a", "b", "_tmp", "run_id=1", "_meta", "system=x", "tb", "_delta_log", "_delta_log", "staging"]
    out = {}
    for _ in range(n):
        bucket = rng.choice(["bronze", "bronze", "prata", "ouro"])
        depth = rng.randint(1, 5)
        parts = [rng.choice(names) for _ in range(depth)]
        if parts[0] == "_delta_log" and bucket != "ouro":
            parts[0] = "c"
        key = "/".join(parts)
        out[(bucket, key + rng.choice(["", "/f.parquet", "/f.parquet", "/"]))] = rng.randint(0, 1000)
    out[("prata", "a//_delta_log/0.json")] = 3
    out[("empty", "x")] = 0
    return [(b, k, s) for (b, k), s in out.items()]


def _usage_by_hand(objects):
    result, roots_of = {}, {}
    for b, k, _ in objects:
        if "/_delta_log" in "/" + k:
            root = ("/" + k).split("/_delta_log")[0].lstrip("/")
            roots_of.setdefault(b, set()).add(f"s3a://{b}/{root}" if root else f"s3a://{b}")
    for b in {o[0] for o in objects}:
        uris = sorted(roots_of.get(b, ()))
        eph = [u for u in uris if "run_id=" in u or ("/_meta/" in u.split("://")[1] and "system=" in u)]
        strip = lambda u: u[len(f"s3a://{b}"):].strip("/")
        under = lambda k, us: any(r == "" or k == r or k.startswith(r + "/") for r in map(strip, us))
        mine = sorted((k, s) for bb, k, s in objects if bb == b)
        loose = [(k, s) for k, s in mine if not under(k, uris)]
        temp = [s for k, s in mine if any(m in "/" + k for m in TEMP)]
        total = sum(s for _, s in mine)
        result[b] = {
            "object_count": len(mine), "total_bytes": total,
            "delta_bytes": total - sum(s for _, s in loose),
            "loose_bytes": sum(s for _, s in loose), "loose_objects": len(loose),
            "ephemeral_bytes": sum(s for k, s in mine if under(k, eph)),
            "temp_bytes": sum(temp), "temp_objects": len(temp),
            "loose_pct": sum(s for _, s in loose) / total * 100.0 if total else 0.0,
            "delta_tables": len(uris), "ephemeral_tables": len(eph),
            "loose_samples": [k for k, _ in loose[:8]],
        }
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_bucket_usage_against_brute_force(spark, seed, broadcast):
    objects = _random_objects(seed, 60 if seed == 3 else 400)
    expected = _usage_by_hand(objects)
    df = spark.createDataFrame(objects, "bucket string, key string, size long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        usage = inventory.with_samples(inventory.bucket_usage(df), inventory.loose_samples(df))
        got = {r["bucket"]: {k: v for k, v in r.asDict().items() if k != "bucket"} for r in usage.collect()}
        assert got.keys() == expected.keys()
        for b in expected:
            assert got[b] == expected[b], b
        flagged = inventory.classify_objects(df)
        assert flagged.count() == len(objects)
        by_bucket = {r[0]: r[1] for r in flagged.filter(~F.col("under_table")).groupBy("bucket").count().collect()}
        assert by_bucket == {b: e["loose_objects"] for b, e in expected.items() if e["loose_objects"]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("seed, range_rows", [(4, 20), (5, 3), (6, 1)])
def test_ranges_change_nothing(spark, seed, range_rows):
    """However the sorted objects are cut, tables that go over a cut stay known behind it."""
    objects = _random_objects(seed, 300)
    expected = _usage_by_hand(objects)
    df = spark.createDataFrame(objects, "bucket string, key string, size long")
    whole = {tuple(r) for r in inventory.classify_objects(df).collect()}
    assert {tuple(r) for r in inventory.classify_objects(df, range_rows=range_rows).collect()} == whole
    usage = inventory.bucket_usage(df, range_rows=range_rows)
    samples = inventory.loose_samples(df, range_rows=range_rows)
    for r in inventory.with_samples(usage, samples).collect():
        assert {k: v for k, v in r.asDict().items() if k != "bucket"} == expected[r["bucket"]]


@pytest.mark.parametrize("seed, range_rows", [(7, None), (8, 5)])
def test_usage_of_nested_prefixes(spark, seed, range_rows):
    """Each target is judged as if its own objects were all there is."""
    objects = _random_objects(seed, 300)
    rng = random.Random(seed)
    folders = {(b, "/".join(k.split("/")[: rng.randint(0, 4)])) for b, k, _ in objects}
    folders = {(b, p.strip("/")) for b, p in folders} | {("bronze", ""), ("ouro", ""), ("prata", "no/such"), ("none", "")}
    targets = spark.createDataFrame([(b, rng.choice([p, f" /{p}/ "])) for b, p in sorted(folders)], "bucket string, prefix string")
    df = spark.createDataFrame(objects, "bucket string, key string, size long")
    got = {(r["bucket"], r["prefix"]): r.asDict() for r in inventory.prefix_usage(df, targets, range_rows).collect()}
    assert got.keys() == folders
    for (bucket, prefix), row in got.items():
        held = [o for o in objects if o[0] == bucket and (not prefix or o[1].startswith(prefix + "/"))]
        want = _usage_by_hand(held).get(bucket, {"object_count": 0, "total_bytes": 0, "delta_tables": 0, "loose_pct": 0.0})
        assert {k: row[k] for k in want if k != "loose_samples"} == {k: v for k, v in want.items() if k != "loose_samples"}, (bucket, prefix)


def test_a_flat_folder_spreads_over_many_ranges(spark):
    rows = spark.range(60_000).select(
        F.lit("b").alias("bucket"), F.concat(F.lit("t/"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("key"), F.lit(1).alias("size")
    )
    log = spark.createDataFrame([("b", "t/_delta_log/0.json", 1), ("b", "u/x", 1)], "bucket string, key string, size int")
    out = inventory.classify_objects(rows.unionByName(log), range_rows=3_000)
    assert out.filter("under_table").count() == 60_001 and out.count() == 60_002
    cuts = ordered.cut_points(rows.withColumnRenamed("key", "place"), "place", 3_000)
    sizes = [r["count"] for r in rows.groupBy(ordered._range_of(F.col("key"), cuts).alias("r")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 9_000


def test_listing_sees_hidden_folders(spark, tmp_path):
    for name in ["tb/_delta_log/0.json", "tb/part.parquet", "x/y/z/deep/.hidden", "top.csv"]:
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("12345")
    got = listing.list_objects(spark, [("bronze", f"file://{tmp_path}")], split_depth=1)
    assert rows(got, "bucket", "key", "size") == [
        ("bronze", "tb/_delta_log/0.json", 5), ("bronze", "tb/part.parquet", 5),
        ("bronze", "top.csv", 5), ("bronze", "x/y/z/deep/.hidden", 5),
    ]
    assert got.filter("last_modified is null").isEmpty()
    report_file = spark.createDataFrame([(" b/", "k", None)], "bkt string, name string, bytes long")
    assert rows(listing.inventory_from(report_file, bucket="bkt", key="name", size="bytes", last_modified=None)) == [
        ("b", "k", 0, None)
    ]


# -- table logs ----------------------------------------------------------------


def _commit(table, version, *actions):
    log = table / "_delta_log"
    log.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"commitInfo": {"timestamp": 1}})] + [json.dumps(a) for a in actions]
    (log / f"{version:020d}.json").write_text("\n".join(lines))


def _add(path, size=10):
    return {"add": {"path": path, "size": size, "modificationTime": 1_700_000_000_000, "dataChange": True}}


def _remove(path, when=1_700_000_500_000):
    return {"remove": {"path": path, "deletionTimestamp": when, "dataChange": True}}


def test_log_statistics(spark, tmp_path):
    one, two, gone = tmp_path / "one", tmp_path / "two", tmp_path / "gone"
    _commit(one, 0, _add("a"), _add("b%20c+d", 30))
    _commit(one, 1, _remove("a"), _add("e", 5))
    _commit(one, 2, _remove("e"), _add("e", 7))
    _commit(two, 0)
    actions = logs.read_log_actions(spark, [str(one), str(two) + "/", str(gone)])
    tables = spark.createDataFrame([(str(t),) for t in (one, two, gone)], "table string")
    stats = commitlog.table_stats(actions, tables)
    assert rows(stats) == [
        (str(gone), False, None, 0, 0, 0, None),
        (str(one), True, 2, 2, 3, 37, 18.5),
        (str(two), True, 0, 0, 1, 0, None),
    ]
    assert rows(commitlog.live_files(actions), "path", "size") == [("b c+d", 30), ("e", 7)]
    assert rows(commitlog.tombstones(actions), "path") == [("a",)]
    capped = commitlog.table_stats(actions, history_limit=2).filter(F.col("table") == str(one))
    assert capped.first()["history_len"] == 2
    assert logs.read_log_actions(spark, [str(gone)]).isEmpty()


def test_log_checkpoint(spark, tmp_path):
    table = tmp_path / "t"
    schema = """add struct<path string, size bigint, modificationTime bigint>,
        remove struct<path string, size bigint, deletionTimestamp bigint>"""
    log = table / "_delta_log"
    log.mkdir(parents=True)

    def checkpoint(version, *files):
        data = [((f, 10, 1), None) for f in files]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / f"c{version}"))
        part = next((tmp_path / f"c{version}").glob("part-*.parquet"))
        (log / f"{version:020d}.checkpoint.parquet").write_bytes(part.read_bytes())

    # commits 0-9 are gone; "old" was removed between the two checkpoints
    checkpoint(5, "old", "kept")
    checkpoint(9, "kept", "late")
    _commit(table, 9, _add("late"))
    _commit(table, 10, _remove("late"), _add("new"))
    actions = logs.read_log_actions(spark, [str(table)])
    assert rows(commitlog.live_files(actions), "path") == [("kept",), ("new",)]
    assert commitlog.table_stats(actions).first()["version"] == 10
    files = logs.read_log_files(spark, [str(table)])
    assert rows(files, "version", "kind") == [(10, "commit"), (5, "checkpoint"), (9, "checkpoint"), (9, "commit")]
    assert {r[0] for r in files.select("table").collect()} == {str(table)}
    (log / f"{11:020d}.checkpoint.0f1e.parquet").write_bytes((log / f"{9:020d}.checkpoint.parquet").read_bytes())
    with pytest.raises(Exception, match="unsupported checkpoint"):
        logs.read_log_actions(spark, [str(table)]).collect()


# -- health --------------------------------------------------------------------


def codes(df):
    return sorted(r["code"] for r in df.collect())


TABLE_SCHEMA = """path string, is_delta boolean, num_files long, history_len long, size_bytes long,
    avg_file_bytes double, growth_pct double"""
BUCKET_SCHEMA = """bucket string, prefix string, total_bytes long, object_count long, growth_pct double,
    loose_bytes long, loose_pct double, loose_objects long, loose_samples array<string>,
    ephemeral_tables long, ephemeral_bytes long, temp_objects long, temp_bytes long"""


def test_alerts(spark):
    buckets = spark.createDataFrame(
        [("bronze", "", 200, 10, 55.0)],
        "bucket string, prefix string, total_bytes long, object_count long, growth_pct double",
    )
    tables = spark.createDataFrame(
        [
            ("s3a://bronze/projeto_a/tb", True, 6000, 500, 120_000_000, 20_000.0, 80.0),
            ("s3a://missing", False, None, None, None, None, 90.0),
        ],
        TABLE_SCHEMA,
    )
    alerts = health.evaluate_health(buckets, tables)
    assert codes(alerts) == ["bucket_growth", "not_delta", "small_files", "stale_log", "table_growth", "too_many_files"]
    first = health.in_order(alerts).first()
    assert (first["target"], first["severity"], first["observed"], first["limit"]) == ("s3a://bronze", "warn", 55.0, 40.0)
    assert first["message"] == "Bucket cresceu 55.0% (limiar 40%; 200 bytes, 10 objetos)"
    assert health.top_alerts(alerts, 2).count() == 2
    assert rows(health.alerts_by_code(alerts))[0] == ("bucket_growth", 1)


def test_no_alerts(spark):
    buckets = spark.createDataFrame([("bronze", "", 100, 1, 5.0, 0, 0.0, 0, [], 0, 0, 0, 0)], BUCKET_SCHEMA)
    tables = spark.createDataFrame([("s3a://b/t", True, 10, 5, 20_000_000, 2_000_000.0, 5.0)], TABLE_SCHEMA)
    assert health.evaluate_health(buckets, tables).isEmpty()


@pytest.mark.parametrize(
    "files, history, size, mean, expected",
    [
        (2, 10, 500_000, 250_000.0, []),
        (100, 50, 20_000_000, 200_000.0, []),
        (100, 50, 100_000_000, 200_000.0, ["small_files"]),
        (10, 500, 10_000_000, 1_000_000.0, ["stale_log"]),
        (10, 425, 10_000_000, 1_000_000.0, ["high_commit_rate"]),
        (10, 419, 10_000_000, 1_000_000.0, []),
        (4999, 10, 10_000_000_000, None, []),
        (5000, 10, 10_000_000_000, 2_000_000.0, ["too_many_files"]),
    ],
)
def test_table_rules(spark, files, history, size, mean, expected):
    tables = spark.createDataFrame([("t", True, files, history, size, mean, 0.0)], TABLE_SCHEMA)
    assert codes(health.evaluate_health(tables=tables)) == expected


def test_loose_and_ephemeral(spark):
    buckets = spark.createDataFrame(
        [("bronze", "", 10_000, 100, 0.0, 3_000, 30.0, 40, ["dump/a.csv", "dump/b.csv"], 2, 80_000, 2, 500),
         ("prata", "", 10_000, 100, None, 3_000, 3.0, 40, [], 0, 0, 0, 0)],
        BUCKET_SCHEMA,
    )
    roots = spark.createDataFrame(
        [("bronze", f"s3a://bronze/d/_meta/x/system=S/run_id=r{i}", True) for i in (1, 2)]
        + [("bronze", "s3a://bronze/t", False)],
        "bucket string, uri string, ephemeral boolean",
    )
    alerts = health.evaluate_health(buckets, roots=roots)
    assert codes(alerts) == [
        "ephemeral_delta_load", "ephemeral_delta_table", "ephemeral_delta_table", "loose_load_volume", "temp_load_volume",
    ]
    high = health.evaluate_health(buckets, None, {"max_ephemeral_delta_tables": 2, "max_loose_bytes_pct": 50}, roots=roots)
    assert codes(high) == ["temp_load_volume"]


def test_scan_errors(spark):
    errors = spark.createDataFrame([("bucket", "s3a://b", "x" * 400), ("table", "t", "no")], "kind string, target string, error string")
    alerts = health.evaluate_health(errors=errors)
    assert rows(alerts.select("code", F.length("message"))) == [("bucket_scan_error", 400), ("table_scan_error", 2)]


def test_health_scan_job(spark):
    objects = spark.createDataFrame(
        [("bronze", "a/t/_delta_log/0.json", 1), ("bronze", "a/t/f.parquet", 99), ("bronze", "dump.csv", 300)],
        "bucket string, key string, size long",
    )
    actions = spark.createDataFrame(
        [("s3a://bronze/a/t", 0, "add", "f.parquet", 99, None, None), ("s3a://bronze/a/t", 0, "commit", None, None, None, None)],
        logs.ACTION_SCHEMA,
    )
    before = spark.createDataFrame([("s3a://bronze", 100)], "target string, total_bytes long")
    listed = targets.listed_uris(spark, ["s3a://bronze/none"])
    scan = health_scan(objects, actions, listed=listed, previous_buckets=before)
    assert codes(scan.alerts) == ["bucket_growth", "loose_load_volume", "not_delta"]
    assert rows(scan.tables, "table", "num_files") == [("s3a://bronze/a/t", 1), ("s3a://bronze/none", 0)]
    assert rows(scan.buckets, "growth_pct", "loose_samples") == [(300.0, ["dump.csv"])]
    grown = growth_report(scan.buckets, scan.alerts)
    assert grown.summary.first().asDict() == {
        "bucket_count": 1, "total_bytes": 400, "total_objects": 3, "growth_warns": 1, "health_alert_count": 3,
    }
    assert ("s3a://bronze", "400 B · 3 objs · Δ +300.0%; loose=75.0% [acima do limiar]") in rows(grown.rows)


def test_targets(spark):
    assert targets.resolve_buckets() == ["bronze", "prata", "ouro"] == targets.resolve_buckets([" "])
    assert targets.resolve_buckets([" /x/ "]) == ["x"]
    listed = targets.listed_uris(spark, ["s3a://prata/x", " s3a://bronze/a ", "", "s3a://prata/x"])
    project = spark.createDataFrame([("s3a://bronze/a",), ("s3a://bronze/b",)], "uri string")
    found = spark.createDataFrame([("s3a://bronze/b",), ("s3a://ouro/z",)], "uri string")
    out = targets.resolve_targets(listed, project, found).orderBy("priority", "position", "uri")
    assert [tuple(r) for r in out.collect()] == [
        ("s3a://prata/x", 0, 0), ("s3a://bronze/a", 0, 1), ("s3a://bronze/b", 1, 0), ("s3a://ouro/z", 2, 0),
    ]
    assert rows(targets.resolve_targets(listed, project, found, uri_prefix="s3a://ouro"), "uri") == [("s3a://ouro/z",)]


# -- reports -------------------------------------------------------------------


def test_failures(spark, tmp_path):
    now = dt.datetime(2026, 1, 2, tzinfo=UTC)
    lines = [
        {"dag_id": "a", "dag_run_id": "m1", "run_type": "manual", "start_date": "2026-01-01T10:00:00Z", "state": "failed"},
        {"dag_id": "b", "dag_run_id": "s1", "run_type": "scheduled", "start_date": "2026-01-01T12:00:00Z",
         "end_date": "2026-01-01T13:00:00Z", "state": "failed"},
        {"dag_id": "c", "dag_run_id": "b1", "run_type": "backfill", "start_date": "2026-01-01T11:00:00Z", "state": "failed"},
        {"dag_id": "skip", "dag_run_id": "x", "run_type": "manual", "start_date": "2026-01-01T11:00:00Z", "state": "failed"},
        {"dag_id": "d", "dag_run_id": "old", "run_type": "manual", "start_date": "2025-12-31T23:00:00Z", "state": "failed"},
        {"dag_id": "e", "dag_run_id": "ok", "run_type": "manual", "start_date": "2026-01-01T11:00:00Z", "state": "success"},
    ]
    (tmp_path / "runs.json").write_text("\n".join(map(json.dumps, lines)))
    runs = snapshots.run_records(spark, str(tmp_path / "runs.json"))
    result = failures_report(runs, now, exclude=["skip"], max_rows=2)
    assert result.summary.first().asDict() == {"manual": 1, "agendado": 1, "outro": 1}
    assert rows(result.rows) == [
        (1, "Falha agendado · b", "run_id=s1 · fim=2026-01-01 13:00:00"),
        (2, "Falha backfill · c", "run_id=b1 · fim=2026-01-01 11:00:00"),
        (3, "Falhas (truncado)", "exibindo 2 de 3"),
    ]
    assert report.failure_rows(report.failed_runs(runs, now)).count() == 4


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshots.latest_snapshot(spark, path) is None
    for day, size in ((1, 10), (2, 20)):
        df = spark.createDataFrame([("s3a://b", size)], "target string, total_bytes long")
        snapshots.save_snapshot(df, path, dt.datetime(2026, 1, day, 6, tzinfo=UTC))
    assert rows(snapshots.latest_snapshot(spark, path), "total_bytes") == [(20,)]
    before = dt.datetime(2026, 1, 2, 6, tzinfo=UTC)
    assert rows(snapshots.latest_snapshot(spark, path, before), "total_bytes") == [(10,)]


# -- cursor --------------------------------------------------------------------


def test_cursor(spark):
    stamp = lambda h: dt.datetime(2026, 1, 1, h, tzinfo=UTC)
    runs = spark.createDataFrame(
        [
            (1, "p", "t", "success", stamp(9), stamp(10)),
            (2, "p", "t", "success", stamp(6), stamp(12)),   # finished later: the cursor moves back
            (3, "p", "t", "success", None, stamp(13)),
            (4, "p", "t", "failed", stamp(11), stamp(14)),
            (5, "p", "u", "failed", stamp(11), stamp(14)),
        ],
        "id long, project string, table_name string, status string, watermark_to timestamp, finished_at timestamp",
    )
    config = spark.createDataFrame(
        [("p", "t", True, " x"), ("p", "u", True, " "), ("p", "v", False, "y")],
        "project string, table_name string, enabled boolean, delta_bronze_path string",
    )
    now = dt.datetime(2026, 1, 2, 0)
    assert rows(cursor.cursor_windows(config, runs, now)) == [
        ("p", "t", dt.datetime(2026, 1, 1, 2, 50), now, False),
        ("p", "u", dt.datetime(2025, 12, 31, 23), now, True),
    ]
    assert rows(cursor.list_tables(config, "p")) == [("t", " x")]
    assert cursor.table_config(config, "t", "p").first()["delta_bronze_path"] == " x"
    with pytest.raises(ValueError, match="v"):
        cursor.table_config(config, "v")
    rows_in = spark.createDataFrame(
        [("p", "t", dt.datetime(2026, 1, 1, 2, 49)), ("p", "t", dt.datetime(2026, 1, 1, 3)), ("p", "v", now)],
        "project string, table_name string, ts timestamp_ntz",
    )
    assert window_filter(rows_in, "ts", cursor.cursor_windows(config, runs, now)).count() == 1


def test_max_ts(spark):
    stamps = [dt.datetime(2026, 1, 1, 8), dt.datetime(2026, 1, 2, 9), None]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    assert cursor.max_ts(df, "ts").first()[0] == stamps[1]
    assert cursor.max_ts(df.filter("ts is null"), "ts").first()[0] is None
    text = spark.createDataFrame([("junk",), ("31/12/2025 10:00:00",), ("2025-12-30",)], "ts string")
    assert cursor.max_ts(text, "ts").first()[0] == dt.datetime(2025, 12, 31, 10)


def test_incremental_load(spark, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    source = spark.createDataFrame(
        [(1, "a", dt.datetime(2026, 1, 1, 1)), (1, "b", dt.datetime(2026, 1, 1, 2)), (2, "c", dt.datetime(2025, 1, 1))],
        "k int, v string, ts timestamp_ntz",
    )
    kwargs = dict(project="p", table_name="t", keys=["k"], watermark_col="ts", run_log=log)
    at = lambda h: dt.datetime(2026, 1, 1, h, tzinfo=UTC)
    assert incremental_load(spark, source, table, now=at(12), **kwargs) == 1
    assert rows(open_table(spark, table), "k", "v") == [(1, "b")]
    more = source.union(spark.createDataFrame([(3, "d", dt.datetime(2026, 1, 1, 11))], source.schema))
    assert incremental_load(spark, more, table, now=at(15), **kwargs) == 2
    assert rows(open_table(spark, table), "k", "v") == [(1, "b"), (3, "d")]
    state = cursor.run_state(control.run_events(spark, log)).orderBy("started_at").collect()
    assert [(r["status"], r["rows_extracted"], r["rows_loaded"]) for r in state] == [("success", 2, 1), ("success", 2, 2)]
    # 02:00 in Sao Paulo is stored as 05:00 UTC; the second run read from ten minutes before
    assert state[1]["watermark_from"].astimezone(UTC) == dt.datetime(2026, 1, 1, 4, 50, tzinfo=UTC)
    with pytest.raises(Exception):
        incremental_load(spark, more, table, now=at(16), clean=lambda d: d.drop("k"), **kwargs)
    assert sorted(r["status"] for r in cursor.run_state(control.run_events(spark, log)).collect()) == ["failed", "success", "success"]


def test_run_arguments(spark, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(TypeError):
        control.open_run(spark, log, "t", from_ts=dt.datetime(2026, 1, 1), project="p")
    with pytest.raises(TypeError):
        control.open_run(spark, log, "t", wm_col="ts", project="p")
    control.open_run(spark, log, "t", wm_col="ts", from_ts=dt.datetime(2026, 1, 1), project="p")
    row = cursor.run_state(control.control_table(spark, "etl_log", path=log)).first()
    assert row["status"] == "running" and row["watermark_from"].astimezone(UTC).hour == 3


# -- maintenance ---------------------------------------------------------------


def test_orphans(spark):
    now = dt.datetime(2026, 1, 31, tzinfo=UTC)
    day = lambda d: dt.datetime(2026, 1, d, tzinfo=UTC)
    files = spark.createDataFrame(
        [("t", "live", 1, day(1)), ("t", "lost", 2, day(1)), ("t", "young", 4, day(30)),
         ("t", "removed_now", 8, day(1)), ("t", "removed_long_ago", 16, day(1))],
        "table string, path string, size long, last_modified timestamp",
    )
    live = spark.createDataFrame([("t", "live")], "table string, path string")
    removed = spark.createDataFrame(
        [("t", "removed_now", day(30)), ("t", "removed_long_ago", day(10))],
        "table string, path string, deletion_time timestamp",
    )
    plain = maintain.orphan_files(files, live, now, include_untracked=True)
    assert rows(plain, "path") == [("lost",), ("removed_long_ago",), ("removed_now",)]
    assert rows(maintain.orphan_counts(plain)) == [("t", 3, 26)]
    latest = live.select("table", "path", F.lit(True).alias("live"), F.lit(None).alias("deletion_time")).unionByName(
        removed.withColumn("live", F.lit(False))
    )
    aged = maintain.orphan_files(files, latest, now, include_untracked=True)
    assert rows(aged, "path") == [("lost",), ("removed_long_ago",)]
    assert aged.columns == files.columns
    strict = maintain.orphan_files(files, latest, now, include_untracked=False)
    assert rows(strict, "path") == [("removed_long_ago",)]


def test_expired_commits_and_tally(spark):
    now = dt.datetime(2026, 1, 31, tzinfo=UTC)
    old, new = dt.datetime(2025, 12, 1, tzinfo=UTC), dt.datetime(2026, 1, 30, 12, tzinfo=UTC)
    files = spark.createDataFrame(
        [("t", v, "commit", old if v < 5 else new) for v in range(8)] + [("t", 3, "checkpoint", old), ("u", 0, "commit", old)],
        "table string, version long, kind string, last_modified timestamp",
    )
    assert rows(maintain.expired_commits(files, now), "version") == [(0,), (1,), (2,)]
    late = files.filter("kind = 'commit'").unionByName(files.filter("kind = 'checkpoint'").withColumn("version", F.lit(7)))
    assert maintain.expired_commits(late, now, retention_days=0).count() == 5
    results = spark.createDataFrame([("a", 3, None), ("b", 4, ""), ("c", None, "x")], "uri string, removed long, error string")
    assert maintain.maintenance_tally(results).first().asDict() == {"ok": 2, "failures": 1, "removed": 7}


# -- streaming -----------------------------------------------------------------


def test_stream_of_several_batches(spark, tmp_path):
    schema = "k int, v int, ts timestamp_ntz"
    start = dt.datetime(2026, 1, 1)
    rng = random.Random(1)
    data = [(rng.randint(0, 20), i, start + dt.timedelta(minutes=i)) for i in range(200)]
    source = tmp_path / "in"
    for i in (2, 0, 3, 1):  # files in no order of time
        part = spark.createDataFrame(data[i * 50 : (i + 1) * 50], schema).coalesce(1)
        part.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    path = str(tmp_path / "t")
    query = incremental_upsert_stream(stream, path, keys=["k"], version="ts", checkpoint=str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.lastProgress["batchId"] == 3
    expected = {k: (k, v) for k, v, _ in data}
    assert rows(open_table(spark, path), "k", "v") == sorted(expected.values(), key=lambda r: (str(r[0]), str(r[1])))
    # nothing new: a restart from the checkpoint changes nothing
    incremental_upsert_stream(stream, path, keys=["k"], version="ts", checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert open_table(spark, path).count() == len(expected)


def test_stream_drops_overlap(spark, tmp_path):
    schema = "k int, ts timestamp_ntz"
    stamp = dt.datetime(2026, 1, 1)
    overwrite(spark.createDataFrame([(1, stamp), (1, stamp), (2, stamp)], schema), str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = drop_overlap(stream, ["k"], "ts", "10 minutes")
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scratch_dir_follows_the_session(spark):
    assert scratch_dir(spark, "x").startswith("/tmp/")
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://shared/folder"})
    assert scratch_dir(named, "x").startswith("hdfs://shared/folder/x-")
    cluster = SimpleNamespace(
        conf={}, sparkContext=SimpleNamespace(getConf=dict, master="yarn")
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(cluster, "x")
