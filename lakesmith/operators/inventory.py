"""Roll-up of an object inventory ``(bucket, key, size)``.

Which table or target an object belongs to is an ordered lookup: all that a folder
holds lies between two places in the order of keys, so the last such place
before an object tells (see ``ordered``). Objects are sorted in ranges, not dealt by folder.

The operators accept the ``roots`` found by :func:`table_roots`. Pass them as a
written table (``materialize``): they are then computed once, and Catalyst sees
their size, so it broadcasts a short list and does not shuffle the inventory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .ordered import as_of, cut_points

# Fixed value: loose keys shown per bucket.
SAMPLE_KEYS = 8


def table_roots(objects: DataFrame) -> DataFrame:
    """Tables found in the inventory: ``(bucket, uri, root, ephemeral)``.

    A key below a log folder makes that folder's parent a table root.
    """
    folders = (
        objects.filter(F.col("bucket").isNotNull() & paths.has_log_folder("key"))
        .select("bucket", paths.folder_of_log("key").alias("folder"))
        .distinct()
    )
    return folders.select(
        "bucket",
        paths.table_uri("bucket", "folder").alias("uri"),
        F.trim("folder", F.lit("/")).alias("root"),
        paths.is_ephemeral_path(F.concat("bucket", F.lit("/"), "folder")).alias("ephemeral"),
    )


def _root_flags(roots: DataFrame) -> DataFrame:
    """Roots made unique: two URIs may differ by a slash only."""
    return roots.groupBy("bucket", "root").agg(F.max("ephemeral").alias("ephemeral"))


def _place(bucket: Column, path: Column) -> Column:
    """Where a path lies among those of all buckets: first the bucket, then the path, byte by byte."""
    return F.concat(bucket, F.lit("\0"), path)


def _inside(folder: Column) -> Column:
    """The place, within a bucket, that what lies in a folder follows."""
    return F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))


def _key() -> Column:
    return F.ltrim("key", F.lit("/"))


def _borders(marks: DataFrame, exact: bool) -> DataFrame:
    """Places where what is below a marked folder ``(bucket, path)`` begins and ends.

    ``(place, bucket, scope, holder)``: from a place on, up to the next one, an object
    is below those marked folders that hold ``holder`` or are it. All that a
    folder ``p`` holds lies between ``p/`` and ``p0``, the next sign. With ``exact``
    the object named ``p`` gets a place of its own: it belongs to the table ``p``
    (``scope``), but lies in the folder above (``holder``).
    """
    path, above = F.col("path"), paths.parent_folder("path")
    end = F.lit(None).cast("string")
    at = lambda place, scope, holder: F.struct(place.alias("at"), scope.alias("scope"), holder.alias("holder"))
    around = [at(F.concat(path, F.lit("/")), path, path), at(F.concat(path, F.lit("0")), above, above)]
    if exact:
        around += [at(path, path, above), at(F.concat(path, F.lit("\0")), above, above)]
    inner = marks.filter("path <> ''").select("bucket", F.explode(F.array(*around)).alias("b"))
    inner = inner.select(_place(F.col("bucket"), F.col("b.at")).alias("place"), "bucket", "b.scope", "b.holder")
    top = F.lit("")
    whole = marks.filter("path = ''").select("bucket").distinct()
    begin = whole.select(_place(F.col("bucket"), top).alias("place"), "bucket", top.alias("scope"), top.alias("holder"))
    behind = whole.select(F.concat("bucket", F.lit("\1")).alias("place"), "bucket", end.alias("scope"), end.alias("holder"))
    return inner.unionByName(begin).unionByName(behind)


def _borders_at(marks: DataFrame, cuts: list[str]) -> DataFrame:
    """The same where ranges are cut, at places of objects."""
    rows = []
    for place in cuts:
        bucket, path = place.split("\0", 1)
        folder = path.rpartition("/")[0]
        rows.append((place, bucket, folder, folder))
    return marks.sparkSession.createDataFrame(rows, "place string, bucket string, scope string, holder string")


def _flag_events(roots: DataFrame, cuts: list[str]) -> DataFrame:
    """Places with the flags that objects from there on have. Only places are exploded, never objects.

    A path has as many prefixes as it is deep.
    """
    borders = _borders(roots.select("bucket", F.col("root").alias("path")), exact=True)
    borders = borders.unionByName(_borders_at(roots, cuts)).withColumn("root", F.explode_outer(paths.path_prefixes("scope")))
    found = borders.join(roots, ["bucket", "root"], "left").groupBy("place").agg(F.max("ephemeral").alias("e"))
    flags = F.struct(F.col("e").isNotNull().alias("under_table"), F.coalesce("e", F.lit(False)).alias("under_ephemeral"))
    return found.select("place", flags.alias("flags"))


def _in_temp_folder(folder: Column) -> Column:
    """The marks of temporary objects end with a slash, so the folder decides."""
    return paths.is_temp_object_key(F.concat(folder, F.lit("/")))


def _flagged(rows: DataFrame, roots: DataFrame, cuts: list[str]) -> DataFrame:
    """Rows with a place and the flags ``under_table`` and ``under_ephemeral``."""
    seen = as_of(rows, _flag_events(roots, cuts), cuts, "place", "flags")
    names = ("under_table", "under_ephemeral")
    flags = {n: F.coalesce(F.col(f"flags.{n}"), F.lit(False)) for n in names}
    return seen.withColumns(flags).drop("flags", "place")


def classify_objects(objects: DataFrame, roots: DataFrame | None = None, range_rows: int | None = None) -> DataFrame:
    """Each object with ``under_table, under_ephemeral, temp``.

    Objects and the borders of all tables are sorted by bucket and key, and each
    object takes the flags of the last border before it.
    """
    roots = _root_flags(table_roots(objects) if roots is None else roots)
    rows = objects.withColumn("key", _key()).withColumn("place", _place(F.col("bucket"), F.col("key")))
    out = _flagged(rows, roots, cut_points(rows, "place", range_rows))
    return out.withColumn("temp", _in_temp_folder(paths.parent_folder("key")))


def _folder() -> Column:
    return F.coalesce(paths.parent_folder(_key()), F.lit(""))


def _by_folder(objects: DataFrame) -> DataFrame:
    """Counts and bytes per folder; few rows per map task."""
    size = F.coalesce("size", F.lit(0)).cast("long")
    sums = [F.count(F.lit(1)).alias("objects"), F.sum(size).alias("bytes")]
    per_folder = objects.groupBy("bucket", _folder().alias("folder")).agg(*sums)
    return per_folder.withColumn("place", _place(F.col("bucket"), _inside(F.col("folder"))))


def _folder_cuts(objects: DataFrame, range_rows: int | None) -> list[str]:
    """Cuts between folders, by a sample of objects: the sums per folder need not be made for it."""
    return cut_points(objects.select(_place(F.col("bucket"), _inside(_folder())).alias("place")), "place", range_rows)


def _moved_roots(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects named exactly like a root, taken out of their folder and put to the root's own place.

    They belong to the table, their folder may not. There are as many as roots at most for each bucket.
    """
    size = F.coalesce("size", F.lit(0)).cast("long")
    named = objects.select("bucket", _key().alias("root"), size.alias("bytes")).join(
        roots.select("bucket", "root"), ["bucket", "root"]
    )
    folder = paths.parent_folder("root")
    out = named.select(
        "bucket", folder.alias("folder"), F.lit(-1).cast("long").alias("objects"), (-F.col("bytes")).alias("bytes"),
        _place(F.col("bucket"), _inside(folder)).alias("place"),
    )
    back = named.select(
        "bucket", folder.alias("folder"), F.lit(1).cast("long").alias("objects"), "bytes",
        _place(F.col("bucket"), F.col("root")).alias("place"),
    )
    return out.unionByName(back)


def _usage_sums() -> list[Column]:
    inside, ephemeral, temp = F.col("under_table"), F.col("under_ephemeral"), F.col("temp")

    def total(column: str, when: Column | None = None) -> Column:
        return F.sum(F.col(column) if when is None else F.when(when, F.col(column)).otherwise(0))

    return [
        total("objects").alias("object_count"),
        total("bytes").alias("total_bytes"),
        total("bytes", inside).alias("delta_bytes"),
        total("bytes", ~inside).alias("loose_bytes"),
        total("objects", ~inside).alias("loose_objects"),
        total("bytes", ephemeral).alias("ephemeral_bytes"),
        total("bytes", temp).alias("temp_bytes"),
        total("objects", temp).alias("temp_objects"),
    ]


def _with_tables(usage: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    share = F.col("loose_bytes") / F.col("total_bytes") * 100.0
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("delta_tables", "ephemeral_tables")]
    return usage.join(tables, keys, "left").select(
        *usage.columns, F.when(F.col("total_bytes") > 0, share).otherwise(0.0).alias("loose_pct"), *counts
    )


def _table_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("delta_tables"), F.count_if("ephemeral").alias("ephemeral_tables")
    )


def bucket_usage(objects: DataFrame, roots: DataFrame | None = None, range_rows: int | None = None) -> DataFrame:
    """One row per bucket: objects and bytes in total, in tables, loose, temporary, ephemeral.

    Table and ephemeral URIs are counted here and listed by :func:`table_roots`:
    a bucket may hold any number of them. Objects are summed per folder first.
    """
    found = table_roots(objects) if roots is None else roots
    flags = _root_flags(found)
    rows = _by_folder(objects).unionByName(_moved_roots(objects, flags))
    folders = _flagged(rows, flags, _folder_cuts(objects, range_rows)).withColumn("temp", _in_temp_folder(F.col("folder")))
    return _with_tables(folders.groupBy("bucket").agg(*_usage_sums()), _table_counts(found, ["bucket"]), ["bucket"])


def _visible_roots(objects: DataFrame, targets: DataFrame) -> DataFrame:
    """Tables that a target's own objects show, ``(bucket, target, root, uri, ephemeral)``: those with log objects in it."""
    logs = (
        objects.filter(F.col("bucket").isNotNull() & paths.has_log_folder("key"))
        .select("bucket", paths.folder_of_log("key").alias("folder"), paths.parent_folder(_key()).alias("scope"))
        .distinct()
    )
    held = logs.withColumn("target", F.explode(paths.path_prefixes("scope"))).join(targets, ["bucket", "target"])
    return held.select(
        "bucket",
        "target",
        F.trim("folder", F.lit("/")).alias("root"),
        paths.table_uri("bucket", "folder").alias("uri"),
        paths.is_ephemeral_path(F.concat("bucket", F.lit("/"), "folder")).alias("ephemeral"),
    ).distinct()


def prefix_usage(objects: DataFrame, targets: DataFrame, range_rows: int | None = None) -> DataFrame:
    """One row per target ``(bucket, prefix)``: the numbers of :func:`bucket_usage` for what the target holds.

    Targets may lie within each other; an object counts for each that holds it.
    What a target shows is all that counts for it: a table whose log lies
    outside does not make its objects part of a table there. The places where
    targets and tables begin and end split all folders into segments, each with
    one set of targets and tables. Folders are summed per segment, and segments per target.
    """
    named = targets.select(
        F.trim(F.trim("bucket"), F.lit("/")).alias("bucket"),
        F.trim(F.trim(F.coalesce("prefix", F.lit(""))), F.lit("/")).alias("target"),
    ).distinct()
    visible = _visible_roots(objects, named)
    flags = visible.groupBy("bucket", "target", "root").agg(F.max("ephemeral").alias("ephemeral"))
    roots = flags.select("bucket", "root").distinct()
    rows = _by_folder(objects).unionByName(_moved_roots(objects, roots))
    cuts = _folder_cuts(objects, range_rows)
    borders = _borders(roots.withColumnRenamed("root", "path"), exact=True)
    borders = borders.unionByName(_borders(named.withColumnRenamed("target", "path"), exact=False))
    # Where several meet at one place, the deeper folder has the longer, greater name.
    events = borders.unionByName(_borders_at(roots, cuts)).groupBy("place").agg(
        F.struct(F.max("scope").alias("scope"), F.max("holder").alias("holder")).alias("segment")
    )
    seen = as_of(rows, events, cuts, "place", "segment").withColumn("temp", _in_temp_folder(F.col("folder")))
    segment = ["bucket", "scope", "holder", "temp"]
    summed = seen.select("bucket", "segment.*", "temp", "objects", "bytes").groupBy(*segment)
    summed = summed.agg(F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"))
    held = summed.withColumn("target", F.explode(paths.path_prefixes("holder"))).join(named, ["bucket", "target"])
    each = held.withColumn("root", F.explode_outer(paths.path_prefixes("scope")))
    judged = each.join(flags, ["bucket", "target", "root"], "left").groupBy("target", *segment).agg(
        F.first("objects").alias("objects"), F.first("bytes").alias("bytes"), F.max("ephemeral").alias("e")
    )
    judged = judged.withColumn("under_table", F.col("e").isNotNull())
    judged = judged.withColumn("under_ephemeral", F.coalesce("e", F.lit(False)))
    sums = judged.groupBy("bucket", "target").agg(*_usage_sums())
    usage = named.join(sums, ["bucket", "target"], "left").fillna(0)
    counts = _table_counts(visible, ["bucket", "target"])
    return _with_tables(usage, counts, ["bucket", "target"]).withColumnRenamed("target", "prefix")


def loose_samples(
    objects: DataFrame, roots: DataFrame | None = None, n: int = SAMPLE_KEYS, range_rows: int | None = None
) -> DataFrame:
    """The first ``n`` keys per bucket that belong to no table: ``(bucket, sample_no, key)``.

    Only loose objects are ranked, and those before the shuffle by bucket as
    well: a task sends at most ``n`` keys per bucket.
    """
    flags = _root_flags(table_roots(objects) if roots is None else roots)
    rows = objects.select("bucket", _key().alias("key"), _place(F.col("bucket"), _key()).alias("place"))
    loose = _flagged(rows, flags, cut_points(rows, "place", range_rows)).filter(~F.col("under_table"))
    bucket = Window.partitionBy("bucket").orderBy("key")
    ranked = loose.withColumn("sample_no", F.row_number().over(bucket)).filter(F.col("sample_no") <= n)
    return ranked.select("bucket", "sample_no", "key")


def with_samples(usage: DataFrame, samples: DataFrame) -> DataFrame:
    """Usage rows with their sample keys in one array of at most a few entries."""
    lists = samples.groupBy("bucket").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sample_no", "key"))), lambda s: s["key"]
        ).alias("loose_samples")
    )
    return usage.join(lists, "bucket", "left").withColumn(
        "loose_samples", F.coalesce("loose_samples", F.array().cast("array<string>"))
    )
