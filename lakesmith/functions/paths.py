"""Object keys and table URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._column import ColumnOrName, as_column
from .text import strip

# Lower-case key parts of temporary objects.
TEMP_MARKERS = ("/_tmp/", "/tmp/", "/.trash/", "/_staging/", "/staging/", "/__pycache__/")

# Fixed value: the folder that makes its parent a table root.
LOG_FOLDER = "/_delta_log"


def _strip_slashes(value: Column) -> Column:
    return F.trim(value, F.lit("/"))


def delta_uri(path: ColumnOrName) -> Column:
    return F.regexp_replace(strip(path), "^s3a://", "s3://")


def uri_from_parts(bucket: ColumnOrName, prefix: ColumnOrName | None = None) -> Column:
    """``s3a://bucket/prefix``, or ``s3a://bucket`` without a prefix."""
    name = _strip_slashes(strip(bucket))
    folder = _strip_slashes(strip(F.lit("") if prefix is None else prefix))
    return F.concat_ws("/", F.concat(F.lit("s3a://"), name), F.nullif(folder, F.lit("")))


bucket_key = uri_from_parts


def bucket_from_uri(uri: ColumnOrName) -> Column:
    rest = F.regexp_replace(strip(uri), "^.*?://", "")
    return strip(F.substring_index(rest, "/", 1))


def has_log_folder(key: ColumnOrName) -> Column:
    return F.contains(_padded(as_column(key)), F.lit(LOG_FOLDER))


def folder_of_log(key: ColumnOrName) -> Column:
    """What precedes the first log folder of a key; the whole key when it has none."""
    return F.ltrim(F.substring_index(_padded(as_column(key)), LOG_FOLDER, 1), F.lit("/"))


def _padded(key: Column) -> Column:
    return F.concat(F.lit("/"), F.ltrim(F.coalesce(key, F.lit("")), F.lit("/")))


def delta_uri_from_object_key(bucket: ColumnOrName, key: ColumnOrName) -> Column:
    """URI of the table whose log holds the key (up to the first log folder), else null."""
    return F.when(has_log_folder(key), table_uri(bucket, folder_of_log(key)))


def table_uri(bucket: ColumnOrName, folder: ColumnOrName) -> Column:
    """URI of a folder exactly as it is spelled in the key."""
    base = F.concat(F.lit("s3a://"), _strip_slashes(strip(bucket)))
    return F.concat_ws("/", base, F.nullif(as_column(folder), F.lit("")))


def uri_to_root_prefix(uri: ColumnOrName, bucket: ColumnOrName) -> Column:
    """Key prefix of a table inside its bucket; empty when the bucket is the table."""
    uri = as_column(uri)
    base = F.concat(F.lit("s3a://"), _strip_slashes(strip(bucket)))
    inside = F.substr(uri, F.length(base) + 2)
    other = F.regexp_replace(F.regexp_replace(uri, "^.*?://", ""), "^[^/]*/", "")
    return _strip_slashes(
        F.when(F.startswith(uri, F.concat(base, F.lit("/"))), inside)
        .when(F.rtrim(uri, F.lit("/")) == base, "")
        .otherwise(other)
    )


def is_ephemeral_delta_uri(uri: ColumnOrName) -> Column:
    """A table written once per run, or nested below ``_meta`` per system."""
    return is_ephemeral_path(F.regexp_replace(as_column(uri), "^.*?://", ""))


def is_ephemeral_path(path: ColumnOrName) -> Column:
    """The same for a path that starts with the bucket."""
    path = F.lower(as_column(path))
    return F.contains(path, F.lit("run_id=")) | (
        F.contains(path, F.lit("/_meta/")) & F.contains(path, F.lit("system="))
    )


def is_temp_object_key(key: ColumnOrName) -> Column:
    padded = F.concat(F.lit("/"), F.ltrim(F.lower(as_column(key)), F.lit("/")))
    found = F.lit(False)
    for marker in TEMP_MARKERS:
        found = found | F.contains(padded, F.lit(marker))
    return found


def parent_folder(key: ColumnOrName) -> Column:
    """The part of a key before its last slash, empty at the top."""
    key = as_column(key)
    name = F.substring_index(key, "/", -1)
    return F.substr(key, F.lit(1), F.char_length(key) - F.char_length(name) - 1)


def path_prefixes(path: ColumnOrName) -> Column:
    """``a/b/c`` to ``['', 'a', 'a/b', 'a/b/c']``: as long as the path is deep."""
    parts = F.split(as_column(path), "/")
    whole = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.array_union(F.array(F.lit("")), whole)
