"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

from lakesmith.queries import REGISTERED

from .conftest import SMALL

DATA = os.environ.get("CHECK_SF_DIR", SMALL)
RUN = {name: run for name, (run, _) in REGISTERED.items()}
CHECK = {name: check for name, (_, check) in REGISTERED.items()}
TABLES = ("region nation customer supplier part orders lineitem events documents").split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, database, name):
    got = RUN[name](spark, DATA)
    expected = database.execute(CHECK[name])
    columns = [c[0] for c in expected.description]
    assert sorted(got.columns) == sorted(columns)
    theirs = {c[0]: _TYPES.get(str(c[1]), str(c[1])) for c in expected.description}
    assert {f.name: f.dataType.simpleString() for f in got.schema} == theirs
    mine, checked = _rows(got.columns, got.collect()), _rows(columns, expected.fetchall())
    assert len(mine) == len(checked)
    different = [(a, b) for a, b in zip(mine, checked) if a != b]
    assert not different, different[:3]
    assert mine, "the query has no rows to compare"


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_query_has_a_check():
    assert RUN.keys() == CHECK.keys()
