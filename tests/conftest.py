import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from lakesmith.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "lakesmith-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.driver.host": "127.0.0.1",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over rows of literals: ``values(schema, rows, expr)``."""

    def run(schema, rows, *exprs):
        # The key keeps the input order without relying on partition order.
        numbered = [(i, *row) for i, row in enumerate(rows)]
        df = spark.createDataFrame(numbered, f"row_no int, {schema}")
        out = df.select("row_no", *[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
        out.sort(key=lambda r: r[0])
        return [r[1] if len(exprs) == 1 else tuple(r[1:]) for r in out]

    return run
