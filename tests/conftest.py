from __future__ import annotations

import pytest

from checks.compare import duck
from trialbraid.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        4,
        **{
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.fixture
def evaluate(spark):
    """Values of one SQL expression over a text column ``c``."""

    def run(expression: str, values: list):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
        rows = df.selectExpr("i", f"{expression} AS out").orderBy("i").collect()
        return [r.out for r in rows]

    return run


@pytest.fixture
def registry(spark):
    """A raw registry from a few partial rows; absent cells are NULL."""
    from trialbraid.schema import INGEST_POS, RAW_COLUMNS

    def make(*rows: dict):
        schema = f"{INGEST_POS} bigint, " + ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
        data = [(i, *[row.get(c) for c in RAW_COLUMNS]) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return make
