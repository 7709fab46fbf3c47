from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def duck_rows(con, sql: str) -> list[tuple]:
    names = sorted(con.sql(sql).columns)
    return sorted(con.sql("SELECT " + ", ".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall(), key=str)


def assert_alike(a: list[tuple], b: list[tuple]) -> None:
    """Rows of a query and of its SQL."""
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, (int, float)) for v in y) else [str(v) for v in x] == [str(v) for v in y]


def grid_of(spark, array):
    """A cell table of a nested list; None is nodata."""
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(array) for c, v in enumerate(row)], "r long, c int, z double")


def array_of(df, value: str):
    pdf = df.toPandas()
    return pdf.pivot(index="r", columns="c", values=value).to_numpy(dtype=float)
