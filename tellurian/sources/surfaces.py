"""Deterministic rasters, clouds and boxes over the test tables.

Each surface has a Spark form and, in ``SQL``, the same definition as a DuckDB
common table expression, so that both engines start from equal numbers.  A cell
table is (r BIGINT, c INT, z DOUBLE), complete over its grid, nodata = NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of cells; the cast comes before the product, as in DuckDB."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "v")).select("r", "c", (F.col("v").cast("double") * 100).alias("z"))


def dem_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value by week and customer class, NULL where there was none."""
    o = table(spark, sf_dir, "orders")
    keys = o.select(
        F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7).alias("r"),
        F.pmod("o_custkey", F.lit(64)).cast("int").alias("c"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    cells = keys.groupBy("r", "c").agg((F.sum("cents") / F.count("cents") / 1e5).alias("z"))
    rows = keys.agg(F.max("r").alias("last")).select(F.explode(F.sequence(F.lit(0), "last")).alias("r"))
    grid = rows.select("r", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c"))
    return grid.join(cells, ["r", "c"], "left").select(F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), "z")


def dem_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dem_dense`` after digging and filling by a rule on (r, c)."""
    change = F.when((F.col("r") + F.col("c")) % 7 == 0, 2.5).when((F.col("r") * 3 + F.col("c")) % 11 == 0, -1.75).otherwise(((F.col("r") + F.col("c")) % 5 - 2) * 0.125)
    return dem_dense(spark, sf_dir).select("r", "c", F.when((F.col("r") + 2 * F.col("c")) % 53 == 0, None).otherwise(F.col("z") + change).alias("z"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bands (r, c, b4, b3, b2) on a grid half as fine as ``dem_dense``, from vector pairs."""
    d = dem_dense(spark, sf_dir).select(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c"), (F.col("r") % 2 * 2 + F.col("c") % 2).alias("k"), "z")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("z")))
    return d.groupBy("r", "c").agg(part(0).alias("b4"), part(1).alias("b3"), part(2).alias("b2"))


def spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bands (r, c, b2, b3, b4, b8, b11, b12) on the grid of ``bands``, two of them mixed from others."""
    d = dem_dense(spark, sf_dir).select(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c"), (F.col("r") % 2 * 2 + F.col("c") % 2).alias("k"), "z")
    b = d.groupBy("r", "c").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(n) for k, n in enumerate(("b4", "b3", "b2", "b8"))])
    return b.withColumns({"b11": (F.col("b4") + F.col("b8")) / 2, "b12": (F.col("b3") - F.col("b2")) / 2})


def band_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surface on the grid of the bands."""
    return bands(spark, sf_dir).select("r", "c", F.col("b4").alias("z"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (id, x, y, z) on a 48 x 48 field, with canopy and stray points, from events."""
    e = table(spark, sf_dir, "events")
    hash_x, hash_y = F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 104729, F.lit(48000)), F.pmod(F.col("event_id") * 15485863 + F.col("user_id") * 32452843, F.lit(48000))
    x, y = hash_x / 1000.0, hash_y / 1000.0
    ground = 100 + 0.1 * x + 0.05 * y
    z = F.when(F.pmod("event_id", F.lit(997)) == 0, ground + 60).when(F.pmod("event_id", F.lit(4)) == 0, ground + 3 + F.pmod("user_id", F.lit(5))).otherwise(ground + F.round(F.col("value") * 100) / 1e6)
    return e.select(F.col("event_id").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections (id, x1, y1, x2, y2, confidence, class_id) in a 200 x 200 field, from parts."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x, y = F.pmod(k * 7919, F.lit(2000)) / 10.0, F.pmod(k * 104729, F.lit(2000)) / 10.0
    conf = F.pmod(k * 611953, F.lit(9973)) / 9973.0
    return p.select(k.alias("id"), x.alias("x1"), y.alias("y1"), (x + 4 + F.col("p_size") % 9).alias("x2"), (y + 4 + F.col("p_size") % 7).alias("y2"), conf.alias("confidence"), F.pmod(k, F.lit(3)).cast("int").alias("class_id"))


def label_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes 0 (background), 1, 2 and a confidence by bins of ``dem_dense``."""
    z = F.col("z")
    label = F.when(z > 8, 1).when(z < -8, 2).otherwise(0)
    return dem_dense(spark, sf_dir).select("r", "c", label.alias("label"), F.round(F.least(F.abs(z) / 50, F.lit(1.0)), 4).alias("confidence"))


#: The same definitions for DuckDB, by name; each is the body of one CTE.
SQL = {
    "dem": "SELECT vec_id AS r, (generate_subscripts(embedding, 1) - 1)::INT AS c, unnest(embedding)::DOUBLE * 100 AS z FROM embeddings",
    "sparse_cells": """SELECT date_diff('day', DATE '1995-01-01', o_orderdate::DATE) // 7 AS r, (o_custkey % 64)::INT AS c,
        sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / count(*) / 1e5 AS z FROM orders GROUP BY ALL""",
    "sparse": """SELECT g.r, g.c, s.z FROM (SELECT r.range AS r, c.range::INT AS c FROM range((SELECT max(r) + 1 FROM sparse_cells)) r, range(64) c) g
        LEFT JOIN sparse_cells s ON s.r = g.r AND s.c = g.c""",
    "dem_new": """SELECT r, c, CASE WHEN (r + 2 * c) % 53 = 0 THEN NULL ELSE z + CASE WHEN (r + c) % 7 = 0 THEN 2.5::DOUBLE
        WHEN (r * 3 + c) % 11 = 0 THEN -1.75::DOUBLE ELSE ((r + c) % 5 - 2) * 0.125::DOUBLE END END AS z FROM dem""",
    "bands": """SELECT r // 2 AS r, (c // 2)::INT AS c, max(z) FILTER (r % 2 = 0 AND c % 2 = 0) AS b4, max(z) FILTER (r % 2 = 0 AND c % 2 = 1) AS b3,
        max(z) FILTER (r % 2 = 1 AND c % 2 = 0) AS b2 FROM dem GROUP BY r // 2, c // 2""",
    "spectral": """SELECT *, (b4 + b8) / 2 AS b11, (b3 - b2) / 2 AS b12 FROM (SELECT r // 2 AS r, (c // 2)::INT AS c, max(z) FILTER (r % 2 = 0 AND c % 2 = 0) AS b4,
        max(z) FILTER (r % 2 = 0 AND c % 2 = 1) AS b3, max(z) FILTER (r % 2 = 1 AND c % 2 = 0) AS b2, max(z) FILTER (r % 2 = 1 AND c % 2 = 1) AS b8 FROM dem GROUP BY r // 2, c // 2)""",
    "band_dem": "SELECT r, c, b4 AS z FROM bands",
    "cloud": """SELECT id, x, y, CASE WHEN id % 997 = 0 THEN ground + 60 WHEN id % 4 = 0 THEN ground + 3 + user_id % 5
        ELSE ground + round(value * 100) / 1e6 END AS z FROM (SELECT *, 100 + 0.1::DOUBLE * x + 0.05::DOUBLE * y AS ground FROM (
        SELECT event_id AS id, user_id, value, ((event_id * 7919 + user_id * 104729) % 48000)::DOUBLE / 1000.0::DOUBLE AS x,
        ((event_id * 15485863 + user_id * 32452843) % 48000)::DOUBLE / 1000.0::DOUBLE AS y FROM events))""",
    "boxes": """SELECT id, x1, y1, x1 + 4 + s % 9 AS x2, y1 + 4 + s % 7 AS y2, confidence, class_id FROM (
        SELECT p_partkey AS id, ((p_partkey * 7919) % 2000)::DOUBLE / 10.0::DOUBLE AS x1, ((p_partkey * 104729) % 2000)::DOUBLE / 10.0::DOUBLE AS y1, p_size AS s,
        ((p_partkey * 611953) % 9973)::DOUBLE / 9973.0::DOUBLE AS confidence, (p_partkey % 3)::INT AS class_id FROM part)""",
    "labels_at": """SELECT r, c, CASE WHEN z > 8 THEN 1 WHEN z < -8 THEN 2 ELSE 0 END AS label, round(least(abs(z) / 50, 1.0::DOUBLE), 4) AS confidence FROM dem""",
}


def ctes(*names: str) -> str:
    """``WITH name AS (...), ...`` for these surfaces and what they build on."""
    needs = {"sparse": ("sparse_cells",), "dem_new": ("dem",), "bands": ("dem",), "labels_at": ("dem",), "spectral": ("dem",), "band_dem": ("dem", "bands")}
    order: list[str] = []
    for n in names:
        for m in (*needs.get(n, ()), n):
            if m not in order:
                order.append(m)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order)
