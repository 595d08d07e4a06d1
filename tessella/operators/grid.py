"""Operators on points and grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table


def cell(x: Column, size: float, origin: float = 0.0) -> Column:
    """Index of the half-open cell [origin + i * size, origin + (i + 1) * size) that holds x."""
    return F.floor((x - F.lit(origin)) / F.lit(size)).cast("long")


def grid_stat(points: DataFrame, x: str, y: str, value: Column, size_x: float, size_y: float) -> DataFrame:
    """Count, mean and largest value of each cell; rows without a position or value do not count."""
    there = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & value.isNotNull())
    return there.groupBy(cell(F.col(x), size_x).alias("ix"), cell(F.col(y), size_y).alias("iy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("top")
    )


@query("a01_grid_stat", """
SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS ix, CAST(floor(l_extendedprice / 10000.0) AS BIGINT) AS iy,
       count(*) AS n, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS mean_tax, max(CAST(round(l_tax * 100) AS BIGINT)) AS top_tax
FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_tax IS NOT NULL
GROUP BY 1, 2
""")
def a01_grid_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of tax (in hundredths) by cell of quantity and price."""
    points = table(spark, sf_dir, "lineitem")
    cells = grid_stat(points, "l_quantity", "l_extendedprice", F.round(F.col("l_tax") * 100).cast("long"), 5.0, 10000.0)
    return cells.select("ix", "iy", "n", (F.col("total") / F.col("n")).alias("mean_tax"), F.col("top").alias("top_tax"))
