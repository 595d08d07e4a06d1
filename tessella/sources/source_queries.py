"""Queries on grids of tiles, tile picks and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import hundredths, query, table
from . import sinks


@query("s11_tile_grid", """
SELECT s_suppkey, unnest(range(CAST(floor(s_acctbal / 500) AS BIGINT), CAST(floor(s_acctbal / 500) AS BIGINT) + 1 + s_nationkey % 3)) AS tx, s_nationkey % 3 + 1 AS tiles FROM supplier
""")
def tile_grid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned tiles of each request."""
    t = F.floor(F.col("s_acctbal") / 500)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(t, t + F.col("s_nationkey") % 3)).alias("tx"), (F.col("s_nationkey") % 3 + 1).alias("tiles"))


@query("s13_point_scan", "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_extendedprice >= 20000 AND l_extendedprice < 40000")
def point_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open box pushed to the scan; two columns besides are read."""
    box = "l_quantity >= 10 AND l_quantity < 20 AND l_extendedprice >= 20000 AND l_extendedprice < 40000"
    return table(spark, sf_dir, "lineitem").filter(box).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query("s14_pick_tiles", """
WITH t AS (SELECT p_partkey, p_size AS x0, p_size + 10 AS x1, p_partkey % 50 AS y0, p_partkey % 50 + 10 AS y1 FROM part)
SELECT p_partkey, (least(x1, 30) - greatest(x0, 20)) * (least(y1, 35) - greatest(y0, 15)) AS overlap FROM t
WHERE least(x1, 30) > greatest(x0, 20) AND least(y1, 35) > greatest(y0, 15) AND (least(x1, 30) - greatest(x0, 20)) * (least(y1, 35) - greatest(y0, 15)) >= 25
""")
def pick_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that overlap the area of interest enough."""
    w = F.least(F.col("p_size") + 10, F.lit(30)) - F.greatest(F.col("p_size"), F.lit(20))
    y = F.col("p_partkey") % 50
    h = F.least(y + 10, F.lit(35)) - F.greatest(y, F.lit(15))
    return table(spark, sf_dir, "part").filter((w > 0) & (h > 0) & (w * h >= 25)).select("p_partkey", (w * h).alias("overlap"))


@query("s16_pruned_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2")
def pruned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("s17_unpivot_years", """
WITH y AS (SELECT o_custkey, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS y1996, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS y1997 FROM orders GROUP BY 1)
SELECT o_custkey, 1996 AS year, y1996 AS n FROM y UNION ALL SELECT o_custkey, 1997, y1997 FROM y
""")
def unpivot_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide years made rows."""
    y = F.year("o_orderdate")
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(y == 1996).alias("1996"), F.count_if(y == 1997).alias("1997"))
    return wide.unpivot("o_custkey", ["1996", "1997"], "year", "n").select("o_custkey", F.col("year").cast("int").alias("year"), "n")


@query("s18_sql_text", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query given as text, over named tables."""
    text = "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name"
    return spark.sql(text, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


@query("k02_deterministic_lines", """
SELECT '{"type":"Feature","id":"' || s_suppkey || '","geometry":{"type":"Point","coordinates":[' || CAST(floor(s_acctbal * 100) AS BIGINT) || ',' || s_nationkey || ']},"properties":{"s_name":"' || s_name || '"}}' AS value FROM supplier
""")
def deterministic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("x", hundredths("s_acctbal"))
    return sinks.geojson_lines(s, "s_suppkey", "x", "s_nationkey", ["s_name"], 0)


@query("k05_upsert", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0
""")
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return sinks.upserted(c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 3 = 0").withColumn("segment", F.lit("new")), ["c_custkey"])


@query("k07_manifest", None)
def manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.manifest(table(spark, sf_dir, "part"), "p_brand", ["p_partkey", "p_name", "p_size"])
