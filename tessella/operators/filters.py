"""Filters: multi-label routing, boxes, polygons, partial dates, free text, admissibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from .projections import tagged_events


def routed(df: DataFrame, layers: dict[str, Column], name: str = "layer") -> DataFrame:
    """A row for each layer whose predicate holds; a row can go to several, or none."""
    labels = F.array(*[F.when(p, F.lit(layer)) for layer, p in layers.items()])
    return df.withColumn(name, F.explode(F.filter(labels, lambda x: x.isNotNull())))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float], margin: float = 0.0, half_open: bool = False) -> Column:
    """Closed box, widened by margin; half_open leaves out the upper edges."""
    x0, y0, x1, y1 = box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin
    upper = (x < x1) & (y < y1) if half_open else (x <= x1) & (y <= y1)
    return (x >= x0) & (y >= y0) & upper


def in_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings, holes included; rings are closed implicitly."""
    crossings = F.lit(0)
    for ring in rings:
        for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ya != yb:
                spans = (F.lit(ya) > y) != (F.lit(yb) > y)
                at = F.lit(xb - xa) * (y - ya) / F.lit(yb - ya) + xa
                crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def whole_date(text: Column) -> Column:
    """A date that may lack day or month: their middle stands in."""
    return F.to_date(F.when(F.length(text) == 4, F.concat(text, F.lit("-07-01"))).when(F.length(text) == 7, F.concat(text, F.lit("-15"))).otherwise(F.substring(text, 1, 10)))


@query("w01_route_layers", """
SELECT layer, event_id FROM (
  SELECT event_id, unnest(list_filter([
      CASE WHEN event_type IN ('click', 'view') THEN 'traffic' END, CASE WHEN value > 100 THEN 'large' END,
      CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'fault' END, CASE WHEN k % 3 = 0 THEN 'left' END], lambda x: x IS NOT NULL)) AS layer
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
""")
def route_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = {
        "traffic": F.col("tags")["kind"].isin("click", "view"),
        "large": F.col("value") > 100,
        "fault": (F.col("tags")["kind"] == "error") & (F.col("k") % 2 == 0),
        "left": F.map_contains_key("tags", "lane:left"),
    }
    return routed(tagged_events(spark, sf_dir), layers).select("layer", "event_id")


@query("w02_key_prefix", """
SELECT event_id FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
WHERE (k % 3 = 0 AND k::VARCHAR NOT IN ('0', '3')) OR (k % 2 = 0 AND (k * 10)::VARCHAR NOT IN ('0', '3'))
""")
def key_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some key lane* with one colon at most whose value is not in a list."""
    found = F.exists(
        F.map_entries("tags"),
        lambda e: e["key"].startswith("lane") & (F.length(e["key"]) - F.length(F.regexp_replace(e["key"], ":", "")) <= 1) & ~e["value"].isin("0", "3"),
    )
    return tagged_events(spark, sf_dir).filter(found).select("event_id")


@query("w03_boxes", """
SELECT l_orderkey, l_linenumber, l_quantity >= 9 AND l_quantity <= 31 AND l_extendedprice >= 9999 AND l_extendedprice <= 50001 AS closed,
       l_quantity >= 10 AND l_quantity < 30 AND l_extendedprice >= 10000 AND l_extendedprice < 50000 AS half_open
FROM lineitem WHERE l_quantity >= 9 AND l_quantity <= 31 AND l_extendedprice >= 9999 AND l_extendedprice <= 50001
""")
def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, box = F.col("l_quantity"), F.col("l_extendedprice"), (10.0, 10000.0, 30.0, 50000.0)
    closed = in_box(x, y, box, margin=1.0)
    return table(spark, sf_dir, "lineitem").filter(closed).select("l_orderkey", "l_linenumber", closed.alias("closed"), in_box(x, y, box, half_open=True).alias("half_open"))


@query("w04_clip_segments", """
SELECT c_custkey, greatest(c_acctbal - 800, 1000.0) AS x0, least(c_acctbal + 800, 5000.0) AS x1 FROM customer
WHERE c_acctbal BETWEEN 1000.0 AND 5000.0 AND c_nationkey BETWEEN 5 AND 15
""")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 800 to either side whose middle lies in a box, cut to it."""
    x = F.col("c_acctbal")
    inside = table(spark, sf_dir, "customer").filter(in_box(x, F.col("c_nationkey"), (1000.0, 5, 5000.0, 15)))
    return inside.select("c_custkey", F.greatest(x - 800, F.lit(1000.0)).alias("x0"), F.least(x + 800, F.lit(5000.0)).alias("x1"))


@query("w05_numbers_in_text", r"""
SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS decimals, regexp_matches(text, '(?i)licen[sc]e') AS named FROM documents
WHERE len(regexp_extract_all(text, '[0-9]+\.[0-9]+')) > 0 OR regexp_matches(text, '(?i)licen[sc]e')
""")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).cast("long")
    named = F.col("text").rlike("(?i)licen[sc]e")
    return table(spark, sf_dir, "documents").filter((n > 0) | named).select("doc_id", n.alias("decimals"), named.alias("named"))


@query("w06_radius_since", """
SELECT event_id FROM events WHERE (value - 100) * (value - 100) <= 2500 AND strftime(ts, '%Y-%m-%d') >= '2024-01-15'
""")
def radius_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("value") - 100
    return table(spark, sf_dir, "events").filter((d * d <= 2500) & (F.date_format("ts", "yyyy-MM-dd") >= "2024-01-15")).select("event_id")


@query("w07_in_polygon", """
WITH e(xa, ya, xb, yb) AS (VALUES (5.0, 5000.0, 45.0, 20000.0), (45.0, 20000.0, 25.0, 90000.0), (25.0, 90000.0, 5.0, 5000.0),
                                  (20.0, 20000.0, 30.0, 30000.0), (30.0, 30000.0, 22.0, 40000.0), (22.0, 40000.0, 20.0, 20000.0))
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (SELECT count(*) FROM e WHERE ((ya > l_extendedprice) <> (yb > l_extendedprice)) AND l_quantity < (xb - xa) * (l_extendedprice - ya) / (yb - ya) + xa) % 2 = 1
""")
def inside_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rings = [[(5.0, 5000.0), (45.0, 20000.0), (25.0, 90000.0)], [(20.0, 20000.0), (30.0, 30000.0), (22.0, 40000.0)]]
    return table(spark, sf_dir, "lineitem").filter(in_polygon(F.col("l_quantity"), F.col("l_extendedprice"), rings)).select("l_orderkey", "l_linenumber")


@query("w08_exclude_classes", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber NOT IN (3, 7) AND l_returnflag = 'N'")
def exclude_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(~F.col("l_linenumber").isin(3, 7) & (F.col("l_returnflag") == "N")).select("l_orderkey", "l_linenumber")


@query("w09_partial_dates", """
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS said FROM orders)
SELECT o_orderkey, said, CAST(CASE length(said) WHEN 4 THEN said || '-07-01' WHEN 7 THEN said || '-15' ELSE said END AS DATE) AS day
FROM d WHERE CAST(CASE length(said) WHEN 4 THEN said || '-07-01' WHEN 7 THEN said || '-15' ELSE said END AS DATE) BETWEEN DATE '1996-03-10' AND DATE '1998-02-01'
""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    said = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).withColumn("day", whole_date(F.col("said")))
    return rows.filter(F.col("day").between(F.lit("1996-03-10").cast("date"), F.lit("1998-02-01").cast("date")))


@query("w10_extract_from_text", r"""
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page,
       CASE WHEN regexp_matches(url, '/(fr|de|es)/') THEN 'local' ELSE 'other' END AS kind
FROM pages
""")
def extract_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "[?&]page=([0-9]+)", 1).alias("page"),
        F.when(url.rlike("/(fr|de|es)/"), "local").otherwise("other").alias("kind"),
    )


@query("w11_admissible_sources", """
WITH m(event_type, state, w) AS (VALUES ('click', 0, 10), ('click', 1, 4), ('view', 0, 7), ('purchase', 1, 9), ('error', 0, 0), ('signup', 1, 0))
SELECT e.event_id, m.w AS weight FROM events e JOIN m ON e.event_type = m.event_type AND e.user_id % 2 = m.state WHERE m.w > 0
""")
def admissible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a source in a zone's state, from a fixed matrix; weight 0 rejects."""
    matrix = spark.createDataFrame([("click", 0, 10), ("click", 1, 4), ("view", 0, 7), ("purchase", 1, 9), ("error", 0, 0), ("signup", 1, 0)], "event_type string, state long, weight int")
    e = table(spark, sf_dir, "events").withColumn("state", F.col("user_id") % 2)
    return e.join(F.broadcast(matrix.filter("weight > 0")), ["event_type", "state"]).select("event_id", "weight")
