"""Projections: nested rows made flat, fallbacks, side-specific tags, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import hundredths, query, table


def first_filled(*values: Column, missing: tuple[str, ...] = ("", "nan", "None")) -> Column:
    """The first value that is neither null nor one of the texts that stand for missing."""
    return F.coalesce(*[F.when(~F.trim(v).isin(*missing), v) for v in values])


def number(v: Column) -> Column:
    """A text as a number, comma or point; null where it is none."""
    return F.regexp_replace(F.trim(v), ",", ".").try_cast("double")


def side_tag(tags: Column, key: str, side: str) -> Column:
    """key:side, else key:both, else key."""
    return F.coalesce(F.try_element_at(tags, F.lit(f"{key}:{side}")), F.try_element_at(tags, F.lit(f"{key}:both")), F.try_element_at(tags, F.lit(key)))


def reversed_tags(tags: Column) -> Column:
    """The tags of a way that is turned round: left and right, forward and backward change places in the keys."""
    def swap(key: Column) -> Column:
        out = key
        for a, b in (("left", "right"), ("forward", "backward")):
            out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, rf"(^|:){a}(?=:|$)", "$1\u0001"), rf"(^|:){b}(?=:|$)", f"$1{a}"), "\u0001", b)
        return out

    return F.transform_keys(tags, lambda k, v: swap(k))


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tagged features: a map of tags made of the event's columns."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    tags = F.map_from_arrays(
        F.array(F.lit("kind"), F.lit("lane:left"), F.lit("lane:both"), F.lit("user")),
        F.array(F.col("event_type"), F.when(k % 3 == 0, k.cast("string")), F.when(k % 2 == 0, (k * 10).cast("string")), F.col("user_id").cast("string")),
    )
    return e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.map_filter(tags, lambda a, b: b.isNotNull()).alias("tags"))


@query("p01_flatten_nested", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
       coalesce(json_extract_string(props, '$.title'), event_type || '/' || json_extract_string(props, '$.k')) AS title,
       CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 AS high, array_to_string(list_sort(list_distinct([event_type, 'event', 'error'])), ',') AS kinds
FROM events
""")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    title = F.coalesce(F.get_json_object("props", "$.title"), F.concat_ws("/", "event_type", k))
    return table(spark, sf_dir, "events").select(
        "event_id", k.cast("long").alias("k"), "event_type", title.alias("title"), (k.cast("long") >= 50).alias("high"),
        F.array_join(F.array_sort(F.array_distinct(F.array("event_type", F.lit("event"), F.lit("error")))), ",").alias("kinds"),
    )


@query("p02_computed_offsets", """
SELECT s_suppkey, floor(s_acctbal * 100)::BIGINT - 500000 AS dx, (s_nationkey - 12)::BIGINT AS dy,
       (floor(s_acctbal * 100)::BIGINT - 500000) * (floor(s_acctbal * 100)::BIGINT - 500000) + (s_nationkey - 12) * (s_nationkey - 12) AS d2
FROM supplier WHERE abs(floor(s_acctbal * 100)::BIGINT - 500000) <= 300000
""")
def computed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    s = s.withColumns({"dx": hundredths("s_acctbal") - 500000, "dy": (F.col("s_nationkey") - 12).cast("long")})
    return s.filter(F.abs("dx") <= 300000).select("s_suppkey", "dx", "dy", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2"))


@query("p03_prune_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def prune_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by list and by suffix."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select([c for c in rows.columns if c in ("l_quantity",) or c.endswith("key")])


@query("p04_first_filled", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand ELSE 'none' END AS label,
       TRY_CAST(replace(CASE WHEN p_size % 2 = 0 THEN p_size || ',5' ELSE 'about ' || p_size END, ',', '.') AS DOUBLE) AS width
FROM part
""")
def first_filled_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    label = first_filled(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(""), F.when(F.col("p_size") % 3 == 1, F.col("p_brand")).otherwise("nan"), F.lit("none"))
    size = F.col("p_size").cast("string")
    return p.select("p_partkey", label.alias("label"), number(F.when(F.col("p_size") % 2 == 0, F.concat(size, F.lit(",5"))).otherwise(F.concat(F.lit("about "), size))).alias("width"))


@query("p05_dotted_path", "SELECT event_id, json_extract_string(props, '$.k') AS found, json_extract_string(props, '$.k.deeper') AS missing FROM events")
def dotted_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("found"), F.get_json_object("props", "$.k.deeper").alias("missing"))


@query("p06_side_tag", """
SELECT event_id, coalesce(CASE WHEN k % 3 = 0 THEN k::VARCHAR END, CASE WHEN k % 2 = 0 THEN (k * 10)::VARCHAR END) AS on_left,
       CASE WHEN k % 2 = 0 THEN (k * 10)::VARCHAR END AS on_right
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def side_tag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_events(spark, sf_dir).select("event_id", side_tag(F.col("tags"), "lane", "left").alias("on_left"), side_tag(F.col("tags"), "lane", "right").alias("on_right"))


@query("p07_reversed_tags", """
SELECT event_id, array_to_string(list_sort(list_filter(['kind', 'user', CASE WHEN k % 3 = 0 THEN 'lane:right' END, CASE WHEN k % 2 = 0 THEN 'lane:both' END], lambda x: x IS NOT NULL)), ',') AS keys
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def reversed_tags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(reversed_tags(F.col("tags")))), ",").alias("keys"))


@query("p08_classify", """
SELECT l_shipmode_class, count(*) AS n FROM (
  SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 AND l_returnflag = 'R' THEN 'returned' WHEN l_quantity < 30 THEN 'middle' ELSE 'other' END AS l_shipmode_class
  FROM lineitem) GROUP BY 1
""")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    kind = F.when(q < 10, "small").when((q < 30) & (F.col("l_returnflag") == "R"), "returned").when(q < 30, "middle").otherwise("other")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("l_shipmode_class")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_round_nested", """
SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1000) AS BIGINT)), ',') AS thousandths, label AS kind FROM embeddings
""")
def round_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside arrays rounded, and a column renamed."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("string")), ",").alias("thousandths"), F.col("label").alias("kind")
    )
