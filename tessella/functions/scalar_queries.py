"""Queries that apply the scalar functions to the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table
from . import laws, lines, scalar


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places: longitude 5 to 6, latitude 45 to 46 degrees, by key and balance."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", (5.0 + F.col("c_nationkey") / 25.0).alias("lon"), (45.0 + F.col("c_custkey") % 1000 / 1000.0).alias("lat"))


PLACES = "p AS (SELECT c_custkey, 5.0 + c_nationkey::DOUBLE / 25.0 AS lon, 45.0 + (c_custkey % 1000)::DOUBLE / 1000.0 AS lat FROM customer)"


@query("f01_lambert93", f"""
WITH {PLACES}, k AS (SELECT 0.0818191910428158 AS e, 0.7256077650532670 AS n, 11754255.4260960 AS c, 12655612.0498760 AS ys),
q AS (SELECT p.*, k.*, ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2)) AS iso FROM p, k)
SELECT c_custkey, CAST(round(700000 + c * exp(-n * iso) * sin(n * radians(lon - 3))) AS BIGINT) AS x, CAST(round(ys - c * exp(-n * iso) * cos(n * radians(lon - 3))) AS BIGINT) AS y FROM q
""")
def lambert93_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = scalar.lambert93(F.col("lon"), F.col("lat"))
    return places(spark, sf_dir).select("c_custkey", F.round(x).cast("long").alias("x"), F.round(y).cast("long").alias("y"))


@query("f02_haversine", f"""
WITH {PLACES} SELECT c_custkey, CAST(round(2 * 6371008.8 * asin(least(sqrt(pow(sin(radians(45.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(45.5)) * pow(sin(radians(5.5 - lon) / 2), 2)), 1.0)) * 100) AS BIGINT) AS cm FROM p
""")
def haversine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scalar.haversine(F.col("lat"), F.col("lon"), F.lit(45.5), F.lit(5.5))
    return places(spark, sf_dir).select("c_custkey", F.round(d * 100).cast("long").alias("cm"))


@query("f03_turned_frame", """
SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) - 25) * 6 + (l_linenumber - 4) * 8 AS u, (l_linenumber - 4) * 6 - (CAST(l_quantity AS BIGINT) - 25) * 8 AS v FROM lineitem
""")
def turned_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local axes turned by the angle with cosine 0.6 and sine 0.8, in tenths."""
    x, y = F.col("l_quantity").cast("long") - 25, F.col("l_linenumber") - 4
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (x * 6 + y * 8).alias("u"), (y * 6 - x * 8).alias("v"))


@query("f04_angle_gap", """
SELECT l_orderkey, l_linenumber, abs((((l_partkey % 360 - l_suppkey * 7 % 360 + 180) % 360 + 360) % 360) - 180) AS gap, abs((((l_partkey % 180 - l_suppkey * 7 % 180 + 90) % 180 + 180) % 180) - 90) AS line_gap FROM lineitem
""")
def angle_gap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def gap(period: int) -> Column:
        return scalar.angle_gap(F.col("l_partkey") % period, F.col("l_suppkey") * 7 % period, float(period)).cast("long")

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gap(360).alias("gap"), gap(180).alias("line_gap"))


@query("f05_ring_area", """
WITH v AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CAST(l_quantity AS BIGINT) AS x, l_partkey % 100 AS y FROM lineitem)
SELECT a.k, CAST(sum(a.x * b.y - b.x * a.y) AS BIGINT) AS area2, sum(a.x * b.y - b.x * a.y) > 0 AS left_turning FROM v a JOIN v b ON a.k = b.k AND b.i = a.i % a.n + 1 GROUP BY a.k
""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("x"), (F.col("l_partkey") % 100).alias("y"))
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(p)).alias("p"))
    area = scalar.signed_area2(F.col("p"))
    return r.select("k", area.alias("area2"), (area > 0).alias("left_turning"))


@query("f06_resample", """
WITH b AS (SELECT user_id, max(CAST(floor(value) AS BIGINT)) AS n FROM events GROUP BY 1) SELECT user_id, unnest(range(0, n + 1, 50)) AS s FROM b
""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abscissas every 50 along each line."""
    b = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.floor("value")).alias("n"))
    return b.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"), F.lit(50).cast("long"))).alias("s"))


def _per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 % 1000).alias("x"), F.col("value").alias("y"), "event_id")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "x", "y"))).alias("p"))


def _lines(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    @F.pandas_udf("struct<n:long,first_x:double,last_y:double>")
    def apply(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [f(list(zip(x, y, strict=True))) for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame([(len(r), r[0][0], r[-1][1]) for r in rows], columns=["n", "first_x", "last_y"])

    return _per_user(spark, sf_dir).select("user_id", apply(F.col("p.x"), F.col("p.y")).alias("r")).select("user_id", "r.*")


@query("f07_simplify", None)
def simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, lambda p: lines.simplified(p, 25.0))


@query("f09_convex_hull", None)
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, lines.hull)


@query("f06b_offset_line", None)
def offset_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, lambda p: lines.offset(p, 1.5))


@query("f08_clip_segments", """
WITH s AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS ax, (o_custkey % 100)::DOUBLE AS ay, (o_custkey % 90)::DOUBLE AS bx, (o_orderkey % 70)::DOUBLE AS by_ FROM orders),
t AS (SELECT *, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN 20 AND 60 THEN 0.0 ELSE 2.0 END ELSE least((20 - ax) / (bx - ax), (60 - ax) / (bx - ax)) END AS ex,
  CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN 20 AND 60 THEN 1.0 ELSE -1.0 END ELSE greatest((20 - ax) / (bx - ax), (60 - ax) / (bx - ax)) END AS lx,
  CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN 10 AND 50 THEN 0.0 ELSE 2.0 END ELSE least((10 - ay) / (by_ - ay), (50 - ay) / (by_ - ay)) END AS ey,
  CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN 10 AND 50 THEN 1.0 ELSE -1.0 END ELSE greatest((10 - ay) / (by_ - ay), (50 - ay) / (by_ - ay)) END AS ly FROM s)
SELECT o_orderkey, CAST(floor(greatest(0.0, ex, ey) * 1000000) AS BIGINT) AS t0, CAST(floor(least(1.0, lx, ly) * 1000000) AS BIGINT) AS t1 FROM t WHERE greatest(0.0, ex, ey) <= least(1.0, lx, ly)
""")
def clip_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    ends = [(x).cast("double") for x in (o % 100, c % 100, c % 90, o % 70)]
    t0, t1 = scalar.clip_segment(*ends, (20.0, 10.0, 60.0, 50.0))
    out = table(spark, sf_dir, "orders").select("o_orderkey", t0.alias("a"), t1.alias("b")).filter("a IS NOT NULL")
    return out.select("o_orderkey", F.floor(F.col("a") * 1000000).alias("t0"), F.floor(F.col("b") * 1000000).alias("t1"))


@query("f10_bilinear_sample", """
WITH g AS (SELECT (n_nationkey % 5)::BIGINT AS i, (n_nationkey // 5)::BIGINT AS j, (n_nationkey * 7 % 25)::DOUBLE AS z FROM nation),
p AS (SELECT c_custkey, (c_custkey % 16) / 4.0 AS x, (c_custkey % 13 % 8) / 2.0 AS y FROM customer),
q AS (SELECT *, least(floor(x), 3)::BIGINT AS i, least(floor(y), 3)::BIGINT AS j FROM p)
SELECT c_custkey, CAST(floor(sum(g.z * CASE WHEN g.i = q.i THEN 1 - (x - q.i) ELSE x - q.i END * CASE WHEN g.j = q.j THEN 1 - (y - q.j) ELSE y - q.j END) * 1000) AS BIGINT) AS z1000
FROM q JOIN g ON g.i BETWEEN q.i AND q.i + 1 AND g.j BETWEEN q.j AND q.j + 1 GROUP BY c_custkey
""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's value between four cells. The weights are multiples of 1/8: sums are exact."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    g = table(spark, sf_dir, "nation").select((n % 5).cast("long").alias("gi"), F.expr("n_nationkey div 5").alias("gj"), (n * 7 % 25).cast("double").alias("z"))
    q = table(spark, sf_dir, "customer").select("c_custkey", ((c % 16) / 4.0).alias("x"), ((c % 13 % 8) / 2.0).alias("y"))
    q = q.withColumns({"i": F.least(F.floor("x"), F.lit(3)), "j": F.least(F.floor("y"), F.lit(3))})
    corners = F.array(*[F.struct((F.col("i") + a).alias("gi"), (F.col("j") + b).alias("gj"), ((F.col("x") - F.col("i")) if a else 1 - (F.col("x") - F.col("i"))).alias("wx"), ((F.col("y") - F.col("j")) if b else 1 - (F.col("y") - F.col("j"))).alias("wy")) for a in (0, 1) for b in (0, 1)])
    met = q.select("c_custkey", F.explode(corners).alias("k")).select("c_custkey", "k.*").join(g, ["gi", "gj"])
    return met.groupBy("c_custkey").agg(F.floor(F.sum(F.col("z") * F.col("wx") * F.col("wy")) * 1000).alias("z1000"))


@query("f11_normalise_text", r"""
SELECT doc_id, trim(regexp_replace(translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\s+', ' ', 'g')) AS plain FROM documents
""")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small letters without accents, blanks collapsed, of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", scalar.normalised(F.col("text")).alias("plain"))


@query("f12_value_range", """
WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ',5 m' WHEN 1 THEN p_size || '-' || (p_size + 2) WHEN 2 THEN '<' || p_size ELSE 'unknown' END AS said FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(replace(replace(said, ' m', ''), ',', '.') AS DOUBLE) WHEN 1 THEN CAST(split_part(said, '-', 1) AS DOUBLE) WHEN 2 THEN 0.0 END AS lo,
       CASE p_partkey % 4 WHEN 0 THEN CAST(replace(replace(said, ' m', ''), ',', '.') AS DOUBLE) WHEN 1 THEN CAST(split_part(said, '-', 2) AS DOUBLE) WHEN 2 THEN CAST(replace(said, '<', '') AS DOUBLE) END AS hi FROM t
""")
def value_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(size, F.lit(",5 m"))).when(k == 1, F.concat(size, F.lit("-"), (F.col("p_size") + 2).cast("string"))).when(k == 2, F.concat(F.lit("<"), size)).otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.value_range(said).alias("r")).select("p_partkey", "r.lo", "r.hi")


@query("f13_sign_codes", """
WITH t AS (SELECT p_partkey, 'B' || p_size AS c1, (p_size * 2)::VARCHAR AS v1, 'M9v' || (p_partkey % 5) AS c2 FROM part) SELECT p_partkey, c1 AS code, v1 AS amount FROM t UNION ALL SELECT p_partkey, c2, '' FROM t
""")
def sign_codes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("FR:B"), F.col("p_size").cast("string"), F.lit("["), (F.col("p_size") * 2).cast("string"), F.lit("],M9v"), (F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(scalar.sign_codes(said)).alias("s")).select("p_partkey", "s.code", F.col("s.value").alias("amount"))


@query("f14_periods", """
WITH p(label, a, b) AS (VALUES ('before', DATE '1900-01-01', DATE '1996-01-01'), ('works', DATE '1996-01-01', DATE '1998-07-01'), ('after', DATE '1998-07-01', DATE '2100-01-01'))
SELECT p.label, date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n FROM orders JOIN p ON o_orderdate::DATE >= p.a AND o_orderdate::DATE < p.b GROUP BY 1, 2
""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    label = F.when(d < F.lit("1996-01-01").cast("date"), "before").when(d < F.lit("1998-07-01").cast("date"), "works").otherwise("after")
    return table(spark, sf_dir, "orders").filter(d.isNotNull()).groupBy(label.alias("label"), F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("f15_sun_elevation", """
WITH d AS (SELECT event_id, epoch_us(ts) // 1000000 / 86400.0 - 10957.5 AS d FROM events),
g AS (SELECT *, radians((357.529 + 0.98560028 * d) % 360.0) AS g, (280.459 + 0.98564736 * d) % 360.0 AS q, radians(23.439 - 0.00000036 * d) AS tilt FROM d),
e AS (SELECT *, radians(q + 1.915 * sin(g) + 0.020 * sin(2 * g)) AS l FROM g),
r AS (SELECT *, degrees(atan2(cos(tilt) * sin(l), cos(l))) AS ra, asin(sin(tilt) * sin(l)) AS decl FROM e)
SELECT event_id, CAST(round(degrees(asin(sin(radians(45.2)) * sin(decl) + cos(radians(45.2)) * cos(decl) * cos(radians((280.46061837 + 360.98564736629 * d + 5.8) % 360.0 - ra)))) * 100) AS BIGINT) AS hundredths FROM r
""")
def sun_elevation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scalar.sun_elevation(F.col("ts"), F.lit(5.8), F.lit(45.2))
    return table(spark, sf_dir, "events").select("event_id", F.round(e * 100).cast("long").alias("hundredths"))


@query("f16_law_quantiles", None)
def law_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a truncated lognormal law at each part's rank."""
    @F.pandas_udf("double")
    def at(p: pd.Series) -> pd.Series:
        return pd.Series(laws.truncated("lognormal", {"mean": 1.5, "std": 0.5}, p.to_numpy(), 0.5, 4.0))

    p = (F.col("p_partkey") % 1000 + 0.5) / 1000
    return table(spark, sf_dir, "part").select("p_partkey", at(p).alias("q"))


@query("f17_following_model", """
WITH v AS (SELECT event_id, event_id % 30 + 1.0 AS v, 5.0 + event_id % 50 AS gap, event_id % 7 - 3.0 AS dv FROM events)
SELECT event_id, CAST(round(1.5 * (1 - pow(v / 15.0, 4) - pow((2.0 + greatest(0.0, v * 1.5 + v * dv / (2 * sqrt(1.5 * 2.0)))) / gap, 2)) * 10000) AS BIGINT) AS acc,
       CAST(round(CASE WHEN dv > 0 THEN dv * dv / (2 * gap) ELSE 0 END * 10000) AS BIGINT) AS need FROM v
""")
def following_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    v, gap, dv = i % 30 + 1.0, 5.0 + i % 50, i % 7 - 3.0
    a = scalar.following_acceleration(v, gap, dv, F.lit(15.0), F.lit(1.5))
    return table(spark, sf_dir, "events").select("event_id", F.round(a * 10000).cast("long").alias("acc"), F.round(scalar.needed_deceleration(dv, gap) * 10000).cast("long").alias("need"))


@query("f18_braking_distance", "SELECT event_id, CAST(round(((event_id % 30) * 1.0 + (event_id % 30) * (event_id % 30) / (2 * (4.5 + 9.81 * 0.02))) * 10000) AS BIGINT) AS d FROM events")
def braking_distance_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scalar.braking_distance((F.col("event_id") % 30).cast("double"), 4.5, 1.0, 0.02)
    return table(spark, sf_dir, "events").select("event_id", F.round(d * 10000).cast("long").alias("d"))


@query("f19_maps_and_arrays", """
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS flags, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(l_linenumber) FILTER (WHERE l_linenumber > 3) AS BIGINT) AS late FROM lineitem GROUP BY l_orderkey
""")
def maps_and_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"), F.collect_list("l_suppkey").alias("s"), F.collect_list("l_linenumber").alias("n"))
    late = F.filter("n", lambda x: x > 3)
    total = F.when(F.size(late) > 0, F.aggregate(late, F.lit(0).cast("long"), lambda a, x: a + x))
    return g.select("l_orderkey", F.array_join(F.array_sort(F.array_distinct("f")), "").alias("flags"), F.size(F.array_distinct("s")).cast("long").alias("suppliers"), total.alias("late"))


@query("f20_json_key", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.get_json_object("props", "$.k").cast("long") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("f21_hashes", "SELECT page_id, sha256(html) AS sha FROM pages")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha"))


@query("f22_tiles", """
WITH b AS (SELECT s_suppkey, 100 + s_suppkey % 400 AS length FROM supplier),
o AS (SELECT s_suppkey, length, unnest(range(0, greatest(length - 64, 0) + 64, 64)) AS origin FROM b)
SELECT DISTINCT s_suppkey, least(origin, length - 64) AS origin FROM o
""")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile origins every 64, the last pulled back to the edge."""
    b = table(spark, sf_dir, "supplier").select("s_suppkey", (100 + F.col("s_suppkey") % 400).alias("length"))
    o = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(64).cast("long")), lambda x: F.least(x, F.col("length") - 64)))
    return b.select("s_suppkey", F.explode(o).alias("origin"))


@query("f23_panorama_pixel", """
WITH p AS (SELECT event_id, event_id % 21 - 10.0 AS x, event_id % 13 - 6.5 AS y, event_id % 7 - 3.0 AS z FROM events)
SELECT event_id, CAST(round((degrees(atan2(x, y)) / 360 + 0.5) * 8192 * 100) AS BIGINT) AS u, CAST(round((0.5 - degrees(atan2(z, sqrt(x * x + y * y))) / 180) * 4096 * 100) AS BIGINT) AS v FROM p
""")
def panorama_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions in an equirectangular image of 8192 by 4096, in hundredths of a pixel."""
    i = F.col("event_id")
    x, y, z = i % 21 - 10.0, i % 13 - 6.5, i % 7 - 3.0
    u = (F.degrees(F.atan2(x, y)) / 360 + 0.5) * 8192
    v = (0.5 - F.degrees(F.atan2(z, F.sqrt(x * x + y * y))) / 180) * 4096
    return table(spark, sf_dir, "events").select("event_id", F.round(u * 100).cast("long").alias("u"), F.round(v * 100).cast("long").alias("v"))
