"""Distance, band and nearest-neighbour joins on a grid.

A pair within distance r lies in the same or in adjacent cells of size r, so the right side is
copied to the 3 (1-D) or 9 (2-D) cells around each row and joined on equal cells; the exact distance
is tested after. The join is an equi-join: it is hashed or sorted, and adaptive execution splits crowded cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import hundredths, query, table
from .grid import cell


def near_pairs(left: DataFrame, right: DataFrame, xy_left: list[str], xy_right: list[str], r: float, metric=None) -> DataFrame:
    """All pairs of rows within r (inclusive), with d2, the squared distance. Column names must differ."""
    for k, (a, b) in enumerate(zip(xy_left, xy_right, strict=True)):
        left = left.withColumn(f"_c{k}", cell(F.col(a), r))
        right = right.withColumn(f"_c{k}", F.explode(F.array(*[cell(F.col(b), r) + s for s in (-1, 0, 1)])))
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(xy_left, xy_right, strict=True)), F.lit(0))
    keys = [f"_c{k}" for k in range(len(xy_left))]
    return left.join(right, keys).withColumn("d2", d2).filter(F.col("d2") <= r * r).drop(*keys)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, xy_left: list[str], xy_right: list[str], r: float) -> DataFrame:
    """left_id and its nearest right_id within r; equal distances go to the smaller id. Rows without one are left out."""
    found = near_pairs(left, right, xy_left, xy_right, r)
    return found.groupBy(left_id).agg(F.min(F.struct("d2", right_id)).alias("_m")).select(left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.d2").alias("d2"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hundredths("c_acctbal").alias("cx"), (F.col("c_nationkey") * 1000).cast("long").alias("cy"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", hundredths("s_acctbal").alias("sx"), (F.col("s_nationkey") * 1000).cast("long").alias("sy"))


POINTS = """
c AS (SELECT c_custkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS cx, CAST(c_nationkey * 1000 AS BIGINT) AS cy FROM customer),
s AS (SELECT s_suppkey, CAST(floor(s_acctbal * 100) AS BIGINT) AS sx, CAST(s_nationkey * 1000 AS BIGINT) AS sy FROM supplier),
p AS (SELECT *, (cx - sx) * (cx - sx) + (cy - sy) * (cy - sy) AS d2 FROM c JOIN s ON abs(cx - sx) <= 20000 AND abs(cy - sy) <= 20000)
"""


@query("j04_nearest", f"""
WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS k FROM p WHERE d2 <= 4000000)
SELECT c_custkey, s_suppkey, d2 FROM r WHERE k = 1
""")
def nearest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", ["cx", "cy"], ["sx", "sy"], 2000.0)


@query("j05_map_match", f"""
WITH {POINTS}, q AS (SELECT *, d2 + 500000 * (((c_custkey - s_suppkey) % 3 + 3) % 3) AS score FROM p WHERE d2 <= 9000000),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score, s_suppkey) AS k FROM q)
SELECT c_custkey, s_suppkey, score FROM r WHERE k = 1
""")
def map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate within reach of the best penalised score."""
    found = near_pairs(customers(spark, sf_dir), suppliers(spark, sf_dir), ["cx", "cy"], ["sx", "sy"], 3000.0)
    score = F.col("d2") + 500000 * F.pmod(F.col("c_custkey") - F.col("s_suppkey"), F.lit(3))
    best = found.groupBy("c_custkey").agg(F.min(F.struct(score.alias("score"), "s_suppkey")).alias("m"))
    return best.select("c_custkey", "m.s_suppkey", "m.score")


@query("j06_first_hit", f"""
WITH {POINTS} SELECT c_custkey, min(s_suppkey) AS s_suppkey FROM p WHERE abs(cx - sx) <= 3000 AND abs(cy - sy) <= 1000 GROUP BY c_custkey
""")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the boxes (about a supplier) that a point lies in."""
    found = near_pairs(customers(spark, sf_dir), suppliers(spark, sf_dir), ["cx"], ["sx"], 3000.0)
    return found.filter(F.abs(F.col("cy") - F.col("sy")) <= 1000).groupBy("c_custkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("j07_segment_candidates", """
WITH g AS (SELECT o_custkey, o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS a, CAST(floor(o_totalprice * 100) AS BIGINT) + 100000 + o_orderkey % 7 * 10000 AS b FROM orders)
SELECT x.o_orderkey AS i, y.o_orderkey AS j, least(x.b, y.b) - greatest(x.a, y.a) AS overlap
FROM g x JOIN g y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey WHERE least(x.b, y.b) >= greatest(x.a, y.a)
""")
def segment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs i < j of a line's segments that share a cell, then the exact test."""
    o = table(spark, sf_dir, "orders")
    a = hundredths("o_totalprice")
    g = o.select("o_custkey", "o_orderkey", a.alias("a"), (a + 100000 + F.col("o_orderkey") % 7 * 10000).alias("b"))
    size = 100000
    celled = g.withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))))
    x, y = celled.alias("x"), celled.alias("y")
    pairs = x.join(y, (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")))
    low, high = F.greatest("x.a", "y.a"), F.least("x.b", "y.b")
    # A pair is kept in the cell where its overlap starts: no distinct is needed.
    hit = pairs.filter((high >= low) & (F.floor(low / size) == F.col("x.c")))
    return hit.select(F.col("x.o_orderkey").alias("i"), F.col("y.o_orderkey").alias("j"), (high - low).alias("overlap"))


@query("j08_vertical_hits", """
WITH t AS (SELECT p_partkey, p_size AS x0, p_size + 4 AS x1, CAST(floor(p_retailprice * 100) AS BIGINT) AS z FROM part)
SELECT l.q AS q, count(*) AS hits, max(z) AS top, min(z) AS bottom, max_by(p_partkey, z * 100000 + p_partkey) AS top_id
FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q FROM lineitem) l JOIN t ON l.q >= t.x0 AND l.q < t.x1 GROUP BY l.q
""")
def vertical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces over a place: number, highest and lowest."""
    t = table(spark, sf_dir, "part").select("p_partkey", hundredths("p_retailprice").alias("z"), F.explode(F.sequence(F.col("p_size").cast("long"), F.col("p_size").cast("long") + 3)).alias("q"))
    places = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q")).distinct()
    return places.join(t, "q").groupBy("q").agg(
        F.count(F.lit(1)).alias("hits"), F.max("z").alias("top"), F.min("z").alias("bottom"), F.max_by("p_partkey", F.col("z") * 100000 + F.col("p_partkey")).alias("top_id")
    )


@query("j09_distance_to_index", f"WITH {POINTS} SELECT c_custkey, min(d2) AS d2, count(*) AS n FROM p WHERE d2 <= 25000000 GROUP BY c_custkey")
def distance_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_pairs(customers(spark, sf_dir), suppliers(spark, sf_dir), ["cx", "cy"], ["sx", "sy"], 5000.0)
    return found.groupBy("c_custkey").agg(F.min("d2").alias("d2"), F.count(F.lit(1)).alias("n"))


@query("j10_nearest_segment", """
WITH c AS (SELECT c_custkey, CAST(floor(c_acctbal * 100) AS BIGINT) AS x FROM customer),
s AS (SELECT s_suppkey, CAST(floor(s_acctbal * 100) AS BIGINT) AS a, CAST(floor(s_acctbal * 100) AS BIGINT) + 1500 AS b FROM supplier),
p AS (SELECT c_custkey, s_suppkey, greatest(a - x, x - b, 0) AS d FROM c JOIN s ON x BETWEEN a - 4000 AND b + 4000),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS k FROM p)
SELECT c_custkey, s_suppkey, d FROM r WHERE k = 1
""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, reach = 4000, 4000
    c = customers(spark, sf_dir).select("c_custkey", F.col("cx").alias("x"), F.floor(F.col("cx") / size).alias("cell"))
    s = suppliers(spark, sf_dir).select("s_suppkey", F.col("sx").alias("a"), (F.col("sx") + 1500).alias("b"))
    s = s.withColumn("cell", F.explode(F.sequence(F.floor((F.col("a") - reach) / size), F.floor((F.col("b") + reach) / size))))
    d = F.greatest(F.col("a") - F.col("x"), F.col("x") - F.col("b"), F.lit(0))
    found = c.join(s, "cell").withColumn("d", d).filter(F.col("d") <= reach)
    return found.groupBy("c_custkey").agg(F.min(F.struct("d", "s_suppkey")).alias("m")).select("c_custkey", "m.s_suppkey", "m.d")


@query("j13_hour_shift_band", """
WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
k(rank, shift) AS (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)),
p AS (SELECT a.event_id, b.event_id AS twin, k.rank, abs(b.t - a.t - k.shift * 3600000000) AS dt
      FROM e a JOIN e b ON a.event_type = 'click' AND b.event_type = 'view' AND a.user_id % 10 = b.user_id % 10 CROSS JOIN k
      WHERE abs(b.t - a.t - k.shift * 3600000000) <= 120000000),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rank, dt, twin) AS n FROM p)
SELECT event_id, twin, rank, dt FROM r WHERE n = 1
""")
def hour_shift_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same moment on two platforms, up to whole hours apart and a tolerance; shifts are tried in a fixed order."""
    tolerance, hour = 120_000_000, 3_600_000_000
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("g"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    shifts = F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(s * hour).alias("shift")) for r, s in enumerate((0, -1, 1, -2, 2))])
    a = e.filter("event_type = 'click'").select("event_id", "g", F.explode(shifts).alias("k"), "t")
    a = a.select("event_id", "g", "k.rank", (F.col("t") + F.col("k.shift")).alias("at")).withColumn("c", F.floor(F.col("at") / tolerance))
    b = e.filter("event_type = 'view'").select(F.col("event_id").alias("twin"), "g", "t")
    b = b.withColumn("c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.floor(F.col("t") / tolerance) + s)))
    dt = F.abs(F.col("t") - F.col("at"))
    found = a.join(b, ["g", "c"]).withColumn("dt", dt).filter(F.col("dt") <= tolerance)
    return found.groupBy("event_id").agg(F.min(F.struct("rank", "dt", "twin")).alias("m")).select("event_id", "m.twin", "m.rank", "m.dt")


@query("j15_coverage", f"""
WITH {POINTS}, n AS (SELECT c_custkey, min(d2) AS d2 FROM p WHERE d2 <= 4000000 GROUP BY 1)
SELECT cy, count(*) AS samples, count(d2) AS covered, CAST(count(d2) AS DOUBLE) / count(*) AS share FROM c LEFT JOIN n ON c.c_custkey = n.c_custkey GROUP BY cy
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a line's samples with a reference within tolerance."""
    c = customers(spark, sf_dir)
    hit = nearest(c, suppliers(spark, sf_dir), "c_custkey", "s_suppkey", ["cx", "cy"], ["sx", "sy"], 2000.0)
    return c.join(hit, "c_custkey", "left").groupBy("cy").agg(
        F.count(F.lit(1)).alias("samples"), F.count("d2").alias("covered"), (F.count("d2").cast("double") / F.count(F.lit(1))).alias("share")
    )


@query("j20_mutual_nearest", f"""
WITH {POINTS}, q AS (SELECT * FROM p WHERE d2 <= 4000000),
a AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS k FROM q),
b AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY d2, c_custkey) AS k FROM q)
SELECT a.c_custkey, a.s_suppkey FROM a JOIN b ON a.c_custkey = b.c_custkey AND a.s_suppkey = b.s_suppkey WHERE a.k = 1 AND b.k = 1
""")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_pairs(customers(spark, sf_dir), suppliers(spark, sf_dir), ["cx", "cy"], ["sx", "sy"], 2000.0)
    a = found.groupBy("c_custkey").agg(F.min(F.struct("d2", "s_suppkey")).alias("m")).select("c_custkey", "m.s_suppkey")
    b = found.groupBy("s_suppkey").agg(F.min(F.struct("d2", "c_custkey")).alias("m")).select("m.c_custkey", "s_suppkey")
    return a.join(b, ["c_custkey", "s_suppkey"])


@query("j21_drop_parallels", f"""
WITH {POINTS} SELECT c_custkey FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.c_custkey = c.c_custkey AND p.d2 <= 1000000)
""")
def drop_parallels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no line of higher priority covers."""
    c = customers(spark, sf_dir)
    hit = near_pairs(c, suppliers(spark, sf_dir), ["cx", "cy"], ["sx", "sy"], 1000.0).select("c_custkey").distinct()
    return c.join(hit, "c_custkey", "left_anti").select("c_custkey")


@query("j22_twin_lines", f"""
WITH {POINTS} SELECT c_custkey, s_suppkey FROM p WHERE abs(cx - sx) BETWEEN 300 AND 2500 AND abs(cy - sy) <= 1000 AND (c_custkey + s_suppkey) % 2 = 1
""")
def twin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite neighbours at a lateral distance between two bounds."""
    found = near_pairs(customers(spark, sf_dir), suppliers(spark, sf_dir), ["cx"], ["sx"], 2500.0)
    lateral = F.abs(F.col("cx") - F.col("sx"))
    return found.filter(lateral.between(300, 2500) & (F.abs(F.col("cy") - F.col("sy")) <= 1000) & ((F.col("c_custkey") + F.col("s_suppkey")) % 2 == 1)).select("c_custkey", "s_suppkey")


@query("j26_station_or_new", f"""
WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) AS k FROM p WHERE d2 <= 1000000)
SELECT c.c_custkey, coalesce('S' || r.s_suppkey, 'new') AS station FROM c LEFT JOIN r ON c.c_custkey = r.c_custkey AND r.k = 1
""")
def station_or_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    hit = nearest(c, suppliers(spark, sf_dir), "c_custkey", "s_suppkey", ["cx", "cy"], ["sx", "sy"], 1000.0)
    return c.join(hit, "c_custkey", "left").select("c_custkey", F.coalesce(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.lit("new")).alias("station"))


@query("j25_overlapping_areas", """
WITH a AS (SELECT p_partkey AS id, p_size AS x0, p_size + 3 AS x1, CAST(floor(p_retailprice) AS BIGINT) AS y0, CAST(floor(p_retailprice) AS BIGINT) + 4 AS y1, p_brand FROM part)
SELECT a.id AS i, b.id AS j, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
FROM a JOIN a b ON a.id < b.id AND a.p_brand <> b.p_brand AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 3
""")
def overlapping_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs i < j of areas that share cells over a threshold, unless the pair of kinds is allowed (same brand).

    All areas are of one size, so the shift between two corners tells what they share. One side is filed under each shift that shares enough,
    one of every two opposite ones, so that a pair meets once, in a join on equal corners, and nothing is counted or gathered after it. The result itself
    grows with the square of the areas about a place; neither side is sent to the driver. Areas without a place share no cells.
    """
    width, height, least = 3, 4, 3
    shifts = [(dx, dy, (width - abs(dx)) * (height - dy)) for dy in range(height) for dx in range(1 - width, width) if (dy, dx) >= (0, 0)]
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(area).cast("long").alias("area")) for dx, dy, area in shifts if area >= least])
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").alias("x"), F.floor("p_retailprice").alias("y"))
    b = p.select(F.col("id").alias("other"), F.col("p_brand").alias("kind"), "x", "y", F.explode(shifts).alias("s"))
    b = b.select("other", "kind", (F.col("x") - F.col("s.dx")).alias("x"), (F.col("y") - F.col("s.dy")).alias("y"), "s.area")
    same_place = F.col("area") == width * height
    met = p.hint("merge").join(b, ["x", "y"]).filter((F.col("p_brand") != F.col("kind")) & F.when(same_place, F.col("id") < F.col("other")).otherwise(F.col("id") != F.col("other")))
    return met.select(F.least("id", "other").alias("i"), F.greatest("id", "other").alias("j"), "area")


def band_pairs(df: DataFrame, group: str, x: str, r: int, key: str, order: list[str]) -> DataFrame:
    """Pairs (better, worse) of keys of a group within r (inclusive) in x; the better comes first in order."""
    first = F.struct(*order)
    left = df.select(F.col(group).alias("_g"), F.floor(F.col(x) / r).alias("_c"), F.col(x).alias("_x"), F.col(key).alias("better"), first.alias("_o"))
    right = df.select(F.col(group).alias("_g"), F.explode(F.array(*[F.floor(F.col(x) / r) + s for s in (-1, 0, 1)])).alias("_c"), F.col(x).alias("_y"), F.col(key).alias("worse"), first.alias("_p"))
    return left.join(right, ["_g", "_c"]).filter((F.abs(F.col("_x") - F.col("_y")) <= r) & (F.col("_o") < F.col("_p"))).select("better", "worse")


def first_choices(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """What a pass from best to worst keeps, when each kept key rules out the worse ones it is paired with.

    keys: key; pairs: better, worse. In rounds: a key without a better open one is kept, its partners go. No
    group is handled by one task, and random orders need about log n rounds.
    """
    from .graph import saved

    still, pairs = saved(keys.select("key")), saved(pairs)
    kept = still.limit(0)
    while True:
        new = saved(still.join(pairs.select(F.col("worse").alias("key")).distinct(), "key", "left_anti"))
        kept = kept.union(new)
        ruled = pairs.join(new, pairs.better == new.key).select("worse").distinct()
        still = saved(still.join(new, "key", "left_anti").join(ruled, still.key == ruled.worse, "left_anti"))
        if still.limit(1).count() == 0:
            return kept
        pairs = saved(pairs.join(still, pairs.better == still.key, "left_semi").join(still, pairs.worse == still.key, "left_semi"))


@query("x04_best_first_within_radius", None)
def best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value first; later rows within 1 of a kept one, of the same method, go.

    Of rows at one place only the best can stay: what rules it out is within 1 of the others too. So places are paired, in whole hundredths, of which
    200 others at most are within 1. Rows without a method or place clash with none.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", hundredths("p_retailprice").alias("x"), F.col("p_size").cast("long").alias("sigma"))
    placed = F.col("p_brand").isNotNull() & F.col("x").isNotNull()
    best = p.filter(placed).groupBy("p_brand", "x").agg(F.min(F.struct("sigma", "p_partkey")).alias("m")).select("p_brand", "x", "m.*")
    kept = first_choices(best.select(F.col("p_partkey").alias("key")), band_pairs(best, "p_brand", "x", 100, "p_partkey", ["sigma", "p_partkey"]))
    return p.filter(placed).join(kept, F.col("p_partkey") == kept.key, "left_semi").union(p.filter(~placed))


def centred(x: Column, y: Column, x0: float, y0: float, cos: float, sin: float) -> tuple[Column, Column]:
    """(u, v) of a turned frame with origin (x0, y0)."""
    return (x - x0) * cos + (y - y0) * sin, (y - y0) * cos - (x - x0) * sin
