"""Graph operators by rounds of joins: components, shortest paths, splitting and chaining of ways.

Each loop cuts its lineage with a checkpoint in the shared folder, so a lost executor costs a round's reads, not its work.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import hundredths, query, table


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; only a local session without a shared folder gets a temporary one.

    Spark would keep the estimated size of what was saved. A join's estimate is the product of its sides', so its digits
    double with each round of a loop. It is left out.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node and its component's smallest node. edges: src, dst; vertices: node (those without edges stand alone).

    Rounds of hooking every node to the least label about it and of pointer jumping, until nothing changes.
    """
    both = saved(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct())
    nodes = both.select(F.col("src").alias("node"))
    label = saved((nodes.union(vertices.select("node")) if vertices is not None else nodes).distinct().withColumn("label", F.col("node")))
    while True:
        about = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("label").alias("least"))
        hooked = label.join(about, label.node == about.src, "left").select("node", "label", F.least("label", "least").alias("new"))
        roots = hooked.select(F.col("node").alias("r"), F.col("new").alias("to"))
        jumped = hooked.join(roots, hooked.new == roots.r).select("node", "label", F.least("new", "to").alias("new"))
        state = saved(jumped)
        label = state.select("node", F.col("new").alias("label"))
        if state.filter("new < label").limit(1).count() == 0:
            return label.select("node", F.col("label").alias("component"))


def shortest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Distances from sources (node, dist 0) over directed edges (src, dst, len): relaxation until nothing changes.

    Only nodes that got nearer in the last round are relaxed.
    """
    dist = saved(sources.select("node", F.lit(0).cast("long").alias("dist")))
    front = dist
    while True:
        step = front.join(edges, front.node == edges.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("len")).alias("new"))
        state = saved(dist.join(step, "node", "full_outer").select("node", "dist", F.least("dist", "new").alias("best")))
        dist = state.select("node", F.col("best").alias("dist"))
        front = state.filter("dist IS NULL OR best < dist").select("node", F.col("best").alias("dist"))
        if front.limit(1).count() == 0:
            return dist


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that follow each other in an order: src < dst."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_suppkey")
    return li.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).filter("dst IS NOT NULL").distinct()


LINKS = """
li AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
e AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS dst FROM li) WHERE dst IS NOT NULL),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
"""


@query("g01_split_ways", """
WITH v AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_partkey) AS degree,
                  count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
c AS (SELECT *, CASE WHEN pos > 1 AND pos < n AND degree > 8 THEN 1 ELSE 0 END AS cut FROM v)
SELECT way, node, pos, CAST(coalesce(sum(cut) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS edge FROM c
""")
def split_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways cut at nodes that many ways share; edge is the running number of the cut before a node."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), "l_linenumber", "l_suppkey")
    order = Window.partitionBy("way").orderBy("l_linenumber", "node", "l_suppkey")
    degree = li.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    v = li.join(degree, "node").withColumn("pos", F.row_number().over(order).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("way")))
    v = v.withColumn("cut", F.when((F.col("pos") > 1) & (F.col("pos") < F.col("n")) & (F.col("degree") > 8), 1).otherwise(0))
    before = Window.partitionBy("way").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return v.select("way", "node", "pos", F.coalesce(F.sum("cut").over(before), F.lit(0)).alias("edge"))


@query("g02_sample_line", """
WITH s AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 5 AS n FROM orders) SELECT o_orderkey, unnest(range(0, n)) AS i, o_custkey * 10 + unnest(range(0, n)) AS x FROM s
""")
def sample_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 5)).alias("i"))
    return s.select("o_orderkey", "i", (F.col("o_custkey") * 10 + F.col("i")).alias("x"))


@query("g03_project_on_line", """
WITH s AS (SELECT s_nationkey AS line, CAST(floor(s_acctbal * 100) AS BIGINT) AS x, s_suppkey FROM supplier),
g AS (SELECT line, x AS a, lead(x) OVER (PARTITION BY line ORDER BY x, s_suppkey) AS b, x - min(x) OVER (PARTITION BY line) AS s0, row_number() OVER (PARTITION BY line ORDER BY x, s_suppkey) AS i FROM s),
c AS (SELECT c_custkey, c_nationkey AS line, CAST(floor(c_acctbal * 100) AS BIGINT) AS p FROM customer),
q AS (SELECT c_custkey, greatest(a - p, p - b, 0) AS d, s0 + least(greatest(p - a, 0), b - a) AS s, i FROM c JOIN g ON c.line = g.line WHERE b IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, i) AS k FROM q)
SELECT c_custkey, s, d FROM r WHERE k = 1
""")
def project_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abscissa and distance of points projected on their line of ordered vertices.

    On an axis the segments of a line follow each other without a gap, from its first vertex to its last. Of the nearest segments
    each has the point's projection at the same place, the point moved into the line's span, so no pairs with segments are needed. A line
    has two vertices at least; a point without a place is at the start, as in SQL, where greatest() and least() pass over nulls.
    """
    g = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("line"), hundredths("s_acctbal").alias("x"))
    g = g.groupBy("line").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).filter("n > 1")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("line"), hundredths("c_acctbal").alias("p"))
    d = F.greatest(F.col("lo") - F.col("p"), F.col("p") - F.col("hi"), F.lit(0))
    s = F.least(F.greatest("p", "lo"), F.col("hi")) - F.col("lo")
    best = c.join(g, "line").groupBy("c_custkey").agg(F.min(F.struct(d.alias("d"), s.alias("s"))).alias("m"))
    return best.select("c_custkey", "m.s", "m.d")


@query("g04_shortest_path", f"""
WITH RECURSIVE {LINKS}, w AS (SELECT src, dst, 1 + (src + dst) % 7 AS len FROM b),
d AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS dist UNION SELECT w.dst, d.dist + w.len FROM d JOIN w ON w.src = d.node WHERE d.dist + w.len <= 7 * (SELECT count(*) FROM supplier))
SELECT node, min(dist) AS dist FROM d GROUP BY node
""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = order_graph(spark, sf_dir)
    both = e.union(e.select("dst", "src")).distinct().withColumn("len", 1 + (F.col("src") + F.col("dst")) % 7)
    return shortest(both, spark.createDataFrame([(0,)], "node long"))


@query("g05_components", f"""
WITH RECURSIVE {LINKS}, c AS (SELECT DISTINCT src AS node, src AS label FROM b UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.node WHERE c.label < b.dst)
SELECT node, min(label) AS component FROM c GROUP BY node
""")
def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(order_graph(spark, sf_dir))


@query("g07_chain_ways", """
WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 97 AS a, event_id * 7 % 97 AS b FROM events),
g AS (SELECT user_id, i, least(abs(a - lag(b) OVER w), abs(b - lag(b) OVER w)) AS gap FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, count(*) AS ways, CAST(coalesce(sum(gap), 0) AS BIGINT) AS gaps FROM g GROUP BY user_id
""")
def chain_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways in order, and how far each one's nearer end lies from the end of the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, sf_dir, "events").withColumn("a", F.col("event_id") % 97).withColumn("b", F.col("event_id") * 7 % 97)
    gap = F.least(F.abs(F.col("a") - F.lag("b").over(w)), F.abs(F.col("b") - F.lag("b").over(w)))
    return v.withColumn("gap", gap).groupBy("user_id").agg(F.count(F.lit(1)).alias("ways"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gaps"))


@query("g08_merge_degree_two", f"""
WITH {LINKS}, d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY 1)
SELECT e.src, e.dst, x.degree = 2 AND (e.src % 2 = e.dst % 2) AS mergeable FROM e JOIN d x ON e.dst = x.node
""")
def merge_degree_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose end has two neighbours and whose contract agrees."""
    e = order_graph(spark, sf_dir)
    d = e.union(e.select("dst", "src")).distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return e.join(d, e.dst == d.node).select("src", "dst", ((F.col("degree") == 2) & (F.col("src") % 2 == F.col("dst") % 2)).alias("mergeable"))


@query("g09_lane_profile", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'primary' WHEN 'click' THEN 'secondary' ELSE 'residential' END AS category,
       CASE WHEN event_type = 'purchase' AND k >= 50 THEN 4 WHEN event_type = 'purchase' OR k >= 80 THEN 2 ELSE 1 END AS lanes,
       CASE WHEN k % 2 = 0 THEN k // 2 WHEN event_type = 'purchase' THEN 80 ELSE 50 END AS speed, k % 5 = 0 AS one_way
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def lane_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules from tags to a lane profile."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "purchase", "primary").when(kind == "click", "secondary").otherwise("residential").alias("category"),
        F.when((kind == "purchase") & (k >= 50), 4).when((kind == "purchase") | (k >= 80), 2).otherwise(1).alias("lanes"),
        F.when(k % 2 == 0, F.floor(k / 2)).when(kind == "purchase", 80).otherwise(50).cast("long").alias("speed"), (k % 5 == 0).alias("one_way"),
    )


@query("g12_line_of_sight", """
WITH o AS (SELECT s_suppkey, s_nationkey AS zone, CAST(floor(s_acctbal) AS BIGINT) AS a FROM supplier)
SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.zone = c.c_nationkey AND o.a + 200 >= least(5000, CAST(floor(c.c_acctbal) AS BIGINT)) AND o.a <= greatest(5000, CAST(floor(c.c_acctbal) AS BIGINT)))
""")
def line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen from the middle of their street: no obstacle of length 200 cuts the way. Both meet in cells of the street."""
    size = 1000
    x = F.floor("c_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("zone"), F.least(F.lit(5000), x).alias("lo"), F.greatest(F.lit(5000), x).alias("hi"))
    c = c.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))))
    o = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), F.floor("s_acctbal").alias("a"))
    o = o.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("a") + 200) / size))))
    hidden = c.join(o, ["zone", "cell"]).filter((F.col("a") + 200 >= F.col("lo")) & (F.col("a") <= F.col("hi"))).select("c_custkey").distinct()
    return table(spark, sf_dir, "customer").select("c_custkey").join(hidden, "c_custkey", "left_anti")


@query("g13_triangulate", """
WITH v AS (SELECT user_id, (event_id % 20 - 10)::BIGINT AS a, (event_id % 7 + 1)::BIGINT AS b, CAST(floor(value * 100) AS BIGINT) AS c FROM events),
s AS (SELECT user_id, sum(a * a)::DOUBLE AS aa, sum(a * b)::DOUBLE AS ab, sum(b * b)::DOUBLE AS bb, sum(a * c)::DOUBLE AS ac, sum(b * c)::DOUBLE AS bc FROM v GROUP BY 1)
SELECT user_id, CASE WHEN aa * bb - ab * ab <> 0 THEN (ac * bb - bc * ab) / (aa * bb - ab * ab) END AS x, CASE WHEN aa * bb - ab * ab <> 0 THEN (aa * bc - ab * ac) / (aa * bb - ab * ab) END AS y FROM s
""")
def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point from many sight lines a x + b y = c: normal equations from whole-number sums."""
    v = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20 - 10).alias("a"), (F.col("event_id") % 7 + 1).alias("b"), hundredths("value").alias("c"))
    total = lambda e: F.sum(F.expr(e)).cast("double")
    s = v.groupBy("user_id").agg(*[total(f"{p} * {q}").alias(p + q) for p, q in ("aa", "ab", "bb", "ac", "bc")])
    det = F.expr("aa * bb - ab * ab")
    return s.select("user_id", F.when(det != 0, F.expr("ac * bb - bc * ab") / det).alias("x"), F.when(det != 0, F.expr("aa * bc - ab * ac") / det).alias("y"))


@query("g15_displacement", """
WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_custkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders WHERE o_orderkey % 2 = 1),
d AS (SELECT a.k, a.id, min(abs(a.x - b.x)) AS d FROM a JOIN b ON a.k = b.k GROUP BY 1, 2) SELECT k, max(d) AS displacement FROM d GROUP BY k
""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest distance from a version's vertex to the other version: neighbours on both sides in one sorted pass, no pairs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.floor("o_totalprice").alias("x"), F.when(F.col("o_orderkey") % 2 == 1, F.floor("o_totalprice")).alias("other"))
    w = Window.partitionBy("k").orderBy("x")
    below = F.last("other", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("other", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    d = o.select("k", "other", F.least(F.col("x") - below, above - F.col("x")).alias("d")).filter("other IS NULL AND d IS NOT NULL")
    return d.groupBy("k").agg(F.max("d").alias("displacement"))


@query("g16_group_bands", """
WITH RECURSIVE s AS (SELECT s_suppkey AS id, CAST(floor(s_acctbal * 100) AS BIGINT) AS x FROM supplier),
b AS (SELECT p.id AS src, q.id AS dst FROM s p JOIN s q ON p.id <> q.id AND abs(p.x - q.x) <= 6000),
c AS (SELECT id AS node, id AS label FROM s UNION SELECT b.dst, c.label FROM c JOIN b ON b.src = c.node WHERE c.label < b.dst)
SELECT node, min(label) AS component FROM c GROUP BY node
""")
def group_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands side by side within reach of each other form a crossing; lone bands stand alone.

    Bands of a cell of the reach are all within it, so a cell joins whole, and to the next one only, if the gap between them
    is within reach. No pairs of bands are made. A key with several bands joins their cells; without key or place a band stands alone.
    """
    reach = 6000
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), hundredths("s_acctbal").alias("x"))
    s = s.withColumn("cell", F.when(F.col("node").isNotNull(), F.floor(F.col("x") / reach)))
    cells = saved(s.filter("cell IS NOT NULL").groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("node").alias("least")))
    home = s.groupBy("node").agg(F.min("cell").alias("cell"))
    following = cells.select((F.col("cell") - 1).alias("cell"), F.col("lo").alias("next"))
    beside = cells.join(following, "cell").filter(F.col("next") - F.col("hi") <= reach).select(F.col("cell").alias("src"), (F.col("cell") + 1).alias("dst"))
    shared = s.join(home.select("node", F.col("cell").alias("src")), "node").filter("cell > src").select("src", F.col("cell").alias("dst"))
    found = saved(components(beside.union(shared), cells.select(F.col("cell").alias("node"))).withColumnRenamed("node", "cell"))
    crossing = found.join(cells, "cell").groupBy("component").agg(F.min("least").alias("least"))
    named = home.join(found.join(crossing, "component"), "cell", "left")
    return named.select("node", F.coalesce("least", "node").alias("component"))


@query("g17_extend_chain", """
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS g, CAST(floor(s_acctbal * 100) AS BIGINT) AS a, CAST(floor(s_acctbal * 100) AS BIGINT) + 10000 AS b FROM supplier),
p AS (SELECT x.id, y.id AS next, row_number() OVER (PARTITION BY x.id ORDER BY y.a - x.b, y.id) AS k FROM s x JOIN s y ON x.g = y.g AND y.a > x.b AND y.a - x.b <= 300000) SELECT id, next FROM p WHERE k = 1
""")
def extend_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that continues each one: the next start after its end, within reach, in one sorted pass."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), hundredths("s_acctbal").alias("a"))
    ends = s.select("g", (F.col("a") + 10000).alias("at"), F.lit(1).alias("side"), F.col("s_suppkey").alias("id"), F.lit(None).cast("struct<a:bigint,id:bigint>").alias("n"))
    starts = s.select("g", F.col("a").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.struct("a", F.col("s_suppkey").alias("id")).alias("n"))
    after = Window.partitionBy("g").orderBy("at", "side", F.col("n.id").asc_nulls_first()).rowsBetween(1, Window.unboundedFollowing)
    out = ends.union(starts).withColumn("next", F.first("n", ignorenulls=True).over(after)).filter("id IS NOT NULL AND next IS NOT NULL AND next.a - at <= 300000")
    return out.select("id", F.col("next.id").alias("next"))

