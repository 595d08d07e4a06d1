"""Equi, full outer, as-of, existence and cascaded joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import hundredths, query, table


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two snapshots: keys, status (added, removed, modified, same) and the changed columns."""
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"_old.{v}").eqNullSafe(F.col(f"_new.{v}")), F.lit(v)) for v in values]), lambda x: x.isNotNull())
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("same")
    present = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return both.withColumn("status", status).withColumn("changed", F.when(present, changed).otherwise(F.array().cast("array<string>")))


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, right_cols: list[str], forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (or the first at or after it) of the same group.

    One exchange by group and one sort: the sides are put together and the last right row is carried along. No pairs are made.
    """
    names = left.columns
    nulls = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right_cols]
    a = left.select(F.col(by).alias("_by"), F.col(left_ts).alias("_ts"), F.lit(0 if forward else 1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*right_cols)).schema[0].dataType).alias("_r"))
    b = right.select(F.col(by).alias("_by"), F.col(right_ts).alias("_ts"), F.lit(1 if forward else 0).alias("_side"), F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_row"), F.struct(*right_cols).alias("_r"))
    w = Window.partitionBy("_by").orderBy("_ts", "_side", F.col("_r").asc())
    frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    pick = F.first("_r", ignorenulls=True) if forward else F.last("_r", ignorenulls=True)
    out = a.unionByName(b).withColumn("_hit", pick.over(frame)).filter(F.col("_row").isNotNull())
    return out.select("_row.*", *[F.col(f"_hit.{c}").alias(c) for c in right_cols]) if nulls else out


def resolve(left: DataFrame, key: Column, tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Links by the first table that knows the key: each table has columns key and target (keys unique)."""
    out = left.withColumn("_key", key)
    targets, modes = [], []
    for mode, t in tables:
        out = out.join(t.select(F.col("key").alias("_key"), F.col("target").alias(f"_{mode}")), "_key", "left")
        targets.append(F.col(f"_{mode}"))
        modes.append(F.when(F.col(f"_{mode}").isNotNull(), F.lit(mode)))
    return out.withColumn("target", F.coalesce(*targets)).withColumn("mode", F.coalesce(*modes, F.lit("none"))).drop("_key", *[f"_{m}" for m, _ in tables])


@query("j01_verdict_chain", """
WITH c AS (SELECT l_orderkey AS id, count(*) AS claims FROM lineitem GROUP BY 1)
SELECT o.o_orderkey AS id, c.claims, o.o_orderstatus AS verdict1, u.c_mktsegment AS verdict2,
       CASE WHEN c.claims IS NULL THEN 'no claim' WHEN o.o_orderstatus = 'F' AND u.c_mktsegment = 'BUILDING' THEN 'agreed' WHEN u.c_mktsegment IS NULL THEN 'open' ELSE 'arbitrated' END AS status
FROM orders o LEFT JOIN c ON o.o_orderkey = c.id LEFT JOIN customer u ON o.o_custkey = u.c_custkey
""")
def verdict_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("claims"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("verdict1"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("verdict2"))
    status = (
        F.when(F.col("claims").isNull(), "no claim").when((F.col("verdict1") == "F") & (F.col("verdict2") == "BUILDING"), "agreed")
        .when(F.col("verdict2").isNull(), "open").otherwise("arbitrated")
    )
    return o.join(claims, "id", "left").join(c, "o_custkey", "left").select("id", "claims", "verdict1", "verdict2", status.alias("status"))


@query("j02_snapshot_diff", """
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 5)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id,
       CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderstatus <> b.o_orderstatus THEN 'modified' ELSE 'same' END AS status,
       CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' ELSE '' END AS changed
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
""")
def snapshot_diff_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    new = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    diff = snapshot_diff(o.filter("o_orderkey % 10 <> 3"), new.filter("o_orderkey % 10 <> 5"), ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return diff.select(F.col("o_orderkey").alias("id"), "status", F.concat_ws(",", "changed").alias("changed"))


@query("j03_assemble_geometry", """
WITH v AS (SELECT user_id, event_id AS ref, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
n AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS x FROM events WHERE event_type <> 'error')
SELECT v.user_id, count(*) AS n_points, string_agg(n.x::VARCHAR, ',' ORDER BY v.pos) AS xs FROM v JOIN n ON v.ref = n.event_id GROUP BY v.user_id
""")
def assemble_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of ordered node references made into point lists; unknown references are left out, the order is kept."""
    e = table(spark, sf_dir, "events")
    ways = e.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("refs")).select("user_id", F.posexplode("refs").alias("pos", "event_id"))
    nodes = e.filter("event_type <> 'error'").select("event_id", hundredths("value").alias("x"))
    line = ways.join(nodes, "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return line.select("user_id", F.size("p").cast("long").alias("n_points"), F.array_join(F.transform("p", lambda q: q["x"].cast("string")), ",").alias("xs"))


@query("j11_leader", """
SELECT event_id, lead(event_id) OVER (PARTITION BY event_type ORDER BY CAST(floor(value * 100) AS BIGINT), event_id) AS leader,
       lead(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY CAST(floor(value * 100) AS BIGINT), event_id) - CAST(floor(value * 100) AS BIGINT) AS gap FROM events
""")
def leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next agent ahead on the same lane."""
    s = hundredths("value")
    w = Window.partitionBy("event_type").orderBy("s", "event_id")
    e = table(spark, sf_dir, "events").withColumn("s", s)
    return e.select("event_id", F.lead("event_id").over(w).alias("leader"), (F.lead("s").over(w) - F.col("s")).alias("gap"))


@query("j12_asof_backward", """
SELECT c.event_id, v.ref, v.ref_type FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS ref, 'view' AS ref_type FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON c.user_id = v.user_id AND c.ts >= v.ts
""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("ref"), F.col("event_type").alias("ref_type"))
    return asof(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "at", ["ref", "ref_type"]).select("event_id", "ref", "ref_type")


@query("j12b_asof_forward", """
SELECT c.event_id, v.ref FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS ref FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON c.user_id = v.user_id AND c.ts <= v.ts
""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("ref"))
    return asof(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "at", ["ref"], forward=True).select("event_id", "ref")


@query("j16_cascaded_links", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey WHEN o_custkey % 5 = 0 THEN o_custkey + 1000000 WHEN o_custkey < 300 THEN -1 END AS target,
       CASE WHEN o_custkey % 3 = 0 THEN 'id' WHEN o_custkey % 5 = 0 THEN 'alias' WHEN o_custkey < 300 THEN 'host' ELSE 'none' END AS mode FROM orders
""")
def cascaded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # Keys that no customer has are known to the id and alias tables too, by the same rule.
    keys = c.union(o.select("o_custkey")).distinct()
    known = [
        ("id", keys.filter("key % 3 = 0").withColumn("target", F.col("key"))),
        ("alias", keys.filter("key % 5 = 0").withColumn("target", F.col("key") + 1000000)),
        ("host", keys.filter("key < 300").withColumn("target", F.lit(-1).cast("long"))),
    ]
    return resolve(o, F.col("o_custkey"), known).select("o_orderkey", "target", "mode")


@query("j17_alias_unique", """
SELECT p_name AS alias, min(p_brand) AS target FROM part WHERE p_size > 45 GROUP BY p_name HAVING count(DISTINCT p_brand) = 1
""")
def alias_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases with one target; ambiguous ones are rejected."""
    a = table(spark, sf_dir, "part").filter("p_size > 45").groupBy(F.col("p_name").alias("alias"))
    return a.agg(F.min("p_brand").alias("target"), F.max("p_brand").alias("last")).filter("target = last").drop("last")


@query("j18_semi_anti", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS present FROM customer c
""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    keys = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(keys, "c_custkey", "left_semi").withColumn("present", F.lit(True)).union(c.join(keys, "c_custkey", "left_anti").withColumn("present", F.lit(False)))


@query("j19_none_between", """
SELECT a.event_id FROM events a WHERE a.event_type = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR)
""")
def none_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with no other of a kind in the time after them: the next one is looked up as of, no pairs are made."""
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) + 1).alias("t"))
    right = e.filter("event_type = 'error'").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).withColumn("next", F.col("at"))
    found = asof(left, right, "user_id", "t", "at", ["next"], forward=True)
    return found.filter("next IS NULL OR next > t - 1 + 6 * 3600000000L").select("event_id")


@query("j23_small_product", "SELECT n_nationkey, r_regionkey, n_regionkey = r_regionkey AS own FROM nation CROSS JOIN region")
def small_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of two fixed dimensions."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return n.crossJoin(F.broadcast(table(spark, sf_dir, "region").select("r_regionkey"))).select("n_nationkey", "r_regionkey", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


@query("j24_covered_lines", """
WITH g AS (SELECT o_custkey AS line, o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS a, CAST(floor(o_totalprice) AS BIGINT) + 20000 AS b, o_orderkey % 4 AS rank FROM orders),
c AS (SELECT x.id FROM g x JOIN g y ON x.line = y.line AND y.rank < x.rank AND least(x.b, y.b) > greatest(x.a, y.a)
      GROUP BY x.id HAVING max(least(x.b, y.b) - greatest(x.a, y.a)) >= 12000)
SELECT id FROM g WHERE id NOT IN (SELECT id FROM c)
""")
def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that no better one of the same line covers to the threshold; pairs meet in cells of an interval's length."""
    size = 20000
    a = F.floor("o_totalprice")
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("id"), a.alias("a"), (a + size).alias("b"), (F.col("o_orderkey") % 4).alias("rank"))
    celled = g.withColumn("c", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.col("b") / size))))
    x, y = celled.alias("x"), celled.alias("y")
    on = (F.col("x.line") == F.col("y.line")) & (F.col("x.c") == F.col("y.c")) & (F.col("y.rank") < F.col("x.rank"))
    covered = x.join(y, on).filter(F.least("x.b", "y.b") - F.greatest("x.a", "y.a") >= 12000).select(F.col("x.id").alias("id"))
    return g.join(covered, "id", "left_anti").select("id")


@query("j27_boundary_pairs", """
WITH g AS (SELECT l_suppkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, a.l_linenumber AS i, b.l_linenumber AS j, CAST(abs(a.s - b.s) AS BIGINT) AS gap, least(a.n, b.n) AS shared FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber + 1 = b.l_linenumber
""")
def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the next of its bundle: gap and shared length."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    b = g.select("l_suppkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_linenumber").alias("j"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    return g.join(b, ["l_suppkey", "l_linenumber"]).select("l_suppkey", F.col("l_linenumber").alias("i"), "j", F.abs(F.col("s") - F.col("s2")).alias("gap"), F.least("n", "n2").alias("shared"))
