"""Evidence fusion: observations to votes, validity weights, verdicts, additions, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import hundredths, query, table
from .graph import components
from .spatial import near_pairs


def ordered_verdict(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The first case that holds."""
    out = F.when(*[(c, v) for c, v in cases][0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def precedence(layers: list[tuple[int, DataFrame]], key: str) -> DataFrame:
    """One row per key: from the layer of highest priority that has it. Pre-aggregated."""
    names = [c for c in layers[0][1].columns if c != key]
    both = None
    for p, layer in layers:
        rows = layer.select(key, F.struct(F.lit(p).alias("p"), *names).alias("r"))
        both = rows if both is None else both.unionByName(rows)
    return both.groupBy(key).agg(F.max_by("r", F.col("r.p")).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in names], F.col("r.p").alias("layer"))


@query("e01_observations", """
SELECT event_id AS obs, user_id AS entity, event_type AS agent, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'old' WHEN ts < TIMESTAMP '2024-01-20' THEN 'recent' ELSE 'new' END AS date_class,
       CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN 60 ELSE 30 END AS weight, CASE WHEN value > 100 THEN 50 ELSE 150 END AS sigma FROM events
""")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs"), F.col("user_id").alias("entity"), F.col("event_type").alias("agent"),
        F.when(F.col("ts") < at("2024-01-10"), "old").when(F.col("ts") < at("2024-01-20"), "recent").otherwise("new").alias("date_class"),
        F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "click", 60).otherwise(30).alias("weight"),
        F.when(F.col("value") > 100, 50).otherwise(150).alias("sigma"),
    )


@query("e02_canonical_attributes", """
WITH a(said, attr, canonical) AS (VALUES ('click', 'use', 'light'), ('view', 'use', 'light'), ('purchase', 'use', 'heavy'), ('error', 'state', 'broken'))
SELECT e.event_id AS obs, a.attr, a.canonical, CAST(floor(e.value * 100) AS BIGINT) AS weight FROM events e JOIN a ON e.event_type = a.said
""")
def canonical_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes through a fixed table of aliases; words it does not know give no vote."""
    alias = spark.createDataFrame([("click", "use", "light"), ("view", "use", "light"), ("purchase", "use", "heavy"), ("error", "state", "broken")], "event_type string, attr string, canonical string")
    return table(spark, sf_dir, "events").join(F.broadcast(alias), "event_type").select(F.col("event_id").alias("obs"), "attr", "canonical", hundredths("value").alias("weight"))


@query("e03_validity_weight", """
SELECT event_id AS obs, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 2 WHEN user_id % 4 = 0 AND ts BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-18' THEN 0 WHEN value < 10 THEN 5 ELSE 10 END AS validity FROM events
""")
def validity_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old: little; inside a works zone during the works: none; uncertain: half."""
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    works = (F.col("user_id") % 4 == 0) & F.col("ts").between(at("2024-01-12"), at("2024-01-18"))
    w = F.when(F.col("ts") < at("2024-01-08"), 2).when(works, 0).when(F.col("value") < 10, 5).otherwise(10)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("obs"), w.alias("validity"))


@query("e04_existence_verdict", """
WITH w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS seen, count(*) FILTER (WHERE event_type = 'error') AS gone, max(ts) FILTER (WHERE event_type = 'view') AS last_seen, max(ts) FILTER (WHERE event_type = 'error') AS last_gone FROM events GROUP BY 1)
SELECT user_id, CASE WHEN seen = 0 AND gone = 0 THEN 'unknown' WHEN gone = 0 THEN 'certain' WHEN seen = 0 THEN 'removed' WHEN last_gone > last_seen AND gone >= seen THEN 'removed' WHEN seen >= 2 * gone THEN 'probable' ELSE 'disputed' END AS verdict FROM w
""")
def existence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "view").alias("seen"), F.count_if(kind == "error").alias("gone"),
        F.max(F.when(kind == "view", F.col("ts"))).alias("last_seen"), F.max(F.when(kind == "error", F.col("ts"))).alias("last_gone"),
    )
    seen, gone = F.col("seen"), F.col("gone")
    cases = [((seen == 0) & (gone == 0), "unknown"), (gone == 0, "certain"), (seen == 0, "removed"), ((F.col("last_gone") > F.col("last_seen")) & (gone >= seen), "removed"), (seen >= 2 * gone, "probable")]
    return w.select("user_id", ordered_verdict(cases, "disputed").alias("verdict"))


@query("e05_significant_difference", """
SELECT o.o_orderkey, abs(CAST(floor(o.o_totalprice * 100) AS BIGINT) - s.total) > greatest(100000, s.total / 10) AS differs
FROM orders o JOIN (SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1) s ON o.o_orderkey = s.l_orderkey
""")
def significant_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(hundredths("l_extendedprice")).alias("total"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", hundredths("o_totalprice").alias("p"))
    return o.join(s, "o_orderkey").select("o_orderkey", (F.abs(F.col("p") - F.col("total")) > F.greatest(F.lit(100000.0), F.col("total") / 10)).alias("differs"))


@query("e06_fused_position", """
WITH m AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS x, CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN 25 ELSE 4 END AS w FROM events)
SELECT user_id, CAST(sum(w * x) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS position, CASE WHEN count(*) FILTER (WHERE w = 100) > 0 THEN 'survey' ELSE 'photo' END AS method, CAST(sum(w) AS BIGINT) AS precision FROM m GROUP BY user_id
""")
def fused_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance position and the best method that took part."""
    w = F.when(F.col("event_type") == "purchase", 100).when(F.col("event_type") == "click", 25).otherwise(4).cast("long")
    m = table(spark, sf_dir, "events").select("user_id", hundredths("value").alias("x"), w.alias("w"))
    return m.groupBy("user_id").agg(
        (F.sum(F.col("w") * F.col("x")).cast("double") / F.sum("w").cast("double")).alias("position"),
        F.when(F.count_if(F.col("w") == 100) > 0, "survey").otherwise("photo").alias("method"), F.sum("w").alias("precision"),
    )


@query("e07_additions", """
WITH RECURSIVE c AS (SELECT c_custkey AS id, CAST(floor(c_acctbal * 100) AS BIGINT) AS x FROM customer),
n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE abs(CAST(floor(s.s_acctbal * 100) AS BIGINT) - c.x) <= 1500)),
b AS (SELECT p.id AS src, q.id AS dst FROM n p JOIN n q ON p.id <> q.id AND abs(p.x - q.x) <= 400),
g AS (SELECT id AS node, id AS label FROM n UNION SELECT b.dst, g.label FROM g JOIN b ON b.src = g.node WHERE g.label < b.dst),
k AS (SELECT node, min(label) AS addition FROM g GROUP BY node)
SELECT addition, count(*) AS n FROM k GROUP BY addition HAVING count(*) >= 2
""")
def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates not near an existing entity, clustered; clusters of two or more are accepted."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), hundredths("c_acctbal").alias("x"))
    s = table(spark, sf_dir, "supplier").select(hundredths("s_acctbal").alias("y"))
    n = c.join(near_pairs(c, s, ["x"], ["y"], 1500.0).select("src").distinct(), "src", "left_anti")
    pairs = near_pairs(n, n.select(F.col("src").alias("dst"), F.col("x").alias("y")), ["x"], ["y"], 400.0).filter("src < dst")
    return components(pairs, n.select(F.col("src").alias("node"))).groupBy(F.col("component").alias("addition")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("e08_state_from_proofs", """
WITH p AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS last_done, min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS first_open FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN done = 0 AND open = 0 THEN 'none' WHEN open = 0 THEN 'closed' WHEN done = 0 THEN 'new' WHEN last_done < first_open THEN 'replaced' WHEN done > 3 * open THEN 'kept' ELSE 'mixed' END AS state FROM p
""")
def state_from_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("open"), F.max(F.when(s == "F", F.col("o_orderdate"))).alias("last_done"), F.min(F.when(s == "O", F.col("o_orderdate"))).alias("first_open")
    )
    done, opened = F.col("done"), F.col("open")
    cases = [((done == 0) & (opened == 0), "none"), (opened == 0, "closed"), (done == 0, "new"), (F.col("last_done") < F.col("first_open"), "replaced"), (done > 3 * opened, "kept")]
    return p.select("o_custkey", ordered_verdict(cases, "mixed").alias("state"))


@query("e09_two_verifiers", """
SELECT doc_id, quality, toxic, CASE WHEN quality = 1 AND toxic = 0 THEN 'confirmed' WHEN quality = 0 AND toxic = 1 THEN 'refuted' ELSE 'to arbitrate' END AS status FROM labels
""")
def two_verifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", ordered_verdict([((q == 1) & (t == 0), "confirmed"), ((q == 0) & (t == 1), "refuted")], "to arbitrate").alias("status"))


@query("e10_layer_precedence", """
WITH l AS (SELECT p_partkey, p_brand AS v, 0 AS p FROM part UNION ALL SELECT p_partkey, p_type, 1 FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, p_name, 2 FROM part WHERE p_size > 40)
SELECT p_partkey, arg_max(v, p) AS v, max(p) AS layer FROM l GROUP BY p_partkey
""")
def layer_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base, then enriched, then arbitrated values."""
    p = table(spark, sf_dir, "part")
    layers = [(0, p.select("p_partkey", F.col("p_brand").alias("v"))), (1, p.filter("p_size > 20").select("p_partkey", F.col("p_type").alias("v"))), (2, p.filter("p_size > 40").select("p_partkey", F.col("p_name").alias("v")))]
    return precedence(layers, "p_partkey")


@query("e11_nearest_admissible", """
WITH c AS (SELECT s_suppkey, s_nationkey AS zone, CAST(floor(s_acctbal) AS BIGINT) AS p0 FROM supplier), k AS (SELECT unnest(range(-20, 21)) * 50 AS step),
t AS (SELECT s_suppkey, p0 + step AS p, abs(step) AS d FROM c, k WHERE p0 + step >= 0 AND (p0 + step) % 7 <> 0 AND (p0 + step) % 500 >= 250),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d, p) AS n FROM t) SELECT s_suppkey, p, d FROM r WHERE n = 1
""")
def nearest_admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place on a grid about p0 that meets all constraints."""
    c = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("p0"))
    t = c.select("s_suppkey", F.explode(F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda k: F.struct(F.abs(k * 50).cast("long").alias("d"), (F.col("p0") + k * 50).alias("p")))).alias("m"))
    ok = t.filter((F.col("m.p") >= 0) & (F.col("m.p") % 7 != 0) & (F.col("m.p") % 500 >= 250))
    return ok.groupBy("s_suppkey").agg(F.min("m").alias("m")).select("s_suppkey", "m.p", "m.d")


@query("e12_missing_in_row", """
WITH s AS (SELECT s_nationkey AS line, CAST(floor(s_acctbal * 100) AS BIGINT) AS x, s_suppkey FROM supplier), g AS (SELECT line, x, lead(x) OVER (PARTITION BY line ORDER BY x, s_suppkey) - x AS gap FROM s),
m AS (SELECT line, median(gap) AS mid FROM g GROUP BY line) SELECT g.line, g.x, g.gap FROM g JOIN m ON g.line = m.line WHERE g.gap >= 1.6 * m.mid AND g.gap <= 2.4 * m.mid
""")
def missing_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of about twice the row's usual spacing: one object is missing there."""
    w = Window.partitionBy("line").orderBy("x", "s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("line"), hundredths("s_acctbal").alias("x"), "s_suppkey")
    g = s.withColumn("gap", F.lead("x").over(w) - F.col("x"))
    m = g.groupBy("line").agg(F.median("gap").alias("mid"))
    return g.join(m, "line").filter("gap >= 1.6D * mid AND gap <= 2.4D * mid").select("line", "x", "gap")


@query("e13_decision_journal", "SELECT user_id AS id, event_type AS nature, min(event_id) AS first_entry, count(*) AS entries FROM events GROUP BY 1, 2")
def decision_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per (id, nature): the first."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("nature")).agg(F.min("event_id").alias("first_entry"), F.count(F.lit(1)).alias("entries"))
