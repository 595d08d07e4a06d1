"""Aggregations: profiles, grouping sets, votes, noisy-or, robust means, shares and correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import hundredths, query, table


def profile(x: Column, ps: tuple[float, ...] = (0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95)) -> list[Column]:
    """Count, mean, sample deviation and exact quantiles (linear interpolation); NaN counts as missing."""
    v = F.nanvl(x.cast("double"), F.lit(None))
    return [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), *[F.percentile(v, p).alias(f"p{round(p * 100)}") for p in ps]]


def circular_mean(angle: Column, weight: Column | None = None, period: float = 360.0) -> Column:
    """Weighted mean of angles modulo a period, in [0, period)."""
    w = weight if weight is not None else F.lit(1.0)
    turn = 2 * math.pi / period
    return F.pmod(F.atan2(F.sum(w * F.sin(angle * turn)), F.sum(w * F.cos(angle * turn))) / turn, F.lit(period))


def noisy_or(scores: Column) -> Column:
    """1 - product(1 - s) over a group, scores cut to [0, 1]. Sorted first, so the result does not depend on the rows' order."""
    cut = F.least(F.greatest(scores, F.lit(0.0)), F.lit(1.0))
    return F.lit(1.0) - F.aggregate(F.array_sort(F.collect_list(cut)), F.lit(1.0), lambda a, s: a * (F.lit(1.0) - s))


def categorical_vote(df: DataFrame, entity: str, value: str, weight: Column, share: float = 0.5, least: float = 0.0) -> DataFrame:
    """The value of most weight (ties: the smaller value), its weight, the next one's, and whether the next one disputes it."""
    tally = df.groupBy(entity, value).agg(F.sum(weight).alias("w"))
    first = Window.partitionBy(entity).orderBy(F.col("w").desc(), F.col(value))
    ranked = tally.withColumn("_k", F.row_number().over(first)).withColumn("second", F.lead("w").over(first)).filter("_k = 1")
    dispute = F.coalesce((F.col("second") >= share * F.col("w")) & (F.col("second") >= least), F.lit(False))
    return ranked.select(entity, F.col(value).alias("winner"), F.col("w").alias("weight"), "second", dispute.alias("conflict"))


@query("a02_profile", """
SELECT event_type, count(value) AS n, CAST(round(quantile_cont(value, 0.05) * 1000000) AS BIGINT) AS p5, CAST(round(quantile_cont(value, 0.5) * 1000000) AS BIGINT) AS p50, CAST(round(quantile_cont(value, 0.95) * 1000000) AS BIGINT) AS p95 FROM events GROUP BY event_type
""")
def profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*profile(F.col("value"), (0.05, 0.5, 0.95)))
    return out.select("event_type", "n", *[F.round(F.col(p) * 1000000).cast("long").alias(p) for p in ("p5", "p50", "p95")])


@query("a03_nested_counts", """
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, CAST(sum(n) AS BIGINT) AS n, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS segments FROM c GROUP BY 1
""")
def nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "c_mktsegment", F.col("n").cast("string"))))
    return c.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.array_join(parts, ",").alias("segments"))


@query("a04_most_common", "SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency counts with a place; the window runs over one row per value."""
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "p_type")).cast("long"))


@query("a05_grouping_sets", """
SELECT coalesce(o_orderstatus, 'all') AS zone, coalesce(o_orderpriority, 'all') AS band, count(*) AS n, CAST(sum(CAST(floor(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total,
       grouping_id(o_orderstatus, o_orderpriority) AS level
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
""")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = o.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(hundredths("o_totalprice")).alias("total"), F.grouping_id("o_orderstatus", "o_orderpriority").alias("level"))
    return out.select(F.coalesce("o_orderstatus", F.lit("all")).alias("zone"), F.coalesce("o_orderpriority", F.lit("all")).alias("band"), "n", "total", "level")


@query("a06_conditional_counts", """
SELECT l_shipdate >= TIMESTAMP '1998-01-01' AS late, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 25) AS large,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS open_quantity FROM lineitem GROUP BY 1
""")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("late")
    return table(spark, sf_dir, "lineitem").groupBy(late).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 25).alias("large"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("long")).otherwise(0)).alias("open_quantity"),
    )


@query("a07_distinct_sets", """
SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey
""")
def distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_distinct("l_partkey").alias("parts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags")
    )


@query("a08_median_or_null", """
SELECT c_nationkey, median(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(floor(c_acctbal * 100) AS BIGINT) END) AS middle,
       quantile_cont(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(floor(c_acctbal * 100) AS BIGINT) END, 0.25) AS lower FROM customer GROUP BY 1
""")
def median_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("c_mktsegment") == "BUILDING", hundredths("c_acctbal"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.median(v).alias("middle"), F.percentile(v, 0.25).alias("lower"))


@query("a09_drop_pale_components", """
WITH g AS (SELECT l_suppkey, count(*) AS area, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1)
SELECT l_suppkey, area, score FROM g WHERE NOT (area > 500 AND score < 5 * area)
""")
def drop_pale_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components but those both big and pale."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("area"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("score"))
    return g.filter(~((F.col("area") > 500) & (F.col("score") < 5 * F.col("area"))))


@query("a10_categorical_vote", """
WITH t AS (SELECT user_id, event_type, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS w FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS k, lead(w) OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS second FROM t)
SELECT user_id, event_type AS winner, w AS weight, second, coalesce(second >= 0.5 * w AND second >= 30, false) AS conflict FROM r WHERE k = 1
""")
def categorical_vote_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorical_vote(table(spark, sf_dir, "events"), "user_id", "event_type", hundredths("value"), 0.5, 30)


@query("a10b_numeric_vote", """
WITH v AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS x, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS w FROM events)
SELECT user_id, CAST(sum(x * w) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean, max(x) - min(x) AS spread, max(x) - min(x) > 20000 AS conflict FROM v GROUP BY user_id
""")
def numeric_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean, range, and whether the range exceeds a tolerance."""
    v = table(spark, sf_dir, "events").select("user_id", hundredths("value").alias("x"), (F.get_json_object("props", "$.k").cast("long") + 1).alias("w"))
    spread = F.max("x") - F.min("x")
    return v.groupBy("user_id").agg((F.sum(F.col("x") * F.col("w")).cast("double") / F.sum("w").cast("double")).alias("mean"), spread.alias("spread"), (spread > 20000).alias("conflict"))


@query("a10c_circular_vote", """
WITH v AS (SELECT event_type, CAST(floor(value * 100) AS BIGINT) % 90 AS a FROM events),
m AS (SELECT event_type, atan2(sum(CAST(round(sin(radians(a)) * 1000000) AS BIGINT)), sum(CAST(round(cos(radians(a)) * 1000000) AS BIGINT))) AS r FROM v GROUP BY 1)
SELECT event_type, CAST(round(degrees(r) * 1000) AS BIGINT) AS mean_millidegrees FROM m
""")
def circular_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular mean; sines and cosines are summed as whole millionths, so that the order of rows cannot matter."""
    a = hundredths("value") % 90
    parts = [F.sum(F.round(f(F.radians(a)) * 1000000).cast("long")) for f in (F.sin, F.cos)]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.degrees(F.atan2(*parts)) * 1000).cast("long").alias("mean_millidegrees"))


@query("a11_noisy_or", """
WITH s AS (SELECT user_id, least(greatest(value / 500.0, 0.0), 1.0) AS s FROM events)
SELECT user_id, CAST(round((1.0 - list_reduce(list_prepend(1.0, list_transform(list_sort(list(s)), lambda x: 1.0 - x)), lambda a, x: a * x)) * 1e9) AS BIGINT) AS existence FROM s GROUP BY user_id
""")
def noisy_or_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(noisy_or(F.col("value") / 500.0).alias("p"))
    return e.select("user_id", F.round(F.col("p") * 1e9).cast("long").alias("existence"))


@query("a12_robust_mean", None)
def robust_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-variance mean with the worst outlier rejected until none is left; a data-dependent loop within an entity."""
    import pandas as pd

    def fuse(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        x, s = rows["value"].to_numpy(), rows["sigma"].to_numpy()
        while True:
            w = 1 / s**2
            mean = float((w * x).sum() / w.sum())
            z = abs(x - mean) / s
            worst = int(z.argmax())
            if len(x) < 3 or not (z[worst] > 3 and abs(x[worst] - mean) > 50):
                return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "mean": [mean], "n_used": [len(x)], "n_rejected": [len(rows) - len(x)]})
            keep = [k for k in range(len(x)) if k != worst]
            x, s = x[keep], s[keep]

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.lit(20.0) + F.col("event_id") % 5).alias("sigma"))
    return e.groupBy("user_id").applyInPandas(fuse, "user_id long, mean double, n_used long, n_rejected long")


@query("a13_presence_weights", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS present, count(*) FILTER (WHERE event_type = 'error') AS absent,
       CAST(sum(CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'error' THEN -2 ELSE 0 END) AS BIGINT) AS balance,
       coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS against
FROM events GROUP BY user_id
""")
def presence_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "view").alias("present"), F.count_if(kind == "error").alias("absent"),
        F.sum(F.when(kind == "view", 1).when(kind == "error", -2).otherwise(0)).alias("balance"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == "error", F.col("event_id")))), lambda x: x.cast("string")), ",").alias("against"),
    )


@query("a14_chronology", """
SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS first_seen, max(ts) FILTER (WHERE event_type = 'view') AS last_seen, min(ts) FILTER (WHERE event_type = 'error') AS first_gone FROM events GROUP BY user_id
""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, gone = F.when(F.col("event_type") == "view", F.col("ts")), F.when(F.col("event_type") == "error", F.col("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.min(gone).alias("first_gone"))


@query("a16_share_by_band", """
SELECT CASE WHEN l_extendedprice < 20000 THEN 'near' WHEN l_extendedprice < 60000 THEN 'middle' ELSE 'far' END AS band,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN l_discount > 0.05 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS share
FROM lineitem GROUP BY 1
""")
def share_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length in all and share of it inside a mask, by band of distance."""
    d, q = F.col("l_extendedprice"), F.col("l_quantity").cast("long")
    band = F.when(d < 20000, "near").when(d < 60000, "middle").otherwise("far").alias("band")
    return table(spark, sf_dir, "lineitem").groupBy(band).agg(F.sum(q).alias("total"), (F.sum(F.when(F.col("l_discount") > 0.05, q).otherwise(0)).cast("double") / F.sum(q).cast("double")).alias("share"))


@query("a18_precision_recall", """
WITH p AS (SELECT l.toxic = 1 AS truth, regexp_matches(d.text, '(?i)(idiot|stupid|trash|moron)') AS found FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT count(*) FILTER (WHERE truth AND found) AS hits, count(*) FILTER (WHERE NOT truth AND found) AS false_alarms, count(*) FILTER (WHERE truth AND NOT found) AS missed,
       CAST(count(*) FILTER (WHERE truth AND found) AS DOUBLE) / nullif(count(*) FILTER (WHERE found), 0) AS precise,
       CAST(count(*) FILTER (WHERE truth AND found) AS DOUBLE) / nullif(count(*) FILTER (WHERE truth), 0) AS recalled FROM p
""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("(?i)(idiot|stupid|trash|moron)").alias("found"))
    p = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("truth")).join(d, "doc_id")
    truth, found = F.col("truth"), F.col("found")
    hits = F.count_if(truth & found)
    return p.agg(
        hits.alias("hits"), F.count_if(~truth & found).alias("false_alarms"), F.count_if(truth & ~found).alias("missed"),
        F.try_divide(hits.cast("double"), F.count_if(found)).alias("precise"), F.try_divide(hits.cast("double"), F.count_if(truth)).alias("recalled"),
    )


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank with ties at their mean place."""
    w = Window.partitionBy(*(by or []))
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*(by or []), x)) - 1) / 2


@query("a19_rank_correlation", """
WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a,
           rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part)
SELECT p_brand, CAST(round(corr(a, b) * 1000000) AS BIGINT) AS spearman_millionths FROM r GROUP BY p_brand
""")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", average_rank("p_size", ["p_brand"]).alias("a"), average_rank("p_retailprice", ["p_brand"]).alias("b"))
    return p.groupBy("p_brand").agg(F.round(F.corr("a", "b") * 1000000).cast("long").alias("spearman_millionths"))


@query("a20_raking", None)
def raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative proportional fitting of a small table (nation by segment) to equal margins; the seed is one aggregate."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = F.lit(1.0)
    for _ in range(8):
        c = c.withColumn("w", F.col("w") * rows / F.sum("w").over(Window.partitionBy("c_nationkey")))
        c = c.withColumn("w", F.col("w") * 5.0 / F.sum("w").over(Window.partitionBy("c_mktsegment")))
    return c.select("c_nationkey", "c_mktsegment", "w")


@query("a21_bounding_box", "SELECT min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.min("l_quantity").alias("x0"), F.min("l_extendedprice").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_extendedprice").alias("y1"))


@query("a22_collapse_profiles", """
WITH g AS (SELECT p_brand || '|' || p_type || '|' || floor(p_size / 10)::INT AS profile, min(p_partkey) AS first_seen, count(*) AS n FROM part GROUP BY 1)
SELECT profile, n, row_number() OVER (ORDER BY first_seen) AS profile_id FROM g
""")
def collapse_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal profiles made one, numbered by first appearance."""
    profile = F.concat_ws("|", "p_brand", "p_type", F.floor(F.col("p_size") / 10).cast("int").cast("string"))
    g = table(spark, sf_dir, "part").groupBy(profile.alias("profile")).agg(F.min("p_partkey").alias("first_seen"), F.count(F.lit(1)).alias("n"))
    return g.select("profile", "n", F.row_number().over(Window.orderBy("first_seen")).cast("long").alias("profile_id"))


@query("a23_valence", "SELECT l_partkey, count(DISTINCT l_orderkey) AS valence FROM lineitem GROUP BY l_partkey")
def valence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that touch a vertex, each once."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("valence"))


@query("a24_coverage_pivot", """
SELECT c_nationkey, count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE') AS automobile, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1
""")
def coverage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))
    return out.select("c_nationkey", *[F.coalesce(c, F.lit(0)).cast("long").alias(c.lower()) for c in ("AUTOMOBILE", "BUILDING", "MACHINERY")])


@query("a25_phase", """
WITH m AS (SELECT user_id % 10 AS g, sum(CAST(round(sin(2 * pi() * (CAST(floor(value * 100) AS BIGINT) % 500) / 500.0) * 1000000) AS BIGINT)) AS s,
                  sum(CAST(round(cos(2 * pi() * (CAST(floor(value * 100) AS BIGINT) % 500) / 500.0) * 1000000) AS BIGINT)) AS c FROM events GROUP BY 1)
SELECT g, CAST(round(atan2(s, c) / (2 * pi()) * 500 * 1000) AS BIGINT) AS phase FROM m
""")
def phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of a pattern of period 500: its circular mean."""
    t = 2 * F.pi() * (hundredths("value") % 500) / 500.0
    parts = [F.sum(F.round(f(t) * 1000000).cast("long")) for f in (F.sin, F.cos)]
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("g")).agg(F.round(F.atan2(*parts) / (2 * F.pi()) * 500 * 1000).cast("long").alias("phase"))


@query("a26_robust_score", """
WITH m AS (SELECT event_type, median(CAST(floor(value * 100) AS BIGINT)) AS mid FROM events GROUP BY 1),
d AS (SELECT e.event_type, median(abs(CAST(floor(e.value * 100) AS BIGINT) - m.mid)) AS mad FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1)
SELECT e.event_id, (CAST(floor(e.value * 100) AS BIGINT) - m.mid) / d.mad AS score FROM events e JOIN m ON e.event_type = m.event_type JOIN d ON e.event_type = d.event_type WHERE e.value > 450
""")
def robust_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess over the median in median absolute deviations; the group tables are joined, rows are not gathered."""
    e = table(spark, sf_dir, "events").withColumn("x", hundredths("value"))
    mid = e.groupBy("event_type").agg(F.median("x").alias("mid"))
    both = e.join(mid, "event_type")
    mad = both.groupBy("event_type").agg(F.median(F.abs(F.col("x") - F.col("mid"))).alias("mad"))
    return both.filter("value > 450").join(mad, "event_type").select("event_id", ((F.col("x") - F.col("mid")) / F.col("mad")).alias("score"))


@query("a27_weighted_least_squares", """
WITH v AS (SELECT user_id, CAST(floor(value * 100) AS BIGINT) AS y, CAST(json_extract_string(props, '$.k') AS BIGINT) AS x, 1 + event_id % 3 AS w FROM events),
s AS (SELECT user_id, CAST(sum(w) AS DOUBLE) AS s0, CAST(sum(w * x) AS DOUBLE) AS sx, CAST(sum(w * y) AS DOUBLE) AS sy, CAST(sum(w * x * x) AS DOUBLE) AS sxx, CAST(sum(w * x * y) AS DOUBLE) AS sxy FROM v GROUP BY 1)
SELECT user_id, CASE WHEN s0 * sxx - sx * sx <> 0 THEN (s0 * sxy - sx * sy) / (s0 * sxx - sx * sx) END AS slope FROM s
""")
def weighted_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations from whole-number sums."""
    k = F.get_json_object("props", "$.k").cast("long")
    v = table(spark, sf_dir, "events").select("user_id", hundredths("value").alias("y"), k.alias("x"), (1 + F.col("event_id") % 3).alias("w"))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    s = v.groupBy("user_id").agg(*[F.sum(e).cast("double").alias(n) for n, e in {"s0": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "sxy": w * x * y}.items()])
    det = F.col("s0") * F.col("sxx") - F.col("sx") * F.col("sx")
    return s.select("user_id", F.when(det != 0, (F.col("s0") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("slope"))


@query("a17_block_change", """
WITH b AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS bx, CAST(floor(l_extendedprice / 20000) AS BIGINT) AS by_, count(*) AS n, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2)
SELECT bx, by_, n, s, s::DOUBLE / n >= (SELECT quantile_cont(s::DOUBLE / n, 0.9) FROM b) AS changed FROM b
""")
def block_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks pooled, and marked where the mean passes the 90th percentile over the blocks (a one-row table)."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 10).alias("bx"), F.floor(F.col("l_extendedprice") / 20000).alias("by_")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("s")
    )
    mean = F.col("s").cast("double") / F.col("n")
    limit = b.agg(F.percentile(mean, 0.9).alias("limit"))
    return b.crossJoin(F.broadcast(limit)).select("bx", "by_", "n", "s", (mean >= F.col("limit")).alias("changed"))
