"""Window operators on trajectories and profiles: headways, runs, overlays, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..registry import hundredths, query, table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectories: agent, time in microseconds, value in hundredths."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("agent"), "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), hundredths("value").alias("x"))


STEPS = "s AS (SELECT event_id, user_id AS agent, event_type, epoch_us(ts) AS t, CAST(floor(value * 100) AS BIGINT) AS x FROM events)"
W = "(PARTITION BY agent ORDER BY t, event_id)"


def by_agent() -> WindowSpec:
    return Window.partitionBy("agent").orderBy("t", "event_id")


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, pos: str) -> DataFrame:
    """Maximal runs of rows whose flag is true: keys, first and last position, number of rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    marked = marked.withColumn("_new", (F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_f")
    return marked.groupBy(*keys, "_run").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count(F.lit(1)).alias("n")).drop("_run")


@query("n01_headway", f"WITH {STEPS} SELECT event_id, row_number() OVER {W} AS rank, t - lag(t, 1, 0) OVER {W} AS headway FROM s")
def headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    return s.select("event_id", F.row_number().over(by_agent()).cast("long").alias("rank"), (F.col("t") - F.lag("t", 1, 0).over(by_agent())).alias("headway"))


@query("n01b_headway_by_rank", f"""
WITH {STEPS}, h AS (SELECT row_number() OVER {W} AS rank, t - lag(t) OVER {W} AS h FROM s) SELECT rank, count(h) AS n, CAST(sum(h) AS BIGINT) AS total FROM h WHERE rank <= 20 GROUP BY rank
""")
def headway_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = steps(spark, sf_dir).select(F.row_number().over(by_agent()).cast("long").alias("rank"), (F.col("t") - F.lag("t").over(by_agent())).alias("h"))
    return h.filter("rank <= 20").groupBy("rank").agg(F.count("h").alias("n"), F.sum("h").alias("total"))


@query("n02_jerk", f"""
WITH {STEPS}, d AS (SELECT event_id, x - lag(x) OVER {W} AS dx, event_type = 'error' OR coalesce(lag(event_type) OVER {W} = 'error', false) AS masked FROM s)
SELECT event_id, dx FROM d WHERE NOT masked AND dx IS NOT NULL
""")
def jerk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of neighbours, but where either is masked."""
    d = steps(spark, sf_dir).select(
        "event_id", (F.col("x") - F.lag("x").over(by_agent())).alias("dx"),
        ((F.col("event_type") == "error") | F.coalesce(F.lag("event_type").over(by_agent()) == "error", F.lit(False))).alias("masked"),
    )
    return d.filter("NOT masked AND dx IS NOT NULL").select("event_id", "dx")


@query("n03_onset", f"WITH {STEPS} SELECT agent, min(t) FILTER (WHERE x > 30000 AND event_type = 'click') AS onset FROM s GROUP BY agent")
def onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("agent").agg(F.min(F.when((F.col("x") > 30000) & (F.col("event_type") == "click"), F.col("t"))).alias("onset"))


@query("n04_peak_after_start", f"""
WITH {STEPS}, m AS (SELECT *, count(*) FILTER (WHERE event_type = 'click') OVER {W} AS started FROM s),
k AS (SELECT *, row_number() OVER {W} AS i FROM m WHERE started > 0)
SELECT agent, max(x) AS peak, min_by(event_id, -x * 1000000 + i) AS at_event FROM k WHERE i <= 10 GROUP BY agent
""")
def peak_after_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value, and where, in the first 10 steps after the first motion."""
    running = by_agent().rowsBetween(Window.unboundedPreceding, 0)
    m = steps(spark, sf_dir).withColumn("started", F.count_if(F.col("event_type") == "click").over(running)).filter("started > 0")
    k = m.withColumn("i", F.row_number().over(by_agent())).filter("i <= 10")
    return k.groupBy("agent").agg(F.max("x").alias("peak"), F.min_by("event_id", -F.col("x") * 1000000 + F.col("i")).alias("at_event"))


@query("n05_neighbour_speed", f"""
WITH {STEPS}, v AS (SELECT agent, abs(lead(x) OVER {W} - lag(x) OVER {W}) AS dx, lead(t) OVER {W} - lag(t) OVER {W} AS dt FROM s)
SELECT agent, count(*) AS n, median(dx) AS speed FROM v WHERE dt <= 36000000000 GROUP BY agent HAVING count(*) >= 3
""")
def neighbour_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = lambda c: F.lead(c).over(by_agent()) - F.lag(c).over(by_agent())
    v = steps(spark, sf_dir).select("agent", F.abs(over("x")).alias("dx"), over("t").alias("dt")).filter("dt <= 36000000000")
    return v.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.median("dx").alias("speed")).filter("n >= 3")


@query("n06_running_median", f"WITH {STEPS} SELECT event_id, median(x) OVER (PARTITION BY agent ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM s")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("event_id", F.percentile("x", 0.5).over(by_agent().rowsBetween(-2, 2)).alias("smooth"))


@query("n07_runs", f"""
WITH {STEPS}, f AS (SELECT *, x > 10000 AS f, row_number() OVER {W} AS i FROM s), g AS (SELECT *, i - row_number() OVER (PARTITION BY agent, f ORDER BY i) AS g FROM f)
SELECT agent, min(t) AS start, max(t) AS stop, count(*) AS n FROM g WHERE f GROUP BY agent, g
""")
def runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(steps(spark, sf_dir), ["agent"], ["t", "event_id"], F.col("x") > 10000, "t")


@query("n07b_gap_sessions", f"""
WITH {STEPS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER {W} <= 7200000000 THEN 0 ELSE 1 END AS new FROM s), k AS (SELECT *, sum(new) OVER {W} AS session FROM g)
SELECT agent, CAST(session AS BIGINT) AS session, count(*) AS n, max(t) - min(t) AS lasted FROM k GROUP BY agent, session
""")
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("t") - F.lag("t").over(by_agent()) <= 7200000000, 0).otherwise(1)
    k = steps(spark, sf_dir).withColumn("new", new).withColumn("session", F.sum("new").over(by_agent().rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("agent", "session").agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("lasted"))


@query("n08_abscissa", f"WITH {STEPS}, d AS (SELECT *, abs(x - lag(x, 1, x) OVER {W}) AS dx FROM s) SELECT event_id, CAST(sum(dx) OVER {W} AS BIGINT) AS s FROM d")
def abscissa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = steps(spark, sf_dir).withColumn("dx", F.abs(F.col("x") - F.coalesce(F.lag("x").over(by_agent()), F.col("x"))))
    return d.select("event_id", F.sum("dx").over(by_agent().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


@query("n09_turns", f"WITH {STEPS}, c AS (SELECT event_id, lag(x) OVER {W} - 2 * x + lead(x) OVER {W} AS bend FROM s) SELECT event_id, bend FROM c WHERE abs(bend) > 20000")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bend = F.lag("x").over(by_agent()) - 2 * F.col("x") + F.lead("x").over(by_agent())
    return steps(spark, sf_dir).select("event_id", bend.alias("bend")).filter("abs(bend) > 20000")


@query("n10_slope_over_distance", f"WITH {STEPS} SELECT event_id, max(x) OVER r - min(x) OVER r AS rise, count(*) OVER r AS n FROM s WINDOW r AS (PARTITION BY agent ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def slope_over_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Window.partitionBy("agent").orderBy("t").rangeBetween(-3_600_000_000, 0)
    return steps(spark, sf_dir).select("event_id", (F.max("x").over(r) - F.min("x").over(r)).alias("rise"), F.count(F.lit(1)).over(r).alias("n"))


@query("n11_platoon_rank", f"""
WITH {STEPS}, g AS (SELECT *, CASE WHEN t - lag(t) OVER {W} <= 7200000000 THEN 0 ELSE 1 END AS new FROM s), k AS (SELECT *, sum(new) OVER {W} AS p FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY agent, p ORDER BY t, event_id) AS place FROM k) SELECT place, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM r GROUP BY place
""")
def platoon_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("t") - F.lag("t").over(by_agent()) <= 7200000000, 0).otherwise(1)
    k = steps(spark, sf_dir).withColumn("new", new).withColumn("p", F.sum("new").over(by_agent().rowsBetween(Window.unboundedPreceding, 0)))
    r = k.withColumn("place", F.row_number().over(Window.partitionBy("agent", "p").orderBy("t", "event_id")).cast("long"))
    return r.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("n12_profile_on_grid", f"""
WITH {STEPS}, b AS (SELECT agent, t, x, lead(t) OVER {W} AS t2, lead(x) OVER {W} AS x2 FROM s),
g AS (SELECT b.*, unnest(range((t + 86399999999) // 86400000000, (t2 - 1) // 86400000000 + 1)) AS d FROM b WHERE t2 > t),
v AS (SELECT d, CAST(floor(x * 1000 + (x2 - x) * 1000 * ((d * 86400000000 - t) // 1000000) / greatest((t2 - t) // 1000000, 1)) AS BIGINT) AS v FROM g)
SELECT d, count(*) AS n, quantile_disc(v, 0.5) AS p50, max(v) AS top FROM v GROUP BY d
""")
def profile_on_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories interpolated at each day's start, and their middle and top over the agents."""
    day, sec = 86_400_000_000, 1_000_000
    b = steps(spark, sf_dir).select("agent", "t", "x", F.lead("t").over(by_agent()).alias("t2"), F.lead("x").over(by_agent()).alias("x2")).filter("t2 > t")
    days = F.expr(f"CASE WHEN (t2 - 1) div {day} >= (t + {day} - 1) div {day} THEN sequence((t + {day} - 1) div {day}, (t2 - 1) div {day}) ELSE array() END")
    g = b.withColumn("d", F.explode(days))
    part = (F.col("x2") - F.col("x")) * 1000 * F.expr(f"(d * {day} - t) div {sec}") / F.greatest(F.expr(f"(t2 - t) div {sec}"), F.lit(1))
    v = g.select("d", F.floor(F.col("x") * 1000 + part).alias("v"))
    return v.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").cast("long").alias("p50"), F.max("v").alias("top"))


@query("n13_slowest_ahead", f"WITH {STEPS} SELECT event_id, min(x) OVER (PARTITION BY agent ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slowest FROM s")
def slowest_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("event_id", F.min("x").over(by_agent().rowsBetween(Window.unboundedPreceding, -1)).alias("slowest"))


@query("n14_closed_ring_smoothing", f"""
WITH {STEPS}, r AS (SELECT *, row_number() OVER {W} AS i, count(*) OVER (PARTITION BY agent) AS n FROM s)
SELECT a.event_id, CAST(b.x + 2 * a.x + c.x AS BIGINT) AS smooth4 FROM r a
JOIN r b ON a.agent = b.agent AND b.i = (a.i + a.n - 2) % a.n + 1 JOIN r c ON a.agent = c.agent AND c.i = a.i % a.n + 1
""")
def closed_ring_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 1 round a closed ring: the ends meet."""
    ordered = by_agent().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("x").over(by_agent()), F.last("x").over(ordered))
    after = F.coalesce(F.lead("x").over(by_agent()), F.first("x").over(ordered))
    return steps(spark, sf_dir).select("event_id", (before + 2 * F.col("x") + after).alias("smooth4"))


def overlay(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Intervals (key, s0, s1, attr) of base cut by those of over, which win: a partition of the base intervals."""
    both = base.withColumn("pri", F.lit(0)).unionByName(over.withColumn("pri", F.lit(1)))
    cuts = both.select(key, F.explode(F.array("s0", "s1")).alias("at")).distinct()
    w = Window.partitionBy(key).orderBy("at")
    parts = cuts.select(key, F.col("at").alias("a"), F.lead("at").over(w).alias("b")).filter("b IS NOT NULL")
    hit = parts.join(both, key).filter("s0 <= a AND b <= s1")
    return hit.groupBy(key, "a", "b").agg(F.max_by("attr", F.struct("pri", "s0", "attr")).alias("attr"))


@query("n15_interval_overlay", """
WITH base AS (SELECT o_custkey AS k, CAST(0 AS BIGINT) AS s0, CAST(1000 AS BIGINT) AS s1, 'base' AS attr, 0 AS pri FROM orders GROUP BY o_custkey),
ov AS (SELECT o_custkey AS k, o_orderkey % 900 AS s0, o_orderkey % 900 + 1 + o_orderkey % 90 AS s1, 'o' || (o_orderkey % 900) AS attr, 1 AS pri FROM orders),
b AS (SELECT * FROM base UNION ALL SELECT * FROM ov), cuts AS (SELECT DISTINCT k, unnest([s0, s1]) AS c FROM b),
p AS (SELECT k, c AS a, lead(c) OVER (PARTITION BY k ORDER BY c) AS b FROM cuts),
h AS (SELECT p.k, p.a, p.b, b.attr, row_number() OVER (PARTITION BY p.k, p.a, p.b ORDER BY b.pri DESC, b.s0 DESC, b.attr DESC) AS n FROM p JOIN b ON p.k = b.k AND b.s0 <= p.a AND p.b <= b.s1)
SELECT k, a, b, attr FROM h WHERE n = 1
""")
def interval_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 900).alias("s0"), F.col("o_orderkey"))
    over = o.select("k", "s0", (F.col("s0") + 1 + F.col("o_orderkey") % 90).alias("s1"), F.concat(F.lit("o"), F.col("s0").cast("string")).alias("attr"))
    base = o.select("k").distinct().select("k", F.lit(0).cast("long").alias("s0"), F.lit(1000).cast("long").alias("s1"), F.lit("base").alias("attr"))
    return overlay(base, over, "k")


@query("n16_merge_short_runs", None)
def merge_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs shorter than three rows go to the neighbour of the closest median, the shortest first, until none is left."""
    import pandas as pd

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "event_id"])
        level = (rows["x"] // 10000).tolist()
        parts: list[list[int]] = []
        for k, v in enumerate(level):
            if parts and level[parts[-1][-1]] == v:
                parts[-1].append(k)
            else:
                parts.append([k])
        x = rows["x"].tolist()
        middle = lambda p: sorted(x[k] for k in p)[len(p) // 2]
        while len(parts) > 1 and (short := min(range(len(parts)), key=lambda i: (len(parts[i]), i))) is not None and len(parts[short]) < 3:
            near = [i for i in (short - 1, short + 1) if 0 <= i < len(parts)]
            to = min(near, key=lambda i: (abs(middle(parts[i]) - middle(parts[short])), i))
            a, b = min(short, to), max(short, to)
            parts[a : b + 1] = [parts[a] + parts[b]]
        return pd.DataFrame([(rows["agent"].iloc[0], n, len(p), middle(p)) for n, p in enumerate(parts)], columns=["agent", "part", "n", "middle"])

    return steps(spark, sf_dir).groupBy("agent").applyInPandas(merge, "agent long, part long, n long, middle long")


@query("n17_largest_gap", """
WITH i AS (SELECT o_custkey AS k, o_orderkey % 900 AS s0, o_orderkey % 900 + 10 AS s1 FROM orders),
m AS (SELECT k, s0, max(s1) OVER (PARTITION BY k ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, max(s1) OVER (PARTITION BY k) AS last FROM i)
SELECT k, greatest(max(s0 - coalesce(reach, 0)), 1000 - max(last)) AS gap FROM m GROUP BY k
""")
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest free part of [0, 1000] between obstacles."""
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 900).alias("s0"))
    i = i.withColumn("s1", F.col("s0") + 10)
    w = Window.partitionBy("k").orderBy("s0", "s1").rowsBetween(Window.unboundedPreceding, -1)
    m = i.withColumn("reach", F.coalesce(F.max("s1").over(w), F.lit(0)))
    return m.groupBy("k").agg(F.greatest(F.max(F.col("s0") - F.col("reach")), 1000 - F.max("s1")).alias("gap"))


@query("n18_low_stretches", f"""
WITH {STEPS}, f AS (SELECT *, x < 8000 AS f, row_number() OVER (PARTITION BY agent, event_type ORDER BY t, event_id) AS i FROM s),
g AS (SELECT *, i - row_number() OVER (PARTITION BY agent, event_type, f ORDER BY i) AS g FROM f)
SELECT agent, event_type, min(t) AS start, max(t) AS stop, count(*) AS n FROM g WHERE f GROUP BY agent, event_type, g HAVING count(*) >= 2
""")
def low_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low runs of each source along a profile."""
    return runs(steps(spark, sf_dir), ["agent", "event_type"], ["t", "event_id"], F.col("x") < 8000, "t").filter("n >= 2")


@query("n19_row_continuity", """
WITH i AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber * 10 + l_partkey % 3 AS s0, l_linenumber * 10 + 9 + l_suppkey % 4 AS s1, l_partkey, l_suppkey FROM lineitem),
w AS (SELECT k, n, lead(s0) OVER (PARTITION BY k ORDER BY n, s0, s1) - s1 AS gap FROM i)
SELECT k, count(*) FILTER (WHERE gap > 1) AS gaps, count(*) FILTER (WHERE gap < 0) AS overlaps FROM w GROUP BY k
""")
def row_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("l_linenumber") * 10
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (base + F.col("l_partkey") % 3).alias("s0"), (base + 9 + F.col("l_suppkey") % 4).alias("s1"))
    gap = F.lead("s0").over(Window.partitionBy("k").orderBy("n", "s0", "s1")) - F.col("s1")
    return i.withColumn("gap", gap).groupBy("k").agg(F.count_if(F.col("gap") > 1).alias("gaps"), F.count_if(F.col("gap") < 0).alias("overlaps"))
