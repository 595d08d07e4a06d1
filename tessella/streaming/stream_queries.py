"""Streaming forms of the window and grid operators: file sources, watermarks, sessions, state by key.

Each builder takes a streaming DataFrame of events and returns one; the queries run it over the events
table to its end (available-now) and return what the sink holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import hundredths, query


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream, with event time as a timestamp."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source takes a folder or a pattern.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to the end of its input into Parquet and reads that back.

    Update mode writes each batch's changed rows to a folder of its own, overwritten if the batch is
    replayed; of equal keys the last batch counts. State older than the watermark is dropped.
    Complete mode, for sessions that update mode lacks, rewrites the sink's folder in each batch and keeps all state.
    """
    folder = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", f"{folder}/out").start()
    elif mode == "update":
        running = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/_epoch={epoch}")).start()
    else:
        running = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    running.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    schema = stream.schema
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_epoch", T.LongType())])).parquet(f"{folder}/out/*").withColumn("_epoch", F.regexp_extract(F.input_file_name(), "_epoch=([0-9]+)", 1).cast("long"))
    others = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "_epoch").alias("_last")).select(*keys, *[f"_last.{c}" for c in others])


def hourly(stream: DataFrame, hours: int = 6, late: str = "1 day") -> DataFrame:
    """Tumbling windows by type; rows later than the watermark are left out."""
    w = F.window("ts", f"{hours} hours")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(hundredths("value")).alias("total"))


@query("stream1_tumbling", """
SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS six_hours, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2
""")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(spark, hourly(events_stream(spark, sf_dir)), "update", ["w", "event_type"])
    return out.select("event_type", F.floor(F.unix_timestamp("w.start") / 21600).alias("six_hours"), "n", "total")


@query("stream2_sliding", """
WITH e AS (SELECT CAST(floor(epoch(ts) / 43200) AS BIGINT) AS h FROM events) SELECT h - k AS half_day, count(*) AS n FROM e, (SELECT unnest([0, 1]) AS k) GROUP BY 1
""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day, every half day."""
    stream = events_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(spark, stream, "update", ["w"]).select(F.floor(F.unix_timestamp("w.start") / 43200).alias("half_day"), "n")


@query("stream3_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events),
k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM k GROUP BY user_id, s
""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return drained(spark, stream, "complete").select("user_id", F.unix_micros("w.start").alias("started"), "n")


@query("stream4_first_of_key", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key once, the state kept by key."""
    stream = events_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return drained(spark, stream).withColumn("seen", F.lit(True))


def headways(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Time since the agent's last event, across batches: the state is that event's time and the count."""
    last, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
    out = []
    for i, t in zip(rows["event_id"].tolist(), rows["t"].tolist(), strict=True):
        out.append((i, n + 1, None if last is None else t - last))
        last, n = t, n + 1
    state.update((last, n))
    yield pd.DataFrame(out, columns=["event_id", "rank", "headway"]).astype({"headway": "Int64"})


@query("stream5_stateful_headway", """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS headway FROM events
""")
def stateful_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events_stream(spark, sf_dir).select("user_id", "event_id", F.unix_micros("ts").alias("t"))
    stateful = stream.groupBy("user_id").applyInPandasWithState(headways, "event_id long, rank long, headway long", "last long, n long", "append", "NoTimeout")
    return drained(spark, stateful)


@query("stream6_static_join", "SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'purchase'")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    stream = events_stream(spark, sf_dir).filter("event_type = 'purchase'").join(c, "user_id").select("event_id", "c_mktsegment")
    return drained(spark, stream)


@query("stream7_band_join", """
SELECT a.event_id, b.event_id AS follower FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
""")
def stream_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams within a band of time; the watermarks bound what is kept."""
    a = events_stream(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", F.col("ts").alias("ta")).withWatermark("ta", "2 hours").alias("a")
    b = events_stream(spark, sf_dir).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("follower"), F.col("ts").alias("tb")).withWatermark("tb", "2 hours").alias("b")
    on = F.expr("a.user_id = b.user_id AND tb > ta AND tb <= ta + INTERVAL 1 HOUR")
    return drained(spark, a.join(b, on).select("event_id", "follower"))


def upsert(target: Callable[[], DataFrame | None], batch: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the batch's rows in place of those of equal keys."""
    old = target()
    return batch if old is None else old.join(batch.select(*keys), keys, "left_anti").unionByName(batch)
