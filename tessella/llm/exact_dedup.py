"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters (the range partitioner's) deal the rows out by a short prefix of the text, a hash
of the whole text and a salt; an external sort places equal texts next to each other; the window
operator then compares each whole text with its neighbour and the row with the best identifier of
each run stays. Prefix and hash only route rows: texts are equal when all their bytes are.

Skew: a text whose copies exceed 1/4096 of all rows is salted by its identifier, so that its run is
cut into many; there are at most 4096 such texts. The leaders of the cut runs are then merged by
whole text, and the result (a row a text, at most 4096, named by hash and SHA-256) is broadcast. Rows of one
identifier, and rows without one, have one salt, so one cut run of a text holds its best identifier.

Range keys are bounded because Spark's splitters are sampled rows that reach the driver: whole
texts as keys would bring it megabytes a row.

Defined cases: null text counts as empty. Rows with the same text and the same identifier: one
stays. A null identifier loses to any other; where all are null, one row stays. Texts of any length are
compared whole. An empty table gives an empty result. Further columns are untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

HOT_PARTS = 4096
SALTS = 64


def _hot(keys: DataFrame, rows: int) -> list[int]:
    """Hashes of texts with over 1/HOT_PARTS of the rows, at most HOT_PARTS of them."""
    if rows == 0:
        return []
    counted = keys.groupBy("_h").count().filter(F.col("count") > max(1000, rows // HOT_PARTS))
    return [r[0] for r in counted.select("_h").collect()]


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "max", carry: tuple = ()) -> DataFrame:
    """One row per input row: _id, _text (normalised), _keep (identifier that stays), _size, _stays, and _row.

    _row is a struct of the columns in carry; _null: the text was null. keep: "max" or "min" identifier. normalise: Column -> Column.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    best, order = (F.max, Column.desc_nulls_last) if keep == "max" else (F.min, Column.asc_nulls_last)
    hashed = df.select(text.alias("_text")).select(F.xxhash64("_text").alias("_h"))
    hot = _hot(hashed, df.count())

    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row") if carry else F.lit(None).alias("_row"), F.col(text_col).isNull().alias("_null"), F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_h", F.xxhash64("_text")).withColumn("_p", F.substring("_text", 1, 12))
    salted = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    spark = df.sparkSession
    route = ["_p", "_h", "_s"] if hot else ["_p", "_h"]  # a constant among them would cost a second exchange
    if hot:
        table = spark.createDataFrame([(h,) for h in hot], "_h long").withColumn("_hot", F.lit(True))
        rows = rows.join(F.broadcast(table), "_h", "left").withColumn("_s", F.when(F.col("_hot"), salted).otherwise(F.lit(-1))).drop("_hot")
    else:
        rows = rows.withColumn("_s", F.lit(-1))

    run = Window.partitionBy(*route, "_text")
    ranked = (
        rows.repartitionByRange(*route)
        .withColumn("_rank", F.row_number().over(run.orderBy(order(F.col("_id")))))
        .withColumn("_lead", best("_id").over(run))
        .withColumn("_n", F.count(F.lit(1)).over(run))
    )
    if not hot:
        return ranked.select("_row", "_null", "_id", "_text", F.col("_lead").alias("_keep"), F.col("_n").alias("_size"), (F.col("_rank") == 1).alias("_stays"))

    # Rows of hot texts only, one for each cut run after the partial aggregation.
    digest = F.when(F.col("_s") >= 0, F.sha2(F.col("_text").cast("binary"), 256)).alias("_d")
    cut = rows.filter("_s >= 0").groupBy("_h", "_text", "_s").agg(best("_id").alias("_lead"), F.count(F.lit(1)).alias("_n"))
    merged = cut.groupBy("_h", "_text").agg(best("_lead").alias("_keep"), F.sum("_n").alias("_size")).select("_h", F.sha2(F.col("_text").cast("binary"), 256).alias("_d"), "_keep", "_size")
    out = ranked.withColumn("_d", digest).join(F.broadcast(merged), ["_h", "_d"], "left")
    keep_id = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("_lead"))
    return out.select(
        "_row", "_null", "_id", "_text", keep_id.alias("_keep"), F.coalesce("_size", "_n").alias("_size"),
        ((F.col("_rank") == 1) & F.col("_lead").eqNullSafe(keep_id)).alias("_stays"),
    )


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, dropped ones too."""
    return annotate(df, id_col, text_col, normalise, keep).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").cast("long").alias("group_size"),
        F.col("_stays").alias("kept"), F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "max") -> DataFrame:
    """The rows that stay, with the input's columns."""
    # The text travels once: as sorted, unless it was changed for the comparison.
    carry = tuple(c for c in df.columns if c != text_col or normalise)
    kept = annotate(df, id_col, text_col, normalise, keep, carry).filter("_stays")
    whole = F.when(~F.col("_null"), F.col("_text")).alias(text_col)
    return kept.select(*[F.col(f"_row.`{c}`") if c in carry else whole for c in df.columns])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
