"""What the operators of this subpackage share: reading columns, durable cuts of lineage, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Since Spark 4.1; an older one keeps the files until its own cleaner comes.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; only a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="shared-")
    return shared.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder, so a lost executor costs no earlier step.

    The shuffle files of the step go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: for the rounds of a loop, whose tables are small and many."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that durable() made and no later step reads."""
    for df in tables:
        hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Id as long, whole text as bytes (null: empty), and the columns in more."""
    return df.select(
        F.col(id_col).cast("long").alias(id_col),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias(text_col),
        *more,
    )


def rowwise(kernel: Callable[[list], Iterator[tuple]], schema: pa.Schema, chunk_bytes: int = 8 << 20) -> Callable:
    """A mapInArrow function: kernel gets the columns of a slice as lists and returns output rows.

    A slice ends after chunk_bytes of input, so that memory follows the longest text, not the batch.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, chunk_bytes):
                rows = list(kernel(*[c.to_pylist() for c in part.columns]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                    )

    return run


def slices(batch: pa.RecordBatch, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, batch.num_rows * chunk_bytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
