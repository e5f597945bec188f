"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch: texts are long rows, and a batch of them stands in memory of both the JVM and Python.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand Python batches within BATCH_LIMITS, unless its user has already asked for smaller ones.

    The setting is read when a query is planned, which is after the operator has returned, so it stays.
    """
    for name, limit in BATCH_LIMITS.items():
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= limit:
            spark.conf.set(name, str(limit))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; a local folder in its place only for a local master, whose executors are this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}/pressweave-shared"
    return path.rstrip("/")


def materialise(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder once and read it back.

    This cuts the lineage: rows survive lost executors and nothing upstream
    runs twice, which RDD checkpoints (they compute twice) don't offer. Row
    groups are small, as every writer holds one in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("table-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for df if its counted rows are within limit; else df as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def n_words(text: str = "text"):
    """Number of words in a text column; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
