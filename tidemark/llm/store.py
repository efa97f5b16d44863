"""Tables that cut lineage, written in the folder all executors share."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no checkpoint folder, as in tests.
FALLBACK = "file:///tmp/checkpoints"
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A cluster must name one: its executors share no other."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or FALLBACK


def cut(df: DataFrame, name: str, release: bool = False, batch: int = 2000) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The copy survives the loss of any executor and nothing before it runs again. Shuffle files that led to it are of
    no use then. Spark deletes them when the driver's collector finds them unreferenced; after a large shuffle,
    ``release`` asks it to look, twice, since what the first look finds may hold on to more. Python workers get at most
    ``batch`` rows at once: rows hold whole texts, sets or sketches, and a worker has little memory.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(ROWS)
    spark.conf.set(ROWS, min(batch, int(rows)) if int(rows) > 0 else batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ROWS, rows)
    for _ in range(2 * release):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that no result needs any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._tidemark_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
