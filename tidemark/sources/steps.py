"""Tables that a computation writes on its way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no checkpoint folder, as in tests.
FALLBACK = "file:///tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir. A cluster must name one: its executors share no other."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = FALLBACK
    return f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: what follows may use it more than once, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
