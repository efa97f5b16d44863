"""Listings that wait for enrichment, as a job that runs again and again.

A stream of listings loses repeats of an item within a watermark's reach; each micro-batch then adds the items that the
queue's table hasn't got. A batch writes a partition of its own and leaves that out when it looks what is there, so a
batch that Spark repeats after a failure replaces itself and adds nothing twice. A run takes what has arrived and stops;
the next one goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import new_rows
from tidemark.sources.tables import read_or_empty

SCHEMA = "item_id string, id string, listing_title string"
CODEC = "spark.sql.streaming.stateStore.compression.codec"


def first_seen(listings: DataFrame, at: str, late: str = "30 days") -> DataFrame:
    """A stream of listings, each item once within ``late`` of the newest ``at``; older rows are dropped."""
    timed = listings.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(["item_id"]).select("item_id", "id", "listing_title")


def queued(spark: SparkSession, path: str) -> DataFrame:
    """All items that the queue has had, with the batch that brought them."""
    schema = spark.createDataFrame([], f"{SCHEMA}, batch bigint").schema
    return read_or_empty(spark, path, schema)


def add_batch(path: str):
    """What ``foreachBatch`` runs: inserts a batch's new items, the first of each by card and title."""

    def add(batch: DataFrame, number: int) -> None:
        before = queued(batch.sparkSession, path).where(F.col("batch") != number)
        new_rows(batch, before, ["item_id"], ["id", "listing_title"]).write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/batch={number}")

    return add


def run_queue(listings: DataFrame, at: str, path: str, checkpoint: str, late: str = "30 days") -> None:
    """Adds what has arrived since the last run, and stops."""
    stream = first_seen(listings, at, late).writeStream.foreachBatch(add_batch(path))
    conf = listings.sparkSession.conf
    before = conf.get(CODEC)
    conf.set(CODEC, "zstd")  # item ids are most of the state
    try:
        run = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # keeps the settings it starts with
    finally:
        conf.set(CODEC, before)
    run.awaitTermination()


def waiting(queue: DataFrame, enriched: DataFrame) -> DataFrame:
    """Items without an enrichment that worked: new ones, and those whose last try failed."""
    return queue.join(enriched.where("status = 'OK'").select("item_id"), "item_id", "left_anti")
