"""Writes that can be repeated: partitions, runs, and keys that are replaced or left as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def overwrite_observed(df: DataFrame, path: str, rates: dict[str, Column]) -> dict[str, float | int | None]:
    """Writes ``df`` and says of each condition in ``rates`` which share of the rows meets it (null counts as not), and how
    many rows there are (``rows``): taken while the rows are written, without a second scan. Null shares without rows."""
    seen = Observation("rates")
    met = [F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(name) for name, c in rates.items()]
    overwrite(df.observe(seen, F.count(F.lit(1)).alias("rows"), *met), path)
    got = seen.get
    return {"rows": got["rows"], **{name: got[name] / got["rows"] if got["rows"] else None for name in rates}}


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others: a second write of the same rows changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def with_run_id(df: DataFrame) -> DataFrame:
    """``run_id`` from the run's day and model, the same whenever the run is repeated."""
    return df.withColumn("run_id", F.xxhash64(F.col("run_date").cast("string"), "model"))


def replace_run(df: DataFrame, path: str) -> None:
    replace_partitions(with_run_id(df), path, "run_date", "model")


def new_rows(df: DataFrame, old: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key ``old`` lacks, the first of each key by ``order``: what an insert that ignores conflicts adds."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*").select(*df.columns)
    return first.join(old.select(*keys), keys, "left_anti")


def insert_if_absent(spark: SparkSession, df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    new_rows(df, spark.read.parquet(path), keys, order).write.mode("append").parquet(path)


def retained(df: DataFrame, day: str, as_of: str, days: int = 90) -> DataFrame:
    return df.where(F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_partitions_before(spark: SparkSession, path: str, partition: str, first: str) -> int:
    """Deletes whole partitions whose day (in the folder's name) is before ``first``, and says how many: nothing is read
    or written, and a second call finds none. Rows without a day stay."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith(f"{partition}=") and s.getPath().getName().split("=", 1)[1] < first[:10]]
    old = [p for p in old if p.getName().split("=", 1)[1][:1].isdigit()]  # not the default partition of nulls
    for p in old:
        fs.delete(p, True)
    return len(old)


def prune(spark: SparkSession, path: str, partition: str, as_of: str, days: int = 90) -> int:
    """Retention of a table that is partitioned by day: partitions older than so many days before ``as_of`` go."""
    import datetime

    first = datetime.date.fromisoformat(as_of) - datetime.timedelta(days=days)
    return drop_partitions_before(spark, path, partition, first.isoformat())


def layout_by_card(df: DataFrame, table: str, buckets: int = 64, by: str = "card_id", order: str = "date") -> None:
    """A catalog table in buckets of a card, each in the order of cards and days: what is asked by card, and joins by card,
    then need no exchange. Joins by card and day need none where spark.sql.requireAllClusterKeysForCoPartition is off. It
    takes the place of an index on the card."""
    df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by, order).format("parquet").saveAsTable(table)


def create_if_absent(spark: SparkSession, table: str, columns: str, path: str) -> None:
    """A table over a folder, unless there is one of that name; what it has stays. Keys are for ``insert_if_absent``."""
    spark.sql(f"create table if not exists {table} ({columns}) using parquet location '{path}'")
