"""Tables and queries of a database, over JDBC.

Filters and column lists of what is built on them go to the database. A table can be read in parts by ranges of a whole
number or a day, so that executors share the work; the ends of the range come from the database by one small query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _reader(spark: SparkSession, url: str, options: dict[str, str]):
    return spark.read.format("jdbc").option("url", url).options(**options)


def database_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """The rows of a query that the database runs. Spark's own filters on it are added to the query."""
    return _reader(spark, url, options).option("query", sql).load()


def database_table(spark: SparkSession, url: str, table: str, by: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table; with ``by``, a numeric or date column, in ``parts`` ranges of it. Rows where ``by`` is null are in the
    first part; a table without other rows is read in one."""
    reader = _reader(spark, url, options).option("dbtable", table)
    if by is not None:
        low, high = database_query(spark, url, f'select min("{by}") as low_end, max("{by}") as high_end from {table}', **options).first()
        if low is not None:
            reader = reader.option("partitionColumn", by).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts)
    return reader.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a table, by as many connections as ``df`` has partitions. ``overwrite`` empties the table and keeps its
    definition and indexes."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", True).options(**options).mode(mode).save()


def newest_run(spark: SparkSession, url: str, table: str, run: str, **options: str) -> DataFrame:
    """Rows of the newest run: the database looks for it and sends only its rows."""
    return database_query(spark, url, f'select * from {table} where "{run}" = (select max("{run}") from {table})', **options).where(F.col(run).isNotNull())
