"""Canonical views (prices, catalog, listings, forecasts) of the driver's tables, and readers of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

PRICE_SCHEMA = T.StructType([T.StructField("card_id", T.StringType()), T.StructField("date", T.DateType()), T.StructField("price", T.DoubleType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred where no schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON text, one object a line; a line that can't be read is a row of nulls."""
    return spark.read.schema(schema).json(path)


def files_by_id(spark: SparkSession, path: str, suffix: str, name: str = r"([^/.]+)[^/]*$") -> DataFrame:
    """(id, path) of all files under a folder with a suffix; the id is what ``name`` finds in the path, by default the
    file's name up to its first point, and empty if that finds nothing. Contents aren't read; empty files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path)
    return files.select(F.regexp_extract("path", name, 1).alias("id"), "path")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or an empty frame of ``schema`` where there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def with_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``: missing ones as null, others cast, further ones left out."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _daily(df: DataFrame, key: str, at: str, value) -> DataFrame:
    day = F.col(at).cast("date")
    return df.groupBy(F.col(key).cast("string").alias("card_id"), day.alias("date")).agg(F.round(F.avg(value), 9).alias("price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short dense series: a month of events for each user."""
    return _daily(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value"))


def long_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long series: years of unit prices for each supplier."""
    return _daily(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))


def sparse_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse series: unit prices for each part."""
    return _daily(table(spark, sf_dir, "lineitem"), "l_partkey", "l_shipdate", F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)))


def price_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as a guide publishes them: the mean of each month, on the first day of the next."""
    month = F.add_months(F.trunc("date", "month"), 1)
    return sparse_prices(spark, sf_dir).groupBy("card_id", month.alias("date")).agg(F.round(F.avg("price"), 6).alias("price"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("tcgplayer_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("rarity"),
        F.col("p_size").alias("cost"), F.col("p_retailprice").alias("retail"), F.date_add(F.lit("1994-12-01").cast("date"), F.col("p_size") * 10).alias("released_at"),
    )


def listings(spark: SparkSession, sf_dir: str, with_card: bool = False, by_card: bool = False) -> DataFrame:
    """Marketplace listings; a title is made of the part's words and what sellers add. With the columns of its card a
    listing needs no second join with the catalog. ``by_card`` deals out the rows by ``id`` before they get their titles:
    what groups them by card then moves no titles."""
    line, cat = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    line = line.withColumn("id", F.col("l_partkey").cast("string"))
    line = (line.repartition("id") if by_card else line).join(cat.withColumn("id", F.col("p_partkey").cast("string")), "id")
    extra = F.element_at(F.array(*[F.lit(x) for x in ("japanese", "fr", "box", "sleeve", "psa 10", "near mint", "italian")]), (F.col("l_linenumber") - 1) % 7 + 1)
    card = [F.col("p_name").alias("name"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("rarity"), F.col("p_size").alias("cost")] if with_card else []
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date")).alias("item_id"),
        "id", F.round(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)), 9).alias("price_val"),
        (F.col("l_returnflag") == "R").alias("is_graded"), F.col("l_shipdate").cast("date").alias("date_pulled"),
        F.concat_ws(" ", "p_name", "p_brand", "p_type", extra).alias("listing_title"), F.when(F.col("l_linestatus") == "O", "EPID").otherwise("TEXT").alias("pull_source"), *card,
    )


def runs(prices_: DataFrame) -> DataFrame:
    """Two forecast runs, 14 and 7 days before the last price."""
    last = prices_.agg(F.max("date").alias("last"))
    return last.select(F.explode(F.array(F.struct(F.lit(1).alias("run_id"), F.date_sub("last", 14).alias("run_date")), F.struct(F.lit(2).alias("run_id"), F.date_sub("last", 7).alias("run_date")))).alias("r")).select("r.*")


def forecasts(spark: SparkSession, sf_dir: str, horizon: int = 7) -> DataFrame:
    """Forecast panel of three models: the last price, the mean of the last seven, and the mean of both."""
    p = prices(spark, sf_dir)
    newest = W.partitionBy("card_id", "run_id").orderBy(F.desc("date"))
    past = p.join(F.broadcast(runs(p)), F.col("date") <= F.col("run_date")).withColumn("rn", F.row_number().over(newest)).where("rn <= 7")  # two runs
    base = past.groupBy("card_id", "run_id", "run_date").agg(F.max_by("price", "date").alias("last"), F.avg("price").alias("ma"))
    model = lambda n, c: F.struct(F.lit(n).alias("model"), F.round(c, 9).alias("pred_price"))
    each = base.select("card_id", "run_id", "run_date", F.explode(F.array(model("Last", F.col("last")), model("MA7", F.col("ma")), model("Mean", (F.col("last") + F.col("ma")) / 2))).alias("m"))
    days = each.select("card_id", "run_id", "run_date", "m.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return days.select("card_id", "run_id", "run_date", F.expr("date_add(run_date, h)").alias("target_date"), "model", "pred_price", F.round(F.col("pred_price") * 0.9, 9).alias("conf_low"), F.round(F.col("pred_price") * 1.1, 9).alias("conf_high"))


def nested_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested price histories: one variant for each return flag, with its prices at Unix seconds."""
    line = table(spark, sf_dir, "lineitem")
    point = F.struct(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("t"), F.round("l_extendedprice", 2).alias("p"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))
    variants = line.groupBy("l_suppkey", "l_returnflag").agg(F.sort_array(F.collect_list(point)).alias("priceHistory"))
    return variants.groupBy(F.col("l_suppkey").cast("string").alias("tcgplayerId")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("id"), "priceHistory"))).alias("variants"))
