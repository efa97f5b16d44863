"""Market summaries as of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .asof import asof_join
from .listings import on_latest_day


def latest_price(prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """Newest price of each card, on or before a day if one is given: an aggregate, so nothing is sorted."""
    df = prices if as_of is None else prices.where(F.col("date") <= F.lit(as_of).cast("date"))
    return df.groupBy("card_id").agg(F.max("date").alias("date"), F.max_by("price", F.struct("date", "price")).alias("price"))


def momentum(prices: DataFrame, days: int = 7) -> DataFrame:
    """Latest price against the latest at least ``days`` before the last day of all, from one aggregate by card."""
    last = prices.agg(F.max("date").alias("_last"))
    at, old = F.struct("date", "price"), F.col("date") <= F.date_sub("_last", days)
    both = prices.join(F.broadcast(last)).groupBy("card_id").agg(F.max_by("price", at).alias("price_cur"), F.max_by("price", F.when(old, at)).alias("price_past"), F.count(F.when(old, 1)).alias("_n"))
    change = F.col("price_cur") - F.col("price_past")
    return both.where("_n > 0").drop("_n").withColumns({"abs_change": change, "pct_change": 100 * change / F.nullif(F.col("price_past"), F.lit(0.0))})


def movers(change: DataFrame) -> DataFrame:
    """The card with the largest rise and fall, in per cent and in money; the first of equal ones. One aggregate finds all
    four; a card whose change isn't known is none of them."""
    whole = F.struct(*change.columns)
    first = lambda c, sign: F.min_by(whole, F.when(F.col(c).isNotNull(), F.struct((sign * F.col(c)).alias("c"), "card_id")))
    ways = {"top_pct": ("pct_change", -1), "low_pct": ("pct_change", 1), "top_abs": ("abs_change", -1), "low_abs": ("abs_change", 1)}
    one = change.agg(*[first(*how).alias(tag) for tag, how in ways.items()])
    each = one.select(F.explode(F.array(*[F.struct(F.col(tag).alias("r"), F.lit(tag).alias("tag")) for tag in ways])).alias("e")).select("e.*")
    return each.where("r is not null").select("r.*", "tag")


def sparkline(prices: DataFrame, cards: DataFrame, days: int = 7) -> DataFrame:
    last = prices.agg(F.max("date").alias("_last"))
    recent = prices.join(F.broadcast(last), F.col("date") > F.date_sub("_last", days)).drop("_last")
    return cards.select("card_id", "tag").join(recent, "card_id", "left")


def volume_by_day(listings: DataFrame) -> DataFrame:
    return listings.groupBy("date_pulled", "is_graded").agg(F.count(F.lit(1)).alias("n"))


def float_value(listings: DataFrame, prices: DataFrame) -> DataFrame:
    """Ungraded listings at today's price, by day. Listings are counted by card and day before the join."""
    n = listings.where(~F.col("is_graded")).groupBy("date_pulled", "id").agg(F.count(F.lit(1)).alias("n"))
    now = latest_price(prices).select(F.col("card_id").alias("id"), "price")
    return n.join(now, "id", "left").groupBy("date_pulled").agg(F.sum(F.col("n") * F.col("price")).alias("market_cap"), F.sum("n").alias("n_listings"))


def priced_on_day(listings: DataFrame, prices: DataFrame, tolerance: str | None = None) -> DataFrame:
    """Listings with the price that their card had on their day, and that price's own day; null before the first price
    and, with a tolerance, where the last one is too old."""
    known = prices.select(F.col("card_id").alias("id"), F.col("date").alias("date_pulled"), F.col("price").alias("price_then"))
    return asof_join(listings, known, ["id"], "date_pulled", tolerance).withColumnRenamed("date_pulled_right", "price_date")


def value_on_day(listings: DataFrame, prices: DataFrame) -> DataFrame:
    """Ungraded listings at the price of their own day, by day. Listings are counted by card and day before the join, so
    a card has as many rows in it as days."""
    n = listings.where(~F.col("is_graded")).groupBy("date_pulled", "id").agg(F.count(F.lit(1)).alias("n"))
    value = F.sum(F.col("n") * F.col("price_then")).alias("market_cap")
    return priced_on_day(n, prices).groupBy("date_pulled").agg(value, F.sum("n").alias("n_listings"), F.sum(F.when(F.col("price_then").isNotNull(), F.col("n")).otherwise(0)).alias("n_priced"))


def top_listed(listings: DataFrame, catalog: DataFrame, prices: DataFrame, k: int = 10) -> DataFrame:
    top = on_latest_day(listings, "date_pulled").groupBy("id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(k)
    now = latest_price(prices).select(F.col("card_id").alias("id"), "price")
    df = top.join(catalog.select("id", "name", "set_name"), "id", "left").join(now, "id", "left")
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "id")))  # k rows


def latest_listings(listings: DataFrame, card: str) -> DataFrame:
    return on_latest_day(listings.where(F.col("id") == card), "date_pulled").select("item_id", "price_val", "is_graded", "date_pulled").orderBy("price_val", "item_id")
