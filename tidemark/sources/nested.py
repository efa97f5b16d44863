"""Nested sources: price histories, card catalogs, request plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rarities that are tracked.
RARITIES = ("Enchanted", "Epic", "Iconic")


def flatten_history(nested: DataFrame) -> DataFrame:
    """(card_id, variant_id, timestamp, date, price): a row for each point; empty histories give none."""
    v = nested.select(F.col("tcgplayerId").alias("card_id"), F.explode("variants").alias("v"))
    p = v.select("card_id", F.col("v.id").alias("variant_id"), F.explode("v.priceHistory").alias("h"))
    at = F.timestamp_seconds("h.t")
    return p.select("card_id", "variant_id", F.col("h.t").alias("timestamp"), at.cast("date").alias("date"), F.col("h.p").alias("price"))


def build_catalog(raw: DataFrame, rarities: tuple[str, ...] = RARITIES) -> DataFrame:
    """Flat catalog of tracked cards with an id; several inks are joined, empty ones are null."""
    ink = F.coalesce(F.nullif(F.array_join("inks", " "), F.lit("")), F.col("ink"))
    return raw.where(F.col("rarity").isin(*rarities) & F.col("tcgplayer_id").isNotNull()).select("id", "tcgplayer_id", "name", F.col("set.name").alias("set_name"), "rarity", ink.alias("ink_clean"))


def batches(ids: DataFrame, column: str, size: int = 20) -> DataFrame:
    """Ids in batches of ``size``, by order. One row for each distinct id is ranked: plan requests from a catalog."""
    ranked = ids.select(column).distinct().withColumn("k", F.row_number().over(W.orderBy(column)))
    return ranked.groupBy(F.ceil(F.col("k") / size).cast("int").alias("batch")).agg(F.sort_array(F.collect_list(column)).alias("ids"))


def page(df: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(order).offset(offset).limit(limit)
