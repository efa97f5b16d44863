"""Feature tables for forecasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .timeseries import gapfill_daily, label_codes, minmax_by_card, scaled, zscore

#: Inks, and the day the game was launched.
INKS = ("Amber", "Amethyst", "Emerald", "Ruby", "Sapphire", "Steel")
LAUNCH = "2023-08-18"


def parsed_date(c: str) -> Column:
    """Year-month-day, else month/day/year, else null."""
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "M/d/yyyy"))


def lenient(c: str, kind: str = "double") -> Column:
    return F.col(c).try_cast(kind)


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def multi_hot(df: DataFrame, column: str, words: tuple[str, ...] = INKS, prefix: str = "ink_") -> DataFrame:
    return df.withColumns({f"{prefix}{w}": F.coalesce(F.contains(F.col(column), F.lit(w)).cast("int"), F.lit(0)) for w in words})


def feature_table(prices: DataFrame, catalog: DataFrame) -> DataFrame:
    """Gap-filled prices with the catalog's columns, age, scaled numbers and codes. Cards that the catalog lacks go.

    Codes and extremes come from one row for each card: its columns, and the first and last day that it has a price.
    """
    meta = catalog.where(~F.coalesce(F.lower("rarity").contains("promo"), F.lit(True))).select(F.col("id").alias("card_id"), "name", "set_name", "rarity", "released_at", "cost")
    known = F.min(F.when(F.col("price").isNotNull(), F.col("date")))
    spans = prices.groupBy("card_id").agg(known.alias("_first"), F.max("date").alias("_last")).where("_first is not null")
    cards = meta.join(spans, "card_id")
    floor = lambda days: F.when(days < 0, 0).otherwise(days)
    age = lambda day: floor(F.datediff(day, "released_at"))
    # One row for each card: all codes and extremes come from it in one pass.
    every = W.partitionBy()
    rank = lambda c: F.when(F.col(c).isNotNull(), F.dense_rank().over(W.orderBy(F.asc_nulls_last(c))) - 1)
    coded = cards.withColumns({
        "name_idx": rank("name"), "set_idx": rank("set_name"), "rarity_idx": rank("rarity"), "cost_lo": F.min("cost").over(every), "cost_hi": F.max("cost").over(every),
        "days_lo": F.min(age("_first")).over(every), "days_hi": F.max(age("_last")).over(every),
    }).drop("_first", "_last")
    df = gapfill_daily(prices).where("price is not null").join(coded, "card_id").withColumn("days_since_release", age("date"))
    df = minmax_by_card(df)
    df = df.withColumns({"cost_scaled": scaled(F.col("cost").cast("double"), F.col("cost_lo"), F.col("cost_hi")), "days_since_release_scaled": scaled(F.col("days_since_release").cast("double"), F.col("days_lo"), F.col("days_hi"))})
    return df.drop("cost_lo", "cost_hi", "days_lo", "days_hi")


def tabular_matrix(catalog: DataFrame, types: list[str], rarities: list[str], inks: tuple[str, ...] = INKS) -> DataFrame:
    """One row of numbers for each card, for a model beside its image: id, character_id, is_character, multi-hot inks,
    dummies of type and rarity, z-scores of cost, strength, willpower, lore and days since launch, and log_price.

    "NA" is null. Strength, willpower and lore that a card lacks are 0; a card without price has no log_price.
    """
    text = lambda c: F.nullif(F.col(c).cast("string"), F.lit("NA")).alias(c)
    number = lambda c: F.nullif(F.col(c).cast("string"), F.lit("NA")).try_cast("double")
    df = catalog.select(
        "id", text("name"), text("type_clean"), text("rarity"), text("ink"), number("cost").alias("cost"), *[F.coalesce(number(c), F.lit(0.0)).alias(c) for c in ("strength", "willpower", "lore")],
        F.datediff(F.col("released_at").cast("date"), F.lit(LAUNCH).cast("date")).cast("double").alias("days_since_launch"), F.log1p(F.coalesce(number("price_foil"), number("price_nonfoil"))).alias("log_price"),
    )
    df = df.withColumn("is_character", F.coalesce(F.contains("type_clean", F.lit("Character")), F.lit(False)).cast("int"))
    df = multi_hot(one_hot(one_hot(label_codes(df, "name", "character_id"), "type_clean", types), "rarity", rarities), "ink", inks)
    numbers = ("cost", "strength", "willpower", "lore", "days_since_launch")
    df = zscore(df, *numbers).drop("name", "type_clean", "rarity", "ink", *numbers)
    return df.withColumnsRenamed({f"{c}_z": c for c in numbers})


def ordinal(column: str, first: list[str]) -> Column:
    """Places of a stated order; values that it doesn't name come after all that it does."""
    place = F.array_position(F.array(*[F.lit(v) for v in first]), F.col(column))
    return F.when(place > 0, place - 1).otherwise(len(first)).cast("int")
