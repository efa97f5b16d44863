"""Marketplace listings: titles, filters, summaries, and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that tell a title's language, in order; all other titles are English.
LANGUAGES = (("Japanese", r"japanese|jpn|\bjp\b"), ("Chinese", r"chinese|\bchn\b|\bcn\b"), ("French", r"french|\bfr\b"), ("German", r"german|\bger\b"), ("Italian", r"italian|\bita\b"))
#: Words that rule a title out (unanchored: "case" also hits "showcase").
BLACKLIST = r"case|box|proxy|replica|repro|custom|fan art|digital|wafer"
SECOND_BLACKLIST = r"(?i)D23|repack|pin|proxy|custom|oversized|coin|sleeve"
#: Words that a title has beside a rare card's name, and companies and words that tell a graded one.
RARITY_WORDS = ("enchanted", "promo", "alt art", "aa", "variant")
GRADED = "psa|cgc|bgs|sgc|grade|graded|slab"
PRICE_FLOOR = 20.0


def language(title: Column) -> Column:
    out = F.lit("English")
    for name, pattern in reversed(LANGUAGES):
        out = F.when(F.lower(title).rlike(pattern), name).otherwise(out)
    return out


def display_name(*parts: str) -> Column:
    return F.concat_ws(" - ", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])


def folder_name(set_name: str) -> Column:
    return F.regexp_replace(set_name, "[ ']", "_")


def _with_card(listings: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Listings with their card's columns; without a catalog, they have these already."""
    return listings if catalog is None else listings.join(catalog, "id")


def market_daily_dive(listings: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Count, floor (5 % quantile), mean and maximum of prices by day, card, language and grading."""
    df = _with_card(listings, catalog).withColumn("language", language(F.col("listing_title")))
    keys = ["date_pulled", "id", "name", "set_name", "rarity", "language", "is_graded", "pull_source"]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_listings"), F.round(F.percentile("price_val", F.lit(0.05)), 9).alias("floor_price"), F.round(F.avg("price_val"), 9).alias("avg_price"), F.max("price_val").alias("max_price")
    )


def listing_overview(listings: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    return _with_card(listings, catalog).groupBy("date_pulled", "rarity", "is_graded").agg(F.count(F.lit(1)).alias("n"))


def on_latest_day(df: DataFrame, day: str) -> DataFrame:
    """Rows of the newest day, by a one-row aggregate."""
    last = df.agg(F.max(day).alias("_last"))
    return df.join(F.broadcast(last), F.col(day) == F.col("_last")).drop("_last")


def top_active(listings: DataFrame, catalog: DataFrame, k: int = 20) -> DataFrame:
    df = on_latest_day(listings, "date_pulled").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(catalog.select("id", "name", "rarity"), "id").orderBy(F.desc("n"), "id").limit(k)


def title_filter(listings: DataFrame) -> DataFrame:
    """Listings whose title fits their card. Needs name, version, rarity and number of the card beside the title.

    All words of the name (three letters at least) must be there; unless the listing was found by the product's id,
    also a word for its rarity and either its number or a word of its version (over three letters).
    """
    title = F.lower("listing_title")
    has = lambda words: F.exists(words, lambda w: F.contains(title, w))
    names = F.filter(F.split(F.lower("name"), r"\s+|-"), lambda w: F.length(w) >= 3)
    versions = F.filter(F.split(F.regexp_replace(F.lower("version"), r"[^\w\s]|_", " "), r"\s+"), lambda w: F.length(w) > 3)
    rarity = F.array(F.lower("rarity"), *[F.lit(w) for w in RARITY_WORDS])
    # A number that is one word is among the title's words; only others need a pattern of their own.
    is_word = F.array_contains(F.split(title, r"[^\p{L}\p{Nd}_]+"), F.col("number"))
    number = F.when(F.col("number").rlike(r"^\w+$"), is_word).when(F.col("number") != "", F.regexp(title, F.concat(F.lit(r"\b"), F.col("number"), F.lit(r"\b"))))
    number = F.coalesce(number, F.lit(False))
    fits = (F.col("pull_source") == "EPID") | (has(rarity) & (number | F.coalesce(has(versions), F.lit(False))))
    return listings.where(F.forall(names, lambda w: F.contains(title, w)) & fits & ~title.rlike(BLACKLIST) & F.coalesce(F.col("price_val") >= PRICE_FLOOR, F.lit(False)))


def without_second_blacklist(listings: DataFrame) -> DataFrame:
    return listings.where(~F.col("listing_title").rlike(SECOND_BLACKLIST))


def incremental_queue(listings: DataFrame, done: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listings that have no enrichment yet, one row for each item, with their card."""
    todo = listings.select("item_id", "id", "listing_title").join(done.select("item_id"), "item_id", "left_anti")
    todo = todo.groupBy("item_id").agg(F.min(F.struct("id", "listing_title")).alias("r")).select("item_id", "r.*")
    return todo.join(catalog.select("id", "name", "rarity"), "id")


ENRICHMENT = "validity string, is_graded boolean, grading_company string, grade_value string"


def parse_enrichment(df: DataFrame, json: str = "json") -> DataFrame:
    """Typed fields of an enrichment reply. "NA" is null; a reply that can't be read has status ERROR and nulls."""
    got = df.withColumn("e", F.from_json(json, ENRICHMENT))
    ok = F.col("e.validity").isNotNull()
    na = lambda c: F.when(ok, F.nullif(F.col(f"e.{c}"), F.lit("NA")))
    return got.select(
        "item_id", F.when(ok, "OK").otherwise("ERROR").alias("status"), F.when(ok, F.col("e.validity") == "Match").alias("is_valid"), F.when(ok, F.coalesce("e.is_graded", F.lit(False))).alias("is_graded"),
        na("grading_company").alias("grading_company"), na("grade_value").alias("grade_val"),
    )


def rule_grader(title: Column) -> Column:
    """A reply as a title's own words give it, in JSON: a stand-in for a language model with the same fields."""
    company = F.upper(F.regexp_extract(F.lower(title), r"\b(psa|bgs|cgc|sgc|pcg)\b", 1))
    grade = F.regexp_extract(F.lower(title), r"\b(?:psa|bgs|cgc|sgc|pcg)\s+(\d+(?:\.5)?)\b", 1)
    text = lambda c: F.when(c == "", "NA").otherwise(c)
    return F.to_json(F.struct(F.lit("Match").alias("validity"), (company != "").alias("is_graded"), text(company).alias("grading_company"), text(grade).alias("grade_value")))


def unioned(frames: list[DataFrame]) -> DataFrame:
    """All rows, by name, with null for columns that one side lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Fields of a marketplace's search replies, as they are landed, one JSON object for each.
RESPONSE = (
    "total int, itemSummaries array<struct<itemId: string, title: string, itemWebUrl: string, price: struct<value: string>, currentBidPrice: struct<value: string>, "
    "buyingOptions: array<string>, itemCreationDate: string>>"
)


def api_items(responses: DataFrame, source: str) -> DataFrame:
    """A listing for each item of landed replies; replies without items give none."""
    i = responses.select(F.explode("itemSummaries").alias("i")).select("i.*")
    price = F.coalesce("price.value", "currentBidPrice.value")
    return i.select(
        F.col("itemId").alias("item_id"), F.col("title").alias("listing_title"), F.regexp_replace(price, "[^0-9.]", "").try_cast("double").alias("price_val"), F.col("itemWebUrl").alias("item_url"),
        F.lower("title").rlike(GRADED).alias("is_graded"), F.lit(source).alias("pull_source"), F.coalesce(F.array_join("buyingOptions", ", "), F.lit("UNKNOWN")).alias("listing_type"), F.substring("itemCreationDate", 1, 10).alias("posted_date"),
    )


def cheapest(cards: DataFrame, listings: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` cheapest listings of each card: a table function of the card, joined laterally."""
    return cards.sparkSession.sql(
        f"select c.id, c.name, l.item_id, l.price_val from {{cards}} c, lateral (select item_id, price_val from {{listings}} x where x.id = c.id order by price_val, item_id limit {int(k)}) l",
        cards=cards, listings=listings,
    )


def verified(listings: DataFrame, enriched: DataFrame) -> DataFrame:
    """Listings whose enrichment calls them a match, with its grading in place of the title's. One row for each item."""
    keep = ["grade_val", "grading_company", "is_graded"]
    good = enriched.where("is_valid").groupBy("item_id").agg(F.min(F.struct(*keep)).alias("e")).select("item_id", "e.*")
    rest = [c for c in listings.columns if c not in (*keep, "item_id")]
    one = listings.groupBy("item_id").agg(F.min(F.struct(*rest)).alias("r")).select("item_id", "r.*")
    return one.join(good, "item_id")
