"""A search for a card as a table function over its landed replies: in Python, and in SQL for large tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DateType, DoubleType, StringType, StructType

from tidemark.operators.listings import GRADED, RESPONSE

NEEDED = ("id", "day", "turn", "source", "body")
FOUND = StructType()
for _name in "id day item_id listing_title price_val item_url is_graded pull_source listing_type posted_date".split():
    FOUND.add(_name, {"day": DateType(), "price_val": DoubleType(), "is_graded": BooleanType()}.get(_name, StringType()))


@udtf
class CardSearch:
    """Listings in the replies to a card's searches of one day, each item once, from the search with the lowest ``turn``.

    The argument is a table of replies: id, day, turn, source, and body, a JSON object. It is dealt out by card and day, a
    unit of at most a few replies. A body that is null or no JSON object, or has no items, gives nothing; an item without
    id is left out, a price that isn't a number is null.
    """

    @staticmethod
    def analyze(replies: AnalyzeArgument) -> AnalyzeResult:
        if not replies.isTable:
            raise Exception("card_search takes a table of replies")
        lacks = [c for c in NEEDED if c not in replies.dataType.fieldNames()]
        if lacks:
            raise Exception(f"card_search: the table of replies lacks {', '.join(lacks)}")
        return AnalyzeResult(FOUND, partitionBy=[PartitioningColumn("id"), PartitioningColumn("day")], orderBy=[OrderingColumn("turn"), OrderingColumn("body")])

    def __init__(self):
        self.seen: set[str] = set()

    def eval(self, reply: Row) -> Iterator[tuple]:
        try:
            body = json.loads(reply["body"] or "null")
        except ValueError:
            return
        for i in (body.get("itemSummaries") or []) if isinstance(body, dict) else []:
            key = i.get("itemId")
            if key is None or key in self.seen:
                continue
            self.seen.add(key)
            title, price = i.get("title"), (i.get("price") or {}).get("value") or (i.get("currentBidPrice") or {}).get("value")
            try:
                number = float(re.sub("[^0-9.]", "", str(price)))
            except ValueError:
                number = None
            graded = None if title is None else re.search(GRADED, title.lower()) is not None
            options, posted = i.get("buyingOptions"), i.get("itemCreationDate")
            yield reply["id"], reply["day"], key, title, number, i.get("itemWebUrl"), graded, reply["source"], "UNKNOWN" if options is None else ", ".join(options), posted and posted[:10]


def register(spark: SparkSession, name: str = "card_search") -> None:
    """Makes ``select * from card_search(table(replies))`` known to SQL."""
    spark.udtf.register(name, CardSearch)


#: The items of one reply, in order. Spark puts the body of this function into the plan of what calls it.
REPLY_ITEMS = f"""
create or replace temporary function reply_items(body string)
returns table (pos int, item_id string, listing_title string, price string, item_url string, listing_type string, posted_date string)
return select pos, i.itemId, i.title, coalesce(nullif(i.price.value, ''), i.currentBidPrice.value), i.itemWebUrl, coalesce(array_join(i.buyingOptions, ', '), 'UNKNOWN'), substring(i.itemCreationDate, 1, 10)
from posexplode(from_json(case when endswith(rtrim(' \t\n\r', body), '}}') then body end, '{RESPONSE}', map('allowSingleQuotes', 'false')).itemSummaries) as t(pos, i)
"""


def found(replies: DataFrame) -> DataFrame:
    """What ``card_search`` gives, for large tables: no row goes to Python. Replies that are dealt out by id and day don't
    move. It differs in this: of several JSON objects in one body, the first counts, and a price that is a JSON number, not
    text, is read as it is written (0 stays 0, and 1e3 is 13, as in ``api_items``)."""
    spark = replies.sparkSession
    spark.sql(REPLY_ITEMS)
    ranked = replies.select(*NEEDED).withColumn("k", F.row_number().over(W.partitionBy("id", "day").orderBy("turn", "body")))
    items = spark.sql("select id, day, source, k, f.* from {ranked} r, lateral reply_items(r.body) f where f.item_id is not null", ranked=ranked)
    first = items.withColumn("n", F.row_number().over(W.partitionBy("id", "day", "item_id").orderBy("k", "pos"))).where("n = 1")
    price, graded = F.regexp_replace("price", "[^0-9.]", "").try_cast("double").alias("price_val"), F.lower("listing_title").rlike(GRADED).alias("is_graded")
    return first.select("id", "day", "item_id", "listing_title", price, "item_url", graded, F.col("source").alias("pull_source"), "listing_type", "posted_date")
