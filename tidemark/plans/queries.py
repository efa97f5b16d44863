"""Every query by name: a function of (spark, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import search
from tidemark.operators import evaluation as ev
from tidemark.operators import features as fe
from tidemark.operators import forecasts as fc
from tidemark.operators import incremental as inc
from tidemark.operators import listings as li
from tidemark.operators import market as mk
from tidemark.operators import scoring as sc
from tidemark.operators import timeseries as ts
from tidemark.sources import nested as ne
from tidemark.sources import requests as rq
from tidemark.sources import sinks
from tidemark.sources import tables as tb
from tidemark.sources.steps import scratch
from tidemark.streaming import queue as qu
from tidemark.streaming import volume as vo

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
AS_OF = "2024-01-20"
MODELS = ["Last", "MA7", "Mean"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


# ---- series


@query
def prices_eligible(s, d):
    return ts.eligible_history(tb.sparse_prices(s, d), 30)


@query
def prices_gapfilled(s, d):
    return ts.gapfill_daily(tb.prices(s, d))


def _holes(s, d) -> DataFrame:
    """Gap-filled prices of which every third day is null."""
    return ts.gapfill_daily(tb.prices(s, d)).withColumn("price", F.when(F.dayofmonth("date") % 3 != 0, F.col("price")))


@query
def prices_locf_with_nulls(s, d):
    return _holes(s, d).withColumn("price", F.last("price", ignorenulls=True).over(ts.old_first()))


@query
def prices_bfill_ffill(s, d):
    return ts.backfill_forward(_holes(s, d), "price")


@query
def price_scaled_per_card(s, d):
    return rounded(ts.minmax_by_card(tb.prices(s, d)), "price_scaled")


@query
def global_minmax(s, d):
    return rounded(ts.minmax_global(tb.catalog(s, d).select("id", "cost", "retail"), "cost", "retail"), "cost_scaled", "retail_scaled")


@query
def zscore(s, d):
    return rounded(ts.zscore(tb.catalog(s, d).select("id", "cost", "retail"), "cost", "retail"), "cost_z", "retail_z")


@query
def label_encode(s, d):
    return ts.label_codes(tb.catalog(s, d).select("id", "set_name"), "set_name", "set_idx")


@query
def vocabulary_size(s, d):
    return ts.label_codes(tb.catalog(s, d).select("id", "set_name"), "set_name", "set_idx").agg((F.max("set_idx") + 1).alias("n"))


@query
def one_hot(s, d):
    return fe.one_hot(tb.catalog(s, d).select("id", "rarity"), "rarity", TYPES)


@query
def multi_hot(s, d):
    return fe.multi_hot(tb.catalog(s, d).select("id", "name"), "name", ("red", "blue", "small", "bolt"), "has_")


@query
def feature_table(s, d):
    df = fe.feature_table(ts.eligible_history(tb.prices(s, d), 25), tb.catalog(s, d))
    return rounded(df, "price_scaled", "cost_scaled", "days_since_release_scaled")


@query
def tabular_matrix(s, d):
    c = F.col("cost")
    kind = F.when(c % 4 == 0, "Character").when(c % 4 == 1, "Action").when(c % 4 == 2, "Item - Character").otherwise("NA")
    numbers = {n: F.when(c % m > 0, (c % m).cast("string")).otherwise("NA") for n, m in (("strength", 5), ("willpower", 7), ("lore", 3))}
    cat = tb.catalog(s, d).withColumns({"type_clean": kind, "ink": F.col("name"), **numbers, "price_foil": F.when(c % 3 > 0, F.col("retail")), "price_nonfoil": F.when(c % 9 > 0, F.col("retail") / 2)})
    out = fe.tabular_matrix(cat, ["Character", "Action", "Item - Character"], TYPES, ("red", "blue", "small", "bolt"))
    return rounded(out, "log_price", "cost", "strength", "willpower", "lore", "days_since_launch")


def _cents(c: str) -> Column:
    """Prices as whole cents in one string, so that whole windows can be compared."""
    return F.array_join(F.transform(c, lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias(c)


@query
def sliding_windows(s, d):
    return ts.sliding_windows(tb.prices(s, d), 14, 7).select("card_id", "start_date", _cents("inputs"), _cents("targets"))


@query
def split_windows(s, d):
    out = ts.split_windows(tb.long_prices(s, d), 30, 15)
    return out.select("card_id", "split", "start_date", _cents("inputs"), _cents("targets"), F.array_join(F.transform("target_dates", lambda x: x.cast("string")), ",").alias("target_dates"))


@query
def price_unscaled(s, d):
    """Scaled prices back in money."""
    df = ts.minmax_by_card(tb.prices(s, d))
    return df.select("card_id", "date", F.round(ts.unscaled(F.col("price_scaled"), F.col("card_min_price"), F.col("card_max_price")), 6).alias("price"))


@query
def split_train(s, d):
    return ts.newest(tb.long_prices(s, d), 41)


@query
def split_val(s, d):
    return ts.newest(tb.long_prices(s, d), 21, 65)


@query
def split_test(s, d):
    return ts.newest(tb.long_prices(s, d), 1, 45)


@query
def context_window(s, d):
    return ts.context_window(tb.long_prices(s, d), 256).select("card_id", "n", _cents("context"))


@query
def day_offsets(s, d):
    return ts.offsets(tb.prices(s, d))


@query
def sample_entropy(s, d):
    return rounded(ts.sample_entropy(tb.prices(s, d)), "samp_entropy")


@query
def hurst_rs(s, d):
    return rounded(ts.hurst(tb.prices(s, d)), "hurst_exp")


@query
def lag1_autocorr(s, d):
    return rounded(ts.lag1_autocorrelation(tb.prices(s, d)), "lag1_corr")


@query
def ts_metrics(s, d):
    return rounded(ts.ts_metrics(tb.prices(s, d)), "avg_price", "cv", "skewness", "samp_entropy", "hurst_exp", "lag1_corr")


@query
def chaos_index(s, d):
    return rounded(ts.chaos_index(tb.long_prices(s, d)), "net_change", "sum_of_changes", "span_range", "efficiency_ratio", "chaos_cv")


@query
def cv_volatility(s, d):
    return rounded(ts.price_cv(tb.long_prices(s, d)), "avg_price", "sd_price", "price_cv")


@query
def tiers_by_card(s, d):
    return ts.chaos_index(tb.long_prices(s, d)).select("card_id", "volatility_tier")


@query
def tiers_by_row(s, d):
    """Thirds over daily rows, not over cards: another result."""
    v = ts.chaos_index(tb.prices(s, d), 7, tiers=False).select("card_id", F.round("chaos_cv", 9).alias("v"))
    return ts.row_thirds(tb.prices(s, d).join(v, "card_id"), "v").select("card_id", "date", "volatility_tier")


@query
def exemplar_index(s, d):
    first = ts.chaos_index(tb.long_prices(s, d)).groupBy("volatility_tier").agg(F.min("card_id").alias("card_id"))
    return rounded(ts.rebased(tb.long_prices(s, d).join(first, "card_id")), "index")


# ---- market


@query
def latest_price(s, d):
    return mk.latest_price(tb.prices(s, d))


@query
def price_asof_cutoff(s, d):
    return mk.latest_price(tb.prices(s, d), AS_OF)


@query
def momentum(s, d):
    return rounded(mk.momentum(tb.prices(s, d)), "abs_change", "pct_change")


@query
def momentum_movers(s, d):
    return mk.movers(rounded(mk.momentum(tb.prices(s, d)), "abs_change", "pct_change"))


@query
def movers_sparkline(s, d):
    p = tb.prices(s, d)
    return mk.sparkline(p, mk.movers(rounded(mk.momentum(p), "abs_change", "pct_change")))


@query
def market_daily_dive(s, d):
    return li.market_daily_dive(tb.listings(s, d, with_card=True, by_card=True))


@query
def listing_overview(s, d):
    return li.listing_overview(tb.listings(s, d, with_card=True))


@query
def top20_active(s, d):
    return li.top_active(tb.listings(s, d), tb.catalog(s, d))


@query
def float_value_on_day(s, d):
    """Market value of each day at the guide's prices of that day."""
    return rounded(mk.value_on_day(tb.listings(s, d), tb.price_guide(s, d)), "market_cap")


@query
def listing_premiums(s, d):
    """Every listing against the guide's price on its day, at most a year old."""
    df = mk.priced_on_day(tb.listings(s, d).select("item_id", "id", "date_pulled", "price_val"), tb.price_guide(s, d), "365 days")
    return df.select("item_id", "date_pulled", "price_date", "price_then", F.round(F.col("price_val") / F.nullif(F.col("price_then"), F.lit(0.0)) - 1, 6).alias("premium"))


@query
def top10_active(s, d):
    return mk.top_listed(tb.listings(s, d), tb.catalog(s, d), tb.sparse_prices(s, d))


@query
def volume_by_day(s, d):
    return mk.volume_by_day(tb.listings(s, d))


@query
def raw_float_value(s, d):
    return rounded(mk.float_value(tb.listings(s, d), tb.sparse_prices(s, d)), "market_cap", to=2)


@query
def card_listings_latest(s, d):
    return mk.latest_listings(tb.listings(s, d), "7")


@query
def card_listing_count(s, d):
    return mk.latest_listings(tb.listings(s, d), "7").agg(F.count(F.lit(1)).alias("n"), F.max("date_pulled").alias("date_pulled"))


@query
def selector_list(s, d):
    return tb.catalog(s, d).where("rarity <> 'PROMO'").select("set_name").distinct().orderBy("set_name")


# ---- listings


@query
def language_detect(s, d):
    return tb.listings(s, d).groupBy(li.language(F.col("listing_title")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query
def display_name(s, d):
    return tb.catalog(s, d).select("id", li.display_name("name", "set_name", "rarity").alias("cardname"), li.folder_name("name").alias("folder_name"))


def _titled(s, d) -> DataFrame:
    return tb.listings(s, d, with_card=True).withColumns({"version": F.col("set_name"), "number": F.col("cost").cast("string")})


@query
def title_filter(s, d):
    return li.title_filter(_titled(s, d)).select("item_id", "id", "price_val", "listing_title")


@query
def second_blacklist(s, d):
    return li.without_second_blacklist(tb.listings(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def not_promo(s, d):
    return tb.catalog(s, d).where(~F.col("rarity").rlike("(?i)promo")).select("id", "rarity")


@query
def incremental_queue(s, d):
    every = tb.listings(s, d)
    return li.incremental_queue(every, every.where(F.split("item_id", "-")[0].cast("long") % 3 == 0), tb.catalog(s, d))


@query
def parse_enrichment(s, d):
    """Replies of the rule grader, some of them cut off."""
    return _enriched(s, d).groupBy("status", "is_valid", "is_graded", "grading_company", "grade_val").agg(F.count(F.lit(1)).alias("n"))


@query
def union_schema_drift(s, d):
    old = tb.listings(s, d).where("is_graded").select("item_id", "id", "listing_title")
    new = tb.listings(s, d).where("not is_graded").select("item_id", "id", "pull_source")
    return li.unioned([old, new]).groupBy("id").agg(F.count("listing_title").alias("titles"), F.count("pull_source").alias("sources"))


@query
def rarity_in_stated_order(s, d):
    first = ["STANDARD", "PROMO", "SMALL"]
    df = tb.catalog(s, d).groupBy("rarity").agg(F.count(F.lit(1)).alias("n"))
    return df.withColumn("place", fe.ordinal("rarity", first)).orderBy("place", "rarity")


def _enriched(s, d) -> DataFrame:
    df = tb.listings(s, d).select("item_id", li.rule_grader(F.col("listing_title")).alias("json"), F.split("item_id", "-")[1].cast("int").alias("n"))
    return li.parse_enrichment(df.withColumn("json", F.when(F.col("n") == 6, F.lit("{oops")).otherwise(F.col("json"))))


@query
def verified_listings(s, d):
    return li.verified(tb.listings(s, d), _enriched(s, d)).select("item_id", "id", "price_val", "date_pulled", "is_graded", "grading_company", "grade_val")


@query
def cheapest_listings(s, d):
    return li.cheapest(tb.catalog(s, d).select("id", "name"), tb.listings(s, d))


# ---- nested sources, files


@query
def flatten_history(s, d):
    return ne.flatten_history(tb.nested_history(s, d))


@query
def history_metadata(s, d):
    return ne.flatten_history(tb.nested_history(s, d)).select("card_id", "variant_id").distinct()


@query
def catalog_build(s, d):
    raw = tb.table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 11 > 0, F.col("p_partkey")).alias("tcgplayer_id"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("set"),
        F.col("p_type").alias("rarity"), F.split("p_name", " ").alias("words"), F.lit("none").alias("ink"),
    ).withColumn("inks", F.when(F.length("name") > 8, F.col("words")).otherwise(F.array().cast("array<string>")))
    return ne.build_catalog(raw, ("PROMO", "LARGE"))


@query
def mixed_dates(s, d):
    o = tb.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("day", "M/d/yyyy")).otherwise("soon")
    return o.withColumn("raw", text).select("o_orderkey", fe.parsed_date("raw").alias("day"))


@query
def json_props(s, d):
    e = tb.table(s, d, "events").withColumn("p", F.from_json("props", "k int"))
    return e.groupBy(F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def batch_requests(s, d):
    return ne.batches(tb.catalog(s, d), "tcgplayer_id").select("batch", F.size("ids").alias("n"), F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("last_id"))


def _price_service():
    """A client that answers with ids and their digits' sum, ``limit`` at a time, as a service would; it fails now and
    then."""
    import json

    asked = set()

    def fetch(ids: list, offset: int, limit: int) -> str | None:
        if offset == 0 and ids[0] % 3 == 0 and ids[0] not in asked:
            asked.add(ids[0])
            raise TimeoutError("try again")
        part = ids[offset : offset + limit]
        return json.dumps({"data": [{"id": int(i), "price": sum(map(int, str(i)))} for i in part]}) if part else None

    return fetch


@query
def fetched_pages(s, d):
    """Requests of twenty ids of the catalog, fetched seven at a time until a page is empty, as rows."""
    plan = ne.batches(tb.catalog(s, d), "tcgplayer_id")
    pages = rq.fetched(plan, _price_service, limit=7, tasks=8, pause=0.0).where("error is null")
    rows = pages.select("batch", "page", F.explode(F.from_json("body", "data array<struct<id: bigint, price: int>>")["data"]).alias("r"))
    return rows.select("batch", "page", "r.id", "r.price")


@query
def observed_rates(s, d):
    """Shares of all listings, taken while these are written: graded ones, matches, and prices over the floor."""
    l, path = _titled(s, d), scratch(s, "observed")
    ok = li.title_filter(l).select("item_id").distinct().withColumn("ok", F.lit(True))
    rates = {"graded": F.col("is_graded"), "matched": F.col("ok"), "dear": F.col("price_val") >= li.PRICE_FLOOR}
    got = sinks.overwrite_observed(l.join(ok, "item_id", "left"), path, rates)
    out = s.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"))
    return out.withColumns({k: F.lit(v).cast("bigint") if k == "rows" else F.round(F.lit(v), 6) for k, v in got.items()})


@query
def offset_page(s, d):
    return ne.page(tb.catalog(s, d).select("tcgplayer_id", "name"), "tcgplayer_id", 50, 25)


@query
def csv_round_trip(s, d):
    path = scratch(s, "csv")
    tb.prices(s, d).write.option("header", True).csv(path)
    return tb.read_csv(s, path, tb.PRICE_SCHEMA)


@query
def csv_inferred(s, d):
    path = scratch(s, "csv")
    tb.prices(s, d).write.option("header", True).csv(path)
    return tb.read_csv(s, path).select(F.col("card_id").cast("string").alias("card_id"), "date", "price")


@query
def api_listings(s, d):
    """Replies of a search, one for each card and day, landed as compressed JSON text and read back."""
    l = tb.listings(s, d, by_card=True).withColumn("n", F.split("item_id", "-")[1].cast("int"))
    price = F.struct(F.concat(F.lit("USD "), F.col("price_val").cast("string")).alias("value"))
    options = F.when(F.col("n") % 3 == 1, F.array(F.lit("FIXED_PRICE"))).when(F.col("n") % 3 == 2, F.array(F.lit("AUCTION"), F.lit("BEST_OFFER")))
    item = F.struct(
        F.col("item_id").alias("itemId"), F.col("listing_title").alias("title"), F.when(F.col("n") % 2 == 0, price).alias("price"), F.when(F.col("n") % 2 == 1, price).alias("currentBidPrice"),
        options.alias("buyingOptions"), F.concat(F.col("date_pulled").cast("string"), F.lit("T12:00:00.000Z")).alias("itemCreationDate"),
    )
    replies = l.groupBy("id", "date_pulled").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"), F.collect_list(item).alias("itemSummaries"))).alias("value"))
    path = scratch(s, "replies")
    replies.select("value").unionByName(s.createDataFrame([('{"total":0}',)], "value string")).write.option("compression", "gzip").text(path)
    return li.api_items(tb.read_json(s, path, li.RESPONSE), "TEXT").select("item_id", "listing_title", "price_val", "is_graded", "listing_type", "posted_date")


@query
def files_by_id(s, d):
    """Paths of landed notes by month: executors write each month's file, and only those named as notes count."""
    path = scratch(s, "notes")
    o = tb.table(s, d, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    named = o.withColumns({"file": F.concat(F.date_format("month", "yyyyMM"), F.when(F.month("month") == 1, ".other").otherwise(".front")), "year": F.year("month")})
    named.repartition(4, "year").select("value", "year", "file").write.partitionBy("year", "file").text(path)
    return tb.files_by_id(s, path, "txt", r"file=([^/.]+)\.front/").where("id <> ''").select("id", F.regexp_extract("path", r"(year=\d+/file=[^/]+)/[^/]+$", 1).alias("folder"))


@query
def column_probe(s, d):
    """A frame that lacks a column and has another's type wrong, brought to a schema."""
    return tb.with_columns(tb.prices(s, d).select("card_id", F.col("price").cast("string").alias("price"), F.lit(1).alias("more")), tb.PRICE_SCHEMA)


@query
def lenient_casts(s, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, "NA").when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" gold")))
    return tb.table(s, d, "part").withColumn("cost", raw).select("p_partkey", fe.lenient("cost").alias("cost"), F.coalesce(fe.lenient("cost", "int"), F.lit(0)).alias("cost_code"))


@query
def create_if_absent(s, d):
    """A table is created, filled, and created again: what it has stays. Its name goes from the catalog at the end, its
    rows stay in its folder."""
    path = scratch(s, "created")
    name, columns = f"tidemark_{path.rsplit('-', 1)[1]}", "item_id string, is_valid boolean"
    sinks.create_if_absent(s, name, columns, path)
    s.sql(f"insert into {name} select * from {{rows}}", rows=_enriched(s, d).where("is_valid").groupBy("item_id").agg(F.max("is_valid").alias("is_valid")))
    sinks.create_if_absent(s, name, columns, path)
    s.sql(f"drop table {name}")
    return s.read.schema(columns).parquet(path)


@query
def missing_source(s, d):
    """Prices of a source that is there and of one that isn't."""
    both = li.unioned([tb.prices(s, d), tb.read_or_empty(s, scratch(s, "absent"), tb.PRICE_SCHEMA)])
    return both.groupBy("card_id").agg(F.count(F.lit(1)).alias("n_days"), F.max("date").alias("last_day"))


@query
def parquet_append(s, d):
    path, p = scratch(s, "append"), tb.prices(s, d)
    sinks.append(p.where("date < '2024-01-10'"), path, "date")
    sinks.append(p.where("date >= '2024-01-10'"), path, "date")
    return s.read.parquet(path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query
def day_replace(s, d):
    """A day written twice, the second time with other prices."""
    path, p = scratch(s, "day"), tb.prices(s, d)
    sinks.replace_partitions(p, path, "date")
    day = p.where(f"date = '{AS_OF}'").withColumn("price", F.col("price") + 1)
    for _ in range(2):
        sinks.replace_partitions(day, path, "date")
    return s.read.parquet(path).select("card_id", F.col("date").cast("date").alias("date"), F.round("price", 6).alias("price"))


@query
def run_replace(s, d):
    path, f = scratch(s, "run"), tb.forecasts(s, d)
    sinks.replace_run(f.drop("run_id"), path)
    sinks.replace_run(f.where("run_id = 2 and model = 'MA7'").drop("run_id"), path)
    return s.read.parquet(path).groupBy("run_date", "model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("run_ids")).withColumn("run_date", F.col("run_date").cast("date"))


@query
def residual_upsert(s, d):
    """Half of the residuals, then all: the second insert adds the other half once."""
    path, r = scratch(s, "upsert"), ev.residuals(tb.forecasts(s, d), tb.prices(s, d))
    keys, order = ["card_id", "model_type", "run_date", "target_date"], ["horizon"]
    sinks.overwrite(r.where("horizon <= 3"), path)
    for _ in range(2):
        sinks.insert_if_absent(s, r, path, keys, order)
    return s.read.parquet(path).groupBy("model_type", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query
def retention(s, d):
    return sinks.retained(ev.residuals(tb.forecasts(s, d), tb.prices(s, d)), "target_date", "2024-04-20").groupBy("target_date").agg(F.count(F.lit(1)).alias("n"))


@query
def volume_stream(s, d):
    """Days that the watermark closed, from a stream that reads what is there."""
    path, at, source = scratch(s, "stream"), scratch(s, "state"), scratch(s, "source")
    e = tb.table(s, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    for part in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        e.where(part).write.mode("append").parquet(source)
        vo.write_available(vo.volume_stream(s.readStream.schema(e.schema).parquet(source)), path, at)
    return s.read.schema("day date, event_type string, n bigint").parquet(path)


def _kept_up(s, d, holdout: int) -> DataFrame:
    """A state of the days up to the twentieth, and of each further day merged after it; the last day comes twice."""
    p = tb.prices(s, d)
    table = inc.StateTable(s, scratch(s, "state"))
    table.merge(p.where(f"date <= '{AS_OF}'"), holdout)
    days = [r[0] for r in p.where(f"date > '{AS_OF}'").select("date").distinct().orderBy("date").collect()]  # ten
    for day in [*days, *days[-1:]]:
        table.merge(p.where(F.col("date") == F.lit(day)), holdout)
    return table.read()


@query
def metrics_by_day(s, d):
    return rounded(inc.metrics_of(_kept_up(s, d, 0)), "avg_price", "cv", "skewness", "lag1_corr", to=5)


@query
def chaos_by_day(s, d):
    return rounded(inc.chaos_of(_kept_up(s, d, 7)), "net_change", "sum_of_changes", "span_range", "efficiency_ratio", "chaos_cv", to=5)


@query
def retention_delete(s, d):
    """Residuals by day in storage, pruned twice: what is left there."""
    path = scratch(s, "retention")
    sinks.replace_partitions(ev.residuals(tb.forecasts(s, d), tb.prices(s, d)), path, "target_date")
    first = sinks.prune(s, path, "target_date", "2024-04-22")
    again = sinks.prune(s, path, "target_date", "2024-04-22")
    left = s.read.parquet(path).groupBy(F.col("target_date").cast("date").alias("target_date")).agg(F.count(F.lit(1)).alias("n"))
    return left.withColumns({"dropped": F.lit(first), "dropped_again": F.lit(again)})


@query
def queue_stream(s, d):
    """Items to enrich, from a stream that brings half a year twice and then everything new, in two runs and an idle one."""
    source, path, at = scratch(s, "arrived"), scratch(s, "queue"), scratch(s, "state")
    l = tb.listings(s, d).select("item_id", "id", "listing_title", "date_pulled")
    for part in ("date_pulled < '1996-01-01'", "date_pulled >= '1995-07-01'", None):
        if part:
            l.where(part).write.mode("append").option("compression", "zstd").parquet(source)
        qu.run_queue(s.readStream.schema(l.schema).parquet(source), "date_pulled", path, at, "400 days")
    return qu.queued(s, path).join(tb.catalog(s, d).select("id", "name"), "id").select("item_id", "id", "name")


def _grader():
    """A client with the fields of a language model's replies, from words of the title. It can't be reached for titles
    that name an Italian card."""
    import json
    import re

    def ask(rows: list[dict]) -> list[str]:
        if any(r["listing_title"].endswith("italian") for r in rows):
            raise ConnectionError("no answer")
        out = []
        for r in rows:
            grade = re.search(r"\bpsa (\d+)\b", r["listing_title"].lower())
            out.append(json.dumps({"validity": "Match", "is_graded": bool(grade), "grading_company": "PSA" if grade else "NA", "grade_value": grade[1] if grade else "NA"}))
        return out

    return ask


@query
def scored_rounds(s, d):
    """Two rounds of scoring by a service that fails for some titles: these are tried again and stay in the queue."""
    path, l = scratch(s, "enriched"), tb.listings(s, d).select("item_id", "id", "listing_title")
    for _ in range(2):
        sc.score_round(s, l, path, _grader, pause=0.0, retries=1)
    tries = s.read.schema(sc.ENRICHED).parquet(path).groupBy("item_id").agg(F.count(F.lit(1)).alias("rounds"))
    out = sc.enriched(s, path).join(tries, "item_id")
    return out.groupBy("status", "is_valid", "is_graded", "grading_company", "grade_val", "rounds").agg(F.count(F.lit(1)).alias("n"))


@query
def card_search(s, d):
    """Replies to searches by text and by product for each card and day, as a table function gives their items."""
    l = tb.listings(s, d).select("id", F.col("date_pulled").alias("day"), "item_id", "listing_title", "price_val", "pull_source")
    nothing = tb.catalog(s, d).select("id", F.col("released_at").alias("day"), F.when(F.col("cost") % 2 == 0, '{"total":0}').otherwise("{cut o").alias("nothing"))
    # Dealt out as the function wants its replies, before items become replies: these are larger, and don't move any more.
    l = l.unionByName(nothing, allowMissingColumns=True).repartition("id", "day").withColumn("n", F.split("item_id", "-")[1].cast("int"))
    item = F.struct(
        F.col("item_id").alias("itemId"), F.col("listing_title").alias("title"), F.struct(F.concat(F.lit("$"), F.col("price_val").cast("string")).alias("value")).alias("price"),
        F.when(F.col("n") > 1, F.array(F.lit("FIXED_PRICE"), F.lit("AUCTION"))).alias("buyingOptions"), F.concat(F.col("day").cast("string"), F.lit("T12:00:00.000Z")).alias("itemCreationDate"),
    )
    by_text = F.col("nothing").isNotNull() | (F.col("n") % 2 == 1) | (F.col("pull_source") == "TEXT")
    searches = F.explode(F.array_compact(F.array(
        F.when(by_text, F.struct(F.lit(1).alias("turn"), F.lit("Text").alias("source"))), F.when(F.col("pull_source") == "EPID", F.struct(F.lit(2).alias("turn"), F.lit("EPID").alias("source"))),
    )))
    items = F.to_json(F.struct(F.count(F.lit(1)).alias("total"), F.collect_list("item").alias("itemSummaries")))
    replies = l.select("id", "day", searches.alias("q"), item.alias("item"), "nothing").groupBy("id", "day", "q.turn", "q.source", "nothing").agg(items.alias("body"))
    replies = replies.select("id", "day", "turn", "source", F.coalesce("nothing", "body").alias("body"))
    return search.found(replies).select("id", F.col("day").alias("date_pulled"), "item_id", F.round("price_val", 6).alias("price_val"), "is_graded", "pull_source", "listing_type", "posted_date")


# ---- forecasts and their errors


@query
def forecast_quantiles(s, d):
    base = mk.latest_price(tb.prices(s, d)).select("card_id", F.col("date").alias("run_date"), "price")
    path = lambda k: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda h: F.col("price") * (1 + 0.01 * k * h))
    return fc.quantiles(base.select("card_id", "run_date", F.array(*[path(k) for k in range(-5, 6)]).alias("paths")))


@query
def batch_forecast(s, d):
    return rounded(fc.batch_forecast(tb.long_prices(s, d), horizon=30), "pred_price", "conf_low", "conf_high", to=4)


@query
def gru_ensemble(s, d):
    f = tb.forecasts(s, d)
    frames = [f.where("model = 'Last'"), f.where("model = 'MA7'"), f.where("model = 'Mean'").drop("conf_low", "conf_high")]
    return rounded(fc.ensemble([x.drop("model", "run_id") for x in frames], "Ensemble"), "pred_price", "conf_low", "conf_high")


@query
def forecast_current(s, d):
    return fc.by_run(tb.forecasts(s, d), True)


@query
def forecast_shadow(s, d):
    return fc.by_run(tb.forecasts(s, d), False)


@query
def latest_run_rows(s, d):
    """A scalar subquery for the newest run."""
    tb.forecasts(s, d).createOrReplaceTempView("tidemark_forecasts")
    return s.sql("select model, count(*) as n from tidemark_forecasts where run_id = (select max(run_id) from tidemark_forecasts) group by model")


@query
def anchored_path(s, d):
    return fc.anchored(fc.by_run(tb.forecasts(s, d), True), tb.prices(s, d).where(f"date <= '{AS_OF}'"), 5)


@query
def shadow_path(s, d):
    return fc.shadow_paths(tb.forecasts(s, d), tb.prices(s, d))


@query
def residuals(s, d):
    return ev.residuals(tb.forecasts(s, d), tb.prices(s, d))


@query
def residual_rollup(s, d):
    return rounded(ev.rollup(ev.residuals(tb.forecasts(s, d), tb.prices(s, d))), "mean_error_pct", "median_error_pct")


def _pool(s, d) -> DataFrame:
    return ev.pool(tb.forecasts(s, d), tb.prices(s, d), ts.chaos_index(tb.prices(s, d), 7))


@query
def diag_card(s, d):
    return rounded(ev.by_card(_pool(s, d)), "mape", "max_error")


@query
def diag_daily(s, d):
    return rounded(ev.by_day(_pool(s, d)), "daily_mape")


@query
def diag_volatility(s, d):
    return rounded(ts.chaos_index(tb.prices(s, d), 7), "net_change", "sum_of_changes", "span_range", "efficiency_ratio", "chaos_cv").withColumn("diagnostic_run_date", F.lit(AS_OF).cast("date"))


@query
def diag_horizon(s, d):
    return rounded(ev.by_horizon(_pool(s, d)), "horizon_mape")


@query
def milestones(s, d):
    return rounded(ev.by_horizon(_pool(s, d)).where(F.col("day_offset").isin(1, 7)), "horizon_mape")


@query
def head_to_head(s, d):
    return rounded(ev.head_to_head(_pool(s, d), "Last", "MA7"), "mape_Last", "mape_MA7", "margin")


@query
def blowouts(s, d):
    return ev.blowouts(rounded(ev.head_to_head(_pool(s, d), "Last", "MA7"), "mape_Last", "mape_MA7", "margin"))


@query
def leaderboard(s, d):
    return rounded(ev.leaderboard(_pool(s, d), MODELS), *MODELS, "margin")


@query
def naive_baselines(s, d):
    p = tb.prices(s, d)
    return rounded(ev.naive_baselines(p, p.agg(F.date_sub(F.max("date"), 7).alias("cutoff"))), "mape")


@query
def fan_chart(s, d):
    return ev.fan(_pool(s, d))


@query
def error_ols(s, d):
    return rounded(ev.error_trend(_pool(s, d), ts.chaos_index(tb.prices(s, d), 7, tiers=False)), "slope", "intercept", "r2", to=5)


@query
def error_boxstats(s, d):
    return ev.box_stats(_pool(s, d), "model", "volatility_tier")


@query
def error_loess(s, d):
    return rounded(ev.loess(_pool(s, d).groupBy("model", "day_offset").agg(F.avg("ape").alias("mape")), "model", "day_offset", "mape"), "smooth", to=5)


@query
def error_by_age(s, d):
    p = tb.prices(s, d)
    out = ev.error_by_age(ev.age_points(_pool(s, d), tb.catalog(s, d), p))
    return rounded(out, "smooth", to=5).withColumn("days_since_release", F.col("days_since_release").cast("bigint"))


@query
def outlier_flags(s, d):
    return rounded(ev.outliers(_pool(s, d)), "mape")


@query
def ml_diag_table(s, d):
    acc = ev.by_card(_pool(s, d)).select("card_id", "model", "mape")
    return rounded(fc.diagnosis_table(acc, tb.prices(s, d), tb.forecasts(s, d)), "mape", "change", "pct_change")


@query
def regression_eval(s, d):
    return ev.regression_eval(tb.table(s, d, "orders").select("o_totalprice", (F.col("o_totalprice") - 1.5).alias("pred")), "o_totalprice", "pred")


@query
def hash_split(s, d):
    """70 / 15 / 15 by an arithmetic hash of the id."""
    b = F.pmod(F.col("tcgplayer_id") * 2654435761, F.lit(100))
    return tb.catalog(s, d).select("id", F.when(b < 70, "train").when(b < 85, "val").otherwise("test").alias("split"))


@query
def set_rarity_trend(s, d):
    cat = tb.catalog(s, d).select(F.col("id").alias("card_id"), "set_name", "rarity")
    df = tb.sparse_prices(s, d).join(cat, "card_id").groupBy("set_name", "rarity", F.trunc("date", "year").alias("year")).agg(F.round(F.avg("price"), 6).alias("mean_price"), F.round(F.percentile("price", F.lit(0.5)), 6).alias("median_price"))
    return df.unpivot(["set_name", "rarity", "year"], ["mean_price", "median_price"], "measure", "value")


@query
def rarity_by_median(s, d):
    """Rarities in the order of their median price."""
    cat = tb.catalog(s, d).groupBy("rarity").agg(F.percentile("retail", F.lit(0.5)).alias("median_retail"))
    return cat.withColumn("place", F.row_number().over(W.orderBy("median_retail", "rarity"))).orderBy("place")


@query
def quote_latest(s, d):
    """Distinct by key, the first by a stated order."""
    w = W.partitionBy("id").orderBy(F.col("pull_source").desc(), "date_pulled", "item_id")
    return tb.listings(s, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "item_id", "pull_source")


# ---- extensions


@query
def match_rate_by_day(s, d):
    ok = li.title_filter(_titled(s, d)).select("item_id").distinct().withColumn("ok", F.lit(1))
    df = tb.listings(s, d).join(ok, "item_id", "left")
    return df.groupBy("date_pulled").agg(F.round(F.count("ok") / F.count(F.lit(1)), 6).alias("match_rate"))


@query
def model_divergence(s, d):
    w = tb.forecasts(s, d).groupBy("card_id", "run_id", "target_date").pivot("model", MODELS).agg(F.max("pred_price"))
    return w.select("card_id", "run_id", "target_date", F.round(F.abs(F.col("Last") - F.col("MA7")), 4).alias("divergence"))


@query
def blue_chip_index(s, d):
    """Rebased prices of the fifty dearest cards, each weighted by its mean price, by year."""
    p = tb.long_prices(s, d)
    dear = p.groupBy("card_id").agg(F.round(F.avg("price"), 4).alias("m")).orderBy(F.desc("m"), "card_id").limit(50)
    df = ts.rebased(p.join(F.broadcast(dear), "card_id"))
    return df.groupBy(F.trunc("date", "year").alias("year")).agg(F.round(F.sum(F.col("index") * F.col("m")) / F.sum("m"), 6).alias("index_value"))
