"""Series of prices by card and day: gaps, fills, scaling, windows, statistics.

Series are keyed by card, so every window is partitioned by it; global extremes are one-row aggregates that are
joined back, never windows over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec


def card() -> WindowSpec:
    return W.partitionBy("card_id")


def old_first() -> WindowSpec:
    return card().orderBy("date")


def new_first() -> WindowSpec:
    return card().orderBy(F.desc("date"))


def eligible_history(prices: DataFrame, min_days: int = 180) -> DataFrame:
    """Rows of cards with at least so many distinct days."""
    enough = prices.groupBy("card_id").agg(F.countDistinct("date").alias("d")).where(F.col("d") >= min_days)
    return prices.join(enough, "card_id", "left_semi")


def calendar(prices: DataFrame) -> DataFrame:
    span = prices.groupBy("card_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return span.select("card_id", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))


def gapfill_daily(prices: DataFrame) -> DataFrame:
    """A row for each day between a card's first and last, with the last price known; leading nulls stay."""
    return calendar(prices).join(prices, ["card_id", "date"], "left").withColumn("price", F.last("price", ignorenulls=True).over(old_first()))


def backfill_forward(df: DataFrame, column: str, default: float = 0.5) -> DataFrame:
    """Nulls take the next value, else the last one, else ``default``."""
    following = old_first().rowsBetween(0, W.unboundedFollowing)
    before = old_first().rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(column, F.coalesce(F.first(column, ignorenulls=True).over(following), F.last(column, ignorenulls=True).over(before), F.lit(default)))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); 0.5 where that span is empty, null where x is null."""
    return F.when(x.isNull(), None).when(hi == lo, 0.5).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0)))


def unscaled(x: Column, lo: Column, hi: Column) -> Column:
    """The price behind a scaled one; of a span without width, that price."""
    return x * (hi - lo) + lo


def minmax_by_card(prices: DataFrame) -> DataFrame:
    df = prices.withColumns({"card_min_price": F.min("price").over(card()), "card_max_price": F.max("price").over(card())})
    return df.withColumn("price_scaled", scaled(F.col("price"), F.col("card_min_price"), F.col("card_max_price")))


def with_extremes(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with {column}_lo and {column}_hi of all rows, from a one-row aggregate."""
    ends = df.agg(*[f(c).alias(f"{c}_{s}") for c in columns for f, s in ((F.min, "lo"), (F.max, "hi"))])
    return df.join(F.broadcast(ends))


def minmax_global(df: DataFrame, *columns: str) -> DataFrame:
    out = with_extremes(df, *columns)
    for c in columns:
        out = out.withColumn(f"{c}_scaled", scaled(F.col(c).cast("double"), F.col(f"{c}_lo"), F.col(f"{c}_hi")))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("lo", "hi")])


def zscore(df: DataFrame, *columns: str) -> DataFrame:
    stats = df.agg(*[f(c).alias(f"{c}_{s}") for c in columns for f, s in ((F.avg, "m"), (F.stddev_samp, "s"))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"{c}_m")) / F.nullif(F.col(f"{c}_s"), F.lit(0.0)))
    return out.drop(*[f"{c}_{s}" for c in columns for s in ("m", "s")])


def label_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense codes of the sorted distinct values, from 0. Null has no code."""
    codes = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(out, F.dense_rank().over(W.orderBy(column)) - 1)
    return df.join(codes, column, "left")


def newest(prices: DataFrame, first: int, last: int | None = None, key: str = "rn") -> DataFrame:
    """Rows from the ``first`` to the ``last`` newest of each card (all older ones if None)."""
    df = prices.withColumn(key, F.row_number().over(new_first())).where(F.col(key) >= first)
    return (df if last is None else df.where(F.col(key) <= last)).drop(key)


def sliding_windows(prices: DataFrame, look: int, ahead: int) -> DataFrame:
    """Each window of ``look`` inputs and ``ahead`` targets of each card, by its first day."""
    frame = old_first().rowsBetween(0, look + ahead - 1)
    df = prices.withColumn("w", F.collect_list("price").over(frame)).where(F.size("w") == look + ahead)
    return df.select("card_id", F.col("date").alias("start_date"), F.slice("w", 1, look).alias("inputs"), F.slice("w", look + 1, ahead).alias("targets"))


def split_windows(prices: DataFrame, look: int, ahead: int, min_days: int = 180, hold: int = 40, skip: int = 20) -> DataFrame:
    """(card_id, split, start_date, inputs, targets, target_dates): the training set of a forecaster.

    Cards with fewer than ``min_days`` rows give nothing. Of the others, ``train`` has all but the ``hold`` newest rows,
    ``val`` the ``look + ahead`` rows before the ``skip`` newest, ``test`` the newest ``look + ahead`` rows; each gives
    every window of inputs and targets it has room for.
    """
    n = look + ahead
    df = prices.withColumns({"_n": F.count(F.lit(1)).over(card()), "_rn": F.row_number().over(new_first())}).where(F.col("_n") >= min_days)
    split = F.array(
        F.when(F.col("_rn") > hold, "train"), F.when((F.col("_rn") > skip) & (F.col("_rn") <= n + skip), "val"), F.when(F.col("_rn") <= n, "test")
    )
    df = df.withColumn("split", F.explode(F.array_compact(split)))
    frame = W.partitionBy("card_id", "split").orderBy("date").rowsBetween(0, n - 1)
    df = df.withColumn("w", F.collect_list(F.struct("price", "date")).over(frame)).where(F.size("w") == n)
    part = lambda field, a, k: F.slice(F.col(f"w.{field}"), a, k)
    return df.select("card_id", "split", F.col("date").alias("start_date"), part("price", 1, look).alias("inputs"), part("price", look + 1, ahead).alias("targets"), part("date", look + 1, ahead).alias("target_dates"))


def context_window(prices: DataFrame, size: int = 256) -> DataFrame:
    last = newest(prices, 1, size).groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("w"))
    return last.select("card_id", F.size("w").alias("n"), F.col("w.price").alias("context"))


def _long_enough(prices: DataFrame, n: int) -> DataFrame:
    return prices.withColumn("n", F.count(F.lit(1)).over(card())).where(F.col("n") >= n)


def _entropy() -> Column:
    """Sample entropy of the array ``x`` with standard deviation ``sd``; null if undefined.

    Pairs of templates are counted inside the card's own array, so no pair is ever a row.
    """
    r = 0.2 * F.col("sd")
    at = lambda i, k: F.element_at("x", i + k)
    near = lambda i, j, k: F.abs(at(i, k) - at(j, k)) < r

    def of(i: Column) -> Column:
        later = F.sequence(i + 1, F.size("x") - 2)
        close = F.filter(later, lambda j: near(i, j, 0) & near(i, j, 1))
        return F.struct(F.size(close).cast("long").alias("b"), F.size(F.filter(close, lambda j: near(i, j, 2))).cast("long").alias("a"))

    counted = F.transform(F.sequence(F.lit(1), F.size("x") - 3), of)
    none = F.lit(0).cast("long")
    both = F.aggregate(counted, F.struct(none.alias("b"), none.alias("a")), lambda acc, y: F.struct((acc["b"] + y["b"]).alias("b"), (acc["a"] + y["a"]).alias("a")))
    value = F.element_at(F.transform(F.array(both), lambda y: F.when(y["a"] > 0, F.ln(y["b"] / F.nullif(y["a"], F.lit(0))))), 1)
    return F.when(F.col("sd") > 0, value)


#: Longer series have their entropy from merge trees, card by card, instead of from pairs inside an array.
LONG = 256


def _long_entropy(df: DataFrame) -> DataFrame:
    """(card_id, samp_entropy) of the series in ``df``, which has each card's ``sd``."""

    def one(pdf):
        import pandas as pd

        from tidemark.functions import entropy

        pdf = pdf.sort_values(["date", "price"])
        value = entropy.sample_entropy(pdf["price"].to_numpy(float), pdf["sd"].iloc[0])
        return pd.DataFrame({"card_id": [pdf["card_id"].iloc[0]], "samp_entropy": pd.Series([value], dtype="float64")})

    return df.select("card_id", "date", "price", "sd").groupBy("card_id").applyInPandas(one, f"card_id {df.schema['card_id'].dataType.simpleString()}, samp_entropy double")


def sample_entropy(prices: DataFrame, min_rows: int = 10) -> DataFrame:
    """Sample entropy (m = 2, r = 0.2 sd) of each card's whole series. Time grows little faster than a series' length."""
    df = _long_enough(prices, min_rows).withColumn("sd", F.stddev_samp("price").over(card()))
    short = df.where(F.col("n") <= LONG).groupBy("card_id").agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("s"), F.first("sd").alias("sd"))
    return short.select("card_id", "sd", F.col("s.price").alias("x")).select("card_id", _entropy().alias("samp_entropy")).unionByName(_long_entropy(df.where(F.col("n") > LONG)))


def hurst(prices: DataFrame, min_rows: int = 10) -> DataFrame:
    """Rescaled range over the whole series: ln(range of cumulative deviations / sd) / ln n; null for flat series."""
    df = _long_enough(prices, min_rows).withColumns({"y": F.col("price") - F.avg("price").over(card()), "sd": F.stddev_samp("price").over(card())})
    df = df.withColumn("c", F.sum("y").over(old_first().rowsBetween(W.unboundedPreceding, 0)))
    spread = F.max("c") - F.min("c")
    rs = F.when((F.first("sd") > 0) & (spread > 0), F.ln(spread / F.nullif(F.first("sd"), F.lit(0.0))) / F.ln(F.first("n")))
    return df.groupBy("card_id").agg(rs.alias("hurst_exp"))


def lag1_autocorrelation(prices: DataFrame, min_rows: int = 3) -> DataFrame:
    df = _long_enough(prices, min_rows).withColumn("before", F.lag("price").over(old_first())).where("before is not null")
    spread = F.stddev_pop("price") * F.stddev_pop("before")  # corr() would fail on a flat series
    return df.groupBy("card_id").agg((F.covar_pop("price", "before") / F.nullif(spread, F.lit(0.0))).alias("lag1_corr"))


def ts_metrics(prices: DataFrame, min_rows: int = 10) -> DataFrame:
    """All statistics of a card's series: windows by card, then one aggregate. The entropy of long series is joined."""
    before, sd = F.lag("price").over(old_first()), F.stddev_samp("price").over(card())
    df = _long_enough(prices, min_rows).withColumns({"before": before, "sd": sd, "y": F.col("price") - F.avg("price").over(card())})
    df = df.withColumn("c", F.sum("y").over(old_first().rowsBetween(W.unboundedPreceding, 0)))
    after = F.when(F.col("before").isNotNull(), F.col("price"))
    spread = F.max("c") - F.min("c")
    each = df.groupBy("card_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.max_by("price", "date").alias("current_price"), F.avg("price").alias("avg_price"),
        (F.stddev_samp("price") / F.nullif(F.avg("price"), F.lit(0.0))).alias("cv"), F.skewness("price").alias("skewness"),
        F.first("sd").alias("sd"), F.sort_array(F.collect_list(F.when(F.col("n") <= LONG, F.struct("date", "price")))).alias("s"),
        F.when((F.first("sd") > 0) & (spread > 0), F.ln(spread / F.nullif(F.first("sd"), F.lit(0.0))) / F.ln(F.first("n"))).alias("hurst_exp"),
        (F.covar_pop(after, "before") / F.nullif(F.stddev_pop(after) * F.stddev_pop("before"), F.lit(0.0))).alias("lag1_corr"),
    )
    each = each.withColumn("x", F.col("s.price")).withColumn("short", F.when(F.size("x") > 0, _entropy()))
    each = each.join(_long_entropy(df.where(F.col("n") > LONG)), "card_id", "left").withColumn("samp_entropy", F.coalesce("short", "samp_entropy"))
    return each.select("card_id", "n_days", "current_price", "avg_price", "cv", "skewness", "samp_entropy", "hurst_exp", "lag1_corr")


def chaos_index(prices: DataFrame, holdout: int = 30, tiers: bool = True) -> DataFrame:
    """Per card with more than ``holdout`` rows, its last ``holdout`` left out: net change, path length, efficiency,
    span, chaos_cv = span * (1 - efficiency), and thirds by it. The ranking window sees one row for each card."""
    df = prices.withColumns({"n": F.count(F.lit(1)).over(card()), "rn": F.row_number().over(new_first())}).where((F.col("n") > holdout) & (F.col("rn") > holdout))
    df = df.withColumn("step", F.abs(F.col("price") - F.lag("price").over(old_first())))
    agg = df.groupBy("card_id").agg(
        F.abs(F.max_by("price", "date") - F.min_by("price", "date")).alias("net_change"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("sum_of_changes"),
        ((F.max("price") - F.min("price")) / F.nullif(F.avg("price"), F.lit(0.0))).alias("span_range"),
    )
    agg = agg.withColumn("efficiency_ratio", F.when(F.col("sum_of_changes") > 0, F.col("net_change") / F.nullif(F.col("sum_of_changes"), F.lit(0.0))).otherwise(1.0))
    agg = agg.withColumn("chaos_cv", F.col("span_range") * (1 - F.col("efficiency_ratio")))
    return thirds(agg, F.round("chaos_cv", 9), "card_id") if tiers else agg


def thirds(df: DataFrame, by: Column, *tie: str) -> DataFrame:
    return df.withColumn("volatility_tier", F.ntile(3).over(W.orderBy(by, *tie)))


def row_thirds(rows: DataFrame, by: str) -> DataFrame:
    """Thirds over the daily rows of all cards, in the order of ``by`` (one value for each card), card and date.

    A window over all rows would sort them in one task. Rows before a card are counted on the table of cards, and
    rows within it by card.
    """
    cards = rows.groupBy("card_id").agg(F.first(by).alias("_by"), F.count(F.lit(1)).alias("_n"))
    order = W.orderBy("_by", "card_id")
    cards = cards.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = cards.agg(F.sum("_n").alias("_all"))
    df = rows.join(cards.select("card_id", "_before"), "card_id").join(F.broadcast(total)).withColumn("_rn", F.col("_before") + F.row_number().over(old_first()) - 1)
    size, more = F.floor(F.col("_all") / 3), F.col("_all") % 3  # the first ``more`` thirds have a row more
    tier = F.when(F.col("_rn") < more * (size + 1), F.floor(F.col("_rn") / (size + 1))).otherwise(F.floor((F.col("_rn") - more) / F.nullif(size, F.lit(0))))
    return df.withColumn("volatility_tier", (tier + 1).cast("int")).drop("_before", "_all", "_rn")


def price_cv(prices: DataFrame, holdout: int = 30) -> DataFrame:
    df = prices.withColumns({"n": F.count(F.lit(1)).over(card()), "rn": F.row_number().over(new_first())}).where((F.col("n") > holdout) & (F.col("rn") > holdout))
    return df.groupBy("card_id").agg(F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("sd_price"), (F.stddev_samp("price") / F.nullif(F.avg("price"), F.lit(0.0))).alias("price_cv"))


def rebased(prices: DataFrame) -> DataFrame:
    return prices.withColumn("index", F.col("price") / F.nullif(F.first("price").over(old_first()), F.lit(0.0)))


def offsets(prices: DataFrame) -> DataFrame:
    """Days counted back from each card's last row, which is 0."""
    return prices.withColumn("offset", F.row_number().over(old_first()) - F.count(F.lit(1)).over(card()).cast("int"))
