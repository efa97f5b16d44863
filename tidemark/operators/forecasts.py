"""Forecast panels: ensembles, current and earlier runs, paths that start at a known price."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .market import latest_price


def ensemble(frames: list[DataFrame], name: str) -> DataFrame:
    """Mean forecast and bounds of several models by card, run and day; bounds a model lacks don't count."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f, allowMissingColumns=True)
    keys = ["card_id", "run_date", "target_date"]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("pred_price", "conf_low", "conf_high")]).withColumn("model", F.lit(name))


def quantiles(samples: DataFrame) -> DataFrame:
    """Median, 10 % and 90 % of sampled paths: (card_id, run_date, paths array<array<double>>) to rows by day."""
    each = samples.select("card_id", "run_date", F.explode("paths").alias("path")).select("card_id", "run_date", F.posexplode("path").alias("k", "v"))
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    out = each.groupBy("card_id", "run_date", "k").agg(q.alias("q"))
    pick = lambda i: F.round(F.col("q")[i], 6)
    return out.select("card_id", "run_date", F.expr("date_add(run_date, k + 1)").alias("target_date"), pick(0).alias("pred_price"), pick(1).alias("conf_low"), pick(2).alias("conf_high"))


def by_run(forecasts: DataFrame, current: bool) -> DataFrame:
    """The newest run's rows, or those of all earlier ones; one row for each card, model, day and run."""
    keys = ["card_id", "model", "target_date", "run_id"]
    rest = [c for c in forecasts.columns if c not in keys]
    first = ["run_date", "pred_price"]  # of rows that repeat a key, the newest run's smallest forecast
    one = forecasts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.unix_date(first[0]), *first[1:], *[c for c in rest if c not in first])).alias("_r")).select(*keys, "_r.*").select(*forecasts.columns)
    last = forecasts.agg(F.max("run_id").alias("_last"))
    return one.join(F.broadcast(last), (F.col("run_id") == F.col("_last")) if current else (F.col("run_id") < F.col("_last"))).drop("_last")


def anchored(forecasts: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """The last actual price, as a forecast without spread, and the forecast up to ``days`` after it."""
    last = latest_price(prices)
    start = last.select("card_id", "date", *[F.col("price").alias(c) for c in ("pred_price", "conf_low", "conf_high")], F.lit("Actual").alias("model"))
    path = forecasts.withColumnRenamed("target_date", "date").join(last.select("card_id", F.col("date").alias("_at")), "card_id").where((F.col("date") > F.col("_at")) & (F.col("date") <= F.date_add("_at", days)))
    return start.unionByName(path.select("card_id", "date", "pred_price", "conf_low", "conf_high", "model"))


def shadow_paths(forecasts: DataFrame, prices: DataFrame) -> DataFrame:
    """Each earlier run with the actual price on its day before its forecasts."""
    old = by_run(forecasts, False)
    runs = old.select("card_id", "run_id", "run_date", "model").distinct()
    starts = runs.join(prices.select("card_id", F.col("date").alias("run_date"), F.col("price").alias("pred_price")), ["card_id", "run_date"])
    return starts.withColumn("date", F.col("run_date")).unionByName(old.select("card_id", "run_id", "run_date", "model", "pred_price", F.col("target_date").alias("date")), allowMissingColumns=True)


def diagnosis_table(accuracy: DataFrame, prices: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Accuracy with the latest price and the last day's forecast of the newest run, and the change between them."""
    end = W.partitionBy("card_id", "model")
    far = by_run(forecasts, True).withColumn("_far", F.max("target_date").over(end)).where(F.col("target_date") == F.col("_far"))
    df = accuracy.join(latest_price(prices).select("card_id", F.col("price").alias("current_price")), "card_id").join(far.select("card_id", "model", "pred_price"), ["card_id", "model"])
    change = F.col("pred_price") - F.col("current_price")
    return df.withColumns({"change": change, "pct_change": 100 * change / F.nullif(F.col("current_price"), F.lit(0.0))})


def drift_paths(contexts: list, horizon: int) -> list:
    """Five paths for each context: the last price and its mean step, times 0.8 to 1.2. A stand-in for a network."""
    import numpy as np

    out = []
    for x in contexts:
        step = (x[-1] - x[0]) / max(1, len(x) - 1)
        out.append(x[-1] + np.outer(0.1 * np.arange(8, 13), step * np.arange(1, horizon + 1)))
    return out


def batch_forecast(prices: DataFrame, predict: Callable[[list, int], list] = drift_paths, horizon: int = 30, size: int = 256, batch: int = 8, min_days: int = 180, model: str = "Drift") -> DataFrame:
    """Backtest: each card's newest ``horizon`` days are hidden, and a model sees up to ``size`` prices before them.

    ``predict`` takes a batch of contexts and gives, for each, paths by sample; it runs on the executors, batch by
    batch, as a network would. The result has the median and the 10 % and 90 % quantiles by hidden day.
    """
    s = F.sort_array(F.collect_list(F.struct("date", "price")))
    whole = prices.groupBy("card_id").agg(s.alias("s")).where(F.size("s") >= max(min_days, horizon + 1))
    past = F.size("s") - horizon
    contexts = whole.select("card_id", F.slice("s.price", F.greatest(past - size, F.lit(0)) + 1, F.least(past, F.lit(size))).alias("context"), F.slice("s.date", past + 1, horizon).alias("days"))

    def run(frames: Iterator) -> Iterator:
        import datetime

        import numpy as np
        import pandas as pd

        for pdf in frames:
            rows = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                samples = predict([np.asarray(c, float) for c in part["context"]], horizon)
                for card, days, paths in zip(part["card_id"], part["days"], samples, strict=True):
                    q = np.quantile(paths, [0.5, 0.1, 0.9], axis=0)
                    start = days[0] - datetime.timedelta(days=1)
                    rows += [(card, start, day, *map(float, q[:, k]), model) for k, day in enumerate(days)]
            yield pd.DataFrame(rows, columns=["card_id", "run_date", "target_date", "pred_price", "conf_low", "conf_high", "model"])

    return contexts.mapInPandas(run, "card_id string, run_date date, target_date date, pred_price double, conf_low double, conf_high double, model string")
