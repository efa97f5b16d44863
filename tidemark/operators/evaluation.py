"""Forecasts against actual prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.local_regression import local_regression
from tidemark.functions.quantiles import counted_values, exact_quantiles, quantiles_of

from .timeseries import newest


def ape(actual: str = "actual_price", pred: str = "pred_price") -> Column:
    """Absolute error as a share of the actual price; null where that is 0."""
    return F.abs(F.col(actual) - F.col(pred)) / F.nullif(F.abs(F.col(actual)), F.lit(0.0))


def residuals(forecasts: DataFrame, prices: DataFrame) -> DataFrame:
    actual = prices.select("card_id", F.col("date").alias("target_date"), F.col("price").alias("actual_price"))
    df = forecasts.join(actual, ["card_id", "target_date"])
    return df.select(
        "card_id", F.col("model").alias("model_type"), F.datediff("target_date", "run_date").alias("horizon"), "actual_price", "pred_price", F.round(ape(), 4).alias("error_abs_pct"), "target_date", "run_date"
    )


def rollup(residuals_: DataFrame) -> DataFrame:
    """Mean and median error and the number of cards by model, horizon and day. Rows without a card don't exist here, so
    all three come from the counts of values."""
    keys = ["model_type", "horizon", "target_date"]
    counted = counted_values(residuals_, keys, "error_abs_pct")
    known = F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")))
    mean = counted.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_c")) / known).alias("mean_error_pct"), F.sum("_c").alias("card_count"))
    return mean.join(quantiles_of(counted, keys, {"median_error_pct": 0.5}), keys, "left")


def pool(forecasts: DataFrame, prices: DataFrame, tiers: DataFrame) -> DataFrame:
    """Errors of all forecasts with a known price, with the card's tier (null if it has none)."""
    r = residuals(forecasts, prices).withColumn("ape", ape())
    return r.withColumnRenamed("model_type", "model").withColumnRenamed("horizon", "day_offset").join(tiers.select("card_id", "volatility_tier"), "card_id", "left")


def by_card(p: DataFrame) -> DataFrame:
    return p.groupBy("card_id", "model", "volatility_tier").agg(F.avg("ape").alias("mape"), F.max("ape").alias("max_error"))


def by_day(p: DataFrame) -> DataFrame:
    return p.groupBy("target_date", "model").agg(F.avg("ape").alias("daily_mape"))


def by_horizon(p: DataFrame) -> DataFrame:
    return p.groupBy("model", "day_offset", "volatility_tier").agg(F.avg("ape").alias("horizon_mape"))


def head_to_head(p: DataFrame, a: str, b: str) -> DataFrame:
    """Both models' mean errors by card, the better one (the first on a tie) and by how much."""
    wide = p.groupBy("card_id").pivot("model", [a, b]).agg(F.avg("ape")).select("card_id", F.round(a, 9).alias(f"mape_{a}"), F.round(b, 9).alias(f"mape_{b}"))
    x, y = F.col(f"mape_{a}"), F.col(f"mape_{b}")
    return wide.withColumns({"winner": F.when(x <= y, a).when(y < x, b), "margin": F.abs(x - y)})


def blowouts(h: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` widest margins of each winner."""
    w = W.partitionBy("winner").orderBy(F.desc("margin"), "card_id")
    return h.where("winner is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def leaderboard(p: DataFrame, models: list[str]) -> DataFrame:
    """Mean errors by card and model; the winner is the first of the smallest, nulls left out."""
    wide = p.groupBy("card_id").pivot("model", models).agg(F.avg("ape"))
    wide = wide.select("card_id", *[F.round(m, 9).alias(m) for m in models])
    best = F.least(*[F.col(m) for m in models])
    winner = F.coalesce(*[F.when(F.col(m) == best, m) for m in models])
    return wide.withColumns({"winner": winner, "margin": F.greatest(*[F.col(m) for m in models]) - best})


def naive_baselines(prices: DataFrame, cutoff: DataFrame, days: int = 7, mean_of: int = 30) -> DataFrame:
    """Mean error by day after a cutoff (one row ``cutoff``) of the last price and of the mean of the last prices."""
    both = prices.join(F.broadcast(cutoff))
    past = newest(both.where(F.col("date") <= F.col("cutoff")), 1, mean_of)
    base = past.groupBy("card_id").agg(F.max_by("price", "date").alias("persistence"), F.avg("price").alias("moving_average"))
    ahead = both.where((F.col("date") > F.col("cutoff")) & (F.col("date") <= F.date_add("cutoff", days))).join(base, "card_id")
    error = lambda c: F.avg(ape("price", c)).alias(c)
    wide = ahead.groupBy(F.datediff("date", "cutoff").alias("day_offset")).agg(error("persistence"), error("moving_average"))
    return wide.unpivot(["day_offset"], ["persistence", "moving_average"], "baseline", "mape")


def fan(p: DataFrame) -> DataFrame:
    names = {"median_ape": 0.5, "p75_ape": 0.75, "p90_ape": 0.9}
    q = exact_quantiles(p, ["model", "day_offset"], "ape", names)
    return q.select("model", "day_offset", *[F.round(n, 6).alias(n) for n in names])


def outliers(p: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Mean error by card and model, and whether it is over the model's mean by so many standard deviations."""
    each = p.groupBy("card_id", "model").agg(F.avg("ape").alias("mape"))
    limit = each.groupBy("model").agg((F.avg("mape") + sigmas * F.coalesce(F.stddev_samp("mape"), F.lit(0.0))).alias("_limit"))
    return each.join(F.broadcast(limit), "model").select("card_id", "model", "mape", F.coalesce(F.round("mape", 9) > F.round("_limit", 9), F.lit(False)).alias("is_outlier"))


def error_trend(p: DataFrame, volatility: DataFrame) -> DataFrame:
    """Least squares of a card's mean error on its volatility, by model."""
    df = p.groupBy("card_id", "model").agg(F.avg("ape").alias("mape")).join(volatility, "card_id")
    return df.groupBy("model").agg(F.regr_slope("mape", "chaos_cv").alias("slope"), F.regr_intercept("mape", "chaos_cv").alias("intercept"), F.regr_r2("mape", "chaos_cv").alias("r2"), F.count(F.lit(1)).alias("n"))


def box_stats(p: DataFrame, *keys: str) -> DataFrame:
    counted = counted_values(p, list(keys), "ape")
    q = quantiles_of(counted, list(keys), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    ends = counted.where("_v is not null").groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_c").alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & q[k].eqNullSafe(ends[f"{k}_"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    df = q.join(ends, same).withColumns({"low": F.greatest("lo", F.col("q1") - reach), "high": F.least("hi", F.col("q3") + reach)})
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")], "n")


def regression_eval(df: DataFrame, actual: str, pred: str) -> DataFrame:
    return df.select(F.round(actual, 2).alias("actual"), F.round(pred, 2).alias("predicted"), F.round(F.col(pred) - F.col(actual), 2).alias("difference"))


def age_points(p: DataFrame, catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """(card_id, model, mape, days_since_release): mean errors of cards with their age on the last day of all prices; a
    card that is yet to come out has the age 0. Cards without catalog entry or release day go."""
    each = p.groupBy("card_id", "model").agg(F.avg("ape").alias("mape")).join(catalog.select(F.col("id").alias("card_id"), "released_at").where("released_at is not null"), "card_id")
    last = prices.agg(F.max("date").alias("_last"))
    return each.join(F.broadcast(last)).withColumn("days_since_release", F.greatest(F.datediff("_last", "released_at"), F.lit(0))).drop("_last", "released_at")


def error_by_age(points: DataFrame, span: float = 0.75) -> DataFrame:
    """Local regression of a card's mean error on its age, by model, at each age that a card has. All cards are points."""
    return local_regression(points, "model", "days_since_release", "mape", span)


def loess(df: DataFrame, by: str, x: str, y: str, span: float = 0.75) -> DataFrame:
    """Locally weighted quadratic fit at each distinct x of a group; groups are small tables of means.

    The nearest ``span`` of the points have tricube weights by distance. Where three weights aren't positive, the
    weighted mean stands in.
    """

    def fit(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.dropna()
        xs, ys = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        k = max(1, int(np.floor(span * len(xs) + 1e-5)))
        out = []
        for x0 in np.unique(xs):
            d = np.abs(xs - x0)
            h = max(np.sort(d)[k - 1], 1e-12)
            w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3
            s = [float((w * (xs - x0) ** i).sum()) for i in range(5)]
            t = [float((w * (xs - x0) ** i * ys).sum()) for i in range(3)]
            a, b, c = s[2] * s[4] - s[3] ** 2, s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] ** 2
            det = s[0] * a - s[1] * b + s[2] * c
            flat = abs(det) < 1e-9 * max(1.0, s[0]) ** 3
            out.append((pdf[by].iloc[0], float(x0), t[0] / s[0] if flat else (t[0] * a - s[1] * (t[1] * s[4] - t[2] * s[3]) + s[2] * (t[1] * s[3] - t[2] * s[2])) / det))
        return pd.DataFrame(out, columns=[by, x, "smooth"])

    return df.groupBy(by).applyInPandas(fit, f"{by} {df.schema[by].dataType.simpleString()}, {x} double, smooth double")
