"""Locally weighted regression of groups of any size.

Points with the same x are summed up before they meet, so ties cost nothing and a group has as many rows as values of
x. These are ranked and cut into ranges of targets; each range gets the rows that can be among the nearest of its
targets, on either side, and is fitted on its own. No task holds the points of a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Targets that are fitted at once: a table of so many by the points around them is in memory.
BLOCK = 32


def fitted(x: np.ndarray, n: np.ndarray, total: np.ndarray, targets: np.ndarray, k: int) -> np.ndarray:
    """Quadratic fits at ``targets`` through points at distinct ``x``: ``n`` points with the sum ``total`` at each.

    The ``k`` nearest points, ties at their reach included, have tricube weights by distance. Where these don't
    determine a parabola, the weighted mean stands in.
    """
    out = []
    for a in range(0, len(targets), BLOCK):
        x0 = targets[a : a + BLOCK, None]
        d = np.abs(x[None, :] - x0)
        order = np.argsort(d, axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
        reach = np.take_along_axis(d, order, axis=1)[np.arange(len(x0)), enough][:, None]
        reach = np.maximum(reach, 1e-12)
        w, u = np.clip(1 - (d / reach) ** 3, 0, 1) ** 3, (x[None, :] - x0) / reach
        s = [(w * n * u**i).sum(axis=1) for i in range(5)]
        t = [(w * total * u**i).sum(axis=1) for i in range(3)]
        p, q, r = s[2] * s[4] - s[3] ** 2, s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] ** 2
        det = s[0] * p - s[1] * q + s[2] * r
        flat = np.abs(det) < 1e-9 * s[0] ** 3
        top = t[0] * p - s[1] * (t[1] * s[4] - t[2] * s[3]) + s[2] * (t[1] * s[3] - t[2] * s[2])
        out.append(np.where(flat, t[0] / s[0], top / np.where(flat, 1.0, det)))
    return np.concatenate(out)


def local_regression(df: DataFrame, by: str, x: str, y: str, span: float = 0.75, targets: int = 512) -> DataFrame:
    """(by, x, n, smooth): the smoothed y at each x that a group has, and how many points are there.

    The nearest ``span`` of a group's points have weight. Points with a null x or y are left out; a group without
    others gives nothing. The windows see a row for each distinct x of a group.
    """
    own = W.partitionBy(by)
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("total"))
    ranked = points.withColumns({"upto": F.sum("n").over(own.orderBy("x")), "every": F.sum("n").over(own), "range": F.floor((F.row_number().over(own.orderBy("x")) - 1) / targets)})
    k = F.greatest(F.floor(F.lit(span) * F.col("every") + 1e-5), F.lit(1))
    # The k nearest of a target are among the k points below and the k above it.
    ranges = ranked.groupBy(F.col(by).alias("_by"), F.col("range").alias("_range")).agg((F.min(F.col("upto") - F.col("n")) - F.min(k)).alias("low"), (F.max("upto") + F.max(k)).alias("high"), F.min(k).alias("k"))
    near = ranked.join(ranges, F.col(by).eqNullSafe(F.col("_by")) & (F.col("upto") > F.col("low")) & (F.col("upto") - F.col("n") < F.col("high")))
    near = near.select(by, F.col("_range"), "k", "x", "n", "total", (F.col("range") == F.col("_range")).alias("target"))

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("x")
        at, is_target = pdf["x"].to_numpy(), pdf["target"].to_numpy(bool)
        smooth = fitted(at, pdf["n"].to_numpy(float), pdf["total"].to_numpy(), at[is_target], int(pdf["k"].iloc[0]))
        return pd.DataFrame({by: pdf[by][is_target].to_numpy(), x: at[is_target], "n": pdf["n"][is_target].to_numpy(), "smooth": smooth})

    return near.groupBy(by, "_range").applyInPandas(fit, f"{by} {df.schema[by].dataType.simpleString()}, {x} double, n bigint, smooth double")
