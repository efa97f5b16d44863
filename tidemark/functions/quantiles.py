"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.sources.steps import kept

#: Buckets of values: within one, values differ by at most one in so many.
FINE = 100


def _bucket(v: Column) -> Column:
    """A whole number that rises with v, by its logarithm."""
    size = lambda x: F.floor(F.log(x) * FINE) + 1_000_000
    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0).cast("long"))


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, _v, _c): how often each value occurs in a group, written once for all that is computed of it. Null values
    are counted, too."""
    return kept(df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")), "values")


def quantiles_of(counted: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """One row for each group: its keys and, by name, quantiles of the values (interpolated, nulls left out).

    Counts by bucket tell in which buckets the wanted places are; only values of these are put in order, so no task
    holds or sorts the values of a whole group.
    """
    counted = counted.where("_v is not null").withColumn("_b", _bucket(F.col("_v")))
    own = W.partitionBy(*keys)
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n")).withColumns({"_start": before(own.orderBy("_b"), "_n"), "_all": F.sum("_n").over(own)})
    place = lambda n, p: F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("at"))
    both = lambda t: F.array_distinct(F.array(F.floor(t["at"]), F.ceil(t["at"])))
    places = F.flatten(F.transform(F.array(*[place(n, p) for n, p in probs.items()]), lambda t: F.transform(both(t), lambda i: F.struct(t["name"].alias("name"), t["at"].alias("at"), i.alias("i")))))
    here = F.filter(places, lambda x: (x["i"] >= F.col("_start")) & (x["i"] < F.col("_start") + F.col("_n")))
    wanted = buckets.withColumn("_want", here).where(F.size("_want") > 0).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_b").alias("_b_"), "_start", "_want")

    same = reduce(lambda x, y: x & y, [counted[k].eqNullSafe(wanted[f"{k}_"]) for k in [*keys, "_b"]])
    inside = counted.join(wanted, same).withColumn("_from", F.col("_start") + before(W.partitionBy(*keys, "_b").orderBy("_v"), "_c"))
    found = inside.select(*keys, "_v", F.explode(F.filter("_want", lambda x: (x["i"] >= F.col("_from")) & (x["i"] < F.col("_from") + F.col("_c")))).alias("_t"))
    found = found.select(*keys, "_v", "_t.*")

    def one(name: str) -> Column:
        mine = F.col("name") == name
        lo, hi = F.min_by(F.when(mine, F.col("_v")), F.when(mine, F.col("i"))), F.max_by(F.when(mine, F.col("_v")), F.when(mine, F.col("i")))
        at = F.max(F.when(mine, F.col("at")))
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return found.groupBy(*keys).agg(*[one(n) for n in probs])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """``quantiles_of`` the values of a column. Equal values are counted before anything is shuffled."""
    return quantiles_of(counted_values(df, keys, value), keys, probs)
