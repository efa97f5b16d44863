"""Statistics of series kept up to date by day: a small state for each card, and a day's rows that are merged into it.

The state holds what can be merged exactly: counts, means, second and third central moments, those of neighbouring
prices, extremes, first and last price, and the length of the path. The newest ``holdout`` rows wait in the state until
newer ones come, as statistics that leave these out need. Merging history and then day after day gives what one run
over all rows gives. Rows of a day that a card's state has passed are left out, so a delta that is replayed changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Of a card: rows that are merged (n, of prices that aren't null), their moments, and pairs of neighbours among them.
STATE = (
    "card_id string, last_day date, rows bigint, n bigint, mean double, m2 double, m3 double, low double, high double, first_price double, last_price double, path double, "
    "pairs bigint, mean_b double, mean_a double, m2_b double, m2_a double, c_ba double, waiting array<struct<date: date, price: double>>"
)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def _delta(rows: DataFrame) -> DataFrame:
    """State of the rows that are ``due``, on their own, and an array of those that aren't. ``before`` is the price of the
    row before, null if there is none."""
    due, both = F.col("due"), F.col("due") & F.col("before").isNotNull() & F.col("price").isNotNull()
    price, day = F.when(due, F.col("price")), F.when(due, F.col("date"))
    n, var, pairs = F.count(price), F.var_pop(price), F.count(F.when(both, 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x, y = F.when(both, F.col("before")), F.when(both, F.col("price"))
    return rows.groupBy("card_id").agg(
        F.max(day).alias("last_day"), F.count(day).alias("rows"), n.alias("n"), zero(F.avg(price)).alias("mean"), zero(var * n).alias("m2"), zero(F.when(var > 0, F.skewness(price)) * n * F.pow(var, 1.5)).alias("m3"),
        F.min(price).alias("low"), F.max(price).alias("high"), F.min_by("price", day).alias("first_price"), F.max_by("price", day).alias("last_price"), zero(F.sum(F.abs(y - x))).alias("path"), pairs.alias("pairs"),
        zero(F.avg(x)).alias("mean_b"), zero(F.avg(y)).alias("mean_a"), zero(F.var_pop(x) * pairs).alias("m2_b"), zero(F.var_pop(y) * pairs).alias("m2_a"), zero(F.covar_pop(x, y) * pairs).alias("c_ba"),
        F.sort_array(F.collect_list(F.when(~due, F.struct("date", "price")))).alias("waiting"),
    )


def _merged(old: str, new: str) -> dict[str, Column]:
    """Moments of two sets from those of each."""
    o, d = (lambda c: F.coalesce(F.col(f"{old}.{c}"), F.lit(0))), (lambda c: F.coalesce(F.col(f"{new}.{c}"), F.lit(0)))
    n, gap = o("n") + d("n"), d("mean") - o("mean")
    share = lambda x: x / F.nullif(n, F.lit(0))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    m2 = o("m2") + d("m2") + zero(share(gap * gap * o("n") * d("n")))
    m3 = o("m3") + d("m3") + zero(share(share(gap * gap * gap * o("n") * d("n") * (o("n") - d("n"))))) + zero(share(3 * gap * (o("n") * d("m2") - d("n") * o("m2"))))
    pairs = o("pairs") + d("pairs")
    part = lambda x: zero(x / F.nullif(pairs, F.lit(0)))
    b, a, both = d("mean_b") - o("mean_b"), d("mean_a") - o("mean_a"), o("pairs") * d("pairs")
    mean = lambda c, gap, k: o(c) + gap * k
    return {
        "last_day": F.greatest(f"{old}.last_day", f"{new}.last_day"), "rows": o("rows") + d("rows"), "n": n, "mean": mean("mean", gap, zero(share(d("n")))), "m2": m2, "m3": m3,
        "low": F.least(f"{old}.low", f"{new}.low"), "high": F.greatest(f"{old}.high", f"{new}.high"),
        "first_price": F.when(F.col(f"{old}.last_day").isNotNull(), F.col(f"{old}.first_price")).otherwise(F.col(f"{new}.first_price")),
        "last_price": F.when(F.col(f"{new}.last_day").isNotNull(), F.col(f"{new}.last_price")).otherwise(F.col(f"{old}.last_price")), "path": o("path") + d("path"),
        "pairs": pairs, "mean_b": mean("mean_b", b, part(d("pairs"))), "mean_a": mean("mean_a", a, part(d("pairs"))), "m2_b": o("m2_b") + d("m2_b") + part(b * b * both),
        "m2_a": o("m2_a") + d("m2_a") + part(a * a * both), "c_ba": o("c_ba") + d("c_ba") + part(b * a * both),
    }


def merge_state(state: DataFrame, prices: DataFrame, holdout: int = 0) -> DataFrame:
    """The state with a day's (or any later) prices, one row for each card and day. ``prices`` may be all history, with
    an empty state. Cards without new rows stay as they are."""
    at = W.partitionBy("card_id").orderBy("date")
    seen = state.select("card_id", F.coalesce(F.array_max("waiting.date"), "last_day").alias("passed"), F.col("last_price").alias("end"))
    new = prices.select("card_id", "date", "price").join(seen, "card_id", "left").where("passed is null or date > passed").drop("passed")
    waited = state.select("card_id", F.col("last_price").alias("end"), F.explode("waiting").alias("r")).select("card_id", "r.*", "end")
    rows = new.unionByName(waited).withColumns({"due": F.row_number().over(W.partitionBy("card_id").orderBy(F.desc("date"))) > holdout, "before": F.lag("price").over(at), "k": F.row_number().over(at)})
    delta = _delta(rows.withColumn("before", F.when(F.col("k") == 1, F.col("end")).otherwise(F.col("before"))))
    fields = [f.name for f in state.schema if f.name not in ("card_id", "waiting")]
    pack = lambda df, name: df.select("card_id", F.struct(*fields, "waiting").alias(name))
    both = pack(state, "old").join(pack(delta, "delta"), "card_id", "full")
    kinds, merged = {f.name: f.dataType for f in state.schema}, _merged("old", "delta")
    return both.select("card_id", *[merged[c].cast(kinds[c]).alias(c) for c in fields], F.coalesce("delta.waiting", "old.waiting").alias("waiting"))


def metrics_of(state: DataFrame, min_rows: int = 10) -> DataFrame:
    """What ``ts_metrics`` gives of the merged rows, but for entropy and Hurst exponent, which need the whole series."""
    positive = lambda c: F.nullif(c, F.lit(0.0))
    n, m2, corr = F.col("n"), F.col("m2"), F.sqrt(F.col("m2_b") * F.col("m2_a"))
    return state.where(F.col("rows") >= min_rows).select(
        "card_id", F.col("rows").alias("n_days"), F.col("last_price").alias("current_price"), F.when(n > 0, F.col("mean")).alias("avg_price"),
        (F.when(n > 1, F.sqrt(m2 / (n - 1))) / positive(F.col("mean"))).alias("cv"), (F.sqrt(n) * F.col("m3") / positive(F.pow(m2, 1.5))).alias("skewness"), (F.col("c_ba") / positive(corr)).alias("lag1_corr"),
    )


def chaos_of(state: DataFrame) -> DataFrame:
    """What ``chaos_index`` gives without tiers, of the rows that don't wait."""
    net, path = F.abs(F.col("last_price") - F.col("first_price")), F.col("path")
    out = state.where("rows > 0").select("card_id", net.alias("net_change"), path.alias("sum_of_changes"), ((F.col("high") - F.col("low")) / F.nullif("mean", F.lit(0.0))).alias("span_range"))
    out = out.withColumn("efficiency_ratio", F.when(F.col("sum_of_changes") > 0, F.col("net_change") / F.nullif("sum_of_changes", F.lit(0.0))).otherwise(1.0))
    return out.withColumn("chaos_cv", F.col("span_range") * (1 - F.col("efficiency_ratio")))


class StateTable:
    """A state in a folder, in numbered versions. A reader has a whole version at any time; a merge that fails leaves the
    last one, and older ones than ``keep`` go."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _folders(self) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        here = [s.getPath() for s in fs.listStatus(at)]
        return sorted(int(p.getName().split("=")[1]) for p in here if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        done = self._folders()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/version={done[-1]}") if done else empty_state(self.spark)

    def merge(self, prices: DataFrame, holdout: int = 0) -> None:
        done = self._folders()
        merge_state(self.read(), prices, holdout).write.mode("overwrite").parquet(f"{self.path}/version={done[-1] + 1 if done else 0}")
        jvm = self.spark._jvm
        for old in done[: max(0, len(done) + 1 - self.keep)]:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
