"""As-of joins: each row with the newest row of another table up to its own time.

Both sides are put below one another and dealt out by key, so one exchange brings a key's rows together; in the order
of time, the last row of the right side that came by is the match. Nothing is compared pair by pair. Where one key may
hold a large share of all rows, ``slices`` cuts its time: keys are then dealt out by slice, and what a slice begins
with comes from one row for each earlier slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: str | None = None, exact: bool = True, how: str = "left", slices: str | None = None) -> DataFrame:
    """``left`` with the columns of ``right``'s newest row of the same key at or before its own ``at``.

    ``by`` and ``at`` are columns of both; the match's own time is ``{at}_right``. Without ``exact`` the match must be
    older. ``tolerance`` is an interval ("7 days"): an older match doesn't count. ``how`` is left or inner. Of right rows
    with the same key and time, the greatest by all their columns counts. Rows whose key or time is null match nothing.
    ``slices`` is a unit of date_trunc ("month"); it doesn't change the result.
    """
    rest = [c for c in right.columns if c not in (*by, at)]
    clash = set(left.columns) & {*rest, f"{at}_right"}
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    known = F.lit(True)
    for c in (*by, at):
        known = known & F.col(c).isNotNull()
    key = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    keys = [f"_k{i}" for i in range(len(by))]
    mine, theirs = F.struct(*left.columns).alias("_left"), F.struct(F.col(at).alias(f"{at}_right"), *rest).alias("_right")
    # At the same time, the right side comes first where it counts.
    turn = lambda is_left: F.lit(int(is_left == exact)).alias("_turn")
    a = left.select(*key, F.col(at).alias("_at"), turn(True), mine, known.alias("_known"))
    b = right.where(known).select(*key, F.col(at).alias("_at"), turn(False), theirs)
    rows = a.unionByName(b, allowMissingColumns=True)
    before = lambda w: w.orderBy("_at", "_turn", "_right").rowsBetween(W.unboundedPreceding, 0)
    if slices is None:
        rows = rows.withColumn("_match", F.last("_right", ignorenulls=True).over(before(W.partitionBy(*keys))))
    else:
        rows = rows.withColumn("_slice", F.date_trunc(slices, "_at"))
        ends = rows.groupBy(*keys, "_slice").agg(F.max("_right").alias("_end"))  # the newest: its time comes first
        earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
        own = F.last("_right", ignorenulls=True).over(before(W.partitionBy(*keys, "_slice")))
        rows = rows.join(ends, [*keys, "_slice"], "left").withColumn("_match", F.coalesce(own, F.col("_carried")))
    found = F.col("_known")
    if tolerance is not None:
        found = found & (F.col(f"_match.{at}_right") >= F.col("_at") - F.expr(f"interval {tolerance}"))
    out = rows.where("_left is not null").select("_left.*", F.when(found, F.col("_match")).alias("_match"))
    if how == "inner":
        out = out.where("_match is not null")
    return out.select(*left.columns, "_match.*")


def forward_asof_join(left: DataFrame, right: DataFrame, by: list[str], day: str) -> DataFrame:
    """``left`` with the columns of ``right``'s oldest row of the same key on or after its own day, by mirrored days."""
    flip: Column = F.datediff(F.lit("1970-01-01"), F.col(day))
    turned = right.withColumn(f"_{day}", F.col(day)).withColumn(day, flip)
    out = asof_join(left.withColumn("_own", F.col(day)).withColumn(day, flip), turned, by, day)
    return out.withColumn(day, F.col("_own")).withColumn(f"{day}_right", F.col(f"_{day}")).drop("_own", f"_{day}")
