"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): the smallest id that links reach.

    Each round every node moves to the smallest of itself and its neighbours, twice over, and links between the
    places they moved to remain; a minimum needs no list of neighbours, so a node with very many links is summed up
    before it is dealt out. The number of rounds grows with the logarithm of the longest path.
    """
    open_ = cut(links.where("a <> b").select("a", "b").distinct(), "links")
    moved: DataFrame | None = None
    while not open_.isEmpty():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "step")
        far = near.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = cut(near.join(far, "to").select("id", F.col("next").alias("to")), "step")
        at = lambda c: step.select(F.col("id").alias(c), F.col("to").alias(f"{c}2"))  # noqa: E731, B023
        left = cut(open_.join(at("a"), "a").join(at("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "links")
        if moved is None:
            moved = cut(step.select("id", F.col("to").alias("root")), "roots")
        else:
            old, moved = moved, cut(moved.join(step.select(F.col("id").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
            discard(old)
        discard(open_, near, step)
        open_ = left
    discard(open_)
    if moved is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    return moved
