"""Audit of how five filters overlap, under every order of them, in DataFrame functions only.

One pass over the texts gives each document a mask of the conditions that it fails, its code-point length and hashes
of successive blocks (64 characters, then eight times as many each time). Copies are found by refining a partition of
the documents: by length, then by one block hash after another; a document that is alone in its class is dropped, and
one whose text has ended leaves the loop. What survives is compared by whole texts: the smallest and the largest text
of a class are equal if all are. Classes that hashes have mixed are told apart by their texts.

Counts are taken by part and mask, at most 128 of a part; all orders are worked out from these.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, discard

FILTERS = "ABCDE"
FIRST, TIMES, BLOCKS = 64, 8, 10
#: Up to so many classes are sent to all executors, to keep other texts from the shuffle; beyond, all texts are joined.
BROADCAST_CLASSES = 200_000
GOOD, TOXIC = 32, 64


def _block_hashes(text: Column, n: Column, hash_bits: int) -> Column:
    """Hashes of the blocks that a text of ``n`` characters has; the last block has no end."""
    out, at, size = [], 0, FIRST
    for k in range(BLOCKS):
        h = F.xxhash64(F.substring(text, at + 1, size if k < BLOCKS - 1 else 2**31 - 1))
        out.append(F.when(n > at, h if hash_bits >= 64 else h.bitwiseAND((1 << hash_bits) - 1)))
        at, size = at + size, size * TIMES
    return F.array_compact(F.array(*out))


def _examined(docs: DataFrame, id_col: str, text_col: str, part_col: str, hash_bits: int) -> DataFrame:
    """id, part, text, mask of the conditions A to D, length and block hashes of each document."""
    t, n = F.col("t"), F.col("n")
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("n", F.length(t).cast("long")).withColumn("words", F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), ""))
    words, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    fails = (words < 50, 100 * distinct < 65 * words, 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 5 * n, t.rlike(r"[#$%&*|]"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return df.select("id", "part", "t", mask.alias("mask"), "n", _block_hashes(t, n, hash_bits).alias("hashes"))


def _labelled(df: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """``df`` with bits for good and toxic documents in the mask."""
    is_one = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    bits = labels.groupBy(F.col(id_col).alias("id")).agg((is_one("quality", GOOD) + is_one("toxic", TOXIC)).alias("bits")).where("bits > 0")
    return df.join(bits, "id", "left").withColumn("mask", F.col("mask") + F.coalesce("bits", F.lit(0))).drop("bits")


def _shared(rows: DataFrame) -> list[DataFrame]:
    """Tables of the rows that share length and all block hashes with another row, by the round in which their texts
    ended."""
    live, out = rows.withColumn("class", F.col("n")), []
    for k in range(-1, BLOCKS):
        keyed = live.withColumn("h", F.lit(0).cast("long") if k < 0 else F.get("hashes", F.lit(k)))
        classes = cut(keyed.groupBy("class", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("class", "h", F.monotonically_increasing_id().alias("name")), "classes")
        step = cut(keyed.join(classes, ["class", "h"]).select("id", "part", "mask", "n", "hashes", F.col("name").alias("class")), "refined")
        discard(classes)
        ended = F.size("hashes") <= k + 1
        out.append(step.where(ended).drop("class"))
        live = step.where(~ended)
        if live.isEmpty():
            break
    return out


def _copies(docs: DataFrame, labels: DataFrame, rows: DataFrame, cols: tuple[str, str, str], hash_bits: int) -> DataFrame:
    """part and mask of each document that has the text of one with a smaller id."""
    found = _shared(rows)
    alike = found[0]
    for f in found[1:]:
        alike = alike.unionByName(f)
    key = ["n", "hashes"]
    texts = _examined(docs, *cols, hash_bits).select("id", "t", *key)
    classes = cut(alike.select(*key).distinct(), "shared")
    if classes.count() <= BROADCAST_CLASSES:
        # Classes that share this hash let texts through which then are alone in their class, or don't copy another.
        texts = texts.withColumn("k", F.xxhash64(*key)).join(F.broadcast(classes.select(F.xxhash64(*key).alias("k")).distinct()), "k", "left_semi").drop("k")
    else:
        texts = texts.join(classes, key, "left_semi")
    compared = texts.groupBy(*key).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("id").alias("first")).select(*key, "first", (F.col("lo") != F.col("hi")).alias("mixed"))
    compared = cut(compared, "compared", release=True)
    out = alike.join(compared.where("not mixed"), key).where("id > first").select("part", "mask")
    mixed = compared.where("mixed").select(*key)
    if not mixed.isEmpty():
        rest = _labelled(_examined(docs, *cols, hash_bits).join(mixed, key, "left_semi"), labels, cols[0])
        first = rest.groupBy("n", "t").agg(F.min("id").alias("first"))
        out = out.unionByName(rest.join(first, ["n", "t"]).where("id > first").select("part", "mask"))
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hash_bits: int = 64) -> DataFrame:
    """Documents by part and mask: bits 1 to 16 for the filters A to E that fail, 32 for good, 64 for toxic ones."""
    cols = (id_col, text_col, part_col)
    rows = cut(_labelled(_examined(docs, *cols, hash_bits).drop("t"), labels, id_col), "examined")
    copies = cut(_copies(docs, labels, rows, cols, hash_bits).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("c")), "copies")
    every = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("c"))
    moved = copies.select("part", "mask", (-F.col("c")).alias("c")).unionByName(copies.select("part", (F.col("mask") + 16).alias("mask"), "c"))
    return every.unionByName(moved).groupBy("part", "mask").agg(F.sum("c").alias("c")).where("c > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hash_bits: int = 64) -> DataFrame:
    """One row for each part, order of the five filters, and step, with counts of documents.

    A null text is empty, a null part the empty string. A document fails E if a smaller id has its text; no id is
    smaller than a null one, and rows that repeat id and text don't copy each other. Of labels that repeat an id, any
    that is 1 counts; documents without a label are neither good nor toxic. Other columns aren't used, whatever their
    names. A table without rows has no parts and gives none. ``hash_bits`` below 64 makes texts share hashes, for tests.
    """
    counts = mask_counts(docs, labels, id_col, text_col, part_col, hash_bits)
    when = lambda bit: F.sum(F.when(F.col("mask").bitwiseAND(bit) > 0, F.col("c")).otherwise(0))
    cells = counts.groupBy("part", F.col("mask").bitwiseAND(31).alias("m")).agg(F.sum("c").alias("n"), when(GOOD).alias("good"), when(TOXIC).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("m", "n", "good", "toxic")).alias("cells"))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    # What a step does depends on its filter and the set of those before it, not on their order.
    steps = [(sum(bit[x] for x in before), bit[f]) for f in FILTERS for r in range(5) for before in combinations(FILTERS.replace(f, ""), r)]
    each = parts.withColumn("s", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in steps]))).select("part", "cells", "s.*")
    total = lambda value, condition: F.expr(f"aggregate(cells, 0L, (s, x) -> s + if({condition}, {value}, 0L))")
    here = "x.m & bit > 0 and x.m & before = 0"
    each = each.select(
        "part", "before", "bit", total("x.n", "x.m & (before | bit) = 0").alias("kept"), total("x.n", here).alias("removed"), total("x.n", "x.m & bit > 0 and x.m & before > 0").alias("redundant"),
        total("x.n", "x.m = bit").alias("unique_fails"), total("x.good", here).alias("good_lost"), total("x.toxic", here).alias("toxic_lost"),
        # Of all 120 orders, each filter that a document fails comes first of these in an equal share.
        total("x.n * (120 div bit_count(x.m))", "x.m & bit > 0").alias("shapley"),
    )
    orders = [("".join(o), k + 1, sum(bit[x] for x in o[:k]), bit[f]) for o in permutations(FILTERS) for k, f in enumerate(o)]
    table = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    return each.join(F.broadcast(table), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
