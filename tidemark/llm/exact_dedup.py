"""Exact dedup by deterministic block naming, in DataFrame functions only.

Every text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and get integers as
names; then names of adjacent pairs are named in the same way, level by level, until one name is left of each
document. Names stand for contents, never for hashes: two documents have the same (level, name) if and only if
their texts are equal.

A 64-bit hash only routes blocks. For each hash the smallest and the largest block are compared; where they are
equal, that hash has one block and the hash can stand for it in the join that hands names back, so the text of a
block crosses the network once, after copies within a task have been merged. Hashes with several blocks are joined
by the whole block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Up to so many hashes that several blocks share are sent to all executors; beyond, all blocks are joined whole.
MAX_SHARED_HASHES = 10_000


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as empty. Single spaces are left as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _named(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows of ``cols`` in sorted order with a rising integer ``name``."""
    ranged = df.select(*cols).distinct().repartitionByRange(*cols).sortWithinPartitions(*cols)
    return ranged.withColumn("name", F.monotonically_increasing_id())


def document_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048, hash_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """One row (id, sha, level, name) for each distinct (id, normalised text); (level, name) is the text's identity.

    Also (id, sha, copies), the number of rows that repeat them.

    ``hash_bits`` below 64 makes blocks share hashes, for tests of the exact way for these.
    """
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    pieces = F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    blocks = norm.select(
        "id", F.sha2("norm", 256).alias("sha"), F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(pieces).alias("blocks")
    ).select("id", "sha", F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    h = F.xxhash64("block")
    blocks = blocks.withColumn("h", h if hash_bits >= 64 else h.bitwiseAND((1 << hash_bits) - 1))

    by_hash = cut(
        blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).select("h", F.when(F.col("lo") != F.col("hi"), True).alias("shared")),
        "hashes", release=True,
    )
    shared = by_hash.where("shared")
    n = shared.count()
    if not n:
        names = cut(_named(by_hash, ["h"]), "blocks")
        level = blocks.select("id", "sha", "n", "pos", "h").join(names, "h")
    else:
        if n <= MAX_SHARED_HASHES:
            blocks = blocks.join(F.broadcast(shared), "h", "left").withColumn("block", F.when(F.col("shared"), F.col("block")).otherwise("")).drop("shared")
        names = cut(_named(blocks, ["h", "block"]), "blocks")
        level = blocks.join(names, ["h", "block"])
    level = cut(level.select("id", "sha", "n", F.col("pos").cast("long").alias("pos"), "name"), "level0")

    rows = level.where("pos = 0").groupBy("id", "sha").agg(F.count(F.lit(1)).alias("copies"))

    done, k = [], 0
    while True:
        done.append(level.where("n = 1").select("id", "sha", F.lit(k).alias("level"), "name"))
        rest = level.where("n > 1")
        if rest.isEmpty():
            break
        half = F.shiftright("pos", 1)
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("id", "sha", F.shiftright(F.col("n") + 1, 1).alias("n"), half.alias("pos")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = cut(pairs, f"pairs{k + 1}")
        names = cut(_named(pairs, ["a", "b"]), f"names{k + 1}")
        level, k = cut(pairs.join(names, ["a", "b"]).select("id", "sha", "n", "pos", "name"), f"level{k + 1}"), k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.distinct(), rows


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2048, hash_bits: int = 64) -> DataFrame:
    """One row for each input row: its id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts equal each other. Of rows that repeat both id and text, one can be
    kept. Rows with a null id belong to a group but stay only where the group has no other id (keep_id is null
    then). Other columns are not used, whatever their names. An empty table gives an empty result.
    """
    names, rows = document_names(docs, id_col, text_col, block_chars, hash_bits)
    names = names.select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), "level", "name")
    rows = cut(rows.join(names, (F.col("sha") == F.col("sha2")) & F.col("id").eqNullSafe(F.col("id2"))).select("id", "sha", "copies", "level", "name"), "identities")
    groups = rows.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    each = rows.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256")
    )
