"""From documents to packed training sequences: quality, toxicity, exact and near duplicates, packing.

Each stage works on all rows that the one before kept and returns the columns of documents; the last returns pieces
of sequences. Rows with a null id or text pass like others: a null text counts as empty. Rows that repeat an id are
judged one by one. An empty table stays empty. Other columns are carried along, whatever their names, but for names
that begin with an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.exact_dedup import exact_dedup, normalised
from tidemark.llm.packing import pack
from tidemark.llm.parity_join import parity_join
from tidemark.llm.quality_model import quality_model
from tidemark.llm.queries import VOCABULARY
from tidemark.llm.store import cut
from tidemark.llm.toxicity import toxicity


def _stay(operator, docs: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a condition on the operator's columns. The text and other columns go through the operator as
    one struct, so that no name can clash and nothing is joined."""
    kept = operator(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), carry=("_row",))
    return kept.where(condition).select("_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model calls good."""
    return _stay(quality_model, docs, "kept")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _stay(lambda d, carry: toxicity(d, labels, carry=carry), docs, "predicted = 0")


def _id(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id; of rows that repeat both, the first by their other
    columns as JSON."""
    stays = exact_dedup(docs).where("kept").select(_id("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = W.partitionBy("_id", "_sha").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    keyed = docs.withColumns({"_id": _id("doc_id"), "_sha": F.sha2(normalised(F.col("text")), 256)})
    return keyed.join(stays, ["_id", "_sha"], "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*docs.columns)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near duplicates reach, the one with the smallest id (a null id comes last).

    Rows go by a hash of id and text, so that those which repeat an id with other texts are documents of their own.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    rows = cut(parity_join(keyed.select("_row", "text"), id_col="_row").select("_row", "component_id").distinct(), "components")
    ids = keyed.select("_row", "doc_id").join(rows, "_row")
    stays = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select("component_id", F.col("first._row").alias("_first"))
    goes = cut(rows.join(stays, "component_id").where("_row <> _first").select("_row"), "goes")
    return keyed.join(goes, "_row", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: what op5_packing returns of each, and its token ids."""
    pieces = pack(docs, VOCABULARY, at_once=1_000_000)  # the stages before leave little memory
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality classifier", quality), ("toxicity", clean), ("exact dedup", distinct), ("n-gram join", unlike), ("packing", packed)]

#: The classifiers are trained models and the packing is a program, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k + 1}")
    return docs
