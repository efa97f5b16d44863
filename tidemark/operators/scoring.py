"""Enrichment of titles by a service that can be exchanged.

``client`` is called on the executors, once in each task, and gives a function from a list of rows (dictionaries) to a
list of replies. Rows go to it in batches. A batch that fails is tried again after a pause that doubles; if it still
fails, its rows are tried one by one, so that one bad row doesn't take others with it. A row that can't be answered has
no reply, and so the status ERROR, under which it is queued again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import new_rows
from tidemark.sources.tables import read_or_empty

from .listings import parse_enrichment

Client = Callable[[], Callable[[list[dict]], list[str]]]
ENRICHED = "item_id string, status string, is_valid boolean, is_graded boolean, grading_company string, grade_val string"


def _asked(ask: Callable[[list[dict]], list[str]], rows: list[dict], retries: int, pause: float) -> list[tuple[str | None, int, str | None]]:
    """(reply, attempts, last error) of each row."""
    error = None
    for attempt in range(retries + 1):
        try:
            replies = ask(rows)
            if len(replies) != len(rows):
                raise ValueError(f"{len(replies)} replies to {len(rows)} rows")
            return [(r, attempt + 1, None) for r in replies]
        except Exception as e:  # a service may fail in any way; the row says how
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    if len(rows) == 1:
        return [(None, retries + 1, error)]
    return [(reply, retries + 1 + n, e) for row in rows for reply, n, e in _asked(ask, [row], retries, pause)]


def scored(queue: DataFrame, client: Client, batch: int = 32, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(item_id, json, attempts, error) of each row of ``queue``; ``json`` is null where no attempt worked."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        ask = None
        for pdf in frames:
            ask = ask or client()
            rows = pdf.to_dict("records")
            out = [x for a in range(0, len(rows), batch) for x in _asked(ask, rows[a : a + batch], retries, pause)]
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy(), "json": [x[0] for x in out], "attempts": [x[1] for x in out], "error": [x[2] for x in out]})

    return queue.mapInPandas(run, "item_id string, json string, attempts int, error string")


def score_round(spark: SparkSession, queue: DataFrame, path: str, client: Client, **how) -> None:
    """Scores what waits in ``queue`` and appends it to the table in ``path``: replies that can be read with the status
    OK, once for each item, and the others with ERROR, so that the next round tries them again."""
    schema = spark.createDataFrame([], ENRICHED).schema
    done = read_or_empty(spark, path, schema)
    todo = queue.join(done.where("status = 'OK'").select("item_id"), "item_id", "left_anti")
    new_rows(parse_enrichment(scored(todo, client, **how)), done.where("status = 'OK'"), ["item_id"], ["status", "is_valid", "is_graded", "grading_company", "grade_val"]).write.mode("append").parquet(path)


def enriched(spark: SparkSession, path: str) -> DataFrame:
    """One row for each item: its enrichment, or the ERROR of an item that has none yet."""
    every = read_or_empty(spark, path, spark.createDataFrame([], ENRICHED).schema)
    rest = [c for c in every.columns if c not in ("item_id", "status")]
    return every.groupBy("item_id").agg(F.max(F.struct("status", *rest)).alias("r")).select("item_id", "r.*")  # "OK" is after "ERROR"
