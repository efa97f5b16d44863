"""Replies of a service to planned requests, page by page.

A request is a batch of ids; ``client`` is called on the executors, once in each task, and gives a function of (ids,
offset, limit) to the text of a page, or None after the last one. The plan is a table, so its requests are dealt out over
tasks, and a task that is lost asks again for its own requests only. A page that fails is tried again; if it still fails
the request ends with a row that says so, and can be planned again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fetch = Callable[[list, int, int], str | None]
PAGES = "batch int, page int, offset int, body string, error string"


def _page(fetch: Fetch, ids: list, offset: int, limit: int, retries: int, pause: float) -> tuple[str | None, str | None]:
    error = None
    for attempt in range(retries + 1):
        try:
            return fetch(ids, offset, limit), None
        except Exception as e:  # a service may fail in any way; the row says how
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    return None, error


def fetched(plan: DataFrame, client: Callable[[], Fetch], limit: int = 200, tasks: int = 32, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """(batch, page, offset, body, error): the pages of each request in ``plan`` (batch, ids), one after the other until
    there is none. A row with an error is a request's last."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        fetch = None
        for pdf in frames:
            fetch = fetch or client()
            for batch, ids in zip(pdf["batch"], pdf["ids"], strict=True):
                page = 0
                while True:
                    body, error = _page(fetch, list(ids), page * limit, limit, retries, pause)
                    if body is None and error is None:
                        break
                    yield pd.DataFrame({"batch": [batch], "page": [page], "offset": [page * limit], "body": [body], "error": [error]})
                    if error:
                        break
                    page += 1

    return plan.select("batch", "ids").repartition(tasks, "batch").mapInPandas(run, PAGES)


def unanswered(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests that have no page, or whose last one failed: what to plan again."""
    answered = pages.groupBy("batch").agg(F.max(F.col("error").isNotNull().cast("int")).alias("failed")).where("failed = 0")
    return plan.join(answered, "batch", "left_anti")
