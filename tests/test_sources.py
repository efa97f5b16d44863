"""A database over JDBC, requests that are fetched page by page, and rates that are taken while rows are written."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.sources import database as db
from tidemark.sources import requests as rq
from tidemark.sources import sinks


@pytest.fixture
def url():
    """A database in the memory of Spark's own process, as ships with Spark."""
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
ROWS = [(k, f"n{k}", dt.date(2024, 1, 1) + dt.timedelta(days=k), k % 3, k / 2) for k in range(100)]
COLUMNS = "id int, name string, day date, run int, price double"


def test_database_table_in_parts_with_filters_in_the_database(spark, url):
    db.write_database(spark.createDataFrame(ROWS, COLUMNS).coalesce(2), url, "cards", **DRIVER)
    whole = db.database_table(spark, url, "cards", by="id", parts=4, **DRIVER)
    assert whole.rdd.getNumPartitions() == 4
    some = whole.where("run = 1 and price > 10").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(run,1)" in plan and "GreaterThan(price,10.0)" in plan and "ReadSchema: struct<name:string>" in plan
    assert sorted(r[0] for r in some.collect()) == sorted(n for _, n, _, run, p in ROWS if run == 1 and p > 10)
    days = db.database_table(spark, url, "cards", by="day", parts=3, **DRIVER)
    assert days.rdd.getNumPartitions() == 3 and days.count() == 100


def test_database_query_newest_run_and_overwrite(spark, url):
    frame = spark.createDataFrame(ROWS, COLUMNS).coalesce(1)
    db.write_database(frame, url, "cards", **DRIVER)
    assert {r.id for r in db.newest_run(spark, url, "cards", "run", **DRIVER).collect()} == {k for k in range(100) if k % 3 == 2}
    n = db.database_query(spark, url, 'select "run", count(*) as n from cards group by "run"', **DRIVER)
    assert sorted(tuple(r) for r in n.collect()) == [(0, 34), (1, 33), (2, 33)]
    db.write_database(frame.limit(3), url, "cards", mode="overwrite", **DRIVER)
    assert db.database_table(spark, url, "cards", **DRIVER).count() == 3
    db.write_database(frame.where("false"), url, "empty_one", **DRIVER)
    assert db.database_table(spark, url, "empty_one", by="id", **DRIVER).count() == 0


def service(fails, pages=3):
    """Pages of each request's ids; ``fails``: how often a (first id, offset) fails before it answers."""

    def make():
        left = dict(fails)

        def fetch(ids, offset, limit):
            if left.get((ids[0], offset), 0) > 0:
                left[ids[0], offset] -= 1
                raise ConnectionError("down")
            part = ids[offset : offset + limit]
            return ",".join(map(str, part)) if part else None

        return fetch

    return make


def test_fetched_pages_retries_and_failures(spark):
    plan = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [6]), (3, [7, 8, 9]), (4, [])], "batch int, ids array<int>").where("batch < 4")
    pages = rq.fetched(plan, service({(1, 2): 1, (7, 2): 9}), limit=2, tasks=2, retries=2, pause=0)
    got = {(r.batch, r.page): (r.offset, r.body, r.error) for r in pages.collect()}
    assert got == {(1, 0): (0, "1,2", None), (1, 1): (2, "3,4", None), (1, 2): (4, "5", None), (2, 0): (0, "6", None), (3, 0): (0, "7,8", None), (3, 1): (2, None, "ConnectionError: down")}
    again = rq.unanswered(plan, pages)
    assert [r.batch for r in again.collect()] == [3]
    assert rq.fetched(again, service({}), limit=2, pause=0).where("error is null").count() == 2
    assert rq.fetched(plan.where("false"), service({})).count() == 0 and rq.unanswered(plan, pages.where("false")).count() == 3


def test_rates_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "n int, ok boolean")
    path = str(tmp_path / "out")
    assert sinks.overwrite_observed(df, path, {"ok": F.col("ok"), "small": F.col("n") < 2}) == {"rows": 4, "ok": 0.5, "small": 0.25}
    assert spark.read.parquet(path).count() == 4
    assert sinks.overwrite_observed(df.where("false"), path, {"ok": F.col("ok")}) == {"rows": 0, "ok": None}
