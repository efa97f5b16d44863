"""Jobs that run again and again: queue, scoring, search, retention, layout."""

import datetime as dt
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.functions import search
from tidemark.operators import scoring as sc
from tidemark.operators import timeseries as ts
from tidemark.plans import queries
from tidemark.sources import sinks
from tidemark.sources import tables as tb
from tidemark.streaming import queue as qu

LISTING = "item_id string, id string, listing_title string, at timestamp"
at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def arrive(spark, folder, rows):
    spark.createDataFrame([(i, "c", f"title {i}", at(k)) for i, k in rows], LISTING).coalesce(1).write.mode("append").parquet(str(folder))


def test_queue_takes_items_once_over_runs_and_drops_late_ones(spark, tmp_path):
    source, path, state = tmp_path / "source", str(tmp_path / "queue"), str(tmp_path / "state")
    run = lambda: qu.run_queue(spark.readStream.schema(LISTING).parquet(str(source)), "at", path, state, "10 days")
    have = lambda: sorted(r.item_id for r in qu.queued(spark, path).collect())
    assert have() == []
    arrive(spark, source, [("a", 30), ("a", 30), ("b", 31)])
    run()
    assert have() == ["a", "b"]
    arrive(spark, source, [("a", 32), ("c", 40), ("late", 1)])  # a comes again, one is a month old
    run()
    assert have() == ["a", "b", "c"]
    run()
    arrive(spark, source, [("a", 90)])  # out of the watermark's reach: only the table still knows it
    run()
    assert have() == ["a", "b", "c"]


def test_queue_batch_that_is_repeated_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "queue")
    rows = spark.createDataFrame([("a", "2", "t"), ("a", "1", "t"), ("b", "1", "t")], qu.SCHEMA)
    for batch in (0, 0, 1, 1):
        qu.add_batch(path)(rows if batch == 0 else rows.unionByName(spark.createDataFrame([("c", "1", "t")], qu.SCHEMA)), batch)
    assert sorted((r.item_id, r.id, r.batch) for r in qu.queued(spark, path).collect()) == [("a", "1", 0), ("b", "1", 0), ("c", "1", 1)]
    done = spark.createDataFrame([("a", "OK"), ("b", "ERROR")], "item_id string, status string")
    assert sorted(r.item_id for r in qu.waiting(qu.queued(spark, path), done).collect()) == ["b", "c"]


def test_asked_retries_batches_then_rows():
    calls = []

    def ask(rows):
        calls.append([r["item_id"] for r in rows])
        if len(calls) == 1:
            raise TimeoutError("slow")
        if any(r["item_id"] == "bad" for r in rows):
            raise ValueError("no")
        return ["{}"] * len(rows)

    rows = [{"item_id": i} for i in ("a", "bad", "c")]
    assert sc._asked(ask, rows[:1], 1, 0) == [("{}", 2, None)]
    got = sc._asked(ask, rows, 1, 0)
    assert got == [("{}", 3, None), (None, 4, "ValueError: no"), ("{}", 3, None)]
    assert calls[2:] == [["a", "bad", "c"], ["a", "bad", "c"], ["a"], ["bad"], ["bad"], ["c"]]
    assert sc._asked(lambda rows: [], rows[:1], 0, 0) == [(None, 1, "ValueError: 0 replies to 1 rows")]


def grader(fails):
    """A client that can't be sent anywhere, as real ones can't: it is made where it is used."""

    def make():
        lock = threading.Lock()

        def ask(rows):
            with lock:
                if any(r["item_id"] in fails for r in rows):
                    raise ConnectionError("down")
                return [json.dumps({"validity": "Match" if r["item_id"] != "no" else "Mismatch", "is_graded": True, "grading_company": "PSA", "grade_value": "NA"}) if r["item_id"] != "odd" else "?" for r in rows]

        return ask

    return make


def test_failed_rows_are_queued_again(spark, tmp_path):
    path, queue = str(tmp_path / "enriched"), spark.createDataFrame([(i, "c", "t") for i in ("a", "b", "no", "odd", "a")], qu.SCHEMA)
    how = {"batch": 2, "retries": 0, "pause": 0}
    state = lambda: {r.item_id: (r.status, r.is_valid, r.grading_company, r.grade_val) for r in sc.enriched(spark, path).collect()}
    sc.score_round(spark, queue, path, grader({"b"}), **how)
    assert state() == {"a": ("OK", True, "PSA", None), "no": ("OK", False, "PSA", None), "b": ("ERROR", None, None, None), "odd": ("ERROR", None, None, None)}
    sc.score_round(spark, queue, path, grader({"a", "no"}), **how)  # these aren't asked again
    assert state()["b"] == ("OK", True, "PSA", None) and state()["odd"][0] == "ERROR" and state()["a"][0] == "OK"
    assert spark.read.parquet(path).where("item_id = 'a'").count() == 1
    sc.score_round(spark, queue.where("false"), path, grader(set()))
    assert len(state()) == 4


def test_search_gives_each_item_once_and_nothing_for_broken_replies(spark):
    day = dt.date(2024, 1, 5)
    item = lambda i, **more: {"itemId": i, "title": f"PSA 9 {i}", **more}
    body = lambda *items: json.dumps({"total": len(items), "itemSummaries": list(items)})
    rows = [
        ("1", day, 2, "EPID", body(item("x", price={"value": "$1,250.50"}), item("y"))), ("1", day, 1, "Text", body(item("x", currentBidPrice={"value": "3"}, buyingOptions=["AUCTION"]), {"title": "no id"})),
        ("1", day + dt.timedelta(1), 1, "Text", body(item("x", price={"value": "free"}, itemCreationDate="2024-01-02T00:00:00Z"))), ("2", day, 1, "Text", None), ("3", day, 1, "Text", '{"total": 0}'),
        ("4", day, 1, "Text", "{cut"), ("5", day, 1, "Text", "[1]"), ("6", day, 1, "Text", body({"itemId": "z"})),
    ]
    replies = spark.createDataFrame(rows, "id string, day date, turn int, source string, body string")
    search.register(spark)
    got = {(r.id, r.day.day, r.item_id): (r.price_val, r.is_graded, r.pull_source, r.listing_type, r.posted_date) for r in spark.sql("select * from card_search(table({r}))", r=replies).collect()}
    assert got == {
        ("1", 5, "x"): (3.0, True, "Text", "AUCTION", None), ("1", 5, "y"): (None, True, "EPID", "UNKNOWN", None), ("1", 6, "x"): (None, True, "Text", "UNKNOWN", "2024-01-02"),
        ("6", 5, "z"): (None, None, "Text", "UNKNOWN", None),
    }
    assert spark.sql("select * from card_search(table({r}))", r=replies.where("false")).count() == 0
    with pytest.raises(Exception, match="lacks day, turn"):
        spark.sql("select * from card_search(table({r}))", r=replies.drop("day", "turn"))


def test_retention_deletes_whole_days_from_storage(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=k)) for k in range(10)] + [(99, None)]
    sinks.append(spark.createDataFrame(rows, "n int, day date"), path, "day")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    assert sinks.prune(spark, path, "day", "2024-01-10", 3) == 6
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    assert len(left) < len(before) and left.items() <= before.items()
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [6, 7, 8, 9, 99]
    assert sinks.prune(spark, path, "day", "2024-01-10", 3) == 0


def test_layout_by_card_needs_no_exchange(spark):
    prices = spark.createDataFrame([(c, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k)) for c in "abcdef" for k in range(20)], tb.PRICE_SCHEMA)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("laid_prices", "laid_others"):
            sinks.layout_by_card(prices, name, 4)
        a, b = spark.table("laid_prices"), spark.table("laid_others").withColumnRenamed("price", "other")
        ends = b.groupBy("card_id").agg(F.max("other").alias("most"))
        for df in (ts.eligible_history(a, 10), ts.rebased(a), a.join(ends, "card_id"), ts.price_cv(a, 5)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        days = a.join(b, ["card_id", "date"])
        assert "Exchange" not in days._jdf.queryExecution().executedPlan().toString()
        assert days.where(F.col("price") == F.col("other")).count() == 120
        assert ts.rebased(prices)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for name in ("laid_prices", "laid_others"):
            spark.sql(f"drop table if exists {name}")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def large_tables(spark):
    """Joins as between tables that are too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield "/root/testdata/sf0.001"
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_replies_dont_move_to_the_search(spark, large_tables):
    df = queries.ALL["card_search"](spark, large_tables)
    assert exchanges(df) == 3  # listings and cards to their join, then rows to card and day


def test_landed_replies_are_compressed(spark, large_tables):
    df = queries.ALL["api_listings"](spark, large_tables)
    names = [f for f in df.inputFiles() if "part-" in f]
    assert names and all(f.endswith(".txt.gz") for f in names)
    assert df.count() == spark.read.parquet(f"{large_tables}/lineitem.parquet").count()


def test_queue_writes_little(spark, tmp_path):
    source, path, state = tmp_path / "source", str(tmp_path / "queue"), str(tmp_path / "state")
    kept = spark.conf.get(qu.CODEC)
    arrive(spark, source, [("a", 30), ("b", 31)])
    qu.run_queue(spark.readStream.schema(LISTING).parquet(str(source)), "at", path, state, "10 days")
    files = list((tmp_path / "queue").rglob("*.parquet"))
    assert files and all(f.name.endswith(".zstd.parquet") for f in files)
    assert f'"{qu.CODEC}":"zstd"' in (tmp_path / "state" / "offsets" / "0").read_text() and spark.conf.get(qu.CODEC) == kept


def test_market_summary_moves_listings_once(spark, large_tables):
    df = queries.ALL["market_daily_dive"](spark, large_tables)
    assert exchanges(df) == 2  # listings and cards to their join


def test_searches_of_large_tables_stay_out_of_python(spark, large_tables):
    day = dt.date(2024, 1, 5)
    item = lambda i, **more: {"itemId": i, "title": f"Slab {i}" if i != "z" else None, **more}
    body = lambda *items, **more: json.dumps({"total": len(items), "itemSummaries": list(items), **more})
    cut = body(item("cut"))
    rows = [
        ("1", day, 2, "EPID", body(item("x", price={"value": "$1,250.50"}), item("y"), item("y", price={"value": "7"}))), ("1", day, 1, "Text", body(item("x", price={"value": ""}, currentBidPrice={"value": "3"}, buyingOptions=["AUCTION", "B"]), {"title": "no id"})),
        ("1", day, 1, "Other", body(item("x", price={"value": "4"}), item("w", buyingOptions=[]), more="a")), ("1", day + dt.timedelta(1), 1, "Text", body(item("x", price={"value": "free"}, itemCreationDate="2024-01-02T00:00:00Z", itemWebUrl="u"))),
        ("2", day, 1, "Text", None), ("2", day, 1, "Text", ""), ("2", None, 1, "Text", body(item("n", price={"value": "1.2.3"}))), (None, None, 1, "Text", body(item("n"))), ("3", day, 1, "Text", '{"total": 0}'), ("3", day, 1, "Text", '{"itemSummaries": null}'),
        *[("4", day, 1, "Text", b) for b in ("{cut", cut[:-1], cut[:-2], cut[:-3], cut + "x", cut.replace('"', "'"), "null", "3", '"a}"')], ("5", day, 1, "Text", "[1]"), ("6", day, 1, "Text", " " + body(item("z"), item(8)) + "\n"),
    ]
    replies = spark.createDataFrame(rows, "id string, day date, turn int, source string, body string")
    search.register(spark)
    by_row, large = spark.sql("select * from card_search(table({r}))", r=replies), search.found(replies)
    assert large.columns == by_row.columns and large.count() == 8
    key = lambda r: [str(v) for v in r]
    assert sorted(large.collect(), key=key) == sorted(by_row.collect(), key=key)
    plan = queries.ALL["card_search"](spark, large_tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "from_json" in plan
