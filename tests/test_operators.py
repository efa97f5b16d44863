"""Edge rows: gaps, nulls, flat series, ties, empty tables, repeated writes."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as ev
from tidemark.operators import features as fe
from tidemark.operators import forecasts as fc
from tidemark.operators import listings as li
from tidemark.operators import timeseries as ts
from tidemark.sources import nested as ne
from tidemark.sources import sinks
from tidemark.sources import tables as tb

D = dt.date


def series(spark, values, card="a"):
    rows = [(card, D(2024, 1, 1) + dt.timedelta(days=k), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, tb.PRICE_SCHEMA)


def test_gapfill_keeps_leading_null_and_single_day(spark):
    df = spark.createDataFrame([("a", D(2024, 1, 1), None), ("a", D(2024, 1, 4), 3.0), ("b", D(2024, 1, 2), 1.0)], tb.PRICE_SCHEMA)
    got = {(r.card_id, r.date.day): r.price for r in ts.gapfill_daily(df).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): None, ("a", 4): 3.0, ("b", 2): 1.0}


def test_backfill_then_forward_then_default(spark):
    got = [r.price for r in ts.backfill_forward(series(spark, [None, 2.0, None]), "price").orderBy("date").collect()]
    assert got == [2.0, 2.0, 2.0]
    assert ts.backfill_forward(series(spark, [None]), "price").first().price == 0.5


def test_scaling_of_flat_and_null(spark):
    got = [r.price_scaled for r in ts.minmax_by_card(series(spark, [4.0, 4.0, None])).orderBy("date").collect()]
    assert got == [0.5, 0.5, None]


def test_chaos_needs_more_rows_than_the_holdout(spark):
    short, one, rising = series(spark, [1.0] * 30, "s"), series(spark, [float(k) for k in range(31)], "o"), series(spark, [float(k + 1) for k in range(40)], "r")
    got = {r.card_id: r for r in ts.chaos_index(short.union(one).union(rising)).collect()}
    assert set(got) == {"o", "r"}
    assert got["o"].efficiency_ratio == 1 and got["r"].efficiency_ratio == 1 and got["r"].chaos_cv == 0


def test_metrics_of_short_and_flat_series(spark):
    df = series(spark, [1.0] * 9, "short").union(series(spark, [1.0] * 12, "flat"))
    rows = ts.ts_metrics(df).collect()
    assert [r.card_id for r in rows] == ["flat"]
    assert rows[0].samp_entropy is None and rows[0].hurst_exp is None and rows[0].lag1_corr is None


def test_sample_entropy_takes_the_whole_series(spark):
    x = [1.0 + k % 7 for k in range(100)] + [float((k * k * 31 + k * 17) % 23) for k in range(300)]
    sd = statistics.stdev(x)
    near = [sum(all(abs(x[i + k] - x[j + k]) < 0.2 * sd for k in range(m)) for i in range(len(x) - 2) for j in range(i + 1, len(x) - 2)) for m in (2, 3)]
    want = pytest.approx(math.log(near[0] / near[1]))
    assert ts.sample_entropy(series(spark, x)).first().samp_entropy == want
    assert ts.ts_metrics(series(spark, x)).first().samp_entropy == want


def test_label_codes_leave_null_out(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    assert {r.x: r.i for r in ts.label_codes(df, "x", "i").collect()} == {"a": 0, "b": 1, None: None}


def test_exact_quantiles(spark):
    """Against numpy: negative, zero, equal and missing values, null keys, one value, none."""
    import numpy as np

    from tidemark.functions.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(0, 3, 500).round(2), "b": np.zeros(7), None: np.exp(rng.normal(0, 9, 200)), "c": np.array([-5.0]), "d": np.concatenate([np.full(50, 2.0), [-1.0, 1e-300, 1e300]])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("none", None)]
    probs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p9": 0.9, "hi": 1.0}
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", probs).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert [got[k][n] for n in probs] == pytest.approx(list(np.quantile(x, list(probs.values()))), rel=1e-12)


@pytest.mark.parametrize("sizes", [(5, 1, 3), (1, 1), (1,), (4, 4, 4)])
def test_row_thirds_are_those_of_one_window(spark, sizes):
    rows = [(f"c{k}", D(2024, 1, 1) + dt.timedelta(days=i), float((k * 7) % 3)) for k, n in enumerate(sizes) for i in range(n)]
    got = {(r.card_id, r.date): r.volatility_tier for r in ts.row_thirds(spark.createDataFrame(rows, "card_id string, date date, v double"), "v").collect()}
    n = len(rows)
    want = [t for t in range(3) for _ in range(n // 3 + (t < n % 3))]
    assert [got[c, d] for c, d, _ in sorted(rows, key=lambda r: (r[2], r[0], r[1]))] == [t + 1 for t in want]


def test_split_windows_need_enough_days(spark):
    df = series(spark, [float(k) for k in range(20)], "long").union(series(spark, [1.0] * 9, "short"))
    got = [(r.split, r.inputs, r.targets) for r in ts.split_windows(df, 2, 1, min_days=10, hold=16, skip=5).orderBy("split", "start_date").collect()]
    assert got == [("test", [17.0, 18.0], [19.0]), ("train", [0.0, 1.0], [2.0]), ("train", [1.0, 2.0], [3.0]), ("val", [12.0, 13.0], [14.0])]


def test_unscaled_prices_are_the_prices(spark):
    df = ts.minmax_by_card(series(spark, [4.0, 4.0], "flat").union(series(spark, [1.0, 5.0, None], "wide")))
    rows = df.select("price", ts.unscaled(F.col("price_scaled"), F.col("card_min_price"), F.col("card_max_price")).alias("back")).collect()
    assert all(r.price == r.back for r in rows)


def test_loess_of_a_parabola_is_the_parabola(spark):
    rows = [("g", float(x), 2.0 + 3 * x - 0.5 * x * x) for x in range(12)] + [("one", 3.0, 7.0), ("one", 4.0, None)]
    got = {(r.g, r.x): r.smooth for r in ev.loess(spark.createDataFrame(rows, "g string, x double, y double"), "g", "x", "y").collect()}
    assert got == pytest.approx({(g, x): y for g, x, y in rows if y is not None})


def test_batch_forecast_takes_any_model_in_batches(spark):
    def model(contexts, horizon):
        assert len(contexts) <= 2
        return [[[x.mean()] * horizon] for x in contexts]

    df = series(spark, [1.0, 3.0, 9.0, 9.0], "a").union(series(spark, [2.0, 2.0, 5.0, 5.0], "b")).union(series(spark, [5.0], "short"))
    got = sorted((r.card_id, r.run_date.day, r.target_date.day, r.pred_price) for r in fc.batch_forecast(df, model, horizon=2, batch=2, min_days=1).collect())
    assert got == [("a", 2, 3, 2.0), ("a", 2, 4, 2.0), ("b", 2, 3, 2.0), ("b", 2, 4, 2.0)]


def test_runs_with_repeated_rows(spark):
    rows = [("a", "m", D(2024, 1, 9), 1, D(2024, 1, 2), 5.0), ("a", "m", D(2024, 1, 9), 1, D(2024, 1, 3), 6.0), ("a", "m", D(2024, 1, 9), 1, D(2024, 1, 3), 4.0)]
    df = spark.createDataFrame(rows, "card_id string, model string, target_date date, run_id int, run_date date, pred_price double")
    assert [(r.run_date.day, r.pred_price) for r in fc.by_run(df, True).collect()] == [(3, 4.0)]


def test_tabular_matrix_of_gaps(spark):
    rows = [("1", "x", "Character", "Epic", "Ruby, Steel", "3", "NA", None, "2", "2023-08-19", "1.5", None), ("2", None, "NA", None, None, "NA", "5", "1", None, None, None, "NA")]
    names = "id name type_clean rarity ink cost strength willpower lore released_at price_foil price_nonfoil".split()
    got = {r.id: r for r in fe.tabular_matrix(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), ["Character"], ["Epic"]).collect()}
    assert (got["1"].ink_Ruby, got["1"].ink_Steel, got["1"].ink_Amber, got["1"].is_character, got["1"].character_id) == (1, 1, 0, 1, 0)
    assert got["1"].log_price == pytest.approx(math.log(2.5)) and got["2"].log_price is None and got["2"].cost is None and got["2"].character_id is None
    assert (got["2"].is_character, got["2"].type_clean_Character, got["2"].rarity_Epic, got["2"].ink_Ruby) == (0, 0, 0, 0)


def test_landed_replies(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"total":1,"itemSummaries":[{"itemId":"1","title":"Elsa PSA 10","currentBidPrice":{"value":"US $1,234.50"}}]}\n{"total":0}\n{oops\n')
    rows = li.api_items(tb.read_json(spark, str(tmp_path), li.RESPONSE), "EPID").collect()
    assert [(r.item_id, r.price_val, r.is_graded, r.listing_type, r.posted_date) for r in rows] == [("1", 1234.5, True, "UNKNOWN", None)]


def test_files_and_order(spark, tmp_path):
    for name in ("b.front.avif", "a.avif", "c.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.id for r in tb.files_by_id(spark, str(tmp_path), "avif").collect()) == ["a", "b"]
    df = spark.createDataFrame([("z",), ("y",), ("x",), (None,)], "s string")
    assert {r.s: r.p for r in df.select("s", fe.ordinal("s", ["y", "x"]).alias("p")).collect()} == {"y": 0, "x": 1, "z": 2, None: 2}


def test_title_filter(spark):
    rows = [
        ("1", "elsa snow", "queen of ice", "Epic", "21", "Elsa Snow queen enchanted", "TEXT", 20.0, True),
        ("2", "elsa snow", "queen of ice", "Epic", "21", "Elsa Snow queen enchanted", "TEXT", 19.99, False),
        ("3", "elsa-snow", "of", "Epic", None, "elsa snow epic", "TEXT", 50.0, False),
        ("4", "elsa-snow", None, "Epic", None, "elsa snow", "EPID", 50.0, True),
        ("5", "elsa snow", "queen", "Epic", "21", "elsa snow epic 21 showcase", "TEXT", 50.0, False),
        ("6", "elsa snow", "x", "Epic", "21", "elsa snow epic 21", "TEXT", 50.0, True),
        ("7", "elsa snow", "x", "Epic", "21", "elsa snow epic 21", "TEXT", None, False),
    ]
    df = spark.createDataFrame(rows, "item_id string, name string, version string, rarity string, number string, listing_title string, pull_source string, price_val double, ok boolean")
    assert {r.item_id for r in li.title_filter(df).collect()} == {r[0] for r in rows if r[-1]}


def test_enrichment_replies(spark):
    df = spark.createDataFrame([("1", '{"validity":"Match","is_graded":true,"grading_company":"PSA","grade_value":"NA"}'), ("2", "{oops"), ("3", None)], "item_id string, json string")
    got = {r.item_id: tuple(r)[1:] for r in li.parse_enrichment(df).collect()}
    assert got == {"1": ("OK", True, True, "PSA", None), "2": ("ERROR", None, None, None, None), "3": ("ERROR", None, None, None, None)}


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-05",), ("8/18/2023",), ("soon",), (None,)], "x string")
    assert [r[0] for r in df.select(fe.parsed_date("x")).collect()] == [D(2024, 1, 5), D(2023, 8, 18), None, None]


def test_zero_actual_has_no_error_and_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("a", "x", 0.0, 1.0), ("b", "x", 2.0, 1.0), ("b", "y", 2.0, 1.0)], "card_id string, model string, actual_price double, pred_price double").withColumn("ape", ev.ape())
    got = {r.card_id: (r.x, r.y, r.winner) for r in ev.leaderboard(df, ["x", "y"]).collect()}
    assert got == {"a": (None, None, None), "b": (0.5, 0.5, "x")}


def test_ensemble_without_bounds(spark):
    day = D(2024, 1, 1)
    a = spark.createDataFrame([("c", day, day, 1.0, 0.5, 1.5)], "card_id string, run_date date, target_date date, pred_price double, conf_low double, conf_high double")
    row = fc.ensemble([a, a.drop("conf_low", "conf_high").withColumn("pred_price", F.lit(3.0))], "e").first()
    assert (row.pred_price, row.conf_low, row.conf_high) == (2.0, 0.5, 1.5)


def test_insert_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    sinks.overwrite(df.where("false"), path)
    for _ in range(2):
        sinks.insert_if_absent(spark, df, path, ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]


def test_absent_source_is_empty(spark, tmp_path):
    assert tb.read_or_empty(spark, str(tmp_path / "no"), tb.PRICE_SCHEMA).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], tb.PRICE_SCHEMA)
    for f in (ts.gapfill_daily, ts.minmax_by_card, ts.chaos_index, ts.ts_metrics, ts.price_cv, ts.rebased, ts.sample_entropy, lambda p: ts.sliding_windows(p, 3, 2), lambda p: ts.split_windows(p, 3, 2), fc.batch_forecast):
        assert f(none).count() == 0


def test_batches(spark):
    got = [(r.batch, len(r.ids)) for r in ne.batches(spark.range(45), "id").orderBy("batch").collect()]
    assert got == [(1, 20), (2, 20), (3, 5)]


@pytest.mark.parametrize("name", ["incremental_queue", "prices_eligible"])
def test_plans_have_semi_or_anti_joins_and_no_products(spark, name):
    from tidemark.plans import queries

    plan = queries.ALL[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti" if name == "incremental_queue" else "LeftSemi") in plan and "Join Cross" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_movers_from_one_aggregate(spark):
    from tidemark.operators import market as mk

    rows = [("b", 5.0, 50.0), ("a", 5.0, 50.0), ("c", -1.0, None), ("d", -3.0, -20.0), ("e", None, None)]
    change = spark.createDataFrame(rows, "card_id string, abs_change double, pct_change double")
    got = mk.movers(change)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.tag: r.card_id for r in got.collect()} == {"top_pct": "a", "low_pct": "d", "top_abs": "a", "low_abs": "d"}
    assert mk.movers(change.where("card_id = 'e'")).count() == 0 and mk.movers(change.where("false")).count() == 0


def test_momentum_needs_an_old_price(spark):
    from tidemark.operators import market as mk

    day = lambda k: D(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("a", day(0), 2.0), ("a", day(2), 4.0), ("a", day(10), 5.0), ("new", day(5), 1.0), ("stale", day(1), 3.0), ("unknown", day(1), None), ("unknown", day(9), 3.0), ("zero", day(0), 0.0), ("zero", day(9), 3.0)]
    got = {r.card_id: (r.price_cur, r.price_past, r.abs_change, r.pct_change) for r in mk.momentum(spark.createDataFrame(rows, tb.PRICE_SCHEMA)).collect()}
    assert got == {"a": (5.0, 4.0, 1.0, 25.0), "stale": (3.0, 3.0, 0.0, 0.0), "unknown": (3.0, None, None, None), "zero": (3.0, 0.0, 3.0, None)}


def test_rollup_and_box_of_null_errors(spark):
    rows = [("m", 1, D(2024, 1, 1), "a", 0.1), ("m", 1, D(2024, 1, 1), "b", None), ("m", 1, D(2024, 1, 1), "c", 0.3), ("n", 1, D(2024, 1, 1), "a", None)]
    df = spark.createDataFrame(rows, "model_type string, horizon int, target_date date, card_id string, error_abs_pct double")
    got = {r.model_type: (r.mean_error_pct, r.card_count, r.median_error_pct) for r in ev.rollup(df).collect()}
    assert got["m"] == (pytest.approx(0.2), 3, pytest.approx(0.2)) and got["n"] == (None, 1, None)
    box = ev.box_stats(df.withColumnRenamed("error_abs_pct", "ape").withColumn("tier", F.lit(None).cast("int")), "model_type", "tier").collect()
    assert [(r.model_type, r.tier, r.median, r.n) for r in box] == [("m", None, 0.2, 2)]


def test_titles_with_numbers_of_any_form(spark):
    rows = [("204/204", "red bolt enchanted 204/204 foil"), ("4", "red bolt enchanted 4/204"), ("20", "red bolt enchanted 204/204"), ("", "red bolt enchanted"), (None, "red bolt enchanted 4"), ("a1", "red bolt enchanted A1")]
    df = spark.createDataFrame([(k, "red bolt", "", "Enchanted", n, t, "TEXT", 25.0) for k, (n, t) in enumerate(rows)], "item_id int, name string, version string, rarity string, number string, listing_title string, pull_source string, price_val double")
    assert sorted(r.item_id for r in li.title_filter(df).collect()) == [0, 1, 5]
