"""As-of joins, regression on age, entropy of long series, and statistics that are merged day by day, against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import entropy
from tidemark.functions import local_regression as lr
from tidemark.operators import asof, incremental as inc, market as mk, timeseries as ts
from tidemark.sources import tables as tb

DAY = dt.date(2024, 1, 1)
day = lambda k: None if k is None else DAY + dt.timedelta(days=k)


def asof_rows():
    rng = random.Random(4)
    left = [(n, rng.choice(["a", "b", "hot", "hot", "hot", None, "only left"]), day(rng.choice([None, *range(90)]))) for n in range(300)]
    right = [(k, day(rng.choice([None, *range(10, 80)])), rng.choice([None, 1.0, 2.0, 3.0])) for k in ["a", "hot", "hot", "only right", None] * 12]
    return left, right


@pytest.mark.parametrize("slices", [None, "month"])
@pytest.mark.parametrize("exact,tolerance,how", [(True, None, "left"), (False, None, "left"), (True, 5, "left"), (True, None, "inner")])
def test_asof_join(spark, slices, exact, tolerance, how):
    left, right = asof_rows()
    a, b = spark.createDataFrame(left, "n int, key string, at date"), spark.createDataFrame(right, "key string, at date, price double")
    got = {(r.n, r.at_right, r.price) for r in asof.asof_join(a, b, ["key"], "at", tolerance and f"{tolerance} days", exact, how, slices).collect()}
    want = set()
    for n, k, t in left:
        of = [(x, v is not None, v or 0.0) for key, x, v in right if None not in (k, t, key, x) and key == k and (x <= t if exact else x < t)]
        best = max(of, default=None)  # of equal days the greatest price, null least
        if best and tolerance and (t - best[0]).days > tolerance:
            best = None
        if best or how == "left":
            want.add((n, best and best[0], best[2] if best and best[1] else None))
    assert got == want


def test_asof_join_needs_one_exchange_and_no_loop(spark):
    left, right = asof_rows()
    a, b = spark.createDataFrame(left, "n int, key string, at date"), spark.createDataFrame(right, "key string, at date, price double")
    plan = asof.asof_join(a, b, ["key"], "at")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_asof_join_refuses_clashing_names_and_takes_empty_sides(spark):
    a, b = spark.createDataFrame([("a", day(1), 5.0)], "key string, at date, price double"), spark.createDataFrame([], "key string, at date, price double")
    with pytest.raises(ValueError, match="price"):
        asof.asof_join(a, b, ["key"], "at")
    assert asof.asof_join(a.drop("price"), b, ["key"], "at").collect() == [("a", day(1), None, None)]
    assert asof.asof_join(b.drop("price"), a, ["key"], "at").count() == 0


def test_forward_asof_join(spark):
    a = spark.createDataFrame([(1, "a", day(3)), (2, "a", day(5)), (3, "a", day(9))], "n int, key string, at date")
    b = spark.createDataFrame([("a", day(5), 1.0), ("a", day(8), 2.0)], "key string, at date, price double")
    assert {(r.n, r.at, r.at_right, r.price) for r in asof.forward_asof_join(a, b, ["key"], "at").collect()} == {(1, day(3), day(5), 1.0), (2, day(5), day(5), 1.0), (3, day(9), None, None)}


def test_value_on_day_counts_what_has_no_price_yet(spark):
    listings = spark.createDataFrame([("a", day(1), False), ("a", day(6), False), ("a", day(6), False), ("b", day(6), False), ("a", day(6), True)], "id string, date_pulled date, is_graded boolean")
    prices = spark.createDataFrame([("a", day(2), 10.0), ("a", day(6), 20.0), ("a", day(7), 99.0)], tb.PRICE_SCHEMA)
    got = {r.date_pulled: (r.market_cap, r.n_listings, r.n_priced) for r in mk.value_on_day(listings, prices).collect()}
    assert got == {day(1): (None, 1, 0), day(6): (40.0, 3, 2)}


def test_local_regression_of_ties_ranges_and_nulls(spark):
    rng = random.Random(2)
    rows = [("m", float(rng.randrange(40)), rng.random()) for _ in range(300)] + [("few", 1.0, 2.0), ("few", 1.0, 4.0), ("few", 3.0, 5.0), ("m", None, 1.0), ("m", 3.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "model string, x double, y double")
    for targets in (512, 7):
        got = {(r.model, r.x): (r.n, r.smooth) for r in lr.local_regression(df, "model", "x", "y", targets=targets).collect()}
        for model in ("m", "few"):
            pts = [(x, y) for m, x, y in rows if m == model and None not in (x, y)]
            assert {x for m, x in got if m == model} == {x for x, _ in pts}
            k = max(1, int(0.75 * len(pts) + 1e-5))
            for x0 in {x for x, _ in pts}:
                h = sorted(abs(x - x0) for x, _ in pts)[k - 1]
                w = [max(0.0, 1 - (abs(x - x0) / h) ** 3) ** 3 if h else float(x == x0) for x, _ in pts]
                n, smooth = got[model, x0]
                assert n == sum(x == x0 for x, _ in pts)
                if len({x for (x, _), v in zip(pts, w, strict=True) if v > 0}) >= 3:
                    coef = np.polynomial.polynomial.polyfit([x - x0 for x, _ in pts], [y for _, y in pts], 2, w=np.sqrt(w))
                    assert math.isclose(smooth, coef[0], rel_tol=1e-6, abs_tol=1e-8)
                else:
                    assert math.isclose(smooth, sum(v * y for (_, y), v in zip(pts, w, strict=True)) / sum(w))
    assert lr.local_regression(df.where("false"), "model", "x", "y").count() == 0


def plain_entropy(x, sd):
    b = a = 0
    for i in range(len(x) - 2):
        near = lambda k: (np.abs(x[i + k] - x[i + 1 + k : len(x) - 2 + k]) < 0.2 * sd)  # noqa: B023, E731
        two = near(0) & near(1)
        b, a = b + int(two.sum()), a + int((two & near(2)).sum())
    return math.log(b / a) if a else None


@pytest.mark.parametrize("small", [1500, 0])
def test_entropy_by_merge_trees(monkeypatch, small):
    monkeypatch.setattr(entropy, "SMALL", small)
    rng = np.random.default_rng(0)
    for t in range(40):
        n = int(rng.integers(4, 300))
        x = rng.integers(0, rng.integers(2, 60), n) / 10 if t % 2 else np.cumsum(rng.normal(size=n)).round(2)
        if t % 5 == 0:
            x[rng.integers(0, n, n // 8)] = np.nan
        sd = np.nanstd(x, ddof=1)
        got, want = entropy.sample_entropy(x, sd), plain_entropy(x, sd) if sd > 0 else None
        assert (got is None) == (want is None) and (got is None or math.isclose(got, want, abs_tol=1e-12))
    assert entropy.sample_entropy(np.ones(50), 0.0) is None and entropy.sample_entropy(np.ones(2), 1.0) is None and entropy.sample_entropy(np.ones(50), None) is None


def test_entropy_of_long_and_short_series_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(c, day(k), float(v)) for c, n in (("a", 40), ("b", 400), ("flat", 300)) for k, v in enumerate(np.ones(n) if c == "flat" else rng.integers(0, 30, n))]
    df = spark.createDataFrame(rows, tb.PRICE_SCHEMA)
    want = {c: plain_entropy(x, x.std(ddof=1)) if x.std() > 0 else None for c in ("a", "b", "flat") for x in [np.array([v for k, _, v in rows if k == c])]}
    for most in (256, 10, 1000):
        monkeypatch.setattr(ts, "LONG", most)
        for got in (ts.sample_entropy(df), ts.ts_metrics(df)):
            assert {r.card_id: r.samp_entropy for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize("holdout", [0, 7])
def test_state_by_day_equals_one_run(spark, tmp_path, holdout):
    rng = random.Random(3)
    rows = [(c, day(k), None if rng.random() < 0.05 else round(rng.random() * 100, 2)) for c, a, b in (("a", 0, 40), ("late", 33, 40), ("stops", 0, 20), ("gaps", 0, 40)) for k in range(a, b) if c != "gaps" or k % 3]
    rows += [("flat", day(k), 5.0) for k in range(40)]
    prices = spark.createDataFrame(rows, tb.PRICE_SCHEMA)
    table = inc.StateTable(spark, str(tmp_path / "state"))
    table.merge(prices.where(F.col("date") < F.lit(day(32))), holdout)
    for k in [*range(32, 40, 2), 38]:  # two days at once; the last of them again
        table.merge(prices.where(F.col("date").between(F.lit(day(k)), F.lit(day(k + 1)))), holdout)
    state = table.read()
    once = inc.merge_state(inc.empty_state(spark), prices, holdout)
    same = lambda df: {r.card_id: [v if not isinstance(v, float) else round(v, 8) + 0.0 for v in r] for r in df.collect()}
    assert same(state) == same(once)
    if holdout:
        want = ts.chaos_index(prices, holdout, tiers=False).where("net_change is not null")
        got = {r.card_id: r.chaos_cv for r in inc.chaos_of(state).collect()}
        assert {r.card_id for r in want.collect()} <= set(got)
        full = prices.where("card_id in ('flat')")
        assert [got[r.card_id] for r in ts.chaos_index(full, holdout, tiers=False).collect()] == [0.0]
    else:
        whole = prices.where("card_id = 'flat' or card_id = 'stops'").where("price is not null")
        got = {r.card_id: r for r in inc.metrics_of(inc.merge_state(inc.empty_state(spark), whole)).collect()}
        for r in ts.ts_metrics(whole).collect():
            for c in ("n_days", "current_price", "avg_price", "cv", "skewness", "lag1_corr"):
                assert got[r.card_id][c] == pytest.approx(r[c]) or (c == "skewness" and got[r.card_id][c] is None)
    assert len(list((tmp_path / "state").iterdir())) == 2


def test_state_of_nothing(spark):
    none = spark.createDataFrame([], tb.PRICE_SCHEMA)
    assert inc.merge_state(inc.empty_state(spark), none).count() == 0
    one = inc.merge_state(inc.empty_state(spark), spark.createDataFrame([("a", day(1), 3.0)], tb.PRICE_SCHEMA))
    assert [tuple(r)[:5] for r in inc.merge_state(one, none).collect()] == [("a", day(1), 1, 1, 3.0)]
    assert inc.metrics_of(one).count() == 0 and inc.chaos_of(one).first().efficiency_ratio == 1.0
