"""Operators that spread one series over many tasks, against their one-task or one-line definitions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluvia.functions import kernels
from fluvia.operators import prep, reports, uncertainty
from fluvia.operators import simulate as sim

DAY = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(8)
    rows = []
    for site, n, share in (("a", 900, 0.02), ("b", 40, 0.5), ("c", 1, 0.0), ("d", 300, 1.0), (None, 60, 0.1)):
        rows += [(site, DAY + dt.timedelta(i), None if rng.random() < share else 5.0, rng.choice((3.0, 3.0, 0.0, None)) if rng.random() < share else 2.0, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "site string, d date, t_air double, q double, t_water double").repartition(7).cache()


@pytest.mark.parametrize("days", (1, 7, 64, 5000))
def test_islands_by_range_are_islands(daily, days):
    named = daily.filter("site IS NOT NULL")
    one, two = (sorted(map(tuple, df.select("site", "d", "valid", "block").collect())) for df in (prep.islands(named, prep.analysis_valid()), prep.islands_by_range(named, prep.analysis_valid(), range_days=days)))
    assert one == two
    for version in (3, 8):
        one, two = (sorted((tuple(r) for r in prep.with_segments(named, version, 5, 2, range_days=x).select("site", "d", "seg_id", "seg_day", "in_eval").collect()), key=str) for x in (None, days))
        assert one == two and any(r[2] for r in one)


def test_no_window_over_the_days_of_a_series(daily):
    plan = prep.with_segments(daily, range_days=64)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x or "Window(" in x]
    assert windows and all("span" in x or "joint" in x or "block" in x for x in windows)


def _pairs(df):
    return sorted((r.site, r.d, r.name) for r in df.collect())


def test_interval_join(spark, daily):
    rng = random.Random(1)
    spans = [("a", 0, 899), ("a", 10, 10), ("a", 20, 19), ("a", -5, 3), ("a", 890, 950), ("a", 2000, 2100), ("x", 0, 10), ("b", 39, 39)]
    spans += [(rng.choice("abcd"), a := rng.randrange(900), a + rng.randrange(-3, 200)) for _ in range(60)]
    rows = [(s, DAY + dt.timedelta(a), DAY + dt.timedelta(b), f"i{k}") for k, (s, a, b) in enumerate(spans)]
    rows += [("a", None, DAY, "none"), ("a", DAY, None, "none"), (None, DAY, DAY, "none")]
    intervals = spark.createDataFrame(rows, "site string, start_d date, end_d date, name string")
    df = daily.select("site", "d").unionByName(daily.select("site", "d").filter("site = 'a' AND dayofmonth(d) = 4")).unionByName(spark.createDataFrame([("a", None)], "site string, d date"))
    expected = sorted((r.site, r.d, n) for r in df.collect() for s, a, b, n in rows if s and a and b and r.d and s == r.site and a <= r.d <= b)
    assert len(expected) > 1000
    for bin_days, bin_rows in ((64, 100_000), (1, 100_000), (365, 9), (7, 1)):
        found = prep.join_intervals(df, intervals, bin_days=bin_days, bin_rows=bin_rows)
        assert _pairs(found) == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got = {r.name: r for r in prep.within(daily.filter("site IS NOT NULL"), intervals.filter("name <> 'none'")).collect()}
    assert (got["i0"].n_rows, got["i0"].total) == (900, sum(range(900))) and (got["i2"].n_rows, got["i2"].total) == (0, None) and got["i5"].n_rows == 0
    assert len(got) == len(spans)


def test_ranked_is_a_row_number(spark, daily):
    df = daily.select("site", (F.col("t_water") % 13).alias("v"), "d")
    w = Window.partitionBy("site").orderBy("v", "d")
    got, expected = (sorted(((r.site or "", r.d, r.n) for r in x.collect())) for x in (reports.ranked(df, ("v", "d"), name="n"), df.withColumn("n", F.row_number().over(w))))
    named = [x for x in got if x[0]]
    assert named == [x for x in expected if x[0]]  # keys that are null join nothing
    assert reports.ranked(df.filter("v < 0"), ("v",)).count() == 0


@pytest.mark.parametrize("block", (4096, 17))
def test_autocorrelation_at_all_lags(spark, monkeypatch, block):
    monkeypatch.setattr(reports, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    data = {"a": np.cumsum(rng.standard_normal(150)), "b": np.array([1.0, 5.0]), "flat": np.full(20, 3.0), "one": np.array([2.0])}
    rows = [(s, DAY + dt.timedelta(2 * i), float(x)) for s, v in data.items() for i, x in enumerate(v)] + [("a", DAY + dt.timedelta(3), None)]
    df = spark.createDataFrame(rows, "site string, d date, v double").repartition(5)
    got = {(r.site, r.lag): r.acf for r in reports.autocorrelation(df, "v").collect()}
    for s, v in data.items():
        x = v - v.mean()
        for lag in range(len(v)):
            expected = (x[: len(x) - lag] * x[lag:]).sum() / (x * x).sum() if s in ("a", "b") else None
            assert got[s, lag] == (None if expected is None else pytest.approx(expected, abs=1e-9)), (s, lag)
    assert len(got) == sum(map(len, data.values()))
    few = reports.autocorrelation(df, "v", 20).collect()
    assert {(r.site, r.lag) for r in few} == {k for k in got if k[1] <= 20} and all(r.acf == got[r.site, r.lag] or r.acf == pytest.approx(got[r.site, r.lag]) for r in few)


def test_a_long_series_has_all_its_lags(spark):
    df = spark.range(10_000).select(F.lit("s").alias("site"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = {r.lag: r.acf for r in reports.autocorrelation(df, "v").collect()}
    x = np.arange(10_000) * 7919 % 1009 - (np.arange(10_000) * 7919 % 1009).mean()
    expected = np.correlate(x, x, "full")[9_999:] / (x * x).sum()
    assert len(got) == 10_000 and np.allclose([got[k] for k in range(10_000)], expected)


def test_observed_span(daily):
    seen = daily.withColumn("t_water", F.when(F.col("t_water").between(10, 20), F.col("t_water")))
    got = reports.observed_span(seen).groupBy("site").agg(F.count("*").alias("n")).collect()
    assert {r.site: r.n for r in got} == {"a": 11, "b": 11, "d": 11}


@pytest.mark.parametrize("n_years", (1, 2))
def test_fold_statistics_are_those_of_the_training_days(spark, n_years):
    rng = random.Random(6)
    rows = [(s, DAY + dt.timedelta(i), rng.choice((None, rng.gauss(1e4 if s == "a" else 0, 2))), rng.choice((None, 0.0, rng.random()))) for s in "ab" for i in range(1500)]
    rows += [("c", DAY + dt.timedelta(i), 1.0 if 365 <= i < 730 else None, None) for i in range(1500)]
    f = spark.createDataFrame(rows, "site string, d date, t_water double, q double").withColumn("t_air", F.lit(1.0))
    folds = prep.folds(f, n_years, 10, 1)
    masked = uncertainty.fold_forcing(f, folds, 10)
    moments, clim = uncertainty.fold_statistics(f, folds, 10)
    keys = ("site", "fold")
    expected = sim.with_moments(masked, F.col("t_water"), F.col("q"), None, keys).select(*keys, "qmedia", "n_dat", "mean_obs", "tss_obs").distinct()
    got, expected = ({(r.site, r.fold): tuple(r)[2:] for r in x.collect()} for x in (moments, expected))
    assert set(got) == set(expected) and len(got) >= 3 * 2
    for k, (qmedia, n, mean, tss) in expected.items():
        near = lambda x, y, **tolerance: x is None if y is None else x == pytest.approx(y, **tolerance)
        assert got[k][1] == n and near(got[k][0], qmedia) and near(got[k][2], mean, rel=1e-12)
        assert near(got[k][3], tss if n else None, rel=1e-6, abs=1e-6)
    got, expected = ({(r.site, r.fold, r.doy0): r.t for r in x.collect()} for x in (clim, prep.climatology(masked, keys)))
    assert set(got) == set(expected)
    assert all(got[k] == (None if v is None else pytest.approx(v, rel=1e-9)) for k, v in expected.items())


@pytest.mark.parametrize("version", sorted(kernels.ACTIVE))
def test_the_rate_as_an_expression_is_the_kernels(spark, version):
    rng = np.random.default_rng(version)
    x = rng.random((50, 4)) * [20, 3, 1, 15] + [0, 0.1, 0, 0]
    p = [0.6, 0.3, 0.45, 0.2, 0.4, 1.5, 0.6, 0.1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(50, None, 1.0, 0.5, 4.0)], "i int, t_air double, theta double, tt double, tw double")
    got = {r.i: r.rate for r in sim.rates(df, p, version).collect()}
    expected = kernels.rate(version, kernels.active_only(np.array([p]), version)[0], *x.T)
    assert np.allclose([got[i] for i in range(50)], expected) and got[50] is None


def test_posterior_quantiles_without_a_task_a_parameter(spark):
    """Ties, nulls, values that aren't numbers, keys that are null: the intervals are those of Spark's percentile."""
    x = F.col("id")
    odd = F.when(x % 7 == 0, F.lit(None)).when(x % 11 == 0, F.lit(float("nan"))).otherwise((x * 7919 % 1009) - 500.5)
    few = F.when(x % 2000 == 5, F.lit(3.0))
    site = F.when(x % 3 == 0, F.lit("a")).when(x % 3 == 1, F.lit("b"))
    rows = spark.range(6001).select(site.alias("site"), F.array(odd, (x % 5).cast("double"), (x * x).cast("double"), few, F.lit(None).cast("double")).alias("p"))
    rows = rows.unionByName(spark.createDataFrame([("one", [float("inf"), -1.0])], "site string, p array<double>"))
    found = reports.posterior_summary(rows, ("site",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "ObjectHashAggregate" not in plan  # their state is all values of a group
    long = rows.select("site", F.posexplode("p").alias("k", "value"))
    exact = long.groupBy("site", "k").agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("value").alias("mean"))
    text = lambda v: "" if v is None else f"{v:.9g}"
    expected = sorted((str(r.site), r.k + 1, text(r.mean), *map(text, r.q or (None, None))) for r in exact.collect())
    assert sorted((str(r.site), r.parameter, text(r.mean), text(r.low), text(r.high)) for r in found.collect()) == expected
    assert len(expected) == 17
