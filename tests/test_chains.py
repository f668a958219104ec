"""Chains of several sites: written by site, read by site, and what forward runs make of them."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import ensembles, uncertainty
from fluvia.operators import simulate as sim
from fluvia.plans import runs
from fluvia.sources import files
from fluvia.sources.config import Config
from tests.test_models import series
from tests.test_runs import config, rows


def chain_of(spark, sites):
    """par_1 of site k lies around its own middle."""
    return spark.createDataFrame([(s, i, [m + i / 1000, 0.3, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0]) for s, m in sites.items() for i in range(40)], "site string, sample_id long, p array<double>")


def test_each_site_has_its_own_samples_and_sidecar(spark, tmp_path):
    path = str(tmp_path / "chain.csv")
    files.write_chain(chain_of(spark, {"007": 1.0, "b/c d": 9.0}), path, [0, 1])
    files.write_json(spark.createDataFrame([("007", 0.25), ("b/c d", 0.75)], "site string, rho double"), files.sidecar_path(path))
    back = files.read_chain(spark, path, [5.0] * 8)
    assert dict(back.dtypes) == {"site": "string", "sample_id": "bigint", "p": "array<double>"}
    found = {(r.site, r.sample_id): r.p for r in back.collect()}
    assert len(found) == 80 and found["007", 3] == [1.003, 0.3, *[5.0] * 6] and found["b/c d", 39][0] == 9.039
    assert {r.site: r.rho for r in files.read_sidecar(spark, path).collect()} == {"007": 0.25, "b/c d": 0.75}
    plan = back.filter("site = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "(site#" in plan
    # a rerun of one site replaces that site's samples alone
    files.write_chain(chain_of(spark, {"007": 2.0}), path, [0, 1])
    assert {r.site: r.m for r in files.read_chain(spark, path, [5.0] * 8).groupBy("site").agg(F.round(F.min(F.col("p")[0]), 3).alias("m")).collect()} == {"007": 2.0, "b/c d": 9.0}


def test_a_chain_without_sites_is_for_all(spark, tmp_path):
    (tmp_path / "chain.csv").write_text("par_1,par_3\n" + "0.1,0.2\n" * 3 + "0.3,0.4\n")
    (tmp_path / "chain_meta.json").write_text('{\n "rho": 0.5,\n "sigma": 1\n}')
    path = str(tmp_path / "chain.csv")
    back = files.read_chain(spark, path, [9.0] * 8)
    assert back.columns == ["sample_id", "p"] and sorted(r.p[0] for r in back.collect()) == [0.1, 0.1, 0.1, 0.3] and back.first().p[1] == 9.0
    best = spark.createDataFrame([("a",), ("b",)], "site string")
    chain = runs.stored_chain(spark, path, best, Config(parameters=(9.0,) * 8, n_samples=3))
    assert sorted((r.site, r.n) for r in chain.groupBy("site").agg(F.count("*").alias("n")).collect()) == [("a", 3), ("b", 3)]
    assert files.read_sidecar(spark, path).first().rho == 0.5
    assert files.read_sidecar(spark, str(tmp_path / "none.csv")).count() == 0


def test_priority_of_the_correlation(spark):
    best = spark.createDataFrame([(s,) for s in "abcd"], "site string")
    own = spark.createDataFrame([("a", 40, 0.1), ("b", 0, 0.0), ("c", 0, 0.0)], "site string, n_pairs long, rho double")
    side = lambda x: spark.createDataFrame(x, "site string, rho double")
    got = lambda s, given=None: {r.site: r.rho for r in runs.forward_rho(best, own, s, given).collect()}
    assert got(side([("a", 0.5), ("b", 0.6)])) == {"a": 0.1, "b": 0.6, "c": 0.0, "d": 0.0}
    assert got(side([(None, 0.7), ("b", 0.6)])) == {"a": 0.1, "b": 0.6, "c": 0.7, "d": 0.7}
    assert got(side([]), 0.9) == dict.fromkeys("abcd", 0.9)


def test_calibrated_chains_of_two_sites_come_back_in_a_forward_run(spark, tmp_path):
    data = series(spark, 500, ("a", "b")).withColumn("t_water", F.col("t_water") + F.when(F.col("site") == "b", 4.0).otherwise(0.0))
    first = runs.run(spark, config(mode="DE-MCMC", output=str(tmp_path / "cal"), noise="ar1"), data)
    meta = {m["site"]: m for p in (tmp_path / "cal").glob("*_meta.json/part*") for m in map(json.loads, p.read_text().splitlines())}
    assert set(meta) == {"a", "b"}
    unseen = series(spark, 500, ("a", "b", "c")).withColumn("t_water", F.lit(None).cast("double"))
    c = config(mode="FORWARD", parameters=(0.5, 0.3, 0.4, 0, 0, 0, 0, 0), output=str(tmp_path / "fwd"), intervals=True, chain=first["chain"], sigma=0.0, noise="ar1", n_samples=30)
    places = runs.run(spark, c, unseen)
    bounds = {(r.site, r.Year, r.Month, r.Day): r for r in rows(spark, places["forward_envelopes"]) if r.Twat_mod_p50 is not None}
    assert {k[0] for k in bounds} == {"a", "b"} and [r.site for r in rows(spark, places["sites_without_chain"])] == ["c"]
    # each site's median is that of its own chain
    days = runs.days_of(unseen, c)
    for site in "ab":
        chain = files.read_chain(spark, first["chain"], list(c.parameters)).filter(F.col("site") == site)
        some = [r.p for r in uncertainty.sampled_by_key(chain, 30, c.seed).orderBy("param_id").collect()]
        d = sim.simulate_many(days.filter(F.col("site") == site), spark.createDataFrame(list(enumerate(some)), "param_id long, p array<double>"), 3, "RK4").groupBy("d").agg(F.percentile("tw", F.lit(0.5)).alias("m")).collect()
        assert len(d) > 400 and all(bounds[site, r.d.year, r.d.month, r.d.day].Twat_mod_p50 == pytest.approx(r.m, abs=1e-9) for r in d)
    own = {r.site: r.rho for r in runs.forward_rho(spark.createDataFrame([("a",), ("b",)], "site string"), spark.createDataFrame([], "site string, n_pairs long, rho double"), files.read_sidecar(spark, first["chain"]), None).collect()}
    assert own == {s: meta[s]["rho"] for s in "ab"}


@pytest.mark.parametrize("rolling", (1, 7))
def test_percentiles_in_tasks_are_those_of_the_shuffled_ensemble(spark, monkeypatch, rolling):
    days = sim.prepared(series(spark, 300, ("a", "b")).withColumn("t_air", F.when(F.dayofyear("d").isin(90, 91, 92, 200), None).otherwise(F.col("t_air"))), 3, 10, 2)
    chain = chain_of(spark, {"a": 0.4, "b": 0.6})
    sigma, rho = (spark.createDataFrame([("a", x), ("b", x / 2)], f"site string, {n} double") for n, x in (("sigma", 0.4), ("rho", 0.6)))
    ask = lambda: {(r.site, r.d): tuple(r)[2:] for r in uncertainty.site_intervals(days, chain, sigma, rho, 3, "RK4", 80.0, 30, 5, rolling=rolling).collect()}
    whole = ask()
    monkeypatch.setattr(ensembles, "BLOCK_VALUES", 30 * 17)
    small = ask()
    monkeypatch.setattr(ensembles, "MOST_VECTORS", 5)
    long = ask()
    assert len(whole) > 560 and set(whole) == set(small) == set(long)
    for k, x in whole.items():
        assert x == pytest.approx(small[k], abs=1e-9) and x == pytest.approx(long[k], abs=1e-9)


def test_no_member_of_an_ensemble_is_shuffled(spark):
    days = sim.prepared(series(spark, 300, ("a",)), 3, 10, 2)
    plan = uncertainty.site_intervals(days, chain_of(spark, {"a": 0.4}), version=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Exchange")  # nothing is exchanged above the simulation
    sums = ensembles.paired_differences(days, spark.createDataFrame([("a", 0, [0.1] * 8, [0.2] * 8)], "site string, run long, down array<double>, up array<double>"), 3)
    assert sums.first().n > 0 and sums.count() == 1


def test_percentiles_are_interpolated():
    x = np.array([[3.0, 1.0, 2.0, np.nan], [5.0, 5.0, 5.0, 5.0]])
    assert ensembles.percentiles(x, (0.0, 0.25, 0.5)).tolist() == [[1.0, 1.75, 2.5], [5.0, 5.0, 5.0]]
    with pytest.raises(ValueError):
        ensembles.daily_percentiles(None, None, interval=100)


def shuffled(df):
    """Rows that each exchange of a collected frame's plan wrote."""

    def below(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return below(node.executedPlan())
        if "QueryStage" in name:
            return below(node.plan())
        found = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
        return found + [x for i in range(node.children().size()) for x in below(node.children().apply(i))]

    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("n", [50, 1500])
def test_samples_are_found_without_shuffling_the_chain(spark, tmp_path, n):
    """A site's samples don't all go to one task; without a name, id or enough samples they are those of a sort."""
    ids = F.when(F.col("id") % 4999 != 7, F.col("id"))
    site = F.when(F.col("id") % 500 == 3, F.lit(None)).when(F.col("id") % 500 == 4, F.lit("c")).otherwise(F.concat(F.lit("S"), F.col("id") % 2))
    path = str(tmp_path / "chain")
    spark.range(40_000).select(site.alias("site"), ids.alias("sample_id"), F.array(F.col("id").cast("double")).alias("p")).write.parquet(path)
    chain = spark.read.parquet(path)
    some = uncertainty.sampled_by_key(chain, n, 3)
    got = sorted((r.site or "", r.param_id, r.p[0]) for r in some.collect())
    written = shuffled(some)
    expected, by_site = [], {}
    for r in chain.collect():
        by_site.setdefault(r.site or "", []).append((hashlib.md5(f"3:{r.sample_id}".encode()).hexdigest() if r.sample_id is not None else "", r.p[0]))
    for name, found in by_site.items():
        expected += [(name, k, p) for k, (_, p) in enumerate(sorted(found)[:n])]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(expected)]
    assert {x[::2] for x in got} == {x[::2] for x in expected}
    joined = runs.stored_chain(spark, stored(spark, chain, tmp_path), spark.createDataFrame([("S0",), ("S1",)], "site string"), Config(parameters=(9.0,) * 8))
    joined.collect()
    assert max(shuffled(joined), default=0) < 100
    assert min(written) < 4 * n + 1000  # the other exchange has counts


def stored(spark, chain, folder):
    path = str(folder / "stored.csv")
    files.write_chain(chain.filter("sample_id IS NOT NULL AND site IS NOT NULL"), path, [0])
    return path
