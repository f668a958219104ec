import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import kernels as k
from fluvia.operators import metrics, prep, reports, search, uncertainty
from fluvia.operators import simulate as sim

P = (1, 0.1, 0.1, 0.5, 1, 1, 0.5, 0.1)


@pytest.mark.parametrize("integrator", k.INTEGRATORS)
@pytest.mark.parametrize("version", sorted(k.ACTIVE))
def test_kernel_is_a_scalar_recurrence(version, integrator):
    rng = np.random.default_rng(version)
    n, p = 60, np.array([P, np.array(P) * 0.7])
    ta, th, t = 10 + 5 * rng.standard_normal(n), 0.5 + rng.random(n), np.arange(n) / 365
    got = k.simulate(version, integrator, p, ta, th, t, 4.0)

    def f(q, a, h, t, w):
        s = q[5] * math.cos(2 * math.pi * (t - q[6]))
        r = q[0] + q[1] * a - q[2] * w
        r += s if version == 5 else h * (q[4] + s - q[7] * w) if version in (7, 8) else 0
        return r / h ** q[3] if version in (4, 8) else r

    for v in range(2):
        q = [x if i in k.ACTIVE[version] else 0 for i, x in enumerate(p[v])]
        w = 4.0
        for j in range(n - 1):
            a, b, h = (ta[j], th[j], t[j]), (ta[j + 1], th[j + 1], t[j + 1]), 1 / 365
            if integrator == "EUL":
                w = w + f(q, *b, w)
            elif integrator == "RK2":
                k1 = f(q, *a, w)
                w += (k1 + f(q, b[0], b[1], a[2] + h, w + k1)) / 2
            elif integrator == "RK4":
                m = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2, a[2] + h / 2)
                k1 = f(q, *a, w)
                k2 = f(q, *m, w + k1 / 2)
                k3 = f(q, *m, w + k2 / 2)
                w += (k1 + 2 * k2 + 2 * k3 + f(q, b[0], b[1], a[2] + h, w + k3)) / 6
            else:  # the implicit trapezoid rule: its equation holds for the new value
                new = got[j + 1, v]
                if new > 0:
                    assert new - w == pytest.approx((f(q, *a, w) + f(q, *b, new)) / 2)
                w = new
            w = max(w, 0)
            assert got[j + 1, v] == pytest.approx(w)


def test_unstable_vectors_are_invalid_not_errors():
    got = k.simulate(8, "RK4", [[1e9, 1e9, -1e9, 1, 0, 0, 0, -1e9]], np.ones(400), np.ones(400), np.arange(400) / 365, 4.0)
    assert not np.isfinite(got[-1]).all()
    with pytest.raises(ValueError):
        k.simulate(6, "RK4", [P], [1], [1], [0], 4)
    with pytest.raises(ValueError):
        k.simulate(8, "ABC", [P], [1], [1], [0], 4)


def test_segments_behind_each_other_and_blocks_of_days():
    rng = np.random.default_rng(4)
    ta, th, t, p = rng.normal(10, 5, 300), 0.5 + rng.random(300), np.arange(300) / 365, [P, np.array(P) * 0.9]
    whole = k.simulate(8, "RK4", p, ta, th, t, [4.0, -2.0, 7.0], begin=(0, 1, 120), block=2 * 37)
    for a, b, start in ((0, 1, 4.0), (1, 120, -2.0), (120, 300, 7.0)):
        assert np.array_equal(whole[a:b], k.simulate(8, "RK4", p, ta[a:b], th[a:b], t[a:b], start))


def test_noise_doesnt_depend_on_partitions(spark):
    df = spark.range(2000).selectExpr("'s' AS site", "id AS seg_day", "1 AS seg_id", "date_add(DATE '2000-01-01', int(id)) AS d")
    one, two = ([r.noise for r in x.orderBy("d").collect()] for x in (uncertainty.iid_noise(df, 2.0, 5), uncertainty.iid_noise(df.repartition(7), 2.0, 5)))
    assert one == two and abs(np.std(one) - 2) < 0.15 and abs(np.mean(one)) < 0.2
    a = [r.noise for r in uncertainty.ar1_noise(df.repartition(5), 1.0, 0.7, 5).orderBy("seg_day").collect()]
    assert np.corrcoef(a[1:], a[:-1])[0, 1] == pytest.approx(0.7, abs=0.06)


def test_searches_score_periods_as_reports_do(spark):
    f = series(spark)
    for score, resolution in (("NSE", "1d"), ("KGE", "2w"), ("RMS", "1m")):
        days = metrics.with_periods(sim.prepared(f, 3, 30, 15), f, resolution, 0.5)
        found = search.history(days, "LATHYP", [0.0, 0.1, 0.1, 0, 0, 0, 0, 0], [1.0, 0.6, 0.8, 0, 0, 0, 0, 0], 3, score=score, n=20, seed=3)
        assert found.count() == 40
        best = search.best_of(found)
        tw = sim.simulate(sim.packed(days).join(best.select("site", "p"), "site"), None, 3)
        out = sim.series(f, tw).withColumn("in_eval", F.coalesce(F.col("seg_day") > 15, F.lit(False)))
        want = {r.site: r[score.lower()] for r in metrics.scores(metrics.periods(out, resolution, 0.5, "t_water_sim")).collect()}
        assert {r.site: r.score for r in best.collect()} == pytest.approx(want)


def series(spark, n=700, sites=("a", "b"), p=(0.5, 0.3, 0.4, 0, 0, 0, 0, 0)):
    rows = []
    for s, site in enumerate(sites):
        ta = [10 + 8 * math.sin(2 * math.pi * i / 365 + s) + ((i * 7919) % 101) / 50 for i in range(n)]
        tw = k.simulate(3, "RK4", [p], ta, np.ones(n), np.arange(n) / 365, 4.0)[:, 0]
        rows += [(site, dt.date(2001, 1, 1) + dt.timedelta(i), None if i in (200, 201) else ta[i], float(tw[i]) if i % 5 else None, 10.0 + i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "site string, d date, t_air double, t_water double, q double")


def test_searches_find_the_parameters(spark):
    days = sim.prepared(series(spark), 3, 30, 15)
    low, high = [0.0, 0.1, 0.1, 0, 0, 0, 0, 0], [1.0, 0.6, 0.8, 0, 0, 0, 0, 0]
    got = {r.site: r for r in search.calibrate(days, "DE", low, high, version=3, members=6, generations=15, seed=2).collect()}
    for r in got.values():
        assert r.score > 0.999 and r.p[:3] == pytest.approx([0.5, 0.3, 0.4], abs=0.02) and r.p[3:] == [0] * 5
    for method, options, least in (("PSO", {"particles": 20, "iterations": 15}, 0.9), ("LATHYP", {"n": 200}, 0.8)):
        assert all(r.score > least for r in search.calibrate(days, method, low, high, version=3, seed=2, **options).collect())
    best = days.select("site").distinct().withColumn("p", F.array(*[F.lit(float(x)) for x in (0.5, 0.3, 0.4, 0, 0, 0, 0, 0)]))
    noisy = days.withColumn("t_water", F.col("t_water") + F.randn(4) * 0.2)
    chain = search.posterior(noisy, best, low, high, version=3, walkers=12, steps=40)
    summary = {(r.site, r.parameter): r for r in reports.posterior_summary(chain, ("site",)).collect()}
    assert summary["a", 2].low < 0.3 < summary["a", 2].high and summary["a", 2].significant and not summary["a", 5].significant
    with pytest.raises(ValueError):
        search.stretch_sampler(lambda x: x.sum(1), np.zeros((3, 2)), 5)


def test_cross_validation_leaves_no_trace_of_the_fold(spark):
    f = series(spark, 1095, ("a",))
    folds = prep.folds(f, 1)
    masked = uncertainty.fold_forcing(f, folds)
    assert masked.filter("held AND (t_water IS NOT NULL OR t_air IS NOT NULL)").count() == 0
    low, high = [0.0, 0.1, 0.1, 0, 0, 0, 0, 0], [1.0, 0.6, 0.8, 0, 0, 0, 0, 0]
    results, held = uncertainty.cross_validate(f, folds, low, high, "DE", 3, members=5, generations=10, seed=1)
    rows = results.collect()
    assert sorted(r.label for r in rows) == ["2002", "2003"] and all(r.nse > 0.99 for r in rows)
    assert held.groupBy("label").count().count() == 2
    assert {r.spread for r in uncertainty.walker_spread(results).filter("parameter > 3").collect()} == {1e-4}


def test_ar1(spark):
    def rho(x, seg=None):
        rows = [("s", 1 if seg is None else seg(i), dt.date(2000, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)]
        return uncertainty.ar1_rho(spark.createDataFrame(rows, "site string, seg_id int, d date, residual double")).first()

    assert rho(k.ar1(np.random.default_rng(3).standard_normal(1000), 1, 0.6)).rho == pytest.approx(0.6, abs=0.1)
    assert rho(range(100), lambda i: i // 50).rho == 0.99
    assert rho(range(30)).rho == 0 and rho(range(31)).rho == 0.99 and rho([1.0] * 50).rho == 0
    x = k.ar1(np.random.default_rng(1).standard_normal(100_000), 2, 0.5)
    assert x.var() == pytest.approx(4, rel=0.05) and np.corrcoef(x[1:], x[:-1])[0, 1] == pytest.approx(0.5, abs=0.05)


def test_intervals_and_sensitivity(spark):
    days = sim.prepared(series(spark, 120, ("a",)), 3, 30, 5)
    chain = spark.createDataFrame([(i, [0.5 + i / 1000, 0.3, 0.4, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)], "sample_id long, p array<double>")
    narrow = uncertainty.prediction_intervals(days, chain, 0.0, version=3).collect()
    wide = {r.d: r for r in uncertainty.prediction_intervals(days, chain, 0.5, 0.4, version=3).collect()}
    assert len(narrow) == 120 and all(r.lower <= r.p50 <= r.upper for r in narrow)
    assert sum(wide[r.d].upper - wide[r.d].lower for r in narrow) > 2 * sum(r.upper - r.lower for r in narrow)
    got = uncertainty.sensitivity(days, [0.5, 0.3, 0.4, 0, 0, 0, 0, 0], [0, 0, 0.4, 0, 0, 0, 0, 0], [1, 1, 0.4, 0, 0, 0, 0, 0], (1.0, 5.0), 3).collect()
    by = {(r.perturbation, r.parameter): r for r in got}
    assert len(got) == 16 and by[1.0, 1].status == "Active" and by[1.0, 3].status == "Fixed" and by[5.0, 8].status == "Inactive"
    assert by[1.0, 2].sensitivity > by[1.0, 1].sensitivity > 0 and by[1.0, 3].sensitivity is None
