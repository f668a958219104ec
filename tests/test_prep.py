import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from fluvia.functions import stats
from fluvia.functions.dates import period_of, water_year, year_fraction
from fluvia.operators import metrics, prep, reports
from fluvia.sources import config, files


def daily(spark, n, start="2000-01-01", **columns):
    first = dt.date.fromisoformat(start)
    rows = [("s", first + dt.timedelta(i), *[float(f(i)) if f(i) is not None else None for f in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "site string, d date, " + ", ".join(f"{c} double" for c in columns))


def test_resampling_drops_bad_dates_and_averages(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("when,v\n2000-01-01 00:00:00,10\n2000-01-01 12:00:00,11\nnonsense,99\n2000-01-03 06:00:00,11.5\n2000-01-03 18:00:00,12.5\n")
    got = files.read_and_resample(spark, str(path), "when", "v", "t_air").orderBy("d").collect()
    assert [(str(r.d), r.t_air) for r in got] == [("2000-01-01", 10.5), ("2000-01-03", 12.0)]


def test_outer_merge_on_a_dense_calendar(spark):
    a = spark.createDataFrame([("s", dt.date(2000, 1, x), v) for x, v in ((1, 10.0), (2, 11.0), (4, 13.0))], "site string, d date, t_air double")
    b = spark.createDataFrame([("s", dt.date(2000, 1, x), v) for x, v in ((1, 5.0), (3, 7.0), (5, 9.0))], "site string, d date, t_water double")
    got = prep.complete_calendar(prep.merge([a, b], ("site", "d"))).orderBy("d").collect()
    assert [(r.d.day, r.t_air, r.t_water) for r in got] == [(1, 10.0, 5.0), (2, 11.0, None), (3, None, 7.0), (4, 13.0, None), (5, None, 9.0)]


def test_analysis_counts_blocks(spark):
    df = daily(spark, 100, t_air=lambda i: None if 40 <= i < 50 else 20, q=lambda i: 0 if i == 80 else 10, t_water=lambda i: 15)
    r = prep.analysis_summary(df, 10).first()
    assert (r.n_valid, r.n_short, r.n_gap, r.valid_days, r.valid_obs) == (3, 0, 2, 89, 89)
    assert r.obs_per_parameter_v8 == 89 / 8
    short = prep.analysis_summary(df, 60).first()
    assert (short.n_valid, short.n_short, short.valid_days) == (0, 3, 0)


def test_segments_by_version(spark):
    df = daily(spark, 100, t_air=lambda i: None if 20 <= i < 25 else 20, q=lambda i: None if 60 <= i < 63 else 10, t_water=lambda i: 15)
    bounds = lambda v: [(r.start_d.timetuple().tm_yday - 1, r.end_d.timetuple().tm_yday - 1) for r in prep.segment_table(prep.with_segments(df, v, 10)).orderBy("start_d").collect()]
    assert bounds(4) == [(0, 19), (25, 59), (63, 99)]
    assert bounds(5) == [(0, 19), (25, 99)]
    assert bounds(8) == bounds(4)
    evaluated = prep.with_segments(df, 8, 10, 15).filter("in_eval").count()
    assert evaluated == 5 + 20 + 22


def test_climatology_goes_around_the_year(spark):
    df = daily(spark, 366, t_air=lambda i: 1, q=lambda i: 1, t_water=lambda i: {10: 10.0, 360: 4.0}.get(i))
    got = {r.doy0: r.t for r in prep.climatology(df).collect()}
    assert len(got) == 366 and got[10] == 10 and got[360] == 4
    assert got[365] == pytest.approx(4 + 6 * 5 / 16) and got[2] == pytest.approx(4 + 6 * 8 / 16) and got[185] == pytest.approx(7)


def test_warmup_and_year_fraction(spark):
    df = daily(spark, 400, start="2020-01-01", t_air=lambda i: i, q=lambda i: 1, t_water=lambda i: 1)
    got = {r.idx: r for r in prep.with_warmup(df).collect()}
    assert len(got) == 765 and got[0].d is None and got[0].tt == 1 / 365 and got[365].tt == 1 / 366 and got[730].tt == 1.0 and got[3].t_air == 3
    days = spark.sql("SELECT DATE '2010-09-30' AS d UNION ALL SELECT DATE '2010-10-01'")
    assert sorted(r[0] for r in days.select(water_year(F.col("d"), 10)).collect()) == [2010, 2011]
    assert days.select(F.max(year_fraction(F.col("d")))).first()[0] == 274 / 365


def test_constraints(spark):
    df = daily(spark, 400, t_air=lambda i: 1, q=lambda i: 1)
    assert "t_water" in prep.require(df).columns
    for bad in (df.filter("d <> DATE '2000-02-01'"), df.unionByName(df.limit(1)), df.filter("d > DATE '2000-01-01'"), df.withColumn("q", F.when(F.dayofmonth("d") > 1, F.col("q"))), df.drop("q")):
        with pytest.raises(ValueError):
            prep.require(bad)
    prep.require(df.withColumn("q", F.lit(None).cast("double")), gap_tolerant=True)


def test_folds(spark):
    df = daily(spark, 4 * 365 + 1, start="2010-01-01", t_air=lambda i: 1, q=lambda i: 1, t_water=lambda i: 3 if i < 800 else None)
    assert sorted({r.label for r in prep.folds(df, 1, skip_years=2).collect()}) == ["2012", "2013"]
    assert sorted({r.label for r in prep.folds(df, 2, skip_years=1).collect()}) == ["2011-2012"]
    assert prep.folds(df, 5).count() == 0
    assert {(r.year, r.fold) for r in prep.folds(df, 1, skip_years=1, min_obs=70).collect()} == {(2011, 0), (2012, 1)}
    assert {(r.year, r.fold) for r in prep.folds(df, 1, skip_years=1, min_obs=71).collect()} == {(2011, 0)}
    f = prep.folds(df, 1)
    assert prep.held_out(df, f, 1).count() == 366 and prep.training(df, f, 1).count() == 3 * 365 and prep.years(df).count() == 4


def test_gaps_are_injected(spark):
    df = daily(spark, 1000, t_air=lambda i: i)
    for name, (number, length) in prep.GAPS.items():
        days = [r.t_air for r in prep.with_gaps(df, "t_air", name).orderBy("d").collect()]
        assert sum(x is None for x in days) == number * length
    gone = prep.with_gaps(df, "t_air", "random").filter("t_air IS NULL")
    assert 20 < gone.count() < 90 and gone.count() == prep.with_gaps(df.repartition(7), "t_air", "random").filter("t_air IS NULL").count()
    got = df.withColumn("m", prep.midpoints("t_air")).withColumn("c", prep.celsius("t_air", 0.1)).orderBy("d").collect()
    assert got[3].m == 3.5 and got[-1].m is None and got[273].c is None and got[274].c == pytest.approx(0.85)


def test_periods(spark):
    df = daily(spark, 60, start="2001-01-01", t_water=lambda i: i if i % 3 else None)
    weeks = metrics.periods(df, "1w", 0.5).orderBy("period").collect()
    assert len(weeks) == 8 and weeks[0].n_obs == 4 and weeks[0].obs == pytest.approx((1 + 2 + 4 + 5) / 4) and str(weeks[0].placed_d) == "2001-01-04"
    months = metrics.periods(df, "1m", 0.6).orderBy("period").collect()
    assert [r.n_days for r in months] == [31, 28, 1] and str(months[0].placed_d) == "2001-01-16"
    assert metrics.periods(df, "1d").count() == 40
    for bad in ("2d", "1y", "123w", "w", "0w"):
        with pytest.raises(ValueError):
            period_of(bad)


def test_scores_of_a_perfect_and_a_constant_simulation(spark):
    p = spark.createDataFrame([("s", 1.0, 1.0), ("s", 2.0, 2.0), ("s", 4.0, 4.0), ("c", 1.0, 3.0), ("c", 2.0, 3.0), ("one", 5.0, 5.0)], "site string, obs double, sim double")
    got = {r.site: r for r in metrics.scores(p).collect()}
    assert (got["s"].nse, got["s"].mae, got["s"].rms) == (1, 0, 0) and got["s"].kge == pytest.approx(1) and got["s"].r2 == pytest.approx(1)
    assert (got["c"].r2, got["c"].kge) == (-999, -999) and got["c"].nse == pytest.approx(1 - 5 / 0.5)
    assert (got["one"].nse, got["one"].kge) == (1, -999)


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("project_name: p\nstation_name: A\nwater_station: B\nversion: 5\nsensitivity_perturbations: 2\noptimization: {n_run: 7, wmax: 0.8}\nparameter_bounds: {min: [1,1,1,1,1,1,1,1], max: [2,2,2,2,2,2,2,2]}\ncross_validation: {optimizer_overrides: {n_runs: 3}}\n")
    c = config.read(str(path))
    assert (c.label, c.output_dir, c.perturbations, c.search.n_runs, c.search.w_max) == ("A_B", "p/output_5", (2,), 7, 0.8)
    assert c.bounds() == ([1, 1, 1, 0, 0, 1, 1, 0], [2, 2, 2, 0, 0, 2, 2, 0]) and c.for_fold().search.n_runs == 3
    for bad in ({"version": 6}, {"integrator": "X"}, {"objective_function": "X"}, {"time_resolution": "2d"}, {"uncertainty_options": {"ar1_rho": 1.0}}, {"uncertainty_options": {"prediction_interval": 100}}, {"Qmedia": 0}, {"cross_validation": {"unit": "week"}}, {"cross_validation": {"skip_first_year": False, "min_train_years": 0}}):
        with pytest.raises(ValueError):
            config.parsed(bad)


def test_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Date,T_air,T_water,Discharge\n2000-01-01,1.5,-999,3\n2000-01-02,,2,x\n")
    got = files.read_series(spark, str(tmp_path / "s.csv")).orderBy("d").collect()
    assert [(r.t_air, r.t_water, r.q) for r in got] == [(1.5, None, 3.0), (None, 2.0, None)]
    (tmp_path / "bad.csv").write_text("Date,T_air\n2000-01-01,1\n")
    with pytest.raises(ValueError):
        files.read_series(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.txt").write_text(" 2000 1 2  3.5 4.5\n2000 1 3 3 4 9\n\n")
    assert [(str(r.d), r.t_air, r.q) for r in files.read_text_series(spark, str(tmp_path / "t.txt")).orderBy("d").collect()] == [("2000-01-02", 3.5, 1.0), ("2000-01-03", 3.0, 9.0)]
    (tmp_path / "chain.csv").write_text("par_1,par_3\n0.5,0.7\n0.6,0.8\n")
    (tmp_path / "chain_meta.json").write_text('{"rho": 0.5}')
    assert sorted(r.p[:3] for r in files.read_chain(spark, str(tmp_path / "chain.csv"), [9.0] * 8).collect()) == [[0.5, 9.0, 0.7], [0.6, 9.0, 0.8]]
    assert [(r.site, r.rho) for r in files.read_sidecar(spark, str(tmp_path / "chain.csv")).collect()] == [(None, 0.5)] and files.read_sidecar(spark, str(tmp_path / "none.csv")).collect() == []
    history = spark.createDataFrame([("s", k, [float(k)] * 8, x, x, x, x) for k, x in enumerate((0.9, -0.5))], "site string, eval long, p array<double>, eff_index double, nse double, r2 double, mae double")
    files.write_history(history, str(tmp_path / "h"))
    assert spark.read.option("header", True).csv(str(tmp_path / "h")).count() == 1
    files.write_json(spark.createDataFrame([(1.5, None)], "a double, b double"), str(tmp_path / "j"))
    assert "".join(p.read_text() for p in (tmp_path / "j").glob("part*")) == '{"a":1.5,"b":null}\n'
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="JSON"):
            files.write_json(spark.createDataFrame([(bad,)], "a double"), str(tmp_path / "k"))


def test_reports_of_a_series(spark):
    df = daily(spark, 100, t_air=lambda i: None if 40 <= i < 50 else 20, q=lambda i: 0 if i == 80 else 10, t_water=lambda i: 15)
    r = reports.gap_summary(df, 8, 10).first()
    assert (r.qmedia_source, r.qmedia, r.t_air_missing, r.q_missing, r.n_segments, r.valid_days, r.n_obs) == ("computed", 10, 10, 0, 3, 89, 100)
    w = reports.flow_warnings(df, 14.0).first()
    assert not w.mostly_missing and w.far_off
    text = reports.analysis_text(prep.analysis_summary(df, 10).first().asDict(), prep.missing(df).first().asDict(), [x.asDict() for x in prep.segment_table(prep.with_segments(df, 8, 10)).orderBy("seg_id").collect()])
    assert "t_air: 10 missing (10.00 %)" in text and "3 valid, 0 too short, 2 gaps" in text and "segment 2: 2000-02-20 to 2000-03-20" in text
    q = spark.range(1, 1000).select((F.col("id") / 1000).alias("p"), stats.normal_quantile(F.col("id") / 1000).alias("z")).unionByName(spark.createDataFrame([(1e-13, 0.0), (1e-7, 0.0)], "p double, z double").withColumn("z", stats.normal_quantile(F.col("p"))))
    for x in q.collect():
        assert x.z == pytest.approx(NormalDist().inv_cdf(x.p), abs=1e-12)
