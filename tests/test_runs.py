import json

import pytest
from pyspark.sql import functions as F

from fluvia.plans import runs
from fluvia.sources.config import Config, Folds, Search
from tests.test_models import series

LOW, HIGH = (0.0, 0.1, 0.1, 0, 0, 0, 0, 0), (1.0, 0.6, 0.8, 0, 0, 0, 0, 0)


def config(**more):
    return Config(**{"version": 3, "gap_tolerant": True, "low": LOW, "high": HIGH, "mode": "DE", "seed": 1, "search": Search(n_runs=8, n_particles=4, walkers=8, steps=10)} | more)


#: Outputs of every run.
NEW = {"problems", "manifest", "residual_histogram", "residual_quantiles", "residual_autocorrelation"}


def rows(spark, place):
    return spark.read.option("header", True).option("inferSchema", True).csv(place).collect()


def test_calibrate_simulate_score(spark):
    f = series(spark, 400, ("a",))
    c = config()
    best = spark.createDataFrame(runs.best_of(f, c).collect())
    assert best.first().score > 0.9
    out = runs.simulated(f, best, c)
    assert out.count() == 400 and out.filter("t_water_sim IS NULL").count() == 2
    assert runs.scores(f, best, c).first().nse == pytest.approx(best.first().score)
    assert runs.scores(f, best, config(resolution="2w", prc=0.5)).first().n > 20


def test_forward_and_errors(spark):
    f = series(spark, 400, ("a",))
    with pytest.raises(ValueError):
        runs.best_of(f, config(gap_tolerant=False))
    whole = f.na.fill({"t_air": 5.0})
    c = config(mode="FORWARD", parameters=(0.5, 0.3, 0.4, 9.0, 0.0, 0.0, 0.0, 0.0), gap_tolerant=False)
    best = runs.best_of(whole, c)
    assert best.first().p[3] == 0 and best.first().score > 0.9
    assert runs.simulated(whole, best, c).filter("t_water_sim IS NULL").count() == 0
    unseen = whole.withColumn("t_water", F.lit(None).cast("double"))
    assert runs.best_of(unseen, c).first().score is None and runs.simulated(unseen, best, c).filter("t_water_sim IS NULL").count() == 0
    with pytest.raises(ValueError):
        runs.best_of(whole, config(mode="FORWARD", gap_tolerant=False))


def test_fold_options(spark):
    f = series(spark, 5 * 365, ("a",))
    labels = lambda **x: sorted({r.label for r in runs.fold_table(f, config(folds=Folds(enabled=True, **x))).collect()})
    assert labels() == ["2003", "2004", "2005"]
    assert labels(min_train_years=2) == ["2004", "2005"]
    assert labels(skip_first_year=False, min_train_years=1) == ["2002", "2003", "2004", "2005"]
    assert labels(unit="n_years", n_years=2) == ["2003-2004"] and labels(unit="year", n_years=2) == ["2003", "2004", "2005"]
    assert labels(min_valid_obs=292) == labels() and labels(min_valid_obs=293) == []


def test_cross_validation_and_posterior(spark):
    f = series(spark, 4 * 365, ("a",))
    got = {r.fold: r for r in runs.cross_validation(f, config(folds=Folds(enabled=True))).collect()}
    assert set(got) == {"2003", "2004", "mean", "std", "pooled"} and got["pooled"].nse > 0.9
    whole = {r.fold: r for r in runs.cross_validation(f.na.fill({"t_air": 5.0}), config(folds=Folds(enabled=True), gap_tolerant=False)).collect()}
    assert set(whole) == set(got) and whole["pooled"].nse > 0.9
    with pytest.raises(ValueError):
        runs.cross_validation(f, config(folds=Folds(unit="n_years", n_years=9)))
    chain = runs.posterior(f, config(mode="DE-CV-MCMC"))
    assert chain.count() == 7 * 8


def test_run_writes_its_outputs(spark, tmp_path):
    data = series(spark, 900, ("a", "b"))
    split = F.col("d") < "2002-06-01"
    c = config(mode="DE-MCMC", station="A", water_station="B", output=str(tmp_path / "out"), noise="ar1", sensitivity=True, perturbations=(1.0, 2.5), min_score=0.5, resolution="1w", prc=0.5)
    places = runs.run(spark, c, data.filter(split), data.filter(~split))
    assert {"parameters", "history", "acceptable", "running_best", "calibration", "gaps", "segments", "segment_warnings", "goodness_of_fit", "chain", "chain_meta", "envelopes", "parameter_significance", "parameter_correlation", "validation", "best", "sensitivity", "sensitivity_by_perturbation"} | NEW == set(places)
    assert places["calibration"].endswith("2_DE-MCMC_NSE_A_B_seriesc_1w.csv")
    series_rows = rows(spark, places["calibration"])
    assert len(series_rows) == 2 * 516 and {"Twat_obs_agg", "Twat_mod_agg", "segment_id"} <= set(series_rows[0].asDict())
    assert 60 < sum(r.Twat_obs_agg > -999 for r in series_rows) < 160
    assert all(r.eff_index >= 0.5 for r in rows(spark, places["history"])) and len(rows(spark, places["chain"])) == 2 * 7 * 8
    meta = [json.loads(x) for p in (tmp_path / "out" / "MCMC_chain_A_B_series_1w_meta.json").glob("part*") for x in p.read_text().splitlines()]
    assert {m["site"] for m in meta} == {"a", "b"} and all(m["sigma"] >= 0 and m["mcmc_walkers"] == 8 and not m["long_enough"] for m in meta)
    best = {r.site: r for r in rows(spark, places["best"])}
    assert best["a"].calibration_score > 0.9 and best["b"].validation_score > 0.8
    short = runs.run(spark, config(output=str(tmp_path / "short")), data.filter(split), data.filter("d > DATE '2003-01-01'"))
    assert "validation" not in short and "validation_score" not in rows(spark, short["best"])[0].asDict()
    wide = rows(spark, places["sensitivity_by_perturbation"])
    assert len(wide) == 16 and sum(r.sensitivity_1 is not None and r.sensitivity_2_5 is not None for r in wide) == 6


def test_validation_forward_intervals_and_missing_files(spark, tmp_path):
    data = series(spark, 1200, ("a",)).withColumn("t_air", F.coalesce("t_air", F.lit(5.0)))
    split = F.col("d") < "2003-01-01"
    for name, some in (("cal", split), ("val", ~split)):
        data.filter(some).orderBy("d").selectExpr("d AS Date", "t_air AS T_air", "t_water AS T_water", "q AS Discharge").coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    (tmp_path / "chain.csv").write_text("par_1,par_2\n" + "".join(f"{0.45 + i / 200},0.3\n" for i in range(20)))
    (tmp_path / "chain_meta.json").write_text('{"rho": 0.5}')
    c = config(mode="FORWARD", parameters=(0.5, 0.3, 0.4, 0, 0, 0, 0, 0), gap_tolerant=False, calibration=str(tmp_path / "cal"), validation=str(tmp_path / "val"), output=str(tmp_path / "out"), intervals=True, chain=str(tmp_path / "chain.csv"), sigma=0.3, noise="ar1", n_samples=15)
    places = runs.run(spark, c)
    best = rows(spark, places["best"])[0]
    assert best.par_1 == 0.5 and best.calibration_score > 0.99 and best.validation_score > 0.9
    bounds = [r for r in rows(spark, places["forward_envelopes"])]
    assert len(bounds) == 730 and all(r.Twat_mod_lower <= r.Twat_mod_p50 <= r.Twat_mod_upper for r in bounds)
    assert len(rows(spark, places["validation"])) == 470
    with pytest.raises(FileNotFoundError):
        runs.run(spark, config(calibration=str(tmp_path / "none")))
    assert runs.read_period(spark, str(tmp_path / "none"), False) is None
    cv = runs.run(spark, config(folds=Folds(enabled=True, min_train_years=0), output=str(tmp_path / "cv")), data)
    assert {r.fold for r in rows(spark, cv["cv_results"])} == {"2002", "2003", "2004", "mean", "std", "pooled"} and list(cv) == ["cv_results"]
