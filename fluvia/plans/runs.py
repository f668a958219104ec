"""Whole runs: preparation, search, simulation, scores, outputs and validation of all sites of a forcing table."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions.kernels import ACTIVE, NEEDS_FLOW
from fluvia.operators import metrics, prep, reports, search, uncertainty
from fluvia.operators import simulate as sim
from fluvia.sources import files, stations
from fluvia.sources.config import Config
from fluvia.sources.scratch import written

#: Two scores of one simulation are the same up to this.
SAME_SCORE = 1e-4


def options_of(c: Config) -> dict:
    seed = {} if c.seed is None else {"seed": c.seed}
    if c.mode == "LATHYP":
        return seed | {"n": c.search.n_runs}
    if c.mode == "PSO":
        return seed | {"particles": c.search.n_particles, "iterations": c.search.n_runs, "c1": c.search.c1, "c2": c.search.c2, "w_max": c.search.w_max, "w_min": c.search.w_min}
    return seed | {"members": c.search.n_particles, "generations": c.search.n_runs}


def method_of(c: Config) -> str:
    return c.mode if c.mode in search.METHODS else "DE"


def days_of(forcing: DataFrame, c: Config) -> DataFrame:
    """The days of the segments, or of the whole series, with what searches need at the configured resolution."""
    prep.require(forcing, c.gap_tolerant)
    days = sim.prepared(forcing, c.version, c.min_days, c.warmup_days, c.qmedia) if c.gap_tolerant else sim.whole(forcing, c.version, c.qmedia)
    return metrics.with_periods(days, forcing, c.resolution, c.prc)


def history_of(forcing: DataFrame, c: Config) -> DataFrame:
    """Every evaluation of the configured search."""
    low, high = c.bounds()
    return search.history(days_of(forcing, c), method_of(c), low, high, c.version, c.integrator, c.objective, c.ice, **options_of(c))


def best_of(forcing: DataFrame, c: Config, history: DataFrame | None = None) -> DataFrame:
    """(site, p, score) by the run mode. A forward run scores the sites that have observations."""
    if c.mode != "FORWARD":
        return search.best_of(history_of(forcing, c) if history is None else history).select("site", "p", "score")
    if c.parameters is None:
        raise ValueError("a forward run needs parameters")
    on = ACTIVE[c.version]
    given = F.array(*[F.lit(x if k in on else 0.0) for k, x in enumerate(c.parameters)])
    fixed = forcing.select("site").distinct().select("site", given.alias("p"))
    scored = scores(forcing, fixed, c).select("site", F.col(c.objective.lower()).alias("score"))
    return fixed.join(scored, "site", "left")


def simulated(forcing: DataFrame, best: DataFrame, c: Config) -> DataFrame:
    """The output series of each site with its best parameters, evaluated days marked."""
    rows = sim.packed(days_of(forcing, c)).join(best.select("site", "p"), "site")
    tw = sim.simulate(rows, None, c.version, c.integrator, c.ice).filter("d IS NOT NULL")
    after = c.warmup_days if c.gap_tolerant else 0
    return sim.series(forcing, tw).withColumn("in_eval", F.coalesce(F.col("seg_day") > after, F.lit(False)))


def scores(forcing: DataFrame, best: DataFrame, c: Config, series: DataFrame | None = None) -> DataFrame:
    """The metrics of each site at the configured resolution."""
    out = simulated(forcing, best, c) if series is None else series
    return metrics.scores(metrics.periods(out, c.resolution, c.prc, "t_water_sim"))


def fold_table(forcing: DataFrame, c: Config) -> DataFrame:
    f = c.folds
    return prep.folds(forcing, c.fold_years, f.first_month, f.min_train_years + int(f.skip_first_year), f.min_valid_obs)


def _validated(forcing: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    folds = written(fold_table(forcing, c), "folds")
    if not folds.limit(1).collect():
        raise ValueError("no folds: check the first training years against the length of the record")
    low, high = c.bounds()
    d = c.for_fold()
    return uncertainty.cross_validate(forcing, folds, low, high, method_of(d), d.version, d.integrator, d.folds.first_month, d.min_days, resolution=d.resolution, prc=d.prc, score=d.objective, warmup_days=d.warmup_days, ice=d.ice, qmedia=d.qmedia, gap_tolerant=d.gap_tolerant, **options_of(d))


def cross_validation(forcing: DataFrame, c: Config) -> DataFrame:
    results, held = _validated(forcing, c)
    return reports.cv_summary(results, metrics.fold_scores(held, ("site",)))


def posterior(forcing: DataFrame, c: Config, best: DataFrame | None = None) -> DataFrame:
    """DE-MCMC and DE-CV-MCMC: chains around the best vectors; in the latter each walker starts with the deviation of
    each parameter over the site's own folds."""
    low, high = c.bounds()
    best = best_of(forcing, c) if best is None else best
    if c.mode == "DE-CV-MCMC":
        results, _ = _validated(forcing, replace(c, mode="DE"))
        best = best.join(reports.spread_array(uncertainty.walker_spread(results)), "site", "left")
        best = best.withColumn("spread", F.coalesce("spread", F.array(*[F.lit(1e-4)] * 8)))
    return search.posterior(days_of(forcing, c), best, low, high, c.version, c.integrator, 1e-4, c.search.walkers, c.search.steps, seed=c.seed or 0, ice=c.ice)


def residual_rho(series: DataFrame) -> DataFrame:
    """(site, n_pairs, rho) of a simulated series' evaluated days; a whole series is one segment."""
    e = series.filter("in_eval").withColumn("residual", F.col("t_water_sim") - F.col("t_water"))
    return uncertainty.ar1_rho(e.withColumn("seg_id", F.coalesce("seg_id", F.lit(0))))


def intervals(forcing: DataFrame, chain: DataFrame, c: Config, sigma: DataFrame, rho: DataFrame | None = None) -> DataFrame:
    """(site, d, lower, p50, upper) of a chain (site, sample_id, p) with the noise of each site: sigma (site, sigma) and,
    for correlated noise, rho (site, rho). All sites run as one ensemble."""
    return uncertainty.site_intervals(days_of(forcing, c), chain, sigma, rho if c.noise == "ar1" else None, c.version, c.integrator, c.interval, c.n_samples, c.seed or 0, c.ice).filter("d IS NOT NULL")


def sidecar(chain: DataFrame, series: DataFrame, c: Config) -> DataFrame:
    """One row for each site: what a later forward run needs to know of a chain."""
    report = search.chain_report(chain, c.search.steps)
    pairs = residual_rho(series)
    return report.join(pairs, "site").select(
        "site", "rho", F.sqrt(F.col("sse") / F.col("n")).alias("sigma"), F.col("n").alias("n_valid_days"), "n_pairs", F.lit(c.noise).alias("noise_model_used_for_this_run"),
        F.lit(c.search.walkers).alias("mcmc_walkers"), F.lit(c.search.steps).alias("mcmc_steps"), F.lit(c.seed).cast("int").alias("mcmc_seed"), F.col("acceptance").alias("mean_acceptance_fraction"), F.col("tau").alias("mean_autocorr_time"), "long_enough",
    )


def read_period(spark: SparkSession, path: str | None, required: bool) -> DataFrame | None:
    """A period's forcing; a missing calibration file is an error, a missing validation file means no validation."""
    if path is None or not files.exists(spark, path):
        if required:
            raise FileNotFoundError(f"no calibration data at {path}")
        return None
    return written(stations.read_stations(spark, path)[0] if files.is_folder(spark, path) and not files.has_parts(spark, path) else files.read_series(spark, path), "forcing")


def site_problems(forcing: DataFrame, c: Config) -> DataFrame:
    """(site, problem): why the model can't run on a site, or a search can't fit it; one row for each reason."""
    flow = F.avg(F.when(F.col("q") > 0, F.col("q"))) if c.qmedia is None else F.max(F.lit(float(c.qmedia)))
    counts = forcing.groupBy("site").agg(F.count("t_water").alias("n_obs"), F.coalesce(flow, F.lit(0.0)).alias("flow"))
    found = [F.when((F.col("n_obs") == 0) & F.lit(c.mode != "FORWARD"), "no observations"), F.when((F.col("flow") <= 0) & F.lit(c.version in NEEDS_FLOW), "no positive flow")]
    if c.gap_tolerant:
        segments = prep.with_segments(forcing, c.version, c.min_days).filter("seg_id IS NOT NULL").select("site").distinct().withColumn("some", F.lit(True))
        counts = counts.join(segments, "site", "left")
        found.append(F.when(F.col("some").isNull(), "no valid segment of the least length"))
    return counts.select("site", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("problem"))


def problems_of(forcing: DataFrame, c: Config) -> DataFrame:
    """The problems of sites, written; an error if no site is left without one."""
    found = written(site_problems(forcing, c), "problems")
    left = forcing.select("site").distinct().join(found, "site", "left_anti")
    if (first := found.limit(1).collect()) and not left.limit(1).collect():
        raise ValueError(f"{first[0].problem}: {first[0].site}")
    return found


def _residuals(series: DataFrame, out: files.Outputs) -> None:
    """Histogram, normal quantiles and autocorrelation at all lags of the residuals of each site."""
    e = written(reports.residuals(series, "t_water_sim").filter("residual IS NOT NULL").select("site", "d", "residual"), "residuals")
    out.csv("residual_histogram", reports.histogram(e, "residual"))
    out.csv("residual_quantiles", reports.normal_quantiles(e, "residual"))
    out.csv("residual_autocorrelation", reports.autocorrelation(e, "residual"))


def _outputs(forcing: DataFrame, best: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """The written series of a period and its scores."""
    series = written(simulated(forcing, best, c), "series")
    if not series.filter("t_water_sim IS NOT NULL").limit(1).collect():
        raise ValueError("no valid segment of the least length")
    return series, scores(forcing, best, c, series)


def run(spark: SparkSession, c: Config, calibration: DataFrame | None = None, validation: DataFrame | None = None) -> dict[str, str]:
    """A configured run with its outputs: the folder of each, by name.

    Cross-validation, where it is enabled for a search, writes its table and ends. Otherwise: parameters and bounds,
    history, best vectors with the scores of both periods, both series, gaps, and, as the mode has them, chains with
    sidecar and envelopes, reports, sensitivity. The score of the written series must be the one that the search found.
    """
    forcing = read_period(spark, c.calibration, True) if calibration is None else written(calibration, "forcing")
    out = files.Outputs(spark, c, [r.site for r in forcing.select("site").distinct().collect()])
    if c.folds.enabled and c.mode in search.METHODS:
        out.csv("cv_results", cross_validation(forcing, c))
        return out.places
    out.text("parameters", files.parameters_text(c))
    out.csv("problems", problems_of(forcing, c))
    if c.mode == "FORWARD":
        best = written(best_of(forcing, c), "best")
    else:
        history = written(history_of(forcing, c), "history")
        out.csv("history", files.history_columns(history).filter(F.col("eff_index") >= c.min_score))
        out.csv("acceptable", reports.acceptable(files.history_columns(history), c.objective))
        out.csv("running_best", reports.running_best(history, "eval", ("site",)).drop("p"))
        best = written(best_of(forcing, c, history), "best")
    series, found = _outputs(forcing, best, c)
    found = written(found.select("site", *metrics.SCORES), "scores")
    if c.mode != "FORWARD":
        other = best.join(found, "site").filter(F.abs(F.col("score") - F.col(c.objective.lower())) > SAME_SCORE)
        if bad := other.limit(1).collect():
            raise RuntimeError(f"the series doesn't have the score of the search: {bad[0]}")
    out.csv("calibration", files.output_series(series, c.resolution, c.prc, c.gap_tolerant))
    if c.gap_tolerant:
        out.csv("gaps", reports.gap_summary(forcing, c.version, c.min_days, c.qmedia))
        segments = written(prep.segment_table(prep.with_segments(forcing, c.version, c.min_days)), "segments")
        out.csv("segments", segments)
        out.csv("segment_warnings", prep.segment_warnings(segments))
    _residuals(series, out)
    if c.version in NEEDS_FLOW:
        out.csv("flow_warnings", reports.flow_warnings(forcing, c.qmedia))
    out.csv("goodness_of_fit", metrics.goodness_of_fit(series.select("site", F.col("t_water").alias("obs"), F.col("t_water_sim").alias("sim")), len(ACTIVE[c.version])))
    if c.mode in ("DE-MCMC", "DE-CV-MCMC"):
        _chains(forcing, best, series, c, out)
    if c.mode == "FORWARD" and c.intervals:
        _forward_intervals(spark, forcing, best, series, c, out)
    best = best.join(found.select("site", F.col(c.objective.lower()).alias("calibration_score")), "site", "left")
    later = read_period(spark, c.validation, False) if validation is None else written(validation, "validation")
    later = None if later is None else prep.with_a_year(later)
    if later is not None and later.limit(1).collect():
        try:
            v_series, v_found = _outputs(later, best, c)
        except ValueError as e:
            out.text("validation_skipped", f"{e}\n")
        else:
            out.csv("validation", files.output_series(v_series, c.resolution, c.prc, c.gap_tolerant))
            best = best.join(v_found.select("site", F.col(c.objective.lower()).alias("validation_score")), "site", "left")
    out.csv("best", files.best_columns(best))
    if c.sensitivity:
        _sensitivity(forcing, best, c, out)
    out.manifest()
    return out.places


def _chains(forcing: DataFrame, best: DataFrame, series: DataFrame, c: Config, out: files.Outputs) -> None:
    chain = written(posterior(forcing, c, best), "chain")
    side = written(sidecar(chain, series, c), "sidecar")
    on = [k for k in ACTIVE[c.version] if c.bounds()[1][k] > c.bounds()[0][k]]
    out.chain("chain", chain, on)
    out.json("chain_meta", side)
    env = intervals(forcing, chain, c, side.select("site", "sigma"), side.select("site", F.coalesce(F.lit(c.rho), "rho").alias("rho")))
    out.csv("envelopes", files.envelope_columns(reports.masked_envelope(env, series)))
    out.csv("parameter_significance", reports.posterior_summary(chain, ("site",)))
    out.csv("parameter_correlation", reports.parameter_correlation(chain, 8, ("site",)))


def stored_chain(spark: SparkSession, path: str, best: DataFrame, c: Config) -> DataFrame:
    """(site, sample_id, p) of the sites of best: each its own samples of a chain by site, all the same of another one."""
    chain, sites = files.read_chain(spark, path, list(c.parameters)), best.select("site").distinct()
    if "site" in chain.columns:
        return chain.join(F.broadcast(sites), "site")  # a row a site; the chain's partitions are pruned to these sites
    return sites.crossJoin(F.broadcast(uncertainty.sampled(chain, c.n_samples, c.seed or 0)))  # n_samples rows at most


def forward_rho(best: DataFrame, own: DataFrame, side: DataFrame, given: float | None) -> DataFrame:
    """(site, rho) of the noise: what is given, else the correlation of the site's own residuals (site, n_pairs, rho),
    where it has pairs, else the sidecar's of the site, or of all sites, else 0."""
    for_all = side.filter("site IS NULL").agg(F.max("rho").alias("rho_of_all"))
    by_site = side.filter("site IS NOT NULL").groupBy("site").agg(F.max("rho").alias("rho_of_site"))
    own = own.select("site", F.when(F.col("n_pairs") > 0, F.col("rho")).alias("own"))
    rho = F.coalesce(F.lit(given).cast("double"), "own", "rho_of_site", "rho_of_all", F.lit(0.0))
    return best.select("site").distinct().join(own, "site", "left").join(by_site, "site", "left").crossJoin(F.broadcast(for_all)).select("site", rho.alias("rho"))


def _forward_intervals(spark: SparkSession, forcing: DataFrame, best: DataFrame, series: DataFrame, c: Config, out: files.Outputs) -> None:
    """Percentiles from a stored chain; sites that it doesn't have are listed and have no envelope."""
    if c.chain is None or not files.exists(spark, c.chain):
        out.text("intervals_skipped", f"no chain at {c.chain}\n")
        return
    chain = written(stored_chain(spark, c.chain, best, c), "chain")
    rho = forward_rho(best, residual_rho(series), files.read_sidecar(spark, c.chain), c.rho)
    env = written(intervals(forcing, chain, c, best.select("site", F.lit(float(c.sigma)).alias("sigma")), rho), "envelopes")
    out.csv("forward_envelopes", files.envelope_columns(reports.masked_envelope(env, series)))
    out.csv("sites_without_chain", best.select("site", F.lit("no samples").alias("problem")).join(chain.select("site").distinct(), "site", "left_anti"))


def _sensitivity(forcing: DataFrame, best: DataFrame, c: Config, out: files.Outputs) -> None:
    low, high = c.bounds()
    table = uncertainty.sensitivity_of(written(days_of(forcing, c), "days"), best.select("site", "p"), low, high, tuple(c.perturbations), c.version, c.integrator, c.ice)
    table = written(table, "sensitivity")
    out.csv("sensitivity", table)
    out.csv("sensitivity_by_perturbation", reports.sensitivity_columns(table, tuple(c.perturbations)))


def main(config: str) -> None:
    """A run by a YAML file."""
    from fluvia.sources.config import read

    spark = SparkSession.builder.appName("fluvia").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, place in run(spark, read(config)).items():
        print(f"{name}: {os.path.normpath(place)}")
