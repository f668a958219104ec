"""Residual correlation, noise, prediction intervals, sensitivity and cross-validation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions import kernels
from fluvia.functions.dates import water_year
from fluvia.functions.stats import correlation
from fluvia.operators import ensembles, metrics, prep, reports, search
from fluvia.operators import simulate as sim
from fluvia.sources.scratch import written

MIN_PAIRS = 30


def ar1_rho(residuals: DataFrame, keys: tuple[str, ...] = ("site",), value: str = "residual") -> DataFrame:
    """Correlation of residuals on neighbouring days of a segment; 0 below 30 pairs, clipped to 0 .. 0.99."""
    w = Window.partitionBy(*keys, "seg_id").orderBy("d")
    before = F.when(F.datediff("d", F.lag("d").over(w)) == 1, F.lag(value).over(w))
    pairs = residuals.withColumn("before", before).filter(F.col(value).isNotNull() & F.col("before").isNotNull())
    out = residuals.select(*keys).distinct().join(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), correlation("before", value).alias("r")), list(keys), "left")
    r = F.when((F.col("n_pairs") >= MIN_PAIRS) & F.col("r").isNotNull() & ~F.isnan("r"), F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.col("r")))).otherwise(0.0)
    return out.select(*keys, F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"), r.alias("rho"))


def normal_draws(seed: int, *columns: str) -> Column:
    """Standard normal draws from hashes of a row's columns with the seed: the same however rows are dealt to tasks."""
    name = lambda k: F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), *[F.col(c).cast("string") for c in columns])
    uniform = lambda k: (F.conv(F.substring(F.md5(name(k)), 1, 13), 16, 10).cast("long") + 0.5) * 2.0**-52
    return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))


def iid_noise(df: DataFrame, sigma: float, seed: int, name: str = "noise", by: tuple[str, ...] = ("site", "d")) -> DataFrame:
    """df with independent noise; ``by`` are the columns that tell rows apart."""
    return df.withColumn(name, normal_draws(seed, *by) * sigma)


def _noise(batches: Iterator[pd.DataFrame], sigma: float, rho: float, keys: tuple[str, ...], order: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        z = [np.asarray(x, float) for x in batch["z"]]
        size = np.array([len(x) for x in z])
        rows = np.zeros((size.max(initial=0), len(z)))  # the segments of a batch step together
        for k, x in enumerate(z):
            rows[: len(x), k] = x
        noise = kernels.ar1(rows, sigma, rho)
        once = {k: np.repeat(batch[k].to_numpy(), size) for k in keys}
        yield pd.DataFrame(once | {order: np.concatenate([np.asarray(x) for x in batch["at"]]), "noise": np.concatenate([noise[:n, k] for k, n in enumerate(size)])})


def ar1_noise(df: DataFrame, sigma: float, rho: float, seed: int = 0, z: Column | None = None, keys: tuple[str, ...] = ("site", "seg_id"), order: str = "seg_day") -> DataFrame:
    """(keys, order, noise): correlated noise of each segment from standard normal draws, or from a given column."""
    draws = df.select(*keys, order, (z if z is not None else normal_draws(seed, *keys, order)).alias("z"))
    kinds = ", ".join(f"{k} {dict(draws.dtypes)[k]}" for k in (*keys, order))
    packed = draws.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), "z"))).alias("x")).select(*keys, F.col("x.at").alias("at"), F.col("x.z").alias("z"))
    return packed.mapInPandas(partial(_noise, sigma=sigma, rho=rho, keys=keys, order=order), f"{kinds}, noise double")


def sampled(chain: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of a chain without replacement; the hash of the row's id with the seed decides, so a rerun is the same."""
    return chain.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string"))), "sample_id").limit(n)


def intervals_of(days: DataFrame, params: DataFrame, n: int, version: int, integrator: str, ice: float, interval: float, noise: DataFrame | None, seed: int, keys: tuple[str, ...], rolling: int = 1) -> DataFrame:
    """(keys, d, lower, p50, upper) over params of at most n vectors of each key: within the tasks that simulate them, or,
    beyond ``ensembles.MOST_VECTORS``, from the ensemble dealt by day."""
    if n <= ensembles.MOST_VECTORS:
        return ensembles.daily_percentiles(days, params, version, integrator, ice, interval, noise, seed, rolling, keys)
    ensemble = sim.simulate_many(days, params, version, integrator, ice, keys, noise=noise, seed=seed)
    if rolling > 1:
        w = Window.partitionBy(*keys, "param_id").orderBy(F.unix_date("d")).rangeBetween(1 - rolling, 0)
        ensemble = ensemble.withColumn("tw", F.avg("tw").over(w))
    return reports.envelope(ensemble, interval, keys)


def prediction_intervals(days: DataFrame, chain: DataFrame, sigma: float = 0.0, rho: float = 0.0, version: int = 8, integrator: str = "RK4", interval: float = 90.0, n: int = 1000, seed: int = 0, keys: tuple[str, ...] = ("site",), rolling: int = 1) -> DataFrame:
    """Percentiles over n posterior samples (sample_id, p), the same for all keys, of the simulation plus residual noise."""
    some = sampled(chain, n, seed).select(F.col("sample_id").alias("param_id"), "p")
    noise = days.select(*keys).distinct().withColumns({"sigma": F.lit(float(sigma)), "rho": F.lit(float(rho))}) if sigma else None
    return intervals_of(days, some, n, version, integrator, 0.0, interval, noise, seed, keys, rolling)


#: Hexadecimal digits of a sample's hash by which samples are counted before any are sorted.
PREFIX = 4


def first_by_hash(chain: DataFrame, n: int, order: Column, keys: tuple[str, ...]) -> DataFrame:
    """Rows of each key up to the first prefix of their hashes ``order`` within which n are found: the n first, and the
    rest of that prefix, one in 16 ** PREFIX of the key's rows. Only counts are shuffled, and a row a key is broadcast."""
    prefix = F.coalesce(F.substring(order, 1, PREFIX), F.lit(""))  # null hashes are the first
    counts = chain.groupBy(*keys, prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("prefix"))
    last = counts.withColumn("upto", upto).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("prefix"))), F.max("prefix")).alias("last"))
    return prep.null_safe_join(chain, F.broadcast(last), keys).filter(prefix <= F.col("last")).drop("last")


def sampled_by_key(chain: DataFrame, n: int, seed: int = 0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """``sampled`` for each key of a chain (keys, sample_id, p): the samples as params (keys, param_id, p)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_id").cast("string")))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "sample_id"))
    some = first_by_hash(chain, n, order, keys).withColumn("at", at).filter(F.col("at") <= n)
    return some.select(*keys, (F.col("at").cast("long") - 1).alias("param_id"), "p")


def site_intervals(days: DataFrame, chain: DataFrame, sigma: DataFrame | None = None, rho: DataFrame | None = None, version: int = 8, integrator: str = "RK4", interval: float = 90.0, n: int = 1000, seed: int = 0, ice: float = 0.0, keys: tuple[str, ...] = ("site",), rolling: int = 1) -> DataFrame:
    """The same for chains of the keys' own (keys, sample_id, p), with sigma (keys, sigma) and rho (keys, rho), or without
    noise: n samples of each key, picked by hash. Keys without samples have no rows."""
    noise = None if sigma is None else sigma.join(rho, list(keys)) if rho is not None else sigma.withColumn("rho", F.lit(0.0))
    return intervals_of(days, sampled_by_key(chain, n, seed, keys), n, version, integrator, ice, interval, noise, seed, keys, rolling)


def sensitivity(days: DataFrame, p: list[float], low: list[float], high: list[float], percents: tuple[float, ...] = (1.0,), version: int = 8, integrator: str = "RK4", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """``sensitivity_of`` around one vector for all keys."""
    best = days.select(*keys).distinct().withColumn("p", F.array(*[F.lit(float(x)) for x in p]))
    return sensitivity_of(days, best, low, high, percents, version, integrator, keys=keys)


def sensitivity_of(days: DataFrame, best: DataFrame, low: list[float], high: list[float], percents: tuple[float, ...] = (1.0,), version: int = 8, integrator: str = "RK4", ice: float = 0.0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, perturbation, parameter, sensitivity, status): mean absolute change per relative change, one parameter of
    the key's vector (keys, p) at a time, on evaluated days with an observation. The two vectors of a
    run go through a task together, which returns sums alone."""
    lo, hi = (F.array(*[F.lit(float(x)) for x in v]) for v in (low, high))
    k, pct = F.col("parameter") - 1, F.col("perturbation")
    of = lambda a: F.element_at(a, F.col("parameter"))
    runs = best.select(*keys, "p", F.explode(F.array(*[F.lit(float(x)) for x in percents])).alias("perturbation")).withColumn("parameter", F.explode(F.sequence(F.lit(1), F.lit(8))))
    base = F.greatest(F.abs(of("p")), F.lit(1e-4))
    runs = runs.withColumns({"down": F.greatest(of(lo), of("p") - base * pct / 100), "up": F.least(of(hi), of("p") + base * pct / 100), "base": base})
    on = F.array(*[F.lit(i in kernels.ACTIVE[version]) for i in range(8)])
    status = F.when(~of(on), "Inactive").when((of(hi) <= of(lo)) | (F.col("up") <= F.col("down")), "Fixed").otherwise("Active")
    runs = runs.withColumns({"status": status, "relative": (F.col("up") - F.col("down")) / F.col("base")})
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("perturbation", "parameter")).cast("long")
    active = runs.filter("status = 'Active'").withColumn("run", number)
    side = lambda c: F.transform("p", lambda x, i: F.when(i == k, F.col(c)).otherwise(x))
    pairs = active.select(*keys, "run", side("down").alias("down"), side("up").alias("up"))
    sums = ensembles.paired_differences(days, pairs, version, integrator, ice, keys=keys)
    index = active.join(sums, [*keys, "run"], "left").select(*keys, "perturbation", "parameter", (F.try_divide("change", "n") / F.col("relative")).alias("sensitivity"))
    return runs.select(*keys, "perturbation", "parameter", "status").join(index, [*keys, "perturbation", "parameter"], "left").select(*keys, "perturbation", "parameter", "sensitivity", "status")


def fold_forcing(forcing: DataFrame, folds: DataFrame, first_month: int = 1, gap_tolerant: bool = True) -> DataFrame:
    """The forcing once for each (site, fold), with ``held`` days' observation (and forcing, if gap tolerant) masked.

    The unmasked values stay as t_water_all, t_air_all and q_all."""
    years = forcing.withColumn("year", water_year(F.col("d"), first_month))
    ids = folds.select("site", "fold", "label").distinct()
    every = years.join(ids, "site")  # a row for each fold of a site
    held = folds.select("site", "fold", "year").withColumn("held", F.lit(True))
    out = every.join(held, ["site", "fold", "year"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    out = out.withColumns({"t_water_all": F.col("t_water"), "t_air_all": F.col("t_air"), "q_all": F.col("q")})
    masked = ("t_water", "t_air", "q") if gap_tolerant else ("t_water",)
    return out.withColumns({c: F.when(~F.col("held"), F.col(c)) for c in masked}).drop("year")


def fold_statistics(forcing: DataFrame, folds: DataFrame, first_month: int = 1) -> tuple[DataFrame, DataFrame]:
    """Moments (site, fold, qmedia, n_dat, mean_obs, tss_obs) and climatology (site, fold, doy0, t) of each fold's training
    days: those of all days less those of the held-out ones, so each day is aggregated twice, however many folds there are.

    Of two disjoint parts of a whole, the sums of squares about their means add up to the whole's but for the distance
    between the two means."""
    q = F.when(F.col("q") > 0, F.col("q"))
    sums = (F.count(q).alias("n_q"), F.coalesce(F.sum(q), F.lit(0.0)).alias("sum_q"), F.count("t_water").alias("n"), F.avg("t_water").alias("mean"), (F.var_pop("t_water") * F.count("t_water")).alias("tss"))
    held_days = forcing.withColumn("year", water_year(F.col("d"), first_month)).join(folds.select("site", "fold", "year"), ["site", "year"])
    held = held_days.groupBy("site", "fold").agg(*sums)
    both = folds.select("site", "fold").distinct().join(forcing.groupBy("site").agg(*sums), "site")
    held = held.select("site", "fold", *[F.col(c).alias(f"held_{c}") for c in ("n_q", "sum_q", "n", "mean", "tss")])
    both = both.join(held, ["site", "fold"], "left").fillna(0, ["held_n_q", "held_sum_q", "held_n", "held_mean", "held_tss"])
    n, c = F.col("n") - F.col("held_n"), F.col
    mean = F.try_divide(c("n") * c("mean") - c("held_n") * c("held_mean"), n)
    apart = F.try_divide(c("held_n") * n, c("n")) * F.pow(c("held_mean") - mean, F.lit(2))
    tss = F.when(n > 0, F.greatest(F.lit(0.0), c("tss") - c("held_tss") - F.coalesce(apart, F.lit(0.0))))
    qmean = F.try_divide(c("sum_q") - c("held_sum_q"), c("n_q") - c("held_n_q"))
    moments = both.select("site", "fold", qmean.alias("qmedia"), n.alias("n_dat"), mean.alias("mean_obs"), tss.alias("tss_obs"))
    day = prep.doy0(F.col("d")).alias("doy0")
    by_day = lambda df, *k: df.groupBy(*k, day).agg(F.count("t_water").alias("k"), F.sum("t_water").alias("s"))
    year = folds.select("site", "fold").distinct().join(by_day(forcing, "site"), "site")
    less = by_day(held_days, "site", "fold").select("site", "fold", "doy0", F.col("k").alias("held_k"), F.col("s").alias("held_s"))
    left = c("k") - F.coalesce("held_k", F.lit(0))
    means = year.join(less, ["site", "fold", "doy0"], "left").select("site", "fold", "doy0", F.try_divide(c("s") - F.coalesce("held_s", F.lit(0.0)), left).alias("t"))
    return moments, prep.filled_year(means, ("site", "fold"))


def cross_validate(forcing: DataFrame, folds: DataFrame, low: list[float], high: list[float], method: str = "DE", version: int = 8, integrator: str = "RK4", first_month: int = 1, min_days: int = 30, fixed: list[float] | None = None, resolution: str = "1d", prc: float = 1.0, score: str = "NSE", warmup_days: int = 15, ice: float = 0.0, qmedia: float | None = None, gap_tolerant: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(site, fold, label, n_obs, nse, kge, rmse, p) of each fold, and the held-out days (site, fold, d, obs, sim).

    A fold's flow mean, climatology and moments come from its training days, by subtraction; then all forcing is there
    again and the held-out days are scored. The forcing is copied for each fold only where its days are simulated. All
    folds of all sites are independent tasks; moments and best vectors are written, so that no search runs twice."""
    keys = ("site", "fold")
    moments, clim = (written(x, n) for x, n in zip(fold_statistics(forcing, folds, first_month), ("fold-moments", "fold-climatology")))
    masked = fold_forcing(forcing, folds, first_month, gap_tolerant)
    whole = None if gap_tolerant else sim.whole(masked, version, qmedia, keys, moments=moments)
    if fixed is None:
        days = sim.prepared(masked, version, min_days, warmup_days, qmedia, keys, moments, clim) if gap_tolerant else whole
        days = metrics.with_periods(days, masked, resolution, prc, keys)
        best = written(search.calibrate(days, method, low, high, version, integrator, score, ice, keys=keys, **options).select(*keys, "p"), "fold-best")
    else:
        best = moments.select(*keys).withColumn("p", F.array(*[F.lit(float(x)) for x in fixed]))
    if not gap_tolerant:  # the model runs through the held-out days
        tw = sim.simulate(sim.packed(whole, keys).join(best, list(keys)), None, version, integrator, ice, keys)
        held = masked.filter("held").select(*keys, "label", "d", F.col("t_water_all").alias("obs")).join(tw.select(*keys, "d", F.col("tw").alias("sim")), [*keys, "d"]).filter("obs IS NOT NULL")
        return metrics.fold_scores(held, ("site", "fold", "label")).join(best, list(keys)), held
    full = masked.select(*keys, "label", "d", "held", F.col("t_air_all").alias("t_air"), F.col("q_all").alias("q"), F.col("t_water").alias("t_water"), "t_water_all")
    days = sim.prepared(full, version, min_days, 0, qmedia, keys, moments, clim)
    rows = sim.packed(days, keys).join(best, list(keys))
    tw = sim.simulate(rows, None, version, integrator, ice, keys)
    held = days.filter("held").select(*keys, "label", "d", F.col("t_water_all").alias("obs")).join(tw.select(*keys, "d", F.col("tw").alias("sim")), [*keys, "d"]).filter("obs IS NOT NULL")
    scores = metrics.fold_scores(held, ("site", "fold", "label"))
    return scores.join(best, list(keys)), held


def walker_spread(best: DataFrame, n: int = 8) -> DataFrame:
    """Deviation of each parameter over a site's folds; 1e-4 where it can't be told."""
    long = best.select("site", F.posexplode("p").alias("k", "v")).groupBy("site", "k").agg(F.stddev_samp("v").alias("s"))
    s = F.when(F.col("s") > 0, F.col("s")).otherwise(1e-4)
    return long.select("site", (F.col("k") + 1).alias("parameter"), s.alias("spread"))
