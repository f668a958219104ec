"""Simulation of daily series: one kernel call for each segment, or for each segment and batch of parameter vectors.

A series is packed into one row of arrays for each (site, segment), which is what the ordered recurrence needs as a
whole; a decade of days is some 100 KB. Segments, sites, folds and batches of parameters are separate tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fluvia.functions import kernels
from fluvia.functions.dates import year_fraction
from fluvia.operators import prep

BATCH = 256


def with_moments(df: DataFrame, obs: Column, flow: Column, qmedia: float | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """df with the mean flow and the number, mean and total sum of squares of all observations of its key, by windows."""
    w = Window.partitionBy(*keys)
    mean = F.avg(F.when(flow > 0, flow)).over(w) if qmedia is None else F.lit(float(qmedia))
    return df.withColumns({"qmedia": mean, "n_dat": F.count(obs).over(w), "mean_obs": F.avg(obs).over(w), "tss_obs": F.var_pop(obs).over(w) * F.count(obs).over(w)})


def _moments_joined(df: DataFrame, moments: DataFrame, qmedia: float | None, keys: tuple[str, ...]) -> DataFrame:
    flow = F.col("qmedia") if qmedia is None else F.lit(float(qmedia))
    return df.join(moments.select(*keys, flow.alias("qmedia"), "n_dat", "mean_obs", "tss_obs"), list(keys))


def prepared(forcing: DataFrame, version: int = 8, min_days: int = 30, warmup_days: int = 15, qmedia: float | None = None, keys: tuple[str, ...] = ("site",), moments: DataFrame | None = None, clim: DataFrame | None = None) -> DataFrame:
    """Days of long enough segments with flow ratio, year fraction, the segment's start value, and the moments of all
    observations, in segments or not. Segments, flow mean and moments come from windows over one exchange; give a
    written table, as climatology reads it once more. Given moments (keys, qmedia, n_dat, mean_obs, tss_obs) and a given
    climatology (keys, doy0, t) are joined instead."""
    given = with_moments(forcing, F.col("t_water"), F.col("q"), qmedia, keys) if moments is None else forcing
    seg = prep.with_segments(given, version, min_days, warmup_days, keys).filter("seg_id IS NOT NULL")
    seg = seg if moments is None else _moments_joined(seg, moments, qmedia, keys)
    starts = prep.start_values(seg, prep.climatology(forcing, keys) if clim is None else clim, keys)
    theta = F.col("q") / F.col("qmedia") if version in kernels.NEEDS_FLOW else F.lit(1.0)
    return seg.join(starts, [*keys, "seg_id"]).withColumn("theta", theta).withColumn("tt", year_fraction(F.col("d")))


def whole(forcing: DataFrame, version: int = 8, qmedia: float | None = None, keys: tuple[str, ...] = ("site",), flow: str = "q", moments: DataFrame | None = None) -> DataFrame:
    """The series with its warm-up year as one segment, from the first observation or 4; evaluation starts after it.
    The mean flow is that of the column ``flow``; given moments are joined instead."""
    warm = prep.with_warmup(forcing, keys)
    real = lambda c: F.when(~F.col("is_warmup"), F.col(c))
    out = with_moments(warm, real("t_water"), real(flow), qmedia, keys) if moments is None else _moments_joined(warm, moments, qmedia, keys)
    first = F.coalesce(F.max(F.when(F.col("idx") == 0, F.col("t_water"))).over(Window.partitionBy(*keys)), F.lit(4.0))
    theta = F.col("q") / F.col("qmedia") if version in kernels.NEEDS_FLOW else F.lit(1.0)
    return out.withColumns({"tw0": first, "theta": theta, "seg_id": F.lit(1).cast("long"), "seg_day": F.col("idx") + 1, "in_eval": ~F.col("is_warmup")})


def packed(days: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row of arrays for each segment, in day order. ``period``, where there is one, is the day's observed period."""
    arrays = ["d", "t_air", "theta", "tt", "obs", "in_eval", *(c for c in ("period",) if c in days.columns)]
    each = F.sort_array(F.collect_list(F.struct("seg_day", *[F.coalesce("t_water", F.lit(float("nan"))).alias("obs") if c == "obs" else c for c in arrays])))
    once = [c for c in ("tw0", "n_dat", "mean_obs", "tss_obs") if c in days.columns]
    rows = days.groupBy(*keys, "seg_id").agg(each.alias("x"), *[F.min(c).alias(c) for c in once])
    return rows.select(*keys, "seg_id", *once, *[F.col(f"x.{c}").alias(c) for c in arrays])


def _rows(batches: Iterator[pd.DataFrame], p: list[float] | None, version: int, integrator: str, ice: float, keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            vector = np.asarray(r.p if p is None else p, float)
            tw = kernels.simulate(version, integrator, vector[None], r.t_air, r.theta, r.tt, r.tw0, ice)[:, 0]
            out = {k: getattr(r, k) for k in keys} | {"seg_id": r.seg_id, "seg_day": np.arange(1, len(tw) + 1, dtype=np.int64), "d": list(r.d), "tw": tw}
            yield pd.DataFrame(out)


def simulate(days: DataFrame, p: list[float] | None, version: int = 8, integrator: str = "RK4", ice: float = 0.0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, seg_id, seg_day, d, tw); p is one vector for all, or None where the packed rows get a column p."""
    rows = days if isinstance(days.schema["d"].dataType, ArrayType) else packed(days, keys)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.mapInPandas(partial(_rows, p=p, version=version, integrator=integrator, ice=ice, keys=keys), f"{kinds}, seg_id long, seg_day long, d date, tw double")


def with_batches(rows: DataFrame, params: DataFrame, size: int, keys: tuple[str, ...]) -> DataFrame:
    """Each row with batches of up to ``size`` vectors: of its own key, if params has keys, or of all params (param_id, p)."""
    own = [k for k in keys if k in params.columns]
    batches = params.groupBy(*own, F.floor(F.col("param_id") / size).alias("b")).agg(F.sort_array(F.collect_list(F.struct("param_id", "p"))).alias("batch")).drop("b")
    return rows.join(batches, own) if own else rows.crossJoin(batches)


def _ensemble(batches: Iterator[pd.DataFrame], version: int, integrator: str, ice: float, keys: tuple[str, ...], seed: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids, vectors = np.array([x["param_id"] for x in r.batch]), np.array([list(x["p"]) for x in r.batch], float)
            tw = kernels.simulate(version, integrator, vectors, r.t_air, r.theta, r.tt, r.tw0, ice)
            n, m = tw.shape
            if sigma := getattr(r, "sigma", None):  # draws depend on the series and the vector, not on the task
                series = zlib.crc32(repr([getattr(r, k) for k in (*keys, "seg_id")]).encode())
                z = np.column_stack([np.random.default_rng((seed, series, int(i))).standard_normal(n) for i in ids])
                tw = tw + kernels.ar1(z, sigma, getattr(r, "rho", None) or 0.0)
            once = {"param_id": np.repeat(ids, n)} | {k: getattr(r, k) for k in keys}
            yield pd.DataFrame(once | {"seg_id": r.seg_id, "seg_day": np.tile(np.arange(1, n + 1, dtype=np.int64), m), "d": np.tile(np.asarray(r.d, object), m), "tw": tw.T.reshape(-1)})


def simulate_many(days: DataFrame, params: DataFrame, version: int = 8, integrator: str = "RK4", ice: float = 0.0, keys: tuple[str, ...] = ("site",), batch: int = 32, noise: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The long ensemble (param_id, keys, seg_id, seg_day, d, tw) of params (param_id, p, and keys if each has its own):
    a task gets a segment and a batch of vectors. ``noise`` (keys, sigma, rho) adds noise to each series."""
    rows = with_batches(packed(days, keys), params, batch, keys)
    if noise is not None:
        rows = rows.join(noise.select(*keys, "sigma", "rho"), list(keys))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.mapInPandas(partial(_ensemble, version=version, integrator=integrator, ice=ice, keys=keys, seed=seed), f"param_id long, {kinds}, seg_id long, seg_day long, d date, tw double")


SUMS = "n long, sum_s double, sum_s2 double, sum_e2 double, sum_ae double, sum_so double, sum_o double, sum_o2 double"


def batch_sums(vectors: np.ndarray, r, version: int, integrator: str, ice: float) -> np.ndarray:
    """[vectors, 8]: the sums of a segment that every metric needs, over evaluated days with an observation; values
    are taken from the observed mean, so that variances don't come from differences of large sums."""
    tw = kernels.simulate(version, integrator, vectors, r.t_air, r.theta, r.tt, r.tw0, ice)
    obs = np.asarray(r.obs, float)
    use = np.asarray(r.in_eval, bool) & ~np.isnan(obs)
    with np.errstate(all="ignore"):
        s, o = tw[use] - r.mean_obs, (obs[use] - r.mean_obs)[:, None]
        e = s - o
        sums = [np.full(len(vectors), float(use.sum())), s.sum(0), (s * s).sum(0), (e * e).sum(0), np.abs(e).sum(0), (s * o).sum(0), np.full(len(vectors), o.sum()), np.full(len(vectors), (o * o).sum())]
    return np.array(sums).T


def _score(batches: Iterator[pd.DataFrame], version: int, integrator: str, ice: float, keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids, vectors = np.array([x["param_id"] for x in r.batch]), np.array([list(x["p"]) for x in r.batch], float)
            sums = batch_sums(vectors, r, version, integrator, ice)
            out = pd.DataFrame(sums, columns=[x.split()[0] for x in SUMS.split(", ")])
            out["n"] = out["n"].astype(np.int64)
            out.insert(0, "param_id", ids)
            for k in reversed((*keys, "n_dat", "mean_obs", "tss_obs")):
                out.insert(0, k, getattr(r, k))
            yield out


def score_many(days: DataFrame, params: DataFrame, version: int = 8, integrator: str = "RK4", ice: float = 0.0, keys: tuple[str, ...] = ("site",), batch: int = BATCH) -> DataFrame:
    """NSE, R2, MAE, KGE and negative RMS error (keys, param_id) of many parameter vectors on daily observations.

    Vectors go through the kernel in batches; only sums of each segment come out and are added up. Observed moments
    are those of all observed days, in segments or not.
    """
    rows = packed(days, keys)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    moments = ("n_dat", "mean_obs", "tss_obs")
    sums = with_batches(rows, params, batch, keys).mapInPandas(partial(_score, version=version, integrator=integrator, ice=ice, keys=keys), f"{kinds}, n_dat long, mean_obs double, tss_obs double, param_id long, {SUMS}")
    sums = sums.groupBy(*keys, "param_id").agg(*[F.min(c).alias(c) for c in moments], *[F.sum(x.split()[0]).alias(x.split()[0]) for x in SUMS.split(", ")]).filter("n > 0")
    c, square = F.col, lambda x: F.pow(x - 1, F.lit(2))
    cov, var_s = c("sum_so") - c("sum_s") * c("sum_o") / c("n"), c("sum_s2") - c("sum_s") * c("sum_s") / c("n")
    std_s, std_o = F.sqrt(var_s / (c("n") - 1)), F.sqrt(c("tss_obs") / (c("n_dat") - 1))
    kge = 1 - F.sqrt(square(std_s / std_o) + square((c("mean_obs") + c("sum_s") / c("n")) / c("mean_obs")) + square(cov / (c("n") - 1) / (std_s * std_o)))
    ok = ~(F.isnan("sum_e2") | (F.abs("sum_e2") == float("inf")))
    found = {
        "nse": F.when(c("tss_obs") == 0, F.when(c("sum_e2") == 0, 1.0).otherwise(-1e30)).otherwise(1 - F.try_divide("sum_e2", "tss_obs")),
        "r2": F.when((c("tss_obs") == 0) | (var_s <= 0), -999.0).otherwise(F.try_divide(F.pow(cov, F.lit(2)), var_s * c("tss_obs"))),
        "mae": c("sum_ae") / c("n"),
        "kge": F.when((c("n") < 2) | (var_s <= 0) | (c("tss_obs") == 0), -999.0).otherwise(kge),
        "rms": -F.sqrt(c("sum_e2") / c("n")),
    }
    return sums.select(*keys, "param_id", "n", *[F.when(ok, x).alias(name) for name, x in found.items()])


def best(scored: DataFrame, score: str = "nse", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The best valid vector of each key; ties go to the smallest param_id."""
    top = F.max_by("param_id", F.struct(F.col(score), -F.col("param_id")))
    return scored.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys).agg(top.alias("param_id"), F.max(score).alias(score))


def rate(version: int, p: list[float], ta: Column, theta: Column, t: Column, tw: Column) -> Column:
    """The model's rate of change as an expression; parameters that the version hasn't are zero."""
    q = [float(x) if k in kernels.ACTIVE[version] else 0.0 for k, x in enumerate(p)]
    season = q[5] * F.cos(2 * F.pi() * (t - q[6]))
    out = q[0] + q[1] * ta - q[2] * tw
    if version == 5:
        out = out + season
    if version in (7, 8):
        out = out + theta * (q[4] + season - q[7] * tw)
    return out / F.pow(theta, F.lit(q[3])) if version in (4, 8) else out


def rates(df: DataFrame, p: list[float], version: int = 8, tw: str = "tw", name: str = "rate") -> DataFrame:
    """df (t_air, theta, tt, tw) with the model's rate of change at each row."""
    out = rate(version, p, *(F.col(c).cast("double") for c in ("t_air", "theta", "tt", tw)))
    return df.withColumn(name, F.nullif(out, F.lit(float("nan"))))


def series(forcing: DataFrame, simulated: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The output series: forcing with simulated temperature and gap flags, null outside of segments."""
    sim = simulated.select(*keys, "d", "seg_id", "seg_day", F.col("tw").alias("t_water_sim"))
    out = prep.gap_flags(forcing).join(sim, [*keys, "d"], "left")
    return out.withColumns({"year": F.year("d"), "month": F.month("d"), "day": F.dayofmonth("d")})
