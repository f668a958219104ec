"""Ensembles that stay in their tasks: percentiles of each day, rolling means before them, and paired differences.

A task gets a segment (or, where rolling means reach across segments, a series) with all vectors of its key. It simulates
a block of days at a time, each from the last row of the one before, and keeps no more than that block: out come one row
a day, or one row of sums for each pair of vectors. No member of an ensemble is ever shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import kernels
from fluvia.operators import simulate as sim

#: Vectors of a key that a task takes at most; larger ensembles are shuffled by day (``reports.envelope``).
MOST_VECTORS = 4096
#: Simulated values that a task holds at once: days times vectors.
BLOCK_VALUES = 1 << 21


def packed_series(days: DataFrame, keys: tuple[str, ...], whole: bool) -> DataFrame:
    """One row of arrays for each segment, or for each series with its segments behind each other."""
    each = F.sort_array(F.collect_list(F.struct("seg_id", "seg_day", "d", "t_air", "theta", "tt", "tw0")))
    rows = days.groupBy(*keys, *(() if whole else ("seg_id",))).agg(each.alias("x"))
    return rows.select(*keys, *[F.col(f"x.{c}").alias(c) for c in ("seg_id", "d", "t_air", "theta", "tt", "tw0")])


def percentiles(values: np.ndarray, at: tuple[float, ...]) -> np.ndarray:
    """[rows, quantiles] of values [rows, members], linearly interpolated; values that aren't numbers are the largest."""
    ordered, n = np.sort(values, axis=1), values.shape[1]
    out = np.empty((len(values), len(at)))
    for k, q in enumerate(at):
        place = q * (n - 1)
        low = int(np.floor(place))
        high = int(np.ceil(place))
        with np.errstate(all="ignore"):
            out[:, k] = ordered[:, low] if low == high else ordered[:, low] * (high - place) + ordered[:, high] * (place - low)
    return out


class Rolling:
    """Means of each member over a window of days that ends with each day; days without a value don't count."""

    def __init__(self, days: int):
        self.days, self.at, self.values = days, np.zeros(0, np.int64), None

    def __call__(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The means for values [days, members] of consecutive days with the numbers ``at``, later than those before."""
        near = self.at > at[0] - self.days
        before = np.zeros((self.days - 1, values.shape[1]))
        there = np.zeros(self.days - 1)
        if near.any():
            place = self.at[near] - (at[0] - self.days + 1)
            before[place], there[place] = self.values[near], 1
        full = np.concatenate((np.zeros((1, values.shape[1])), before, values))
        total = np.cumsum(full, axis=0)
        count = np.cumsum(np.concatenate(([0], there, np.ones(len(at)))))
        n = len(at)
        kept = values[:0] if self.values is None else self.values[near]
        self.at, self.values = np.concatenate((self.at[near], at))[1 - self.days :], np.concatenate((kept, values))[1 - self.days :]
        return (total[self.days : self.days + n] - total[:n]) / (count[self.days : self.days + n] - count[:n])[:, None]


def blocks_of(r, vectors: np.ndarray, ids: np.ndarray, version: int, integrator: str, ice: float, series: tuple, seed: int, most: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, values [days, vectors]) of a packed row, with the noise of its sigma and rho, block by block.

    Draws depend on the series, the segment and the vector alone."""
    seg = np.asarray(r.seg_id)
    cuts = [*np.flatnonzero(np.diff(seg, prepend=seg[0] - 1)).tolist(), len(seg)]
    step = max(2, most // len(vectors))
    sigma, rho = getattr(r, "sigma", None), getattr(r, "rho", None) or 0.0
    for a, b in zip(cuts, cuts[1:]):
        name = zlib.crc32(repr([*series, seg[a].item()]).encode())
        draws = [np.random.default_rng((seed, name, int(i))) for i in ids] if sigma else []
        last = noise = None
        for low in range(a, b, step):
            high, lead = min(b, low + step), max(a, low - 1)
            start = r.tw0[a] if last is None else last[None]
            tw = kernels.simulate(version, integrator, vectors, r.t_air[lead:high], r.theta[lead:high], r.tt[lead:high], start, ice)[low - lead :]
            last = tw[-1].copy()
            if sigma:
                noise = kernels.ar1(np.column_stack([g.standard_normal(high - low) for g in draws]), sigma, rho, None if noise is None else noise[-1])
                tw = tw + noise
            yield low, high, tw


def _quantiles(batches: Iterator[pd.DataFrame], version: int, integrator: str, ice: float, keys: tuple[str, ...], seed: int, at: tuple[float, ...], rolling: int, most: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids, vectors = np.array([x["param_id"] for x in r.batch]), np.array([list(x["p"]) for x in r.batch], float)
            once = {k: getattr(r, k) for k in keys}
            mean = Rolling(rolling) if rolling > 1 else None
            for low, high, tw in blocks_of(r, vectors, ids, version, integrator, ice, tuple(once.values()), seed, most):
                days = r.d[low:high]
                if mean:
                    tw = mean(np.array([x.toordinal() for x in days]), tw)
                q = percentiles(tw, at)
                yield pd.DataFrame(once | {"d": list(days), "lower": q[:, 0], "p50": q[:, 1], "upper": q[:, 2]})


def daily_percentiles(days: DataFrame, params: DataFrame, version: int = 8, integrator: str = "RK4", ice: float = 0.0, interval: float = 90.0, noise: DataFrame | None = None, seed: int = 0, rolling: int = 1, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, d, lower, p50, upper): exact percentiles of each day over the vectors params (param_id, p, and keys if each
    has its own), of which a key has MOST_VECTORS at most; ``noise`` (keys, sigma, rho) adds noise to each series.

    With ``rolling`` days, each member is averaged over so many calendar days up to each one before its percentiles."""
    if not 0 < interval < 100:
        raise ValueError("the prediction interval lies between 0 and 100, both excluded")
    tail = (100 - interval) / 200
    own = [k for k in keys if k in params.columns]
    batch = params.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("param_id", "p"))).alias("batch"))
    rows = packed_series(days, keys, rolling > 1)
    rows = rows.join(batch, own) if own else rows.crossJoin(F.broadcast(batch))  # one row of bounded size
    if noise is not None:
        rows = rows.join(noise.select(*keys, "sigma", "rho"), list(keys))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    run = partial(_quantiles, version=version, integrator=integrator, ice=ice, keys=keys, seed=seed, at=(tail, 0.5, 1 - tail), rolling=rolling, most=BLOCK_VALUES)
    return rows.mapInPandas(run, f"{kinds}, d date, lower double, p50 double, upper double")


def _differences(batches: Iterator[pd.DataFrame], version: int, integrator: str, ice: float, keys: tuple[str, ...], most: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            pairs = np.array([(list(x["down"]), list(x["up"])) for x in r.batch], float)
            use = np.asarray(r.in_eval, bool) & ~np.isnan(np.asarray(r.obs, float))
            tw = kernels.simulate(version, integrator, pairs.reshape(-1, pairs.shape[2]), r.t_air, r.theta, r.tt, r.tw0, ice)[use].reshape(-1, len(pairs), 2)
            ok = (tw < most).all(2)
            with np.errstate(all="ignore"):
                change = np.where(ok, np.abs(tw[:, :, 1] - tw[:, :, 0]), 0.0).sum(0)
            yield pd.DataFrame({k: getattr(r, k) for k in keys} | {"run": [x["run"] for x in r.batch], "n": ok.sum(0), "change": change})


def paired_differences(days: DataFrame, pairs: DataFrame, version: int = 8, integrator: str = "RK4", ice: float = 0.0, most: float = 50.0, keys: tuple[str, ...] = ("site",), batch: int = 64) -> DataFrame:
    """(keys, run, n, change): for each pair of vectors (keys, run, down, up) the number of evaluated days with an
    observation on which both simulations are below ``most``, and the sum of their absolute differences there.

    Both vectors of a pair run in one batch of a task, which returns the two sums of a segment."""
    batches = pairs.groupBy(*keys, F.floor(F.col("run") / batch).alias("b")).agg(F.sort_array(F.collect_list(F.struct("run", "down", "up"))).alias("batch")).drop("b")
    rows = sim.packed(days, keys).join(batches, list(keys))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    sums = rows.mapInPandas(partial(_differences, version=version, integrator=integrator, ice=ice, keys=keys, most=most), f"{kinds}, run long, n long, change double")
    return sums.groupBy(*keys, "run").agg(F.sum("n").alias("n"), F.sum("change").alias("change"))
