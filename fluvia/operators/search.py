"""Optimizers and samplers in numpy over a batched objective, and their runs for many sites.

Every method calls ``objective(vectors [n, dims]) -> scores [n]`` (larger is better, nan: invalid) with whole
populations. ``history`` has all evaluations of a search of each site, or site and fold; ``calibrate`` the best.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvia.functions import kernels
from fluvia.operators import simulate as sim

Objective = Callable[[np.ndarray], np.ndarray]
BAD = -1e30


@dataclass
class Found:
    best: np.ndarray
    score: float
    history: np.ndarray  # rows of vector and score, in order of evaluation


def _evaluated(objective: Objective, x: np.ndarray) -> np.ndarray:
    y = np.asarray(objective(x), float)
    return np.where(np.isfinite(y), y, BAD)


def _found(history: list[tuple[np.ndarray, np.ndarray]]) -> Found:
    x, y = np.vstack([a for a, _ in history]), np.concatenate([b for _, b in history])
    k = int(np.argmax(y))
    if y[k] <= BAD:
        raise ValueError("no parameter vector gave a valid score")
    return Found(x[k], float(y[k]), np.column_stack([x, y]))


def latin_hypercube(low: np.ndarray, high: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    cells = np.column_stack([rng.permutation(n) for _ in low])
    return low + (cells + rng.random(cells.shape)) / n * (high - low)


def lathyp(objective: Objective, low, high, n: int = 500, seed: int = 0) -> Found:
    x = latin_hypercube(low, high, n, np.random.default_rng(seed))
    return _found([(x, _evaluated(objective, x))])


def pso(objective: Objective, low, high, particles: int = 50, iterations: int = 100, c1=2.0, c2=2.0, w_max=0.9, w_min=0.4, seed: int = 0) -> Found:
    """Particle swarm with falling inertia and absorbing walls: a particle that leaves stops there, unscored."""
    rng, span = np.random.default_rng(seed), np.where(high > low, high - low, 1.0)
    x = low + rng.random((particles, len(low))) * (high - low)
    v = rng.random(x.shape) * (high - low)
    y = _evaluated(objective, x)
    own, own_y, history = x.copy(), y.copy(), [(x.copy(), y)]
    for k in range(iterations):
        lead = own[np.argmax(own_y)]
        w = w_max - (w_max - w_min) * k / max(1, iterations - 1)
        v = w * v + c1 * rng.random(x.shape) * (own - x) + c2 * rng.random(x.shape) * (lead - x)
        x = x + v
        out = ((x < low) | (x > high)).any(1)
        v = np.where((x < low) | (x > high), 0, v)
        x = np.clip(x, low, high)
        y = np.full(particles, BAD)
        if (~out).any():
            y[~out] = _evaluated(objective, x[~out])
            history.append((x[~out], y[~out]))
        better = y > own_y
        own[better], own_y[better] = x[better], y[better]
        near = np.sqrt((((own - own[np.argmax(own_y)]) / span) ** 2).sum(1)) < 1e-4
        if near.mean() >= 0.9:
            break
    return _found(history)


def differential_evolution(objective: Objective, low, high, members: int = 10, generations: int = 100, crossover=0.7, tol=0.01, seed: int = 0) -> Found:
    """Best/1/bin with a mutation dithered in (0.5, 1), a generation at a time."""
    rng, dims = np.random.default_rng(seed), len(low)
    free = np.flatnonzero(high > low)
    n = max(5, members * max(1, len(free)))
    x = latin_hypercube(low, high, n, rng)
    y = _evaluated(objective, x)
    history = [(x.copy(), y.copy())]
    for _ in range(generations):
        f = rng.uniform(0.5, 1)
        one, two = rng.integers(1, n, n), rng.integers(1, n - 1, n)
        two += two >= one  # members, as steps from each one, that differ from it and from each other
        a, b = (np.arange(n) + one) % n, (np.arange(n) + two) % n
        trial = x[np.argmax(y)] + f * (x[a] - x[b])
        cross = rng.random((n, dims)) < crossover
        cross[np.arange(n), rng.integers(0, dims, n)] = True
        trial = np.where(cross, trial, x)
        wild = (trial < low) | (trial > high)
        trial = np.where(wild, low + rng.random(trial.shape) * (high - low), trial)
        t = _evaluated(objective, trial)
        history.append((trial, t))
        better = t >= y
        x[better], y[better] = trial[better], t[better]
        valid = y[y > BAD]
        if len(valid) == n and np.std(-valid) <= tol * abs(np.mean(valid)):
            break
    return _found(history)


def polish(objective: Objective, low, high, start: np.ndarray, iterations: int = 60) -> Found:
    """Bounded quasi-Newton ascent (BFGS on the free, unbound coordinates); differences and line steps are batches."""
    span = high - low
    free = np.flatnonzero(span > 0)
    x = np.clip(start, low, high)
    y = float(_evaluated(objective, x[None])[0])
    history = [(x[None].copy(), np.array([y]))]
    h, last = np.eye(len(free)), None
    for _ in range(iterations):
        step = 1e-6
        points = np.repeat(x[None], 2 * len(free), 0)
        for k, i in enumerate(free):
            points[2 * k, i] = min(x[i] + step * span[i], high[i])
            points[2 * k + 1, i] = max(x[i] - step * span[i], low[i])
        values = _evaluated(objective, points)
        width = (points[0::2, free].diagonal() - points[1::2, free].diagonal()) / span[free]
        g = (values[0::2] - values[1::2]) / width
        if last is not None:
            s, t = (x[free] - last[0]) / span[free], last[1] - g  # of -score, the function that falls
            if s @ t > 1e-12:
                rho = 1 / (s @ t)
                v = np.eye(len(free)) - rho * np.outer(s, t)
                h = v @ h @ v.T + rho * np.outer(s, s)
        held = ((x[free] <= low[free]) & (g < 0)) | ((x[free] >= high[free]) & (g > 0))
        d = np.where(held, 0, h @ np.where(held, 0, g))
        if d @ g <= 0:
            h, d = np.eye(len(free)), np.where(held, 0, g)
        sizes = 2.0 ** -np.arange(0, 24)
        trial = np.repeat(x[None], len(sizes), 0)
        trial[:, free] = np.clip(x[free] + sizes[:, None] * d * span[free], low[free], high[free])
        t = _evaluated(objective, trial)
        history.append((trial, t))
        k = int(np.argmax(t))
        if t[k] <= y + 1e-12:
            break
        last = (x[free].copy(), g)
        x, y = trial[k], float(t[k])
    return _found(history)


def de_polished(objective: Objective, low, high, seed: int = 0, **options) -> Found:
    a = differential_evolution(objective, low, high, seed=seed, **options)
    b = polish(objective, low, high, a.best)
    best = b if b.score >= a.score else a
    return Found(best.best, best.score, np.vstack([a.history, b.history]))


@dataclass
class Chain:
    samples: np.ndarray  # [steps, walkers, dims]
    acceptance: float
    tau: np.ndarray

    def flat(self, burn: float = 0.3) -> np.ndarray:
        return self.samples[int(burn * len(self.samples)) :].reshape(-1, self.samples.shape[2])


def autocorrelation_time(x: np.ndarray, c: float = 5.0) -> float:
    """Integrated autocorrelation time of walkers' series [steps, walkers], by the window that first exceeds c times it."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(0), size, axis=0)
    acf = np.fft.irfft(f * np.conj(f), size, axis=0)[:n].mean(1)
    if acf[0] <= 0:
        return float("nan")
    tau = 2 * np.cumsum(acf / acf[0]) - 1
    window = np.flatnonzero(np.arange(n) >= c * tau)
    return float(tau[window[0] if len(window) else n - 1])


def stretch_sampler(log_p: Objective, start: np.ndarray, steps: int, seed: int = 0, a: float = 2.0) -> Chain:
    """Affine-invariant ensemble: each half of the walkers moves in one batch along lines to the other half."""
    walkers, dims = start.shape
    if walkers < 2 * dims:
        raise ValueError(f"{walkers} walkers for {dims} dimensions: at least twice as many are needed")
    rng, x = np.random.default_rng(seed), start.copy()
    y = np.asarray(log_p(x), float)
    samples, accepted = np.empty((steps, walkers, dims)), 0
    halves = np.arange(walkers) < walkers // 2
    for k in range(steps):
        for side in (halves, ~halves):
            mine, others = np.flatnonzero(side), np.flatnonzero(~side)
            z = ((a - 1) * rng.random(len(mine)) + 1) ** 2 / a
            pivot = x[rng.choice(others, len(mine))]
            new = pivot + z[:, None] * (x[mine] - pivot)
            t = np.asarray(log_p(new), float)
            t = np.where(np.isnan(t), -np.inf, t)
            with np.errstate(invalid="ignore"):
                take = np.log(rng.random(len(mine))) < (dims - 1) * np.log(z) + t - y[mine]
            x[mine[take]], y[mine[take]] = new[take], t[take]
            accepted += int(take.sum())
        samples[k] = x
    return Chain(samples, accepted / (steps * walkers), np.array([autocorrelation_time(samples[:, :, i]) for i in range(dims)]))


METHODS = {"LATHYP": lathyp, "PSO": pso, "DE": de_polished}
METRICS = ("nse", "r2", "mae", "kge", "rms")


@dataclass
class Series:
    """The segments of one key behind each other, and what the metrics need: the evaluated days with an observation,
    the period of each (or the day itself), the periods' observed means, and the moments of all observed periods."""

    t_air: np.ndarray
    theta: np.ndarray
    tt: np.ndarray
    begin: np.ndarray
    start: np.ndarray
    used: np.ndarray  # positions of days
    period_begin: np.ndarray  # positions in used
    obs: np.ndarray  # of each period that has a used day
    n_dat: int
    mean_obs: float
    tss_obs: float

    @staticmethod
    def of(group: pd.DataFrame) -> Series:
        rows = sorted(group.itertuples(index=False), key=lambda r: r.seg_id)
        t_air, theta, tt, obs = (np.concatenate([np.asarray(getattr(r, c), float) for r in rows]) for c in ("t_air", "theta", "tt", "obs"))
        size = [len(r.obs) for r in rows]
        used = np.concatenate([np.asarray(r.in_eval, bool) for r in rows]) & ~np.isnan(obs)
        if hasattr(rows[0], "period"):
            period = np.concatenate([np.array([(x["p"].toordinal(), x["obs"]) if x is not None else (-1, np.nan) for x in r.period], float).reshape(-1, 2) for r in rows])
            used = np.flatnonzero(used & (period[:, 0] >= 0))
            begin = np.flatnonzero(np.diff(period[used, 0], prepend=-2))
            obs = period[used, 1][begin]
        else:
            used = np.flatnonzero(used)
            begin, obs = np.arange(len(used)), obs[used]
        r = rows[0]
        return Series(t_air, theta, tt, np.concatenate(([0], np.cumsum(size)[:-1])), np.array([r.tw0 for r in rows], float), used, begin, obs, int(r.n_dat), float(r.mean_obs or 0), float(r.tss_obs or 0))

    def simulated(self, vectors: np.ndarray, version: int, integrator: str, ice: float) -> np.ndarray:
        """[periods, vectors]"""
        tw = kernels.simulate(version, integrator, vectors, self.t_air, self.theta, self.tt, self.start, ice, self.begin)[self.used]
        if len(self.period_begin) == len(self.used):
            return tw
        with np.errstate(all="ignore"):
            return np.add.reduceat(tw, self.period_begin, axis=0) / np.diff(np.append(self.period_begin, len(self.used)))[:, None]

    def metrics(self, vectors: np.ndarray, version: int, integrator: str, ice: float) -> np.ndarray:
        """[vectors, 6]: NSE, R2, MAE, KGE, negative RMS error, SSE; nan for what isn't valid."""
        n, o = len(self.obs), (self.obs - self.mean_obs)[:, None]
        with np.errstate(all="ignore"):
            s = self.simulated(vectors, version, integrator, ice) - self.mean_obs
            e, mean = s - o, s.mean(0)
            sse, tss_s, cov = (e * e).sum(0), ((s - mean) ** 2).sum(0), ((s - mean) * o).sum(0)
            nse = 1 - sse / self.tss_obs if self.tss_obs else np.where(sse == 0, 1.0, BAD)
            r2 = np.where(tss_s * self.tss_obs > 0, cov * cov / (tss_s * self.tss_obs), -999.0)
            std_s, std_o = np.sqrt(tss_s / (n - 1)), np.sqrt(self.tss_obs / (self.n_dat - 1))
            kge = 1 - np.sqrt((std_s / std_o - 1) ** 2 + ((mean + self.mean_obs) / self.mean_obs - 1) ** 2 + (cov / (n - 1) / (std_s * std_o) - 1) ** 2)
            kge = np.where((n > 1) & (std_s > 0) & (std_o > 0), kge, np.where(np.isfinite(sse), -999.0, np.nan))
            out = np.column_stack([nse, r2, np.abs(e).mean(0), kge, -np.sqrt(sse / n), sse])
        out[~np.isfinite(sse)] = np.nan
        return out


def _searched(group: pd.DataFrame, method: str, low, high, version: int, integrator: str, score: str, ice: float, options: dict, keys: tuple[str, ...]) -> pd.DataFrame:
    """All evaluations of one key, in order."""
    series = Series.of(group)
    low, high = (kernels.active_only(np.asarray(x, float)[None], version)[0] for x in (low, high))
    column, vectors, found = METRICS.index(score.lower()), [], []

    def objective(x: np.ndarray) -> np.ndarray:
        found.append(series.metrics(x, version, integrator, ice))
        vectors.append(np.array(x))
        return found[-1][:, column]

    if len(series.obs):
        METHODS[method](objective, low, high, **options)
    x, y = (np.vstack(v) if v else np.zeros((0, 8)) for v in (vectors, found))
    once = {k: group[k].iloc[0] for k in keys}
    return pd.DataFrame(once | {"eval": np.arange(len(x)), "p": pd.Series(list(x), dtype=object), "eff_index": y[:, column]} | {m: y[:, i] for i, m in enumerate(METRICS)}, index=range(len(x)))


def history(days: DataFrame, method: str, low, high, version: int = 8, integrator: str = "RK4", score: str = "NSE", ice: float = 0.0, keys: tuple[str, ...] = ("site",), **options) -> DataFrame:
    """(keys, eval, p, eff_index, nse, r2, mae, kge, rms) of every evaluation of a search; null where a vector isn't valid.

    A swarm or an evolution runs whole in a task for each key, as each generation needs the one before it. A daily Latin
    hypercube has no such order: its vectors are a table that is scored in batches, for all keys in one job."""
    if method not in METHODS:
        raise ValueError(f"method {method}: one of {sorted(METHODS)}")
    if method == "LATHYP" and "period" not in days.columns:
        lo, hi = (kernels.active_only(np.asarray(x, float)[None], version)[0] for x in (low, high))
        x = latin_hypercube(lo, hi, options.get("n", 500), np.random.default_rng(options.get("seed", 0)))
        design = days.sparkSession.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "param_id long, p array<double>")
        scored = sim.score_many(days, design, version, integrator, ice, keys).join(design, "param_id")
        return scored.select(*keys, F.col("param_id").alias("eval"), "p", F.col(score.lower()).alias("eff_index"), *METRICS)
    rows = sim.packed(days, keys)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _searched(group, method, low, high, version, integrator, score, ice, options, keys)

    found = rows.groupBy(*keys).applyInPandas(run, f"{kinds}, eval long, p array<double>, eff_index double, {', '.join(f'{m} double' for m in METRICS)}")
    return found.select(*keys, "eval", "p", *[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) for c in ("eff_index", *METRICS)])


def best_of(found: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, p, score, n_evaluated): the best valid evaluation of each key; of equal ones, the first."""
    valid = F.col("eff_index").isNotNull()
    out = found.groupBy(*keys).agg(F.max_by(F.when(valid, F.col("p")), F.when(valid, F.struct("eff_index", -F.col("eval")))).alias("p"), F.max("eff_index").alias("score"), F.count(F.lit(1)).alias("n_evaluated"))
    return out.filter("score IS NOT NULL")


def calibrate(days: DataFrame, method: str, low, high, version: int = 8, integrator: str = "RK4", score: str = "NSE", ice: float = 0.0, keys: tuple[str, ...] = ("site",), **options) -> DataFrame:
    """(keys, p, score, n_evaluated): the best vector of a complete search for each key."""
    return best_of(history(days, method, low, high, version, integrator, score, ice, keys, **options), keys)


def posterior(days: DataFrame, best: DataFrame, low, high, version: int = 8, integrator: str = "RK4", spread: float = 1e-4, walkers: int = 32, steps: int = 200, burn: float = 0.3, seed: int = 0, ice: float = 0.0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, sample_id, p, acceptance, tau, sse, n): the flattened chains around the best vectors (keys, p).

    Walkers start around the best vector with the deviation ``spread`` times each parameter's range, or with those of
    a column ``spread`` of best, an array like p. sse and n are the best vector's."""
    more = ["spread"] if "spread" in best.columns else []
    rows = sim.packed(days, keys).join(best.select(*keys, F.col("p").alias("best"), *more), list(keys))
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    lo, hi = (kernels.active_only(np.asarray(x, float)[None], version)[0] for x in (low, high))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        series, active = Series.of(group), np.flatnonzero(hi > lo)
        start, n = np.asarray(group["best"].iloc[0], float), len(series.obs)
        sse = lambda x: series.metrics(x, version, integrator, ice)[:, -1]

        def log_p(x: np.ndarray) -> np.ndarray:
            full = np.repeat(start[None], len(x), 0)
            full[:, active] = x
            out = np.full(len(x), -np.inf)
            inside = ((x >= lo[active]) & (x <= hi[active])).all(1)
            if inside.any() and n:
                with np.errstate(all="ignore"):
                    out[inside] = -0.5 * n * np.log(sse(full[inside]) / n)
            return np.where(np.isnan(out), -np.inf, out)

        rng = np.random.default_rng(seed)
        width = np.asarray(group["spread"].iloc[0], float)[active] if more else spread * (hi - lo)[active]
        ball = np.clip(start[active] + width * rng.standard_normal((walkers, len(active))), lo[active], hi[active])
        chain = stretch_sampler(log_p, ball, steps, seed)
        flat = np.repeat(start[None], len(chain.flat(burn)), 0)
        flat[:, active] = chain.flat(burn)
        tau = float(np.nanmean(chain.tau)) if np.isfinite(chain.tau).any() else None
        most = float(np.nanmax(chain.tau)) if tau is not None else None
        return pd.DataFrame({k: group[k].iloc[0] for k in keys} | {"sample_id": np.arange(len(flat)), "p": flat.tolist(), "acceptance": chain.acceptance, "tau": tau, "max_tau": most, "sse": float(sse(start[None])[0]), "n": n})

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, sample_id long, p array<double>, acceptance double, tau double, max_tau double, sse double, n long")


def chain_report(chain: DataFrame, steps: int, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Acceptance and autocorrelation time of each key's chain, and whether the chain is long enough: 50 times its time."""
    out = chain.groupBy(*keys).agg(F.first("acceptance").alias("acceptance"), F.first("tau").alias("tau"), F.first("max_tau").alias("max_tau"), F.first("sse").alias("sse"), F.first("n").alias("n"), F.count(F.lit(1)).alias("n_samples"))
    return out.withColumn("long_enough", F.coalesce(F.lit(steps) >= 50 * F.col("max_tau"), F.lit(False)))
