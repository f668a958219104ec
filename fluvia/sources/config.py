"""Run configuration: a YAML file as a checked dataclass."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from fluvia.functions.dates import period_of
from fluvia.functions.kernels import ACTIVE, INTEGRATORS

MODES = ("FORWARD", "PSO", "LATHYP", "DE", "DE-MCMC", "DE-CV-MCMC")
OBJECTIVES = ("NSE", "KGE", "RMS")


@dataclass(frozen=True)
class Search:
    n_runs: int = 100
    n_particles: int = 50
    c1: float = 2.0
    c2: float = 2.0
    w_max: float = 0.9
    w_min: float = 0.4
    walkers: int = 32
    steps: int = 1000


@dataclass(frozen=True)
class Folds:
    enabled: bool = False
    unit: str = "year"
    n_years: int = 1
    first_month: int = 1
    min_train_years: int = 1
    skip_first_year: bool = True
    min_valid_obs: int = 10
    overrides: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    project: str = "project"
    station: str = "AirStation"
    water_station: str = ""
    series: str = "series"
    resolution: str = "1d"
    version: int = 8
    ice: float = 0.0
    objective: str = "NSE"
    integrator: str = "RK4"
    mode: str = "DE"
    prc: float = 1.0
    min_score: float = 0.0
    gap_tolerant: bool = False
    qmedia: float | None = None
    warmup_days: int = 15
    min_days: int = 30
    sensitivity: bool = False
    perturbations: tuple[float, ...] = (1.0,)
    calibration: str | None = None
    validation: str | None = None
    output: str | None = None
    low: tuple[float, ...] = (0.0,) * 8
    high: tuple[float, ...] = (0.0,) * 8
    parameters: tuple[float, ...] | None = None
    intervals: bool = False
    chain: str | None = None
    noise: str = "iid"
    rho: float | None = None
    interval: float = 90.0
    sigma: float = 0.0
    n_samples: int = 1000
    seed: int | None = None
    search: Search = Search()
    folds: Folds = Folds()

    def __post_init__(self):
        period_of(self.resolution)
        for name, value, allowed in (("version", self.version, tuple(ACTIVE)), ("objective", self.objective, OBJECTIVES), ("integrator", self.integrator, INTEGRATORS), ("mode", self.mode, MODES), ("noise", self.noise, ("iid", "ar1")), ("unit", self.folds.unit, ("year", "n_years"))):
            if value not in allowed:
                raise ValueError(f"{name} {value!r}: one of {allowed}")
        if self.rho is not None and not -1 < self.rho < 1:
            raise ValueError("ar1 rho lies between -1 and 1, both excluded")
        if not 0 < self.interval < 100:
            raise ValueError("the prediction interval lies between 0 and 100, both excluded")
        if self.qmedia is not None and self.qmedia <= 0:
            raise ValueError("qmedia is positive")
        if not self.folds.skip_first_year and not self.folds.min_train_years:
            raise ValueError("the first year has none before it to spin up from: skip it, or train on a first year at least")
        if len(self.low) != 8 or len(self.high) != 8:
            raise ValueError("8 lower and 8 upper bounds")

    @property
    def label(self) -> str:
        water = self.water_station or self.station
        return self.station if water == self.station else f"{self.station}_{water}"

    @property
    def output_dir(self) -> str:
        return self.output or f"{self.project}/output_{self.version}"

    def bounds(self) -> tuple[list[float], list[float]]:
        """Bounds with unused parameters held at zero."""
        on = ACTIVE[self.version]
        return [x if k in on else 0.0 for k, x in enumerate(self.low)], [x if k in on else 0.0 for k, x in enumerate(self.high)]

    @property
    def fold_years(self) -> int:
        """Years of a held-out block."""
        return self.folds.n_years if self.folds.unit == "n_years" else 1

    def for_fold(self) -> Config:
        """The configuration of a fold's search."""
        return replace(self, search=replace(self.search, **self.folds.overrides))


def parsed(raw: dict) -> Config:
    """A configuration from the nested map of a YAML file."""
    options, paths, unc, fwd, cv, bounds = (raw.get(k) or {} for k in ("optimization", "paths", "uncertainty_options", "forward_options", "cross_validation", "parameter_bounds"))
    pick = lambda source, names: {new: source[old] for old, new in names.items() if source.get(old) is not None}
    top = pick(raw, {"project_name": "project", "station_name": "station", "water_station": "water_station", "series": "series", "time_resolution": "resolution", "version": "version", "Tice_cover": "ice", "objective_function": "objective", "integrator": "integrator", "run_mode": "mode", "prc": "prc", "mineff_index": "min_score", "gap_tolerant": "gap_tolerant", "Qmedia": "qmedia", "warmup_drop_days": "warmup_days", "min_segment_days": "min_days", "sensitivity_analysis": "sensitivity"})
    top |= pick(paths, {"input_data": "calibration", "validation_data": "validation", "output_dir": "output"})
    top |= pick(unc, {"noise_model": "noise", "ar1_rho": "rho", "prediction_interval": "interval"})
    top |= pick(fwd, {"enable_prediction_intervals": "intervals", "mcmc_chain_path": "chain", "residual_sigma": "sigma", "n_samples": "n_samples", "random_seed": "seed"})
    if (x := raw.get("sensitivity_perturbations")) is not None:
        top["perturbations"] = tuple(x) if isinstance(x, (list, tuple)) else (x,)
    if bounds:
        top |= {"low": tuple(map(float, bounds["min"])), "high": tuple(map(float, bounds["max"]))}
    if raw.get("parameters_forward") is not None:
        top["parameters"] = tuple(map(float, raw["parameters_forward"]))
    found = pick(options, {"n_run": "n_runs", "n_runs": "n_runs", "n_particles": "n_particles", "c1": "c1", "c2": "c2", "wmax": "w_max", "wmin": "w_min", "mcmc_walkers": "walkers", "mcmc_steps": "steps"})
    folds = pick(cv, {"enabled": "enabled", "unit": "unit", "n_years_per_fold": "n_years", "water_year_start_month": "first_month", "min_train_years": "min_train_years", "skip_first_year": "skip_first_year", "min_valid_obs": "min_valid_obs", "optimizer_overrides": "overrides"})
    return Config(**top, search=Search(**found), folds=Folds(**folds))


def read(path: str) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parsed(yaml.safe_load(f) or {})
