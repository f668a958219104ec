"""Period aggregation and goodness of fit as decomposable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.dates import period_of
from fluvia.functions.stats import correlation

SCORES = ("nse", "r2", "mae", "kge", "rms")


def period_start(resolution: str, first_d: Column, one_month: bool = False) -> Column:
    """The first day of d's period: the day, a block of weeks counted from first_d, or a block of months."""
    n, unit = period_of(resolution)
    if unit == "d":
        return F.col("d")
    if unit == "w":
        return F.date_add(first_d, (F.floor(F.datediff(F.col("d"), first_d) / (7 * n)) * 7 * n).cast("int"))
    months = F.year("d") * 12 + F.month("d") - 1
    first = months if n == 1 or one_month else F.floor(months / n) * n
    return F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1))


def periods(df: DataFrame, resolution: str = "1d", prc: float = 1.0, sim: str | None = None, keys: tuple[str, ...] = ("site",), one_month: bool = False) -> DataFrame:
    """Observed means of days, blocks of weeks from the first day, or blocks of months.

    A period counts if at least a share ``prc`` of its days (of its full length, for weeks) is observed. With ``sim``,
    its mean over the days that are observed, evaluated (``in_eval``, where there is one) and simulated joins in.
    """
    n, unit = period_of(resolution)
    df = df.withColumn("period", period_start(resolution, F.min("d").over(Window.partitionBy(*keys)), one_month))
    seen = F.col("t_water").isNotNull()
    more = [F.avg(F.when(seen & (F.col("in_eval") if "in_eval" in df.columns else F.lit(True)), F.col(sim))).alias("sim")] if sim else []
    out = df.groupBy(*keys, "period").agg(F.count("t_water").alias("n_obs"), F.count(F.lit(1)).alias("n_days"), F.avg("t_water").alias("obs"), F.max("d").alias("last_d"), *more)
    full = F.lit(7 * n) if unit == "w" else F.col("n_days")
    place = {"d": F.col("period"), "w": F.least(F.date_add("period", -(-7 * n // 2) - 1), F.col("last_d")), "m": F.date_sub("last_d", F.floor(F.col("n_days") / 2).cast("int"))}[unit]
    return out.filter((F.col("n_obs") >= F.greatest(full * prc, F.lit(1)))).withColumn("placed_d", place).drop("last_d")


def with_periods(days: DataFrame, forcing: DataFrame, resolution: str, prc: float = 1.0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """days with ``period`` (a struct of the period's first day ``p`` and its observed mean ``obs``, null for days of
    periods that don't count) and with the moments of all periods, for searches at a coarser resolution."""
    if period_of(resolution)[1] == "d":
        return days
    kept = periods(forcing, resolution, prc, keys=keys)
    stats = observed_stats(kept, keys).select(*keys, "n_dat", "mean_obs", "tss_obs")
    first = forcing.groupBy(*keys).agg(F.min("d").alias("first_d"))
    days = days.join(first, list(keys)).withColumn("p", period_start(resolution, F.col("first_d"))).drop("first_d")
    period = F.when(F.col("obs").isNotNull(), F.struct("p", "obs")).alias("period")
    out = days.drop("n_dat", "mean_obs", "tss_obs").join(kept.select(*keys, F.col("period").alias("p"), "obs"), [*keys, "p"], "left").join(stats, list(keys))
    return out.withColumn("period", period).drop("p", "obs")


def observed_stats(p: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Number, mean, total sum of squares and deviation of all periods."""
    n = F.count("obs")
    return p.groupBy(*keys).agg(n.alias("n_dat"), F.avg("obs").alias("mean_obs"), (F.var_pop("obs") * n).alias("tss_obs"), F.when(n > 1, F.stddev_samp("obs")).otherwise(0.0).alias("std_obs"))


def scores(p: DataFrame, keys: tuple[str, ...] = ("site",), stats: DataFrame | None = None) -> DataFrame:
    """NSE, R2, MAE, KGE and negative RMS error of (obs, sim) periods against the moments of all observed periods."""
    stats = observed_stats(p, keys) if stats is None else stats
    both = p.filter("obs IS NOT NULL AND sim IS NOT NULL AND NOT isnan(sim)")
    e = F.col("sim") - F.col("obs")
    n = F.count(F.lit(1))
    sums = both.groupBy(*keys).agg(n.alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"), (F.covar_pop("sim", "obs") * n).alias("sso"), (F.var_pop("sim") * n).alias("tss_sim"), F.avg("sim").alias("mean_sim"), F.stddev_samp("sim").alias("std_sim"), (F.var_pop("obs") * n).alias("tss_valid"))
    out = sums.join(stats, list(keys))
    c = F.col
    kge = 1 - F.sqrt(F.pow(c("std_sim") / c("std_obs") - 1, F.lit(2)) + F.pow(c("mean_sim") / c("mean_obs") - 1, F.lit(2)) + F.pow(c("sso") / (c("n") - 1) / (c("std_sim") * c("std_obs")) - 1, F.lit(2)))
    return out.select(
        *keys, "n",
        F.when(c("tss_obs") == 0, F.when(c("sse") == 0, 1.0).otherwise(-1e30)).otherwise(1 - c("sse") / c("tss_obs")).alias("nse"),
        F.when((c("tss_obs") == 0) | (c("tss_sim") == 0), -999.0).otherwise(F.pow(c("sso") / F.sqrt(c("tss_sim") * c("tss_obs")), F.lit(2))).alias("r2"),
        (c("sae") / c("n")).alias("mae"),
        F.when((c("n") < 2) | (c("std_sim") == 0) | (c("std_obs") == 0), -999.0).otherwise(kge).alias("kge"),
        (-F.sqrt(c("sse") / c("n"))).alias("rms"),
        F.when(c("tss_valid") > 0, 1 - c("sse") / c("tss_valid")).alias("nse_valid"),
    )


def fold_scores(p: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Held-out NSE, KGE and RMSE with the moments of the held-out days, population deviations."""
    both = p.filter("obs IS NOT NULL AND sim IS NOT NULL AND NOT isnan(sim)")
    e = F.col("sim") - F.col("obs")
    n, alpha, beta, r = F.count(F.lit(1)), F.stddev_pop("sim") / F.nullif(F.stddev_pop("obs"), F.lit(0.0)), F.avg("sim") / F.nullif(F.avg("obs"), F.lit(0.0)), correlation("sim", "obs")
    square = lambda c: F.pow(c - 1, F.lit(2))
    return both.groupBy(*keys).agg(n.alias("n_obs"), (1 - F.sum(e * e) / F.nullif(F.var_pop("obs") * n, F.lit(0.0))).alias("nse"), (1 - F.sqrt(square(r) + square(alpha) + square(beta))).alias("kge"), F.sqrt(F.avg(e * e)).alias("rmse"))


def goodness_of_fit(p: DataFrame, n_parameters: int, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """RMSE, MAE, R2, and the information criteria of n_parameters active parameters."""
    both = p.filter("obs IS NOT NULL AND sim IS NOT NULL")
    e = F.col("sim") - F.col("obs")
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), (F.var_pop("obs") * F.count(F.lit(1))).alias("tss"))
    fit = F.col("n") * F.log(F.nullif(F.col("sse"), F.lit(0.0)) / F.col("n"))
    return sums.select(*keys, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", (1 - F.col("sse") / F.nullif(F.col("tss"), F.lit(0.0))).alias("r2"), (fit + 2 * n_parameters).alias("aic"), (fit + n_parameters * F.log(F.col("n"))).alias("bic"))


def log_likelihood(sse: Column, n: Column) -> Column:
    """Gaussian log likelihood with the deviation concentrated out; -inf without data, +inf for a perfect fit."""
    return F.when((n == 0) | sse.isNull() | F.isnan(sse), float("-inf")).when(sse == 0, float("inf")).otherwise(-0.5 * n * F.log(sse / n))
