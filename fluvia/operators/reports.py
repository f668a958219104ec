"""Report tables: everything that a plot or a text report would show, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.stats import correlation, normal_quantile
from fluvia.operators import prep
from fluvia.sources.scratch import written

LIMITS = {"NSE": 0.5, "KGE": 0.5}
RMS_TOLERANCE = 2.0


def acceptable(history: DataFrame, objective: str = "NSE", score: str = "eff_index", limit: float | None = None) -> DataFrame:
    """Evaluations good enough to plot, or all of them if none is."""
    ok = -F.col(score) <= (RMS_TOLERANCE if limit is None else limit) if objective == "RMS" else F.col(score) >= (LIMITS[objective] if limit is None else limit)
    some = history.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("some"))
    return history.crossJoin(F.broadcast(some)).filter(ok | ~F.col("some")).drop("some")  # one row


def running_best(history: DataFrame, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The best NSE, R2 and MAE up to each evaluation."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumns({"best_nse": F.max("nse").over(w), "best_r2": F.max("r2").over(w), "best_mae": F.min("mae").over(w)})


def rolling_mean(value: str, days: int = 7, keys: tuple[str, ...] = ("site",)) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy("d").rowsBetween(1 - days, 0))


def observed_span(df: DataFrame, value: str = "t_water", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Rows from the first to the last observed value; the two days of a key come from an aggregation, not a sort."""
    span = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("d").alias("first_seen"), F.max("d").alias("last_seen"))
    return df.join(span, list(keys)).filter(F.col("d").between(F.col("first_seen"), F.col("last_seen"))).select(*df.columns)


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], keys: tuple[str, ...]) -> DataFrame:
    """(keys, q): exact percentiles of each key, linearly interpolated, in an array; null values don't count, and values
    that aren't numbers are the largest.

    Equal values are counted, and the counts dealt by ranges and written. Sums of the ranges tell which of them hold a wanted
    place; only those are sorted, so no task gets all values of a key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    dealt = written(counts.repartitionByRange(n, *keys, "value").withColumn("range", F.spark_partition_id()), "counts")
    sums, key = dealt.groupBy(*keys, "range").agg(F.sum("n").alias("in_range")), Window.partitionBy(*keys)
    sums = sums.select(*keys, "range", "in_range", F.sum("in_range").over(key).alias("total"), (F.sum("in_range").over(key.orderBy("range")) - F.col("in_range")).alias("before"))
    places = [F.lit(float(q)) * (F.col("total") - 1) for q in at]
    ends = [(F.floor(x), F.ceil(x)) for x in places]
    holds = lambda first, size, x: (x >= F.col(first)) & (x < F.col(first) + F.col(size))
    wanted = sums.filter(reduce(or_, [holds("before", "in_range", x) for pair in ends for x in pair]))
    rows = prep.null_safe_join(dealt, wanted, (*keys, "range"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("value"))
    rows = rows.withColumn("first", F.col("before") + upto - F.col("n"))
    found = [F.max(F.when(holds("first", "n", x), F.col("value"))).alias(f"{name}_{k}") for k, pair in enumerate(ends) for name, x in zip(("low", "high"), pair)]
    out = rows.groupBy(*keys).agg(F.max("total").alias("total"), *found)
    between = [F.when(F.col(f"low_{k}") == F.col(f"high_{k}"), F.col(f"low_{k}")).otherwise((b - x) * F.col(f"low_{k}") + (x - a) * F.col(f"high_{k}")) for k, (x, (a, b)) in enumerate(zip(places, ends))]
    return out.select(*keys, F.array(*between).alias("q"))


def posterior_summary(chain: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviation, 95 % interval of each parameter of (sample_id, p), and whether zero lies outside."""
    long, each = chain.select(*keys, F.posexplode("p").alias("at", "value")), (*keys, "parameter")
    long = long.select(*keys, (F.col("at") + 1).alias("parameter"), "value")
    out = long.groupBy(*each).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = prep.null_safe_join(out, quantiles(long, "value", (0.025, 0.975), each), each, "left")
    low, high = F.col("q")[0], F.col("q")[1]
    return out.select(*each, "mean", "std", low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def burned(chain: DataFrame, steps: int, burn: float = 0.3, step: str = "step") -> DataFrame:
    """A chain of walkers without its first steps."""
    return chain.filter(F.col(step) >= int(burn * steps))


def parameter_correlation(chain: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlations of all pairs of parameters, one aggregation."""
    pairs = [(i, j) for i in range(n) for j in range(n)]
    row = chain.groupBy(*keys).agg(*[correlation(F.col("p")[i], F.col("p")[j]).alias(f"c_{i}_{j}") for i, j in pairs])
    cells = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("a"), F.lit(j + 1).alias("b"), F.col(f"c_{i}_{j}").alias("r")) for i, j in pairs]))
    return row.select(*keys, cells.alias("x")).select(*keys, "x.a", "x.b", "x.r")


def envelope(ensemble: DataFrame, interval: float = 90.0, keys: tuple[str, ...] = ("site",), value: str = "tw") -> DataFrame:
    """Lower, median and upper percentile of each day over the samples, exact and linearly interpolated."""
    if not 0 < interval < 100:
        raise ValueError("the prediction interval lies between 0 and 100, both excluded")
    tail = (100 - interval) / 200
    q = F.percentile(value, F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)))
    return ensemble.groupBy(*keys, "d").agg(q.alias("q")).select(*keys, "d", F.col("q")[0].alias("lower"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("upper"))


def masked_envelope(bounds: DataFrame, simulated: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The envelope aligned to a series by site and day, null where the series has no simulation."""
    out = simulated.join(bounds, [*keys, "d"], "left")
    return out.withColumns({c: F.when(F.col("t_water_sim").isNotNull(), F.col(c)) for c in ("lower", "p50", "upper")})


def residuals(series: DataFrame, sim: str = "tw", obs: str = "t_water") -> DataFrame:
    """series with the simulated less the observed value."""
    return series.withColumn("residual", F.col(sim) - F.col(obs))


def residual_sigma(df: DataFrame, value: str = "residual", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, n, sse, sigma) of residuals that aren't null."""
    e = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(value)).alias("sse"))
    return e.withColumn("sigma", F.sqrt(F.col("sse") / F.col("n")))


def histogram(df: DataFrame, value: str, bins: int = 30, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Counts in equal bins between the least and the largest value, which falls into the last bin."""
    span = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col(value) - F.col("a")) / width), F.lit(bins - 1))).otherwise(0)
    return df.filter(F.col(value).isNotNull()).join(span, list(keys)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, order: tuple[str, ...], keys: tuple[str, ...] = ("site",), name: str = "rn") -> DataFrame:
    """df with row numbers 1 .. of each key in an order of columns, without a task for each key.

    Rows are dealt by ranges of the order, sorted and written with their places; a table of the counts of each key in each
    range gives the offset that is added to the places within it. Rows equal in the order have any of their numbers."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("place", F.monotonically_increasing_id())
    dealt = written(dealt, "ranges").withColumn("range", F.shiftright("place", 33))
    first = dealt.groupBy(*keys, "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")
    offset = first.select(*keys, "range", (before - F.col("first") + 1).alias("offset"))
    out = dealt.join(offset, [*keys, "range"]) if keys else dealt.join(offset, "range")
    return out.withColumn(name, F.col("place") + F.col("offset")).drop("place", "range", "offset")


#: Values of a block of a series that are multiplied with those of another block at once.
BLOCK_ROWS = 4096


def _products(batches: Iterator[pd.DataFrame], keys: tuple[str, ...], size: int) -> Iterator[pd.DataFrame]:
    """Sums of products of the values of two blocks, by the distance of their places."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            x, y = np.asarray(r.x, float), np.asarray(r.y, float)
            s = np.correlate(y, x, "full")  # at place m: lag of m - (len(x) - 1) between the blocks' first values
            lag = np.arange(len(s)) - (len(x) - 1) + (r.later - r.block) * size
            use = lag >= 0
            yield pd.DataFrame({k: getattr(r, k) for k in keys} | {"lag": lag[use], "s": s[use]})


def autocorrelation(df: DataFrame, value: str, lags: int | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, lag, acf): the autocorrelation of each series at all lags 0 .. n - 1, or up to ``lags``; null values are
    passed over, and a constant series has none.

    Values are packed in blocks by their places; each block meets the later ones within reach, a task a pair, which
    returns one sum for each lag between them."""
    seen = df.filter(F.col(value).isNotNull()).select(*keys, "d", F.col(value).cast("double").alias("x"))
    rows = ranked(seen, ("d",), keys)
    mean = rows.groupBy(*keys).agg(F.avg("x").alias("mean"))
    total = rows.join(mean, list(keys)).groupBy(*keys).agg(F.first("mean").alias("mean"), F.sum(F.pow(F.col("x") - F.col("mean"), F.lit(2))).alias("total"), F.count(F.lit(1)).alias("n"))
    total = written(total, "moments")
    block = F.floor((F.col("rn") - 1) / BLOCK_ROWS)
    packed = rows.join(total.select(*keys, "mean"), list(keys)).groupBy(*keys, block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("rn", (F.col("x") - F.col("mean")).alias("x")))).alias("v"))
    packed = written(packed.select(*keys, "block", F.col("v.x").alias("x")), "blocks")
    last = F.floor((F.col("n") - 1) / BLOCK_ROWS)
    reach = last if lags is None else F.least(last, F.col("block") + (lags + BLOCK_ROWS - 1) // BLOCK_ROWS)
    first = packed.join(total.select(*keys, "n"), list(keys)).withColumn("later", F.explode(F.sequence("block", reach))).drop("n")
    pairs = first.join(packed.select(*keys, F.col("block").alias("later"), F.col("x").alias("y")), [*keys, "later"])
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    sums = pairs.select(*keys, "block", "later", "x", "y").mapInPandas(partial(_products, keys=keys, size=BLOCK_ROWS), f"{kinds}, lag long, s double")
    sums = sums if lags is None else sums.filter(F.col("lag") <= lags)
    return sums.groupBy(*keys, "lag").agg(F.sum("s").alias("s")).join(total, list(keys)).select(*keys, "lag", F.try_divide("s", "total").alias("acf"))


def normal_quantiles(df: DataFrame, value: str, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Ordered values against normal quantiles of Filliben's order medians; places come from ``ranked``."""
    out = ranked(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("ordered")), ("ordered",), keys, "i")
    out = out.join(out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), list(keys))
    tail = F.pow(F.lit(0.5), 1 / F.col("n"))
    m = F.when(F.col("n") == 1, 0.5).when(F.col("i") == F.col("n"), tail).when(F.col("i") == 1, 1 - tail).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return out.select(*keys, "i", "ordered", normal_quantile(m).alias("theoretical"))


def combined(first: Column | str, second: Column | str) -> Column:
    """The aggregated simulation where there is one, else the daily one."""
    return F.coalesce(first, second)


def sensitivity_columns(table: DataFrame, percents: tuple[float, ...], keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """A row for each parameter with the sensitivities of all perturbations beside each other."""
    wide = table.groupBy(*keys, "parameter").pivot("perturbation", [float(x) for x in percents]).agg(F.first("sensitivity"))
    return wide.select(*keys, "parameter", *[F.col(f"`{float(x)}`").alias(f"sensitivity_{float(x):g}".replace(".", "_")) for x in percents])


def spread_array(spread: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, parameter, spread) as one array of each key."""
    each = F.sort_array(F.collect_list(F.struct("parameter", "spread")))
    return spread.groupBy(*keys).agg(each.alias("x")).select(*keys, F.col("x.spread").alias("spread"))


def gap_summary(forcing: DataFrame, version: int = 8, min_days: int = 30, qmedia: float | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row of each series: the flow mean and where it comes from, missing forcing, segments, valid days, observations."""
    seg = prep.with_segments(forcing, version, min_days, 0, keys)
    n, share = F.count(F.lit(1)), lambda c: (F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1))
    mean = F.avg(F.when(F.col("q") > 0, F.col("q"))) if qmedia is None else F.lit(float(qmedia))
    return seg.groupBy(*keys).agg(
        F.lit("computed" if qmedia is None else "user").alias("qmedia_source"), mean.alias("qmedia"), n.alias("n_days"), (n - F.count("t_air")).alias("t_air_missing"), share("t_air").alias("t_air_share"),
        (n - F.count("q")).alias("q_missing"), share("q").alias("q_share"), F.countDistinct("seg_id").alias("n_segments"), F.count("seg_id").alias("valid_days"), F.count("t_water").alias("n_obs"),
    )


def flow_warnings(forcing: DataFrame, qmedia: float | None = None, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Whether more than half of a series' flow is missing, and whether a given mean is over 30 % off the computed one."""
    n, q = F.count(F.lit(1)), F.when(F.col("q") > 0, F.col("q"))
    off = F.abs(F.lit(qmedia).cast("double") - F.avg(q)) / F.avg(q) > 0.3
    return forcing.groupBy(*keys).agg((F.count(q) < 0.5 * n).alias("mostly_missing"), F.coalesce(off, F.lit(False)).alias("far_off"))


def analysis_text(summary: dict, gaps: dict, segments: list[dict]) -> str:
    """The text report of one series, from its rows of ``prep.analysis_summary``, ``prep.missing`` and ``segment_table``."""
    lines = [f"days: {gaps['n']}", *(f"{c}: {gaps[f'{c}_missing']} missing ({gaps[f'{c}_percent']:.2f} %)" for c in ("t_air", "t_water", "q"))]
    lines += [f"blocks: {summary['n_valid']} valid, {summary['n_short']} too short, {summary['n_gap']} gaps", f"valid days: {summary['valid_days']}, observed: {summary['valid_obs']}"]
    lines += [f"observations per parameter, version {v}: {summary[f'obs_per_parameter_v{v}']:.1f}" for v in (3, 4, 5, 7, 8)]
    return "\n".join([*lines, *(f"segment {s['seg_id']}: {s['start_d']} to {s['end_d']}, {s['n_days']} days, {s['n_obs']} observed" for s in segments)]) + "\n"


def analysis_lines(min_days: int) -> Column:
    """The lines of a site's report, from a row of its summary, missing values, span and valid segments (an array)."""
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    lines = [F.format_string("range: %s to %s, %d days", date(F.col("first_d")), date(F.col("last_d")), F.col("n"))]
    lines += [F.format_string(f"{c}: %d missing (%.1f %%)", F.col(f"{c}_missing"), F.col(f"{c}_percent")) for c in ("t_air", "t_water", "q")]
    lines += [
        F.format_string(f"blocks: %d valid, %d shorter than {min_days} days, %d gaps", "n_valid", "n_short", "n_gap"),
        F.format_string("valid days: %d, observed: %d", "valid_days", "valid_obs"),
        *[F.format_string(f"observations per parameter, version {v}: %.1f", f"obs_per_parameter_v{v}") for v in (3, 4, 5, 7, 8)],
    ]
    each = F.transform("segments", lambda x, i: F.format_string("segment %d: %s to %s, %d days, %d observed", i + 1, date(x["start_d"]), date(x["end_d"]), x["n_days"], x["n_obs"]))
    return F.concat(F.array(*lines), F.coalesce(each, F.array(F.lit("no valid segment: the model can't run on this series"))))


def cv_summary(results: DataFrame, pooled: DataFrame, n_parameters: int = 8, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Rows of the folds, their mean and deviation (0 of one fold), and the scores of all held-out days together."""
    numbers = ["nse", "kge", "rmse", *[f"p{i}" for i in range(1, n_parameters + 1)]]
    flat = results.select(*keys, F.col("label").alias("fold"), "n_obs", "nse", "kge", "rmse", *[F.col("p")[i - 1].alias(f"p{i}") for i in range(1, n_parameters + 1)])
    mean = flat.groupBy(*keys).agg(F.lit("mean").alias("fold"), F.sum("n_obs").alias("n_obs"), *[F.avg(c).alias(c) for c in numbers])
    std = flat.groupBy(*keys).agg(F.lit("std").alias("fold"), F.sum("n_obs").alias("n_obs"), *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(c) for c in numbers])
    last = pooled.select(*keys, F.lit("pooled").alias("fold"), "n_obs", "nse", "kge", "rmse", *[F.lit(None).cast("double").alias(f"p{i}") for i in range(1, n_parameters + 1)])
    return flat.unionByName(mean).unionByName(std).unionByName(last)
