"""Preparation of daily series: resampling, merging, calendars, validity, segments, climatology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluvia.functions.dates import doy0, water_year, year_fraction
from fluvia.functions.kernels import NEEDS_FLOW

SENTINEL = -999.0


def nulled(c: Column | str, positive: bool = False) -> Column:
    """A value with the sentinel, and if asked for what isn't positive, as null."""
    c = F.col(c) if isinstance(c, str) else c
    bad = (c == SENTINEL) | F.isnan(c)
    return F.when(~(bad | (c <= 0)) if positive else ~bad, c)


def with_sentinel(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(SENTINEL))


def resample_daily(df: DataFrame, date: str, value: str, name: str, fmt: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily means of a series of any frequency; rows whose date can't be parsed are dropped, null values ignored."""
    kind = dict(df.dtypes)[date]
    when = F.col(date) if kind in ("date", "timestamp", "timestamp_ntz") else F.try_to_timestamp(F.col(date), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(date))
    days = df.select(*keys, F.to_date(when).alias("d"), F.col(value).cast("double").alias(name))
    return days.filter(F.col("d").isNotNull()).groupBy(*keys, "d").agg(F.avg(name).alias(name))


def merge(series: list[DataFrame], keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """Full outer join of series on their keys."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), series)


def null_safe_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """a with the columns of b, where null keys are equal."""
    other = {k: f"other_{k}" for k in keys}
    return a.join(b.withColumnsRenamed(other), reduce(lambda x, k: x & F.col(k).eqNullSafe(F.col(other[k])), keys, F.lit(True)), how).drop(*other.values())


def merge_long(long: DataFrame, names: list[str], keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """The same from one long table (keys, name, value): one shuffle however many sources there are."""
    return long.groupBy(*keys).pivot("name", names).agg(F.avg("value"))


def complete_calendar(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """A row for every day from the first to the last of each key; missing days have null values."""
    span = df.groupBy(*keys).agg(F.min("d").alias("a"), F.max("d").alias("b")) if keys else df.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("d"))
    return days.join(df, [*keys, "d"], "left")


def ordered_columns(df: DataFrame, first: tuple[str, ...] = ("d", "t_air", "t_water", "q")) -> DataFrame:
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def gap_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"t_air_gap": F.col("t_air").isNull().cast("int"), "q_gap": F.col("q").isNull().cast("int")})


def forcing_valid(version: int) -> Column:
    """Whether the model can step over a day; versions without flow ignore it."""
    ok = F.col("t_air").isNotNull()
    return ok & F.coalesce(F.col("q") > 0, F.lit(False)) if version in NEEDS_FLOW else ok


def analysis_valid() -> Column:
    return F.col("t_air").isNotNull() & F.coalesce(F.col("q") > 0, F.lit(False))


def islands(df: DataFrame, valid: Column, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """df with ``valid`` and ``block``, a number of each run of equal validity, in date order."""
    w = Window.partitionBy(*keys).orderBy("d")
    df = df.withColumn("valid", valid)
    before = F.lag("valid").over(w)
    return df.withColumn("turn", F.when(before.isNull() | (before != F.col("valid")), 1).otherwise(0)).withColumn("block", F.sum("turn").over(w)).drop("turn")


#: Days of a range in which runs are found on their own before the ranges are put together.
RANGE_DAYS = 1024


def islands_by_range(df: DataFrame, valid: Column, keys: tuple[str, ...] = ("site",), range_days: int = RANGE_DAYS) -> DataFrame:
    """``islands`` in two levels: runs within ranges of days, each a group of its own, then a carry over the ranges' edges.

    A series is spread over as many tasks as it has ranges; one group for each key has only a row for each range."""
    span = F.floor(F.unix_date("d") / range_days).alias("span")
    local = Window.partitionBy(*keys, "span").orderBy("d")
    rows = df.withColumn("valid", valid).select("*", span)
    rows = rows.withColumn("turn", F.when(F.lag("valid").over(local) != F.col("valid"), 1).otherwise(0)).withColumn("turns", F.sum("turn").over(local))
    edges = rows.groupBy(*keys, "span").agg(F.min_by("valid", "d").alias("first"), F.max_by("valid", "d").alias("last"), F.sum("turn").alias("inside"))
    over = Window.partitionBy(*keys).orderBy("span")
    before = F.lag("last").over(over)
    edges = edges.withColumn("joint", F.when(before.isNull() | (before != F.col("first")), 1).otherwise(0))
    edges = edges.select(*keys, "span", (F.sum(F.col("joint") + F.col("inside")).over(over) - F.col("inside")).alias("carry"))
    out = rows.join(edges, [*keys, "span"])
    return out.select(*df.columns, "valid", (F.col("carry") + F.col("turns")).alias("block"))


def with_segments(df: DataFrame, version: int = 8, min_days: int = 30, warmup_days: int = 15, keys: tuple[str, ...] = ("site",), range_days: int | None = None) -> DataFrame:
    """df with ``seg_id`` (1 .. in date order; null outside of long enough runs), ``seg_day`` (1 ..) and ``in_eval``.

    With ``range_days`` no series is sorted in one task: runs are found by ranges of so many days, and segments are numbered
    in a table of the runs, which joins the days again."""
    if range_days is None:
        tagged = islands(df, forcing_valid(version), keys)
        block = Window.partitionBy(*keys, "block")
        tagged = tagged.withColumn("days", F.count(F.lit(1)).over(block)).withColumn("start", F.min("d").over(block))
        kept = F.col("valid") & (F.col("days") >= min_days)
        starts = F.when(kept & (F.col("d") == F.col("start")), 1).otherwise(0)
        w = Window.partitionBy(*keys).orderBy("d")
        tagged = tagged.withColumn("seg_id", F.when(kept, F.sum(starts).over(w))).withColumn("seg_day", F.when(kept, F.datediff("d", "start") + 1))
        return tagged.withColumn("in_eval", F.coalesce(F.col("seg_day") > warmup_days, F.lit(False))).drop("valid", "block", "days", "start")
    tagged = islands_by_range(df, forcing_valid(version), keys, range_days)
    runs = tagged.filter("valid").groupBy(*keys, "block").agg(F.min("d").alias("start"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= min_days)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("block")).cast("long")
    out = tagged.join(runs.select(*keys, "block", "start", number.alias("seg_id")), [*keys, "block"], "left")
    out = out.select(*df.columns, "seg_id", (F.datediff("d", "start") + 1).alias("seg_day"))
    return out.withColumn("in_eval", F.coalesce(F.col("seg_day") > warmup_days, F.lit(False)))


#: Days of a bin of the interval join, and rows of a bin that one task joins.
BIN_DAYS, BIN_ROWS = 64, 100_000


def join_intervals(df: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("site",), start: str = "start_d", end: str = "end_d", day: str = "d", bin_days: int = BIN_DAYS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """df beside each row of intervals (keys, start, end, ..) that its day lies in, both ends included.

    Intervals are cut into bins of days and joined by equal bins, then refined, so it's no nested loop. A bin of more than
    ``bin_rows`` rows is dealt by hash to several tasks, to each of which its intervals go. Intervals may overlap; one that
    ends before it starts, or without an end, has no day; rows without a day have no interval."""
    number = lambda c: F.floor(F.unix_date(c) / bin_days)
    left = df.withColumn("bin", number(F.col(day))).filter("bin IS NOT NULL")
    cut = intervals.filter(F.col(start) <= F.col(end)).withColumn("bin", F.explode(F.sequence(number(F.col(start)), number(F.col(end)))))
    hot = left.groupBy(*keys, "bin").agg(F.ceil(F.count(F.lit(1)) / bin_rows).cast("int").alias("shares")).filter("shares > 1")
    dealt = F.coalesce("shares", F.lit(1))
    salt = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    left = left.join(hot, [*keys, "bin"], "left").withColumn("share", F.pmod(salt, dealt).cast("int")).drop("shares")
    cut = cut.join(hot, [*keys, "bin"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), dealt - 1))).drop("shares")
    return left.join(cut, [*keys, "bin", "share"]).filter(F.col(day).between(F.col(start), F.col(end))).drop("bin", "share")


def within(df: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("site",), value: str = "t_water") -> DataFrame:
    """intervals (keys, start_d, end_d) with the number of df's days in each, that of a value and its sum; 0 and null of none."""
    found = join_intervals(df.select(*keys, "d", value), intervals.select(*keys, "start_d", "end_d").distinct(), keys)
    counts = found.groupBy(*keys, "start_d", "end_d").agg(F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_seen"), F.sum(value).alias("total"))
    out = intervals.join(counts, [*keys, "start_d", "end_d"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_seen")})


def held_out(df: DataFrame, folds: DataFrame, fold: int, first_month: int = 1, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The days of a fold."""
    return df.withColumn("year", water_year(F.col("d"), first_month)).join(folds.filter(F.col("fold") == fold), [*keys, "year"], "left_semi").drop("year")


def training(df: DataFrame, folds: DataFrame, fold: int, first_month: int = 1, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The days that aren't in a fold."""
    return df.withColumn("year", water_year(F.col("d"), first_month)).join(folds.filter(F.col("fold") == fold), [*keys, "year"], "left_anti").drop("year")


def years(df: DataFrame, keys: tuple[str, ...] = ("site",), first_month: int = 1) -> DataFrame:
    """The distinct water years of each key."""
    return df.select(*keys, water_year(F.col("d"), first_month).alias("year")).distinct()


def midpoints(value: str, keys: tuple[str, ...] = ("site",)) -> Column:
    """The mean of a day's value and the next one's."""
    return (F.col(value) + F.lead(value).over(Window.partitionBy(*keys).orderBy("d"))) / 2


def celsius(kelvin: Column | str, least: float | None = None) -> Column:
    """Kelvin as degrees Celsius; below ``least``, if it is given, null."""
    c = (F.col(kelvin) if isinstance(kelvin, str) else kelvin) - 273.15
    return c if least is None else F.when(c >= least, c)


#: Gaps as (number, days): so many gaps of so many days, evenly spread over the series.
GAPS = {"few_short": (5, 3), "many_short": (20, 3), "few_long": (2, 30), "many_long": (5, 30)}


def with_gaps(df: DataFrame, value: str, scenario: str, share: float = 0.05, seed: int = 0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """df with values missing by one of GAPS, or, for "random", on a share of the days that a hash with the seed picks."""
    w = Window.partitionBy(*keys)
    if scenario == "random":
        name = F.concat_ws("|", *[F.col(k).cast("string") for k in (*keys, "d")], F.lit(str(seed)))
        gone = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % 1_000_000 < int(share * 1_000_000)
        return df.withColumn(value, F.when(~gone, F.col(value)))
    number, length = GAPS[scenario]
    every = F.floor(F.count(F.lit(1)).over(w) / (number + 1))
    n = F.row_number().over(w.orderBy("d")) - 1
    gone = (F.floor(n / every).between(1, number)) & (n % every < length)
    return df.withColumn(value, F.when(~gone, F.col(value)))


def segment_table(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """One row for each segment of ``with_segments``."""
    return df.filter("seg_id IS NOT NULL").groupBy(*keys, "seg_id").agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count(F.lit(1)).alias("n_days"), F.count("t_water").alias("n_obs"))


def segment_warnings(segments: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Of each series: segments of less than a year, and whether there are more than two."""
    return segments.groupBy(*keys).agg(F.count_if(F.col("n_days") < 365).alias("n_short"), (F.count(F.lit(1)) > 2).alias("many"))


def block_table(df: DataFrame, min_days: int = 30, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Valid, short and gap blocks with their bounds and lengths."""
    blocks = islands(df, analysis_valid(), keys).groupBy(*keys, "block", "valid").agg(F.min("d").alias("start_d"), F.max("d").alias("end_d"), F.count(F.lit(1)).alias("n_days"), F.count("t_water").alias("n_obs"))
    kind = F.when(~F.col("valid"), "gap").when(F.col("n_days") >= min_days, "valid").otherwise("short")
    return blocks.withColumn("kind", kind)


def analysis_summary(df: DataFrame, min_days: int = 30, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Blocks of each kind, valid days, observations in valid blocks, and these per parameter of each version."""
    return summary_of(block_table(df, min_days, keys), keys)


def summary_of(b: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The summary of a table of blocks."""
    of = lambda kind, c=F.lit(1): F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    out = b.groupBy(*keys).agg(of("valid").alias("n_valid"), of("short").alias("n_short"), of("gap").alias("n_gap"), of("valid", F.col("n_days")).alias("valid_days"), of("valid", F.col("n_obs")).alias("valid_obs"))
    return out.withColumns({f"obs_per_parameter_v{v}": F.col("valid_obs") / n for v, n in ((3, 3), (4, 4), (5, 5), (7, 7), (8, 8))})


def missing(df: DataFrame, columns: tuple[str, ...] = ("t_air", "t_water", "q"), keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Missing values of each column: number and percent."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n"), *[(n - F.count(c)).alias(f"{c}_missing") for c in columns], *[(100 * (n - F.count(c)) / n).alias(f"{c}_percent") for c in columns])


def qmedia(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Mean and number of positive flows."""
    q = F.when(F.col("q") > 0, F.col("q"))
    return df.groupBy(*keys).agg(F.avg(q).alias("qmedia"), F.count(q).alias("n_q"))


def climatology(df: DataFrame, keys: tuple[str, ...] = ("site",), value: str = "t_water") -> DataFrame:
    """Mean by 0-based day of the year, all 366; empty days are interpolated linearly around the year."""
    return filled_year(df.groupBy(*keys, doy0(F.col("d")).alias("doy0")).agg(F.avg(value).alias("t")), keys)


def filled_year(means: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """All 366 days of means (keys, doy0, t); days without a mean are interpolated linearly around the year."""
    grid = means.select(*keys).distinct().withColumn("doy0", F.explode(F.sequence(F.lit(0), F.lit(365))))
    year = grid.join(means, [*keys, "doy0"], "left").withColumn("turn", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("x", F.col("doy0") + 366 * F.col("turn"))
    w = Window.partitionBy(*keys).orderBy("x")
    at = F.when(F.col("t").isNotNull(), F.struct("x", "t"))
    low = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    year = year.withColumn("low", low).withColumn("high", high)
    value_ = F.when(F.col("t").isNotNull(), F.col("t")).otherwise(F.col("low.t") + (F.col("high.t") - F.col("low.t")) * (F.col("x") - F.col("low.x")) / (F.col("high.x") - F.col("low.x")))
    return year.withColumn("t", value_).filter("turn = 0").select(*keys, "doy0", "t")


def start_values(df: DataFrame, clim: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Each segment's first water temperature: what was observed, else the climatology, else 4."""
    first = df.filter("seg_day = 1").select(*keys, "seg_id", F.col("t_water").alias("obs"), doy0(F.col("d")).alias("doy0"))
    return first.join(clim, [*keys, "doy0"], "left").select(*keys, "seg_id", F.coalesce("obs", "t", F.lit(4.0)).alias("tw0"))


def with_warmup(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """A copy of the first 365 days, dateless, before the series; ``idx`` counts from 0, ``tt`` is the year fraction."""
    w = Window.partitionBy(*keys).orderBy("d")
    df = df.withColumn("n", F.row_number().over(w) - 1)
    real = df.withColumns({"is_warmup": F.lit(False), "idx": F.col("n") + 365, "tt": year_fraction(F.col("d"))})
    warm = df.filter("n < 365").withColumns({"is_warmup": F.lit(True), "idx": F.col("n"), "tt": (F.col("n") + 1) / 365, "d": F.lit(None).cast("date")})
    return warm.unionByName(real).drop("n")


def checks(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The scan-time constraints of each series: first day, gaps and repeats in the dates, missing forcing."""
    out = df.groupBy(*keys).agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count(F.lit(1)).alias("n"), F.countDistinct("d").alias("n_days"), F.count_if(F.col("t_air").isNull() | F.col("q").isNull()).alias("n_missing"))
    return out.select(
        *keys,
        ((F.month("first_d") == 1) & (F.dayofmonth("first_d") == 1)).alias("starts_jan_1"),
        ((F.col("n") == F.col("n_days")) & (F.col("n_days") == F.datediff("last_d", "first_d") + 1)).alias("is_daily"),
        (F.col("n_missing") == 0).alias("is_complete"),
        (F.col("n") >= 365).alias("has_a_year"),
    )


def with_a_year(df: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """The series of at least 365 days."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n >= 365").select(*keys), list(keys), "left_semi")


def require(df: DataFrame, gap_tolerant: bool = False, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """df, or ValueError where a series breaks a constraint."""
    if lost := {"d", "t_air", "q"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(lost)}")
    if "t_water" not in df.columns:
        df = df.withColumn("t_water", F.lit(None).cast("double"))
    wrong = ~F.col("is_daily") if gap_tolerant else ~(F.col("is_daily") & F.col("starts_jan_1") & F.col("is_complete"))
    if bad := checks(df, keys).filter(wrong).limit(1).collect():
        raise ValueError(f"not a complete daily series: {bad[0]}")
    return df


def folds(df: DataFrame, n_years: int = 1, first_month: int = 1, skip_years: int = 1, min_obs: int = 0, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Leave-out blocks of n water years: (keys, year, fold, label); the first years and a short tail are left out, as
    are blocks with fewer than ``min_obs`` observations. Folds are numbered before that."""
    years = df.groupBy(*keys, water_year(F.col("d"), first_month).alias("year")).agg(F.count("t_water").alias("n_obs"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("year"))
    block = Window.partitionBy(*keys, "fold")
    out = years.withColumn("r", rank - skip_years).filter("r >= 1").withColumn("fold", F.floor((F.col("r") - 1) / n_years).cast("int"))
    out = out.withColumn("n", F.count(F.lit(1)).over(block)).withColumn("n_obs", F.sum("n_obs").over(block)).filter((F.col("n") == n_years) & (F.col("n_obs") >= min_obs))
    low, high = F.min("year").over(block).cast("string"), F.max("year").over(block).cast("string")
    return out.withColumn("label", low if n_years == 1 else F.concat_ws("-", low, high)).select(*keys, "year", "fold", "label")
