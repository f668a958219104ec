"""Data preparation: from folders of raw station files to daily tables with their reports, in one call."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.operators import prep, reports
from fluvia.sources import files, stations
from fluvia.sources.scratch import written

#: The columns of the merged table, and their names in its files.
COLUMNS = {"t_air": "T_air", "t_water": "T_water", "q": "Discharge"}


@dataclass(frozen=True)
class Source:
    """Files of one variable at any frequency: a folder with a file or folder for each site, or one site's file."""

    path: str
    name: str
    value: str
    date: str = "Date"
    fmt: str | None = None
    kelvin: bool = False


def long_series(spark: SparkSession, sources: list[Source], sites: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(site, d, name, value) of all sources' rows, and (site, file, line, reason) of those that can't be read."""
    rows = []
    for s in sources:
        found = stations.parsed(spark, s.path, {"value": s.value}, s.date, s.fmt, sites=sites)
        value = prep.celsius("value") if s.kelvin else F.col("value")
        rows.append(found.select("site", "file", "line", "reason", "d", F.lit(s.name).alias("name"), value.alias("value")))
    rows = written(reduce(DataFrame.unionByName, rows), "source-lines")
    return rows.filter("reason IS NULL").select("site", "d", "name", "value"), rows.filter("reason IS NOT NULL").select("site", "file", "line", "reason")


def merged(long: DataFrame) -> DataFrame:
    """Daily means of every variable beside each other on each site's complete calendar, the standard columns first.

    All sources are one table, so they merge in one shuffle; a variable that no source has is null."""
    names = sorted({*COLUMNS, *(r.name for r in long.select("name").distinct().collect())})  # as many as there are variables
    wide = prep.complete_calendar(prep.merge_long(long, names, ("site", "d")))
    return prep.ordered_columns(wide, ("site", "d", *COLUMNS))


def analysed(days: DataFrame, min_days: int = 30) -> dict[str, DataFrame]:
    """The tables of an analysis: missing values, blocks, their summary, and a report of each site as lines of text."""
    blocks = written(prep.block_table(days, min_days), "blocks")
    summary = written(prep.summary_of(blocks), "summary")
    missing = prep.missing(days)
    spans = days.groupBy("site").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    valid = blocks.filter("kind = 'valid'").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("start_d", "end_d", "n_days", "n_obs"))).alias("segments"))
    report = missing.join(summary, "site").join(spans, "site").join(valid, "site", "left").select("site", F.explode(reports.analysis_lines(min_days)).alias("value"))
    return {"missing": missing, "blocks": blocks, "summary": summary, "report": report}


def prepare(spark: SparkSession, sources: list[Source], output: str, min_days: int = 30, sites: list[str] | None = None) -> dict[str, str]:
    """Merges, completes, analyses and writes; the folder of each output, by name.

    ``merged`` can be read by ``stations.read_stations`` and by a run. Outputs are partitioned by site: a call for some sites
    replaces these alone. ``rejected`` has the lines that couldn't be read, ``manifest`` the rows of each output."""
    long, bad = long_series(spark, sources, sites)
    days = written(merged(long), "merged")
    out = files.Folder(spark, output, [r.site for r in days.select("site").distinct().collect()])
    table = prep.gap_flags(days).select("site", F.col("d").alias("Date"), *[F.col(k).alias(v) for k, v in COLUMNS.items()], *[c for c in days.columns if c not in ("site", "d", *COLUMNS)])
    out.csv("merged", table)
    out.csv("rejected", bad)
    for name, df in analysed(days, min_days).items():
        out.lines(name, df) if name == "report" else out.csv(name, df)
    out.manifest()
    return out.places
