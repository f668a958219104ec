"""Folders of station files: one file, or one folder of files, for each site, with what can't be read kept aside."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.operators import prep
from fluvia.sources.scratch import written

#: Files whose headers are broadcast at most.
BROADCAST_FILES = 100_000
#: What stands for no value.
MISSING = ("", "na", "nan", "null")


def site_of(entry: str) -> str:
    """The site of a folder's entry: ``name.csv``, ``name``, or a partition ``site=name``."""
    return unquote(entry[5:]) if entry.startswith("site=") else entry.removesuffix(".csv")


def list_sites(spark: SparkSession, path: str) -> dict[str, str]:
    """The sites of a folder and the place of each; a file is one site by its name."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise FileNotFoundError(path)
    if store.getFileStatus(place).isFile():
        return {site_of(place.getName()): path}
    found = (x.getPath() for x in store.listStatus(place))
    return {site_of(p.getName()): f"{path.rstrip('/')}/{p.getName()}" for p in found if not p.getName().startswith(("_", "."))}


def _entry(root: str) -> Column:
    """The name of the folder's entry that a row's file lies in or is."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tail = re.escape(root.rstrip("/").rpartition("/")[2])
    return F.regexp_extract(decoded, f"/{tail}/([^/]+)", 1)


def parsed(spark: SparkSession, path: str, columns: dict[str, str], date: str = "Date", fmt: str | None = "yyyy-MM-dd", required: tuple[str, ...] | None = None, sites: list[str] | None = None) -> DataFrame:
    """(site, file, line, d, .. , reason): every line of a folder's files but their headers, values by new name.

    ``columns`` are the old names of the new ones; each file says in its own header where they are, in any order. ``reason``
    is null for rows that could be read: else the file has no header or not all ``required`` columns (all, by default), the
    line another number of fields, the date or a value can't be read. Fields hold no commas. With ``sites``, only their
    files are listed and read; one that isn't there is an error."""
    there = list_sites(spark, path)
    if sites is not None and (lost := [s for s in sites if s not in there]):
        raise FileNotFoundError(f"{path}: no files of {lost[:5]}")
    places = [p for s, p in there.items() if sites is None or s in sites]
    if not places:
        raise FileNotFoundError(f"{path}: no files")
    alone = there.get(site_of(path.rstrip("/").rpartition("/")[2])) == path
    entry = F.lit(path.rstrip("/").rpartition("/")[2]) if alone else _entry(path)
    site = F.when(entry.startswith("site="), F.url_decode(F.replace(F.substring(entry, 6, 1 << 20), F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_replace(entry, r"\.csv$", ""))
    clean = F.transform(F.split(F.replace("value", F.lit('"'), F.lit("")), ","), lambda x: F.trim(x))
    lines = spark.read.option("recursiveFileLookup", True).text(places).filter(F.trim("value") != "")
    lines = lines.select(site.alias("site"), F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), clean.alias("fields"))
    heads = lines.filter(F.array_contains("fields", date)).groupBy("site", "file").agg(F.max("fields").alias("head"))
    heads = written(heads, "headers")
    small = F.broadcast(heads) if heads.count() <= BROADCAST_FILES else heads
    rows = lines.join(small, ["site", "file"], "left").filter("head IS NULL OR fields <> head")
    text = lambda name: F.get("fields", F.array_position("head", name).cast("int") - 1)
    needed = (date, *(columns.values() if required is None else required))
    number = {new: F.when(~F.lower(text(old)).isin(*MISSING), text(old)) for new, old in columns.items()}
    rows = rows.withColumns({f"raw_{new}": x for new, x in number.items()}).withColumn("raw_d", text(date))
    value = {new: prep.nulled(F.expr(f"try_cast(`raw_{new}` AS double)")) for new in columns}
    when = F.try_to_timestamp("raw_d", F.lit(fmt)) if fmt else F.try_to_timestamp("raw_d")
    rows = rows.withColumns(value | {"d": F.to_date(when)})
    lost = F.array_except(F.array(*[F.lit(c) for c in needed]), F.col("head"))
    bad = F.filter(F.array(*[F.when(F.col(f"raw_{new}").isNotNull() & F.expr(f"try_cast(`raw_{new}` AS double) IS NULL"), F.lit(old)) for new, old in columns.items()]), lambda x: x.isNotNull())
    reason = (
        F.when(F.col("head").isNull(), "no header").when(F.size(lost) > 0, F.concat(F.lit("missing columns: "), F.array_join(lost, ", ")))
        .when(F.size("fields") != F.size("head"), "another number of fields").when(F.col("d").isNull(), "no date").when(F.size(bad) > 0, F.concat(F.lit("no number: "), F.array_join(bad, ", ")))
    )
    return rows.select("site", "file", "line", "d", *columns, reason.alias("reason"))


def read_stations(spark: SparkSession, path: str, fmt: str = "yyyy-MM-dd", sites: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(site, d, t_air, t_water, q) of a folder's files with Date, T_air, Discharge and maybe T_water, sentinels null, and
    (site, file, line, reason) of the lines that can't be read. Both come from one pass, which is written."""
    names = {"t_air": "T_air", "t_water": "T_water", "q": "Discharge"}
    rows = written(parsed(spark, path, names, "Date", fmt, ("T_air", "Discharge"), sites), "station-lines")
    return rows.filter("reason IS NULL").select("site", "d", *names), rows.filter("reason IS NOT NULL").select("site", "file", "line", "reason")
