"""Files in and out: series, chains with their sidecars, reports."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.operators import metrics, prep
from fluvia.sources.config import Config
from fluvia.sources.scratch import written


def read_series(spark: SparkSession, path: str, site: str = "site", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """A CSV with Date, T_air, Discharge and maybe T_water as (site, d, t_air, t_water, q); sentinels are null."""
    raw = spark.read.option("header", True).csv(path)
    if lost := [c for c in ("Date", "T_air", "Discharge") if c not in raw.columns]:
        raise ValueError(f"{path}: missing columns {lost}")
    value = lambda c: prep.nulled(F.expr(f"try_cast(`{c}` AS double)")) if c in raw.columns else F.lit(None).cast("double")
    return raw.select(F.lit(site).alias("site"), F.to_date("Date", fmt).alias("d"), value("T_air").alias("t_air"), value("T_water").alias("t_water"), value("Discharge").alias("q"))


def read_and_resample(spark: SparkSession, path: str, date: str, value: str, name: str, fmt: str | None = None) -> DataFrame:
    return prep.resample_daily(spark.read.option("header", True).csv(path), date, value, name, fmt)


def read_text_series(spark: SparkSession, path: str) -> DataFrame:
    """Lines of year month day Ta Tw [Q], parted by white space; Q is 1 where it lacks."""
    x = F.split(F.trim("value"), r"\s+")
    part = lambda i: F.get(x, F.lit(i))
    rows = spark.read.text(path).filter(F.trim("value") != "")
    day = F.make_date(part(0).cast("int"), part(1).cast("int"), part(2).cast("int"))
    return rows.select(day.alias("d"), part(3).cast("double").alias("t_air"), part(4).cast("double").alias("t_water"), F.coalesce(part(5).cast("double"), F.lit(1.0)).alias("q"))


def write_chain(chain: DataFrame, path: str, sampled: list[int], keep: bool = True) -> None:
    """A chain (site, sample_id, p) as a dataset partitioned by site, with the columns sample_id and par_k of the sampled
    parameters (0 ..). A site's chain replaces that site's alone; the others stay."""
    write_csv(chain.select("site", "sample_id", *[F.col("p")[k].alias(f"par_{k + 1}") for k in sampled]), path, ("site",), keep)


def read_chain(spark: SparkSession, path: str, defaults: list[float]) -> DataFrame:
    """A chain with columns par_k as (site, sample_id, p), or, where it isn't partitioned by site, as (sample_id, p).

    Columns are typed, not inferred, and a filter or join on the site reads that site's files alone. Parameters that aren't
    sampled have their defaults; rows of a chain without ids are numbered as they are read, and written once for that."""
    names = spark.read.option("header", True).csv(path).columns
    given = {int(c.split("_")[1]) - 1: c for c in names if c.startswith("par_")}
    kinds = {"site": "string", "sample_id": "long"}
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` {kinds.get(c, 'double' if c in given.values() else 'string')}" for c in names)).csv(path)
    p = F.array(*[F.col(given[k]) if k in given else F.lit(float(x)) for k, x in enumerate(defaults)]).alias("p")
    if "sample_id" in names:
        return raw.select(*(c for c in ("site",) if c in names), "sample_id", p)
    return written(raw.select(*(c for c in ("site",) if c in names), F.monotonically_increasing_id().alias("sample_id"), p), "chain")


#: What lies beside a chain, a row for each site.
SIDECAR = "site string, rho double, sigma double, n_valid_days long, n_pairs long, noise_model_used_for_this_run string, mcmc_walkers int, mcmc_steps int, mcmc_seed int, mean_acceptance_fraction double, mean_autocorr_time double, long_enough boolean"


def sidecar_path(chain_path: str) -> str:
    return chain_path.rstrip("/").removesuffix(".csv") + "_meta.json"


def read_sidecar(spark: SparkSession, chain_path: str) -> DataFrame:
    """The rows beside a chain; a single object without a site is for all sites, and no file makes no row."""
    path = sidecar_path(chain_path)
    if not exists(spark, path):
        return spark.createDataFrame([], SIDECAR)
    return spark.read.schema(SIDECAR).option("multiLine", not is_folder(spark, path)).json(path)


def write_csv(df: DataFrame, path: str, by: tuple[str, ...] = (), keep: bool = False) -> None:
    """df as a folder; with ``keep``, only the partitions that df has are replaced."""
    w = df.write.mode("overwrite").option("header", True)
    if not by:
        w.csv(path)
        return
    w.option("partitionOverwriteMode", "dynamic" if keep else "static").partitionBy(*by).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; numbers that JSON doesn't have are an error."""
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    bad = [F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False)) for c in numbers]
    checked = df.withColumns({c: F.when(x, F.raise_error(F.lit(f"{c} isn't a number that JSON has")).cast("double")).otherwise(F.col(c)) for c, x in zip(numbers, bad)}) if numbers else df
    checked.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def has_parts(spark: SparkSession, path: str) -> bool:
    """Whether a folder is one table's parts, not files or folders of sites."""
    store, place = _store(spark, path)
    return any(x.getPath().getName().startswith("part-") for x in store.listStatus(place))


def partitions(spark: SparkSession, path: str, column: str) -> dict:
    """The folders of a written table by their value of a partition column; no table has none."""
    store, place = _store(spark, path)
    found = [x.getPath() for x in store.listStatus(place)] if store.exists(place) else []
    return {unquote(p.getName().partition("=")[2]): p for p in found if p.getName().startswith(f"{column}=")}


def drop_partitions(spark: SparkSession, path: str, column: str, values: set[str]) -> None:
    """Removes the partitions of a written table whose column has one of the values."""
    store, _ = _store(spark, path)
    for value, place in partitions(spark, path, column).items():
        if value in values:
            store.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.getFileStatus(place).isDirectory()


def history_columns(history: DataFrame) -> DataFrame:
    """Evaluations with a column for each parameter, the score and the metrics."""
    return history.select("site", "eval", *[F.col("p")[k].alias(f"par_{k + 1}") for k in range(8)], "eff_index", "nse", "r2", "mae")


def write_history(history: DataFrame, path: str, least: float = 0.0) -> None:
    """Evaluations whose score is at least ``least``."""
    write_csv(history_columns(history).filter(F.col("eff_index") >= least), path)


def best_columns(best: DataFrame) -> DataFrame:
    """Best vectors and scores with six decimals."""
    return best.select("site", *[F.round(F.col("p")[k], 6).alias(f"par_{k + 1}") for k in range(8)], *[F.round(c, 6).alias(c) for c in ("calibration_score", "validation_score") if c in best.columns])


def envelope_columns(bounds: DataFrame) -> DataFrame:
    return bounds.select("site", F.year("d").alias("Year"), F.month("d").alias("Month"), F.dayofmonth("d").alias("Day"), F.col("lower").alias("Twat_mod_lower"), F.col("p50").alias("Twat_mod_p50"), F.col("upper").alias("Twat_mod_upper"))


def output_series(series: DataFrame, resolution: str = "1d", prc: float = 1.0, gap_tolerant: bool = True) -> DataFrame:
    """The output columns of a simulated series, sentinels for nulls. A period's observed and simulated means stand at
    its middle day."""
    number = lambda c: prep.with_sentinel(c)
    periods = metrics.periods(series, resolution, prc, "t_water_sim").select("site", F.col("placed_d").alias("d"), "obs", F.col("sim").alias("sim_agg"))
    gaps = [F.col("t_air_gap").alias("Tair_gap"), F.col("q_gap").alias("Q_gap"), F.coalesce("seg_id", F.lit(-1)).alias("segment_id")] if gap_tolerant else []
    out = series.join(periods, ["site", "d"], "left")
    return out.select("site", "year", "month", "day", number("t_air").alias("Tair"), number("t_water").alias("Twat_obs"), number("t_water_sim").alias("Twat_mod"), number("obs").alias("Twat_obs_agg"), number("sim_agg").alias("Twat_mod_agg"), number("q").alias("Q"), *gaps)


def parameters_text(c: Config) -> str:
    """The bounds that a run searches in."""
    low, high = c.bounds()
    return " ".join(f"{x:.6f}" for x in low) + "\n" + " ".join(f"{x:.6f}" for x in high) + "\n"


#: Which part of a run's name each output has: all of mode, objective, station, series and resolution, or none.
_NAMED = {"history": "0_{run}", "best": "1_{run}", "calibration": "2_{run_c}", "validation": "3_{run_v}", "chain": "MCMC_chain_{series}", "chain_meta": "MCMC_chain_{series}_meta", "envelopes": "MCMC_envelopes_{series}", "forward_envelopes": "Forward_Prediction_Envelopes_{series}"}


class Folder:
    """A folder of outputs. Tables with a site are partitioned by it: of the sites at hand all partitions are replaced,
    those of other sites stay, so a rerun of one site replaces its part alone, and may be repeated."""

    def __init__(self, spark: SparkSession, root: str, sites: list[str]):
        self.spark, self.root, self.sites, self.places, self.names = spark, root, sites, {}, {}
        self.by_site: list[str] = []

    def _place(self, name: str, tail: str) -> str:
        self.places[name] = f"{self.root}/{_NAMED.get(name, name).format(**self.names)}{tail}"
        return self.places[name]

    def _replaced(self, name: str, df: DataFrame, tail: str, kind: str) -> None:
        place = self._place(name, tail)
        drop_partitions(self.spark, place, "site", set(self.sites))
        w = df.write.mode("append").partitionBy("site")
        w.option("header", True).csv(place) if kind == "csv" else w.text(place)
        self.by_site.append(name)

    def csv(self, name: str, df: DataFrame) -> None:
        if "site" in df.columns:
            self._replaced(name, df, ".csv", "csv")
        else:
            write_csv(df, self._place(name, ".csv"))

    def lines(self, name: str, df: DataFrame) -> None:
        """Lines of text (site, value), in their order."""
        self._replaced(name, df, ".txt", "text")

    def chain(self, name: str, chain: DataFrame, sampled: list[int]) -> None:
        write_chain(chain, self._place(name, ".csv"), sampled)
        self.by_site.append(name)

    def json(self, name: str, df: DataFrame) -> None:
        """A row for each site; rows of other sites that are there stay."""
        place = self._place(name, ".json")
        if "site" in df.columns and exists(self.spark, place):
            old = self.spark.read.schema(df.schema).json(place).filter(~F.col("site").isin(self.sites))
            df = written(old.unionByName(df), "rows")
        write_json(df, place)

    def text(self, name: str, text: str) -> None:
        self.spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(self._place(name, ".txt"))

    def _counted(self, name: str) -> DataFrame:
        site, heads = F.col("site").cast("string"), 0 if self.places[name].endswith(".txt") else 1
        lines = self.spark.read.text(self.places[name]).filter(site.isin(self.sites))
        files = lines.groupBy(site.alias("site"), F.col("_metadata.file_path").alias("file")).agg((F.count(F.lit(1)) - heads).alias("n"))
        return files.groupBy("site").agg(F.lit(name).alias("output"), F.sum("n").alias("n_rows"))

    def manifest(self) -> None:
        """The number of rows of each output and site, counted from what was written; outputs without rows aren't listed."""
        if counts := [self._counted(name) for name in self.by_site if partitions(self.spark, self.places[name], "site")]:
            self.csv("manifest", written(reduce(DataFrame.unionByName, counts), "counts"))


class Outputs(Folder):
    """The outputs of a run, under its output folder."""

    def __init__(self, spark: SparkSession, c: Config, sites: list[str]):
        super().__init__(spark, c.output_dir, sites)
        run = lambda tail="": f"{c.mode}_{c.objective}_{c.label}_{c.series}{tail}_{c.resolution}"
        self.names = {"run": run(), "run_c": run("c"), "run_v": run("v"), "series": f"{c.label}_{c.series}_{c.resolution}"}
