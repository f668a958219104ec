"""Queries over the driver tables, each with its SQL.

Two sites are made from the order tables: air temperature from order prices, flow and water temperature from line
items, on a dense calendar with the natural gaps. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.functions import kernels, stats
from fluvia.functions.dates import doy0, water_year, year_fraction
from fluvia.operators import ensembles, metrics, prep, reports, search, uncertainty
from fluvia.operators import simulate as sim
from fluvia.plans import preparation, runs
from fluvia.sources import files, stations
from fluvia.sources.config import Config
from fluvia.sources.scratch import scratch, written

MIN_DAYS, WARMUP_DAYS = 10, 2
P = (0.6, 0.3, 0.45, 0.2, 0.4, 1.5, 0.6, 0.1)
LOW = (0.0, 0.1, 0.3, 0.0, 0.0, 0.0, 0.0, 0.0)
HIGH = (2.0, 0.6, 0.9, 0.5, 1.0, 3.0, 1.0, 0.3)
N_VECTORS = 1000


def _day(c: str):
    return F.to_date(c)


def air(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")).alias("site"), "o_orderdate", (F.col("o_totalprice") / 19997).alias("v"))
    return prep.resample_daily(orders, "o_orderdate", "v", "t_air", keys=("site",))


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("S"), (F.col("l_orderkey") % 2).cast("string")).alias("site"), _day("l_shipdate").alias("d"), "l_discount", "l_quantity")
    out = items.groupBy("site", "d").agg((F.avg("l_discount") * 200).alias("t"), F.sum("l_quantity").alias("q"))
    return out.select("site", "d", F.when(F.dayofmonth("d") % 7 != 0, F.col("t")).alias("t_water"), "q")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.merge([air(spark, sf_dir), water(spark, sf_dir)], ("site", "d"))


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.ordered_columns(prep.complete_calendar(merged(spark, sf_dir)), ("site", "d", "t_air", "t_water", "q"))


def settled(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """The forcing as a written table, for queries that read it more than once; ``since`` a day."""
    m = merged(spark, sf_dir)
    return written(prep.ordered_columns(prep.complete_calendar(m if since is None else m.filter(F.col("d") >= since)), ("site", "d", "t_air", "t_water", "q")), "forcing")


FORCING = """
air AS (SELECT 'S' || (o_custkey % 2) AS site, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice / 19997) AS t_air FROM orders GROUP BY 1, 2),
wat AS (SELECT 'S' || (l_orderkey % 2) AS site, CAST(l_shipdate AS DATE) AS d, avg(l_discount) * 200 AS t, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
merged AS (SELECT coalesce(a.site, w.site) AS site, coalesce(a.d, w.d) AS d, t_air, CASE WHEN day(w.d) % 7 <> 0 THEN t END AS t_water, q FROM air a FULL OUTER JOIN wat w ON a.site = w.site AND a.d = w.d),
span AS (SELECT site, min(d) AS a, max(d) AS b FROM merged GROUP BY site),
cal AS (SELECT site, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM span),
forcing AS (SELECT cal.site, cal.d, t_air, t_water, q FROM cal LEFT JOIN merged m ON cal.site = m.site AND cal.d = m.d)"""


def _islands(valid: str) -> str:
    return f"""
val AS (SELECT *, {valid} AS valid FROM forcing),
isl AS (SELECT *, sum(turn) OVER (PARTITION BY site ORDER BY d) AS block FROM (SELECT *, CASE WHEN lag(valid) OVER w IS NULL OR lag(valid) OVER w <> valid THEN 1 ELSE 0 END AS turn FROM val WINDOW w AS (PARTITION BY site ORDER BY d))),
blk AS (SELECT site, block, valid, min(d) AS start_d, max(d) AS end_d, count(*) AS n_days, count(t_water) AS n_obs FROM isl GROUP BY site, block, valid)"""


WITH_FLOW, WITHOUT_FLOW = "t_air IS NOT NULL AND coalesce(q > 0, false)", "t_air IS NOT NULL"


def _segments(version: int = 8) -> str:
    return (
        _islands(WITH_FLOW if version in kernels.NEEDS_FLOW else WITHOUT_FLOW)
        + f""",
seg AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY start_d) AS seg_id FROM blk WHERE valid AND n_days >= {MIN_DAYS}),
days AS (SELECT i.site, i.d, t_air, t_water, q, seg_id, date_diff('day', start_d, i.d) + 1 AS seg_day, coalesce(date_diff('day', start_d, i.d) + 1 > {WARMUP_DAYS}, false) AS in_eval FROM isl i LEFT JOIN seg s ON i.site = s.site AND i.block = s.block)"""
    )


CLIMATOLOGY = """
doy AS (SELECT site, dayofyear(d) - 1 AS doy0, avg(t_water) AS t FROM forcing GROUP BY 1, 2),
ring AS (SELECT s.site, g.doy0, k.turn, g.doy0 + 366 * k.turn AS x, t FROM (SELECT DISTINCT site FROM forcing) s CROSS JOIN (SELECT unnest(range(366)) AS doy0) g CROSS JOIN (SELECT unnest([-1, 0, 1]) AS turn) k LEFT JOIN doy ON doy.site = s.site AND doy.doy0 = g.doy0),
near AS (SELECT *, last_value(CASE WHEN t IS NOT NULL THEN x END IGNORE NULLS) OVER lo AS x1, last_value(t IGNORE NULLS) OVER lo AS t1, first_value(CASE WHEN t IS NOT NULL THEN x END IGNORE NULLS) OVER hi AS x2, first_value(t IGNORE NULLS) OVER hi AS t2 FROM ring
  WINDOW lo AS (PARTITION BY site ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY site ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
clim AS (SELECT site, doy0, CASE WHEN t IS NOT NULL THEN t ELSE t1 + (t2 - t1) * (x - x1) / (x2 - x1) END AS t FROM near WHERE turn = 0)"""
QMEDIA = "\nqm AS (SELECT site, avg(q) FILTER (WHERE q > 0) AS qmedia, count(*) FILTER (WHERE q > 0) AS n_q FROM forcing GROUP BY site)"
STARTS = "\nst AS (SELECT d.site, seg_id, coalesce(d.t_water, c.t, 4.0) AS tw0 FROM days d LEFT JOIN clim c ON c.site = d.site AND c.doy0 = dayofyear(d.d) - 1 WHERE seg_day = 1)"
TT = "dayofyear({0}) * 1.0 / dayofyear(make_date(year({0}), 12, 31))"


def _fixed(p: tuple[float, ...], version: int) -> str:
    on = kernels.ACTIVE[version]
    return "\npar AS (SELECT 0 AS pid, " + ", ".join(f"{x if k in on else 0.0}::DOUBLE AS p{k + 1}" for k, x in enumerate(p)) + ")"


DESIGN = "\npar AS (SELECT i AS pid, " + ", ".join(f"{lo} + ((i * 7919 + {k} * 104729) % 10007) / 10007.0::DOUBLE * {hi - lo} AS p{k + 1}" for k, (lo, hi) in enumerate(zip(LOW, HIGH))) + f" FROM (SELECT unnest(range({N_VECTORS})) AS i))"


def design(spark: SparkSession) -> DataFrame:
    """A deterministic design of parameter vectors."""
    i = F.col("id")
    return spark.range(N_VECTORS).select(i.alias("param_id"), F.array(*[F.lit(lo) + ((i * 7919 + k * 104729) % 10007) / 10007.0 * (hi - lo) for k, (lo, hi) in enumerate(zip(LOW, HIGH))]).alias("p"))


def _rate(version: int, ta: str, th: str, t: str, tw: str) -> str:
    s = f"p6 * cos(2 * pi() * ({t} - p7))"
    out = f"p1 + p2 * {ta} - p3 * ({tw})"
    if version == 5:
        out += f" + {s}"
    if version in (7, 8):
        out += f" + {th} * (p5 + {s} - p8 * ({tw}))"
    return f"({out}) / pow({th}, p4)" if version in (4, 8) else f"({out})"


def _simulation(version: int, integrator: str, source: str | None = None) -> str:
    """CTEs up to sim(pid, site, seg_id, i, tw); ``source`` has those of fx0 and st, if they aren't the segments'."""
    theta = "q / qmedia" if version in kernels.NEEDS_FLOW else "1.0::DOUBLE"
    base = "SELECT s.*, f.* EXCLUDE (site, seg_id, i), par.* EXCLUDE (pid) FROM sim s JOIN fx f ON f.site = s.site AND f.seg_id = s.seg_id AND f.i = s.i JOIN par ON par.pid = s.pid WHERE f.ta2 IS NOT NULL"
    r = lambda ta, th, t, tw: _rate(version, ta, th, t, tw)
    half = f"{kernels.STEP!r}"
    if integrator == "EUL":
        inner, step = base, f"tw + {r('ta2', 'th2', 'tt2', 'tw')}"
    elif integrator == "RK2":
        inner = f"SELECT *, {r('ta2', 'th2', f'(tt + {half})', 'tw + k1')} AS k2 FROM (SELECT *, {r('ta', 'th', 'tt', 'tw')} AS k1 FROM ({base}))"
        step = "tw + 0.5 * (k1 + k2)"
    elif integrator == "RK4":
        mid = ("(0.5 * (ta + ta2))", "(0.5 * (th + th2))", f"(tt + 0.5 * {half})")
        inner = f"SELECT *, {r('ta', 'th', 'tt', 'tw')} AS k1 FROM ({base})"
        inner = f"SELECT *, {r(*mid, 'tw + 0.5 * k1')} AS k2 FROM ({inner})"
        inner = f"SELECT *, {r(*mid, 'tw + 0.5 * k2')} AS k3 FROM ({inner})"
        inner = f"SELECT *, {r('ta2', 'th2', f'(tt + {half})', 'tw + k3')} AS k4 FROM ({inner})"
        step = "tw + (k1 + 2 * k2 + 2 * k3 + k4) / 6"
    else:
        s1, s2 = "p6 * cos(2 * pi() * (tt - p7))", "p6 * cos(2 * pi() * (tt2 - p7))"
        inner = base
        if version in (3, 5):
            step = f"(tw * (1 - 0.5 * p3) + p1 + 0.5 * p2 * (ta + ta2) + 0.5 * {s1} + 0.5 * {s2}) / (1 + 0.5 * p3)"
        else:
            d1, d2 = "pow(th, p4)", "pow(th2, p4)"
            step = f"(tw + 0.5 / {d1} * (p1 + p2 * ta - p3 * tw + th * (p5 + {s1} - p8 * tw)) + 0.5 / {d2} * (p1 + p2 * ta2 + th2 * (p5 + {s2}))) / (1 + 0.5 * p8 * th2 / {d2} + 0.5 * p3 / {d2})"
    source = f"""{_segments(version)},{CLIMATOLOGY},{QMEDIA},{STARTS},
fx0 AS (SELECT days.site, seg_id, seg_day AS i, d, t_air AS ta, {theta} AS th, {TT.format('d')} AS tt FROM days JOIN qm ON qm.site = days.site WHERE seg_id IS NOT NULL)""" if source is None else source
    return f"""{source},
fx AS (SELECT *, lead(ta) OVER w AS ta2, lead(th) OVER w AS th2, lead(tt) OVER w AS tt2 FROM fx0 WINDOW w AS (PARTITION BY site, seg_id ORDER BY i)),
sim(pid, site, seg_id, i, tw) AS (SELECT pid, site, seg_id, 1::BIGINT, tw0 FROM st CROSS JOIN par UNION ALL SELECT pid, site, seg_id, i + 1, greatest(0.0, {step}) FROM ({inner}))"""


SIM8 = f"{_fixed(P, 8)},{_simulation(8, 'RK4')}"
SIMULATED = SIM8 + ",\nser AS (SELECT f.site, f.d, f.t_air, f.t_water, f.q, d.seg_id, d.seg_day, d.in_eval, s.tw FROM forcing f JOIN days d ON d.site = f.site AND d.d = f.d LEFT JOIN sim s ON s.site = d.site AND s.seg_id = d.seg_id AND s.i = d.seg_day)"


def days(spark: SparkSession, sf_dir: str, version: int = 8) -> DataFrame:
    return sim.prepared(settled(spark, sf_dir), version, MIN_DAYS, WARMUP_DAYS)


def simulated(spark: SparkSession, sf_dir: str, min_days: int = MIN_DAYS, warmup_days: int = WARMUP_DAYS, f: DataFrame | None = None) -> DataFrame:
    """The forcing with segments and the RK4 v8 simulation of the fixed parameters, written."""
    f = settled(spark, sf_dir) if f is None else f
    tw = sim.simulate(sim.prepared(f, 8, min_days, warmup_days), list(P))
    out = f.join(tw, ["site", "d"], "left").withColumn("in_eval", F.coalesce(F.col("seg_day") > warmup_days, F.lit(False)))
    return written(out, "simulated")


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.residuals(simulated(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str, min_days: int = MIN_DAYS, warmup_days: int = WARMUP_DAYS) -> DataFrame:
    """Prepare, find segments, simulate and score every site."""
    return metrics.scores(metrics.periods(simulated(spark, sf_dir, min_days, warmup_days), "1d", 1.0, "tw"))


_FOUND: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(name: str, columns: str, run: Callable[[SparkSession, str], DataFrame], body: str | None, ctes: str = "", base: bool = True, since: str | None = None) -> None:
    """columns: name:kind, with kinds d (double), i (integer), s (as it is)."""
    spec = [c.split(":") for c in columns.split()]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.select(*[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if k == "d" else F.col(c).cast("long") if k == "i" else F.col(c)).alias(c) for c, k in spec])

    _FOUND[name] = query
    if body is not None:
        chosen = ", ".join(f"round({c}::DOUBLE, 6) + 0.0 AS {c}" if k == "d" else f"CAST({c} AS BIGINT) AS {c}" if k == "i" else c for c, k in spec)
        source = FORCING if since is None else FORCING.replace("AND a.d = w.d)", f"AND a.d = w.d WHERE coalesce(a.d, w.d) >= DATE '{since}')")
        parts = ",".join(x for x in (source if base else "", ctes) if x)
        _SQL[name] = (f"WITH RECURSIVE {parts}\n" if parts else "") + f"SELECT {chosen} FROM ({body})"


# sources, projections, joins, sets
_query("src2_resample_daily", "site:s d:s t_air:d", air, "SELECT * FROM air")


def _stations(s: SparkSession, p: str) -> tuple[DataFrame, DataFrame]:
    """The forcing as a folder of station files and read again; some lines have no date, others a word for a number."""
    f = forcing(s, p)
    day = F.dayofmonth("d")
    raw = f.select("site", F.col("q").alias("Discharge"), F.when(day == 14, "no day").otherwise(F.date_format("d", "yyyy-MM-dd")).alias("Date"), F.when(day == 13, "warm").otherwise(F.col("t_air").cast("string")).alias("T_air"), F.coalesce("t_water", F.lit(prep.SENTINEL)).alias("T_water"))
    files.write_csv(raw, path := scratch(s, "stations"), ("site",))
    return stations.read_stations(s, path)


_query("src1_src2_station_folder", "site:s d:s t_air:d t_water:d q:d", lambda s, p: _stations(s, p)[0], "SELECT * FROM forcing WHERE day(d) NOT IN (13, 14)")
_query("src1_rejected_lines", "site:s reason:s n:i", lambda s, p: _stations(s, p)[1].groupBy("site", "reason").agg(F.count(F.lit(1)).alias("n")), "SELECT site, CASE WHEN day(d) = 13 THEN 'no number: T_air' ELSE 'no date' END AS reason, count(*) AS n FROM forcing WHERE day(d) IN (13, 14) GROUP BY ALL")


def _prepared(s: SparkSession, p: str) -> dict[str, str]:
    """Three folders of raw files, air at its own frequency, through the preparation plan."""
    orders = s.read.parquet(f"{p}/orders.parquet")
    air_ = orders.select(F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")).alias("site"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("time"), (F.col("o_totalprice") / 19997).alias("v"))
    places = {name: scratch(s, name) for name in ("air", "water", "flow")}
    files.write_csv(air_, places["air"], ("site",))
    daily = written(water(s, p), "water")
    files.write_csv(daily.select("site", F.col("d").alias("Date"), F.col("t_water").alias("v")), places["water"], ("site",))
    files.write_csv(daily.select("site", F.col("d").alias("Date"), F.col("q").alias("v")), places["flow"], ("site",))
    sources = [preparation.Source(places["air"], "t_air", "v", "time", "yyyy-MM-dd HH:mm:ss"), preparation.Source(places["water"], "t_water", "v", fmt="yyyy-MM-dd"), preparation.Source(places["flow"], "q", "v", fmt="yyyy-MM-dd")]
    return preparation.prepare(s, sources, scratch(s, "prepared"), MIN_DAYS)


_query("pre1_snk10_prepared", "site:s d:s t_air:d t_water:d q:d", lambda s, p: stations.read_stations(s, _prepared(s, p)["merged"])[0], "SELECT * FROM forcing")
_query("pre1_snk10_manifest", "site:s output:s n_rows:i", lambda s, p: s.read.option("header", True).csv(_prepared(s, p)["manifest"]).filter("output IN ('merged', 'blocks', 'summary')"), "SELECT site, 'merged' AS output, count(*) AS n_rows FROM forcing GROUP BY site UNION ALL SELECT site, 'blocks', count(*) FROM blk GROUP BY site UNION ALL SELECT DISTINCT site, 'summary', 1 FROM blk", _islands(WITH_FLOW))
_query("joi1_full_outer_merge", "site:s d:s t_air:d t_water:d q:d", merged, "SELECT * FROM merged")
_query("joi2_dense_calendar", "site:s d:s t_air:d t_water:d q:d", forcing, "SELECT * FROM forcing")
_query(
    "joi1_long_pivot_merge", "d:s click:d error:d purchase:d signup:d view:d",
    lambda s, p: prep.merge_long(s.read.parquet(f"{p}/events.parquet").select(F.to_date("ts").alias("d"), F.col("event_type").alias("name"), "value"), ["click", "error", "purchase", "signup", "view"]),
    "SELECT CAST(ts AS DATE) AS d, " + ", ".join(f"avg(value) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1", base=False,
)
_query(
    "agg1_event_daily_mean", "event_type:s d:s value:d",
    lambda s, p: prep.resample_daily(s.read.parquet(f"{p}/events.parquet"), "ts", "value", "value", keys=("event_type",)),
    "SELECT event_type, CAST(ts AS DATE) AS d, avg(value) AS value FROM events GROUP BY 1, 2", base=False,
)
_query("prj3_parse_or_drop", "d:s v:d", lambda s, p: prep.resample_daily(s.read.parquet(f"{p}/orders.parquet").select(F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("x"), "o_totalprice"), "x", "o_totalprice", "v"), "SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1", base=False)
_query("prj4_sentinel_to_null", "site:s d:s q:d", lambda s, p: forcing(s, p).withColumn("q", prep.nulled(F.when(F.dayofmonth("d") == 3, -999.0).when(F.dayofmonth("d") == 4, 0.0).otherwise(F.col("q")), True)), "SELECT site, d, CASE WHEN day(d) NOT IN (3, 4) AND q > 0 THEN q END AS q FROM forcing")
_query("prj5_null_to_sentinel", "site:s d:s t_water:d", lambda s, p: forcing(s, p).withColumn("t_water", prep.with_sentinel("t_water")), "SELECT site, d, coalesce(t_water, -999.0) AS t_water FROM forcing")
_query("prj6_gap_flags", "site:s d:s t_air_gap:i q_gap:i", lambda s, p: prep.gap_flags(forcing(s, p)), "SELECT site, d, (t_air IS NULL)::INT AS t_air_gap, (q IS NULL)::INT AS q_gap FROM forcing")
_query("prj7_forcing_validity", "site:s d:s v5:s v8:s", lambda s, p: forcing(s, p).select("site", "d", prep.forcing_valid(5).alias("v5"), prep.forcing_valid(8).alias("v8")), f"SELECT site, d, {WITHOUT_FLOW} AS v5, {WITH_FLOW} AS v8 FROM forcing")
_query("prj8_analysis_validity", "site:s d:s ok:s", lambda s, p: forcing(s, p).withColumn("ok", prep.analysis_valid()), f"SELECT site, d, {WITH_FLOW} AS ok FROM forcing")
_query("prj9_drop_warmup", "site:s d:s idx:i", lambda s, p: prep.with_warmup(forcing(s, p)).filter("NOT is_warmup"), "SELECT site, d, row_number() OVER (PARTITION BY site ORDER BY d) + 364 AS idx FROM forcing")
_query("prj10_observed_span", "site:s d:s t_water:d", lambda s, p: reports.observed_span(forcing(s, p)), "SELECT site, d, t_water FROM forcing QUALIFY d BETWEEN min(CASE WHEN t_water IS NOT NULL THEN d END) OVER (PARTITION BY site) AND max(CASE WHEN t_water IS NOT NULL THEN d END) OVER (PARTITION BY site)")
_query("prj12_residual", "site:s d:s residual:d", residuals, "SELECT site, d, tw - t_water AS residual FROM ser", SIMULATED)
_query("prj15_unit_conversion", "site:s d:s c:d", lambda s, p: forcing(s, p).withColumn("c", prep.celsius(F.col("t_air") * 30 + 173.0, 0.1)), "SELECT site, d, CASE WHEN t_air * 30 + 173.0 - 273.15 >= 0.1 THEN t_air * 30 + 173.0 - 273.15 END AS c FROM forcing")
for _g, (_k, _len) in prep.GAPS.items():
    _query(f"prj17_gaps_{_g}", "site:s d:s t_air:d", lambda s, p, g=_g: prep.with_gaps(forcing(s, p), "t_air", g), f"SELECT site, d, CASE WHEN NOT (n // every BETWEEN 1 AND {_k} AND n % every < {_len}) THEN t_air END AS t_air FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d) - 1 AS n, count(*) OVER (PARTITION BY site) // {_k + 1} AS every FROM forcing)")
_query("prj17_gaps_random", "site:s d:s t_air:d", lambda s, p: prep.with_gaps(forcing(s, p), "t_air", "random", 0.05, 3), "SELECT site, d, CASE WHEN CAST('0x' || substr(md5(site || '|' || d || '|3'), 1, 8) AS BIGINT) % 1000000 >= 50000 THEN t_air END AS t_air FROM forcing")
_query("joi3_segment_tagging", "site:s d:s seg_id:i seg_day:i", lambda s, p: prep.with_segments(forcing(s, p), 8, MIN_DAYS, WARMUP_DAYS), "SELECT site, d, seg_id, CASE WHEN seg_id IS NOT NULL THEN seg_day END AS seg_day FROM days", _segments())
_query("win1_joi3_segments_by_range", "site:s d:s seg_id:i seg_day:i in_eval:s", lambda s, p: prep.with_segments(forcing(s, p), 8, MIN_DAYS, WARMUP_DAYS, range_days=prep.RANGE_DAYS), "SELECT site, d, seg_id, CASE WHEN seg_id IS NOT NULL THEN seg_day END AS seg_day, in_eval FROM days", _segments())
_query("win2_islands_by_range", "site:s d:s valid:s block:i", lambda s, p: prep.islands_by_range(forcing(s, p), prep.analysis_valid(), range_days=100), "SELECT site, d, valid, block FROM isl", _islands(WITH_FLOW))


def _intervals(s: SparkSession, p: str) -> DataFrame:
    """An interval for each order, of up to 34 days from its date; some end before they start."""
    o = s.read.parquet(f"{p}/orders.parquet").select("o_orderkey", F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")).alias("site"), _day("o_orderdate").alias("start_d"))
    return prep.within(settled(s, p), o.withColumn("end_d", F.date_add("start_d", (F.col("o_orderkey") % 40 - 5).cast("int"))))


_query("joi3_interval_join", "o_orderkey:i site:s start_d:s end_d:s n_rows:i n_seen:i total:d", _intervals, "SELECT o_orderkey, o.site, start_d, end_d, count(f.d) AS n_rows, count(f.t_water) AS n_seen, sum(f.t_water) AS total FROM (SELECT o_orderkey, 'S' || (o_custkey % 2) AS site, CAST(o_orderdate AS DATE) AS start_d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INT) AS end_d FROM orders) o LEFT JOIN forcing f ON f.site = o.site AND f.d BETWEEN start_d AND end_d GROUP BY ALL")
_query("joi6_start_values", "site:s seg_id:i tw0:d", lambda s, p: prep.start_values(prep.with_segments(f := settled(s, p), 8, MIN_DAYS), prep.climatology(f)), "SELECT * FROM st", f"{_segments()},{CLIMATOLOGY},{STARTS}")
_FOLDS = """
yrs AS (SELECT DISTINCT site, year(d) AS year FROM forcing),
rk AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY year) - 1 AS r FROM yrs),
fo AS (SELECT *, CAST(floor((r - 1) / 2) AS INT) AS fold FROM rk WHERE r >= 1),
fold AS (SELECT *, min(year) OVER w || '-' || max(year) OVER w AS label FROM fo WINDOW w AS (PARTITION BY site, fold) QUALIFY count(*) OVER w = 2)"""
_query("joi4_held_out_days", "site:s d:s", lambda s, p: prep.held_out(f := settled(s, p), prep.folds(f, 2), 0), "SELECT site, d FROM forcing f WHERE EXISTS (SELECT 1 FROM fold WHERE fold.site = f.site AND fold.year = year(f.d) AND fold = 0)", _FOLDS)
_query("joi5_training_days", "site:s d:s", lambda s, p: prep.training(f := settled(s, p), prep.folds(f, 2), 0), "SELECT site, d FROM forcing f WHERE NOT EXISTS (SELECT 1 FROM fold WHERE fold.site = f.site AND fold.year = year(f.d) AND fold = 0)", _FOLDS)
_query("set1_warmup_year", "site:s idx:i d:s t_air:d tt:d is_warmup:s", lambda s, p: prep.with_warmup(forcing(s, p)), f"SELECT site, n + 365 AS idx, d, t_air, {TT.format('d')} AS tt, false AS is_warmup FROM x UNION ALL SELECT site, n, NULL, t_air, (n + 1) / 365.0::DOUBLE, true FROM x WHERE n < 365", "\nx AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d) - 1 AS n FROM forcing)")
_query("smp1_k_rows", "sample_id:i v:d", lambda s, p: uncertainty.sampled(s.read.parquet(f"{p}/orders.parquet").select(F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("v")), 100, 7), "SELECT o_orderkey AS sample_id, o_totalprice AS v FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100", base=False)

# constraints and counts
_query("val2_val6_checks", "site:s starts_jan_1:s is_daily:s is_complete:s has_a_year:s", lambda s, p: prep.checks(forcing(s, p)), "SELECT site, month(min(d)) = 1 AND day(min(d)) = 1 AS starts_jan_1, count(*) = count(DISTINCT d) AND count(*) = date_diff('day', min(d), max(d)) + 1 AS is_daily, count(*) FILTER (WHERE t_air IS NULL OR q IS NULL) = 0 AS is_complete, count(*) >= 365 AS has_a_year FROM forcing GROUP BY site")
_query("agg2_missing", "site:s n:i t_air_missing:i t_water_missing:i q_missing:i t_air_percent:d t_water_percent:d q_percent:d", lambda s, p: prep.missing(forcing(s, p)), "SELECT site, count(*) AS n, count(*) - count(t_air) AS t_air_missing, count(*) - count(t_water) AS t_water_missing, count(*) - count(q) AS q_missing, 100.0 * (count(*) - count(t_air)) / count(*) AS t_air_percent, 100.0 * (count(*) - count(t_water)) / count(*) AS t_water_percent, 100.0 * (count(*) - count(q)) / count(*) AS q_percent FROM forcing GROUP BY site")
_BLOCK_KIND = f"CASE WHEN NOT valid THEN 'gap' WHEN n_days >= {MIN_DAYS} THEN 'valid' ELSE 'short' END"
_query("agg3_blocks", "site:s kind:s start_d:s end_d:s n_days:i n_obs:i", lambda s, p: prep.block_table(forcing(s, p), MIN_DAYS), f"SELECT *, {_BLOCK_KIND} AS kind FROM blk", _islands(WITH_FLOW))
_query("agg4_pre1_summary", "site:s n_valid:i n_short:i n_gap:i valid_days:i valid_obs:i obs_per_parameter_v3:d obs_per_parameter_v8:d", lambda s, p: prep.analysis_summary(forcing(s, p), MIN_DAYS), "SELECT site, count(*) FILTER (WHERE kind = 'valid') AS n_valid, count(*) FILTER (WHERE kind = 'short') AS n_short, count(*) FILTER (WHERE kind = 'gap') AS n_gap, coalesce(sum(n_days) FILTER (WHERE kind = 'valid'), 0) AS valid_days, coalesce(sum(n_obs) FILTER (WHERE kind = 'valid'), 0) AS valid_obs, coalesce(sum(n_obs) FILTER (WHERE kind = 'valid'), 0) / 3.0 AS obs_per_parameter_v3, coalesce(sum(n_obs) FILTER (WHERE kind = 'valid'), 0) / 8.0 AS obs_per_parameter_v8 FROM kinds GROUP BY site", f"{_islands(WITH_FLOW)},\nkinds AS (SELECT *, {_BLOCK_KIND} AS kind FROM blk)")
_query("agg5_qmedia", "site:s qmedia:d n_q:i", lambda s, p: prep.qmedia(forcing(s, p)), "SELECT * FROM qm", QMEDIA)
_query("agg6_win8_climatology", "site:s doy0:i t:d", lambda s, p: prep.climatology(forcing(s, p)), "SELECT * FROM clim", CLIMATOLOGY)
_query("win1_segments", "site:s seg_id:i start_d:s end_d:s n_days:i n_obs:i", lambda s, p: prep.segment_table(prep.with_segments(forcing(s, p), 8, MIN_DAYS)), "SELECT * FROM seg", _segments())
_query("win1_segment_warnings", "site:s n_short:i many:s", lambda s, p: prep.segment_warnings(prep.segment_table(prep.with_segments(forcing(s, p), 8, MIN_DAYS))), "SELECT site, count(*) FILTER (WHERE n_days < 365) AS n_short, count(*) > 2 AS many FROM seg GROUP BY site", _segments())
_query("win3_eval_mask", "site:s d:s in_eval:s", lambda s, p: prep.with_segments(forcing(s, p), 8, MIN_DAYS, WARMUP_DAYS), "SELECT site, d, in_eval FROM days", _segments())
_query("win4_midpoints", "site:s d:s mid:d", lambda s, p: forcing(s, p).withColumn("mid", prep.midpoints("t_air")), "SELECT site, d, (t_air + lead(t_air) OVER (PARTITION BY site ORDER BY d)) / 2 AS mid FROM forcing")
_query("win7_rolling_mean", "site:s d:s m:d", lambda s, p: forcing(s, p).withColumn("m", reports.rolling_mean("t_air")), "SELECT site, d, avg(t_air) OVER (PARTITION BY site ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM forcing")
_query("win10_folds", "site:s year:i fold:i label:s", lambda s, p: prep.folds(forcing(s, p), 2), "SELECT * FROM fold", _FOLDS)
_query("dt5_dt6_dt7_dates", "site:s d:s tt:d doy0:i wy:i", lambda s, p: forcing(s, p).select("site", "d", year_fraction(F.col("d")).alias("tt"), doy0(F.col("d")).alias("doy0"), water_year(F.col("d"), 10).alias("wy")), f"SELECT site, d, {TT.format('d')} AS tt, dayofyear(d) - 1 AS doy0, year(d) + (month(d) >= 10)::INT AS wy FROM forcing")
_query("agg32_years", "site:s year:i", lambda s, p: prep.years(forcing(s, p)), "SELECT DISTINCT site, year(d) AS year FROM forcing")

# right-hand sides, integrators
for _v in (3, 4, 5, 7, 8):
    def _ode(s, p, v=_v):
        f = sim.with_moments(forcing(s, p), F.col("t_water"), F.col("q"))
        theta = F.col("q") / F.col("qmedia") if v in kernels.NEEDS_FLOW else F.lit(1.0)
        return sim.rates(f.withColumns({"theta": theta, "tt": year_fraction(F.col("d")), "tw": F.coalesce("t_water", F.lit(4.0))}), list(P), v)

    _query(f"ode{_v}_rate", "site:s d:s rate:d", _ode, f"SELECT f.site, d, {_rate(_v, 't_air', '(q / qmedia)', '(' + TT.format('d') + ')', 'coalesce(t_water, 4.0)')} AS rate FROM forcing f JOIN qm ON qm.site = f.site CROSS JOIN par", f"{QMEDIA},{_fixed(P, _v)}")
    for _i in kernels.INTEGRATORS:
        _query(f"int_{_i.lower()}_v{_v}", "site:s seg_id:i seg_day:i tw:d", lambda s, p, v=_v, i=_i: sim.simulate(days(s, p, v), list(P), v, i), "SELECT site, seg_id, i AS seg_day, tw FROM sim", f"{_fixed(P, _v)},{_simulation(_v, _i)}")

# periods, scores, reports
_STATS = "stat AS (SELECT site, count(*) AS n_dat, avg(obs) AS mean_obs, var_pop(obs) * count(*) AS tss_obs, CASE WHEN count(*) > 1 THEN stddev_samp(obs) ELSE 0 END AS std_obs FROM per GROUP BY site)"
_DAILY = SIMULATED + ",\nper AS (SELECT site, d AS period, t_water AS obs, CASE WHEN in_eval THEN tw END AS sim FROM ser WHERE t_water IS NOT NULL),\n" + _STATS
_SCORES = """SELECT site, n, CASE WHEN tss_obs = 0 THEN CASE WHEN sse = 0 THEN 1 ELSE -1e30 END ELSE 1 - sse / tss_obs END AS nse, CASE WHEN tss_obs = 0 OR tss_sim = 0 THEN -999 ELSE pow(sso / sqrt(tss_sim * tss_obs), 2) END AS r2, mae,
  CASE WHEN n < 2 OR std_sim = 0 OR std_obs = 0 THEN -999 ELSE 1 - sqrt(pow(std_sim / std_obs - 1, 2) + pow(mean_sim / mean_obs - 1, 2) + pow(sso / (n - 1) / (std_sim * std_obs) - 1, 2)) END AS kge, -sqrt(sse / n) AS rms, 1 - sse / tss_valid AS nse_valid
FROM (SELECT p.site, count(*) AS n, sum((sim - obs) * (sim - obs)) AS sse, avg(abs(sim - obs)) AS mae, covar_pop(sim, obs) * count(*) AS sso, var_pop(sim) * count(*) AS tss_sim, avg(sim) AS mean_sim, stddev_samp(sim) AS std_sim, var_pop(obs) * count(*) AS tss_valid FROM per p WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY p.site) JOIN stat USING (site)"""
_query("agg11_15_scores_daily", "site:s n:i nse:d r2:d mae:d kge:d rms:d nse_valid:d", flagship, _SCORES, _DAILY)
_query("agg9_statis", "site:s n_dat:i mean_obs:d tss_obs:d std_obs:d", lambda s, p: metrics.observed_stats(metrics.periods(forcing(s, p))), "SELECT * FROM stat", "\nper AS (SELECT site, t_water AS obs FROM forcing WHERE t_water IS NOT NULL),\n" + _STATS)


def _period_sql(resolution: str, prc: float) -> str:
    n, unit = int(resolution[:-1]), resolution[-1]
    if unit == "w":
        key = f"a + CAST(floor(date_diff('day', a, ser.d) / {7 * n}) AS INT) * {7 * n}"
        full, place = f"{7 * n}", f"least(period + {-(-7 * n // 2) - 1}, last_d)"
    else:
        key = "make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 AS INT) + 1, 1)"
        full, place = "n_days", "last_d - CAST(floor(n_days / 2) AS INT)"
    m = f"CAST(floor((year(d) * 12 + month(d) - 1) / {n}) AS BIGINT) * {n}" if unit == "m" else "0"
    return f"""
keyed AS (SELECT ser.*, {key} AS period FROM (SELECT *, {m} AS m FROM ser) ser JOIN span ON span.site = ser.site),
per0 AS (SELECT site, period, count(t_water) AS n_obs, count(*) AS n_days, avg(t_water) AS obs, avg(CASE WHEN t_water IS NOT NULL AND in_eval THEN tw END) AS sim, max(d) AS last_d FROM keyed GROUP BY site, period),
per AS (SELECT *, {place} AS placed_d FROM per0 WHERE n_obs >= greatest({full} * {prc}, 1)),
""" + _STATS


for _r, _prc in (("1w", 0.5), ("2w", 0.6), ("1m", 0.7), ("3m", 0.5)):
    _query(f"agg8_periods_{_r}", "site:s period:s n_obs:i n_days:i obs:d sim:d placed_d:s", lambda s, p, r=_r, c=_prc: metrics.periods(simulated(s, p), r, c, "tw"), "SELECT * FROM per", SIMULATED + "," + _period_sql(_r, _prc))
    _query(f"agg10_15_scores_{_r}", "site:s n:i nse:d r2:d mae:d kge:d rms:d", lambda s, p, r=_r, c=_prc: metrics.scores(metrics.periods(simulated(s, p), r, c, "tw")), _SCORES, SIMULATED + "," + _period_sql(_r, _prc))
_query("agg16_fold_scores", "site:s year:i n_obs:i nse:d kge:d rmse:d", lambda s, p: metrics.fold_scores(simulated(s, p).select("site", F.year("d").alias("year"), F.col("t_water").alias("obs"), F.col("tw").alias("sim")), ("site", "year")), "SELECT site, year(d) AS year, count(*) AS n_obs, 1 - sum((tw - t_water) * (tw - t_water)) / (var_pop(t_water) * count(*)) AS nse, 1 - sqrt(pow(corr(tw, t_water) - 1, 2) + pow(stddev_pop(tw) / stddev_pop(t_water) - 1, 2) + pow(avg(tw) / avg(t_water) - 1, 2)) AS kge, sqrt(avg((tw - t_water) * (tw - t_water))) AS rmse FROM ser WHERE tw IS NOT NULL AND t_water IS NOT NULL GROUP BY 1, 2", SIMULATED)
_query("agg18_goodness_of_fit", "site:s n:i rmse:d mae:d r2:d aic:d bic:d", lambda s, p: metrics.goodness_of_fit(simulated(s, p).select("site", F.col("t_water").alias("obs"), F.col("tw").alias("sim")), 8), "SELECT site, n, sqrt(sse / n) AS rmse, mae, 1 - sse / tss AS r2, n * ln(sse / n) + 16 AS aic, n * ln(sse / n) + 8 * ln(n) AS bic FROM (SELECT site, count(*) AS n, sum((tw - t_water) * (tw - t_water)) AS sse, avg(abs(tw - t_water)) AS mae, var_pop(t_water) * count(*) AS tss FROM ser WHERE tw IS NOT NULL AND t_water IS NOT NULL GROUP BY site)", SIMULATED)
_query("agg22_ar1_rho", "site:s n_pairs:i rho:d", lambda s, p: uncertainty.ar1_rho(residuals(s, p).filter("in_eval")), "SELECT site, count(b) AS n_pairs, CASE WHEN count(b) >= 30 THEN greatest(0, least(0.99, corr(b, r))) ELSE 0 END AS rho FROM (SELECT site, tw - t_water AS r, CASE WHEN tw - t_water IS NOT NULL AND d - lag(d) OVER w = 1 THEN lag(tw - t_water) OVER w END AS b FROM ser WHERE in_eval WINDOW w AS (PARTITION BY site, seg_id ORDER BY d)) GROUP BY site", SIMULATED)
_query("agg23_24_likelihood_sigma", "site:s n:i log_p:d sigma:d", lambda s, p: reports.residual_sigma(residuals(s, p).filter("in_eval")).withColumn("log_p", metrics.log_likelihood(F.col("sse"), F.col("n"))), "SELECT site, count(*) AS n, -0.5 * count(*) * ln(sum(r * r) / count(*)) AS log_p, sqrt(sum(r * r) / count(*)) AS sigma FROM (SELECT site, tw - t_water AS r FROM ser WHERE in_eval) WHERE r IS NOT NULL GROUP BY site", SIMULATED)
_query("agg27_histogram", "site:s bin:i n:i", lambda s, p: reports.histogram(forcing(s, p), "q"), "SELECT site, CASE WHEN b > a THEN least(floor((q - a) / ((b - a) / 30)), 29) ELSE 0 END AS bin, count(*) AS n FROM (SELECT f.site, q, min(q) OVER (PARTITION BY f.site) AS a, max(q) OVER (PARTITION BY f.site) AS b FROM forcing f) WHERE q IS NOT NULL GROUP BY 1, 2")


def _horner(table: tuple, r: str) -> str:
    above, below = (reduce(lambda acc, c: f"({acc} * {r} + {c!r}::DOUBLE)", x[1:], f"{x[0]!r}::DOUBLE") for x in table)
    return f"{above} / {below}"


_PROBIT = f"CASE WHEN abs(m - 0.5) <= 0.425 THEN (m - 0.5) * {_horner(stats.MIDDLE, '(0.180625 - (m - 0.5) * (m - 0.5))')} ELSE sign(m - 0.5) * CASE WHEN r <= 5 THEN {_horner(stats.TAIL, '(r - 1.6)')} ELSE {_horner(stats.FAR, '(r - 5)')} END END"
_query("agg28_normal_quantiles", "site:s i:i ordered:d theoretical:d", lambda s, p: reports.normal_quantiles(residuals(s, p), "residual"), f"SELECT site, i, ordered, {_PROBIT} AS theoretical FROM (SELECT *, sqrt(-ln(least(m, 1 - m))) AS r FROM (SELECT *, CASE WHEN n = 1 THEN 0.5 WHEN i = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS m FROM (SELECT site, tw - t_water AS ordered, row_number() OVER (PARTITION BY site ORDER BY tw - t_water) AS i, count(*) OVER (PARTITION BY site) AS n FROM ser WHERE tw - t_water IS NOT NULL)))", SIMULATED)
_query("agg29_autocorrelation", "site:s lag:i acf:d", lambda s, p: reports.autocorrelation(residuals(s, p), "residual"), "SELECT x.site, y.rn - x.rn AS lag, sum(x.x * y.x) / any_value(t.t) AS acf FROM x JOIN x y ON y.site = x.site AND y.rn >= x.rn JOIN (SELECT site, sum(x * x) AS t FROM x GROUP BY site) t ON t.site = x.site GROUP BY 1, 2", SIMULATED + ",\nx AS (SELECT site, r - avg(r) OVER (PARTITION BY site) AS x, row_number() OVER (PARTITION BY site ORDER BY d) AS rn FROM (SELECT site, d, tw - t_water AS r FROM ser WHERE tw - t_water IS NOT NULL))")


def _output(s: SparkSession, p: str, since: str | None = None, resolution: str = "1d", prc: float = 1.0) -> DataFrame:
    f = settled(s, p, since)
    tw = sim.simulate(sim.prepared(f, 8, MIN_DAYS, WARMUP_DAYS), list(P))
    series = sim.series(f, tw).withColumn("in_eval", F.coalesce(F.col("seg_day") > WARMUP_DAYS, F.lit(False)))
    return files.output_series(written(series, "series"), resolution, prc)


_SERIES = "SELECT ser.site, year(ser.d) AS year, month(ser.d) AS month, day(ser.d) AS day, coalesce(t_air, -999) AS Tair, coalesce(t_water, -999) AS Twat_obs, coalesce(tw, -999) AS Twat_mod, coalesce(per.obs, -999) AS Twat_obs_agg, coalesce(per.sim, -999) AS Twat_mod_agg, coalesce(q, -999) AS Q, (t_air IS NULL)::INT AS Tair_gap, (q IS NULL)::INT AS Q_gap, CASE WHEN tw IS NULL THEN -1 ELSE seg_id END AS segment_id FROM ser LEFT JOIN per ON per.site = ser.site AND per."
_SERIES_COLUMNS = "site:s year:i month:i day:i Tair:d Twat_obs:d Twat_mod:d Twat_obs_agg:d Twat_mod_agg:d Q:d Tair_gap:i Q_gap:i segment_id:i"
_query("snk4_output_series", _SERIES_COLUMNS, _output, _SERIES + "period = ser.d", _DAILY)
_query("snk4_output_series_1m", _SERIES_COLUMNS, lambda s, p: _output(s, p, None, "1m", 0.7), _SERIES + "placed_d = ser.d", SIMULATED + "," + _period_sql("1m", 0.7))
_query("snk5_validation_series", _SERIES_COLUMNS, lambda s, p: _output(s, p, "1998-07-01", "1w", 0.5), _SERIES + "placed_d = ser.d", SIMULATED + "," + _period_sql("1w", 0.5), since="1998-07-01")
_query("prj11_combined_simulation", "site:s d:s t:d", lambda s, p: (x := simulated(s, p)).join(metrics.periods(x, "1w", 0.5, "tw").select("site", F.col("placed_d").alias("d"), "sim"), ["site", "d"], "left").withColumn("t", reports.combined("sim", "tw")), "SELECT ser.site, ser.d, coalesce(per.sim, ser.tw) AS t FROM ser LEFT JOIN per ON per.site = ser.site AND per.placed_d = ser.d", SIMULATED + "," + _period_sql("1w", 0.5))
_query("snk6_gap_summary", "site:s qmedia:d n_days:i t_air_missing:i t_air_share:d q_missing:i q_share:d n_segments:i valid_days:i n_obs:i", lambda s, p: reports.gap_summary(forcing(s, p), 8, MIN_DAYS), "SELECT f.site, any_value(qmedia) AS qmedia, count(*) AS n_days, count(*) - count(f.t_air) AS t_air_missing, 1 - count(f.t_air) / count(*) AS t_air_share, count(*) - count(f.q) AS q_missing, 1 - count(f.q) / count(*) AS q_share, count(DISTINCT seg_id) AS n_segments, count(seg_id) AS valid_days, count(f.t_water) AS n_obs FROM forcing f JOIN days ON days.site = f.site AND days.d = f.d JOIN qm ON qm.site = f.site GROUP BY f.site", f"{_segments()},{QMEDIA}")



def _forward(s: SparkSession, p: str) -> DataFrame:
    return runs.best_of(settled(s, p), Config(mode="FORWARD", parameters=P, gap_tolerant=True, min_days=MIN_DAYS, warmup_days=WARMUP_DAYS))


_query("fwd1_forward_score", "site:s score:d", _forward, f"SELECT site, nse AS score FROM ({_SCORES})", _DAILY)

# many evaluations
_MANY = f"{DESIGN},{_simulation(8, 'RK4')},\nens AS (SELECT pid, s.site, s.seg_id, s.i, d.d, tw, t_water, in_eval FROM sim s JOIN days d ON d.site = s.site AND d.seg_id = s.seg_id AND d.seg_day = s.i)"
_MANY_SCORES = """SELECT e.site, pid AS param_id, count(*) AS n, 1 - sum((tw - t_water) * (tw - t_water)) / any_value(tss) AS nse, pow(covar_pop(tw, t_water) * count(*), 2) / (var_pop(tw) * count(*) * any_value(tss)) AS r2, avg(abs(tw - t_water)) AS mae,
  1 - sqrt(pow(stddev_samp(tw) / any_value(std) - 1, 2) + pow(avg(tw) / any_value(mean) - 1, 2) + pow(covar_samp(tw, t_water) / (stddev_samp(tw) * any_value(std)) - 1, 2)) AS kge, -sqrt(avg((tw - t_water) * (tw - t_water))) AS rms
FROM ens e JOIN (SELECT site, var_pop(t_water) * count(t_water) AS tss, avg(t_water) AS mean, stddev_samp(t_water) AS std FROM forcing GROUP BY site) t ON t.site = e.site WHERE in_eval AND t_water IS NOT NULL GROUP BY e.site, pid"""
_query("joi7_score_design", "site:s param_id:i n:i nse:d r2:d mae:d kge:d rms:d", lambda s, p: sim.score_many(days(s, p), design(s)), _MANY_SCORES, _MANY)
_query("opt1_agg30_best_of_design", "site:s param_id:i nse:d", lambda s, p: sim.best(sim.score_many(days(s, p), design(s))), f"SELECT site, arg_max(param_id, nse) AS param_id, max(nse) AS nse FROM ({_MANY_SCORES}) GROUP BY site", _MANY)
_query("win6_running_best", "site:s param_id:i best_nse:d best_r2:d best_mae:d", lambda s, p: reports.running_best(sim.score_many(days(s, p), design(s)), "param_id", ("site",)), f"SELECT site, param_id, max(nse) OVER w AS best_nse, max(r2) OVER w AS best_r2, min(mae) OVER w AS best_mae FROM ({_MANY_SCORES}) WINDOW w AS (PARTITION BY site ORDER BY param_id)", _MANY)
_query("prj13_acceptable", "site:s param_id:i nse:d", lambda s, p: reports.acceptable(sim.score_many(days(s, p), design(s)), "NSE", "nse", -5.0), f"SELECT * FROM (SELECT *, bool_or(nse >= -5) OVER () AS any_good FROM ({_MANY_SCORES})) WHERE nse >= -5 OR NOT any_good", _MANY)
_query("agg21_fwd2_envelope", "site:s d:s lower:d p50:d upper:d", lambda s, p: ensembles.daily_percentiles(days(s, p), design(s)), "SELECT site, d, quantile_cont(tw, 0.05) AS lower, quantile_cont(tw, 0.5) AS p50, quantile_cont(tw, 0.95) AS upper FROM ens GROUP BY site, d", _MANY)
_query("joi8_prj16_masked_envelope", "site:s d:s lower:d upper:d", lambda s, p: reports.masked_envelope(ensembles.daily_percentiles(sim.prepared(f := settled(s, p), 8, MIN_DAYS, WARMUP_DAYS), design(s)), simulated(s, p, f=f).select("site", "d", F.col("tw").alias("t_water_sim"))), "SELECT f.site, f.d, lower, upper FROM forcing f LEFT JOIN (SELECT site, d, quantile_cont(tw, 0.05) AS lower, quantile_cont(tw, 0.95) AS upper FROM ens GROUP BY site, d) e ON e.site = f.site AND e.d = f.d", _MANY)
_query("win7_rolling_envelope", "site:s d:s lower:d p50:d upper:d", lambda s, p: ensembles.daily_percentiles(days(s, p), design(s), rolling=7), "SELECT site, d, quantile_cont(m, 0.05) AS lower, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.95) AS upper FROM (SELECT site, d, avg(tw) OVER (PARTITION BY site, pid ORDER BY d RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS m FROM ens) GROUP BY site, d", _MANY)


def _site_chains(s: SparkSession, p: str) -> DataFrame:
    """Every order is a sample of its site's chain, which is stored with a sidecar and read again: percentiles of 1000
    samples of each site, with the correlation that its sidecar has."""
    o = s.read.parquet(f"{p}/orders.parquet").withColumn("site", F.concat(F.lit("S"), (F.col("o_custkey") % 2).cast("string")))
    vector = F.array(*[F.lit(lo) + ((F.col("o_orderkey") * 7919 + k * 104729) % 10007) / 10007.0 * (hi - lo) for k, (lo, hi) in enumerate(zip(LOW, HIGH))])
    path = scratch(s, "site-chains")
    files.write_chain(o.select("site", F.col("o_orderkey").alias("sample_id"), vector.alias("p")), path, list(range(8)))
    files.write_json(o.groupBy("site").agg((F.sum(F.col("o_orderkey") % 100) / F.count(F.lit(1)) / 100).alias("rho")), files.sidecar_path(path))
    d = days(s, p)
    best = d.select("site").distinct()
    bounds = uncertainty.site_intervals(d, runs.stored_chain(s, path, best, Config(parameters=P)), n=1000, seed=7)
    rho = runs.forward_rho(best, s.createDataFrame([], "site string, n_pairs long, rho double"), files.read_sidecar(s, path), None)
    return bounds.join(rho, "site")


_SITE_PAR = "\nchain AS (SELECT 'S' || (o_custkey % 2) AS psite, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 2 ORDER BY md5('7:' || o_orderkey), o_orderkey) AS n FROM orders QUALIFY n <= 1000),\npar AS (SELECT psite, o_orderkey AS pid, " + ", ".join(f"{lo} + ((o_orderkey * 7919 + {k} * 104729) % 10007) / 10007.0::DOUBLE * {hi - lo} AS p{k + 1}" for k, (lo, hi) in enumerate(zip(LOW, HIGH))) + " FROM chain)"
_query("fwd2_fwd3_site_chains", "site:s d:s lower:d p50:d upper:d rho:d", _site_chains, "SELECT e.site, d, quantile_cont(tw, 0.05) AS lower, quantile_cont(tw, 0.5) AS p50, quantile_cont(tw, 0.95) AS upper, any_value(r.rho) AS rho FROM ens e JOIN chain ON chain.o_orderkey = e.pid AND chain.psite = e.site JOIN (SELECT 'S' || (o_custkey % 2) AS site, sum(o_orderkey % 100) / count(*) / 100 AS rho FROM orders GROUP BY 1) r ON r.site = e.site GROUP BY e.site, d", f"{_SITE_PAR},{_MANY.removeprefix(DESIGN + ',')}")
_CHAIN_OF = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of four parameters: a sample for each line item, its line number the step."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"), F.col("l_linenumber").alias("step"), F.array(*[F.col(c).cast("double") for c in _CHAIN_OF]).alias("p"))


_CHAIN = " UNION ALL ".join(f"SELECT {k} AS parameter, {c}::DOUBLE AS v FROM lineitem" for k, c in enumerate(_CHAIN_OF, 1))
_query("agg19_posterior_summary", "parameter:i mean:d std:d low:d high:d significant:s", lambda s, p: reports.posterior_summary(chain(s, p)), f"SELECT parameter, avg(v) AS mean, stddev_samp(v) AS std, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS significant FROM ({_CHAIN}) GROUP BY parameter", base=False)
_query("agg20_parameter_correlation", "a:i b:i r:d", lambda s, p: reports.parameter_correlation(chain(s, p), 4), " UNION ALL ".join(f"SELECT {i} AS a, {j} AS b, corr({x}, {y}) AS r FROM lineitem" for i, x in enumerate(_CHAIN_OF, 1) for j, y in enumerate(_CHAIN_OF, 1)), base=False)


def _perturbed(percent: float) -> list[tuple[list[float], list[float], float]]:
    """For each parameter the vectors below and above P, and the relative difference."""
    out = []
    for k, (x, lo, hi) in enumerate(zip(P, LOW, HIGH)):
        down, up = max(lo, x - abs(x) * percent / 100), min(hi, x + abs(x) * percent / 100)
        out.append(([*P[:k], down, *P[k + 1 :]], [*P[:k], up, *P[k + 1 :]], (up - down) / abs(x)))
    return out


_SENS = _perturbed(1.0)
_SENS_PAR = "\npar AS (" + " UNION ALL ".join(f"SELECT {2 * k + side} AS pid, " + ", ".join(f"{x!r}::DOUBLE AS p{j + 1}" for j, x in enumerate(r[side])) for k, r in enumerate(_SENS) for side in (0, 1)) + ")"
_SENS_MANY = f"{_SENS_PAR},{_MANY.removeprefix(DESIGN + ',')}"
_SENS_BODY = "SELECT x.site, r.parameter, avg(a - b) / any_value(r.relative) AS sensitivity, 'Active' AS status FROM (SELECT site, pid // 2 AS run, seg_id, i, max(tw) AS a, min(tw) AS b FROM ens WHERE in_eval AND t_water IS NOT NULL GROUP BY ALL) x JOIN (VALUES " + ", ".join(f"({k}, {k + 1}, {r[2]!r}::DOUBLE)" for k, r in enumerate(_SENS)) + ") r(run, parameter, relative) ON r.run = x.run WHERE a < 50 GROUP BY 1, 2"
_query("sen1_agg25_sensitivity", "site:s parameter:i sensitivity:d status:s", lambda s, p: uncertainty.sensitivity(written(days(s, p), "days"), list(P), list(LOW), list(HIGH)), _SENS_BODY, _SENS_MANY)
_query("joi9_sensitivity_columns", "site:s parameter:i sensitivity_1:d", lambda s, p: reports.sensitivity_columns(uncertainty.sensitivity(written(days(s, p), "days"), list(P), list(LOW), list(HIGH)), (1.0,)), f"SELECT site, parameter, sensitivity AS sensitivity_1 FROM ({_SENS_BODY})", _SENS_MANY)
_query("noi2_ar1_noise", "site:s seg_id:i seg_day:i noise:d", lambda s, p: uncertainty.ar1_noise(prep.with_segments(forcing(s, p), 8, MIN_DAYS).filter("seg_id IS NOT NULL"), 0.8, 0.6, z=(F.col("seg_day") * 7919 + F.col("seg_id") * 104729) % 10007 / 10007.0 - 0.5), "SELECT site, seg_id, i AS seg_day, y AS noise FROM n", _segments() + ",\nz AS (SELECT site, seg_id, seg_day AS i, (seg_day * 7919 + seg_id * 104729) % 10007 / 10007.0::DOUBLE - 0.5 AS z FROM days WHERE seg_id IS NOT NULL),\nn(site, seg_id, i, y) AS (SELECT site, seg_id, i, 0.8 * z FROM z WHERE i = 1 UNION ALL SELECT n.site, n.seg_id, z.i, 0.6 * n.y + 0.8 * sqrt(1 - 0.36::DOUBLE) * z.z FROM n JOIN z ON z.site = n.site AND z.seg_id = n.seg_id AND z.i = n.i + 1)")
_query("noi1_iid_noise", "site:s d:s noise:d", lambda s, p: uncertainty.iid_noise(forcing(s, p), 0.8, 5), "SELECT site, d, 0.8 * sqrt(-2 * ln(u0)) * cos(2 * pi() * u1) AS noise FROM (SELECT site, d, (CAST('0x' || substr(md5('5|0|' || site || '|' || d), 1, 13) AS BIGINT) + 0.5::DOUBLE) * pow(2::DOUBLE, -52) AS u0, (CAST('0x' || substr(md5('5|1|' || site || '|' || d), 1, 13) AS BIGINT) + 0.5::DOUBLE) * pow(2::DOUBLE, -52) AS u1 FROM forcing)")
_query("set3_burn_in", "sample_id:i step:i", lambda s, p: reports.burned(chain(s, p), 7), "SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_linenumber AS step FROM lineitem WHERE l_linenumber >= 2", base=False)


def _sim1(s: SparkSession, p: str) -> DataFrame:
    filled = settled(s, p).withColumns({"t_air": F.coalesce("t_air", F.lit(5.0)), "q": F.coalesce("q", F.lit(50.0))})
    return sim.simulate(sim.whole(filled), list(P)).withColumnRenamed("seg_day", "i")


_WHOLE = f"""
filled AS (SELECT site, d, coalesce(t_air, 5.0) AS t_air, t_water, coalesce(q, 50.0) AS q, row_number() OVER (PARTITION BY site ORDER BY d) - 1 AS n FROM forcing),
warm AS (SELECT site, n AS idx, t_air, t_water, q, (n + 1) / 365.0::DOUBLE AS tt FROM filled WHERE n < 365 UNION ALL SELECT site, n + 365, t_air, t_water, q, {TT.format('d')} FROM filled),
qm AS (SELECT site, avg(q) FILTER (WHERE q > 0) AS qmedia FROM filled GROUP BY site),
st AS (SELECT site, 1::BIGINT AS seg_id, coalesce(t_water, 4.0) AS tw0 FROM warm WHERE idx = 0),
fx0 AS (SELECT warm.site, 1::BIGINT AS seg_id, idx + 1 AS i, t_air AS ta, q / qmedia AS th, tt FROM warm JOIN qm ON qm.site = warm.site)"""
_query("sim1_whole_series", "site:s i:i tw:d", _sim1, "SELECT site, i, tw FROM sim", f"{_fixed(P, 8)},{_simulation(8, 'RK4', _WHOLE)}")


def _troubled(s: SparkSession, p: str) -> DataFrame:
    """Each site four times: as it is, without observations, without every other day of air, without flow."""
    f = forcing(s, p).withColumn("x", F.explode(F.array(*map(F.lit, "abcd"))))
    some = lambda c, kept: F.when(kept, F.col(c)).alias(c)
    x = F.col("x")
    return f.select(F.concat("site", "x").alias("site"), "d", some("t_air", (x != "c") | (F.dayofmonth("d") % 2 == 0)), some("t_water", x != "b"), some("q", x != "d"))


# searches with the operators' defaults
_LATHYP = search.latin_hypercube(np.array(LOW), np.array(HIGH), 500, np.random.default_rng(1)).tolist()
_LATHYP_PAR = "\npar AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(f"{x!r}::DOUBLE" for x in v) + ")" for i, v in enumerate(_LATHYP)) + ") v(pid, " + ", ".join(f"p{k}" for k in range(1, 9)) + "))"
_query("opt1_lathyp_search", "site:s score:d n_evaluated:i", lambda s, p: search.calibrate(days(s, p), "LATHYP", LOW, HIGH, seed=1), f"SELECT site, max(nse) AS score, count(*) AS n_evaluated FROM ({_MANY_SCORES}) GROUP BY site", f"{_LATHYP_PAR},{_MANY.removeprefix(DESIGN + ',')}")


def _history(s: SparkSession, p: str) -> DataFrame:
    """A search's evaluations with a score of at least -2, written as a run writes them and read again."""
    found = search.history(days(s, p), "LATHYP", LOW, HIGH, seed=1)
    files.write_history(found, path := scratch(s, "history"), -2.0)
    return s.read.option("header", True).csv(path)


_PARS = " ".join(f"par_{k}:d" for k in range(1, 9))
_PAR_COLUMNS = ", ".join(f"p{k} AS par_{k}" for k in range(1, 9))
_LATHYP_MANY = f"{_LATHYP_PAR},{_MANY.removeprefix(DESIGN + ',')}"
_query("snk1_snk2_history", f"site:s eval:i {_PARS} eff_index:d nse:d r2:d mae:d", _history, f"SELECT site, param_id AS eval, {_PAR_COLUMNS}, nse AS eff_index, nse, r2, mae FROM ({_MANY_SCORES}) JOIN par ON par.pid = param_id WHERE nse >= -2", _LATHYP_MANY)
_query("snk3_best_vectors", f"site:s {_PARS} calibration_score:d", lambda s, p: files.best_columns(search.calibrate(days(s, p), "LATHYP", LOW, HIGH, seed=1).withColumnRenamed("score", "calibration_score")), f"SELECT site, {_PAR_COLUMNS}, nse AS calibration_score FROM (SELECT site, param_id, nse FROM ({_MANY_SCORES}) QUALIFY row_number() OVER (PARTITION BY site ORDER BY nse DESC, param_id) = 1) JOIN par ON par.pid = param_id", _LATHYP_MANY)
_query("val9_site_problems", "site:s problem:s", lambda s, p: runs.site_problems(_troubled(s, p), Config(gap_tolerant=True, min_days=MIN_DAYS)), "SELECT site, 'no observations' AS problem FROM forcing GROUP BY site HAVING count(t_water) = 0 UNION ALL SELECT site, 'no positive flow' FROM forcing GROUP BY site HAVING coalesce(max(q), 0) <= 0 UNION ALL SELECT site, 'no valid segment of the least length' FROM (SELECT DISTINCT site FROM forcing) ANTI JOIN seg USING (site)", "\n" + ",\n".join(x for x in (FORCING.replace("forcing AS (", "daily AS ("), "forcing AS (SELECT site || x AS site, d, CASE WHEN x <> 'c' OR day(d) % 2 = 0 THEN t_air END AS t_air, CASE WHEN x <> 'b' THEN t_water END AS t_water, CASE WHEN x <> 'd' THEN q END AS q FROM daily CROSS JOIN (SELECT unnest(['a', 'b', 'c', 'd']) AS x))", _segments().strip())), base=False)
for _n, _m in (("opt2_pso", "PSO"), ("opt3_opt4_de", "DE")):
    _query(f"{_n}_search", "site:s score:d n_evaluated:i", lambda s, p, m=_m: search.calibrate(days(s, p), m, LOW, HIGH, seed=1), None)


def _posterior(s: SparkSession, p: str) -> DataFrame:
    d = written(days(s, p), "days")
    best = written(search.calibrate(d, "DE", LOW, HIGH, seed=1), "best")
    return reports.posterior_summary(written(search.posterior(d, best, LOW, HIGH, seed=1), "chain"), ("site",))


_query("opt5_posterior", "site:s parameter:i mean:d std:d", _posterior, None)


def _cv(s: SparkSession, p: str, method: str, **options) -> DataFrame:
    f = settled(s, p)
    results, held = uncertainty.cross_validate(f, prep.folds(f, 1, 1, 2, 10), list(LOW), list(HIGH), method=method, min_days=MIN_DAYS, warmup_days=WARMUP_DAYS, seed=1, **options)
    return reports.cv_summary(results, metrics.fold_scores(held, ("site",)))


def _cv_sql(n: int) -> str:
    """Cross-validation with a Latin hypercube of n vectors. A series of a fold is named by its site and year."""
    vectors = search.latin_hypercube(np.array(LOW), np.array(HIGH), n, np.random.default_rng(1)).tolist()
    par = "\npar AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(f"{x!r}::DOUBLE" for x in v) + ")" for i, v in enumerate(vectors)) + ") v(pid, " + ", ".join(f"p{k}" for k in range(1, 9)) + "))"
    every = FORCING.replace("forcing AS (", "daily AS (") + """,
yrs AS (SELECT site, year(d) AS year, count(t_water) AS n_obs FROM daily GROUP BY 1, 2),
fold AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY year) AS r FROM yrs) WHERE r > 2 AND n_obs >= 10),
deep AS (SELECT daily.site || '#' || fold.year AS site, d, year(d) = fold.year AS held, t_air, t_water, q FROM daily JOIN fold ON fold.site = daily.site)"""
    train = f"{every},\nforcing AS (SELECT site, d, CASE WHEN NOT held THEN t_air END AS t_air, CASE WHEN NOT held THEN t_water END AS t_water, CASE WHEN NOT held THEN q END AS q FROM deep),{par},{_MANY.removeprefix(DESIGN + ',')}"
    flow = "\nqm AS (SELECT site, avg(q) FILTER (WHERE q > 0 AND NOT held) AS qmedia FROM deep GROUP BY site)"
    full = f"{every},\nforcing AS (SELECT site, d, t_air, CASE WHEN NOT held THEN t_water END AS t_water, q FROM deep),{par},{_MANY.removeprefix(DESIGN + ',').replace(QMEDIA, flow)}"
    scored = "count(*) AS n_obs, 1 - sum((sim - obs) * (sim - obs)) / (var_pop(obs) * count(*)) AS nse, 1 - sqrt(pow(corr(sim, obs) - 1, 2) + pow(stddev_pop(sim) / stddev_pop(obs) - 1, 2) + pow(avg(sim) / avg(obs) - 1, 2)) AS kge, sqrt(avg((sim - obs) * (sim - obs))) AS rmse"
    p8 = [f"p{k}" for k in range(1, 9)]
    each = lambda f: ", ".join(f.format(c) for c in p8)
    return f"""SELECT * FROM (WITH {par.strip()},
best AS (SELECT * FROM (WITH RECURSIVE {train} SELECT site, arg_max(param_id, nse) AS pid FROM ({_MANY_SCORES}) GROUP BY site)),
held AS (SELECT split_part(site, '#', 1) AS site, split_part(site, '#', 2) AS fold, obs, sim FROM (WITH RECURSIVE {full} SELECT e.site, e.pid, deep.t_water AS obs, e.tw AS sim FROM ens e JOIN deep ON deep.site = e.site AND deep.d = e.d WHERE held AND deep.t_water IS NOT NULL) SEMI JOIN best USING (site, pid)),
chosen AS (SELECT split_part(site, '#', 1) AS site, split_part(site, '#', 2) AS fold, {each("{}")} FROM best JOIN par USING (pid)),
scored AS (SELECT * FROM (SELECT site, fold, {scored} FROM held GROUP BY 1, 2) JOIN chosen USING (site, fold))
SELECT * FROM scored UNION ALL SELECT site, 'mean', sum(n_obs), avg(nse), avg(kge), avg(rmse), {each("avg({})")} FROM scored GROUP BY 1
UNION ALL SELECT site, 'std', sum(n_obs), coalesce(stddev_samp(nse), 0), coalesce(stddev_samp(kge), 0), coalesce(stddev_samp(rmse), 0), {each("coalesce(stddev_samp({}), 0)")} FROM scored GROUP BY 1
UNION ALL SELECT site, 'pooled', {scored}, {each("NULL")} FROM held GROUP BY 1)"""


_CV_COLUMNS = "site:s fold:s n_obs:i nse:d kge:d rmse:d " + " ".join(f"p{k}:d" for k in range(1, 9))
_query("cv1_agg17_cross_validation", _CV_COLUMNS, lambda s, p: _cv(s, p, "DE"), None)
_query("cv1_agg17_lathyp_cross_validation", _CV_COLUMNS, lambda s, p: _cv(s, p, "LATHYP"), _cv_sql(500), base=False)


def _fold_best(s: SparkSession, p: str) -> DataFrame:
    return s.read.parquet(f"{p}/lineitem.parquet").select(F.col("l_returnflag").alias("site"), F.array(*[F.col(c).cast("double") for c in _CHAIN_OF]).alias("p"))


_query("agg26_walker_spread", "site:s parameter:i spread:d", lambda s, p: uncertainty.walker_spread(_fold_best(s, p)), " UNION ALL ".join(f"SELECT l_returnflag AS site, {k} AS parameter, coalesce(nullif(stddev_samp({c}), 0), 1e-4) AS spread FROM lineitem GROUP BY 1" for k, c in enumerate(_CHAIN_OF, 1)), base=False)


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict:
    return dict(_SQL)
