"""Station folders, the preparation plan, and outputs by site."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluvia.operators import prep
from fluvia.plans import preparation as pre
from fluvia.plans import runs
from fluvia.sources import files, stations
from tests.test_models import series
from tests.test_runs import config, rows

DAY = dt.date(2001, 1, 1)


def days(n):
    return [DAY + dt.timedelta(i) for i in range(n)]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "stations"
    root.mkdir()
    (root / "a b.csv").write_text("Date,T_air,T_water,Discharge\n" + "".join(f"{d},{i},-999,{i + 1}\n" for i, d in enumerate(days(5))) + "2001-02-30,1,2,3\n2001-01-09,warm,2,3\n2001-01-10,1,2\n\n2001-01-11,,NaN,7\n")
    (root / "c.csv").write_text('"Discharge","Date","T_air"\n' + "".join(f'{i},"{d}",5.5\n' for i, d in enumerate(days(3))))
    (root / "d.csv").write_text("Date,T_water\n2001-01-01,4\n")
    (root / "e.csv").write_text("2001-01-01,4,4,4\n")
    (root / "_hidden.csv").write_text("nothing")
    part = root / "site=x%2Fy+z"
    part.mkdir()
    (part / "one.csv").write_text("Date,T_air,Discharge\n2001-01-01,1,1\n")
    (part / "two.csv").write_text("Date,Discharge,T_air\n2001-01-02,2,3\n")
    return str(root)


def test_folders_of_station_files(spark, folder):
    good, bad = stations.read_stations(spark, folder)
    found = {}
    for r in good.collect():
        found.setdefault(r.site, []).append((r.d, r.t_air, r.t_water, r.q))
    assert set(found) == {"a b", "c", "x/y+z"}
    assert sorted(found["a b"])[0] == (DAY, 0.0, None, 1.0) and (dt.date(2001, 1, 11), None, None, 7.0) in found["a b"] and len(found["a b"]) == 6
    assert sorted(found["c"]) == [(d, 5.5, None, float(i)) for i, d in enumerate(days(3))]
    assert sorted(found["x/y+z"]) == [(DAY, 1.0, None, 1.0), (days(2)[1], 3.0, None, 2.0)]
    assert sorted((r.site, r.line, r.reason) for r in bad.collect()) == [
        ("a b", "2001-01-09,warm,2,3", "no number: T_air"), ("a b", "2001-01-10,1,2", "another number of fields"), ("a b", "2001-02-30,1,2,3", "no date"),
        ("d", "2001-01-01,4", "missing columns: T_air, Discharge"), ("e", "2001-01-01,4,4,4", "no header"),
    ]
    some, _ = stations.read_stations(spark, folder, sites=["c", "x/y+z"])
    assert {r.site for r in some.collect()} == {"c", "x/y+z"}
    one, _ = stations.read_stations(spark, folder + "/c.csv")
    assert {r.site for r in one.collect()} == {"c"} and one.count() == 3
    with pytest.raises(FileNotFoundError):
        stations.read_stations(spark, folder, sites=["c", "nobody"])
    with pytest.raises(FileNotFoundError):
        stations.read_stations(spark, folder + "/none")


def test_prepare_merges_completes_reports_and_writes(spark, tmp_path):
    for name in ("air", "water", "flow"):
        (tmp_path / name).mkdir()
    for k, site in enumerate(("a", "b")):
        (tmp_path / "air" / f"{site}.csv").write_text("time,temperature\n" + "".join(f"{d} 0{h}:30,{283.15 + k + h}\n" for i, d in enumerate(days(60)) for h in (1, 3) if i not in (30, 31)))
        (tmp_path / "water" / f"{site}.csv").write_text("Date,T\n" + "".join(f"{d},{4 + k}\n" for i, d in enumerate(days(60)) if i % 2))
        (tmp_path / "flow" / f"{site}.csv").write_text("Date,Q\n" + "".join(f"{d},2\n" for d in days(62)) + "never,1\n")
    sources = [
        pre.Source(str(tmp_path / "air"), "t_air", "temperature", "time", "yyyy-MM-dd HH:mm", kelvin=True),
        pre.Source(str(tmp_path / "water"), "t_water", "T", fmt="yyyy-MM-dd"), pre.Source(str(tmp_path / "flow"), "q", "Q", fmt="yyyy-MM-dd"),
    ]
    out = str(tmp_path / "out")
    places = pre.prepare(spark, sources, out, 10)
    assert set(places) == {"merged", "rejected", "missing", "blocks", "summary", "report", "manifest"}
    good, bad = stations.read_stations(spark, places["merged"])
    assert bad.count() == 0 and good.count() == 2 * 62
    got = {(r.site, r.d): r for r in good.collect()}
    assert got["a", DAY].t_air == pytest.approx(12.0) and got["b", DAY].t_air == pytest.approx(13.0) and got["a", days(31)[30]].t_air is None
    assert got["b", days(2)[1]].t_water == 5 and got["b", DAY].t_water is None and got["a", days(62)[61]].q == 2
    assert [r.reason for r in rows(spark, places["rejected"])] == ["no date"] * 2
    summary = {r.site: r for r in rows(spark, places["summary"])}
    assert (summary["a"].n_valid, summary["a"].n_gap, summary["a"].valid_days, summary["a"].valid_obs) == (2, 2, 58, 29)
    text = [r.value for r in spark.read.text(places["report"]).filter("site = 'a'").collect()]
    assert text[0] == "range: 2001-01-01 to 2001-03-03, 62 days" and "t_air: 4 missing (6.5 %)" in text and "blocks: 2 valid, 0 shorter than 10 days, 2 gaps" in text
    assert text[-1] == "segment 2: 2001-02-02 to 2001-03-01, 28 days, 14 observed"
    counts = {(r.site, r.output): r.n_rows for r in rows(spark, places["manifest"])}
    assert counts["a", "merged"] == 62 and counts["b", "blocks"] == 4 and counts["a", "rejected"] == 1
    # a rerun of one site replaces that site alone
    (tmp_path / "flow" / "a.csv").write_text("Date,Q\n" + "".join(f"{d},2\n" for d in days(70)))
    again = pre.prepare(spark, sources, out, 10, sites=["a"])
    assert {r.site: r.n for r in spark.read.option("header", True).csv(again["merged"]).groupBy("site").agg(F.count("*").alias("n")).collect()} == {"a": 70, "b": 62}
    assert [r.site for r in rows(spark, again["rejected"])] == ["b"]
    forcing = runs.read_period(spark, places["merged"], True)
    assert {r.site for r in forcing.select("site").distinct().collect()} == {"a", "b"} and prep.checks(forcing).filter("is_daily").count() == 2


def test_sites_with_problems_are_listed(spark, tmp_path):
    data = series(spark, 500, ("a", "b", "c"))
    data = data.withColumn("t_water", F.when(F.col("site") != "b", F.col("t_water"))).withColumn("t_air", F.when((F.col("site") != "c") | (F.dayofmonth("d") % 3 == 0), F.col("t_air")))
    c = config(output=str(tmp_path / "out"))
    places = runs.run(spark, c, data)
    assert sorted((r.site, r.problem) for r in rows(spark, places["problems"])) == [("b", "no observations"), ("c", "no valid segment of the least length")]
    assert [r.site for r in rows(spark, places["best"])] == ["a"]
    n = {r.output: r.n_rows for r in rows(spark, places["manifest"]) if r.site == "a"}
    assert n["calibration"] == 500 and n["best"] == 1 and n["residual_histogram"] > 5
    lags = rows(spark, places["residual_autocorrelation"])
    assert {r.site for r in lags} == {"a"} and sorted(r.lag for r in lags) == list(range(n["residual_quantiles"])) and [r.acf for r in lags if r.lag == 0] == [pytest.approx(1.0)]
    with pytest.raises(ValueError, match="no observations: b"):
        runs.problems_of(data.filter("site = 'b'"), c)
    with pytest.raises(ValueError, match="no positive flow"):
        runs.problems_of(data.filter("site = 'a'").withColumn("q", F.lit(0.0)), config(version=8, low=(0.0,) * 8, high=(1.0,) * 8))


def test_rows_beside_a_chain_of_other_sites_stay(spark, tmp_path):
    out = files.Folder(spark, str(tmp_path), ["a", "b"])
    out.json("meta", spark.createDataFrame([("a", 1.0), ("b", 2.0)], "site string, rho double"))
    again = files.Folder(spark, str(tmp_path), ["b"])
    again.json("meta", spark.createDataFrame([("b", 3.0)], "site string, rho double"))
    assert {r.site: r.rho for r in spark.read.json(again.places["meta"]).collect()} == {"a": 1.0, "b": 3.0}
