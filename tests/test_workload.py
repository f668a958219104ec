import os

import pytest

import __spark_entry__ as entry
from fluvia import workload

SF = "/root/testdata/sf0.001"
CHOSEN = ["src2_resample_daily", "joi2_dense_calendar", "joi6_start_values", "agg4_pre1_summary", "agg6_win8_climatology", "win10_folds", "int_eul_v3", "int_crn_v7", "int_rk4_v8", "agg11_15_scores_daily", "agg10_15_scores_1m", "agg22_ar1_rho", "joi7_score_design", "opt1_lathyp_search", "snk5_validation_series", "smp1_k_rows", "agg28_normal_quantiles", "agg19_posterior_summary", "prj17_gaps_few_short", "ode8_rate", "sen1_agg25_sensitivity", "noi2_ar1_noise", "fwd2_fwd3_site_chains", "win7_rolling_envelope", "agg21_fwd2_envelope", "win1_joi3_segments_by_range", "joi3_interval_join", "agg29_autocorrelation", "src1_src2_station_folder", "pre1_snk10_prepared", "noi1_iid_noise", "prj17_gaps_random"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def text(rows):
    return sorted(tuple("" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert text(map(tuple, workload.queries()[name](spark, SF).collect())) == text(con.execute(workload.oracle_sql()[name]).fetchall())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 80


def test_sources_are_scanned_once(spark):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    for name, most in (("joi2_dense_calendar", 4), ("joi7_score_design", 4), ("agg21_fwd2_envelope", 4), ("sen1_agg25_sensitivity", 5)):
        assert scans(workload.queries()[name](spark, SF)) <= most, name


def test_cross_validation_calibrates_each_fold(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def calibrate(days, method, low, high, *args, keys, **options):
        raise Fitted(method, tuple(low), tuple(high), keys, options)

    monkeypatch.setattr(workload.uncertainty.search, "calibrate", calibrate)
    with pytest.raises(Fitted) as found:
        workload.queries()["cv1_agg17_cross_validation"](spark, SF)
    assert found.value.args == ("DE", workload.LOW, workload.HIGH, ("site", "fold"), {"seed": 1})
