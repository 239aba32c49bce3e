"""Run reports and profile against hand-computed values."""

import math

from pyspark.sql import functions as F

from parcelgrid.operators.report import house_report, profile, run_report


def test_run_report_by_hand(spark):
    visits = spark.createDataFrame(
        [("r1", 1, True, 10.0, 3), ("r1", 1, False, 5.0, 0), ("r1", 2, True, 21.0, 2), ("r2", 7, False, 0.0, 0)],
        "run_id string, tile int, success boolean, seconds double, house_count int")
    got = {r.run_id: r for r in run_report(visits).collect()}
    r1 = got["r1"]
    assert (r1.tiles, r1.pages, r1.pages_ok, r1.pages_failed, r1.houses) == (2, 3, 2, 1, 5)
    assert r1.success_pct == round(200 / 3, 2) and r1.total_seconds == 36.0
    assert r1.seconds_per_tile == 18.0 and r1.tiles_per_hour == 200.0
    r2 = got["r2"]
    assert r2.tiles_per_hour is None and r2.success_pct == 0.0


def test_house_report_by_hand(spark):
    statuses = spark.createDataFrame([("a", "saved", 2.0), ("a", "failed", 4.0), ("a", "skipped", 0.0),
                                      ("b", "saved", 1.5)], "run_id string, status string, seconds double")
    got = {r.run_id: r for r in house_report(statuses).collect()}
    assert (got["a"].processed, got["a"].saved, got["a"].failed, got["a"].skipped) == (1, 1, 1, 1)
    assert math.isclose(got["a"].mean_seconds, 2.0) and got["b"].saved == 1


def test_profile_by_hand(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (3, None)], "a int, `b c` string")
    got = {r.column_name: (r.n_rows, r.n_nulls) for r in profile(df).collect()}
    assert got == {"a": (3, 1), "b c": (3, 2)}


def test_eta_by_hand(spark):
    from parcelgrid.operators.report import with_eta

    visits = spark.createDataFrame([("r1", 1, True, 10.0, 0), ("r1", 2, True, 30.0, 0)],
                                   "run_id string, tile int, success boolean, seconds double, house_count int")
    rep = run_report(visits).withColumn("planned_tiles", F.lit(10))
    r = with_eta(rep).first()
    assert (r.remaining, r.eta_seconds) == (8, 160.0)
