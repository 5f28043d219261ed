from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import timeseries as ts

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def frames(spark, targets, readings):
    t = spark.createDataFrame([(i, "k", at(m)) for i, m in enumerate(targets)], "i int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("k", at(m), v) for m, v in readings] or [], "k string, rt timestamp_ntz, v double").coalesce(1)
    return t, r


def asof(spark, targets, readings, tolerance, **more):
    t, r = frames(spark, targets, readings)
    return {x.i: x.v for x in ts.asof_nearest(t, r, ["k"], "t", "rt", ["v"], tolerance, **more).collect()}


def test_tie_goes_back_and_bounds_are_inclusive(spark):
    assert asof(spark, [10], [(0, 1.0), (20, 2.0)], 30) == {0: 1.0}
    assert asof(spark, [10, 11], [(0, 1.0)], 10) == {0: 1.0, 1: None}


def test_duplicate_readings(spark):
    assert asof(spark, [5], [(0, 1.0), (0, 2.0)], 30) == {0: 2.0}
    assert asof(spark, [-5], [(0, 1.0), (0, 2.0)], 30) == {0: 1.0}


def interpolated(spark, targets, readings, **more):
    t, r = frames(spark, targets, readings)
    return {x.i: x for x in ts.interpolate_at(t, r, ["k"], "t", "rt", "v", 90.0, **more).collect()}


def test_exact_hit_and_edges(spark):
    out = interpolated(spark, [10, 30, -60, 5], [(0, 0.0), (10, 10.0), (20, 40.0)])
    assert (out[0].v, out[0].gap_next_min, out[0].gap_prev_min) == (10.0, 0.0, 10.0)
    assert out[1].v is None and out[1].valid_interpolation and out[1].gap_next_min == float("inf")
    assert out[2].v is None and out[2].valid_interpolation and out[2].nearest_time == at(0)
    assert out[3].v == 5.0


def test_no_readings(spark):
    out = interpolated(spark, [1], [])
    assert out[0].v is None and not out[0].valid_interpolation and out[0].gap_prev_min == out[0].gap_next_min == float("inf") and out[0].nearest_time is None


def test_wide_gap_and_sentinel(spark):
    readings = [(0, 1.0), (5, -999999.0), (14400, 11.0)]
    assert interpolated(spark, [5], [(0, 1.0), (14405, 2.0)])[0].valid_interpolation
    assert interpolated(spark, [5], readings)[0].v == -999999.0
    assert interpolated(spark, [5], readings, sentinel=-999999.0)[0].v == pytest.approx(1 + 10 * 5 / 14400)


@pytest.mark.parametrize("slice_seconds", [None, 3600])
def test_like_pandas(spark, slice_seconds):
    rng = np.random.default_rng(5)
    targets, times = np.sort(rng.integers(0, 3000, 150)), np.sort(rng.integers(0, 3000, 80))
    readings = [(int(m), float(i)) for i, m in enumerate(times)]
    left = pd.DataFrame({"t": [at(int(m)) for m in targets], "i": range(len(targets))})
    right = pd.DataFrame({"t": [at(m) for m, _ in readings], "v": [v for _, v in readings]})
    want = pd.merge_asof(left, right, on="t", direction="nearest", tolerance=pd.Timedelta(minutes=20))
    got = asof(spark, [int(m) for m in targets], readings, 20, slice_seconds=slice_seconds)
    assert [got[i] for i in range(len(targets))] == [None if np.isnan(v) else v for v in want["v"]]


def test_pivot_takes_last_known_and_drops_empty(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (1, "a", None, 1), (1, "b", 2.0, 2), (2, "a", None, 3)], "k int, n string, v double, s int")
    assert [tuple(r) for r in ts.pivot_last(df, ["k"], "n", "v", ["s"], ["a", "b"]).collect()] == [(1, 1.0, 2.0)]


@pytest.mark.parametrize("slice_seconds", [0, 3600, 86400])
def test_rows_may_come_in_any_order(spark, slice_seconds):
    """Readings of one time, gaps and hot slices: the same rows however the inputs are dealt."""
    rng = np.random.default_rng(9)
    targets = [(i, "ab"[i % 2], at(int(m))) for i, m in enumerate(rng.integers(-100, 6000, 300))]
    readings = [("ab"[i % 2], at(int(m)), None if i % 7 == 0 else float(rng.integers(0, 50))) for i, m in enumerate(rng.integers(0, 300, 400) * 20)]
    t = spark.createDataFrame(targets, "i int, k string, t timestamp_ntz")
    r = spark.createDataFrame(readings, "k string, rt timestamp_ntz, v double")
    seen = set()
    for turn in range(3):
        t2, r2 = t.repartition(3 + turn, F.rand(turn)), r.repartition(2 + turn, F.rand(turn + 5))
        a = ts.asof_nearest(t2, r2, ["k"], "t", "rt", ["v"], 45.0, slice_seconds=slice_seconds)
        b = ts.interpolate_at(t2, r2, ["k"], "t", "rt", "v", 90.0, slice_seconds=slice_seconds)
        seen.add((tuple(sorted(map(repr, a.collect()))), tuple(sorted(map(repr, b.collect())))))
    assert len(seen) == 1
    whole = ts.interpolate_at(t, r, ["k"], "t", "rt", "v", 90.0, slice_seconds=0)
    assert next(iter(seen))[1] == tuple(sorted(map(repr, whole.collect())))


def test_long_keys_are_cut(spark, monkeypatch):
    _, r = frames(spark, [], [(m, 1.0) for m in range(100)])
    assert ts.slice_width(r, ["k"], "rt") == 0 and ts.slice_width(r.where("false"), ["k"], "rt") == 0
    monkeypatch.setattr(ts, "LONG_KEY", 50)
    monkeypatch.setattr(ts, "SLICE_ROWS", 10)
    assert ts.slice_width(r, ["k"], "rt") == 99 * 60 // 10
