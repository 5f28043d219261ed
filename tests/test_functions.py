from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import calendar, stats, text
from tarnwork.operators import guards, relational, splits


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("123", "00000123"), ("123.0", "00000123"), (" 01312000 ", "01312000"), ("Cam_1", "Cam_1")])
def test_site_id(spark, raw, want):
    assert one(spark, text.normal_site_id(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("a:b/c d", "a-b-c-d"), ("--", "unknown"), ("é?", "é")])
def test_token(spark, raw, want):
    assert one(spark, text.safe_token(F.lit(raw))) == want


@pytest.mark.parametrize("day,year,month", [("2023-09-30T23:59:59", 2023, 12), ("2023-10-01T00:00:00", 2024, 1)])
def test_water_year(spark, day, year, month):
    t = F.lit(day).cast("timestamp_ntz")
    assert (one(spark, calendar.water_year(t)), one(spark, calendar.water_month(t))) == (year, month)


@pytest.mark.parametrize("utc,zone,hour", [("2024-03-10T07:30:00", "America/New_York", 3.5), ("2024-03-10T06:59:59", "America/New_York", 1 + 59 / 60 + 59 / 3600), ("2024-11-03T06:30:00", "America/New_York", 1.5), ("2024-11-03T08:30:00", "America/Denver", 1.5)])
def test_local_hour_over_clock_changes(spark, utc, zone, hour):
    assert one(spark, calendar.local_hour(F.lit(utc).cast("timestamp_ntz"), F.lit(zone))) == pytest.approx(hour)


def test_names(spark):
    assert one(spark, calendar.camera_time(F.lit("cam___2024-01-02T03-04-05Z.jpg"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, calendar.camera_time(F.lit("cam___broken.jpg"))) is None
    assert one(spark, calendar.stamped_time(F.lit("x_2024-01-02T03-04-05_2025-01-01T00-00-00.png"))) == datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, calendar.month_floor(F.lit("nonsense"))) == datetime(2022, 1, 1)


def test_qualifiers(spark):
    assert one(spark, text.qualifiers(F.lit('["P", {"qualifierDescription": "x"}, {"y": 1}]'))) == "P,x"
    assert one(spark, text.qualifiers(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("n,ratio,want", [(0, 0.5, 0), (1, 0.5, 0), (2, 0.5, 1), (5, 0.5, 2), (7, 0.5, 4), (3, 1.0, 2)])
def test_holdout_size(spark, n, ratio, want):
    assert one(spark, stats.holdout_size(F.lit(n), ratio)) == want


def test_empty_population_gives_floors(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert tuple(df.agg(stats.adaptive_floor(F.col("x"), 85, 0.05, 0.9), stats.adaptive_band(F.col("x"), 7, 10, 0.1)).first()) == (85.0, 10.0)


def test_metrics_of_constant_truth(spark):
    row = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "t double, p double").agg(*stats.regression_metrics(F.col("t"), F.col("p"))).first()
    assert (row.MAE, row.RMSE, row.R2, row.Bias) == (1.0, 1.0, None, 0.0)


def test_weights(spark):
    df = spark.createDataFrame([(1, -0.5), (2, 0.0), (3, 0.8), (4, 0.8)], "k int, r double")
    top = {x.k: x.weight for x in stats.with_ensemble_weights(df, "r", "topk", 1.0, 1, (), "k").collect()}
    assert top == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    for mode in ("uniform", "weighted", "softmax"):
        assert sum(x.weight for x in stats.with_ensemble_weights(df, "r", mode).collect()) == pytest.approx(1)
    with pytest.raises(ValueError):
        stats.with_ensemble_weights(df, "r", "best")


def test_one_hot_of_missing_month(spark):
    flags = one(spark, calendar.month_season_one_hot(F.lit(None).cast("int")))
    assert flags[0] == 1 and sum(flags[:12]) == 1 and flags[15] == 1 and len(flags) == 16


def test_parse_months():
    assert calendar.parse_months("11, 12;1") == [11, 12, 1]
    with pytest.raises(ValueError):
        calendar.parse_months("13")


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, split string")
    with pytest.raises(ValueError):
        guards.require_columns(df, ["z"])
    with pytest.raises(ValueError):
        guards.assert_unique(df, ["k"])
    with pytest.raises(ValueError):
        guards.require_classes(df, "split", ["train"])
    with pytest.raises(ValueError):
        guards.single_value(df, "k", "split")
    with pytest.raises(ValueError):
        guards.require_rows(df.where("k > 5"))
    old = spark.createDataFrame([(1, 2, 3, 4)], "k int, quality_keep int, flag_dark int, gray_mean int")
    assert guards.without_quality(old).columns == ["k"]
    wide = spark.createDataFrame([(1, 0.5, 1.5, "x")], "k int, emb_000 double, emb_001 double, emb_name string")
    assert guards.as_vector(wide).first().embedding == [0.5, 1.5]
    assert guards.as_columns(guards.as_vector(wide), "embedding", 2).columns == ["k", "emb_name", "emb_000", "emb_001"]


def test_split_is_a_partition_with_small_seasons(spark):
    rows = [(i, "s", "fall" if i < 1 else "winter" if i < 3 else "spring") for i in range(13)]
    df = spark.createDataFrame(rows, "i int, site string, season string")
    out = splits.stratified_holdout(df, ["site", "season"], "i", 0.25)
    held = {r.season: r.n for r in out.where("is_val").groupBy("season").agg(F.count("*").alias("n")).collect()}
    assert out.count() == 13 and held == {"winter": 1, "spring": 2}
    assert {r.i for r in out.where("is_val").collect()} == {r.i for r in splits.stratified_holdout(df.repartition(7), ["site", "season"], "i", 0.25).where("is_val").collect()}


def test_strict_split_with_one_year_takes_the_tail(spark):
    days = [datetime(2021 if m >= 10 else 2022, m, 1) for m in range(1, 13)] + [datetime(2022 if m >= 10 else 2023, m, 1) for m in range(1, 13)]
    df = spark.createDataFrame([(i, "s", d) for i, d in enumerate(days)], "i int, site string, t timestamp_ntz")
    n = {r.split: r["count"] for r in splits.strict_year_split(df, ["site"], "t", "i", 2023, 0.2).groupBy("split").count().collect()}
    assert n == {"train": 9, "val": 3, "test": 12}


def test_running_best_and_pick(spark):
    log = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.5), (1, 3, 0.2)], "s int, e int, r double")
    assert [x.epochs_since_best for x in relational.running_best(log, ["s"], "e", "r").orderBy("e").collect()] == [0, 0, 1]
    assert relational.pick_task(log, 9, "e").count() == 0 and relational.pick_task(log, 1, "e").first().e == 2
