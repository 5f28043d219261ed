import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.functions import quantiles
from tarnwork.operators import splits


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_like_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)  # with 100 the bracket leaves most values out, as for a large group
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=4000), "b": np.round(rng.normal(size=2500), 1), "c": np.array([3.0]), "d": np.array([]), None: np.array([1.0, np.inf, -np.inf, 2.0])}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [(k, x) for k in ("a", "d") for x in (None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    qs = (0.0, 0.05, 0.1, 0.5, 0.75, 0.999, 1.0)
    got = {r.k: tuple(r)[1:] for r in quantiles.exact_quantiles(df, ["k"], {f"q{i}": (F.col("x"), q) for i, q in enumerate(qs)}).collect()}
    assert set(got) == set(groups)
    assert got["d"] == (None,) * len(qs)
    for k in ("a", "b", "c"):
        assert got[k] == pytest.approx(np.quantile(groups[k], qs), rel=1e-12, abs=1e-12)
    assert got[None][0] == -np.inf and got[None][3] == 1.5 and got[None][-1] == np.inf
    all_of = quantiles.exact_quantiles(df.where("k in ('a', 'b')"), [], {"m": (F.col("x"), 0.5)}).first().m
    assert all_of == pytest.approx(np.median(np.concatenate([groups["a"], groups["b"]])))
    assert quantiles.exact_quantiles(df.where("false"), ["k"], {"m": (F.col("x"), 0.5)}).count() == 0


def test_no_group_is_held_or_ranked_whole(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("site"), F.timestamp_seconds(F.col("id") * 40_000).alias("t"))
    plan = quantiles.exact_quantiles(df, ["site"], {"m": (F.col("id"), 0.5)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
    held = splits.stratified_holdout(df, ["site"], "id", 0.25)
    assert "row_number() windowspecdefinition(_slot" in held._jdf.queryExecution().executedPlan().toString()


def test_first_rows_like_one_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(None if s == 2 else s, int(i), int(rng.integers(0, 9)) * 30_000) for s in range(4) for i in range((1, 2, 150, 700)[s])]
    df = spark.createDataFrame(rows, "site int, i int, sec long").withColumn("t", F.when(F.col("i") % 17 != 3, F.timestamp_seconds("sec")))
    tail = {(r.site, r.i) for r in splits.tail_holdout(df.repartition(6), ["site"], "t", "i", 0.3).where("is_val").collect()}
    want = set()
    for site in {r[0] for r in rows}:
        own = sorted(((-1 if i % 17 == 3 else sec, i) for s, i, sec in rows if s == site), reverse=True)
        want |= {(site, i) for _, i in own[: max(1, -(-len(own) * 3 // 10))]}
    assert tail == want
    out = splits.stratified_holdout(df.repartition(3), ["site"], "i", 0.2)
    n = {r.site: r.n for r in out.where("is_val").groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert out.count() == len(rows) and n == {1: 1, None: 30, 3: 140}
    ranked = out.where("site = 3").withColumn("r", F.md5(F.concat_ws("|", F.lit("42"), F.col("site").cast("string"), F.col("i").cast("string")))).orderBy("r").collect()
    assert [r.is_val for r in ranked] == [True] * 140 + [False] * 560
