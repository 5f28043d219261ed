from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import interior, models, quality
from tarnwork.plans import catalog, pipeline
from tarnwork.streaming import ingest


def test_prepare_filter_split(spark):
    sites = spark.createDataFrame([("g", "s1", "c1", "01"), ("g", "s2", "c2", "01")], "river_group string, site_folder string, cam_id string, nwis_id string")
    days = [datetime(2021, 10, 1, 18) + timedelta(days=d) for d in range(0, 4 * 365, 5)]
    images = spark.createDataFrame([(c, t, f"{c}/{i}.jpg") for c in ("c1", "c2") for i, t in enumerate(days)], "cam_id string, image_time timestamp_ntz, image_path string")
    readings = spark.createDataFrame([("01", datetime(2021, 10, 1) + timedelta(days=d), float(d)) for d in range(4 * 365)], "nwis_id string, time timestamp_ntz, discharge double")
    out = pipeline.prepare(sites, images, readings, max_gap_minutes=24 * 60)
    assert out["matched"].count() == 2 * len(days) and out["windows"].count() == 1
    metrics = images.select("image_path", F.lit(True).alias("read_ok"), *[F.lit(0.5).alias(m) for m in quality.METRICS])
    metrics = metrics.withColumns({"gray_mean": F.lit(120.0), "gray_std": F.lit(60.0), "lap_var": F.lit(900.0), "colorfulness": F.lit(30.0), "brightness_peak_v": F.lit(0.5), "bright_low_sat_ratio": F.lit(0.0), "raindrop_blob_count": F.lit(0.0), "glare_saturated_ratio": F.lit(0.0), "glare_very_bright_low_sat_ratio": F.lit(0.0)})
    made = pipeline.filter_images(out["matched"], metrics, ["site_folder"], "image_path", 2025)
    assert made["kept"].count() == made["audit"].count() == 2 * len(days)
    assert {(r.site_folder, r.split) for r in made["split_manifest"].select("site_folder", "split").distinct().collect()} == {(s, x) for s in ("s1", "s2") for x in ("train", "val", "test")}
    assert made["years"].where("is_complete_water_year").count() >= 6
    with pytest.raises(ValueError):
        pipeline.prepare(sites.union(spark.createDataFrame([("g", "s3", "c3", "02")], sites.schema)), images, readings)


def test_dataset_by_name_or_time(spark):
    images = spark.createDataFrame([("a.jpg", "p/a.jpg", datetime(2024, 1, 1, 0, 5), 2024, 1), ("b.jpg", "p/b.jpg", datetime(2024, 1, 2), 2024, 1)], "filename string, image_path string, image_time timestamp_ntz, year int, month int").withColumn("site_id", F.lit("s"))
    readings = spark.createDataFrame([("s", datetime(2024, 1, 1), 7.0, None)], "site_id string, time timestamp_ntz, discharge double, gauge_height double")
    matched, unmatched = pipeline.build_dataset(images, readings, ["site_id"])
    assert [r.discharge for r in matched.collect()] == [7.0] and unmatched.count() == 1


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(30, 6)), np.abs(rng.normal(size=30)) * 100
    for kind in models.ADAPTERS:
        s = models.BEST | {"adapter_type": kind, "trunk_dim": 8, "head_dim": 8, "adapter_hidden": 5, "adapter_bottleneck": 3, "use_metadata": True, "metadata_hidden": 4, "core_type": "shared" if kind != "none" else "disentangled"}
        net, meta = models.Net(s, 6, 2, np.random.default_rng(1)), rng.normal(size=(30, 2))

        def loss():
            low, high, logit, gate, mixed = net(x, meta)
            return models.smooth_l1(mixed.clamped_log1p(), np.log1p(y)).mean_of(np.ones(30)) + models.bce_with_logits(logit, (y > 50) * 1.0, 1.5).mean_of(np.ones(30))

        loss().backward()
        before = {n: w.grad.copy() for n, w in net.weights.items()}
        for n, w in net.weights.items():
            at = (0,) * w.value.ndim
            kept = float(w.value[at])
            ends = []
            for e in (1e-5, -1e-5):
                w.value[at] = kept + e
                ends.append(float(loss().value))
            w.value[at] = kept
            assert before[n][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6), (kind, n)


def test_models_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 6))
    y = 6 + x[:, 0] - 0.5 * x[:, 1]
    rows = [(f"i{i:03d}", "s", ("train", "train", "val", "test")[i % 4], float(y[i]), x[i].tolist()) for i in range(240)]
    df = spark.createDataFrame(rows, "image_path string, site_id string, split string, discharge double, embedding array<float>")
    out = pipeline.baselines(df, ["site_id"])["metrics"].first()
    assert out.R2 > 0.95 and (out.n_train, out.n_test) == (180, 60)
    made = pipeline.evaluate(df, ["site_id"], [1, 2], epochs=60, trunk_dim=32, head_dim=16, adapter_type="none", lr=2e-2, batch_size=32)
    m = made["metrics"].first()
    assert m.soft_R2 > 0.3 and m.n_test == 60 and made["seed_logs"].count() == 2
    assert m.expert_oracle_MAE <= m.soft_MAE + 1e-9


def test_both_baselines_for_each_key(spark):
    rng = np.random.default_rng(3)
    rows = []
    for site, variant, sign in (("a", "p05", 1), ("a", "p50", -1), ("b", "p05", 3)):
        x = rng.normal(size=(160, 5))
        rows += [(f"i{i:03d}", site, variant, ("train", "val", "test", " Train")[i % 4], float(10 + sign * v[0]), v.tolist()) for i, v in enumerate(x)]
    rows += [("i999", "c", "p05", "train", 1.0, [0.0] * 5)]  # no test rows, no model
    df = spark.createDataFrame(rows, "image_path string, site_id string, variant string, split string, discharge double, embedding array<float>")
    out = pipeline.baselines(df, ["site_id", "variant"])
    got = {(r.site_id, r.variant, r.model): r for r in out["metrics"].collect()}
    assert set(got) == {(*k, m) for k in (("a", "p05"), ("a", "p50"), ("b", "p05")) for m in ("svm", "random_forest")}
    assert all((r.n_train, r.n_test) == (120, 40) and r.R2 > 0.7 for r in got.values())
    assert out["predictions"].where("model = 'random_forest'").count() == 120
    assert {r.model for r in pipeline.compare_models(out["metrics"])["by_model"].collect()} == {"svm", "random_forest"}


def test_tree_splits_like_brute_force():
    rng = np.random.default_rng(0)
    for n in (4, 9, 40):
        x, w = rng.integers(0, 6, (n, 3)).astype(np.float32), rng.integers(1, 4, n).astype(float)
        y = rng.normal(size=n)
        off = y - np.average(y, weights=w)
        best = -np.inf
        for f in range(3):
            for cut in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= cut
                if min(low.sum(), (~low).sum()) >= 2:
                    best = max(best, sum((off[s] * w[s]).sum() ** 2 / w[s].sum() for s in (low, ~low)))
        found = models.Tree._split(x, off * w, w, np.arange(3), 3, 2)
        if found is None:
            assert best == -np.inf
            continue
        low = x[:, found[0]] <= found[1]
        assert min(low.sum(), (~low).sum()) >= 2 and sum((off[s] * w[s]).sum() ** 2 / w[s].sum() for s in (low, ~low)) == pytest.approx(best)


def test_svr_goes_on_until_it_converges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)[:, None] + 0.1 * rng.normal(size=(40, 35))  # correlated columns take some thousand passes
    y = 5 + 3 * x @ rng.normal(size=35) + 0.3 * rng.normal(size=40)
    rows = [(f"i{i:02d}", s, ("train", "test")[i % 4 == 3], float(y[i]), x[i].tolist()) for i in range(40) for s in "ab"]
    df = spark.createDataFrame(rows, "image_path string, site_id string, split string, discharge double, embedding array<double>")
    assert [r.converged for r in models.svr_baseline(df, ["site_id"], steps=2000).collect()] == [False] * 20
    assert [r.converged for r in models.svr_baseline(df, ["site_id"]).collect()] == [True] * 20
    assert {(r.model, r.converged) for r in pipeline.baselines(df, ["site_id"], trees=5)["metrics"].collect()} == {("svm", True), ("random_forest", None)}


def test_interior_svr_meets_the_conditions_of_the_minimum():
    rng = np.random.default_rng(3)
    for n, d, c, epsilon in ((30, 5, 1.0, 0.05), (200, 8, 10.0, 0.5), (25, 40, 1.0, 0.05), (1, 3, 1.0, 0.05)):
        x = rng.normal(size=(n, d))
        y = 5 + x @ rng.normal(size=d) + 0.3 * rng.normal(size=n)
        w, b, converged = interior.interior_svr(x, y, c, epsilon)
        a, error = np.column_stack([x, np.ones(n)]), x @ w + b - y
        edge = np.abs(np.abs(error) - epsilon) < 1e-4
        rest = np.append(w, b) + c * (np.sign(error) * (np.abs(error) > epsilon) * ~edge) @ a
        beta = np.linalg.lstsq(-a[edge].T, rest, rcond=None)[0] if edge.any() else np.zeros(0)
        assert converged and np.abs(rest + beta @ a[edge]).max() < 1e-3
        assert ((beta * np.sign(error[edge]) > -1e-3) & (np.abs(beta) < c + 1e-3)).all()
    assert interior.interior_svr(x, np.zeros(1))[2] and not interior.interior_svr(np.full((4, 3), np.nan), np.ones(4))[2]
    assert not interior.interior_svr(rng.normal(size=(50, 3)), rng.normal(size=50), steps=9)[2]


def test_svr_converges_in_few_passes_over_many_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 6))
    y = 100 + 40 * rng.integers(0, 10, 8000) + 50 * x.sum(axis=1)
    rows = [(f"i{i:04d}", "a", ("train", "test")[i % 50 == 0], float(y[i]), x[i].tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, "image_path string, site_id string, split string, discharge double, embedding array<double>")
    assert [r.converged for r in models.svr_baseline(df, ["site_id"], steps=150).collect()] == [True] * 160


def test_svr_of_large_keys_is_that_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for site, n in (("big", 400), ("other", 300), ("untested", 300), ("small", 40)):
        x = rng.normal(size=(n, 4))
        x[:, 2] = 0.1  # its sum over n is not n times it
        y = 5 + x @ rng.normal(size=4) + 0.3 * rng.normal(size=n)
        rows += [(f"i{i:03d}", site, "train" if i % 4 or site == "untested" else "test", float(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "image_path string, site_id string, split string, discharge double, embedding array<float>")
    monkeypatch.setattr(models, "UPDATES", 0)
    one = models.svr_baseline(df, ["site_id"])
    monkeypatch.setattr(models, "CELLS", 1000)
    monkeypatch.setattr(models, "PIECE", 700)
    seen = []
    monkeypatch.setattr(models, "spread_svr", lambda *given, f=models.spread_svr: seen.append(f(*given)) or seen[-1])
    many = models.svr_baseline(df, ["site_id"])
    assert one.schema == many.schema and len(seen[0]) == 2
    one, many = ({(r.site_id, r.image_path): r for r in out.collect()} for out in (one, many))
    assert one.keys() == many.keys() and len(one) == 100 + 75 + 10
    assert all((r.discharge_true, r.converged) == (one[k].discharge_true, True) and r.pred == pytest.approx(one[k].pred, abs=1e-6) for k, r in many.items())


def test_model_queries_run_the_whole_job(spark, sf, monkeypatch):
    vectors = catalog.labelled_vectors(spark, sf)
    assert vectors.selectExpr("min(size(embedding))").first()[0] == catalog.table(spark, sf, "embeddings").selectExpr("max(size(embedding))").first()[0]
    made = catalog.moe_train(spark, sf).groupBy("seed").count().collect()
    assert sorted(r.seed for r in made) == models.BEST["seeds"] and {r["count"] for r in made} == {vectors.where("split = 'test'").count()}
    seen = {}
    monkeypatch.setattr(models, "forest_baseline", lambda df, keys, **changes: seen.update(forest=(keys, changes)))
    catalog.rf_baseline(spark, sf)
    assert seen["forest"] == (["site_id"], {})


def test_best_models(spark):
    df = spark.createDataFrame([("s", "p05", "rf", 0.5), ("s", "p50", "rf", 0.7), ("s", "p50", "svm", 0.6)], "site_id string, variant string, model string, R2 double")
    out = pipeline.compare_models(df)
    assert out["by_model"].count() == 2 and out["by_site"].first().model == "rf"


def test_stream(spark, tmp_path):
    rows = [(i % 2, datetime(2024, 1, 1) + timedelta(minutes=20 * i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows + rows[:3], "k int, t timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "k int, t timestamp, v double"
    ingest.to_table(ingest.once_each(ingest.new_rows(spark, str(tmp_path / "in"), schema), ["k", "t"], "t", "10 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12
    query = ingest.windowed(ingest.new_rows(spark, str(tmp_path / "in"), schema), ["k"], "t", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 15
