import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import quality
from tarnwork.plans import cli, pipeline
from tarnwork.sources import readers, sinks

from test_images import png


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    return lambda *argv: cli.main([str(a) for a in argv])


@pytest.fixture
def site(tmp_path):
    """A site with a folder for each split, readings as labels, and one image without a reading."""
    start, rows = datetime(2024, 1, 1, 12), []
    for i in range(24):
        at = start + timedelta(days=i)
        folder = tmp_path / "s1" / ("train", "train", "val", "test")[i % 4]
        folder.mkdir(parents=True, exist_ok=True)
        png(folder / f"{at:%Y-%m-%dT%H-%M-%S}.png", np.full((8, 8, 3), 10 * i, np.uint8))
        if i != 7:
            rows.append(f"{at + timedelta(minutes=5):%Y-%m-%dT%H:%M:%SZ},{i + 1.5}")
    (tmp_path / "s1" / "labels.csv").write_text("time,discharge\n" + "\n".join(rows) + "\n")
    return tmp_path


def test_dataset_features_and_models(spark, run, site):
    out = site / "out"
    settings = json.dumps({"epochs": 3, "trunk_dim": 8, "head_dim": 4, "adapter_type": "none", "seeds": [1, 2]})
    run("run-best", "--output-root", out, "--site-dir", site / "s1", "--stand-in", "--settings", settings)
    p = cli.paths(str(out))
    manifest = spark.read.parquet(p["splits"])
    assert {r.split: r["count"] for r in manifest.groupBy("split").count().collect()} == {"train": 12, "val": 6, "test": 5}
    assert spark.read.parquet(f"{p['splits']}_unmatched").count() == 1
    assert spark.read.parquet(p["features"]).where("embedding is not null").count() == 23
    best = spark.read.parquet(f"{p['results']}/best_metrics").first()
    assert best.site_id == "s1" and best.n_test == 5 and spark.read.parquet(f"{p['results']}/best_seed_logs").count() == 2
    (site / "config.json").write_text(json.dumps({"unknown": 1} | json.loads(settings)))
    run("train-adapter", "--output-root", out, "--config", site / "config.json", "--settings", json.dumps({"seeds": [5]}))
    assert [r.seed for r in spark.read.parquet(f"{p['results']}/adapter_seed_logs").collect()] == [5]


def test_dataset_of_a_site_list(spark, run, site):
    (site / "sites.csv").write_text(f"site_id,site_dir,labels_csv\na,{site}/s1,\nb,{site}/s1,{site}/s1/labels.csv\n")
    run("build-dataset", "--output-root", site / "two", "--site-list-csv", site / "sites.csv", "--match-tolerance-minutes", 6)
    p = cli.paths(str(site / "two"))
    assert spark.read.parquet(p["splits"]).count() == 46 and spark.read.parquet(f"{p['splits']}_unmatched").groupBy("site_id").count().count() == 2
    with pytest.raises(ValueError):
        run("build-dataset", "--output-root", site / "none", "--site-list-csv", site / "sites.csv", "--match-tolerance-minutes", 4)
    with pytest.raises(SystemExit):
        run("build-dataset", "--output-root", site / "two")


def test_files_are_linked_copied_and_moved(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.jpg").write_text(n)
    rows = [(f"file://{tmp_path}/{n}.jpg", s, f"{tmp_path}/to/{n}.jpg") for n, s in (("a", "train"), ("b", "val"), ("c", "test"))] + [(f"{tmp_path}/no.jpg", "unused", f"{tmp_path}/to/no.jpg")]
    df = spark.createDataFrame(rows, "image_path string, split string, target string")
    (tmp_path / "root" / "train").mkdir(parents=True)
    (tmp_path / "root" / "train" / "old.jpg").write_text("old")
    for _ in range(2):
        assert [r.status for r in sinks.materialize_splits(df, str(tmp_path / "root")).collect()] == ["done"] * 3
        assert sorted(str(f.relative_to(tmp_path / "root")) for s in ("train", "val", "test") for f in (tmp_path / "root" / s).iterdir()) == ["test/c.jpg", "train/a.jpg", "val/b.jpg"]
    assert (tmp_path / "root" / "train" / "a.jpg").samefile(tmp_path / "a.jpg")
    place = lambda how, **more: {r.source[-5:]: r.status for r in sinks.place_files(df, "image_path", "target", str(tmp_path / "log"), how, **more).collect()}
    assert place("copy") == {"a.jpg": "done", "b.jpg": "done", "c.jpg": "done", "o.jpg": "failed"}
    assert place("copy")["a.jpg"] == "there" and place("copy", overwrite=True)["a.jpg"] == "done"
    assert place("move", overwrite=True)["b.jpg"] == "done" and not (tmp_path / "b.jpg").exists() and place("move")["b.jpg"] == "there"
    with pytest.raises(ValueError):
        place("melt")


def test_variant_manifests(spark):
    rows = [(s, f"{s}{i}.jpg", ("train", " Val", "test")[i % 3], 1.0, 2024, 1, datetime(2024, 1, 1)) for s in "ab" for i in range(3 if s == "a" else 2)]
    manifest = spark.createDataFrame(rows, "site_id string, image_path string, split string, discharge double, year int, month int, image_time timestamp_ntz")
    tasks = spark.createDataFrame([("a", "p05", "r1"), ("a", "p50", "r2")], "site_id string, variant string, roi_path string")
    assert pipeline.variant_manifest(manifest, tasks).groupBy("variant", "roi_path").count().count() == 2
    for bad in (tasks.union(spark.createDataFrame([("b", "p05", "r")], tasks.schema)), tasks.union(spark.createDataFrame([("z", "p05", "r")], tasks.schema))):
        with pytest.raises(ValueError):
            pipeline.variant_manifest(manifest, bad)
    with pytest.raises(ValueError):
        pipeline.variant_manifest(manifest.drop("year"), tasks)


def test_filter_references_and_tasks(spark, run, tmp_path, monkeypatch, capsys):
    root = tmp_path / "root"
    p = cli.paths(str(root))
    days = [datetime(2022, 10, 1, 18) + timedelta(days=8 * d) for d in range(136)]
    (tmp_path / "img").mkdir()
    for i in range(len(days)):
        (tmp_path / "img" / f"{i}.jpg").write_text(str(i))
    rows = [("g", "s", "c", "01", t, f"{tmp_path}/img/{i}.jpg", float(i)) for i, t in enumerate(days)]
    matched = spark.createDataFrame(rows, "river_group string, site_folder string, cam_id string, nwis_id string, image_time timestamp_ntz, image_path string, discharge double")
    sinks.write_table(matched, f"{p['matched']}_matched")
    good = {m: 0.5 for m in quality.METRICS} | {"gray_mean": 120.0, "gray_std": 60.0, "lap_var": 900.0, "colorfulness": 30.0, "bright_low_sat_ratio": 0.0, "raindrop_blob_count": 0.0, "glare_saturated_ratio": 0.0, "glare_very_bright_low_sat_ratio": 0.0}
    dark = F.col("image_path").endswith("/5.jpg")
    metrics = matched.select("image_path", F.lit(True).alias("read_ok"), *[F.when(dark, 0.0).otherwise(v).alias(m) for m, v in good.items()])
    monkeypatch.setattr(readers, "images", lambda *_: None)
    monkeypatch.setattr(pipeline, "quality_table", lambda *_: metrics)
    run("filter-images", "--output-root", root, "--link-splits", tmp_path / "links", "--move-dropped", tmp_path / "dropped")
    manifest = spark.read.parquet(p["splits"])
    assert manifest.count() == len(days) - 1 and [f.name for f in (tmp_path / "dropped").glob("*.jpg")] == ["5.jpg"]
    assert len(list((tmp_path / "links").glob("*/*.jpg"))) == manifest.where("split <> 'unused'").count()
    run("select-references", "--output-root", root, "--copy-to", tmp_path / "refs")
    assert len(list((tmp_path / "refs").glob("s_p*__target_*.jpg"))) == 3
    features = spark.createDataFrame([("a", "p05", 1.0), ("a", "p50", 1.0), ("b", "p05", 1.0)], "site_id string, variant string, discharge double")
    sinks.write_table(features, p["features"])
    capsys.readouterr()
    run("run-baselines", "--output-root", root, "--list-tasks", "--task-index", 1)
    assert [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == [{"site_id": "a", "variant": "p50", "task_index": 1}]
