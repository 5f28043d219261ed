"""Commands: python -m tarnwork.plans.cli COMMAND ... Each reads and writes tables under a data root."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import models, quality, relational, splits
from tarnwork.plans import pipeline
from tarnwork.sources import readers, rest, sinks


def paths(root: str) -> dict[str, str]:
    """Where a data root keeps what."""
    names = {"site_list": "site_list.csv", "pipeline_site_list": "pipeline_site_list.csv", "images": "images", "readings": "readings", "matched": "matched", "audit": "quality_audit", "splits": "split_manifest",
             "references": "roi_references", "regions": "rois", "features": "features", "results": "results", "config": "best_config.json"}
    return {k: f"{root.rstrip('/')}/{v}" for k, v in names.items()}


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def prepare_data(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    sites = readers.site_list(spark, a.site_csv or p["site_list"], a.only_cam_id, a.only_river_group)
    if a.listing_url:
        if not a.camera_url:
            raise SystemExit("--listing-url needs --camera-url, which tells from when on to list")
        asked = rest.listing(sites.select("cam_id"), a.camera_url, a.listing_url, a.limit)
        sinks.write_table(rest.listed_images(asked, a.image_url), f"{p['images']}_listing")
        listing = spark.read.parquet(f"{p['images']}_listing")
        if a.skip_download:
            manifest = listing.withColumn("image_time", F.col("timestamp_utc"))
        else:
            manifest, failed = rest.download(listing, None, p["images"])
            sinks.write_table(failed, f"{p['images']}_failed")
    else:
        manifest = spark.read.parquet(f"{p['images']}_manifest")
    if a.gauge_url:
        windows = pipeline.request_windows(sites, manifest, a.hydro_buffer_days)
        origin = rest.gauge_readings(rest.gauge_payloads(windows, a.gauge_url), "nwis_iv", gauge="nwis_id")
        sinks.write_table(origin, f"{p['readings']}_origin")
        origin = spark.read.parquet(f"{p['readings']}_origin")
        sinks.write_table(pipeline.wide_readings(origin, ["nwis_id"]), p["readings"])
        sinks.write_table(pipeline.hydro_summary(origin), f"{p['readings']}_summary")
    out = pipeline.prepare(sites, manifest, spark.read.parquet(p["readings"]), a.hydro_buffer_days, a.max_gap_minutes)
    for name, df in out.items():
        sinks.write_table(df, f"{p['matched']}_{name}")


def show_tasks(tasks) -> None:
    """Prints every task as a line of JSON."""
    for line in tasks.toJSON().toLocalIterator():
        print(line)


def filter_images(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    matched = spark.read.parquet(f"{p['matched']}_matched")
    matched = matched.where(F.col("site_folder").isin(a.site_name)) if a.site_name else matched
    changes = {"local_day_start_hour": a.day_start, "local_day_end_hour": a.day_end, "fallback_val_ratio": a.fallback_val_ratio, "min_images_per_water_year": a.min_images_per_water_year} | json.loads(a.limits)
    c = quality.limits(**changes)
    metrics = pipeline.quality_table(readers.images(spark, p["images"]), c)
    out = pipeline.filter_images(matched, metrics, ["river_group", "site_folder"], "image_path", a.test_water_year, None, c, a.strict, a.rough_year_min_months, a.seed)
    sinks.write_table(out["audit"], p["audit"])
    sinks.write_table(out["summary"], f"{p['audit']}_summary")
    if a.activate_filtered:
        sinks.activate(out["split_manifest"], a.output_root, "split_manifest")
        manifest = sinks.current(spark, a.output_root, "split_manifest")
    else:
        sinks.write_table(out["split_manifest"], p["splits"])
        manifest = spark.read.parquet(p["splits"])
    if a.link_splits:
        sinks.materialize_splits(manifest, a.link_splits)
    if a.move_dropped:
        gone = relational.quarantine(matched.select("image_path"), manifest, spark.read.parquet(p["audit"]))
        sinks.write_table(relational.quarantine_names(gone).withColumn("target", F.concat_ws("/", F.lit(a.move_dropped), "target")), f"{p['audit']}_moved")
        sinks.place_files(spark.read.parquet(f"{p['audit']}_moved"), "image_path", "target", a.move_dropped, "move")


def select_references(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    manifest = spark.read.parquet(p["splits"])
    manifest = manifest.where(F.col("site_folder").isin(a.site_dir)) if a.site_dir else manifest
    chosen = sinks.reference_names(splits.choose_references(manifest, ["site_folder"]), "site_folder")
    sinks.write_table(chosen, p["references"])
    if a.copy_to:
        named = spark.read.parquet(p["references"]).withColumn("_to", F.concat_ws("/", F.lit(a.copy_to), "reference_name"))
        sinks.place_files(named, "image_path", "_to", a.copy_to, "copy", a.overwrite)


def run_variants(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    tasks = relational.cross_tasks(readers.pipeline_sites(spark, a.site_list_csv or p["pipeline_site_list"]), ["p05", "p50", "p95"], a.site_id, a.variant)
    tasks = relational.task_indexed(tasks, "site_id", "variant")
    tasks = tasks.where(F.col("task_index") == a.task_index) if a.task_index is not None else tasks
    if a.list_tasks or a.dry_run:
        show_tasks(tasks.orderBy("task_index"))
        return
    if a.manifest:
        own = tasks.withColumn("roi_path", F.concat(F.lit(f"{p['regions']}/"), "site_id", F.lit("_"), "variant", F.lit(".json")))
        sinks.write_table(pipeline.variant_manifest(spark.read.parquet(a.manifest), own), f"{p['splits']}_variants", ("site_id", "variant"))
    features = spark.read.parquet(p["features"]).join(tasks.select("site_id", "variant"), ["site_id", "variant"], "left_semi")
    for name, df in pipeline.evaluate(features, ["site_id", "variant"], **json.loads(a.settings)).items():
        sinks.write_table(df, f"{p['results']}/mixture_{name}")


def run_baselines(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    features = readers.features(spark.read.parquet(p["features"]), drop_sentinel=False)
    tasks = relational.task_indexed(features.select("site_id", "variant").distinct(), "site_id", "variant")
    tasks = tasks.where(F.col("task_index") == a.task_index) if a.task_index is not None else tasks
    if a.list_tasks:
        show_tasks(tasks.orderBy("task_index"))
        return
    if a.task_index is not None:
        features = features.join(tasks.select("site_id", "variant"), ["site_id", "variant"], "left_semi")
    for name, df in pipeline.baselines(features, ["site_id", "variant"]).items():
        sinks.write_table(df, f"{p['results']}/baseline_{name}")


def split_folders(a) -> dict[str, str]:
    return {"train": a.train_dir_name, "val": a.val_dir_name, "test": a.test_dir_name}


def dataset(spark: SparkSession, a):
    """(manifest, unmatched) of one site folder, or of every row of a site list, whose label files have columns of their own."""
    if not a.site_dir and not a.site_list_csv:
        raise SystemExit("--site-dir or --site-list-csv is needed")
    if a.site_dir:
        return pipeline.build_site(spark, a.site_dir, a.labels_csv, split_folders(a), a.match_tolerance_minutes, a.roi_path)
    sites = [r.asDict() for r in readers.pipeline_sites(spark, a.site_list_csv).toLocalIterator()]
    parts = [pipeline.build_site(spark, s["site_dir"], s.get("labels_csv"), split_folders(a), a.match_tolerance_minutes, s.get("roi_path") or a.roi_path, s["site_id"]) for s in sites]
    matched, unmatched = (list(p) for p in zip(*parts, strict=True))
    return pipeline.build_sites(matched), pipeline.build_sites(unmatched, check=False)


def build_dataset(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    manifest, unmatched = dataset(spark, a)
    sinks.write_table(manifest, p["splits"])
    sinks.write_table(unmatched, f"{p['splits']}_unmatched")
    sinks.write_table(relational.value_counts(spark.read.parquet(p["splits"]), "split"), f"{p['splits']}_summary")


def extract(spark: SparkSession, a, manifest) -> None:
    p = paths(a.output_root)
    regions = readers.roi(spark, a.roi_path or p["regions"]) if a.with_regions else None
    folder = a.site_dir or p["images"]
    table = pipeline.feature_table(manifest, readers.images(spark, folder), a.backbone, regions, not a.disable_water_mask, a.stand_in)
    sinks.write_table(table, p["features"])


def extract_features(spark: SparkSession, a) -> None:
    extract(spark, a, spark.read.parquet(a.manifest or paths(a.output_root)["splits"]))


def train(spark: SparkSession, a, keys: list[str], name: str) -> None:
    """Trains and evaluates; settings come from a JSON file, and changes to it from --settings."""
    p = paths(a.output_root)
    held = "\n".join(r.value for r in spark.read.text(a.config).toLocalIterator()) if a.config else "{}"
    settings = {k: v for k, v in json.loads(held).items() if k in models.BEST} | json.loads(a.settings)
    features = readers.features(spark.read.parquet(p["features"]))
    for what, df in pipeline.evaluate(features, [k for k in keys if k in features.columns], **settings).items():
        sinks.write_table(df, f"{p['results']}/{name}_{what}")


def train_adapter(spark: SparkSession, a) -> None:
    train(spark, a, a.key, "adapter")


def run_best(spark: SparkSession, a) -> None:
    p = paths(a.output_root)
    if a.site_dir or a.site_list_csv:
        build_dataset(spark, a)
    manifest = spark.read.parquet(a.manifest or p["splits"])
    sinks.write_splits(manifest, f"{p['results']}/splits")
    extract(spark, a, manifest)
    train(spark, a, ["site_id", "site_folder"], "best")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tarnwork")
    commands = parser.add_subparsers(dest="command", required=True)
    folders = {"site-dir": None, "labels-csv": None, "site-list-csv": None, "match-tolerance-minutes": 30.0, "train-dir-name": "train", "val-dir-name": "val", "test-dir-name": "test", "roi-path": None}
    pixels = {"manifest": None, "backbone": "convnext_tiny", "with-regions": False, "disable-water-mask": False, "stand-in": False}
    options = {
        prepare_data: {"site-csv": None, "limit": 50000, "hydro-buffer-days": 2, "max-gap-minutes": 90.0, "only-cam-id": None, "only-river-group": None, "skip-download": False, "listing-url": None, "camera-url": None, "image-url": "", "gauge-url": None},
        filter_images: {"test-water-year": 2025, "fallback-val-ratio": 0.2, "min-images-per-water-year": 1, "day-start": 8.0, "day-end": 18.5, "rough-year-min-months": 10, "seed": 42, "site-name": [], "activate-filtered": False, "strict": False, "limits": "{}", "link-splits": None, "move-dropped": None},
        select_references: {"site-dir": [], "overwrite": False, "copy-to": None},
        run_variants: {"site-list-csv": None, "site-id": [], "variant": [], "task-index": 0, "list-tasks": False, "dry-run": False, "settings": "{}", "manifest": None},
        run_baselines: {"list-tasks": False, "task-index": 0},
        build_dataset: folders,
        extract_features: pixels | {"site-dir": None, "roi-path": None},
        train_adapter: {"key": ["site_id"], "config": None, "settings": "{}"},
        run_best: folders | pixels | {"config": None, "settings": "{}"},
    }
    for run, own in options.items():
        sub = commands.add_parser(run.__name__.replace("_", "-"))
        sub.add_argument("--output-root", required=True)
        sub.set_defaults(run=run)
        for name, default in own.items():
            if isinstance(default, bool):
                sub.add_argument(f"--{name}", action="store_true")
            elif isinstance(default, list):
                sub.add_argument(f"--{name}", nargs="*", default=default)
            else:
                sub.add_argument(f"--{name}", type=str if default is None else type(default), default=None if name == "task-index" else default)
    args = parser.parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
