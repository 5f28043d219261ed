"""Compositions: from listings and readings to matched images, filtered and split manifests, features and models.

Every stage is one DataFrame over all sites, keyed by site; nothing loops over sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.calendar import SITE_ZONES, with_local_clock
from tarnwork.functions.stats import ensemble, mixture, regression_metrics, score_summary, with_ensemble_weights
from tarnwork.functions.text import normal_site_id
from tarnwork.operators import models, quality, relational, splits, timeseries
from tarnwork.operators.guards import one_to_one, require_columns, require_rows, single_value, without_quality
from tarnwork.operators.pixels import image_metrics
from tarnwork.operators.vision import embed, embedder
from tarnwork.sources.readers import by_precedence, direct_labels, hydro_table, labels, split_images

CODES = {"00060": "discharge", "60": "discharge"}


def wide_readings(origin: DataFrame, keys: list[str]) -> DataFrame:
    """keys, time, discharge from long readings: the last known value of each time."""
    known = origin.where(F.col("variable_cd").isin(list(CODES))).withColumn("_seq", F.monotonically_increasing_id())
    return timeseries.pivot_last(known.withColumn("_name", F.lit("discharge")), [*keys, "datetime_utc"], "_name", "value", ["_seq"], ["discharge"]).withColumnRenamed("datetime_utc", "time")


def hydro_summary(origin: DataFrame, site: str = "site_no") -> DataFrame:
    """Per site: rows of each variable, and whether there is discharge."""
    n = origin.groupBy(site, "variable_cd").agg(F.count("*").alias("n"))
    return n.groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable_cd", "n")))).alias("counts"), F.max(F.col("variable_cd").isin(list(CODES))).alias("has_discharge"))


def placed_images(sites: DataFrame, images: DataFrame) -> DataFrame:
    own = single_value(sites, "river_group", "nwis_id").select("river_group", "site_folder", "cam_id", "nwis_id")
    return images.join(own, "cam_id")


def request_windows(sites: DataFrame, images: DataFrame, buffer_days: int = 2) -> DataFrame:
    """Of each gauge, the span to ask for: that of all images of its cameras, with days to spare."""
    return timeseries.request_window(placed_images(sites, images), ["nwis_id"], "image_time", buffer_days)


def prepare(sites: DataFrame, images: DataFrame, readings: DataFrame, buffer_days: int = 2, max_gap_minutes: float = 90.0) -> dict[str, DataFrame]:
    """windows (what to ask the gauges for), matched_all and matched of all cameras. Cameras of a river group share one gauge.

    sites: river_group, site_folder, cam_id, nwis_id. images: cam_id, image_time and more. readings: nwis_id, time, discharge.
    """
    placed = placed_images(sites, images)
    windows = timeseries.request_window(placed, ["nwis_id"], "image_time", buffer_days)
    matched = timeseries.align_images(placed, readings, ["nwis_id"], max_gap_minutes)
    return {"windows": windows, "matched_all": matched, "matched": timeseries.valid_matches(matched)}


def zone_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(s, *z) for s, z in SITE_ZONES.items()], "site string, zone string, day_start double, day_end double")


def filter_images(
    matched: DataFrame, metrics: DataFrame, site: list[str], key: str, test_year: int, zones: DataFrame | None = None, c: quality.Limits | None = None, strict: bool = False, least_months: int = 10, seed: int = 42
) -> dict[str, DataFrame]:
    """audit (all rows with flags and reasons), kept, years and split manifests of all sites. strict: complete water years only."""
    c = c or quality.limits()
    original = without_quality(matched)
    require_columns(original, [*site, "image_path", "image_time"])
    named = original.withColumn("quality_site_id", normal_site_id(F.col(site[-1]))).withColumn("quality_image_time", F.col("image_time"))
    clocked = with_local_clock(named, zones if zones is not None else zone_table(matched), "quality_site_id", "image_time", c.local_day_start_hour, c.local_day_end_hour, c.use_site_day_windows)
    joined = one_to_one(clocked, metrics, ["image_path"]).withColumn("read_ok", F.coalesce("read_ok", F.lit(False)))
    audit = quality.classify(joined, site, c)
    kept = audit.where(F.coalesce("quality_keep", F.lit(False))).select(*original.columns)
    if strict:
        manifest = splits.strict_year_split(kept, site, "image_time", key, test_year, c.fallback_val_ratio, c.min_images_per_water_year)
    else:
        manifest = splits.rough_year_split(kept, site, "image_time", key, test_year, c.fallback_val_ratio, c.min_images_per_water_year, least_months, seed)
    summary = audit.groupBy(*site).agg(F.count("*").alias("n_images"), F.count_if("quality_keep").alias("n_kept"), F.count_if("quality_review").alias("n_review"))
    summary = summary.withColumn("keep_ratio", F.col("n_kept") / F.greatest(F.lit(1), "n_images"))
    reasons = audit.where(~F.col("quality_keep")).groupBy(*site, "quality_reasons").count()
    return {"audit": audit, "kept": kept, "years": splits.water_year_summary(kept, site, "image_time", c.min_images_per_water_year), "split_manifest": manifest, "summary": summary, "drop_reasons": reasons}


def quality_table(images: DataFrame, c: quality.Limits | None = None) -> DataFrame:
    return image_metrics(images, c)


def build_dataset(images: DataFrame, label_table: DataFrame, on: list[str], tolerance_minutes: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(manifest, unmatched): labels by file name where the table has them, else the nearest reading within the tolerance."""
    direct = direct_labels(label_table)
    if direct is not None:
        joined = images.join(direct.select("filename", "hydro_time", "discharge", "gauge_height"), "filename", "left")
    else:
        readings = hydro_table(label_table) if not on else label_table
        joined = timeseries.asof_nearest(images, readings, on, "image_time", "time", ["discharge", "gauge_height"], tolerance_minutes).withColumnRenamed("matched_time", "hydro_time")
    matched, unmatched = relational.matched_unmatched(joined, "discharge")
    first = [c for c in ("roi_path", "site_dir", "site_id", "split") if c in matched.columns]
    return matched.select(*first, "image_path", "image_time", "year", "month", "hydro_time", "discharge", "gauge_height"), unmatched


def build_site(spark: SparkSession, site_dir: str, label_file: str | None, folders: dict[str, str], tolerance_minutes: float = 30.0, roi_path: str | None = None, site_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, unmatched) of a site whose images lie in a folder for each split; the label file is looked for if not given."""
    label_file = label_file or by_precedence(spark, site_dir)
    if not label_file:
        raise ValueError(f"no label file in {site_dir}")
    images = split_images(spark, site_dir, folders, roi_path).withColumn("site_id", F.lit(site_id or site_dir.rstrip("/").split("/")[-1]))
    return build_dataset(images, labels(spark, label_file), [], tolerance_minutes)


#: What the manifest of a variant has to have.
VARIANT_COLUMNS = ("image_path", "split", "discharge", "year", "month", "image_time")


def variant_manifest(manifest: DataFrame, tasks: DataFrame) -> DataFrame:
    """The manifest's rows for each task (site_id, variant, roi_path) of their site; every task needs rows of each split."""
    require_columns(manifest, ["site_id", *VARIANT_COLUMNS])
    own = tasks.select("site_id", "variant", "roi_path")
    out = manifest.drop("variant", "roi_path").join(own, "site_id")
    n = out.groupBy("site_id", "variant").agg(*[F.count_if(F.lower(F.trim("split")) == s).alias(s) for s in splits.SPLITS])
    short = own.join(n, ["site_id", "variant"], "left").where(" or ".join(f"coalesce({s}, 0) = 0" for s in splits.SPLITS)).limit(1).collect()
    if short:
        raise ValueError(f"no rows of every split for {short[0].site_id}, {short[0].variant}")
    return out


def build_sites(parts: list[DataFrame], check: bool = True) -> DataFrame:
    """One table of several sites' manifests; columns that a site lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return require_rows(out, "dataset") if check else out


#: Paths up to which their table is broadcast to the pictures (some 200 bytes each); beyond, the pictures are shuffled by path.
BROADCAST_PATHS = 200_000


def feature_table(manifest: DataFrame, images: DataFrame, backbone: str = "convnext_tiny", regions: DataFrame | None = None, refine: bool = True, stand_in: bool = False) -> DataFrame:
    """The manifest with an embedding of each image; regions (roi_path, region) come with the manifest's roi_path."""
    make, region = embedder(backbone, stand_in), None
    if regions is not None:
        region = "region"
        paths = manifest.select(F.col("image_path").alias("_path"), "roi_path").join(regions, "roi_path", "left").select("_path", region)
        few = manifest.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
        images = images.join(F.broadcast(paths) if few else paths, images["image.origin"] == paths["_path"]).select("image", region)
    return manifest.join(embed(images, make, region, refine), "image_path", "left")


def evaluate(features: DataFrame, keys: list[str], seeds: list[int] | None = None, **changes) -> dict[str, DataFrame]:
    """metrics, predictions and seed_logs of the seed ensemble for each key."""
    settings = models.BEST | changes
    runs = models.evaluate_mixture(features, keys, seeds, **changes)
    soft = (1 - F.col("gate")) * F.col("low") + F.col("gate") * F.col("high")
    each = runs.groupBy(*keys, "seed").agg(F.first("val_r2").alias("val_r2_from_fit"), F.first("best_epoch").alias("best_epoch"), regression_metrics(F.col("discharge_true"), soft)[2].alias("test_soft_r2_seed"))
    weights = with_ensemble_weights(each, "val_r2_from_fit", settings["ensemble_mode"], settings["ensemble_weight_power"], settings["ensemble_topk"], tuple(keys), "seed")
    mixed = ensemble(runs, weights.select(*keys, "seed", "weight"), (*keys, "seed"), (*keys, "image_path", "discharge_true", "threshold"), ("low", "high", "gate"))
    made = mixture(F.col("low"), F.col("high"), F.col("gate"), F.col("discharge_true"), F.col("threshold"))
    predictions = mixed.withColumns(made).withColumnsRenamed({"low": "pred_low", "high": "pred_high", "gate": "p_high"})
    kinds = ("soft", "hard", "seg_oracle", "expert_oracle")
    scores = [m.alias(f"{k}_{n}") for k in kinds for m, n in zip(regression_metrics(F.col("discharge_true"), F.col(f"pred_{k}")), ("MAE", "RMSE", "R2", "Bias"), strict=True)]
    metrics = predictions.groupBy(*keys).agg(F.count("*").alias("n_test"), *scores)
    seeds_summary = weights.groupBy(*keys).agg(*[c.alias(f"seed_r2_{n}") for c, n in zip(score_summary(F.col("test_soft_r2_seed"), F.col("weight")), ("weighted", "mean", "std", "max"), strict=True)])
    return {"metrics": metrics.join(seeds_summary, keys), "predictions": predictions, "seed_logs": weights}


def baselines(features: DataFrame, keys: list[str], trees: int = 500) -> dict[str, DataFrame]:
    """metrics and predictions of the linear baseline (svm) and the random forest (random_forest), each fitted for each key.

    converged tells of the svm whether it did; it is null for the forest.
    """
    counts = features.groupBy(*keys).agg(F.count_if(F.lower(F.trim("split")).isin("train", "val")).alias("n_train"), F.count_if(F.lower(F.trim("split")) == "test").alias("n_test"))
    made = {"svm": models.svr_baseline(features, keys), "random_forest": models.forest_baseline(features, keys, trees=trees).withColumn("converged", F.lit(None).cast("boolean"))}
    predictions = [p.withColumn("model", F.lit(m)) for m, p in made.items()]
    metrics = [p.groupBy(*keys, "model").agg(*regression_metrics(F.col("discharge_true"), F.col("pred")), F.bool_and("converged").alias("converged")).join(counts, keys) for p in predictions]
    return {"metrics": metrics[0].unionByName(metrics[1]), "predictions": predictions[0].unionByName(predictions[1])}


def compare_models(metrics: DataFrame) -> dict[str, DataFrame]:
    """The best variant of each site and model, and the best model of each site, by R2."""
    by_model = relational.best_per(metrics, ["site_id", "model"], "R2", ["variant"])
    return {"by_model": by_model, "by_site": relational.best_per(by_model, ["site_id"], "R2", ["model", "variant"])}
