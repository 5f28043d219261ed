"""Readers of files: tables with declared schemas, images and their paths, regions of interest, manifests by precedence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.calendar import stamped_time
from tarnwork.functions.text import basename, normal_label, plain_path, to_double, to_time
from tarnwork.operators.guards import first_column, require_columns, require_rows
from tarnwork.operators.timeseries import keep_first, pivot_last

SITES = "river_group string, site_folder string, cam_id string, nwis_id string"
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
#: File names in order of precedence, and the codes of the two measured variables.
LABEL_FILES = ("matched.csv", "labels.csv", "images_labeled_exact.csv", "features_raw.csv", "origin.csv", "long_table.csv")
MANIFEST_FILES = ("split_manifest.csv", "split_manifest_filtered.csv")
VARIABLES = {"00060": "discharge", "60": "discharge", "00065": "gauge_height", "65": "gauge_height"}
SENTINEL = -999999.0


def csv(spark: SparkSession, path: str, schema: str | None = None, infer: bool = False) -> DataFrame:
    """A CSV table with a header; without a schema all columns are text, or, with infer, of the type that all their cells have (a second pass). A byte-order mark before the first name is dropped."""
    out = spark.read.csv(path, header=True, enforceSchema=False, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=infer)
    return out.toDF(*[c.lstrip("﻿") for c in out.columns])


def site_list(spark: SparkSession, path: str, cam_id: str | None = None, river_group: str | None = None) -> DataFrame:
    """Sites as text (leading zeros stay, missing cells are empty), of one camera or group if asked for."""
    out = csv(spark, path).na.fill("")
    require_columns(out, ["river_group", "site_folder", "cam_id", "nwis_id"])
    for name, value in (("cam_id", cam_id), ("river_group", river_group)):
        out = out.where(F.col(name) == value) if value else out
    return require_rows(out, path)


def pipeline_sites(spark: SparkSession, path: str, wanted: Iterable[str] = ()) -> DataFrame:
    """site_id, site_dir and, where given, labels_csv and roi_path (blank cells count as missing)."""
    out = require_columns(csv(spark, path), ["site_id", "site_dir"])
    out = out.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in out.columns})
    return require_rows(out.where(F.col("site_id").isin(list(wanted))) if wanted else out, path)


def files(spark: SparkSession, path: str, extensions: Iterable[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, length) of files under a folder at any depth; their content is not read."""
    pattern = "(?i)\\.(" + "|".join(extensions) + ")$"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where(F.col("path").rlike(pattern))


def timed_images(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """image_path, filename, image_time, year, month of files whose name has a time stamp, in order of time."""
    out = files(spark, path).select(plain_path(F.col("path")).alias("image_path"), basename(F.col("path")).alias("filename"), stamped_time(basename(F.col("path"))).alias("image_time"))
    out = out.where(F.col("image_time").isNotNull()).withColumns({"year": F.year("image_time"), "month": F.month("image_time")})
    return require_rows(out, path) if check else out


def split_images(spark: SparkSession, site_dir: str, folders: dict[str, str], roi_path: str | None = None) -> DataFrame:
    """timed_images() of the folders of splits ({split: folder}): adds split, site_dir and roi_path."""
    names = F.create_map(*[F.lit(x) for split, folder in folders.items() for x in (folder, split)])
    out = timed_images(spark, [f"{site_dir}/{f}" for f in folders.values()], check=False)
    own = F.regexp_extract("image_path", r"/([^/]+)/[^/]+$", 1)
    return out.withColumns({"split": names[own], "site_dir": F.lit(site_dir), "roi_path": F.lit(roi_path).cast("string")})


def site_folders(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """river_group, site_id, path of folders root/river/site that hold a marker file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(root).select("path")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -3).alias("river_group"), F.element_at(parts, -2).alias("site_id"), F.regexp_replace("path", "/[^/]+$", "").alias("path"))


def by_precedence(spark: SparkSession, folder: str, names: Iterable[str] = LABEL_FILES) -> str | None:
    """The path of the first of names that the folder (or one below it) holds."""
    order = {n: i for i, n in enumerate(names)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path")
    found = listed.withColumn("rank", rank[basename(F.col("path"))]).where("rank is not null")
    return found.agg(F.min_by("path", F.struct("rank", "path"))).first()[0]


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A label table; the long form (variable_cd, value) becomes one column for each variable."""
    df = csv(spark, path)
    if not {"variable_cd", "value"} <= set(df.columns):
        return df
    time = first_column(df, ("datetime_utc", "time", "datetime"))
    long = df.select(to_time(F.col(time)).alias("time"), F.create_map(*[F.lit(x) for kv in VARIABLES.items() for x in kv])[F.trim("variable_cd")].alias("name"), to_double(F.col("value")).alias("value"))
    long = long.where(F.col("time").isNotNull()).withColumn("seq", F.monotonically_increasing_id())
    return pivot_last(long, ["time"], "name", "value", ["seq"], ["discharge", "gauge_height"])


def direct_labels(df: DataFrame) -> DataFrame | None:
    """filename, image_time, hydro_time, discharge, gauge_height, one row for each file; None if the columns are not there."""
    name = first_column(df, ("filename", "image_path", "path"))
    if not name or not {"image_time", "hydro_time", "discharge"} <= set(df.columns):
        return None
    height = to_double(F.col("gauge_height")) if "gauge_height" in df.columns else F.lit(None).cast("double")
    out = df.select(basename(F.col(name)).alias("filename"), to_time(F.col("image_time")).alias("image_time"), to_time(F.col("hydro_time")).alias("hydro_time"), to_double(F.col("discharge")).alias("discharge"), height.alias("gauge_height"))
    out = out.dropna(subset=["filename", "image_time", "discharge"]).withColumn("_seq", F.monotonically_increasing_id())
    return keep_first(out, ["filename"], ["_seq"]).drop("_seq")


def hydro_table(df: DataFrame) -> DataFrame:
    """time, discharge, gauge_height; rows without time or discharge are left out."""
    time = first_column(df, ("time", "datetime_utc", "hydro_time", "datetime"))
    if not time or "discharge" not in df.columns:
        raise ValueError("a table of readings needs a time column and discharge")
    height = to_double(F.col("gauge_height")) if "gauge_height" in df.columns else F.lit(None).cast("double")
    return df.select(to_time(F.col(time)).alias("time"), to_double(F.col("discharge")).alias("discharge"), height.alias("gauge_height")).dropna(subset=["time", "discharge"])


def roi(spark: SparkSession, path: str) -> DataFrame:
    """roi_path and region struct(image_width, image_height, polygon): the first shape labelled roi, else the first with points. Files without one raise."""
    schema = "imageWidth int, imageHeight int, shapes array<struct<label:string,points:array<array<double>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("roi_path", F.input_file_name())
    named = F.get(F.filter("shapes", lambda s: (F.lower(F.trim(s["label"])) == "roi") & (F.size(s["points"]) > 0)), F.lit(0))
    some = F.get(F.filter("shapes", lambda s: F.size(s["points"]) > 0), F.lit(0))
    points = F.transform(F.coalesce(named, some)["points"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    out = raw.select("roi_path", F.when(points.isNotNull(), F.struct(F.col("imageWidth").alias("image_width"), F.col("imageHeight").alias("image_height"), points.alias("polygon"))).alias("region"))
    if bad := out.where("region is null").limit(1).collect():
        raise ValueError(f"no shape with points in {bad[0].roi_path}")
    return out


def images(spark: SparkSession, path: str) -> DataFrame:
    """Spark's image source, with paths as timed_images() writes them; what can't be decoded keeps its path, with height -1."""
    names = ",".join(f"*.{e}" for x in IMAGE_EXTENSIONS for e in (x, x.upper()))
    out = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{names}}}").load(path)
    return out.withColumn("image", F.col("image").withField("origin", plain_path(F.col("image.origin"))))


def features(df: DataFrame, truth: str = "discharge", years: tuple[int, ...] | None = None, drop_sentinel: bool = True) -> DataFrame:
    """Feature rows with a numeric truth (the sentinel counts as missing unless kept), of some years if asked for; adds log_{truth} and normalises split."""
    out = df.withColumn(truth, to_double(F.col(truth)))
    out = out.where(F.col(truth).isNotNull())
    out = out.where(F.col(truth) != SENTINEL) if drop_sentinel else out
    out = out.where(F.col("year").cast("int").isin(list(years))) if years else out
    out = out.withColumn("split", normal_label(F.col("split"))) if "split" in out.columns else out
    return out.withColumn(f"log_{truth}", F.when(F.col(truth) > -1, F.log1p(truth)))
