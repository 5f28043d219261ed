"""Writers: tables, JSON documents, versioned activation, splits, and files that are linked, copied or moved on executors."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import plain_path
from tarnwork.operators.guards import require_classes


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A small document through Hadoop's file systems, so that any store works."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(df: DataFrame, path: str) -> dict:
    """The one row of df as an indented JSON document."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    write_text(df, path, json.dumps(json.loads(rows[0]), indent=2, ensure_ascii=False))
    return json.loads(rows[0])


def activate(df: DataFrame, root: str, name: str) -> str:
    """Writes a new version beside the earlier ones and points to it; a version that is being read is never touched."""
    path = f"{root}/{name}/version={time.time_ns()}"
    df.write.parquet(path)
    write_text(df, f"{root}/{name}.current", path)
    return path


def current(df_or_spark, root: str, name: str) -> DataFrame:
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.read.parquet(spark.read.text(f"{root}/{name}.current").first()[0])


def write_splits(manifest: DataFrame, path: str) -> DataFrame:
    """train (as train_pool), val and test rows in folders of their own; raises if one has no rows; returns the counts."""
    known = require_classes(manifest.withColumn("split", F.lower(F.trim("split"))), "split", ("train", "val", "test"))
    known = known.where(F.col("split").isin("train", "val", "test")).withColumn("split", F.when(F.col("split") == "train", "train_pool").otherwise(F.col("split")))
    known.write.mode("overwrite").partitionBy("split").parquet(path)
    return manifest.sparkSession.read.parquet(path).groupBy("split").count()


def place_files(df: DataFrame, source: str, target: str, folder: str, how: str = "link", overwrite: bool = False, parallel: int = 64) -> DataFrame:
    """(source, target, status, error): each source linked (copied where links can't be), copied or moved to its target, on a mount that executors share.

    Status is done, there (the target stood already and overwrite is off; a move whose source has gone) or failed. A target
    appears whole or not at all, so a task may run again. What was done is written below folder/_placed and read from there.
    """
    if how not in ("link", "copy", "move"):
        raise ValueError(f"no way to place files: {how}")

    def put(source: str, target: str) -> str:
        import os
        import shutil
        import uuid

        if os.path.exists(target) and (not overwrite or not os.path.exists(source) or os.path.samefile(source, target)):
            return "there"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        if how == "move":
            shutil.move(source, target)
            return "done"
        own = f"{target}.{uuid.uuid4().hex}"
        try:
            if how == "link":
                try:
                    os.link(source, own)
                except OSError:
                    shutil.copy2(source, own)
            else:
                shutil.copy2(source, own)
            os.replace(own, target)
        finally:
            if os.path.exists(own):
                os.remove(own)
        return "done"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            status, errors = [], []
            for r in frame.itertuples(index=False):
                try:
                    status.append(put(r.source, r.target))
                    errors.append(None)
                except OSError as e:  # goes to the table
                    status.append("failed")
                    errors.append(repr(e))
            yield frame.assign(status=status, error=errors)

    local = [plain_path(F.col(c)).alias(n) for c, n in ((source, "source"), (target, "target"))]
    path = f"{folder}/_placed/run={time.time_ns()}"
    df.select(*local).repartition(parallel).mapInPandas(run, "source string, target string, status string, error string").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize_splits(manifest: DataFrame, root: str) -> DataFrame:
    """Folders train, val and test below root, made anew: each holds links to its images."""
    links = split_links(manifest.where(F.col("split").isin("train", "val", "test")), root)
    for split in ("train", "val", "test"):
        remove(manifest.sparkSession, f"{root}/{split}")
    return place_files(links, "image_path", "link_path", root)


def split_links(manifest: DataFrame, root: str) -> DataFrame:
    """image_path and link_path: where each image belongs in the folders of splits."""
    return manifest.select("image_path", F.concat_ws("/", F.lit(root), "split", F.element_at(F.split("image_path", "/"), -1)).alias("link_path"))


def reference_names(df: DataFrame, site: str, value: str = "discharge") -> DataFrame:
    """Adds reference_name and roi_name of chosen rows: site and variant, with target, actual value and time as safe parts, and the source's extension."""
    from tarnwork.functions.text import safe_token

    def number(c: str):
        return safe_token(F.regexp_replace(F.round(F.col(c).cast("double"), 3).cast("string"), "E", "e"))

    stem = F.concat_ws("_", site, "variant")
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("image_path", r"(\.[^./]*)$", 1)), F.lit("")), F.lit(".jpg"))
    name = F.concat(stem, F.lit("__target_"), number("target"), F.lit("__actual_"), number(value), F.lit("__"), safe_token(F.col("image_time").cast("string")), ext)
    return df.withColumns({"reference_name": name, "roi_name": F.concat(stem, F.lit(".json"))})
