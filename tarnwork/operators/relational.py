"""Plain relational operators with the semantics that the pipeline needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each value without nulls, the most frequent first."""
    return df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def distinct_joined(df: DataFrame, keys: list[str], column: str, separator: str = "|", out: str = "joined") -> DataFrame:
    """The sorted distinct values of each key as one text."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_set(column)), lambda x: x.cast("string")), separator).alias(out))


def matched_unmatched(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(column).isNotNull()), df.where(F.col(column).isNull())


def quarantine(files: DataFrame, kept: DataFrame, audit: DataFrame, path: str = "image_path") -> DataFrame:
    """Files that were not kept: path, reason, quality_reasons. The reason is the quality filter if the audit did not keep the file, else that it has no match."""
    own = audit.select(path, F.col("quality_keep").alias("_keep"), "quality_reasons").dropDuplicates([path])
    out = files.select(path).distinct().join(kept.select(path).distinct(), path, "left_anti").join(own, path, "left")
    reason = F.when(~F.coalesce("_keep", F.lit(True)), "quality_filter").otherwise("not_in_kept_matched")
    return out.select(path, reason.alias("reason"), F.coalesce("quality_reasons", F.lit("")).alias("quality_reasons"))


def quarantine_names(df: DataFrame, path: str = "image_path", taken: DataFrame | None = None) -> DataFrame:
    """Adds target, a file name that no other row has: repeated names get __filtered_1, _2, ... in order of the path."""
    name = F.element_at(F.split(path, "/"), -1)
    n = F.row_number().over(Window.partitionBy(name).orderBy(path)) - 1
    if taken is not None:
        df = df.join(taken.select(F.col("name").alias("_taken")).distinct(), name == F.col("_taken"), "left")
        n = n + F.col("_taken").isNotNull().cast("int")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("target", F.when(n == 0, name).otherwise(F.concat(stem, F.lit("__filtered_"), n.cast("string"), ext))).drop("_taken")


def cross_tasks(sites: DataFrame, variants: list[str], only_sites: list[str] | None = None, only_variants: list[str] | None = None) -> DataFrame:
    """A row for each site and variant; variants are a short literal list, so this is a projection and no join."""
    chosen = [v for v in variants if not only_variants or v in only_variants]
    out = sites.where(F.col("site_id").isin(only_sites)) if only_sites else sites
    return out.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in chosen])))


def pick_task(tasks: DataFrame, index: int, *order: str) -> DataFrame:
    """The task at a zero-based place; none if it lies outside."""
    return tasks.orderBy(*order).offset(index).limit(1)


def task_indexed(tasks: DataFrame, *order: str) -> DataFrame:
    """Tasks (a few for each site) with their zero-based place."""
    return tasks.withColumn("task_index", F.row_number().over(Window.orderBy(*order)) - 1)


def best_per(df: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row of the highest score of each key (ties: the first by `tie`)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.where(F.col(score).isNotNull()).withColumn("_s", -F.col(score)).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_s", *tie)).alias("_row"))
    return best.select(*keys, "_row.*")


def top_k(df: DataFrame, keys: list[str], score: Column, k: int, tie: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc(), *tie))
    return df.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def running_best(log: DataFrame, keys: list[str], epoch: str, score: str) -> DataFrame:
    """Adds best_so_far and epochs_since_best: what early stopping looks at."""
    w = Window.partitionBy(*keys).orderBy(epoch)
    best = F.max(score).over(w)
    since = F.last(F.when(F.col(score) >= F.col("best_so_far"), F.col(epoch)), True).over(w)
    return log.withColumn("best_so_far", best).withColumn("epochs_since_best", F.col(epoch) - since)


def difference(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys).distinct(), keys, "left_anti")
