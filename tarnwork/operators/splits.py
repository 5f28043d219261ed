"""Train, validation and test splits by water year, by season, at random, or as labelled; reference rows at quantiles.

Everything is per site in one pass: yearly counts (a few rows for each site) decide, and are joined back. Sampling ranks rows
by an MD5 of seed, site, stratum and row key, so membership is stable under any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.calendar import hydro_season, water_month, water_year
from tarnwork.functions.quantiles import exact_quantiles
from tarnwork.functions.stats import holdout_size
from tarnwork.operators.guards import require_classes

SPLITS = ("train", "val", "test")


def water_year_summary(df: DataFrame, keys: list[str], time: str, least: int = 1) -> DataFrame:
    """Per key and water year: rows, months (1 is October) as text and number, completeness, first and last time."""
    months = F.array_sort(F.collect_set(water_month(F.col(time))))
    out = df.where(F.col(time).isNotNull()).groupBy(*keys, water_year(F.col(time)).alias("water_year"))
    out = out.agg(F.count("*").alias("n_images"), months.alias("_m"), F.min(time).alias("image_time_min"), F.max(time).alias("image_time_max"))
    full = (F.size("_m") == 12) & (F.col("n_images") >= least)
    return out.select(
        *keys, "water_year", "n_images", F.array_join(F.transform("_m", lambda m: m.cast("string")), "|").alias("months_present"),
        F.size("_m").alias("n_months_present"), full.alias("is_complete_water_year"), "image_time_min", "image_time_max",
    )


def _rank(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def first_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], size: Callable[[Column], Column], out: str, descending: bool = False) -> DataFrame:
    """Marks the first size(n) of the n rows of each key, in an order that `bucket` is a coarse part of.

    Rows are counted by key and bucket, which tells of each bucket how many of its rows are among the first; rows are then
    ranked inside their bucket only, so that a key is never sorted in one task.
    """
    df = df.withColumn("_slot", F.struct(bucket.alias("_bucket"), *keys))  # fields that are null are equal in a struct
    counts = df.groupBy("_slot").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*[F.col("_slot")[k] for k in keys])
    by = F.col("_slot._bucket")
    before = F.sum("_c").over(whole.orderBy(by.desc() if descending else by)) - F.col("_c")
    takes = counts.select(F.col("_slot").alias("_of"), (size(F.sum("_c").over(whole)) - before).alias("_takes"))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy(*order))
    return df.join(takes, F.col("_slot") == F.col("_of")).withColumn(out, place <= F.col("_takes")).drop("_slot", "_of", "_takes")


def stratified_holdout(df: DataFrame, strata: list[str], key: str, ratio: float, seed: int = 42, out: str = "is_val") -> DataFrame:
    """Marks round-half-even(n * ratio) rows of each stratum (at least 1 and at most n - 1 from two rows on), the first by hash."""
    rank = _rank(seed, *[F.col(c) for c in strata], F.col(key))
    return first_rows(df, strata, F.substring(rank, 1, 3), [rank, F.col(key)], lambda n: holdout_size(n, ratio), out)


def random_holdout(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """A split column: a share of rows goes to val by a hash of seed and key; a range of the hash, so that no sort is needed."""
    draw = F.conv(F.substring(_rank(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(draw < ratio, "val").otherwise("train"))


def _years(df: DataFrame, site: list[str], time: str) -> DataFrame:
    y = df.groupBy(*site, water_year(F.col(time)).alias("water_year"))
    return y.agg(F.count("*").alias("n"), F.countDistinct(water_month(F.col(time))).alias("months"))


def check_splits(df: DataFrame) -> DataFrame:
    return require_classes(df, "split", SPLITS)


def rough_year_split(
    df: DataFrame, site: list[str], time: str, key: str, test_year: int, ratio: float = 0.2, least: int = 1, least_months: int = 10, seed: int = 42
) -> DataFrame:
    """Adds water_year and split (train, val, test, unused) per site; sites whose test year, or all years before, are too small are left out.

    Years with enough rows count. If two or more before the test year have enough months, the last of them is val, the others
    train and the rest of the rows unused; else a share of each hydrologic season of all earlier rows is val.
    """
    df = df.where(F.col(time).isNotNull()).withColumn("water_year", water_year(F.col(time)))
    years = _years(df, site, time).where(F.col("n") >= least)
    before = (F.col("water_year") < test_year).cast("int")
    rough = (before == 1) & (F.col("months") >= least_months)
    plan = years.groupBy(*site).agg(
        F.max((F.col("water_year") == test_year).cast("int")).alias("_test"), F.sum(before).alias("_before"),
        F.sum(rough.cast("int")).alias("_rough"), F.max(F.when(rough, F.col("water_year"))).alias("_val"),
    ).where("_test = 1 and _before > 0")
    years = years.join(plan, site).where(F.col("water_year") <= test_year).select(*site, "water_year", "_rough", "_val", (F.col("months") >= least_months).alias("_full"))
    out = df.join(F.broadcast(years) if not site else years, [*site, "water_year"])
    season = F.when(F.col("water_year") < test_year, hydro_season(F.month(time))).otherwise("test")
    out = stratified_holdout(out.withColumn("_season", season), [*site, "_season"], key, ratio, seed, "_held")
    by_year = F.when(~F.col("_full"), "unused").when(F.col("water_year") == F.col("_val"), "val").otherwise("train")
    split = F.when(F.col("water_year") == test_year, "test").when(F.col("_rough") >= 2, by_year).when(F.col("_held"), "val").otherwise("train")
    return out.withColumn("split", split).drop("_rough", "_val", "_full", "_season", "_held")


def strict_year_split(df: DataFrame, site: list[str], time: str, key: str, test_year: int, ratio: float = 0.2, least: int = 1) -> DataFrame:
    """Adds water_year and split per site, over complete water years only: the last before the test year is val; a single one gives its last share by time."""
    df = df.where(F.col(time).isNotNull()).withColumn("water_year", water_year(F.col(time)))
    years = _years(df, site, time).where((F.col("n") >= least) & (F.col("months") == 12) & (F.col("water_year") <= test_year))
    early = F.when(F.col("water_year") < test_year, F.col("water_year"))
    plan = years.groupBy(*site).agg(F.max("water_year").alias("_last"), F.count(early).alias("_n"), F.max(early).alias("_val")).where(f"_last = {int(test_year)} and _n > 0")
    out = df.join(years.join(plan, site).select(*site, "water_year", "_n", "_val") if site else years.crossJoin(F.broadcast(plan)).select("water_year", "_n", "_val"), [*site, "water_year"])
    return tail_holdout(out, [*site, "water_year"], time, key, ratio, "_tail").withColumn(
        "split", F.when(F.col("water_year") == test_year, "test").when(F.col("_n") >= 2, F.when(F.col("water_year") == F.col("_val"), "val").otherwise("train")).when(F.col("_tail"), "val").otherwise("train")
    ).drop("_n", "_val", "_tail")


def tail_holdout(df: DataFrame, keys: list[str], time: str, key: str, ratio: float, out: str = "is_val") -> DataFrame:
    """Marks the last ceil(n * ratio) rows by time of each key, at least one."""
    order = [F.col(time).desc(), F.col(key).desc()]
    return first_rows(df, keys, F.to_date(time), order, lambda n: F.greatest(F.lit(1), F.ceil(n * float(ratio))), out, descending=True)


def explicit_split(df: DataFrame, column: str = "split", check: bool = True) -> DataFrame:
    """The labelled split, trimmed and lower-cased; every one of train, val and test has to have rows."""
    out = df.withColumn(column, F.lower(F.trim(F.col(column))))
    return require_classes(out, column, SPLITS) if check else out


def nearest_to_quantiles(df: DataFrame, groups: list[str], value: str, tie: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Of each group and named quantile, the row whose value is nearest to it (ties: the first by `tie`): variant, quantile, target, and the row's columns."""
    known = df.where(F.col(value).isNotNull())
    names = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(float(q)).alias("quantile"), F.lit(i).alias("i")) for i, (k, q) in enumerate(quantiles.items())])
    found = exact_quantiles(known, groups, {f"_q{i}": (F.col(value), float(q)) for i, q in enumerate(quantiles.values())})
    targets = found.select(*groups, F.array(*[f"_q{i}" for i in range(len(quantiles))]).alias("_q")).withColumn("_v", F.explode(names))
    targets = targets.select(*groups, "_v.variant", "_v.quantile", F.get("_q", F.col("_v.i")).alias("target"))
    joined = known.join(targets, groups) if groups else known.crossJoin(F.broadcast(targets))  # as many targets as quantiles
    order = F.struct(F.abs(F.col(value) - F.col("target")), *tie)
    best = joined.groupBy(*groups, "variant", "quantile", "target").agg(F.min_by(F.struct(*[c for c in df.columns if c not in groups]), order).alias("_row"))
    return best.select(*groups, "variant", "quantile", "target", "_row.*")


def choose_references(manifest: DataFrame, site: list[str], value: str = "discharge", tie: list[str] | None = None) -> DataFrame:
    """Reference rows of the training split at the 5th, 50th and 95th percentile."""
    train = manifest.where(F.lower(F.trim("split")) == "train").where(F.col(value).isNotNull())
    return nearest_to_quantiles(train, site, value, tie or ["image_time", "image_path"], {"p05": 0.05, "p50": 0.5, "p95": 0.95})
