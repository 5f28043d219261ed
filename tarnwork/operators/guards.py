"""Checks and column choices that other operators rely on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: What an earlier quality run may have left in a table.
QUALITY_NAMES = frozenset(
    "read_ok width height gray_mean gray_std entropy lap_var grayscale_score colorfulness brightness_peak_v bright_low_sat_ratio "
    "glare_very_bright_low_sat_ratio glare_saturated_ratio snow_white_low_sat_ratio snow_bright_loose_ratio snow_cool_bright_ratio "
    "snow_blue_dominant_ratio gray_ice_low_sat_ratio raindrop_blob_count raindrop_blob_area_ratio raindrop_circularity_mean soft_flag_count".split()
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if twice := df.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError(f"not unique by {', '.join(keys)}: {twice[0].asDict()}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join whose keys are unique on both sides."""
    return assert_unique(left, on).join(assert_unique(right, on), on, how)


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def require_classes(df: DataFrame, column: str, classes: Iterable[str]) -> DataFrame:
    """Every class has a row."""
    have = {r[0] for r in df.where(F.col(column).isin(list(classes))).select(column).distinct().collect()}
    if missing := sorted(set(classes) - have):
        raise ValueError(f"no rows with {column} {', '.join(missing)}")
    return df


def single_value(df: DataFrame, group: str, column: str) -> DataFrame:
    """Every group has exactly one distinct value."""
    odd = df.groupBy(group).agg(F.countDistinct(column).alias("n")).where("n != 1").limit(5).collect()
    if odd:
        raise ValueError(f"not one {column} for {group} {', '.join(str(r[0]) for r in odd)}")
    return df


def first_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def without_quality(df: DataFrame) -> DataFrame:
    """Without the columns of an earlier quality run."""
    return df.drop(*[c for c in df.columns if c in QUALITY_NAMES or c.startswith(("quality_", "flag_")) or c.endswith("_threshold")])


def feature_columns(df: DataFrame, prefix: str = "emb_") -> list[str]:
    return [f.name for f in df.schema if f.name.startswith(prefix) and isinstance(f.dataType, NumericType)]


def as_vector(df: DataFrame, prefix: str = "emb_", out: str = "embedding") -> DataFrame:
    """Feature columns as one array<float> column."""
    own = feature_columns(df, prefix)
    return df.withColumn(out, F.array(*[F.col(c).cast("float") for c in own])).drop(*own)


def as_columns(df: DataFrame, vector: str, n: int, prefix: str = "emb_") -> DataFrame:
    return df.select(*[c for c in df.columns if c != vector], *[F.get(vector, F.lit(i)).alias(f"{prefix}{i:03d}") for i in range(n)])


def ordered(df: DataFrame, optional: Iterable[str], always: Iterable[str]) -> DataFrame:
    """The optional columns that are there, then the others."""
    return df.select(*[c for c in optional if c in df.columns], *always)
