"""Aggregates and expressions: exact quantiles, adaptive floors, regression metrics, ensemble weights, scalers, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.quantiles import exact_quantiles


def quantile(x: Column, q: float) -> Column:
    """Linear between order statistics; nulls and NaN do not count. An aggregate that holds its group; large groups go through exact_quantiles()."""
    return F.percentile(F.when(~F.isnan(x), x), q)


def adaptive_floor(x: Column, floor: float, q: float, factor: float = 1.0) -> Column:
    """The larger of a floor and a multiple of a quantile; the floor if there are no values."""
    return floor_of(quantile(x, q), floor, factor)


def floor_of(value: Column, floor: float, factor: float = 1.0) -> Column:
    return F.greatest(F.lit(float(floor)), value * float(factor))


def adaptive_band(x: Column, least: float, most: float, q: float) -> Column:
    """The quantile held between least and most; most if there are no values."""
    return band_of(quantile(x, q), least, most)


def band_of(value: Column, least: float, most: float) -> Column:
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), value))


def keep_ratio(kept: Column, n: Column) -> Column:
    return kept / F.greatest(F.lit(1), n)


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def holdout_size(n: Column, ratio: float) -> Column:
    """round-half-even(n * ratio), at least 1 and at most n - 1; none of one row or fewer."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(n - 1, F.greatest(F.lit(1), half_even(n * float(ratio)))))


def clamp_prediction(x: Column, most: float = 20000.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def regression_metrics(truth: Column, predicted: Column) -> list[Column]:
    """MAE, RMSE, R2, Bias over rows where both are known. R2 of constant truth is null."""
    both = truth.isNotNull() & predicted.isNotNull()
    t, e = F.when(both, truth), F.when(both, predicted - truth)
    return [F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), (1 - F.sum(e * e) / F.nullif(F.count(t) * F.var_pop(t), F.lit(0.0))).alias("R2"), F.avg(e).alias("Bias")]


def with_ensemble_weights(models: DataFrame, r2: str, mode: str = "weighted", power: float = 1.0, topk: int = 5, keys: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Adds weight, which sums to 1 over the models of a key. Modes: uniform, weighted, topk (ties: the later in `order`), softmax."""
    whole = Window.partitionBy(*keys)
    base = F.greatest(F.col(r2), F.lit(0.0)) + 1e-6
    if mode == "uniform":
        w = F.lit(1.0)
    elif mode == "softmax":
        w = F.exp(float(power) * (base - F.max(base).over(whole)))
    elif mode == "topk":
        place = F.row_number().over(whole.orderBy(F.col(r2).desc(), F.col(order or r2).desc()))
        w = F.when(place <= F.greatest(F.lit(1), F.least(F.lit(topk), F.count("*").over(whole))), F.pow(base, float(power))).otherwise(0.0)
    elif mode == "weighted":
        w = F.pow(base, float(power))
    else:
        raise ValueError(f"no ensemble mode {mode}")
    return models.withColumn("_w", w).withColumn("weight", F.col("_w") / F.sum("_w").over(whole)).drop("_w")


def ensemble(predictions: DataFrame, weights: DataFrame, on: tuple[str, ...], rows: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The weighted sum of the models' values for each row."""
    joined = predictions.join(weights, list(on))
    return joined.groupBy(*rows).agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])


def score_summary(score: Column, weight: Column) -> list[Column]:
    return [(F.sum(weight * score) / F.sum(weight)).alias("weighted_mean"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.max(score).alias("best")]


def mixture(low: Column, high: Column, gate: Column, truth: Column, threshold: Column) -> dict[str, Column]:
    """Soft and hard mixtures of two experts, and what oracles of segment and expert would give."""
    segment = (truth > threshold).cast("int")
    return {
        "pred_soft": (1 - gate) * low + gate * high,
        "pred_hard": F.when(gate >= 0.5, high).otherwise(low),
        "seg_pred": (gate >= 0.5).cast("int"),
        "seg_true": segment,
        "pred_seg_oracle": F.when(segment == 1, high).otherwise(low),
        "pred_expert_oracle": F.when(F.abs(low - truth) < F.abs(high - truth), low).otherwise(high),
    }


def dimensions(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """(keep..., dim, x) for each component."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def robust_scaler(train: DataFrame, vector: str) -> DataFrame:
    """(dim, center, scale): median and interquartile range, 1 where that is 0."""
    found = exact_quantiles(dimensions(train, vector), ["dim"], {"q1": (F.col("x"), 0.25), "center": (F.col("x"), 0.5), "q3": (F.col("x"), 0.75)}, few=True)
    iqr = F.col("q3") - F.col("q1")
    return found.select("dim", "center", F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale"))


def standard_scaler(train: DataFrame, vector: str) -> DataFrame:
    """(dim, center, scale): mean and population standard deviation, 1 where that is 0."""
    sd = F.stddev_pop("x")
    return dimensions(train, vector).groupBy("dim").agg(F.avg("x").alias("center"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def scaled(df: DataFrame, vector: str, key: str, scaler: DataFrame, out: str = "scaled") -> DataFrame:
    """(key, out): components less center, over scale. A scaler has one row for each dimension, so it becomes two small arrays."""
    both = scaler.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "center", "scale"))), lambda s: F.struct(s["center"], s["scale"])).alias("_s"))
    z = F.transform(F.col(vector), lambda x, i: (x.cast("double") - F.col("_s")[i]["center"]) / F.col("_s")[i]["scale"])
    return df.crossJoin(F.broadcast(both)).select(key, z.alias(out))  # one row on the right


def entropy_bits(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy of the counts of a value for each key, with p = n / (total + 1e-8)."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    n = n.withColumn("p", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) + 1e-8))
    return n.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def text_entropy_bits(text: Column) -> Column:
    """Shannon entropy of a text's characters, with p = n / (total + 1e-8), on the row: nothing is exploded or shuffled. Null for null and empty texts."""
    total = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))
    share = F.transform(chars, lambda c: (total - F.length(F.replace(text, c, F.lit("")))) / (total + 1e-8))
    return F.when(total > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def histogram_peak(df: DataFrame, keys: list[str], value: Column, bins: int = 50) -> DataFrame:
    """The middle of the fullest of equal bins over [0, 1] for each key, the first of equals."""
    n = df.withColumn("_bin", F.least(F.floor(value * bins), F.lit(bins - 1))).groupBy(*keys, "_bin").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(((F.max_by("_bin", F.struct(F.col("n"), -F.col("_bin"))) + 0.5) / bins).alias("peak"))
