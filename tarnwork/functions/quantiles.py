"""Exact quantiles of groups of any size: a sketch brackets each, only the values inside the bracket are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch, and how many of its errors the bracket reaches to either side.
ACCURACY, REACH = 10_000, 3


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], few: bool = False) -> DataFrame:
    """(keys..., one double for each name of `wanted`: its values and the quantile), linear between order statistics.

    Nulls and NaN do not count; a group without values gets null, and null keys are a group. No buffer holds a group's
    values: a first pass sketches, a second counts what lies below the bracket and each distinct value in it, some 6 in 10,000
    of the rows. A bracket that misses its quantile raises. Groups of fewer than
    ACCURACY values are counted whole. few: the groups are few by their meaning, and are broadcast.
    """
    slot, i = F.struct(F.lit(0), *[F.col(k) for k in keys]), range(len(wanted))
    values = [(F.when(~F.isnan(x.cast("double")), x.cast("double")).alias(f"_x{j}")) for j, (x, _) in enumerate(wanted.values())]
    rows = df.select(slot.alias("_slot"), *values)
    step = REACH / ACCURACY
    ends = [F.array(F.lit(max(0.0, q - step)), F.lit(min(1.0, q + step))) for _, q in wanted.values()]

    def bracket(j: int) -> Column:
        x, n = F.col(f"_x{j}"), F.count(f"_x{j}")
        near = F.percentile_approx(x, ends[j], ACCURACY)  # in small groups the bracket is no rank wide, so those are counted whole
        return F.struct(F.when(n < ACCURACY, F.array(F.min(x), F.max(x))).otherwise(near).alias("ends"), n.alias("n"))

    sketch = rows.groupBy("_slot").agg(*[bracket(j).alias(f"_b{j}") for j in i])
    sketch = sketch.withColumnRenamed("_slot", "_own")

    def place(j: int) -> Column:
        x, (low, high) = F.col(f"_x{j}"), (F.col(f"_b{j}")["ends"][e] for e in (0, 1))
        zone = F.when(x.isNull() | (x > high), 2).when(x < low, 0).otherwise(1)
        return F.struct(F.lit(j).alias("i"), zone.alias("zone"), F.when(zone == 1, x).alias("x"), F.col(f"_b{j}")["n"].alias("n"))

    held = rows.join(F.broadcast(sketch) if few or not keys else sketch, rows["_slot"] == sketch["_own"])
    counts = held.select("_slot", F.explode(F.array(*[place(j) for j in i])).alias("_p")).groupBy("_slot", "_p").agg(F.count("*").alias("_c"))
    ahead = F.sum("_c").over(Window.partitionBy("_slot", "_p.i").orderBy("_p.zone", "_p.x"))
    counts = counts.withColumn("_ahead", ahead)
    qs = F.array(*[F.lit(float(q)) for _, q in wanted.values()])
    at = qs[F.col("_p.i")] * (F.col("_p.n") - 1)

    def order_statistic(rank: Column) -> Column:
        return F.min(F.when((F.col("_ahead") > rank) & (F.col("_p.zone") < 2), F.struct("_p.zone", "_p.x")))

    found = counts.groupBy("_slot", F.col("_p.i").alias("_i"), F.col("_p.n").alias("_n")).agg(order_statistic(F.floor(at)).alias("_low"), order_statistic(F.ceil(at)).alias("_high"))
    rank = qs[F.col("_i")] * (F.col("_n") - 1)
    share = rank - F.floor(rank)
    hit = F.when((F.col("_low.zone") == 1) & (F.col("_high.zone") == 1), F.col("_low.x") * (1 - share) + F.col("_high.x") * share)
    same = F.col("_low.x") == F.col("_high.x")
    value = F.when(F.col("_n") > 0, F.when(same, F.col("_low.x")).otherwise(F.coalesce(hit, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))))
    out = found.withColumn("_v", value).groupBy("_slot").agg(*[F.max(F.when(F.col("_i") == j, F.col("_v"))).alias(name) for j, name in enumerate(wanted)])
    return out.select(*[F.col("_slot")[k].alias(k) for k in keys], *wanted)
