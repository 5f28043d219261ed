"""Joins of irregular time series: nearest as-of, interpolation with gaps, and the long-to-wide pivot.

Both joins put targets and readings of a key in one ordering and look back and ahead with window frames: one shuffle on the
key and one sort, no range join. A key with very many rows (a station with decades of readings) is cut by time: rows are dealt
by (key, time slice), and each slice also gets the readings of the last time before it and of the first after it, so that hot
keys spread over tasks and results stay the same. The width of a slice follows from counts unless it is given.

Nothing depends on the order of rows in a table, which a shuffle does not keep: readings of one time are ordered by `order`, columns that
tell them apart, or else by their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITE = float("inf")
#: Readings of a key from which on it is cut by time, and about how many a slice then has.
LONG_KEY, SLICE_ROWS = 200_000, 50_000


def minutes_between(a: Column, b: Column) -> Column:
    """b - a in minutes with fractions."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(6e7)


def slice_width(readings: DataFrame, on: list[str], time: str) -> int:
    """Seconds of a slice that deals the longest key's readings in parts of about SLICE_ROWS; 0 if no key is long."""
    span = F.timestamp_diff("SECOND", F.min(time), F.max(time))
    keys = readings.where(F.col(time).isNotNull()).groupBy(*on).agg(F.count("*").alias("n"), span.alias("span"))
    longest = keys.agg(F.max_by(F.struct("n", "span"), "n").alias("k")).first()["k"]
    return 0 if longest is None or longest["n"] <= LONG_KEY else max(1, longest["span"] * SLICE_ROWS // longest["n"])


def _events(targets: DataFrame, readings: DataFrame, keys: list[str], t: str, rt: str, values: list[str], order: list[str] | None, slice_seconds: int | None) -> tuple[DataFrame, list[str]]:
    """Targets (side 1, all their columns in _row) and readings (side 0) in one table, with the columns that deal rows to windows."""
    slice_seconds = slice_width(readings, keys, rt) if slice_seconds is None else slice_seconds
    left = targets.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(*targets.columns).alias("_row"))
    reading, tie = F.struct(F.col(rt).alias("_t"), *values), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order or values)])
    right = readings.where(F.col(rt).isNotNull()).select(*keys, F.col(rt).alias("_t"), F.lit(0).alias("_side"), reading.alias("_reading"), tie.alias("_tie"))
    both = left.unionByName(right, allowMissingColumns=True)
    if not slice_seconds:
        return both, keys
    width = slice_seconds * 1_000_000
    part = F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("_t")) / width).cast("long")
    both = both.withColumn("_slice", part)
    own = both.where("_side = 0")
    # the readings at the edges of each slice also go to the slices with targets that they are the neighbours of
    full = F.expr(" and ".join(["true", *[f"_reading.{v} is not null" for v in values]]))
    known = F.when(full, F.col("_t"))
    edge = own.groupBy(*keys, "_slice").agg(F.max("_t").alias("hi"), F.min("_t").alias("lo"), F.max(known).alias("khi"), F.min(known).alias("klo"))
    sides = ("hi", "khi", "lo", "klo")
    wanted = both.where("_side = 1").select(*keys, "_slice").distinct()
    marks = wanted.select(*keys, "_slice", F.lit(1).alias("want")).unionByName(edge.select(*keys, "_slice", *sides), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_slice")  # one row for each slice, not for each reading
    near = marks.groupBy(*keys, "_slice").agg(F.max("want").alias("want"), *[F.max(c).alias(c) for c in sides])
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    near = near.select(*keys, "_slice", "want", *[(F.last(c, True).over(back) if "h" in c else F.first(c, True).over(ahead)).alias(c) for c in sides]).where("want = 1")
    lent = near.select(*keys, "_slice", F.explode(F.array_distinct(F.array(*sides))).alias("_t")).where("_t is not null")
    lent = lent.join(own.drop("_slice"), [*keys, "_t"])  # all readings of that time
    return both.unionByName(lent, allowMissingColumns=True), [*keys, "_slice"]


def asof_nearest(
    targets: DataFrame,
    readings: DataFrame,
    on: list[str],
    time: str,
    reading_time: str,
    values: list[str],
    tolerance_minutes: float = 30.0,
    slice_seconds: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Each target with the values of the nearest reading within an inclusive tolerance, else nulls; matched_time is its time.

    Equal distances go to the earlier reading. Of readings at one time, the last counts looking back and the first looking
    ahead, by `order` or else by their values. slice_seconds: None chooses by counts, 0 never cuts. Targets without a time stay unmatched.
    """
    both, deal = _events(targets, readings, on, time, reading_time, values, order, slice_seconds)
    back = Window.partitionBy(*deal).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*deal).orderBy(F.col("_t"), F.col("_side").desc(), F.col("_tie")).rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumns({"_p": F.last("_reading", True).over(back), "_n": F.first("_reading", True).over(ahead)}).where("_side = 1")
    gap_p, gap_n = minutes_between(F.col("_p._t"), F.col("_t")), minutes_between(F.col("_t"), F.col("_n._t"))
    out = out.withColumns({"_gp": F.when(gap_p <= tolerance_minutes, gap_p), "_gn": F.when(gap_n <= tolerance_minutes, gap_n)})
    best = F.when(F.col("_gp").isNotNull() & (F.col("_gn").isNull() | (F.col("_gp") <= F.col("_gn"))), F.col("_p")).when(F.col("_gn").isNotNull(), F.col("_n"))
    out = out.where(F.col("_row").isNotNull()).withColumn("_best", F.when(F.col("_t").isNotNull(), best))
    return out.select("_row.*", F.col("_best._t").alias("matched_time"), *[F.col(f"_best.{v}").alias(v if v not in targets.columns else f"{v}_matched") for v in values])


def interpolate_at(
    targets: DataFrame,
    readings: DataFrame,
    on: list[str],
    time: str,
    reading_time: str,
    value: str,
    max_gap_minutes: float = 90.0,
    sentinel: float | None = None,
    slice_seconds: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Each target with the value interpolated in time between its neighbours, and how far they are.

    Adds {value} (null outside the readings' range), gap_prev_min to the last reading strictly before, gap_next_min to the
    first at or after (infinite where there is none), nearest_time (the earlier of equals) and valid_interpolation: the nearer
    gap is within the limit. So a target just outside the range can be valid without a value. Of readings at one time the
    first by `order` counts, or else the one of least value (nulls last). A reading equal to `sentinel` is left out if one is given.
    """
    usable = readings.where(F.col(reading_time).isNotNull())
    if sentinel is not None:
        usable = usable.where(F.col(value).isNull() | (F.col(value) != sentinel))
    rank = F.struct(*order) if order else F.struct(F.col(value).isNull().alias("n"), F.col(value).alias("v"))
    first = usable.groupBy(*on, F.col(reading_time)).agg(F.min_by(F.struct(F.col(value).alias("v")), rank).alias("_v"))
    first = first.select(*on, reading_time, F.col("_v.v").cast("double").alias("_v"))
    both, deal = _events(targets, first, on, time, reading_time, ["_v"], None, slice_seconds)
    order = Window.partitionBy(*deal).orderBy(F.col("_t"), F.col("_side").desc(), F.col("_tie"))  # targets before readings of the same time
    known = F.when(F.col("_reading._v").isNotNull(), F.col("_reading"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumns(
        {
            "_p": F.last("_reading", True).over(before),
            "_n": F.first("_reading", True).over(after),
            "_vp": F.last(known, True).over(before),
            "_vn": F.first(known, True).over(after),
        }
    ).where("_side = 1")
    gap_p, gap_n = F.coalesce(minutes_between(F.col("_p._t"), F.col("_t")), F.lit(INFINITE)), F.coalesce(minutes_between(F.col("_t"), F.col("_n._t")), F.lit(INFINITE))
    out = out.withColumns({"gap_prev_min": gap_p, "gap_next_min": gap_n})
    vp, vn = minutes_between(F.col("_vp._t"), F.col("_t")), minutes_between(F.col("_t"), F.col("_vn._t"))
    inside = F.when(vn == 0, F.col("_vn._v")).when(vp.isNotNull() & vn.isNotNull(), F.col("_vp._v") + (F.col("_vn._v") - F.col("_vp._v")) * vp / (vp + vn))
    nearest = F.when(F.col("gap_prev_min") <= F.col("gap_next_min"), F.col("_p._t")).otherwise(F.col("_n._t"))
    valid = F.least("gap_prev_min", "gap_next_min") <= max_gap_minutes
    keep = [c for c in targets.columns if c != value]
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in keep], inside.alias(value), nearest.alias("nearest_time"), "gap_prev_min", "gap_next_min", valid.alias("valid_interpolation"))


def align_images(images: DataFrame, readings: DataFrame, on: list[str], max_gap_minutes: float = 90.0, image_time: str = "image_time", reading_time: str = "time", value: str = "discharge") -> DataFrame:
    """interpolate_at() in the form of the matched table: hydro_time repeats the image's time, nearest_obs_time is text, empty for none."""
    out = interpolate_at(images, readings, on, image_time, reading_time, value, max_gap_minutes)
    text = F.coalesce(F.date_format("nearest_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    return out.withColumns({"hydro_time": F.col(image_time), "nearest_obs_time": text}).drop("nearest_time")


def valid_matches(df: DataFrame, flag: str = "valid_interpolation") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)))


def pivot_last(df: DataFrame, keys: list[str], name: str, value: str, order: list[str], names: list) -> DataFrame:
    """One column for each of names with the last non-null value by `order`; rows without any value are left out."""
    known = df.where(F.col(value).isNotNull() & F.col(name).isin(names))
    return known.groupBy(*keys).pivot(name, names).agg(F.max_by(value, F.struct(*order)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, which has to tell rows apart."""
    rows = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(rows, F.struct(*order)).alias("_row")).select("_row.*")


def request_window(df: DataFrame, keys: list[str], time: str, buffer_days: int) -> DataFrame:
    """The range of times of each key, wider by a buffer on both sides."""
    days = F.expr(f"interval {int(buffer_days)} days")
    return df.groupBy(*keys).agg((F.min(time) - days).alias("start"), (F.max(time) + days).alias("end"))


def time_axis(*frames: tuple[DataFrame, str]) -> DataFrame:
    """The distinct times of several tables."""
    out = frames[0][0].select(F.col(frames[0][1]).alias("time"))
    for df, c in frames[1:]:
        out = out.unionByName(df.select(F.col(c).alias("time")))
    return out.distinct()
