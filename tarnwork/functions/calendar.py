"""Column functions on times: water years, seasons, local clocks, ISO text. Timestamps are UTC (NTZ or with session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
STAMP = "yyyy-MM-dd'T'HH-mm-ss"
STAMP_PATTERN = r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})"
#: The zones and daylight windows of known sites; sites that are not listed have none of their own.
SITE_ZONES = {
    "01312000": ("America/New_York", 8.0, 18.0),
    "05124000": ("America/Chicago", 8.0, 18.5),
    "02094659": ("America/New_York", 8.0, 18.5),
    "05427880": ("America/Chicago", 8.0, 19.0),
    "06309000": ("America/Denver", 8.0, 19.0),
    "14243000": ("America/Los_Angeles", 8.0, 19.0),
    "06799350": ("America/Chicago", 8.0, 18.0),
}


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def ntz(text: Column, fmt: str) -> Column:
    """try_to_timestamp without a zone."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def camera_time(filename: Column) -> Column:
    """The time after the first `___` of a camera's file name, null where there is none."""
    tail = F.regexp_extract(filename, r"___(.*)$", 1)
    return ntz(F.nullif(F.regexp_replace(F.regexp_replace(tail, r"\.[^.]*$", ""), "Z$", ""), F.lit("")), STAMP)


def stamped_time(name: Column) -> Column:
    """The first time stamp in a name, null where there is none."""
    return ntz(F.nullif(F.regexp_extract(name, STAMP_PATTERN, 1), F.lit("")), STAMP)


def local_image_name(ts: Column) -> Column:
    return F.concat(F.date_format(ts, STAMP), F.lit(".jpg"))


def month_floor(text: Column) -> Column:
    """The first of the month of an ISO time; 2022-01-01 where it can't be read."""
    return F.date_trunc("month", F.coalesce(F.try_to_timestamp(text), F.lit("2022-01-01").cast("timestamp"))).cast("timestamp_ntz")


def month_windows(start: Column, newest: Column) -> Column:
    """Array of (start, end) of months from start's on, while a month begins by newest + 31 days."""
    months = F.sequence(F.date_trunc("month", start), newest + F.expr("interval 31 days"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(m.alias("start"), (m + F.expr("interval 1 month")).alias("end")))


def water_year(ts: Column) -> Column:
    return F.year(ts) + (F.month(ts) >= 10).cast("int")


def water_month(ts: Column) -> Column:
    """1 for October to 12 for September."""
    return F.pmod(F.month(ts) + 2, F.lit(12)) + 1


def hydro_season(month: Column) -> Column:
    return F.when(month.isin(10, 11, 12), "fall").when(month.isin(1, 2, 3), "winter").when(month.isin(4, 5, 6), "spring").when(month.isin(7, 8, 9), "summer").otherwise("unknown")


def met_season(month: Column) -> Column:
    """1 for December to February, to 4."""
    return (F.floor(F.pmod(month, F.lit(12)) / 3) + 1).cast("int")


def local_hour(ts: Column, zone: Column) -> Column:
    """Hours with fractions on the local clock; null without a zone."""
    t = F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))
    return F.hour(t) + F.minute(t) / 60 + F.floor(F.second(t)) / 3600


def local_month(ts: Column, zone: Column) -> Column:
    return F.month(F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz")))


def with_local_clock(df: DataFrame, zones: DataFrame, site: str, ts: str, day_start: float = 8.0, day_end: float = 18.0, own_windows: bool = True) -> DataFrame:
    """Adds quality_local_hour, quality_local_month, quality_day_start_hour and quality_day_end_hour. zones (site, zone, day_start, day_end) is a table of sites."""
    own = zones.select(F.col("site").alias("_site"), F.col("zone").alias("_zone"), F.col("day_start").alias("_from"), F.col("day_end").alias("_to"))
    out = df.join(own, df[site] == own["_site"], "left")
    start, end = (F.coalesce("_from", F.lit(day_start)), F.coalesce("_to", F.lit(day_end))) if own_windows else (F.lit(day_start), F.lit(day_end))
    made = {
        "quality_local_hour": local_hour(F.col(ts), F.col("_zone")),
        "quality_local_month": local_month(F.col(ts), F.col("_zone")),
        "quality_day_start_hour": start,
        "quality_day_end_hour": end,
    }
    return out.withColumns(made).drop("_site", "_zone", "_from", "_to")


def month_season_one_hot(month: Column, fields: tuple[str, ...] = ("month", "season")) -> Column:
    """12 flags of the month and 4 of its season; a missing month counts as January, in season 4."""
    m, s = F.greatest(F.coalesce(month, F.lit(1)), F.lit(1)), F.coalesce(met_season(month), F.lit(4))
    flags = {"month": F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i == m).cast("float")), "season": F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (i == s).cast("float"))}
    return F.concat(*[flags[f] for f in fields]) if fields else F.array().cast("array<float>")


def parse_months(text: str) -> list[int]:
    """Months of a list such as "11,12,1"."""
    months = [int(x) for x in text.replace(";", ",").split(",") if x.strip()]
    if bad := [m for m in months if not 1 <= m <= 12]:
        raise ValueError(f"not months: {bad}")
    return months
