"""Remote payloads: a Python data source of JSON pages in windows, their parsing, and downloads with a table of failures.

Base addresses are options, so nothing here knows a service. An address without http reads files, which is how tests run.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwork.functions.calendar import camera_time, local_image_name, month_floor, month_windows
from tarnwork.functions.text import basename, item_name, items_of, plain_path, qualifiers
from tarnwork.operators.timeseries import keep_first

RETRIES, TIMEOUT, IMAGE_TIMEOUT, CHUNK = 3, 120, 180, 32768


def get(url: str, params: dict | None = None, retries: int = RETRIES, timeout: float = TIMEOUT, wait: float = 1.5) -> bytes:
    """The bytes at an address; waits ever longer between tries."""
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    for attempt in range(retries + 1):
        try:
            if not full.startswith(("http://", "https://")):
                name = url.removeprefix("file://")
                if params and "{" in name:
                    name = name.format(**params)
                with open(name, "rb") as f:
                    return f.read()
            with urllib.request.urlopen(full, timeout=timeout) as answer:  # noqa: S310
                return answer.read()
        except Exception:
            if attempt == retries:
                raise
            time.sleep(wait * (attempt + 1))
    raise AssertionError


class Window(InputPartition):
    def __init__(self, params: dict):
        super().__init__(json.dumps(params, sort_keys=True))
        self.params = params


class JsonPages(DataSource):
    """Format `json_pages`: a row (key, params, payload) for each request. Options: url, key, windows (JSON list of parameter objects), limit.

    With a limit, the first request goes without a window; if it holds fewer items than the limit (and any), it is complete
    and the windows are not asked. A failure of that request is raised only if the windows also fail.
    """

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return "key string, params string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return JsonPagesReader(self.options)


def item_count(payload: str) -> int:
    p = json.loads(payload)
    if isinstance(p, dict):
        p = next((p[k] for k in ("items", "files", "value") if p.get(k)), [])
    return len(p)


class JsonPagesReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.key = options["url"], options.get("key", "")
        self.windows, self.limit = json.loads(options.get("windows", "[]")), int(options.get("limit", "0"))
        self.pause = float(options.get("pause", "0.05"))
        if self.limit and not self.windows:
            raise ValueError("a limit may cut the answer short, so it needs windows to ask instead")

    def partitions(self) -> list[Window]:
        if not self.windows:
            return [Window({})]
        if self.limit:
            try:
                n = item_count(get(self.url, {"limit": self.limit}).decode())
                if 0 < n < self.limit:
                    return [Window({"limit": self.limit})]
            except Exception as failed:  # noqa: BLE001
                try:
                    get(self.url, self.windows[0])
                except Exception:
                    raise failed from None
        return [Window(w) for w in self.windows]

    def read(self, partition: Window) -> Iterator[tuple]:
        time.sleep(self.pause)
        yield self.key, json.dumps(partition.params, sort_keys=True), get(self.url, partition.params).decode()


def pages(spark: SparkSession, url: str, key: str = "", windows: list[dict] | None = None, limit: int = 0, pause: float = 0.05) -> DataFrame:
    spark.dataSource.register(JsonPages)
    options = {"url": url, "key": key, "windows": json.dumps(windows or []), "limit": str(limit), "pause": str(pause)}
    return spark.read.format("json_pages").options(**options).load()


def _asked(rows: DataFrame, ask, schema: str, parallel: int) -> DataFrame:
    """A row of `schema` for each row: what `ask` gives for it, on executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for frame in frames:
            for row in frame.to_dict("records"):  # one answer at a time, as each may be large
                yield pd.DataFrame([ask(row)], columns=names)

    return rows.repartition(parallel).mapInPandas(run, schema)


def listing(cameras: DataFrame, camera_url: str, files_url: str, limit: int = 50_000, parallel: int = 64, pause: float = 0.05) -> DataFrame:
    """(key, payload) of the file lists of all cameras (cam_id), requested on executors.

    A camera whose whole list has fewer items than the limit (and any) is complete. Any other is asked month by month, from its
    creation to its newest image; months are dealt out whatever their camera. A failure of the whole list is told only if a month fails too.
    """
    common = {"rawItem": "true", "limit": str(limit), "recent": "false"}

    def whole(row: dict) -> tuple:
        camera, payload, error = get(camera_url, {"camId": row["cam_id"]}).decode(), None, None
        try:
            got = get(files_url, {"camId": row["cam_id"]} | common).decode()
            payload = got if 0 < item_count(got) < limit else None
        except Exception as failed:  # the months may still answer  # noqa: BLE001
            error = repr(failed)
        return row["cam_id"], camera, payload, error

    def month(row: dict) -> tuple:
        if row["whole"] is not None:
            return row["key"], row["whole"]
        time.sleep(pause)
        try:
            return row["key"], get(files_url, {"camId": row["key"]} | common | {"after": row["after"], "before": row["before"]}).decode()
        except Exception as failed:
            if row["error"] is not None:
                raise RuntimeError(f"list of {row['key']} failed: {row['error']}") from failed
            raise

    first = _asked(cameras.select("cam_id").distinct(), whole, "key string, payload string, whole string, error string", parallel)
    item = F.get(items_of(F.col("payload")), F.lit(0))
    newest = F.coalesce(F.try_to_timestamp(F.try_variant_get(item, "$.newestImageDT", "string")), F.current_timestamp())
    months = month_windows(month_floor(F.try_variant_get(item, "$.createdDate", "string")), newest.cast("timestamp_ntz"))
    one = F.array(F.struct(F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end")))
    spans = first.select("key", "whole", "error", F.explode(F.when(F.col("whole").isNotNull(), one).otherwise(months)).alias("w"))
    stamp = "yyyy-MM-dd'T'HH-mm-ss'Z'"
    return _asked(spans.select("key", "whole", "error", F.date_format("w.start", stamp).alias("after"), F.date_format("w.end", stamp).alias("before")), month, "key string, payload string", parallel)


def gauge_payloads(windows: DataFrame, url: str, gauge: str = "nwis_id", parallel: int = 64) -> DataFrame:
    """(key, payload): the discharge series of each gauge in its window (start, end), requested on executors."""
    common = {"parameterCd": "00060", "format": "json", "siteStatus": "all"}

    def ask(row: dict) -> tuple:
        return row["key"], get(url, {"sites": row["key"], "startDT": row["start"], "endDT": row["end"]} | common).decode()

    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    rows = windows.select(F.col(gauge).alias("key"), F.date_format("start", iso).alias("start"), F.date_format("end", iso).alias("end"))
    return _asked(rows, ask, "key string, payload string", parallel)


def camera_metadata(payloads: DataFrame) -> DataFrame:
    """key, created, newest of camera payloads: the first object of a list, or under items, files or value."""
    first = F.get(items_of(F.col("payload")), F.lit(0))
    return payloads.select("key", F.try_to_timestamp(F.try_variant_get(first, "$.createdDate", "string")).alias("created"), F.try_to_timestamp(F.try_variant_get(first, "$.newestImageDT", "string")).alias("newest"))


def listed_images(payloads: DataFrame, base_url: str) -> DataFrame:
    """cam_id, timestamp_utc, source_filename, url of JPEG items whose name has a time; each name once, in order of time at the sink."""
    item = payloads.select(F.col("key").alias("cam_id"), F.explode(items_of(F.col("payload"))).alias("item"))
    named = item.select("cam_id", basename(item_name(F.col("item"))).alias("source_filename")).where(F.col("source_filename").rlike(r"(?i)\.jpe?g$"))
    named = named.withColumn("timestamp_utc", camera_time(F.col("source_filename"))).where(F.col("timestamp_utc").isNotNull())
    out = named.withColumn("url", F.concat_ws("/", F.lit(base_url.rstrip("/")), "cam_id", "source_filename"))
    return keep_first(out, ["cam_id", "source_filename"], ["timestamp_utc", "url"]).select("cam_id", "timestamp_utc", "source_filename", "url")


GAUGE = (
    "value struct<timeSeries:array<struct<variable:struct<variableCode:array<struct<value:string>>,variableName:string,unit:struct<unitCode:string>>,"
    "sourceInfo:struct<siteCode:array<struct<value:string>>>,values:array<struct<qualifier:string,method:array<struct<methodDescription:string>>,"
    "value:array<struct<dateTime:string,value:string>>>>>>>"
)


def gauge_readings(payloads: DataFrame, source: str = "", gauge: str | None = None) -> DataFrame:
    """(the asked key under the name `gauge`, if one is given,) datetime_utc, site_no, variable_cd, variable_name, unit, value, qualifiers, method, source of nested gauge payloads; readings without a time are left out."""
    parsed = payloads.select("key", F.from_json("payload", GAUGE).alias("p"))
    series = parsed.select("key", F.explode("p.value.timeSeries").alias("s"))
    block = series.select("key", "s", F.explode("s.values").alias("b"))
    r = block.select("key", "s", "b", F.explode("b.value").alias("v"))
    code = F.get(F.col("s.variable.variableCode"), F.lit(0))["value"]
    site = F.coalesce(F.get(F.col("s.sourceInfo.siteCode"), F.lit(0))["value"], F.col("key"))
    out = r.select(
        *([F.col("key").alias(gauge)] if gauge else []),
        F.try_to_timestamp("v.dateTime").cast("timestamp_ntz").alias("datetime_utc"), site.alias("site_no"), code.alias("variable_cd"), F.col("s.variable.variableName").alias("variable_name"),
        F.col("s.variable.unit.unitCode").alias("unit"), F.col("v.value").try_cast("double").alias("value"), qualifiers(F.col("b.qualifier")).alias("qualifiers"),
        F.coalesce(F.get(F.col("b.method"), F.lit(0))["methodDescription"], F.lit("")).alias("method"), F.lit(source).alias("source"),
    )
    return out.dropna(subset=["datetime_utc"])


def download(listing: DataFrame, existing: DataFrame | None, folder: str, parallel: int = 64) -> tuple[DataFrame, DataFrame]:
    """(manifest, failures) of fetching each listed image into a shared folder once. existing (path, length) lists what is there; empty files are fetched again.

    What was done is written below folder/_downloads and read from there, so that a lost executor does not fetch again what a reader has seen.
    """
    rows = listing.withColumn("filename", local_image_name(F.col("timestamp_utc"))).withColumn("image_path", F.concat_ws("/", F.lit(folder), "cam_id", "filename"))
    if existing is not None:
        there = existing.where("length > 0").select(plain_path(F.col("path")).alias("image_path")).distinct().withColumn("_there", F.lit(True))
        rows = rows.join(there, "image_path", "left")
    else:
        rows = rows.withColumn("_there", F.lit(None).cast("boolean"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for frame in frames:
            got, errors = [], []
            for r in frame.itertuples(index=False):
                error = None
                if not r.there:
                    try:
                        os.makedirs(os.path.dirname(r.image_path), exist_ok=True)
                        own = f"{r.image_path}.{uuid.uuid4().hex}"
                        with open(own, "wb") as f:
                            f.write(get(r.url, timeout=IMAGE_TIMEOUT))
                        os.replace(own, r.image_path)
                    except Exception as e:  # goes to the table of failures  # noqa: BLE001
                        error = repr(e)
                got.append(error is None and not r.there)
                errors.append(error)
            yield frame.drop(columns=["there"]).assign(downloaded_now=got, error=errors)

    columns = "cam_id string, source_filename string, url string, filename string, image_path string, image_time timestamp_ntz"
    tasks = rows.select("cam_id", "source_filename", "url", "filename", "image_path", F.col("timestamp_utc").alias("image_time"), F.coalesce("_there", F.lit(False)).alias("there"))
    path = f"{folder}/_downloads/run={time.time_ns()}"
    tasks.repartition(parallel).mapInPandas(run, f"{columns}, downloaded_now boolean, error string").write.parquet(path)
    done = listing.sparkSession.read.parquet(path)
    return done.where("error is null").drop("error"), done.where("error is not null").drop("downloaded_now")
