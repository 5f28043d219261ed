import json
import struct
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import pixels, quality, vision
from tarnwork.plans import pipeline
from tarnwork.sources import readers, rest, sinks


def png(path, rgb):
    h, w = rgb.shape[:2]

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    discs = np.zeros((120, 160, 3), np.uint8)
    y, x = np.mgrid[:120, :160]
    for k in range(6):
        discs[(y - 30 - 50 * (k // 3)) ** 2 + (x - 30 - 50 * (k % 3)) ** 2 <= 64] = 255
    png(root / "2024-01-01T08-00-00.png", discs)
    png(root / "2024-01-02T08-00-00.png", np.full((20, 30, 3), (10, 20, 30), np.uint8))
    png(root / "2024-01-03T08-00-00.png", np.kron(np.indices((10, 10)).sum(axis=0) % 2, np.ones((1, 1)))[..., None].repeat(3, 2).astype(np.uint8) * 255)
    (root / "2024-01-04T08-00-00.png").write_bytes(b"broken")
    (root / "notes.txt").write_text("x")
    return root


def test_metrics(spark, folder):
    out = {r.image_path[-23:-13]: r for r in pixels.image_metrics(readers.images(spark, str(folder))).collect()}
    assert out["2024-01-01"].raindrop_blob_count == 6 and out["2024-01-01"].raindrop_circularity_mean > 0.7
    solid = out["2024-01-02"]
    assert solid.gray_mean == 18 and solid.gray_std == 0 and solid.lap_var == 0 and abs(solid.entropy) < 1e-6
    assert solid.grayscale_score == pytest.approx(40 / 3 / 255, rel=1e-5) and solid.colorfulness == pytest.approx(0.3 * np.hypot(10, 15), rel=1e-5)
    board = out["2024-01-03"]
    assert board.entropy == pytest.approx(1) and board.gray_mean == 127.5 and board.lap_var == pytest.approx(1020.0**2)
    assert not out["2024-01-04"].read_ok and out["2024-01-04"].gray_mean is None


def test_unreadable_rows_are_dropped_with_all_reasons(spark, folder):
    m = pixels.image_metrics(readers.images(spark, str(folder / "2024-01-04T08-00-00.png")))
    clock = {"quality_local_hour": F.lit(12.0), "quality_local_month": F.lit(6), "quality_day_start_hour": F.lit(8.0), "quality_day_end_hour": F.lit(18.0)}
    row = quality.classify(m.withColumns(clock).withColumn("site", F.lit("s")), ["site"]).first()
    assert not row.quality_keep and row.quality_reasons.startswith("unreadable|night_or_near_grayscale|night_dark_scene|severe_dark|severe_blurry|dark_candidate|blurry_candidate")


def test_limits():
    assert quality.limits(snow_months="1").snow_months == "1"
    with pytest.raises(ValueError):
        quality.limits(nonsense=1)


def test_discovery(spark, folder):
    assert readers.timed_images(spark, str(folder)).count() == 4
    with pytest.raises(ValueError):
        readers.require_rows(readers.timed_images(spark, str(folder), check=False).where("year = 1999"))


def test_roi(spark, tmp_path, folder):
    (tmp_path / "a.json").write_text('{"imageWidth": 320, "imageHeight": 240, "shapes": [{"label": "x", "points": [[0, 0], [1, 1], [2, 0]]}, {"label": "roi", "points": [[20, 20], [300, 30], [280, 200]]}]}')
    region = readers.roi(spark, str(tmp_path / "a.json"))
    assert len(region.first().region.polygon) == 3 and region.first().region.polygon[0].x == 20
    (tmp_path / "b.json").write_text('{"imageWidth": 1, "imageHeight": 1, "shapes": []}')
    with pytest.raises(ValueError):
        readers.roi(spark, str(tmp_path / "b.json"))
    images = readers.images(spark, str(folder)).crossJoin(region.select("region"))
    out = vision.embed(images, lambda: vision.GridEmbedder(32), "region").collect()
    assert sum(r.embedding is None for r in out) == 1 and {len(r.embedding) for r in out if r.embedding is not None} == {32}


def test_kernels():
    square = np.zeros((12, 12), bool)
    square[2:10, 3:9] = True
    path = pixels.outline(square)
    assert pixels.polygon_area(path) == 35 and pixels.polygon_length(path) == 24
    two = np.zeros((5, 5), bool)
    two[0, 0] = two[1, 1] = two[4, 4] = True
    assert pixels.components(two)[1] == 2 and pixels.components(two, diagonal=False)[1] == 3
    rgb = np.random.default_rng(0).integers(0, 256, (30, 40, 3)).astype(np.uint8)
    assert np.abs(vision.from_lab(vision.to_lab(rgb)).astype(int) - rgb).max() <= 1
    assert vision.polygon_mask(10, 10, np.array([[2, 2], [7, 2], [7, 7], [2, 7.0]])).sum() == 36
    assert vision.edge_distance(np.pad(np.ones((5, 5), bool), 1)).max() == pytest.approx(3 * 0.955)
    green = np.zeros((100, 100, 3), np.uint8)
    green[...] = (90, 90, 110)
    green[20:40, 20:40] = (40, 160, 40)
    left = vision.water_mask(green, np.ones((100, 100), bool))
    assert not left[30, 30] and left[80, 80]
    assert vision.water_mask(np.full((50, 50, 3), (40, 160, 40), np.uint8), np.ones((50, 50), bool)).all()


def test_rest_windows_and_downloads(spark, tmp_path):
    for m in (1, 2):
        (tmp_path / f"m{m}.json").write_text(f'{{"files": ["c___2024-0{m}-01T00-00-00Z.jpg", {{"key": "d/c___2024-0{m}-02T00-00-00Z.JPG"}}, "x.png"]}}')
    pages = rest.pages(spark, str(tmp_path / "m{month}.json"), "cam1", [{"month": 1}, {"month": 2}], pause=0)
    listed = rest.listed_images(pages, str(tmp_path / "store"))
    assert listed.count() == 4
    (tmp_path / "store/cam1").mkdir(parents=True)
    (tmp_path / "store/cam1/c___2024-01-01T00-00-00Z.jpg").write_bytes(b"abc")
    good, bad = rest.download(listed.where("month(timestamp_utc) = 1").where("day(timestamp_utc) = 1"), None, str(tmp_path / "out"), 2)
    assert [r.downloaded_now for r in good.collect()] == [True] and bad.count() == 0
    again, _ = rest.download(listed.where("month(timestamp_utc) = 1").where("day(timestamp_utc) = 1"), readers.files(spark, str(tmp_path / "out")), str(tmp_path / "out"), 2)
    assert [r.downloaded_now for r in again.collect()] == [False]


def test_listing_goes_by_month_where_the_whole_list_may_be_cut(spark, tmp_path):
    name = "c___2024-{:02d}-{:02d}T00-00-00Z.jpg".format
    answers = {"a": [name(1, 1), name(1, 2)], "b": [name(1, 1), name(1, 2), name(1, 3)], "c": []}  # b fills the limit, c is empty, d fails
    for cam in "abcd":
        (tmp_path / f"camera-{cam}.json").write_text(json.dumps([{"createdDate": "2024-01-15T00:00:00Z", "newestImageDT": "2024-01-20T00:00:00Z"}]))
        for m in (1, 2):
            (tmp_path / f"list-{cam}-2024-{m:02d}-01T00-00-00Z.json").write_text(json.dumps({"items": [name(m, 1), name(m, 2)]}))
        if cam in answers:
            (tmp_path / f"list-{cam}-.json").write_text(json.dumps({"items": answers[cam]}))

    def get(url, params=None, **_):
        what = "camera" if url == "camera" else "list"
        end = f"-{params.get('after', '')}" if what == "list" else ""
        return (tmp_path / f"{what}-{params['camId']}{end}.json").read_bytes()

    cameras = spark.createDataFrame([(c,) for c in "abcd"] + [("a",)], "cam_id string")
    real, rest.get = rest.get, get
    try:
        asked = rest.listing(cameras, "camera", "list", limit=3, parallel=2, pause=0)
        found = {(r.cam_id, r.source_filename) for r in rest.listed_images(asked, "s").collect()}
        assert found == {(c, name(m, d)) for c in "abcd" for m in ((1,) if c == "a" else (1, 2)) for d in (1, 2)}
    finally:
        rest.get = real
    with pytest.raises(Exception, match="limit"):
        rest.pages(spark, "x", limit=3).collect()


def test_gauges_are_asked_for_their_windows(spark, tmp_path):
    series = {"variable": {"variableCode": [{"value": "00060"}]}, "values": [{"value": [{"dateTime": "2024-01-01T00:00:00Z", "value": "5"}, {"dateTime": "2024-01-01T00:00:00Z", "value": "x"}]}]}
    for g in ("01", "02"):
        (tmp_path / f"{g}-2023-12-30T00:00:00Z.json").write_text(json.dumps({"value": {"timeSeries": [series] if g == "01" else []}}))
    sites = spark.createDataFrame([("g", "s", "c", "01"), ("h", "t", "e", "02")], "river_group string, site_folder string, cam_id string, nwis_id string")
    images = spark.createDataFrame([("c", datetime(2024, 1, 1)), ("e", datetime(2024, 1, 1))], "cam_id string, image_time timestamp_ntz")
    windows = pipeline.request_windows(sites, images, 2)
    got = rest.gauge_payloads(windows, str(tmp_path / "{sites}-{startDT}.json"), parallel=2)
    rows = pipeline.wide_readings(rest.gauge_readings(got, "t", gauge="nwis_id"), ["nwis_id"]).collect()
    assert [(r.nwis_id, r.time, r.discharge) for r in rows] == [("01", datetime(2024, 1, 1), 5.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "Train "), ("b", "val"), ("c", "test")], "image_path string, split string")
    assert {r.split: r["count"] for r in sinks.write_splits(df, str(tmp_path / "s")).collect()} == {"train_pool": 1, "val": 1, "test": 1}
    sinks.activate(df, str(tmp_path), "m")
    sinks.activate(df.limit(1), str(tmp_path), "m")
    assert sinks.current(spark, str(tmp_path), "m").count() == 1
    assert sinks.write_json(spark.createDataFrame([(1, {"a": 2})], "n int, m map<string,int>"), str(tmp_path / "d.json")) == {"n": 1, "m": {"a": 2}}


def test_labels(spark, tmp_path):
    (tmp_path / "origin.csv").write_text("﻿datetime_utc,variable_cd,value\n2024-01-01T00:00:00Z,00060,5\n2024-01-01T00:00:00Z,65,1.5\n2024-01-02T00:00:00Z,60,x\n")
    row = readers.labels(spark, str(tmp_path / "origin.csv")).collect()
    assert len(row) == 1 and (row[0].discharge, row[0].gauge_height) == (5.0, 1.5)
    (tmp_path / "labels.csv").write_text("filename,image_time,hydro_time,discharge\n/a/x.jpg,2024-01-01 00:00:00,2024-01-01 00:00:00,3\nx.jpg,2024-01-01 00:00:00,2024-01-01 00:00:00,4\n")
    assert [tuple(r)[0:1] + (r.discharge,) for r in readers.direct_labels(readers.csv(spark, str(tmp_path / "labels.csv"))).collect()] == [("x.jpg", 3.0)]
    assert readers.by_precedence(spark, str(tmp_path)).endswith("labels.csv")
