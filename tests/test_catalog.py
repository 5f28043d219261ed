"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import duckdb
import pytest

from tarnwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_site_crc_like_zlib(spark, sf):
    import zlib

    assert all(r.crc == zlib.crc32(r.n_name.encode()) for r in catalog.site_crc(spark, sf).collect())


def test_image_metrics_like_plain_loops(spark, sf):
    """Grey means, entropy, focus and colour of the pictures, pixel by pixel."""
    import math
    from statistics import fmean, pstdev

    source = {}
    for r in catalog.image_rows(spark, sf).limit(40).collect():
        source[r.image.origin] = (r.image.height, bytes(r.image.data))
    seen = 0
    for r in catalog.image_metrics(spark, sf).collect():
        if r.image_path not in source:
            continue
        height, data = source[r.image_path]
        assert r.read_ok == (height * 16 * 3 == len(data))
        if not r.read_ok:
            continue
        seen += 1
        pixels = [(data[i], data[i + 1], data[i + 2]) for i in range(0, len(data), 3)]
        grey = [math.floor(0.114 * b + 0.587 * g + 0.299 * x + 0.5) for b, g, x in pixels]
        counts = [grey.count(v) for v in set(grey)]
        share = [n / (len(grey) + 1e-8) for n in counts]
        assert abs(r.gray_mean - fmean(grey)) < 0.02 and abs(r.gray_std - pstdev(grey)) < 0.02
        assert abs(r.entropy + sum(p * math.log2(p) for p in share)) < 0.05
        assert abs(r.grayscale_score - fmean((abs(x - g) + abs(x - b) + abs(g - b)) / 3 / 255 for b, g, x in pixels)) < 1e-5
        rg, yb = [abs(x - g) for b, g, x in pixels], [abs(0.5 * (x + g) - b) for b, g, x in pixels]
        assert abs(r.colorfulness - (math.hypot(pstdev(rg), pstdev(yb)) + 0.3 * math.hypot(fmean(rg), fmean(yb)))) < 1e-3
        at = lambda y, x: grey[(-y if y < 0 else 30 - y if y > 15 else y) * 16 + (-x if x < 0 else 30 - x if x > 15 else x)]
        lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(16) for x in range(16)]
        assert abs(r.lap_var - pstdev(lap) ** 2) < 0.01 * r.lap_var
        bright = [(max(p), max(p) - min(p)) for p in pixels]
        assert abs(r.glare_saturated_ratio - fmean(v / 255 > 0.985 and d / max(v, 1) < 0.30 for v, d in bright)) < 0.01
    assert seen >= 30


def test_no_cross_join_in_timeseries(spark, sf):
    plan = catalog.QUERIES["interpolate_at"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 210
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
