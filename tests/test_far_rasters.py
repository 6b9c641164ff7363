"""Rasters that reach beyond the grid and beyond a pole."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tilespark.functions import grid as G
from tilespark.operators import resample as R
from tilespark.plans.oracle import oracle
from tilespark.plans.queries import QUERIES, RESOLUTIONS
from tilespark.sources import rasters as S

MERC = G.global_mercator()
SQL = oracle(RESOLUTIONS)


def orders(path, last):
    """A raster of thin rows down to that of the order ``last``."""
    keys = f"SELECT range AS o_orderkey FROM range({last + 1}) WHERE range % 599 = 0 OR range = {last}"
    duckdb.execute(f"COPY (SELECT o_orderkey, o_orderkey % 1500 AS o_custkey, 1000.0::DOUBLE + o_orderkey * 7919 % 400000 AS o_totalprice FROM ({keys})) TO '{path}/orders.parquet' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def far_dir(tmp_path_factory):
    """375 degrees from north to south: down to -330."""
    return orders(tmp_path_factory.mktemp("far"), 899_999)


def rows(frame):
    return sorted(repr([v.item() if hasattr(v, "item") else v for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{d}/orders.parquet'")
    assert rows(QUERIES[name](spark, d).toPandas()) == rows(con.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["extents_mercator", "resample_nearest_mercator", "terrain_children_mercator", "tiler_bounds_mercator", "tiler_max_zoom_mercator", "tiler_tile_bounds_mercator"])
def test_mercator_beyond_a_pole(spark, far_dir, name):
    same_as_sql(spark, far_dir, name)


def test_bounds_end_at_the_edge_where_a_corner_has_no_image():
    meta = S.RasterMeta(150, 2800, -10.0, 45.0, 0.0625, 0.0625)  # down to -130
    _, miny, _, maxy = meta.bounds_on(MERC)
    assert miny == MERC.miny and maxy == pytest.approx(5621521.486)
    with pytest.raises(ValueError):
        S.RasterMeta(10, 2160, -10.0, 45.0, 0.0625, 0.0625).bounds_on(MERC)  # a corner at the pole


def test_average_mercator_leaves_out_pixels_without_a_place(spark, tmp_path, far_dir):
    same_as_sql(spark, orders(tmp_path, 2140 * 150 - 1), "resample_average_mercator")  # down to -88.75
    meta = S.RasterMeta(1, 5760, 0.0, 45.0, 1.0, 0.0625)
    px = spark.createDataFrame([(0, 719, 1), (0, 2159, 2), (0, 2160, 3), (0, 3000, 4), (0, 5039, 5), (0, 5040, 6), (0, 5041, 7)], "col long, row long, value long")
    got = {r["v"]: r["low"] for r in R._spread(px, meta, MERC, [0], False, "value").groupBy("v").agg(F.min("gy").alias("low")).collect()}
    assert set(got) == {1, 7}  # not those at a pole or on the far half of the meridian
    north = math.log(math.tan(math.radians(89.875) / 2 + math.pi / 4)) * G.EARTH_RADIUS
    assert got[7] == math.floor((north + MERC.half_y) / R.pitch(MERC, 0, False))
    assert QUERIES["resample_average_mercator"](spark, far_dir).count() > 0


@pytest.mark.parametrize("name", ["terrain_decode", "terrain_decode_raw", "terrain_encode", "terrain_encode_raw", "terrain_export", "terrain_empty", "terrain_tiles"])
def test_tiles_below_the_grid(spark, far_dir, name):
    same_as_sql(spark, far_dir, name)


@pytest.mark.parametrize("name", ["children_vs_tiles", "enumerate_extent", "enumerate_ordered", "enumerate_zoom_range", "extents_feature", "extents_geojson", "grid_tile_bounds", "resume_anti_join", "terrain_children", "tile_count_by_zoom", "tiler_tile_bounds", "tile_path", "tile_info"])
def test_keys_below_the_grid(spark, far_dir, name):
    same_as_sql(spark, far_dir, name)
