"""The raster engine: goldens, properties and file round trips."""

import gzip

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tilespark.functions import bounds as B
from tilespark.functions import codec
from tilespark.functions import grid as G
from tilespark.operators import enumerate as E
from tilespark.operators import resample as R
from tilespark.operators import sinks, terrain
from tilespark.plans import build
from tilespark.plans.oracle import oracle
from tilespark.plans.queries import QUERIES, RESOLUTIONS
from tilespark.session import as_uri
from tilespark.sources import rasters as S
from tilespark.streaming import tiles as streaming

GEO = G.global_geodetic()
SQL = oracle(RESOLUTIONS)


def plain(v):
    return v.item() if hasattr(v, "item") else v


def rows_of(frame, columns):
    return sorted(repr([None if v is None or v != v else plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "nation customer supplier part orders".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_grid_goldens():
    assert [GEO.resolution_of(z) for z in (0, 1, 5, 10)] == [2.769230769230769, 1.3846153846153846, 0.08653846153846154, 0.002704326923076923]
    assert G.global_geodetic(tms=False).resolution_of(0) == 5.538461538461538
    assert G.global_mercator().resolution_of(0) == pytest.approx(156543.03392804097)
    assert GEO.zoom_extent(0) == (0, 0, 2, 1) and GEO.zoom_extent(5) == (0, 0, 64, 32) and G.global_mercator().zoom_extent(5) == (0, 0, 32, 32)
    with pytest.raises(ValueError):
        G.profile("other")
    with pytest.raises(ValueError):
        G.reproject(4326, 2154, None, None)


def test_counts_golden(spark):
    levels = E.extent_ranges(spark, GEO, (-5.5, 50.0, -4.0, 51.2), GEO.zoom_of(1 / 1200))
    counts = {r["zoom"]: r["n"] for r in E.counts(levels).collect()}
    assert [counts[z] for z in range(12, -1, -1)] == [1015, 270, 80, 20, 6, 4, 2, 2, 1, 1, 1, 1, 1]
    assert E.keys(levels).count() == sum(counts.values()) == 1404
    a = [tuple(r) for r in E.ordered_ranges(levels).orderBy("idx").collect()]
    assert a == [(r["idx"], r["zoom"], r["tx"], r["ty"]) for r in E.ordered(E.keys(levels)).orderBy("idx").collect()]
    with pytest.raises(ValueError):
        E.grid_ranges(spark, GEO, 1, 2)
    clipped = E.extent_ranges(spark, GEO, (-180.0, -90.0, 180.0, 90.0), 2, 0, clip_to_grid=True)
    assert {r["zoom"]: r["n"] for r in E.counts(clipped).collect()} == {0: 2, 1: 8, 2: 32}


def test_quantise_golden(spark):
    metres = [-1000.0, -0.1, 0.0, 0.19, 0.2, 1.999, 8848.86, 12106.8, -2000.0, 99999.0]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in metres], "m double").select(codec.quantise(F.col("m"))).collect()]
    assert got == [0, 4999, 5000, 5000, 5001, 5009, 49244, 65534, 0, 65535]


def test_tile_centre_is_in_its_tile(spark):
    keys = E.keys(E.grid_ranges(spark, GEO, 6, 6)).filter("tx < 128 AND ty < 64")
    b = GEO.tile_bounds(F.col("tx"), F.col("ty"), F.col("zoom"))
    tx, ty = GEO.crs_to_tile((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, F.col("zoom"))
    assert keys.filter((tx != F.col("tx")) | (ty != F.col("ty"))).count() == 0
    assert keys.select(GEO.crs_to_tile(F.lit(-181.0), F.lit(0.0), F.lit(3))[0].alias("x")).filter("x IS NOT NULL").count() == 0


def test_reprojection_round_trip(spark):
    p = spark.createDataFrame([(-179.0, -80.0), (0.0, 0.0), (12.5, 47.3)], "lon double, lat double")
    x, y = G.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = G.to_geodetic(x, y)
    assert p.filter((F.abs(lon - F.col("lon")) > 1e-9) | (F.abs(lat - F.col("lat")) > 1e-9)).count() == 0


def test_bounds_check_raises(spark):
    bad = spark.createDataFrame([(2.0, 0.0, 1.0, 1.0)], "minx double, miny double, maxx double, maxy double")
    with pytest.raises(Exception, match="minimum X"):
        bad.select(*(c.alias(str(i)) for i, c in enumerate(B.checked(B.of())))).collect()


def numpy_tile(pixels, meta, zoom, tx, ty):
    """A tile's heights by brute force from the definitions."""
    res = 2.769230769230769 / 2**zoom
    minx, maxx = tx * 65 * res - 180, (tx + 1) * 65 * res - 180
    maxy = (ty + 1) * 65 * res - 90
    p = (maxx - minx) / 64
    out = np.full((65, 65), codec.SEA_LEVEL)
    c, r, v = pixels
    x0, x1 = meta.x0 + c * meta.dx, meta.x0 + (c + 1) * meta.dx
    y1, y0 = meta.y0 - r * meta.dy, meta.y0 - (r + 1) * meta.dy
    eps = 1e-9
    for i in range(65):
        for k in range(65):
            w, n = minx - p + k * p, maxy + p - i * p
            on = (x0 < w + p - eps) & (x1 > w + eps) & (y0 < n - eps) & (y1 > n - p + eps)
            if on.any():
                out[i, k] = int((np.float32(v[on].sum() / on.sum()) + np.float32(1000)) * np.float32(5))
    return out


def test_tiles_against_numpy_and_shared_borders(spark, sf_dir):
    meta = S.dem_meta(spark, sf_dir)
    p = S.dem(spark, sf_dir).toPandas()
    pixels = (p.col.to_numpy(), p.row.to_numpy(), p.elev_m.to_numpy(np.float64))
    tiles = {(r["zoom"], r["tx"], r["ty"]): np.frombuffer(r["height_bytes"], "<u2").reshape(65, 65) for r in terrain.terrain_tiles(S.dem_pixels(spark, sf_dir), meta, GEO).collect()}
    for key in sorted(tiles)[::4]:
        assert (tiles[key] == numpy_tile(pixels, meta, *key)).all(), key
    for (z, x, y), t in tiles.items():
        if (z, x + 1, y) in tiles:
            assert (t[:, 64] == tiles[z, x + 1, y][:, 0]).all()
        if (z, x, y + 1) in tiles:
            assert (t[0, :] == tiles[z, x, y + 1][64, :]).all()


def test_files_round_trip_resume_and_stream(spark, sf_dir, tmp_path):
    meta, pixels = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    tiles = build.build_terrain(pixels, meta, start_zoom=3)
    target = as_uri(str(tmp_path / "t"))
    assert sinks.write_files(build.terrain_files(tiles), target).count() == tiles.count()
    assert not list((tmp_path / "t").rglob("*.tmp"))
    one = next((tmp_path / "t").rglob("*.terrain")).read_bytes()
    assert len(gzip.decompress(one)) == codec.SHORT
    read = build.decode_tiles(S.read_tiles(spark, target))
    a = {tuple(r)[:3]: r["heights"] for r in read.collect()}
    b = {(r["zoom"], r["tx"], r["ty"]): np.frombuffer(r["height_bytes"], "<u2").tolist() for r in tiles.collect()}
    assert a == b
    there = S.read_tiles(spark, target).filter("zoom > 1")
    assert sorted(r["zoom"] for r in build.build_terrain(pixels, meta, start_zoom=3, existing=there).collect()) == [0, 1]
    stream = streaming.info_stream(spark, target).writeStream.format("memory").queryName("infos").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("infos").count() == len(a)
    text = build.tile_info(read, show_heights=True).filter("zoom = 0").collect()[0]["info"].split("\n")
    assert text[0] == "Heights:" and len(text) == 68 and len(text[1].split(" ")) == 65
    exported = build.export_tiles(read.filter("zoom = 0"))
    assert exported.count() == codec.CELLS and exported.filter("abs(elev_m - (raw_i16 / 5.0D - 1000)) > 1e-9").count() == 0


def test_raw_encoders_agree(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 65536, codec.CELLS).tolist()
    mask = bytes(rng.integers(0, 2, 65536).astype(np.uint8))
    df = spark.createDataFrame([(h, 9, bytearray(b"\x01")), (h, 15, bytearray(mask))], "heights array<int>, children int, mask binary")
    raw = df.select("*", codec.encode_raw(F.col("heights"), F.col("children"), F.col("mask")).alias("raw"))
    assert sorted(r[0] for r in raw.select(codec.mask_kind(F.octet_length("raw"))).collect()) == ["grid", "single"]
    back = raw.select("heights", "children", "mask", codec.decode(F.col("raw")).alias("t"))
    assert back.filter("heights = t.heights AND children = t.children AND mask = t.mask").count() == 2
    with pytest.raises(Exception, match="8452"):
        raw.select(codec.decode(F.substring("raw", 1, 100))).collect()


def test_nodata_multiband_mosaic_and_rows(spark, sf_dir):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    gaps = px.withColumn("value", F.when((F.col("col") + F.col("row")) % 3 != 0, F.col("value")))
    full, some = (R.area(p, meta, GEO, [4], "average").count() for p in (px, gaps))
    assert 0 < some <= full
    lows = R.area(px, meta, GEO, [4], "min").withColumnRenamed("v", "lo").drop("n").join(R.area(px, meta, GEO, [4], "max").withColumnRenamed("v", "hi").drop("n"), ["band", "zoom", "gx", "gy"]).join(R.area(px, meta, GEO, [4]), ["band", "zoom", "gx", "gy"])
    assert lows.filter("NOT (lo <= v AND v <= hi)").count() == 0
    assert build.build_raster(S.dem2(spark, sf_dir), meta, start_zoom=2).select("band").distinct().count() == 2
    back = S.explode_rows(S.pack_rows(px))
    assert back.exceptAll(px.select("band", "col", "row", "value")).count() == 0 and back.count() == px.count()
    with pytest.raises(ValueError):
        R.resample(px, meta, GEO, [1], "other")
    with pytest.raises(ValueError):
        terrain.terrain_tiles(px, meta, G.global_mercator())
    for bad in ({"epsg": None}, {"n_bands": 0}, {"dy": -1.0}):
        with pytest.raises(ValueError):
            S.RasterMeta(**({"n_cols": 1, "n_rows": 1, "x0": 0.0, "y0": 0.0, "dx": 1.0, "dy": 1.0} | bad))


def test_mercator_raster_from_degrees(spark, sf_dir):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    merc = G.global_mercator()
    assert meta.requires_reprojection(merc) and not meta.requires_reprojection(GEO) and meta.max_zoom(merc) == 5
    assert build.extents(spark, meta, "mercator", start_zoom=5, end_zoom=5).agg(F.min("ty")).collect()[0][0] >= 18  # north of 30 degrees
    near = R.point(px, meta, merc, [5], terrain=False).select("gx", "gy", F.col("v").alias("near"))
    both = R.area(px, meta, merc, [5], "min", terrain=False).join(R.area(px, meta, merc, [5], "max", terrain=False).select("gx", "gy", F.col("v").alias("hi")), ["gx", "gy"]).join(near, ["gx", "gy"])
    assert both.count() == near.count() > 1000 and both.filter("NOT near BETWEEN v AND hi").count() == 0
    tiles = build.build_raster(px, meta, "mercator")
    keys = build.extents(spark, meta, "mercator")
    assert tiles.join(keys, ["zoom", "tx", "ty"], "left_anti").count() == 0 and tiles.filter("zoom = 0").count() == 1
    for bad in ({"y0": 90.0, "n_rows": 10}, {"epsg": 2154}):
        with pytest.raises(ValueError):
            S.RasterMeta(**({"n_cols": 10, "n_rows": 10, "x0": 0.0, "y0": 10.0, "dx": 1.0, "dy": 1.0} | bad)).max_zoom(merc)


def test_resume_aggregates_missing_tiles_only(spark, sf_dir):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    every = terrain.terrain_tiles(px, meta, GEO).cache()
    for lost in ("zoom = 4 AND tx % 3 = 0", "zoom < 2", "ty % 2 = 0", "1 = 0"):
        there = every.filter(f"NOT ({lost})").select("zoom", "tx", "ty")
        own = terrain.terrain_tiles(px, meta, GEO, existing=there)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, every.filter(lost).collect())), lost
    rows = spark.createDataFrame(every.select("zoom", "tx", "ty").collect(), "zoom int, tx long, ty long")
    plan = terrain.terrain_tiles(px, meta, GEO, existing=rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "orders" not in plan and "o_totalprice" not in plan  # nothing is missing: no pixel is read
    for method in ("mode", "average", "bilinear"):
        full = terrain.terrain_tiles(px, meta, GEO, method=method)
        some = terrain.terrain_tiles(px, meta, GEO, method=method, existing=every.filter("zoom <> 3").select("zoom", "tx", "ty"))
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, full.filter("zoom = 3").collect()))


def test_pyramid_and_masks(spark, sf_dir):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    near = R.area(px, meta, GEO, [5, 3], pyramid=True).join(R.area(px, meta, GEO, [5, 3]).withColumnRenamed("v", "own").drop("n"), ["band", "zoom", "gx", "gy"])
    assert near.count() == R.area(px, meta, GEO, [5, 3]).count() and near.filter("zoom = 5 AND abs(v - own) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        R.area(px, meta, GEO, [1], "mode", pyramid=True)
    assert build.build_terrain(px, meta, start_zoom=3, pyramid=True).count() == build.build_terrain(px, meta, start_zoom=3).count()
    tiles = build.build_terrain(px, meta, start_zoom=0).withColumn("mask", F.lit(bytearray(codec.WATER)))
    read = build.decode_tiles(build.terrain_files(tiles).select("content", F.lit(0).alias("zoom"), F.lit(0).alias("tx"), F.lit(0).alias("ty")))
    assert all(r["info"].endswith("Tile type: all water") for r in build.tile_info(read).collect())
    kinds = spark.createDataFrame([(bytearray(b"\0" * 65536),), (bytearray(b"\2"),), (bytearray(b"\0"),)], "mask binary").select(sinks.info(F.array(), F.lit(0), F.col("mask"), show_children=False).alias("t"))
    assert [r["t"] for r in kinds.collect()] == ["Tile type: water mask", "Tile type: unknown", "Tile type: all land"]


def test_rollup_keeps_extremes(spark, sf_dir):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    own = lambda z: R.area(px, meta, GEO, [z], "max").select("gx", "gy", "v")
    fine = R.area(px, meta, GEO, [5], "max").select("band", "zoom", "gx", "gy", "n", F.col("v").alias("s"), F.col("v").alias("lo"), F.col("v").alias("hi"))
    assert R.rollup(fine).select("gx", "gy", "hi").exceptAll(own(4)).count() == 0


def test_ascii_grid(spark, tmp_path):
    f = tmp_path / "g.asc"
    f.write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 40\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    px, meta = S.read_ascii_grid(spark, str(f))
    assert meta.bounds == (10.0, 40.0, 11.5, 41.0)
    assert sorted((r["row"], r["col"], r["value"]) for r in px.filter("value IS NOT NULL").collect()) == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0), (1, 2, 6.0)]
    assert px.filter("value IS NULL").count() == 1


def test_overlap_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    box = lambda n: [(i, *lo, *(a + b for a, b in zip(lo, map(float, rng.integers(0, 9, 2))))) for i in range(n) for lo in [tuple(map(float, rng.integers(-20, 20, 2)))]]
    a, b = box(60), box(50)
    make = lambda x: spark.createDataFrame(x, "id long, minx double, miny double, maxx double, maxy double")
    got = sorted(map(tuple, B.overlap_join(make(a), make(b), "id", "id", 4.0).collect()))
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[3] and y[1] < x[3] and x[2] < y[4] and y[2] < x[4])
