
from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import bounds as B
from tilespark.functions import codec
from tilespark.functions import grid as G
from tilespark.operators import enumerate as E
from tilespark.operators import resample as R
from tilespark.operators import sinks, terrain
from tilespark.plans import build
from tilespark.session import table
from tilespark.sources import rasters as S

GEO, MERC = G.global_geodetic(), G.global_mercator()
QUERIES: dict = {}
#: Resolutions that are no exact powers, for the zoom query.
RESOLUTIONS = (100.0, 2.5, 1.3, 0.7, 0.3, 0.0625, 0.01, 0.0008333333333333334, 0.0001)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _z(c="zoom"):
    return F.col(c)


def _dem(spark, d):
    return S.dem_pixels(spark, d), S.dem_meta(spark, d)


def _keys(spark, d):
    return E.keys(E.raster_ranges(spark, GEO, S.dem_meta(spark, d)))


def _tiles(spark, d):
    return terrain.terrain_tiles(*_dem(spark, d), GEO)


def _named(names, cols):
    return [c.alias(n) for n, c in zip(names, cols)]


XY, BOX, GT = ("x", "y"), ("minx", "miny", "maxx", "maxy"), tuple(f"gt{i}" for i in range(6))


# ---- sources ----


@query
def raster_scan(spark, d):
    return S.dem(spark, d)


@query
def raster_bounds(spark, d):
    p = S.dem(spark, d)
    x0, y0, s = *S.DEM_ORIGIN, S.DEM_PIXEL
    return p.agg((x0 + F.min("col") * s).alias("minx"), (y0 - (F.max("row") + 1) * s).alias("miny"), (x0 + (F.max("col") + 1) * s).alias("maxx"), (y0 - F.min("row") * s).alias("maxy"))


@query
def raster_resolution(spark, d):
    p = S.dem(spark, d)
    s = S.DEM_PIXEL
    n = lambda c: F.max(c) - F.min(c) + 1
    return p.agg(((n("col") * s) / n("col")).alias("res_x"), ((n("row") * s) / n("row")).alias("res_y"))


@query
def raster_multiband(spark, d):
    return S.dem2(spark, d).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))


@query
def raster_mosaic(spark, d):
    p = S.dem(spark, d)
    return S.mosaic(p.filter("col < 75"), p.filter("col >= 75")).agg(F.count(F.lit(1)).alias("n"), F.sum("elev_m").alias("sum_elev"))


# ---- grid ----


@query
def grid_profiles(spark, d):
    rows = [(g.name, g.tile_size, g.epsg, g.minx, g.miny, g.maxx, g.maxy, g.root_tiles) for g in (GEO, MERC)]
    return spark.createDataFrame(rows, "profile string, tile_size int, epsg int, minx double, miny double, maxx double, maxy double, root_tiles int")


@query
def grid_resolution(spark, d):
    z = spark.range(21).select(F.col("id").cast("int").alias("zoom"))
    return z.select(F.lit("geodetic").alias("profile"), "zoom", GEO.resolution(_z()).alias("res")).union(z.select(F.lit("mercator"), "zoom", MERC.resolution(_z())))


@query
def grid_zoom_for_resolution(spark, d):
    r = spark.createDataFrame([(x,) for x in RESOLUTIONS], "res double")
    return r.select("res", GEO.zoom_for_resolution(F.col("res")).alias("zoom"))


def _pixels(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_size") % 12).cast("int").alias("zoom"), (F.col("p_partkey") * 37 % 100000).alias("px"), (F.col("p_partkey") * 91 % 50000).alias("py"))


@query
def grid_pixels_to_tile(spark, d):
    return _pixels(spark, d).select("zoom", "px", "py", *_named(("tx", "ty"), GEO.pixels_to_tile(F.col("px"), F.col("py"))))


@query
def grid_pixels_to_crs(spark, d):
    return _pixels(spark, d).select("zoom", "px", "py", *_named(XY, GEO.pixels_to_crs(F.col("px"), F.col("py"), _z())))


def _points(spark, d):
    c = table(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("id"), (-180 + F.col("c_custkey") % 360 + 0.5).alias("lon"), (-90 + F.expr("(c_custkey div 360) % 180") + 0.5).alias("lat"))
    return p.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(8))))


@query
def grid_crs_to_pixels(spark, d):
    return _points(spark, d).select("id", "zoom", *_named(("px", "py"), GEO.crs_to_pixels(F.col("lon"), F.col("lat"), _z())))


@query
def grid_crs_to_tile(spark, d):
    return _points(spark, d).select("id", "zoom", *_named(("tx", "ty"), GEO.crs_to_tile(F.col("lon"), F.col("lat"), _z())))


@query
def grid_tile_bounds(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", *_named(BOX, GEO.tile_bounds(F.col("tx"), F.col("ty"), _z())))


@query
def grid_tile_extent(spark, d):
    return E.grid_ranges(spark, GEO, 10)


@query
def tiler_corner_tiles(spark, d):
    r = E.raster_ranges(spark, GEO, S.dem_meta(spark, d))
    return r.select("zoom", *(F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), ("llx", "lly", "urx", "ury"))))


@query
def tiler_tile_bounds(spark, d):
    r = E.raster_ranges(spark, GEO, S.dem_meta(spark, d))
    return r.select("zoom", *(F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), BOX)))


@query
def tiler_max_zoom(spark, d):
    return spark.createDataFrame([(S.dem_meta(spark, d).max_zoom(GEO),)], "max_zoom int")


@query
def bounds_reproject(spark, d):
    p = _points(spark, d).filter("zoom = 0 AND abs(lat) < 85")
    x, y = G.to_mercator(F.col("lon"), F.col("lat"))
    return p.agg(*(F.round(a, 3).alias(n) for n, a in zip(BOX, (F.min(x), F.min(y), F.max(x), F.max(y)))))


# a raster in degrees on the mercator grid


@query
def tiler_bounds_mercator(spark, d):
    return spark.createDataFrame([S.dem_meta(spark, d).bounds_on(MERC)], "minx double, miny double, maxx double, maxy double").select(*(F.round(c, 3).alias(c) for c in BOX))


@query
def tiler_max_zoom_mercator(spark, d):
    return spark.createDataFrame([(S.dem_meta(spark, d).max_zoom(MERC),)], "max_zoom int")


@query
def tiler_tile_bounds_mercator(spark, d):
    r = E.raster_ranges(spark, MERC, S.dem_meta(spark, d))
    return r.select("zoom", *(F.col(a).alias(b) for a, b in zip(("x0", "y0", "x1", "y1"), BOX)))


@query
def extents_mercator(spark, d):
    return build.extents(spark, S.dem_meta(spark, d), "mercator")


@query
def terrain_children_mercator(spark, d):
    m = S.dem_meta(spark, d)
    return E.keys(E.raster_ranges(spark, MERC, m)).select("zoom", "tx", "ty", terrain.children(MERC, m, _z(), F.col("tx"), F.col("ty")).alias("children"))


@query
def resample_average_mercator(spark, d):
    p, m = _dem(spark, d)
    return R.area(p, m, MERC, list(range(m.max_zoom(MERC) + 1)), terrain=False).select("zoom", "gx", "gy", "v")


@query
def resample_nearest_mercator(spark, d):
    p, m = _dem(spark, d)
    return R.point(p, m, MERC, list(range(m.max_zoom(MERC) + 1)), terrain=False).select("zoom", "gx", "gy", "v")


@query
def tile_geotransform(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", *_named(GT, sinks.geotransform(GEO, _z(), F.col("tx"), F.col("ty"))))


@query
def terrain_tile_bounds(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", *_named(("res", *BOX), GEO.terrain_tile_bounds(F.col("tx"), F.col("ty"), _z())))


@query
def terrain_geotransform(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", *_named(GT, sinks.terrain_geotransform(GEO, _z(), F.col("tx"), F.col("ty"))))


# ---- bounds ----


def _boxes(df, key):
    k = F.col(key).cast("long")
    return df.select(k.alias("id"), (k * 7 % 40).alias("minx"), (k * 11 % 30).alias("miny"), (k * 7 % 40 + k * 3 % 9 - 1).alias("maxx"), (k * 11 % 30 + k * 5 % 8 - 1).alias("maxy"))


def _suppliers(spark, d):
    return _boxes(table(spark, d, "supplier"), "s_suppkey")


@query
def bounds_validate(spark, d):
    return _suppliers(spark, d).select("id", *BOX, B.is_valid(B.of()).alias("valid"))


def _valid(spark, d):
    return _suppliers(spark, d).filter(B.is_valid(B.of()))


@query
def bounds_corners(spark, d):
    return _valid(spark, d).select("id", *(c.alias(f"{k}_{a}") for k, p in B.corners(B.of()).items() for a, c in zip(XY, p)))


@query
def bounds_size(spark, d):
    return _valid(spark, d).select("id", *_named(("width", "height"), B.size(B.of())))


@query
def bounds_quadrants(spark, d):
    return _valid(spark, d).select("id", *(c.cast("long").alias(f"{k}_{a}") for k, q in B.quadrants(B.of(), whole=True).items() for a, c in zip(BOX, q)))


@query
def bounds_overlap_join(spark, d):
    return B.overlap_join(_valid(spark, d), _boxes(table(spark, d, "nation"), "n_nationkey"), "id", "id", 8.0)


# ---- enumeration ----


@query
def enumerate_grid(spark, d):
    return E.keys(E.grid_ranges(spark, GEO, 4))


@query
def enumerate_extent(spark, d):
    return _keys(spark, d)


@query
def enumerate_zoom_range(spark, d):
    return E.keys(E.raster_ranges(spark, GEO, S.dem_meta(spark, d), 5, 3))


@query
def enumerate_ordered(spark, d):
    return E.ordered_ranges(E.raster_ranges(spark, GEO, S.dem_meta(spark, d)))


@query
def tile_count_by_zoom(spark, d):
    return E.counts(E.raster_ranges(spark, GEO, S.dem_meta(spark, d)))


@query
def tile_count(spark, d):
    return tile_count_by_zoom(spark, d).agg(F.sum("n").alias("n"))


# ---- resampling ----


def _area(method):
    def f(spark, d):
        p, m = _dem(spark, d)
        v = F.col("v") if method == "average" else F.col("v").cast("long")
        return R.area(p, m, GEO, list(range(m.max_zoom(GEO) + 1)), method).select("zoom", "gx", "gy", v.alias("v"))

    f.__name__ = f"resample_{method}"
    return query(f)


def _point(method):
    def f(spark, d):
        p, m = _dem(spark, d)
        return R.point(p, m, GEO, list(range(m.max_zoom(GEO) + 1)), method).select("zoom", "gx", "gy", F.round(F.col("v").cast("double"), 6).alias("v"))

    f.__name__ = f"resample_{method}"
    return query(f)


for _m in R.AREA:
    _area(_m)
for _m in R.POINT:
    _point(_m)


@query
def resample_max_pyramid(spark, d):
    """Each level from the one above; extremes are the same as from the pixels."""
    p, m = _dem(spark, d)
    return R.area(p, m, GEO, list(range(m.max_zoom(GEO) + 1)), "max", pyramid=True).select("zoom", "gx", "gy", F.col("v").cast("long").alias("v"))


@query
def terrain_quantise(spark, d):
    return QUERIES["resample_average"](spark, d).select("zoom", "gx", "gy", codec.quantise(F.col("v")).alias("h"))


# ---- terrain ----


@query
def terrain_children(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", terrain.children(GEO, S.dem_meta(spark, d), _z(), F.col("tx"), F.col("ty")).alias("children"))


@query
def children_vs_tiles(spark, d):
    """Flags beside the number of child tiles that are really enumerated."""
    t = terrain_children(spark, d)
    kids = _keys(spark, d).groupBy((F.col("zoom") - 1).alias("zoom"), F.expr("tx div 2").alias("tx"), F.expr("ty div 2").alias("ty")).agg(F.count(F.lit(1)).alias("n_child_tiles"))
    return t.join(kids, ["zoom", "tx", "ty"], "left").select("zoom", "tx", "ty", "children", F.coalesce("n_child_tiles", F.lit(0)).cast("long").alias("n_child_tiles"))


@query
def terrain_border(spark, d):
    return terrain.border_members(terrain_quantise(spark, d)).select("zoom", "tx", "ty", "r", "k", "h")


@query
def terrain_tiles(spark, d):
    return _tiles(spark, d).select("zoom", "tx", "ty", "children", "n_cells", "h_sum", F.md5("height_bytes").alias("h_md5"))


@query
def raster_tiles(spark, d):
    p, m = _dem(spark, d)
    t = terrain.raster_tiles(p, m, GEO, list(range(m.max_zoom(GEO) + 1)), "max")
    text = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["r"].cast("string"), c["k"].cast("string"), c["v"].cast("long").cast("string"))), ",")
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["v"].cast("long"))
    return t.select("zoom", "tx", "ty", F.size("cells").cast("long").alias("n_cells"), total.alias("h_sum"), F.md5(text.cast("binary")).alias("h_md5"))


@query
def terrain_empty(spark, d):
    _, m = _dem(spark, d)
    p = S.empty_pixels(spark)
    return terrain.terrain_tiles(p, m, GEO, [1, 0]).select("zoom", "tx", "ty", "n_cells", "h_sum", F.md5("height_bytes").alias("h_md5"))


def _raw(spark, d):
    land = F.lit(bytearray(codec.LAND))
    return _tiles(spark, d).withColumn("raw", codec.raw_from_bytes(F.col("height_bytes"), F.col("children"), land))


@query
def terrain_encode_raw(spark, d):
    return _raw(spark, d).select("zoom", "tx", "ty", F.octet_length("raw").cast("long").alias("n_bytes"), F.md5("raw").alias("payload_md5"))


def _sums(decoded):
    total = F.aggregate("heights", F.lit(0).cast("long"), lambda a, h: a + h)
    return decoded.select("zoom", "tx", "ty", "children", total.alias("h_sum"))


@query
def terrain_encode(spark, d):
    """Gzip and back: what the file holds."""
    return _sums(build.decode_tiles(_raw(spark, d).select("zoom", "tx", "ty", codec.gzip_bytes(F.col("raw")).alias("content"))))


@query
def terrain_decode(spark, d):
    """Files written to the shared folder and read back by their paths."""
    from tilespark.session import as_uri, scratch

    target = as_uri(scratch(spark, "tiles"))
    sinks.write_files(build.terrain_files(_tiles(spark, d)), target).count()
    return _sums(build.decode_tiles(S.read_tiles(spark, target)))


@query
def terrain_decode_raw(spark, d):
    return _sums(build.decode_tiles(_raw(spark, d).select("zoom", "tx", "ty", F.col("raw").alias("content")), compressed=False))


def _flags(spark, d):
    p = table(spark, d, "part")
    mask = F.when(F.col("p_size") % 3 == 2, F.unhex(F.repeat(F.lit("0001"), 8))).when(F.col("p_size") % 2 == 1, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 16).cast("int").alias("children"), mask.alias("mask"), F.when(F.col("p_size") % 3 == 0, codec.SHORT).when(F.col("p_size") % 3 == 1, codec.LONG).otherwise(8451).cast("long").alias("n_bytes"))


@query
def terrain_validate(spark, d):
    return _flags(spark, d).select("id", "n_bytes", codec.mask_kind(F.col("n_bytes")).alias("mask_kind"))


@query
def terrain_mask(spark, d):
    b = codec.mask_booleans(F.col("mask"))
    return _flags(spark, d).select("id", F.size(b).cast("long").alias("n"), F.size(F.filter(b, lambda v: v)).cast("long").alias("n_water"))


@query
def tile_type(spark, d):
    m = F.col("mask")
    return _flags(spark, d).select("id", codec.is_water(m).alias("is_water"), codec.is_land(m).alias("is_land"), codec.has_water_mask(m).alias("has_mask"))


@query
def child_flags(spark, d):
    c = F.col("children")
    return _flags(spark, d).select("id", codec.has_children(c).alias("any_child"), *(codec.has_child(c, k).alias(k) for k in codec.FLAGS))


@query
def child_flags_update(spark, d):
    c = F.col("children")
    return _flags(spark, d).select("id", *(codec.set_child(c, k).alias(f"set_{k}") for k in codec.FLAGS), *(codec.set_child(c, k, False).alias(f"clear_{k}") for k in codec.FLAGS), codec.set_all_children().alias("all_on"), codec.set_all_children(False).alias("all_off"))


@query
def terrain_export(spark, d):
    t = _tiles(spark, d).select("zoom", "tx", "ty", codec.unpack_heights(F.col("height_bytes")).alias("heights"))
    return terrain.export_cells(t, GEO)


# ---- sinks ----


@query
def tile_path(spark, d):
    return _keys(spark, d).select("zoom", "tx", "ty", sinks.tile_path(_z(), F.col("tx"), F.col("ty")).alias("path"))


@query
def resume_anti_join(spark, d):
    t = _keys(spark, d)
    there = t.filter("(tx + ty) % 2 = 0").select(sinks.tile_path(_z(), F.col("tx"), F.col("ty")).alias("path"))
    return sinks.resume(t, there).select("zoom", "tx", "ty", "path")


@query
def extents_feature(spark, d):
    return build.extents(spark, S.dem_meta(spark, d))


@query
def extents_geojson(spark, d):
    return sinks.feature_collections(extents_feature(spark, d))


@query
def tile_info(spark, d):
    t = _tiles(spark, d).select("zoom", "tx", "ty", codec.unpack_heights(F.col("height_bytes")).alias("heights"), "children", F.lit(bytearray(codec.LAND)).alias("mask"))
    return build.tile_info(t)
