"""The builds as functions: terrain, raster tiles, extents, info and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions import codec
from tilespark.functions.grid import profile
from tilespark.operators import enumerate as E
from tilespark.operators import sinks, terrain
from tilespark.sources.rasters import RasterMeta


def _zooms(meta: RasterMeta, grid, start_zoom: int | None, end_zoom: int | None) -> list[int]:
    start = meta.max_zoom(grid) if start_zoom is None or start_zoom < 0 else start_zoom
    end = 0 if end_zoom is None or end_zoom < 0 else end_zoom
    E.check_zooms(start, end)
    return list(range(start, end - 1, -1))


def terrain_files(tiles: DataFrame, compress: bool = True) -> DataFrame:
    """(path, content) of height tiles; land unless a column ``mask`` says otherwise."""
    land = F.lit(bytearray(codec.LAND))
    mask = F.coalesce(F.col("mask"), land) if "mask" in tiles.columns else land
    raw = codec.raw_from_bytes(F.col("height_bytes"), F.col("children"), mask)
    content = codec.gzip_bytes(raw) if compress else raw
    return tiles.select(sinks.tile_path(F.col("zoom"), F.col("tx"), F.col("ty")).alias("path"), content.alias("content"))


def build_terrain(pixels: DataFrame, meta: RasterMeta, profile_name: str = "geodetic", tile_size: int | None = None, start_zoom: int | None = None, end_zoom: int | None = None, method: str = "average", existing: DataFrame | None = None, strict: bool = False, pyramid: bool = False) -> DataFrame:
    """Height tiles of a raster. ``strict`` keeps to the average whatever ``method`` says; ``existing`` resumes; ``pyramid`` makes coarse levels from finer ones."""
    grid = profile(profile_name, tile_size)
    return terrain.terrain_tiles(pixels, meta, grid, _zooms(meta, grid, start_zoom, end_zoom), "average" if strict else method, existing=existing, pyramid=pyramid)


def build_raster(pixels: DataFrame, meta: RasterMeta, profile_name: str = "geodetic", tile_size: int | None = None, start_zoom: int | None = None, end_zoom: int | None = None, method: str = "average") -> DataFrame:
    """Raster tiles of all bands."""
    grid = profile(profile_name, tile_size)
    return terrain.raster_tiles(pixels, meta, grid, _zooms(meta, grid, start_zoom, end_zoom), method)


def extents(spark, meta: RasterMeta, profile_name: str = "geodetic", tile_size: int | None = None, start_zoom: int | None = None, end_zoom: int | None = None) -> DataFrame:
    """Outlines of the tiles that cover a raster; no pixel is read."""
    grid = profile(profile_name, tile_size)
    z = _zooms(meta, grid, start_zoom, end_zoom)
    keys = E.keys(E.raster_ranges(spark, grid, meta, z[0], z[-1]))
    return keys.withColumn("feature", sinks.feature(grid, F.col("zoom"), F.col("tx"), F.col("ty")))


def tile_info(tiles: DataFrame, show_heights: bool = False, show_children: bool = True, show_type: bool = True) -> DataFrame:
    """Text of decoded tiles (heights, children, mask)."""
    return tiles.select("zoom", "tx", "ty", sinks.info(F.col("heights"), F.col("children"), F.col("mask"), show_heights, show_children, show_type).alias("info"))


def decode_tiles(files: DataFrame, compressed: bool = True) -> DataFrame:
    """(zoom, tx, ty, content) to heights, children and mask."""
    from tilespark.session import ship

    ship(files.sparkSession)
    raw = codec.gunzip_bytes(F.col("content")) if compressed else F.col("content")
    keys = [c for c in ("zoom", "tx", "ty") if c in files.columns]
    return files.select(*keys, raw.alias("raw")).select(*keys, codec.decode(F.col("raw")).alias("t")).select(*keys, "t.*")


def export_tiles(tiles: DataFrame, profile_name: str = "geodetic") -> DataFrame:
    """Georeferenced cells of decoded tiles."""
    return terrain.export_cells(tiles, profile(profile_name))
