"""Tile keys: which tiles a raster or an extent needs, by arithmetic alone.

Ranges per zoom are literals, so nothing is read; a level of any size is spread
over the cluster by exploding the columns first and the rows after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilespark.functions.grid import Grid
from tilespark.sources.rasters import RasterMeta


#: Tiles or cells up to which one task lists them.
SPREAD_OVER = 1_000_000


def check_zooms(start: int, end: int) -> None:
    if start < end:
        raise ValueError("the start zoom must not be less than the end zoom")


def ranges(spark: SparkSession, per_zoom: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """(zoom, x0, y0, x1, y1), a row for each zoom."""
    rows = [(z, *(int(v) for v in r)) for z, r in per_zoom.items()]
    out = spark.createDataFrame(rows, "zoom int, x0 long, y0 long, x1 long, y1 long")
    out._n_keys = sum((x1 - x0 + 1) * (y1 - y0 + 1) for _, x0, y0, x1, y1 in rows)
    return out


def spread(columns: DataFrame, n: int, *by: str) -> DataFrame:
    """Deal the tile columns over the cluster when they stand for many tiles."""
    return columns.repartition(*by) if n > SPREAD_OVER else columns


def keys(levels: DataFrame) -> DataFrame:
    """All tile keys of the ranges, both ends included."""
    xs = spread(levels.select("zoom", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("tx")), getattr(levels, "_n_keys", 0), "zoom", "tx")
    return xs.select("zoom", "tx", F.explode(F.sequence("y0", "y1")).alias("ty"))


def grid_ranges(spark: SparkSession, grid: Grid, start: int, end: int = 0) -> DataFrame:
    check_zooms(start, end)
    return ranges(spark, {z: grid.zoom_extent(z) for z in range(start, end - 1, -1)})


def extent_ranges(spark: SparkSession, grid: Grid, extent: tuple, start: int, end: int = 0, clip_to_grid: bool = False) -> DataFrame:
    check_zooms(start, end)
    out = {}
    for z in range(start, end - 1, -1):
        x0, y0, x1, y1 = (*grid.tile_of(extent[0], extent[1], z), *grid.tile_of(extent[2], extent[3], z))
        if clip_to_grid:
            gx, gy = grid.zoom_extent(z)[2:]
            x1, y1 = min(x1, gx - 1), min(y1, gy - 1)
        out[z] = (x0, y0, x1, y1)
    return ranges(spark, out)


def raster_ranges(spark: SparkSession, grid: Grid, meta: RasterMeta, start: int | None = None, end: int = 0) -> DataFrame:
    """From the raster's finest zoom (or ``start``) down to ``end``."""
    start = meta.max_zoom(grid) if start is None or start < 0 else start
    return extent_ranges(spark, grid, meta.bounds_on(grid), start, max(end, 0))


def ordered(tiles: DataFrame) -> DataFrame:
    """With ``idx``: zoom falling, then x and y rising.

    The place follows from the ranges, so it is a running count of the levels
    before plus arithmetic; see :func:`ordered_ranges` for the form without a sort.
    """
    w = Window.orderBy(F.desc("zoom"), "tx", "ty")
    return tiles.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def ordered_ranges(levels: DataFrame) -> DataFrame:
    """Keys with ``idx`` from arithmetic on the (few) level rows; no key is sorted or gathered."""
    n = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    before = F.coalesce(F.sum(n).over(Window.orderBy(F.desc("zoom")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = levels.withColumn("before", before)
    xs = own.select("*", F.explode(F.sequence("x0", "x1")).alias("tx"))
    ys = xs.select("*", F.explode(F.sequence("y0", "y1")).alias("ty"))
    idx = F.col("before") + (F.col("tx") - F.col("x0")) * (F.col("y1") - F.col("y0") + 1) + F.col("ty") - F.col("y0")
    return ys.select(idx.cast("long").alias("idx"), "zoom", "tx", "ty")


def counts(levels: DataFrame) -> DataFrame:
    """Tiles per zoom in closed form."""
    return levels.select("zoom", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).alias("n"))
