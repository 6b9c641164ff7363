"""Rasters as DataFrames: pixels, their metadata and mosaics.

``pixels``: band INT, col BIGINT, row BIGINT, value (null is nodata).
``raster_rows``: band INT, row BIGINT, values ARRAY - the compact form.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.grid import Grid, project


@dataclass(frozen=True)
class RasterMeta:
    """Size, affine origin and pixel size of a north-up raster."""

    n_cols: int
    n_rows: int
    x0: float
    y0: float
    dx: float
    dy: float
    epsg: int | None = 4326
    n_bands: int = 1

    def __post_init__(self):
        if self.epsg is None:
            raise ValueError("the raster has no spatial reference system")
        if self.n_bands < 1:
            raise ValueError("the raster has no bands")
        if self.dx <= 0 or self.dy <= 0:
            raise ValueError("only north-up rasters without rotation are supported")

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 - self.n_rows * self.dy, self.x0 + self.n_cols * self.dx, self.y0

    @property
    def resolution(self) -> float:
        return abs(self.dx)

    def requires_reprojection(self, grid: Grid) -> bool:
        return self.epsg != grid.epsg

    def bounds_on(self, grid: Grid) -> tuple[float, float, float, float]:
        """The box of the four corners in the grid's reference system; beyond a pole it ends at the grid's edge."""
        minx, miny, maxx, maxy = self.bounds
        if not self.requires_reprojection(grid):
            return minx, miny, maxx, maxy
        edges = ((miny, grid.miny), (maxy, grid.maxy))
        corners = [(c[0], edge if math.isnan(c[1]) else c[1]) for x in (minx, maxx) for y, edge in edges for c in (project(self.epsg, grid.epsg, x, y),)]
        xs, ys = zip(*corners)
        return min(xs), min(ys), max(xs), max(ys)

    def resolution_on(self, grid: Grid) -> float:
        """Pixel width on the grid: of the reprojected box where the systems differ."""
        if not self.requires_reprojection(grid):
            return self.resolution
        minx, _, maxx, _ = self.bounds_on(grid)
        return (maxx - minx) / self.n_cols

    def max_zoom(self, grid: Grid) -> int:
        return grid.zoom_of(self.resolution_on(grid))

    def tile_range(self, grid: Grid, zoom: int) -> tuple[int, int, int, int]:
        """First and last tile of the raster; a border on a tile edge counts the next tile too."""
        minx, miny, maxx, maxy = self.bounds_on(grid)
        return (*grid.tile_of(minx, miny, zoom), *grid.tile_of(maxx, maxy, zoom))


def meta_of(pixels: DataFrame, x0: float, y0: float, dx: float, dy: float, epsg: int = 4326) -> RasterMeta:
    """Metadata of a pixel table whose origin is pixel (0, 0); one row reaches the driver."""
    r = pixels.agg(F.max("col").alias("c"), F.max("row").alias("r"), F.count_distinct("band").alias("b") if "band" in pixels.columns else F.lit(1).alias("b")).collect()[0]
    return RasterMeta((r["c"] if r["c"] is not None else -1) + 1, (r["r"] if r["r"] is not None else -1) + 1, x0, y0, dx, dy, epsg, max(1, r["b"]))


def empty_pixels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "band int, col long, row long, value double")


def explode_rows(rows: DataFrame) -> DataFrame:
    """``raster_rows`` to ``pixels``."""
    return rows.select("band", "row", F.posexplode("values").alias("col", "value")).select("band", F.col("col").cast("long").alias("col"), "row", "value")


def pack_rows(pixels: DataFrame) -> DataFrame:
    """``pixels`` to ``raster_rows``; gaps between the first and last column are null."""
    own = pixels.groupBy("band", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"))
    return own.select("band", "row", F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda c: F.try_element_at("m", c)).alias("values"))


def mosaic(*parts: DataFrame) -> DataFrame:
    """Tiles of one raster side by side; the parts must not overlap."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    """An ESRI ASCII grid: the six header lines reach the driver, the cells stay distributed."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"))
    head = lines.filter(F.col("value").rlike(r"^\s*[A-Za-z_]")).orderBy("n").limit(6).collect()
    h = {k.lower(): v for k, v in (r["value"].split()[:2] for r in head)}
    size, n_rows, none = float(h["cellsize"]), int(h["nrows"]), float(h.get("nodata_value", "nan"))
    x0 = float(h["xllcorner"]) if "xllcorner" in h else float(h["xllcenter"]) - size / 2
    low = float(h["yllcorner"]) if "yllcorner" in h else float(h["yllcenter"]) - size / 2
    body = lines.filter(~F.col("value").rlike(r"^\s*[A-Za-z_]") & (F.trim("value") != ""))
    # rows are numbered per partition, then shifted by the rows before: no global sort
    part = F.shiftright("n", 33)
    counted = body.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("first")).collect()  # a row for each file split
    shift, total = {}, 0
    for r in sorted(counted, key=lambda r: r["p"]):
        shift[r["p"]] = total
        total += r["c"]
    from pyspark.sql import Window

    own = body.withColumn("p", part).withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("n")) - 1)
    base = F.create_map(*[F.lit(x) for kv in shift.items() for x in kv]) if shift else F.create_map(F.lit(0), F.lit(0))
    rows = own.select(F.lit(1).alias("band"), (F.element_at(base, F.col("p")) + F.col("k")).cast("long").alias("row"), F.transform(F.split(F.trim("value"), r"\s+"), lambda v: F.when(v.try_cast("double") != none, v.try_cast("double"))).alias("values"))
    return explode_rows(rows), RasterMeta(int(h["ncols"]), n_rows, x0, low + n_rows * size, size, size)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Height-tile files below ``path`` ({zoom}/{x}/{y}.terrain): key and file bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.terrain").load(path)
    key = lambda i: F.regexp_extract("path", r"(\d+)/(-?\d+)/(-?\d+)\.terrain$", i)
    return files.select(key(1).cast("int").alias("zoom"), key(2).cast("long").alias("tx"), key(3).cast("long").alias("ty"), "content")


# ---- rasters derived from the driver's tables (FIXTURES.md) ----

DEM_COLS, DEM_ORIGIN, DEM_PIXEL = 150, (-10.0, 45.0), 0.0625


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elevation raster: col, row, elev_m."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_orderkey") % DEM_COLS).alias("col"), F.expr(f"o_orderkey div {DEM_COLS}").alias("row"), F.floor(F.col("o_totalprice") / 60).cast("long").alias("elev_m"))


def dem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dem(spark, sf_dir).select(F.lit(1).alias("band"), "col", "row", F.col("elev_m").alias("value"))


def dem_meta(spark: SparkSession, sf_dir: str) -> RasterMeta:
    top = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).collect()[0][0]
    rows = (top // DEM_COLS + 1) if top is not None else 0
    return RasterMeta(min(DEM_COLS, (top or 0) + 1), rows, *DEM_ORIGIN, DEM_PIXEL, DEM_PIXEL)


def dem2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bands: elevation and customer key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cell = [(F.col("o_orderkey") % DEM_COLS).alias("col"), F.expr(f"o_orderkey div {DEM_COLS}").alias("row")]
    bands = F.explode(F.array(F.struct(F.lit(1).alias("band"), F.floor(F.col("o_totalprice") / 60).cast("long").alias("value")), F.struct(F.lit(2).alias("band"), F.col("o_custkey").alias("value"))))
    return o.select(*cell, bands.alias("b")).select("b.band", "col", "row", "b.value")
