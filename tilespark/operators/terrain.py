"""Height tiles and raster tiles from lattice cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import bounds as B
from tilespark.functions import codec
from tilespark.functions.grid import Grid
from tilespark.operators import enumerate as E
from tilespark.operators import resample as R
from tilespark.session import ship
from tilespark.sources.rasters import RasterMeta


def children(grid: Grid, meta: RasterMeta, zoom: Column, tx: Column, ty: Column) -> Column:
    """Bitmask of quarters that overlap the raster; 0 at the raster's finest zoom."""
    box = grid.tile_bounds(tx, ty, zoom)
    whole = tuple(F.lit(v) for v in meta.bounds_on(grid))
    q = B.quadrants(box)
    bits = sum((F.when(B.overlaps(q[k], whole), F.lit(bit)).otherwise(F.lit(0)) for k, bit in codec.FLAGS.items()), F.lit(0))
    return F.when(zoom == meta.max_zoom(grid), F.lit(0)).otherwise(bits).cast("int")


def border_members(cells: DataFrame, side: int = 64) -> DataFrame:
    """Each lattice cell with all height tiles it belongs to (at most four): zoom, tx, ty, r, k.

    Besides its own tile a cell in the last column is the west border of the next
    tile, one in the first row the north border of the tile below. The lists are
    never empty; the outer form keeps the optimizer from testing that on every pixel
    below the aggregate.
    """
    own_x = F.floor(F.col("gx") / side).cast("long")
    own_y = F.floor(F.col("gy") / side).cast("long")
    kx, ky = F.pmod(F.col("gx"), F.lit(side)), F.pmod(F.col("gy"), F.lit(side))
    place = lambda t, i: F.struct(t.cast("long").alias("t"), i.cast("int").alias("i"))
    xs = F.when(kx == side - 1, F.array(place(own_x, kx + 1), place(own_x + 1, F.lit(0)))).otherwise(F.array(place(own_x, kx + 1)))
    ys = F.when(ky == 0, F.array(place(own_y, side - ky), place(own_y - 1, F.lit(0)))).otherwise(F.array(place(own_y, side - ky)))
    rest = [c for c in cells.columns if c not in ("gx", "gy")]
    out = cells.select(*rest, xs.alias("xs"), ys.alias("ys")).withColumn("x", F.explode_outer("xs")).withColumn("y", F.explode_outer("ys"))
    return out.select(*rest, F.col("x.t").alias("tx"), F.col("y.t").alias("ty"), F.col("y.i").alias("r"), F.col("x.i").alias("k"))


def plain_members(cells: DataFrame, size: int) -> DataFrame:
    """Lattice cells with their raster tile: row 0 is the northernmost."""
    rest = [c for c in cells.columns if c not in ("gx", "gy")]
    fl = lambda c: F.floor(F.col(c) / size).cast("long")
    return cells.select(*rest, fl("gx").alias("tx"), fl("gy").alias("ty"), (size - 1 - F.pmod("gy", F.lit(size))).cast("int").alias("r"), F.pmod("gx", F.lit(size)).cast("int").alias("k"))


#: Missing tiles that may be broadcast (24 bytes each, for four owners).
BROADCAST_KEYS = 500_000


def missing_cells(keys: DataFrame, n: int, side: int = codec.SIDE - 1):
    """A filter of lattice rows (zoom, gx, gy): those whose own tile, or one that borrows its border from it, is in ``keys``."""
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, -1) for j in (0, 1))))
    owners = keys.select("zoom", "tx", "ty", around.alias("a")).select(F.col("zoom").alias("_z"), (F.col("tx") + F.col("a.i")).alias("_x"), (F.col("ty") + F.col("a.j")).alias("_y")).distinct()
    owners = F.broadcast(owners) if n <= BROADCAST_KEYS else owners
    own = lambda c: F.floor(F.col(c) / side).cast("long")
    return lambda rows: rows.join(owners, (F.col("zoom") == F.col("_z")) & (own("gx") == F.col("_x")) & (own("gy") == F.col("_y")), "left_semi")


def terrain_tiles(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int] | None = None, method: str = "average", value: str = "value", existing: DataFrame | None = None, pyramid: bool = False) -> DataFrame:
    """Height tiles: zoom, tx, ty, children, n_cells, h_sum, height_bytes.

    ``existing`` (zoom, tx, ty) resumes a build: those tiles are taken away from
    the keys, zooms without missing tiles aren't looked at, and of the others only cells
    of missing tiles are aggregated. ``pyramid`` is that of :func:`resample.area`.
    """
    if grid.tile_size != codec.SIDE:
        raise ValueError("height tiles need a tile size of 65")
    spark = pixels.sparkSession
    ship(spark)
    top = meta.max_zoom(grid)
    zooms = sorted(zooms if zooms is not None else range(top + 1), reverse=True)
    levels = E.ranges(spark, {z: meta.tile_range(grid, z) for z in zooms})
    keys = E.keys(levels)
    first = pixels.filter("band = 1") if "band" in pixels.columns else pixels
    options = {"value": value}
    if existing is not None:
        keys = keys.join(existing.select("zoom", "tx", "ty"), ["zoom", "tx", "ty"], "left_anti")
        missing = {r["zoom"]: r["n"] for r in keys.groupBy("zoom").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each zoom
        options["only"] = missing_cells(keys, sum(missing.values()))
        if not pyramid:
            zooms = [z for z in zooms if z in missing] or zooms[-1:]
        if not missing:
            first = first.filter(F.lit(False))
    if pyramid:
        options["pyramid"] = True
    cells = R.resample(first, meta, grid, zooms, method, **options)
    coded = cells.select("zoom", "gx", "gy", codec.quantise(F.col("v")).alias("h"))
    members = border_members(coded)
    tiles = members.groupBy("zoom", "tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"), F.collect_list(F.struct((F.col("r") * codec.SIDE + F.col("k")).alias("i"), "h")).alias("c"))  # at most 4225 cells a tile
    out = keys.join(tiles, ["zoom", "tx", "ty"], "left")
    none = F.array().cast("array<int>")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(
        "zoom", "tx", "ty",
        children(grid, meta, F.col("zoom"), F.col("tx"), F.col("ty")).alias("children"),
        n.alias("n_cells"),
        (F.coalesce("s", F.lit(0)) + (codec.CELLS - n) * codec.SEA_LEVEL).cast("long").alias("h_sum"),
        codec.pack_cells(F.coalesce(F.col("c.i"), none), F.coalesce(F.col("c.h"), none)).alias("height_bytes"),
    )


def raster_tiles(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int], method: str = "average", value: str = "value") -> DataFrame:
    """Raster tiles of all bands as rows of covered cells: zoom, tx, ty, band, cells (r, k, v)."""
    cells = R.resample(pixels, meta, grid, zooms, method, terrain=False, value=value)
    members = plain_members(cells.select("band", "zoom", "gx", "gy", "v"), grid.tile_size)
    return members.groupBy("zoom", "tx", "ty", "band").agg(F.array_sort(F.collect_list(F.struct("r", "k", "v"))).alias("cells"))  # at most tile_size squared


def export_cells(tiles: DataFrame, grid: Grid) -> DataFrame:
    """Georeferenced cells of decoded tiles: x, y of each cell's corner, the raw code as signed 16 bits, metres."""
    res, minx, _, _, maxy = grid.terrain_tile_bounds(F.col("tx"), F.col("ty"), F.col("zoom"))
    own = tiles.select("zoom", "tx", "ty", res.alias("res"), minx.alias("minx"), maxy.alias("maxy"), F.posexplode("heights").alias("i", "h"))
    r, k = F.expr(f"CAST(i div {codec.SIDE} AS INT)"), F.expr(f"i % {codec.SIDE}")
    raw = F.when(F.col("h") >= 32768, F.col("h") - 65536).otherwise(F.col("h"))
    return own.select("zoom", "tx", "ty", r.alias("r"), k.alias("k"), (F.col("minx") + k * F.col("res")).alias("x"), (F.col("maxy") - r * F.col("res")).alias("y"), raw.alias("raw_i16"), codec.dequantise(F.col("h")).alias("elev_m"))
