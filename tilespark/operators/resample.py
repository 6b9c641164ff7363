"""Resampling pixels onto the lattice that all tiles of a zoom share.

At zoom z the cells of all tiles form one lattice of pitch P(z). A pixel is
listed in the cells it overlaps, and one partially aggregated group-by gives every
cell of every zoom: no tile reads the raster on its own and no range join is
needed. Sampling methods go the other way, from cell centres to the pixels
around them, in blocks of pixels.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions.grid import Grid, project_axes, reproject
from tilespark.session import ship
from tilespark.sources.rasters import RasterMeta

#: Overlap, in cells, that counts as none between reprojected pixels and cells.
SLIVER = 1e-9
AREA = ("average", "mode", "max", "min", "med", "q1", "q3")
POINT = ("nearest", "bilinear", "cubic", "cubicspline", "lanczos")


def check(method: str) -> str:
    if method not in AREA + POINT:
        raise ValueError(f"unknown resampling method: {method}")
    return method


def pitch(grid: Grid, zoom: int, terrain: bool = True) -> float:
    """Cell size: a tile is ``tile_size - 1`` cells wide for heights, ``tile_size`` for rasters."""
    cells = grid.tile_size - 1 if terrain else grid.tile_size
    return grid.width / grid.root_tiles / cells / 2.0**zoom


def _zooms(grid, zooms, terrain) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(z).alias("zoom"), F.lit(pitch(grid, z, terrain)).alias("p")) for z in zooms)))


def _spread(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int], terrain: bool, value: str, block: int | None = None) -> DataFrame:
    """A row for every pixel, zoom and overlapped cell: band, zoom, gx, gy, v.

    With ``block``, a zoom no finer than any of ``zooms``, pixels are dealt by its cells first, and
    (bx, by) say which: cells nest, so all rows of a cell are in one partition.
    """
    x = lambda c: F.lit(meta.x0) + c * F.lit(meta.dx)
    y = lambda r: F.lit(meta.y0) - r * F.lit(meta.dy)
    west, south = reproject(meta.epsg, grid.epsg, x(F.col("col")), y(F.col("row") + 1))
    east, north = reproject(meta.epsg, grid.epsg, x(F.col("col") + 1), y(F.col("row")))
    band = F.col("band") if "band" in pixels.columns else F.lit(1)
    own = pixels.filter(F.col(value).isNotNull()).select(band.alias("band"), F.col(value).alias("v"), west.alias("w"), south.alias("s"), east.alias("e"), north.alias("n"), F.lit(0).alias("bx"), F.lit(0).alias("by"))
    if meta.requires_reprojection(grid):
        own = own.filter(F.col("s").isNotNull() & F.col("n").isNotNull())  # pixels at or beyond a pole have no place on the plane
    slack = SLIVER if meta.requires_reprojection(grid) else 0.0  # edges that fall on cell borders only up to rounding

    if block is not None:
        size = pitch(grid, block, terrain)

        def blocks(lo, hi, half):  # every block that a cell of the pixel at any zoom lies in
            first, last = (F.floor((lo + half) / size + s).cast("long") for s in (0.0, slack))
            return F.explode(F.sequence(first, F.greatest(first, last, (F.ceil((hi + half) / size) - 1).cast("long"))))

        own = own.withColumn("bx", blocks(F.col("w"), F.col("e"), grid.half_x)).withColumn("by", blocks(F.col("s"), F.col("n"), grid.half_y))
        own = own.repartition(min(10_000, 1 + meta.n_cols * meta.n_rows * meta.n_bands // 100_000), "bx", "by")
    own = own.withColumn("z", _zooms(grid, zooms, terrain))
    inside = lambda rows, g, b: rows if block is None else rows.filter(F.floor(F.col(g) / F.pow(F.lit(2.0), F.col("zoom") - block)).cast("long") == F.col(b))

    def cell(lo, hi, half, p="z.p"):
        first, last = F.floor((lo + half) / F.col(p) + slack).cast("long"), (F.ceil((hi + half) / F.col(p) - slack) - 1).cast("long")
        return F.sequence(first, F.greatest(first, last) if slack else last)

    keep = [] if block is None else ["bx", "by"]
    gx = inside(own.select("band", "v", "s", "n", *keep, F.col("z.zoom").alias("zoom"), F.col("z.p").alias("p"), F.explode(cell(F.col("w"), F.col("e"), F.lit(grid.half_x))).alias("gx")), "gx", "bx")
    return inside(gx.select("band", "v", "zoom", "gx", *keep, F.explode(cell(F.col("s"), F.col("n"), F.lit(grid.half_y), "p")).alias("gy")), "gy", "by")


def _ranked(spread: DataFrame, method: str) -> DataFrame:
    """Mode and quartiles from counts of each value in a cell, so no task holds a cell's pixels."""
    cell = ["band", "zoom", "gx", "gy"]
    counted = spread.groupBy(*cell, "v").agg(F.count(F.lit(1)).alias("c"))
    if method == "mode":
        return counted.groupBy(*cell).agg(F.sum("c").alias("n"), F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
    quarters = {"q1": 1, "med": 2, "q3": 3}[method]
    upto = Window.partitionBy(*cell).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumn("upto", F.sum("c").over(upto))
    totals = counted.groupBy(*cell).agg(F.sum("c").alias("n"))
    enough = running.join(totals, cell).filter(4 * F.col("upto") >= quarters * F.col("n"))
    return enough.groupBy(*cell).agg(F.first("n").alias("n"), F.min("v").alias("v"))


#: Pixels that a block of cells may overlap in the ranking of values.
BLOCK_PIXELS = 1 << 14


def _block_zoom(meta: RasterMeta, grid: Grid, terrain: bool) -> int:
    """The coarsest zoom, maybe below 0, whose cells overlap at most ``BLOCK_PIXELS`` pixels."""
    side = meta.resolution_on(grid) * math.sqrt(meta.dy / meta.dx)
    return math.ceil(math.log2(pitch(grid, 0, terrain) / side / math.sqrt(BLOCK_PIXELS)))


def _ranked_in_blocks(spread: DataFrame, method: str) -> DataFrame:
    """Mode and quartiles of cells whose rows (with ``bx``, ``by``) lie in one partition: no cell is shuffled."""
    cell = ["gy", "gx", "zoom", "band", "by", "bx"]  # sorted by what differs most
    if method == "mode":
        counted = spread.groupBy(*cell, "v").agg(F.count(F.lit(1)).alias("c"))
        return counted.groupBy(*cell).agg(F.sum("c").alias("n"), F.max_by("v", F.struct("c", -F.col("v"))).alias("v")).drop("bx", "by")
    quarters = {"q1": 1, "med": 2, "q3": 3}[method]
    ranks = Window.partitionBy(*cell).orderBy("v")
    n = F.count(F.lit(1)).over(ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = spread.select(*cell, "v", F.row_number().over(ranks).cast("long").alias("k"), n.alias("n"))
    return ranked.filter(F.col("k") == F.floor((quarters * F.col("n") + 3) / 4)).select("band", "zoom", "gx", "gy", "n", "v")


def area(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int], method: str = "average", terrain: bool = True, value: str = "value", only=None, pyramid: bool = False) -> DataFrame:
    """Cells (band, zoom, gx, gy, n, v) by an aggregate of the pixels that overlap each; nulls don't count.

    ``only`` filters the rows (zoom, gx, gy) before anything is aggregated. ``pyramid`` reads
    the pixels for the finest zoom alone and makes each coarser one from the one above: exact for
    extremes, near for the average, not offered for the others.
    """
    check(method)
    if pyramid and method not in ("average", "max", "min"):
        raise ValueError(f"no pyramid for {method}")
    zooms = sorted(zooms, reverse=True)
    spread = _spread(pixels, meta, grid, zooms[:1] if pyramid else zooms, terrain, value)
    spread = spread if only is None or pyramid else only(spread)
    grouped = spread.groupBy("band", "zoom", "gx", "gy")
    if pyramid:
        level = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        levels = level
        for zoom in range(zooms[0] - 1, zooms[-1] - 1, -1):
            level = rollup(level)
            levels = levels.unionByName(level) if zoom in zooms else levels
        v = {"average": F.col("s") / F.col("n"), "max": F.col("hi"), "min": F.col("lo")}[method]
        out = levels.select("band", "zoom", "gx", "gy", "n", v.alias("v"))
        return out if only is None else only(out)
    if method == "average":
        return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).select("band", "zoom", "gx", "gy", "n", (F.col("s") / F.col("n")).alias("v"))
    if method in ("max", "min"):
        return grouped.agg(F.count(F.lit(1)).alias("n"), getattr(F, method)("v").alias("v"))
    block = _block_zoom(meta, grid, terrain)
    near, far = [z for z in zooms if z >= block], [z for z in zooms if z < block]
    parts = []
    if near:
        own = _spread(pixels, meta, grid, near, terrain, value, block)
        parts.append(_ranked_in_blocks(own if only is None else only(own), method))
    if far:  # cells of more pixels than a block
        own = _spread(pixels, meta, grid, far, terrain, value)
        parts.append(_ranked(own if only is None else only(own), method))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rollup(cells: DataFrame) -> DataFrame:
    """The next coarser level from (n, s, lo, hi) sums: exact for extremes, an approximation for means."""
    half = lambda c: F.floor(F.col(c) / 2).cast("long").alias(c)
    return cells.select("band", (F.col("zoom") - 1).alias("zoom"), half("gx"), half("gy"), "n", "s", "lo", "hi").groupBy("band", "zoom", "gx", "gy").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _weight(method: str, t: np.ndarray) -> np.ndarray:
    a = np.abs(t)
    if method == "bilinear":
        return np.maximum(0.0, 1 - a)
    if method == "cubic":
        return np.where(a <= 1, (1.5 * a - 2.5) * a * a + 1, np.where(a < 2, ((-0.5 * a + 2.5) * a - 4) * a + 2, 0.0))
    if method == "cubicspline":
        return np.where(a <= 1, 2 / 3 - a * a + a * a * a / 2, np.where(a < 2, (2 - a) * (2 - a) * (2 - a) / 6, 0.0))
    p = np.where(a < 1e-12, 1.0, t) * math.pi
    sin = lambda x: np.fromiter(map(math.sin, x), float, len(x))  # noqa: E731 - the C library's; NumPy's own differs in the last bit
    return np.where(a < 1e-12, 1.0, np.where(a < 3, sin(p) / p * sin(p / 3) / (p / 3), 0.0))


#: First and last pixel of a kernel, from the one at or before the centre.
REACH = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2), "cubicspline": (-1, 2), "lanczos": (-2, 3)}
#: Pixels on a side of the blocks in which centres are sampled, and cells that are sampled at once.
BLOCK, AT_ONCE = 256, 1 << 16


def _blocks(batches):
    """(key, table) for each run of rows with the same first three columns."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(start, end - start))
    if held:
        yield last, pa.Table.from_batches(held)


def _axis(meta: RasterMeta, grid: Grid, level: tuple, block: int, method: str, vertical: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lattice numbers whose centre lies in a block's columns (or rows), and the centres in pixels."""
    _, p, x0, x1, y0, y1 = level
    first, last, half, n = (y0, y1, grid.half_y, meta.n_rows) if vertical else (x0, x1, grid.half_x, meta.n_cols)
    edges = np.array([block * BLOCK - 1.0, (block + 1) * BLOCK + 1.0])
    place = meta.y0 - edges * meta.dy if vertical else meta.x0 + edges * meta.dx
    if vertical and (meta.epsg, grid.epsg) == (4326, 3857):
        place = np.clip(place, -90 + 1e-9, 90 - 1e-9)
    place = np.sort(project_axes(meta.epsg, grid.epsg, place, place)[vertical])
    low, high = (np.floor((place + half) / p) + (-1, 1)).tolist()
    g = np.arange(max(first, low), min(last, high) + 1).astype(np.int64)
    centre = -half + (g + 0.5) * p
    at = project_axes(grid.epsg, meta.epsg, centre, centre)[vertical]
    at = (meta.y0 - at) / meta.dy - 0.5 if vertical else (at - meta.x0) / meta.dx - 0.5
    own = np.maximum(np.floor(at + 0.5 if method == "nearest" else at), 0) // BLOCK == block
    own &= (at >= -0.5) & (at < n - 0.5)
    return g[own], at[own]


def _sample(meta: RasterMeta, grid: Grid, levels: list, method: str, bx: int, by: int, col: np.ndarray, row: np.ndarray, value: pa.Array):
    """Cells (zoom, gx, gy, v) whose centres lie in a block, from its pixels and their rim; v is an Arrow array."""
    lo, hi = REACH[method]
    left, top, side = bx * BLOCK - 1 + lo, by * BLOCK - 1 + lo, BLOCK + 1 + hi - lo
    col, row = col - left, row - top
    place = np.where((col >= 0) & (col < side) & (row >= 0) & (row < side), row * side + col, side * side)  # the last place is nobody's
    counts = np.bincount(place, minlength=side * side + 1)[:-1]
    if method == "nearest":
        order, starts = np.argsort(place, kind="stable"), np.cumsum(counts) - counts
    else:
        there = counts.reshape(side, side).astype(float)
        sums = np.bincount(place, value.to_numpy(zero_copy_only=False), side * side + 1)[:-1].reshape(side, side)

    def weighted(u, v):  # sums of weight times value, and of weights, for the centres of rows v and columns u
        c, r = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        s, w = np.zeros((len(v), len(u))), np.zeros((len(v), len(u)))
        for i in range(lo, hi + 1):
            wx, wide, wide_there = _weight(method, u - (c + i)), sums[:, c + i - left], there[:, c + i - left]
            for j in range(lo, hi + 1):
                own = wx * _weight(method, v - (r + j))[:, None]
                s += own * wide[r + j - top]
                w += own * wide_there[r + j - top]
        return s.ravel(), w.ravel()

    for level in levels:
        (gx, u), (gy, v) = (_axis(meta, grid, level, b, method, vertical) for b, vertical in ((bx, False), (by, True)))
        for i in range(0, len(gx), AT_ONCE):
            x, ux = gx[i : i + AT_ONCE], u[i : i + AT_ONCE]
            step = max(1, AT_ONCE // len(x))
            for j in range(0, len(gy), step):
                y, vy = gy[j : j + step], v[j : j + step]
                xs, ys = np.tile(x, len(y)), np.repeat(y, len(x))
                if method == "nearest":
                    c, r = np.floor(ux + 0.5).astype(np.int64) - left, np.floor(vy + 0.5).astype(np.int64) - top
                    at = (r[:, None] * side + c).ravel()
                    n = counts[at]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield level[0], np.repeat(xs, n), np.repeat(ys, n), value.take(pa.array(order[np.repeat(starts[at], n) + nth]))
                else:
                    s, w = weighted(ux, vy)
                    some = np.abs(w) > 1e-12
                    yield level[0], xs[some], ys[some], pa.array(s[some] / w[some])


def point(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int], method: str = "nearest", terrain: bool = True, value: str = "value", only=None) -> DataFrame:
    """Cells (band, zoom, gx, gy, v) sampled at their centres; weights are renewed over the pixels there are.

    Centres are carried into the raster's reference system where it differs from the grid's.
    Pixels are dealt in square blocks with the rim that the kernel needs; a task holds one
    block at a time and lists the centres in it by arithmetic, so cells are neither joined nor shuffled.
    """
    check(method)
    spark = pixels.sparkSession
    ship(spark)
    minx, miny, maxx, maxy = meta.bounds_on(grid)
    levels = []
    for z in zooms:
        p = pitch(grid, z, terrain)
        fx = lambda x: int((x + grid.half_x) // p)  # noqa: E731, B023
        fy = lambda y: int((y + grid.half_y) // p)  # noqa: E731, B023
        levels.append((z, p, fx(minx), fx(maxx), fy(miny), fy(maxy)))
    lo, hi = REACH[method]

    def blocks(c, n):
        block = lambda v: F.floor(F.greatest(v, F.lit(0)) / BLOCK).cast("long")
        first, last = block(F.col(c) - hi), F.least(block(F.col(c) - lo), F.lit(max(0, n - 1) // BLOCK))
        return F.explode(F.sequence(first, F.greatest(first, last)))

    band = F.col("band") if "band" in pixels.columns else F.lit(1)
    v = F.col(value) if method == "nearest" else F.col(value).cast("double")
    source = pixels.filter(F.col(value).isNotNull()).select(band.alias("band"), F.col("col").cast("long"), F.col("row").cast("long"), v.alias("v"))
    source = source.withColumn("bx", blocks("col", meta.n_cols)).withColumn("by", blocks("row", meta.n_rows)).select("band", "bx", "by", "col", "row", "v")
    n = meta.n_bands * (1 + meta.n_cols // BLOCK) * (1 + meta.n_rows // BLOCK)
    dealt = source.repartition(min(n, max(512, n // 64)), "band", "bx", "by").sortWithinPartitions("band", "bx", "by")
    types = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for (band, bx, by), t in _blocks(batches):
                t = t.combine_chunks()
                col, row = (t.column(i).to_numpy() for i in (3, 4))
                values = t.column(5).chunk(0)
                for zoom, gx, gy, v in _sample(meta, grid, levels, method, int(bx), int(by), col, row, values):
                    if len(gx):
                        bands = pa.array([band]).cast(t.column(0).type).take(pa.array(np.zeros(len(gx), np.int64)))
                        yield pa.RecordBatch.from_arrays([bands, pa.array(np.full(len(gx), zoom, np.int32)), pa.array(gx), pa.array(gy), v], names=["band", "zoom", "gx", "gy", "v"])

    out = dealt.mapInArrow(run, f"band {types['band']}, zoom int, gx long, gy long, v {types['v']}")
    return out if only is None else only(out)


def resample(pixels: DataFrame, meta: RasterMeta, grid: Grid, zooms: list[int], method: str = "average", **options) -> DataFrame:
    return (area if check(method) in AREA else point)(pixels, meta, grid, zooms, method, **options)
