"""Paths, files, GeoJSON and text for tiles.

Files are written by the tasks under temporary names and renamed, through a file
system that all executors reach.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import bounds as B
from tilespark.functions import codec
from tilespark.functions.grid import Grid
from tilespark.session import open_store, ship


def tile_path(zoom: Column, tx: Column, ty: Column, extension: str = "terrain") -> Column:
    return F.concat_ws("/", zoom.cast("string"), tx.cast("string"), F.concat(ty.cast("string"), F.lit("." + extension)))


def resume(tiles: DataFrame, existing_paths: DataFrame, extension: str = "terrain") -> DataFrame:
    """Tiles whose file isn't listed yet (column ``path``)."""
    named = tiles.withColumn("path", tile_path(F.col("zoom"), F.col("tx"), F.col("ty"), extension))
    return named.join(existing_paths.select("path"), "path", "left_anti")


def geotransform(grid: Grid, zoom: Column, tx: Column, ty: Column) -> list[Column]:
    """gt0..gt5 of a raster tile."""
    minx, _, _, maxy = grid.tile_bounds(tx, ty, zoom)
    res = grid.resolution(zoom)
    return [minx, res, F.lit(0.0), maxy, F.lit(0.0), -res]


def terrain_geotransform(grid: Grid, zoom: Column, tx: Column, ty: Column) -> list[Column]:
    """gt0..gt5 of a height tile, labelled by the plain tile bounds."""
    minx, _, maxx, maxy = grid.tile_bounds(tx, ty, zoom)
    res = (maxx - minx) / float(grid.tile_size - 1)
    return [minx, res, F.lit(0.0), maxy, F.lit(0.0), -res]


def feature(grid: Grid, zoom: Column, tx: Column, ty: Column) -> Column:
    """A tile's outline as a GeoJSON feature; the ring runs LL, LR, UR, UL, LL."""
    c = B.corners(grid.tile_bounds(tx, ty, zoom))
    ring = [v for k in ("ll", "lr", "ur", "ul", "ll") for v in c[k]]
    points = ", ".join(["[%.15e, %.15e]"] * 5)
    text = '{ "type": "Feature", "geometry": { "type": "Polygon", "coordinates": [[' + points + ']]}, "properties": {"tx": %d, "ty": %d}}'
    return F.format_string(text, *ring, tx, ty)


def feature_collections(features: DataFrame) -> DataFrame:
    """One FeatureCollection a zoom (columns zoom, tx, ty, feature).

    A level's text is one value, so this is for levels that fit one row; larger
    levels go through :func:`write_geojson`, a feature a line.
    """
    rows = features.groupBy("zoom").agg(F.array_sort(F.collect_list(F.struct("tx", "ty", "feature"))).alias("f"))
    return rows.select("zoom", F.concat(F.lit('{ "type": "FeatureCollection", "features": [\n'), F.array_join(F.col("f.feature"), ",\n"), F.lit("]}\n")).alias("geojson"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features in a folder per zoom."""
    features.select("zoom", F.col("feature").alias("value")).write.partitionBy("zoom").text(path)


def info(heights: Column, children: Column, mask: Column, show_heights: bool = False, show_children: bool = True, show_type: bool = True) -> Column:
    """A tile as text: heights 65 a line, which children there are, what covers it."""
    parts = []
    if show_heights:
        lines = F.transform(F.sequence(F.lit(0), F.lit(codec.SIDE - 1)), lambda i: F.array_join(F.slice(heights, i * codec.SIDE + 1, codec.SIDE).cast("array<string>"), " "))
        parts.append(F.concat(F.lit("Heights:\n"), F.array_join(lines, "\n")))
    if show_children:
        named = F.concat_ws(" ", *(F.when(codec.has_child(children, k), F.lit(k.upper())) for k in ("sw", "se", "nw", "ne")))
        parts.append(F.when(codec.has_children(children), F.concat(F.lit("Child tiles: "), named)).otherwise(F.lit(" None")))
    if show_type:
        kind = F.when(codec.has_water_mask(mask), "water mask").when(codec.is_land(mask), "all land").when(codec.is_water(mask), "all water").otherwise("unknown")
        parts.append(F.concat(F.lit("Tile type: "), kind))
    return F.concat_ws("\n", *parts)


def write_files(files: DataFrame, target: str) -> DataFrame:
    """Write (path, content) rows below the URI ``target``; returns path and size, so writing that commits.

    A file appears under its name only when it is whole, and repeated tasks write the same bytes.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(target)
        made: set = set()
        for b in batches:
            paths, sizes = b.column(0).to_pylist(), []
            for path, content in zip(paths, b.column(1).to_pylist()):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                temp = f"{base}/{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(temp, compression=None) as out:
                    out.write(content)
                store.move(temp, f"{base}/{path}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size long")


def write_raster_tiles(tiles: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Raster tiles through any of Spark's writers, a folder per zoom."""
    if fmt not in ("parquet", "orc", "json", "avro"):
        raise ValueError(f"unsupported raster tile format: {fmt}")
    tiles.write.partitionBy("zoom").format(fmt).options(**options).save(path)
