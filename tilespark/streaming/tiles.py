"""Height tiles as a stream: files are decoded as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.plans.build import decode_tiles, tile_info

_FILE = "path string, modificationTime timestamp, length long, content binary"


def tile_stream(spark: SparkSession, path: str) -> DataFrame:
    """Decoded tiles of new ``.terrain`` files below ``path``."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.terrain").load(path)
    key = lambda i: F.regexp_extract("path", r"(\d+)/(-?\d+)/(-?\d+)\.terrain$", i)
    return decode_tiles(files.select(key(1).cast("int").alias("zoom"), key(2).cast("long").alias("tx"), key(3).cast("long").alias("ty"), "content"))


def info_stream(spark: SparkSession, path: str) -> DataFrame:
    return tile_info(tile_stream(spark, path))
