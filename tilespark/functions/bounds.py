"""Algebra of bounding boxes given as four columns (minx, miny, maxx, maxy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def of(prefix: str = "") -> Box:
    """The box in columns ``prefix`` + minx, miny, maxx, maxy."""
    return tuple(F.col(prefix + c) for c in ("minx", "miny", "maxx", "maxy"))


def is_valid(b: Box) -> Column:
    return (b[0] <= b[2]) & (b[1] <= b[3])


def checked(b: Box) -> Box:
    """The box, or an error when a minimum exceeds its maximum."""
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    x = F.when(b[0] <= b[2], b[0].cast("double")).otherwise(fail("the minimum X value is greater than the maximum"))
    y = F.when(b[1] <= b[3], b[1].cast("double")).otherwise(fail("the minimum Y value is greater than the maximum"))
    return x, y, b[2], b[3]


def corners(b: Box) -> dict[str, tuple[Column, Column]]:
    return {"ll": (b[0], b[1]), "lr": (b[2], b[1]), "ur": (b[2], b[3]), "ul": (b[0], b[3])}


def size(b: Box) -> tuple[Column, Column]:
    return b[2] - b[0], b[3] - b[1]


def quadrants(b: Box, whole: bool = False) -> dict[str, Box]:
    """The four quarters; ``whole`` halves integer boxes downwards."""
    w, h = size(b)
    half = (lambda v: F.floor(v / 2)) if whole else (lambda v: v / 2)
    mx, my = b[0] + half(w), b[1] + half(h)
    return {"sw": (b[0], b[1], mx, my), "se": (mx, b[1], b[2], my), "nw": (b[0], my, mx, b[3]), "ne": (mx, my, b[2], b[3])}


def overlaps(a: Box, b: Box) -> Column:
    """Strict: boxes that only touch don't overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float) -> DataFrame:
    """Pairs of ids whose boxes overlap, by cells of a coarse grid instead of a theta join.

    Both sides name their box minx..maxy. Every box is listed in the cells it
    touches; a pair that meets in several is taken only in the first of them, so
    no distinct is needed. ``cell`` should be near the usual size of a box.
    """

    def spread(df, name, out):
        b = of()
        cells = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
        own = df.filter(is_valid(b)).select(F.col(name).alias(out), *(c.alias(f"{out}_{k}") for c, k in zip(b, ("minx", "miny", "maxx", "maxy"))), cells(b[0], b[2]).alias("xs"), cells(b[1], b[3]).alias("ys"))
        return own.withColumn("cx", F.explode("xs")).withColumn("cy", F.explode("ys")).drop("xs", "ys")

    a, b = spread(left, left_id, "a_id"), spread(right, right_id, "b_id")
    met = a.join(b, ["cx", "cy"]).filter(overlaps(of("a_id_"), of("b_id_")))
    first = lambda k: F.floor(F.greatest(F.col(f"a_id_min{k}"), F.col(f"b_id_min{k}")) / cell).cast("long")
    return met.filter((F.col("cx") == first("x")) & (F.col("cy") == first("y"))).select("a_id", "b_id")
