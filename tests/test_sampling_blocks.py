"""Centres sampled in blocks of pixels: the rims between blocks, gaps, bands and repeated pixels."""

import math

import pytest
from pyspark.sql import functions as F

from tilespark.functions import grid as G
from tilespark.operators import resample as R
from tilespark.sources import rasters as S

GEO = G.global_geodetic()


@pytest.mark.parametrize("method", ["nearest", "lanczos"])
def test_blocks_against_brute_force(spark, method):
    cols, rows = R.BLOCK + 9, 7
    meta = S.RasterMeta(cols, rows, -1.0, 10.0, 0.0625, 0.0625)
    px = spark.range(cols * rows).filter("id % 11 <> 3").select(F.lit(1).alias("band"), (F.col("id") % cols).alias("col"), F.expr(f"id div {cols}").alias("row"), (F.col("id") * 37 % 1000).alias("value"))
    values = {(r["col"], r["row"]): r["value"] for r in px.collect()}
    found = R.point(px, meta, GEO, [6], method)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # cells are neither joined nor broadcast
    p, want = R.pitch(GEO, 6), {}
    lobe = lambda t: 1.0 if abs(t) < 1e-12 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3)
    for gx in range(int(179 / p) - 1, int((179 + cols / 16) / p) + 2):
        for gy in range(int((100 - rows / 16) / p) - 1, int(100 / p) + 2):
            u, v = (-180 + (gx + 0.5) * p + 1.0) / 0.0625 - 0.5, (10.0 - (-90 + (gy + 0.5) * p)) / 0.0625 - 0.5
            if not (-0.5 <= u < cols - 0.5 and -0.5 <= v < rows - 0.5):
                continue
            if method == "nearest":
                near = [(values.get((math.floor(u + 0.5), math.floor(v + 0.5))), 1.0)]
            else:
                near = [(values.get((c, r)), lobe(u - c) * lobe(v - r)) for c in range(math.floor(u) - 2, math.floor(u) + 4) for r in range(math.floor(v) - 2, math.floor(v) + 4)]
            near = [(x, w) for x, w in near if x is not None]
            if near:
                want[gx, gy] = sum(x * w for x, w in near) / sum(w for _, w in near)
    got = {(r["gx"], r["gy"]): r["v"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    twice = px.union(px.withColumn("band", F.lit(2)).withColumn("value", F.col("value") + 1))
    many = {(r["band"], r["gx"], r["gy"]): r["v"] for r in R.point(twice, meta, GEO, [6], method).collect()}
    assert len(many) == 2 * len(want) and all(many[2, *k] == pytest.approx(want[k] + 1, abs=1e-6) for k in want)
    assert method != "nearest" or R.point(px.union(px), meta, GEO, [6]).count() == 2 * len(want)
