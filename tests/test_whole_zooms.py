"""Registered raster queries cover every zoom of the raster."""

from tilespark.plans.queries import QUERIES


def zooms(spark, sf_dir, name):
    return {r[0] for r in QUERIES[name](spark, sf_dir).select("zoom").distinct().collect()}


def test_export_has_every_tile(spark, sf_dir):
    keys = lambda n: {tuple(r) for r in QUERIES[n](spark, sf_dir).select("zoom", "tx", "ty").distinct().collect()}
    assert max(z for z, _, _ in keys("terrain_tiles")) > 3
    assert keys("terrain_export") == keys("terrain_tiles")


def test_point_kernels_have_every_zoom(spark, sf_dir):
    for name in ("nearest", "bilinear", "cubic", "cubicspline", "lanczos"):
        found = zooms(spark, sf_dir, f"resample_{name}")  # the coarsest cells may have no centre on a small raster
        assert max(found) == max(zooms(spark, sf_dir, "resample_average")) and found == set(range(min(found), max(found) + 1)), name
