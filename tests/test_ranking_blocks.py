"""Mode and quartiles ranked in blocks of cells."""

import pytest

from tilespark.functions import grid as G
from tilespark.operators import resample as R
from tilespark.sources import rasters as S


@pytest.mark.parametrize("grid", [G.global_geodetic(), G.global_mercator()])
def test_blocks_give_the_cells_of_the_counts(spark, sf_dir, monkeypatch, grid):
    meta, px = S.dem_meta(spark, sf_dir), S.dem_pixels(spark, sf_dir)
    for method, pixels in (("q3", 1 << 14), ("mode", 50)):
        monkeypatch.setattr(R, "BLOCK_PIXELS", pixels)  # the smaller one leaves coarse zooms to the counts
        zooms = list(range(meta.max_zoom(grid) + 1))
        got = R.area(px, meta, grid, zooms, method, terrain=False)
        want = R._ranked(R._spread(px, meta, grid, zooms, False, "value"), method).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        if pixels > 50:
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # counts aren't joined with their totals
