"""DuckDB SQL for each registered query, written on its own from the definitions."""

from __future__ import annotations

import math

R0 = 360.0 / 2 / 65
MERC_EDGE = math.pi * 6378137.0
MERC_R0 = 2 * MERC_EDGE / 256
ZOOM_DEM = 6  # ceil(log2(R0 * 16)); far from a whole number

DEM = "dem AS (SELECT o_orderkey % 150 AS col, o_orderkey // 150 AS row, CAST(floor(o_totalprice / 60) AS BIGINT) AS elev_m FROM orders)"
META = "meta AS (SELECT -10.0::DOUBLE AS minx, 45.0::DOUBLE - (max(row) + 1) * 0.0625::DOUBLE AS miny, -10.0::DOUBLE + (max(col) + 1) * 0.0625::DOUBLE AS maxx, 45.0::DOUBLE AS maxy FROM dem)"


def res(z="zoom"):
    return f"({R0!r}::DOUBLE / pow(2.0::DOUBLE, {z}))"


def pix(v, half, z="zoom"):
    return f"CAST(floor(({v} + {half}) / {res(z)}) AS BIGINT)"


LEVELS = f"""{DEM}, {META}, zs AS (SELECT CAST(range AS INTEGER) AS zoom FROM range({ZOOM_DEM + 1})),
lv AS (SELECT zoom, {pix('minx', '180.0::DOUBLE')} // 65 AS x0, {pix('miny', '90.0::DOUBLE')} // 65 AS y0, {pix('maxx', '180.0::DOUBLE')} // 65 AS x1, {pix('maxy', '90.0::DOUBLE')} // 65 AS y1 FROM zs, meta)"""
KEYS = f"""{LEVELS}, kx AS (SELECT zoom, y0, y1, unnest(range(x0, x1 + 1)) AS tx FROM lv), keys AS (SELECT zoom, tx, unnest(range(y0, y1 + 1)) AS ty FROM kx)"""


def box(z="zoom"):
    r = res(z)
    return (f"(tx * 65.0::DOUBLE * {r} - 180.0)", f"(ty * 65.0::DOUBLE * {r} - 90.0)", f"((tx + 1) * 65.0::DOUBLE * {r} - 180.0)", f"((ty + 1) * 65.0::DOUBLE * {r} - 90.0)")


def pitch(z="z.zoom", cells=64):
    return f"({180.0 / cells!r}::DOUBLE / pow(2.0::DOUBLE, {z}))"


def spread(cells=64):
    """A row for each pixel, zoom and cell it overlaps."""
    p = pitch(cells=cells)
    west, east = "(-10.0::DOUBLE + col * 0.0625::DOUBLE)", "(-10.0::DOUBLE + (col + 1) * 0.0625::DOUBLE)"
    south, north = "(45.0::DOUBLE - (row + 1) * 0.0625::DOUBLE)", "(45.0::DOUBLE - row * 0.0625::DOUBLE)"
    cell = lambda lo, hi, half: f"unnest(range(CAST(floor(({lo} + {half}) / {p}) AS BIGINT), CAST(ceil(({hi} + {half}) / {p}) AS BIGINT)))"
    return f"""{LEVELS}, sx AS (SELECT z.zoom, row, elev_m AS v, {cell(west, east, '180.0')} AS gx FROM dem, zs z),
spread AS (SELECT z.zoom, gx, v, {cell(south, north, '90.0')} AS gy FROM sx z)"""


def area(expr):
    return f"WITH {spread()} SELECT zoom, gx, gy, {expr} AS v FROM spread GROUP BY zoom, gx, gy"


MODE = f"""WITH {spread()}, c AS (SELECT zoom, gx, gy, v, count(*) AS n FROM spread GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY zoom, gx, gy ORDER BY n DESC, v) AS k FROM c) SELECT zoom, gx, gy, v FROM r WHERE k = 1"""


def point(method):
    p = pitch("zoom")
    cells = f"""{LEVELS}, pz AS (SELECT zoom, {p} AS p, minx, miny, maxx, maxy FROM zs, meta),
px AS (SELECT zoom, p, miny, maxy, unnest(range(CAST(floor((minx + 180.0) / p) AS BIGINT), CAST(floor((maxx + 180.0) / p) AS BIGINT) + 1)) AS gx FROM pz),
pc AS (SELECT zoom, p, gx, unnest(range(CAST(floor((miny + 90.0) / p) AS BIGINT), CAST(floor((maxy + 90.0) / p) AS BIGINT) + 1)) AS gy FROM px),
uv AS (SELECT zoom, gx, gy, (-180.0 + (gx + 0.5::DOUBLE) * p + 10.0) / 0.0625 - 0.5 AS u, (45.0 - (-90.0 + (gy + 0.5::DOUBLE) * p)) / 0.0625 - 0.5 AS v FROM pc),
ctr AS (SELECT uv.* FROM uv, (SELECT max(row) + 1 AS n FROM dem) WHERE u >= -0.5 AND u < 149.5 AND v >= -0.5 AND v < n - 0.5)"""
    if method == "nearest":
        return f"WITH {cells} SELECT zoom, gx, gy, round(CAST(elev_m AS DOUBLE), 6) AS v FROM ctr JOIN dem ON col = CAST(floor(u + 0.5) AS BIGINT) AND row = CAST(floor(v + 0.5) AS BIGINT)"
    lo, hi = {"bilinear": (0, 1), "cubic": (-1, 2), "cubicspline": (-1, 2), "lanczos": (-2, 3)}[method]

    def w(t):
        a = f"abs({t})"
        if method == "bilinear":
            return f"greatest(0.0, 1 - {a})"
        if method == "cubic":
            return f"CASE WHEN {a} <= 1 THEN (1.5 * {a} - 2.5) * {a} * {a} + 1 WHEN {a} < 2 THEN ((-0.5 * {a} + 2.5) * {a} - 4) * {a} + 2 ELSE 0 END"
        if method == "cubicspline":
            return f"CASE WHEN {a} <= 1 THEN 2.0::DOUBLE / 3 - {a} * {a} + {a} * {a} * {a} / 2 WHEN {a} < 2 THEN (2 - {a}) * (2 - {a}) * (2 - {a}) / 6 ELSE 0 END"
        return f"CASE WHEN {a} < 1e-12 THEN 1 WHEN {a} < 3 THEN sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) ELSE 0 END"

    return f"""WITH {cells}, n1 AS (SELECT zoom, gx, gy, u, v, unnest(range({lo}, {hi + 1})) AS i FROM ctr), n2 AS (SELECT *, unnest(range({lo}, {hi + 1})) AS j FROM n1),
n3 AS (SELECT zoom, gx, gy, u, v, CAST(floor(u) AS BIGINT) + i AS c, CAST(floor(v) AS BIGINT) + j AS r FROM n2),
n4 AS (SELECT zoom, gx, gy, c, r, CAST(({w('(u - c)')}) * ({w('(v - r)')}) AS DOUBLE) AS w FROM n3)
SELECT zoom, gx, gy, round(sum(w * elev_m) / sum(w), 6) AS v FROM n4 JOIN dem ON col = c AND row = r GROUP BY zoom, gx, gy"""


QUANT = f"""{spread()}, avgs AS (SELECT zoom, gx, gy, sum(v) / count(*) AS v FROM spread GROUP BY zoom, gx, gy),
q AS (SELECT zoom, gx, gy, CAST(greatest(0, least(65535, trunc((CAST(v AS FLOAT) + 1000::FLOAT) * 5::FLOAT))) AS INTEGER) AS h FROM avgs)"""
MEMBERS = f"""{QUANT}, mx AS (SELECT zoom, gy, h, CAST(floor(gx / 64.0) AS BIGINT) AS tx, CAST(gx - 64 * floor(gx / 64.0) + 1 AS INTEGER) AS k FROM q
UNION ALL SELECT zoom, gy, h, CAST(floor(gx / 64.0) AS BIGINT) + 1, 0 FROM q WHERE gx - 64 * floor(gx / 64.0) = 63),
members AS (SELECT zoom, tx, k, h, CAST(floor(gy / 64.0) AS BIGINT) AS ty, CAST(64 - (gy - 64 * floor(gy / 64.0)) AS INTEGER) AS r FROM mx
UNION ALL SELECT zoom, tx, k, h, CAST(floor(gy / 64.0) AS BIGINT) - 1, 0 FROM mx WHERE gy - 64 * floor(gy / 64.0) = 0)"""
_B = box()
_MX, _MY = f"({_B[0]} + ({_B[2]} - {_B[0]}) / 2)", f"({_B[1]} + ({_B[3]} - {_B[1]}) / 2)"


def _over(x0, y0, x1, y1):
    return f"({x0} < m.maxx AND m.minx < {x1} AND {y0} < m.maxy AND m.miny < {y1})"


CHILDREN = f"""{KEYS}, ch AS (SELECT zoom, tx, ty, CAST(CASE WHEN zoom = {ZOOM_DEM} THEN 0 ELSE
CASE WHEN {_over(_B[0], _B[1], _MX, _MY)} THEN 1 ELSE 0 END + CASE WHEN {_over(_MX, _B[1], _B[2], _MY)} THEN 2 ELSE 0 END +
CASE WHEN {_over(_B[0], _MY, _MX, _B[3])} THEN 4 ELSE 0 END + CASE WHEN {_over(_MX, _MY, _B[2], _B[3])} THEN 8 ELSE 0 END END AS INTEGER) AS children FROM keys, meta m)"""
#: All parts share LEVELS, which may stand in a query only once.
_TAIL = lambda s: s[len(LEVELS) :]
_HEX = "printf('%02X%02X', {h} % 256, {h} // 256)"
TILES = f"""{CHILDREN}{_TAIL(MEMBERS)}, full_cells AS (SELECT k.zoom, k.tx, k.ty, i.range AS i, m.h FROM keys k CROSS JOIN range(4225) i LEFT JOIN members m ON m.zoom = k.zoom AND m.tx = k.tx AND m.ty = k.ty AND m.r * 65 + m.k = i.range),
tiles AS (SELECT zoom, tx, ty, count(h) AS n_cells, CAST(sum(coalesce(h, 5000)) AS BIGINT) AS h_sum, string_agg({_HEX.format(h='coalesce(h, 5000)')}, '' ORDER BY i) AS hex FROM full_cells GROUP BY zoom, tx, ty)"""


# the same raster on the mercator grid of 256-cell tiles
ZOOM_MERC = math.ceil(math.log2(MERC_R0 / (math.radians(0.0625) * 6378137.0)))
_E = f"{MERC_EDGE!r}::DOUBLE"
_RES_M = f"({MERC_R0!r}::DOUBLE / pow(2.0::DOUBLE, zoom))"


def _mx(lon):
    return f"(radians({lon}) * 6378137.0)"


def _my(lat):
    return f"(ln(tan(radians({lat}) / 2 + pi() / 4)) * 6378137.0)"


LEVELS_M = f"""{DEM}, geo AS (SELECT max(row) + 1 AS n FROM dem), meta AS (SELECT {_mx('-10.0::DOUBLE')} AS minx, {_my('45.0::DOUBLE - n * 0.0625::DOUBLE')} AS miny, {_mx('-0.625::DOUBLE')} AS maxx, {_my('45.0::DOUBLE')} AS maxy FROM geo),
zs AS (SELECT CAST(range AS INTEGER) AS zoom FROM range({ZOOM_MERC + 1})),
lv AS (SELECT zoom, """ + ", ".join(f"CAST(floor(({c} + {_E}) / {_RES_M}) AS BIGINT) // 256 AS {n}" for c, n in (("minx", "x0"), ("miny", "y0"), ("maxx", "x1"), ("maxy", "y1"))) + " FROM zs, meta)"
KEYS_M = f"""{LEVELS_M}, kx AS (SELECT zoom, y0, y1, unnest(range(x0, x1 + 1)) AS tx FROM lv), keys AS (SELECT zoom, tx, unnest(range(y0, y1 + 1)) AS ty FROM kx)"""
_BM = tuple(f"({t} * 256.0::DOUBLE * {_RES_M} - {_E})" for t in ("tx", "ty", "(tx + 1)", "(ty + 1)"))
_MXM, _MYM = f"({_BM[0]} + ({_BM[2]} - {_BM[0]}) / 2)", f"({_BM[1]} + ({_BM[3]} - {_BM[1]}) / 2)"
CHILDREN_M = f"""{KEYS_M} SELECT zoom, tx, ty, CAST(CASE WHEN zoom = {ZOOM_MERC} THEN 0 ELSE
CASE WHEN {_over(_BM[0], _BM[1], _MXM, _MYM)} THEN 1 ELSE 0 END + CASE WHEN {_over(_MXM, _BM[1], _BM[2], _MYM)} THEN 2 ELSE 0 END +
CASE WHEN {_over(_BM[0], _MYM, _MXM, _BM[3])} THEN 4 ELSE 0 END + CASE WHEN {_over(_MXM, _MYM, _BM[2], _BM[3])} THEN 8 ELSE 0 END END AS INTEGER) AS children FROM keys, meta m"""


def _spread_m():
    cell = lambda lo, hi: f"unnest(range(CAST(floor(({lo} + {_E}) / {_RES_M} + 1e-9) AS BIGINT), CAST(ceil(({hi} + {_E}) / {_RES_M} - 1e-9) AS BIGINT)))"
    lon, lat = (lambda c: _mx(f"(-10.0::DOUBLE + {c} * 0.0625::DOUBLE)")), (lambda r: _my(f"(45.0::DOUBLE - {r} * 0.0625::DOUBLE)"))
    return f"""{LEVELS_M}, sx AS (SELECT zoom, row, elev_m AS v, {cell(lon('col'), lon('(col + 1)'))} AS gx FROM dem, zs), spread AS (SELECT zoom, gx, v, {cell(lat('(row + 1)'), lat('row'))} AS gy FROM sx)"""


NEAREST_M = f"""{LEVELS_M}, cx AS (SELECT zoom, miny, maxy, unnest(range(CAST(floor((minx + {_E}) / {_RES_M}) AS BIGINT), CAST(floor((maxx + {_E}) / {_RES_M}) AS BIGINT) + 1)) AS gx FROM zs, meta),
cy AS (SELECT zoom, gx, unnest(range(CAST(floor((miny + {_E}) / {_RES_M}) AS BIGINT), CAST(floor((maxy + {_E}) / {_RES_M}) AS BIGINT) + 1)) AS gy FROM cx),
ll AS (SELECT zoom, gx, gy, degrees((-{_E} + (gx + 0.5::DOUBLE) * {_RES_M}) / 6378137.0) AS lon, degrees(2 * atan(exp((-{_E} + (gy + 0.5::DOUBLE) * {_RES_M}) / 6378137.0)) - pi() / 2) AS lat FROM cy)
SELECT zoom, gx, gy, elev_m AS v FROM ll JOIN dem ON col = CAST(floor((lon + 10.0) / 0.0625) AS BIGINT) AND row = CAST(floor((45.0 - lat) / 0.0625) AS BIGINT)"""


def _corners_cols():
    pts = {"ll": ("minx", "miny"), "lr": ("maxx", "miny"), "ur": ("maxx", "maxy"), "ul": ("minx", "maxy")}
    return ", ".join(f"{v} AS {k}_{a}" for k, p in pts.items() for a, v in zip("xy", p))


def _boxes(t, key):
    return f"(SELECT {key}::BIGINT AS id, {key}::BIGINT * 7 % 40 AS minx, {key}::BIGINT * 11 % 30 AS miny, {key}::BIGINT * 7 % 40 + {key}::BIGINT * 3 % 9 - 1 AS maxx, {key}::BIGINT * 11 % 30 + {key}::BIGINT * 5 % 8 - 1 AS maxy FROM {t})"


SUP, NAT = _boxes("supplier", "s_suppkey"), _boxes("nation", "n_nationkey")
VALID = "minx <= maxx AND miny <= maxy"
POINTS = "pts AS (SELECT c_custkey AS id, -180 + c_custkey % 360 + 0.5::DOUBLE AS lon, -90 + (c_custkey // 360) % 180 + 0.5::DOUBLE AS lat FROM customer), pz AS (SELECT id, lon, lat, CAST(unnest(range(9)) AS INTEGER) AS zoom FROM pts)"
PIXELS = "(SELECT CAST(p_size % 12 AS INTEGER) AS zoom, p_partkey * 37 % 100000 AS px, p_partkey * 91 % 50000 AS py FROM part)"
FLAGS = "(SELECT p_partkey AS id, CAST(p_size % 16 AS INTEGER) AS children, CASE WHEN p_size % 3 = 2 THEN repeat('0001', 8) WHEN p_size % 2 = 1 THEN '01' ELSE '00' END AS mask, CAST(CASE p_size % 3 WHEN 0 THEN 8452 WHEN 1 THEN 73987 ELSE 8451 END AS BIGINT) AS n_bytes FROM part)"
PATH = "zoom::VARCHAR || '/' || tx::VARCHAR || '/' || ty::VARCHAR || '.terrain'"
_RING = ", ".join(["[%.15e, %.15e]"] * 5)


def _feature(b):
    return "printf('{ \"type\": \"Feature\", \"geometry\": { \"type\": \"Polygon\", \"coordinates\": [[" + _RING + "]]}, \"properties\": {\"tx\": %d, \"ty\": %d}}', " + ", ".join([b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3], b[0], b[1]]) + ", tx, ty)"


_FEATURE = _feature(_B)
_TERR_RES = f"(({_B[2]} - {_B[0]}) / 64.0::DOUBLE)"
_QUADS = {"sw": ("minx", "miny", "mx", "my"), "se": ("mx", "miny", "maxx", "my"), "nw": ("minx", "my", "mx", "maxy"), "ne": ("mx", "my", "maxx", "maxy")}
_BITS = {"sw": 1, "se": 2, "nw": 4, "ne": 8}
_SUMS = f"WITH {TILES} SELECT t.zoom, t.tx, t.ty, c.children, t.h_sum FROM tiles t JOIN ch c USING (zoom, tx, ty)"


def _extent_sql(z0, z1):
    out = []
    for zoom in range(z0, z1 - 1, -1):
        r = R0 / 2.0**zoom
        out.append(f"SELECT {zoom}::INTEGER AS zoom, 0::BIGINT AS x0, 0::BIGINT AS y0, {int(360.0 / r) // 65}::BIGINT AS x1, {int(180.0 / r) // 65}::BIGINT AS y1")
    return " UNION ALL ".join(out)


def oracle(resolutions) -> dict[str, str]:
    q = {
        "raster_scan": f"WITH {DEM} SELECT col, row, elev_m FROM dem",
        "raster_bounds": f"WITH {DEM} SELECT -10.0::DOUBLE + min(col) * 0.0625::DOUBLE AS minx, 45.0::DOUBLE - (max(row) + 1) * 0.0625::DOUBLE AS miny, -10.0::DOUBLE + (max(col) + 1) * 0.0625::DOUBLE AS maxx, 45.0::DOUBLE - min(row) * 0.0625::DOUBLE AS maxy FROM dem",
        "raster_resolution": "SELECT 0.0625::DOUBLE AS res_x, 0.0625::DOUBLE AS res_y FROM (SELECT count(*) FROM orders)",
        "raster_multiband": "SELECT band, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM (SELECT 1::INTEGER AS band, CAST(floor(o_totalprice / 60) AS BIGINT) AS value FROM orders UNION ALL SELECT 2, o_custkey FROM orders) GROUP BY band",
        "raster_mosaic": f"WITH {DEM} SELECT count(*) AS n, CAST(sum(elev_m) AS BIGINT) AS sum_elev FROM dem",
        "grid_profiles": f"SELECT 'geodetic' AS profile, 65::INTEGER AS tile_size, 4326::INTEGER AS epsg, -180.0::DOUBLE AS minx, -90.0::DOUBLE AS miny, 180.0::DOUBLE AS maxx, 90.0::DOUBLE AS maxy, 2::INTEGER AS root_tiles UNION ALL SELECT 'mercator', 256, 3857, {-MERC_EDGE!r}, {-MERC_EDGE!r}, {MERC_EDGE!r}, {MERC_EDGE!r}, 1",
        "grid_resolution": f"SELECT p AS profile, CAST(range AS INTEGER) AS zoom, r / pow(2.0::DOUBLE, range) AS res FROM range(21), (VALUES ('geodetic', {R0!r}::DOUBLE), ('mercator', {MERC_R0!r}::DOUBLE)) t(p, r)",
        "grid_zoom_for_resolution": "SELECT res, CAST(greatest(0, ceil(log2(" + f"{R0!r}" + "::DOUBLE / res))) AS INTEGER) AS zoom FROM (VALUES " + ", ".join(f"({r!r}::DOUBLE)" for r in resolutions) + ") t(res)",
        "grid_pixels_to_tile": f"SELECT zoom, px, py, px // 65 AS tx, py // 65 AS ty FROM {PIXELS}",
        "grid_pixels_to_crs": f"SELECT zoom, px, py, px * {res()} - 180.0 AS x, py * {res()} - 90.0 AS y FROM {PIXELS}",
        "grid_crs_to_pixels": f"WITH {POINTS} SELECT id, zoom, {pix('lon', '180.0')} AS px, {pix('lat', '90.0')} AS py FROM pz",
        "grid_crs_to_tile": f"WITH {POINTS} SELECT id, zoom, {pix('lon', '180.0')} // 65 AS tx, {pix('lat', '90.0')} // 65 AS ty FROM pz",
        "grid_tile_bounds": f"WITH {KEYS} SELECT zoom, tx, ty, {_B[0]} AS minx, {_B[1]} AS miny, {_B[2]} AS maxx, {_B[3]} AS maxy FROM keys",
        "grid_tile_extent": _extent_sql(10, 0),
        "tiler_corner_tiles": f"WITH {LEVELS} SELECT zoom, x0 AS llx, y0 AS lly, x1 AS urx, y1 AS ury FROM lv",
        "tiler_tile_bounds": f"WITH {LEVELS} SELECT zoom, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM lv",
        "tiler_max_zoom": f"SELECT CAST(ceil(log2({R0!r}::DOUBLE * 16)) AS INTEGER) AS max_zoom",
        "bounds_reproject": f"WITH {POINTS}, m AS (SELECT radians(lon) * 6378137.0 AS x, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0 AS y FROM pts WHERE abs(lat) < 85) SELECT round(min(x), 3) AS minx, round(min(y), 3) AS miny, round(max(x), 3) AS maxx, round(max(y), 3) AS maxy FROM m",
        "tiler_bounds_mercator": f"WITH {LEVELS_M} SELECT round(minx, 3) AS minx, round(miny, 3) AS miny, round(maxx, 3) AS maxx, round(maxy, 3) AS maxy FROM meta",
        "tiler_max_zoom_mercator": f"WITH {LEVELS_M} SELECT CAST(ceil(log2({MERC_R0!r}::DOUBLE / ((maxx - minx) / 150))) AS INTEGER) AS max_zoom FROM meta",
        "tiler_tile_bounds_mercator": f"WITH {LEVELS_M} SELECT zoom, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM lv",
        "extents_mercator": f"WITH {KEYS_M} SELECT zoom, tx, ty, {_feature(_BM)} AS feature FROM keys",
        "terrain_children_mercator": f"WITH {CHILDREN_M}",
        "resample_average_mercator": f"WITH {_spread_m()} SELECT zoom, gx, gy, sum(v) / count(*) AS v FROM spread GROUP BY zoom, gx, gy",
        "resample_nearest_mercator": f"WITH {NEAREST_M}",
        "resample_max_pyramid": area("max(v)"),
        "tile_geotransform": f"WITH {KEYS} SELECT zoom, tx, ty, {_B[0]} AS gt0, {res()} AS gt1, 0.0::DOUBLE AS gt2, {_B[3]} AS gt3, 0.0::DOUBLE AS gt4, -{res()} AS gt5 FROM keys",
        "terrain_tile_bounds": f"WITH {KEYS} SELECT zoom, tx, ty, {_TERR_RES} AS res, {_B[0]} - {_TERR_RES} AS minx, {_B[1]} AS miny, {_B[2]} AS maxx, {_B[3]} + {_TERR_RES} AS maxy FROM keys",
        "terrain_geotransform": f"WITH {KEYS} SELECT zoom, tx, ty, {_B[0]} AS gt0, {_TERR_RES} AS gt1, 0.0::DOUBLE AS gt2, {_B[3]} AS gt3, 0.0::DOUBLE AS gt4, -{_TERR_RES} AS gt5 FROM keys",
        "bounds_validate": f"SELECT *, {VALID} AS valid FROM {SUP}",
        "bounds_corners": f"SELECT id, {_corners_cols()} FROM {SUP} WHERE {VALID}",
        "bounds_size": f"SELECT id, maxx - minx AS width, maxy - miny AS height FROM {SUP} WHERE {VALID}",
        "bounds_quadrants": "SELECT id, " + ", ".join(f"{v} AS {k}_{n}" for k, b in _QUADS.items() for n, v in zip(("minx", "miny", "maxx", "maxy"), b)) + f" FROM (SELECT *, minx + (maxx - minx) // 2 AS mx, miny + (maxy - miny) // 2 AS my FROM {SUP} WHERE {VALID})",
        "bounds_overlap_join": f"SELECT a.id AS a_id, b.id AS b_id FROM {SUP} a JOIN {NAT} b ON a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy WHERE a.minx <= a.maxx AND a.miny <= a.maxy AND b.minx <= b.maxx AND b.miny <= b.maxy",
        "enumerate_grid": f"WITH lv AS ({_extent_sql(4, 0)}), kx AS (SELECT zoom, y0, y1, unnest(range(x0, x1 + 1)) AS tx FROM lv) SELECT zoom, tx, unnest(range(y0, y1 + 1)) AS ty FROM kx",
        "enumerate_extent": f"WITH {KEYS} SELECT zoom, tx, ty FROM keys",
        "enumerate_zoom_range": f"WITH {KEYS} SELECT zoom, tx, ty FROM keys WHERE zoom BETWEEN 3 AND 5",
        "enumerate_ordered": f"WITH {KEYS} SELECT row_number() OVER (ORDER BY zoom DESC, tx, ty) - 1 AS idx, zoom, tx, ty FROM keys",
        "tile_count_by_zoom": f"WITH {KEYS} SELECT zoom, count(*) AS n FROM keys GROUP BY zoom",
        "tile_count": f"WITH {KEYS} SELECT count(*) AS n FROM keys",
        "resample_average": area("sum(v) / count(*)"),
        "resample_max": area("max(v)"),
        "resample_min": area("min(v)"),
        "resample_med": area("CAST(quantile_disc(v, 0.5) AS BIGINT)"),
        "resample_q1": area("CAST(quantile_disc(v, 0.25) AS BIGINT)"),
        "resample_q3": area("CAST(quantile_disc(v, 0.75) AS BIGINT)"),
        "resample_mode": MODE,
        **{f"resample_{m}": point(m) for m in ("nearest", "bilinear", "cubic", "cubicspline", "lanczos")},
        "terrain_quantise": f"WITH {QUANT} SELECT zoom, gx, gy, h FROM q",
        "terrain_children": f"WITH {CHILDREN} SELECT zoom, tx, ty, children FROM ch",
        "children_vs_tiles": f"WITH {CHILDREN}, n AS (SELECT zoom - 1 AS zoom, tx // 2 AS tx, ty // 2 AS ty, count(*) AS n FROM keys GROUP BY ALL) SELECT ch.zoom, ch.tx, ch.ty, children, coalesce(n, 0) AS n_child_tiles FROM ch LEFT JOIN n USING (zoom, tx, ty)",
        "terrain_border": f"WITH {MEMBERS} SELECT zoom, tx, ty, r, k, h FROM members",
        "terrain_tiles": f"WITH {TILES} SELECT t.zoom, t.tx, t.ty, c.children, t.n_cells, t.h_sum, md5(unhex(t.hex)) AS h_md5 FROM tiles t JOIN ch c USING (zoom, tx, ty)",
        "raster_tiles": f"WITH {spread(65)}, c AS (SELECT zoom, gx, gy, max(v) AS v FROM spread GROUP BY zoom, gx, gy), m AS (SELECT zoom, CAST(floor(gx / 65.0) AS BIGINT) AS tx, CAST(floor(gy / 65.0) AS BIGINT) AS ty, CAST(64 - (gy - 65 * floor(gy / 65.0)) AS INTEGER) AS r, CAST(gx - 65 * floor(gx / 65.0) AS INTEGER) AS k, v FROM c) SELECT zoom, tx, ty, count(*) AS n_cells, CAST(sum(v) AS BIGINT) AS h_sum, md5(string_agg(r || ':' || k || ':' || v, ',' ORDER BY r, k)) AS h_md5 FROM m GROUP BY zoom, tx, ty",
        "terrain_empty": f"WITH {KEYS} SELECT zoom, tx, ty, 0::BIGINT AS n_cells, 21125000::BIGINT AS h_sum, md5(unhex(repeat('8813', 4225))) AS h_md5 FROM keys WHERE zoom <= 1",
        "terrain_encode_raw": f"WITH {TILES} SELECT t.zoom, t.tx, t.ty, 8452::BIGINT AS n_bytes, md5(unhex(t.hex || printf('%02X', c.children) || '00')) AS payload_md5 FROM tiles t JOIN ch c USING (zoom, tx, ty)",
        "terrain_encode": _SUMS,
        "terrain_decode": _SUMS,
        "terrain_decode_raw": _SUMS,
        "terrain_validate": f"SELECT id, n_bytes, CASE n_bytes WHEN 8452 THEN 'single' WHEN 73987 THEN 'grid' END AS mask_kind FROM {FLAGS}",
        "terrain_mask": f"SELECT id, length(mask) // 2 AS n, CAST(length(mask) - length(replace(mask, '1', '')) AS BIGINT) AS n_water FROM {FLAGS}",
        "tile_type": f"SELECT id, mask = '01' AS is_water, mask = '00' AS is_land, length(mask) > 2 AS has_mask FROM {FLAGS}",
        "child_flags": "SELECT id, children != 0 AS any_child, " + ", ".join(f"(children & {b}) = {b} AS {k}" for k, b in _BITS.items()) + f" FROM {FLAGS}",
        "child_flags_update": "SELECT id, " + ", ".join(f"CAST(children | {b} AS INTEGER) AS set_{k}, CAST(children & {15 - b} AS INTEGER) AS clear_{k}" for k, b in _BITS.items()) + f", 15::INTEGER AS all_on, 0::INTEGER AS all_off FROM {FLAGS}",
        "terrain_export": f"WITH {TILES} SELECT zoom, tx, ty, CAST(i // 65 AS INTEGER) AS r, CAST(i % 65 AS INTEGER) AS k, ({_B[0]} - {_TERR_RES}) + (i % 65) * {_TERR_RES} AS x, ({_B[3]} + {_TERR_RES}) - (i // 65) * {_TERR_RES} AS y, CAST(CASE WHEN coalesce(h, 5000) >= 32768 THEN coalesce(h, 5000) - 65536 ELSE coalesce(h, 5000) END AS INTEGER) AS raw_i16, coalesce(h, 5000) / 5.0::DOUBLE - 1000.0 AS elev_m FROM full_cells",
        "tile_path": f"WITH {KEYS} SELECT zoom, tx, ty, {PATH} AS path FROM keys",
        "resume_anti_join": f"WITH {KEYS} SELECT zoom, tx, ty, {PATH} AS path FROM keys WHERE (tx + ty) % 2 != 0",
        "extents_feature": f"WITH {KEYS} SELECT zoom, tx, ty, {_FEATURE} AS feature FROM keys",
        "extents_geojson": f"WITH {KEYS}, f AS (SELECT zoom, tx, ty, {_FEATURE} AS feature FROM keys) SELECT zoom, '{{ \"type\": \"FeatureCollection\", \"features\": [' || chr(10) || string_agg(feature, ',' || chr(10) ORDER BY tx, ty) || ']}}' || chr(10) AS geojson FROM f GROUP BY zoom",
        "tile_info": f"WITH {CHILDREN} SELECT zoom, tx, ty, CASE WHEN children = 0 THEN ' None' ELSE 'Child tiles: ' || concat_ws(' ', " + ", ".join(f"CASE WHEN (children & {b}) = {b} THEN '{k.upper()}' END" for k, b in _BITS.items()) + ") END || chr(10) || 'Tile type: all land' AS info FROM ch",
    }
    return q
