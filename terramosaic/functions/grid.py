"""A hexagonal grid in built-in expressions.

Hexagons tile a cylindrical equal-area plane in axial coordinates (q, r), so all
cells of a resolution have one area: that of the sphere over 2 + 120 * 7^res,
the public cell counts of aperture-7 grids. A cell id packs resolution, q and r
into a BIGINT, which makes a neighbour an addition. Everything is an expression
string that both Spark and other SQL engines evaluate, so filters push down,
code generation applies, and no Python worker runs.

Ids are of this grid alone. Cells do not wrap at the antimeridian.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terramosaic.types import Bbox

EARTH_KM = 6371.0072
SHIFT, HALF = 1 << 28, 1 << 27
RES_UNIT = 1 << 56
MAX_RES = 15
#: Axial steps to the six neighbours.
STEPS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def number(x: float) -> str:
    """A DOUBLE literal in any dialect."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def edge_km(res: int) -> float:
    if not 0 <= res <= MAX_RES:
        raise ValueError(f"resolution {res} is not in 0..{MAX_RES}")
    area = 4 * pi * EARTH_KM**2 / (2 + 120 * 7**res)
    return sqrt(2 * area / (3 * sqrt(3)))


def cell_sql(lat: str, lng: str, res: int) -> str:
    """Cell id of a coordinate; null where one is null, not finite or out of range."""
    a = edge_km(res)
    x, y = f"(radians({lng}) * {number(EARTH_KM)})", f"(sin(radians({lat})) * {number(EARTH_KM)})"
    q = f"(({number(sqrt(3) / 3)} * {x} - {number(1 / 3)} * {y}) / {number(a)})"
    r = f"({number(2 / 3)} * {y} / {number(a)})"
    rq, rr, rs = f"floor({q} + 0.5e0)", f"floor({r} + 0.5e0)", f"floor(-{q} - {r} + 0.5e0)"
    dq, dr, ds = f"abs({rq} - {q})", f"abs({rr} - {r})", f"abs({rs} + {q} + {r})"
    q_out = f"(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{rr} - {rs} ELSE {rq} END)"
    r_out = f"(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN {rr} WHEN {dr} > {ds} THEN -{rq} - {rs} ELSE {rr} END)"
    inside = f"({lat}) BETWEEN -90e0 AND 90e0 AND ({lng}) BETWEEN -180e0 AND 180e0"
    return f"(CASE WHEN {inside} THEN {res * RES_UNIT} + (CAST({q_out} AS BIGINT) + {HALF}) * {SHIFT} + CAST({r_out} AS BIGINT) + {HALF} END)"


def q_sql(cell: str, res: int) -> str:
    return f"(CAST(floor(({cell} - {res * RES_UNIT}) / {number(SHIFT)}) AS BIGINT) - {HALF})"


def r_sql(cell: str, res: int) -> str:
    return f"((({cell} - {res * RES_UNIT}) % {SHIFT}) - {HALF})"


def lng_sql(x: str) -> str:
    return f"degrees(({x}) / {number(EARTH_KM)})"


def lat_sql(y: str) -> str:
    return f"degrees(asin(greatest(-1e0, least(1e0, ({y}) / {number(EARTH_KM)}))))"


def center_xy_sql(cell: str, res: int) -> tuple[str, str]:
    a, q, r = edge_km(res), q_sql(cell, res), r_sql(cell, res)
    return f"({number(a * sqrt(3))} * ({q} + {r} * 0.5e0))", f"({number(a * 1.5)} * {r})"


def corners_xy_sql(cell: str, res: int) -> list[tuple[str, str]]:
    """The six corners, counter-clockwise from the lower right."""
    a, (x, y) = edge_km(res), center_xy_sql(cell, res)
    w, h = a * sqrt(3) / 2, a / 2
    return [(f"({x} + {number(dx)})", f"({y} + {number(dy)})") for dx, dy in ((w, -h), (w, h), (0, a), (-w, h), (-w, -h), (0, -a))]


def center_sql(cell: str, res: int) -> tuple[str, str]:
    x, y = center_xy_sql(cell, res)
    return lng_sql(x), lat_sql(y)


def corners_sql(cell: str, res: int) -> list[tuple[str, str]]:
    return [(lng_sql(x), lat_sql(y)) for x, y in corners_xy_sql(cell, res)]


def neighbors_sql(cell: str) -> list[str]:
    return [f"({cell} + {dq * SHIFT + dr})" for dq, dr in STEPS]


def is_edge_sql(cell: str, res: int, box: Bbox) -> str:
    """Whether the cell's polygon meets the box's outline (touching counts), in planar coordinates.

    A convex polygon meets the outline if it meets the filled box and does not
    lie strictly inside it. Two convex shapes are apart if an edge's normal
    separates them.
    """
    return meets_outline_sql(corners_sql(cell, res), box)


def meets_outline_sql(corners: list[tuple[str, str]], box: Bbox) -> str:
    """As is_edge_sql(), on given corners in the grid's order.

    The hexagon's sides give its extent: corners 0 and 3 east and west, 2 and 5
    north and south. The two upright edges are settled by the extent; behind a
    slanted edge, the box is apart if its corner nearest to the hexagon is.
    """
    west, east, south, north = (number(v) for v in (box.sw.lng, box.ne.lng, box.sw.lat, box.ne.lat))
    right, left, top, bottom = corners[0][0], corners[3][0], corners[2][1], corners[5][1]
    overlap = f"{right} >= {west} AND {left} <= {east} AND {top} >= {south} AND {bottom} <= {north}"
    inside = f"{left} > {west} AND {right} < {east} AND {bottom} > {south} AND {top} < {north}"
    apart = []
    for k, (px, py) in ((1, (west, south)), (2, (east, south)), (4, (east, north)), (5, (west, north))):
        (x0, y0), (x1, y1) = corners[k], corners[(k + 1) % 6]
        apart.append(f"({x1} - {x0}) * ({py} - {y0}) - ({y1} - {y0}) * ({px} - {x0}) < 0e0")
    return f"(({overlap}) AND NOT ({inside}) AND NOT ({' OR '.join(apart)}))"


# ---- column forms ----------------------------------------------------------
# Steps go into columns of their own, so that each is computed once a row.


def with_cell(df: DataFrame, lat: str, lng: str, res: int, name: str = "geocode", valid: bool = False) -> DataFrame:
    """``df`` with the cell id of a coordinate, null where that is no coordinate.

    ``valid`` says that all coordinates are present and in range. The id is then
    never null, which keeps the null checks that joins add from being pushed to
    the scan with the whole expression in them.
    """
    a = edge_km(res)
    inside = F.lit(True) if valid else F.col(lat).between(-90.0, 90.0) & F.col(lng).between(-180.0, 180.0)
    x, y = F.radians(F.col(lng)) * EARTH_KM, F.sin(F.radians(F.col(lat))) * EARTH_KM
    df = df.withColumns({"_x": F.when(inside, x), "_y": F.when(inside, y)})
    df = df.withColumns({"_q": (sqrt(3) / 3 * F.col("_x") - 1 / 3 * F.col("_y")) / a, "_r": 2 / 3 * F.col("_y") / a})
    df = df.withColumns({"_rq": F.floor(F.col("_q") + 0.5), "_rr": F.floor(F.col("_r") + 0.5), "_rs": F.floor(-F.col("_q") - F.col("_r") + 0.5)})
    dq, dr, ds = F.abs(F.col("_rq") - F.col("_q")), F.abs(F.col("_rr") - F.col("_r")), F.abs(F.col("_rs") + F.col("_q") + F.col("_r"))
    df = df.withColumn("_far", F.when((dq > dr) & (dq > ds), 0).when(dr > ds, 1).otherwise(2))
    q = F.when(F.col("_far") == 0, -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    r = F.when(F.col("_far") == 1, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    cell = F.lit(res * RES_UNIT) + (q + HALF) * SHIFT + r + HALF
    return df.withColumn(name, F.coalesce(cell, F.lit(-1)) if valid else cell).drop("_x", "_y", "_q", "_r", "_rq", "_rr", "_rs", "_far")


def with_geometry(cells: DataFrame, res: int, box: Bbox, cell: str = "geocode") -> DataFrame:
    """``cells`` with centre, closed boundary ring and edge flag."""
    a = edge_km(res)
    w, h = a * sqrt(3) / 2, a / 2
    x, y = center_xy_sql(cell, res)
    # A filter on the edge flag must not be pushed below the plane coordinates, where it would hold
    # their expressions many times over; an aggregate by the (unique) cell stands in its way.
    keys = cells.columns
    df = cells.withColumns({"_x": F.expr(x), "_y": F.expr(y)}).groupBy(*keys).agg(F.first("_x").alias("_x"), F.first("_y").alias("_y"))
    lng = {k: F.expr(lng_sql(f"(_x + {number(dx)})")).alias(k) for k, dx in (("w", -w), ("x", 0), ("e", w))}
    lat = {k: F.expr(lat_sql(f"(_y + {number(dy)})")).alias(k) for k, dy in (("b", -a), ("l", -h), ("y", 0), ("h", h), ("t", a))}
    df = df.select(*keys, *(c.alias(f"_{k}") for k, c in (lng | lat).items()))
    corners = [("_e", "_l"), ("_e", "_h"), ("_x", "_t"), ("_w", "_h"), ("_w", "_l"), ("_x", "_b")]
    ring = [F.struct(F.col(cx).alias("lng"), F.col(cy).alias("lat")) for cx, cy in (*corners, corners[0])]
    center = F.struct(F.col("_x").alias("lng"), F.col("_y").alias("lat"))
    return df.select(*keys, center.alias("center"), F.array(*ring).alias("boundary"), F.expr(meets_outline_sql(corners, box)).alias("is_edge"))


def neighbors(cell_col: str) -> Column:
    return F.array(*(F.col(cell_col) + (dq * SHIFT + dr) for dq, dr in STEPS))
