"""Well-known binary of points, polygons and multipolygons (little-endian, two dimensions)."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

Ring = list[tuple[float, float]]
POINT, POLYGON, MULTIPOLYGON = 1, 3, 6


def encode_point(lng: float, lat: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, lng, lat)


def encode_polygon(rings: list[Ring]) -> bytes:
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *(v for p in ring for v in p)))
    return b"".join(out)


def encode_multipolygon(polygons: list[list[Ring]]) -> bytes:
    return struct.pack("<BII", 1, MULTIPOLYGON, len(polygons)) + b"".join(map(encode_polygon, polygons))


def decode(raw: bytes) -> tuple[str, list]:
    """("Point", [lng, lat]), ("Polygon", rings) or ("MultiPolygon", polygons), coordinates as GeoJSON nests them."""
    shape, end = _read(bytes(raw), 0)
    if end != len(raw):
        raise ValueError("bytes behind the geometry")
    return shape


def _read(raw: bytes, at: int) -> tuple[tuple[str, list], int]:
    order = {0: ">", 1: "<"}[raw[at]]
    (kind,) = struct.unpack_from(f"{order}I", raw, at + 1)
    at += 5
    if kind == POINT:
        return ("Point", list(struct.unpack_from(f"{order}2d", raw, at))), at + 16
    if kind not in (POLYGON, MULTIPOLYGON):
        raise ValueError(f"geometry type {kind} is not supported")
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at, parts = at + 4, []
    for _ in range(n):
        if kind == MULTIPOLYGON:
            (_, part), at = _read(raw, at)
        else:
            (size,) = struct.unpack_from(f"{order}I", raw, at)
            flat = struct.unpack_from(f"{order}{2 * size}d", raw, at + 4)
            part, at = [list(p) for p in zip(flat[::2], flat[1::2], strict=True)], at + 4 + 16 * size
        parts.append(part)
    return ("Polygon" if kind == POLYGON else "MultiPolygon", parts), at


@F.pandas_udf(BinaryType())
def point_wkb(lng: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) else encode_point(x, y) for x, y in zip(lng, lat, strict=True)])


@F.pandas_udf(BinaryType())
def ring_wkb(ring: pd.Series) -> pd.Series:
    """Polygon of one closed ring, an array of (lng, lat) structs."""
    return pd.Series([None if r is None else encode_polygon([[(p["lng"], p["lat"]) for p in r]]) for r in ring])


@F.pandas_udf(StringType())
def geometry_json(raw: pd.Series) -> pd.Series:
    """GeoJSON geometry of WKB."""
    import json

    out = []
    for value in raw:
        if value is None:
            out.append(None)
        else:
            kind, coordinates = decode(value)
            out.append(json.dumps({"type": kind, "coordinates": coordinates}))
    return pd.Series(out)
