"""Operators on occurrence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.functions import grid
from terramosaic.types import Bbox

LAT, LNG = "decimalLatitude", "decimalLongitude"


def in_box(df: DataFrame, box: Bbox, lat: str = LAT, lng: str = LNG) -> DataFrame:
    """Both coordinates present and inside the box, borders included; pushed to the scan."""
    return df.where(F.col(lat).between(box.sw.lat, box.ne.lat) & F.col(lng).between(box.sw.lng, box.ne.lng))


def with_geocode(df: DataFrame, res: int, lat: str = LAT, lng: str = LNG) -> DataFrame:
    return grid.with_cell(df, lat, lng, res)


def geocodes(df: DataFrame, res: int, lat: str = LAT, lng: str = LNG) -> DataFrame:
    return with_geocode(df.select(lat, lng), res, lat, lng).select("geocode")


def in_cells(df: DataFrame, box: Bbox, res: int, lat: str = LAT, lng: str = LNG) -> DataFrame:
    """Rows inside the box with their cell, which is never null."""
    box = Bbox.of(max(box.sw.lat, -90.0), min(box.ne.lat, 90.0), max(box.sw.lng, -180.0), min(box.ne.lng, 180.0))
    return grid.with_cell(in_box(df, box, lat, lng), lat, lng, res, valid=True)
