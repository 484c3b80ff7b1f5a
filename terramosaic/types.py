"""Small value types."""

from __future__ import annotations

from typing import NamedTuple

from terramosaic import defaults


class LatLng(NamedTuple):
    lat: float
    lng: float


class Bbox(NamedTuple):
    """A box by its south-west and north-east corners."""

    sw: LatLng
    ne: LatLng

    @classmethod
    def of(cls, min_lat: float = defaults.MIN_LAT, max_lat: float = defaults.MAX_LAT, min_lng: float = defaults.MIN_LNG, max_lng: float = defaults.MAX_LNG) -> Bbox:
        return cls(LatLng(min_lat, min_lng), LatLng(max_lat, max_lng))
