"""Map colours of clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from terramosaic.functions import colors
from terramosaic.operators import distances as dist

SCHEMA = "cluster int, color string, darkened_color string"
TAXONOMIC_FROM = 10


def greedy(neighbors: dict[int, list[int]]) -> dict[int, int]:
    """Smallest colour that no coloured neighbour has, by falling degree (stable)."""
    adjacent: dict[int, set[int]] = {c: set(n) - {c} for c, n in neighbors.items()}
    for c, around in list(adjacent.items()):
        for x in around:
            adjacent.setdefault(x, set()).add(c)
    out: dict[int, int] = {}
    for c in sorted(neighbors, key=lambda c: -len(adjacent[c])):
        used = {out[x] for x in adjacent[c] if x in out}
        out[c] = next(k for k in range(len(used) + 1) if k not in used)
    return out


def geographic(neighbors: DataFrame) -> DataFrame:
    """Colours that differ between adjacent clusters; one row a cluster, so the driver colours them."""
    rows = {r["cluster"]: r["direct_and_indirect_neighbors"] for r in neighbors.orderBy("cluster").collect()}
    found = greedy(rows)
    shades = colors.palette(max(found.values(), default=-1) + 1)
    return neighbors.sparkSession.createDataFrame([(c, shades[k], colors.darken(shades[k])) for c, k in sorted(found.items())], SCHEMA)


def taxonomic(statistics: DataFrame, reducer: str = "mds") -> DataFrame:
    """Colours near each other for clusters of like composition: three dimensions as hue, saturation and value."""
    clusters = [r["cluster"] for r in statistics.where("cluster is not null").select("cluster").distinct().orderBy("cluster").collect()]
    if len(clusters) < TAXONOMIC_FROM:
        raise ValueError(f"taxonomic colours need {TAXONOMIC_FROM} clusters, got {len(clusters)}")
    place = {c: k for k, c in enumerate(clusters)}
    square = np.zeros((len(clusters), len(clusters)))
    for r in dist.cluster_distances(statistics).collect():
        square[place[r["a"]], place[r["b"]]] = square[place[r["b"]], place[r["a"]]] = r["distance"]
    y = dist.mds(square, 3) if reducer == "mds" else dist.external(reducer, square, 3)
    y = (y - y.min(axis=0)) / np.where(np.ptp(y, axis=0) == 0, 1, np.ptp(y, axis=0))
    rows = [(c, colors.hsv_hex(*v), colors.darken(colors.hsv_hex(*v))) for c, v in zip(clusters, y.tolist(), strict=True)]
    return statistics.sparkSession.createDataFrame(rows, SCHEMA)


def cluster_colors(neighbors: DataFrame, statistics: DataFrame | None = None, method: str = "geographic") -> DataFrame:
    if method == "geographic":
        return geographic(neighbors)
    if method == "taxonomic":
        if statistics is None:
            raise ValueError("taxonomic colours need the statistics")
        return taxonomic(statistics)
    raise ValueError(f"unknown colour method {method!r}")


def method_for(k: int) -> str:
    return "taxonomic" if k >= TAXONOMIC_FROM else "geographic"


def as_map(table: DataFrame) -> dict[int, str]:
    return {r["cluster"]: r["color"] for r in table.collect()}
