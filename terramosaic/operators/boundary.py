"""Outlines of clusters: cells of a cluster dissolved into polygons."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.functions import wkb

#: Corners are compared on a lattice of 1e-9 degrees.
SNAP = 1_000_000_000


def outline_edges(clusters: DataFrame, cell_table: DataFrame) -> DataFrame:
    """Directed edges of each cluster's outline: edges that occur in both directions cancel.

    Columns: cluster, x0, y0, x1, y1 on the lattice. A group-by, whatever the
    number of cells.
    """
    rings = clusters.join(cell_table, "geocode").select("cluster", "geocode", "boundary")
    snapped = rings.select("cluster", F.transform("boundary", lambda p: F.struct(F.round(p["lng"] * SNAP).cast("bigint").alias("x"), F.round(p["lat"] * SNAP).cast("bigint").alias("y"))).alias("ring"))
    steps = snapped.select("cluster", F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"))).alias("e"))
    edges = steps.select("cluster", F.col("e.a").alias("a"), F.col("e.b").alias("b")).where("a <> b")
    forward = F.col("a") < F.col("b")
    lines = edges.groupBy("cluster", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("q")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net"))
    out = lines.where("net <> 0").select("cluster", F.when(F.col("net") > 0, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(F.col("net") > 0, F.col("q")).otherwise(F.col("p")).alias("b"))
    return out.select("cluster", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


def chain(edges: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed edges; where rings meet in a corner, the sharpest left turn keeps them apart."""
    ahead: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for a, b in sorted(edges):
        ahead[a].append(b)
    rings = []
    for start in sorted(ahead):
        while ahead[start]:
            ring, here = [start], ahead[start].pop(0)
            while here != start:
                before, options = ring[-1], ahead[here]
                ring.append(here)
                if not options:
                    raise ValueError("the edges do not close")
                heading = math.atan2(here[1] - before[1], here[0] - before[0])
                turn = [(math.atan2(p[1] - here[1], p[0] - here[0]) - heading + 3 * math.pi) % (2 * math.pi) for p in options]
                here = options.pop(max(range(len(options)), key=turn.__getitem__))
            rings.append([*ring, start])
    return rings


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False)) / 2


def inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = point
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def polygons(edges: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[list[list[tuple[float, float]]]]:
    """Shells with their holes, in degrees; a hole goes to the smallest shell that contains it."""
    rings = chain(edges)
    shells = sorted((r for r in rings if signed_area(r) > 0), key=lambda r: (signed_area(r), r))
    out: list[list] = [[r] for r in shells]
    for hole in (r for r in rings if signed_area(r) < 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        for k, shell in enumerate(shells):
            if inside(middle, shell):
                out[k].append(hole)
                break
    out.sort(key=lambda p: p[0])
    return [[[(x / SNAP, y / SNAP) for x, y in ring] for ring in polygon] for polygon in out]


def cluster_boundary(clusters: DataFrame, cell_table: DataFrame) -> DataFrame:
    """(cluster, geometry): WKB Polygon for one cell, MultiPolygon for several; cells without geometry are skipped."""
    sizes = clusters.join(cell_table.select("geocode"), "geocode", "left_semi").groupBy("cluster").agg(F.count("*").alias("cells"))
    edges = outline_edges(clusters, cell_table).join(sizes, "cluster")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = polygons([((a, b), (c, d)) for a, b, c, d in zip(pdf.x0, pdf.y0, pdf.x1, pdf.y1, strict=True)])
        raw = wkb.encode_polygon(found[0]) if pdf.cells.iloc[0] == 1 else wkb.encode_multipolygon(found)
        return pd.DataFrame({"cluster": [pdf.cluster.iloc[0]], "geometry": [raw]})

    return edges.groupBy("cluster").applyInPandas(run, "cluster int, geometry binary").orderBy("cluster")
