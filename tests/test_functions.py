"""Grid, colours, WKB, Fisher: values known from elsewhere, and invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramosaic.functions import colors, fisher, grid, wkb
from terramosaic.types import Bbox


def test_fisher_published_values():
    assert fisher.two_sided(6, 2, 1, 4) == pytest.approx(0.10256410256410257, rel=1e-9)
    assert fisher.two_sided(8, 2, 1, 5) == pytest.approx(0.034965034965034975, rel=1e-9)
    assert fisher.two_sided(5, 0, 5, 0) == 1.0
    assert fisher.two_sided(3, 7, 7, 3) == pytest.approx(fisher.two_sided(7, 3, 3, 7))  # symmetric tables tie exactly


def test_palette_and_darken():
    assert colors.palette(2) == ["#febf5a", "#f43d25"]
    assert colors.palette(3) == ["#fed976", "#fd8c3c", "#e2191c"]
    assert colors.darken("#ff0000") == colors.darken("#f00") == "#7f0000"
    with pytest.raises(ValueError):
        colors.darken("#12345")


def test_darken_column(spark):
    df = spark.createDataFrame([("#ff8000",), ("#0f0",), (None,)], "c string")
    out = [r[0] for r in df.select(colors.darken_column(F.col("c"))).collect()]
    assert out == [colors.darken("#ff8000"), colors.darken("#0f0"), None]
    with pytest.raises(Exception, match="not a hex"):
        spark.createDataFrame([("#xyz",)], "c string").select(colors.darken_column(F.col("c"))).collect()


def test_wkb_round_trip():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    point = wkb.encode_point(-122.4, 37.8)
    assert len(point) == 21 and wkb.decode(point) == ("Point", [-122.4, 37.8])
    assert wkb.decode(wkb.encode_polygon([ring, ring])) == ("Polygon", [[list(p) for p in ring]] * 2)
    assert wkb.decode(wkb.encode_multipolygon([[ring], [ring]]))[0] == "MultiPolygon"


def test_grid_null_and_range(spark):
    rows = [(37.77, -122.42), (-33.87, 151.21), (0.0, 0.0), (51.5, -0.12), (None, 10.0), (90.0, None), (91.0, 0.0)]
    out = [r[0] for r in spark.createDataFrame(rows, "lat double, lng double").transform(grid.with_cell, "lat", "lng", 4).select("geocode").collect()]
    assert all(x is not None for x in out[:4]) and out[4:] == [None] * 3
    with pytest.raises(ValueError):
        grid.cell_sql("lat", "lng", 16)


@pytest.mark.parametrize("res", [0, 2, 4, 6])
def test_grid_centre_is_in_its_own_cell(spark, res):
    rng = np.random.default_rng(res)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-80, 80, 300), rng.uniform(-175, 175, 300))]
    cells = grid.with_cell(spark.createDataFrame(rows, "lat double, lng double"), "lat", "lng", res).select("geocode")
    centres = grid.with_geometry(cells, res, Bbox.of()).select("geocode", "center.lat", "center.lng")
    back = grid.with_cell(centres, "lat", "lng", res, "again").where("abs(lat) < 89 and abs(lng) < 179")
    assert grid.with_cell(centres, "lat", "lng", res, "again").where(f"again <> {grid.cell_sql('lat', 'lng', res)}").count() == 0
    assert back.where("geocode <> again").count() == 0


def test_neighbours_are_mutual_and_adjacent(spark):
    one = grid.with_cell(spark.createDataFrame([(37.0, -80.0)], "lat double, lng double"), "lat", "lng", 4).select("geocode")
    ring = one.select("geocode", F.explode(grid.neighbors("geocode")).alias("n"))
    back = ring.select("geocode", F.explode(grid.neighbors("n")).alias("b")).where("geocode = b")
    assert ring.count() == 6 and back.count() == 6
    near = grid.with_geometry(ring.select(F.col("n")), 4, Bbox.of(), "n").select("n", F.col("boundary").alias("y"))
    corners = grid.with_geometry(ring, 4, Bbox.of()).select("n", F.col("boundary").alias("x")).join(near, "n").collect()
    for r in corners:  # a shared side: two corners in common
        a, b = ({(round(p["lng"], 9), round(p["lat"], 9)) for p in ring_} for ring_ in (r["x"], r["y"]))
        assert len(a & b) == 2


def test_edge_flag(spark):
    res = 3
    cells = spark.createDataFrame([(float(a), float(b)) for a in range(25, 46) for b in range(-95, -64)], "lat double, lng double")
    box = Bbox.of(30.0, 40.0, -90.0, -70.0)
    rows = grid.with_geometry(grid.with_cell(cells, "lat", "lng", res).select("geocode").distinct(), res, box).select(F.col("is_edge").alias("e"), F.col("boundary").alias("b")).collect()
    for r in rows:
        xs, ys = [p["lng"] for p in r["b"]], [p["lat"] for p in r["b"]]
        inside = min(xs) > -90 and max(xs) < -70 and min(ys) > 30 and max(ys) < 40
        apart = max(xs) < -90 or min(xs) > -70 or max(ys) < 30 or min(ys) > 40
        if inside or apart:
            assert not r["e"]
        elif any(-90 <= x <= -70 and 30 <= y <= 40 for x, y in zip(xs, ys)):
            assert r["e"]


def test_geometry_json(spark):
    raw = spark.createDataFrame([(bytearray(wkb.encode_point(1.5, 2.5)),), (None,)], "w binary")
    out = [r[0] for r in raw.select(wkb.geometry_json("w")).collect()]
    assert json.loads(out[0]) == {"type": "Point", "coordinates": [1.5, 2.5]} and out[1] is None
    assert math.isclose(grid.edge_km(0) ** 2 * 1.5 * math.sqrt(3) * 122, 4 * math.pi * grid.EARTH_KM**2)
