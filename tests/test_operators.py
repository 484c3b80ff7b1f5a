"""Published fixtures of the operators, brute-force checks, and plans."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramosaic import standin
from terramosaic.operators import boundary, cells, coloring, distances, export, metrics, statistics, taxa, ward
from terramosaic.functions import wkb
from terramosaic.sources import darwin_core
from terramosaic.types import Bbox

COUNTS = [(1000, 0, 5), (1000, 1, 4), (2000, 0, 3), (2000, 1, 2), (2000, 2, 8), (3000, 0, 2), (3000, 2, 4), (3000, 3, 3)]


@pytest.mark.parametrize(("top", "presence", "kept"), [(None, None, {0, 1, 2, 3}), (2, None, {0, 2}), (1, None, {2}), (None, 0.67, {0, 1, 2}), (None, 1.0, {0}), (2, 0.67, {0, 2})])
def test_filter_taxa(spark, top, presence, kept):
    counts = spark.createDataFrame(COUNTS, "geocode bigint, taxonId bigint, count bigint")
    assert {r["taxonId"] for r in taxa.filter_taxa(counts, top, presence).collect()} == kept


def test_statistics_fixture(spark):
    counts = spark.createDataFrame([(1000, 0, 5), (1000, 1, 3), (2000, 0, 2), (2000, 2, 8), (3000, 2, 4), (3000, 3, 6)], "geocode bigint, taxonId bigint, count bigint")
    clusters = spark.createDataFrame([(1000, 0), (2000, 0), (3000, 1)], "geocode bigint, cluster int")
    taxonomy = spark.createDataFrame([(i, f"t{i}", i) for i in range(4)], "taxonId bigint, scientificName string, gbifTaxonId bigint")
    rows = {(r["cluster"], r["taxonId"]): r for r in statistics.cluster_taxa_statistics(counts, clusters, taxonomy).collect()}
    assert rows[0, 0]["count"] == 7 and rows[0, 0]["average"] == pytest.approx(7 / 18)
    assert rows[None, 2]["count"] == 12


def test_significant_differences_fixture(spark):
    rows = [(1, 101, 50), (1, 102, 20), (1, 103, 4), (2, 101, 4), (2, 102, 5), (2, 103, 50)]
    stats = spark.createDataFrame([(c, t, n, n / 74) for c, t, n in rows], "cluster int, taxonId bigint, count bigint, average double")
    near = spark.createDataFrame([(1, [2], [2]), (2, [1], [1])], "cluster int, direct_neighbors array<int>, direct_and_indirect_neighbors array<int>")
    found = statistics.significant_differences(stats, near).collect()
    assert len(found) == 2 and {r["taxonId"] for r in found} == {102}


def test_metrics_values():
    assert metrics.elbow([1, 2, 3, 4, 5, 6], [100, 50, 20, 18, 17, 16]) == 3
    assert metrics.elbow([1, 2, 3, 4, 5], [50, 40, 30, 20, 10]) is None
    assert metrics.elbow([2, 3, 4, 5, 6, 7], [90, 100, 50, 20, 18, 17]) == 2
    assert metrics.elbow([2, 3, 4, 5, 6, 7, 8], [1000, 600, 350, 280, 250, 230, 215]) in {3, 4, 5}


def test_silhouette_of_tight_pairs(spark):
    pairs = [(i, j, 0.1 if i // 2 == j // 2 else 2.5) for i, j in itertools.combinations(range(6), 2)]
    p = spark.createDataFrame(pairs, "i int, j int, d double")
    ids = spark.createDataFrame([(i,) for i in range(6)], "i int")
    labels = spark.createDataFrame([(3, i, i // 2) for i in range(6)], "num_clusters int, i int, cluster int")
    out = metrics.silhouettes(distances.square(p, ids), labels).collect()
    assert len(out) == 6 and all(r["silhouette_score"] > 0.9 for r in out)


def test_davies_bouldin_value(spark):
    """Rows (0,1), (1,1), (3,4) with labels 0, 0, 1, given as features in long form."""
    points = [(0, 1), (1, 1), (3, 4)]
    square = spark.createDataFrame([(i, j, float(v)) for i, p in enumerate(points) for j, v in enumerate(p)], "i int, j int, d double")
    labels = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (2, 2, 1)], "num_clusters int, i int, cluster int")
    assert metrics.davies_bouldin(square, labels).first()[1] == pytest.approx(0.12803687993289598)


def test_bray_curtis(spark):
    rows = [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.0), (2, 1, 0.0), (3, 0, 0.0), (3, 1, 0.0)]
    out = {(r["a"], r["b"]): r["distance"] for r in distances.bray_curtis(spark.createDataFrame(rows, "r int, f int, v double"), "r", "f", "v").collect()}
    assert out[0, 1] == 1 and out[2, 3] == 1 and out[0, 2] == 1


def test_permanova_fixture(spark):
    square = np.where(np.add.outer(np.arange(6) // 3, -(np.arange(6) // 3)) == 0, 0.1, 0.9)
    np.fill_diagonal(square, 0)
    row = statistics.permanova(square, np.array([0, 0, 0, 1, 1, 1]), spark, 199).first()
    assert row["test_statistic"] == pytest.approx(241) and 0.02 < row["p_value"] < 0.25
    ones = 1 - np.eye(4)
    assert statistics.permanova(ones, np.array([0, 0, 1, 1]), spark, 0).first()["test_statistic"] == pytest.approx(1)
    for bad in ([0] * 4, [0, 1, 2, 3]):
        with pytest.raises(ValueError):
            statistics.permanova(ones, np.array(bad), spark, 1)


def test_ward_path_graph_and_grid():
    path = np.abs(np.subtract.outer(np.arange(6), np.arange(6))).astype(float)
    edges = np.array([(i, i + 1) for i in range(5)])
    labels = ward.cut(2, ward.tree(path, edges), 6)
    assert np.count_nonzero(np.diff(labels)) == 1
    points = np.array([(x, y) for x in range(4) for y in range(5)], float)
    square = np.linalg.norm(points[:, None] - points[None], axis=2)
    grid_edges = np.array([(a, b) for a, b in itertools.combinations(range(20), 2) if np.abs(points[a] - points[b]).sum() == 1])
    children = ward.tree(square, grid_edges)
    for k in range(2, 7):
        labels = ward.cut(k, children, 20)
        assert set(labels) == set(range(k))
        for c in range(k):  # every cluster is connected
            own, seen, todo = set(np.flatnonzero(labels == c)), set(), []
            todo = [next(iter(own))]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [y for a, b in grid_edges for y in ((b,) if a == x else (a,) if b == x else ()) if y in own and y not in seen]
            assert seen == own


def test_ward_range_errors(spark):
    for low, high in ((1, 3), (4, 3)):
        with pytest.raises(ValueError):
            ward.cluster_multi_k(None, None, None, low, high)


def test_component_links_join_all():
    rows = [(10, 0.0, 0.0, 10, 1), (11, 1.0, 0.0, 10, 1), (20, 5.0, 0.0, 20, 1), (21, 6.0, 0.0, 20, 1), (30, 3.0, 0.0, 30, 0)]
    assert cells.component_links(rows) == [(11, 30), (30, 20)]
    with pytest.raises(ValueError):
        cells.component_links([(1, 0.0, 0.0, 1, 1), (2, 1.0, 0.0, 2, 6)])


def test_indirect_edge_keeps_ids_exact(spark):
    a, b = 595148721944002559, 595148996821909504
    df = spark.createDataFrame([(a, [], []), (b, [], [])], "geocode bigint, direct_neighbors array<bigint>, direct_and_indirect_neighbors array<bigint>")
    out = {r["geocode"]: r["direct_and_indirect_neighbors"] for r in cells.with_indirect_edge(df, a, b).collect()}
    assert out == {a: [b], b: [a]}


def test_coloring_differs_between_neighbours():
    graph = {1: [2, 3, 4], 2: [1, 3], 3: [1, 2, 4], 4: [1, 3]}
    found = coloring.greedy(graph)
    assert all(found[a] != found[b] for a, around in graph.items() for b in around)


def test_dissolve_with_hole_and_feature_collection(spark):
    def box(x, y):
        return [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]

    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [(i, [{"lng": float(a), "lat": float(b)} for a, b in box(x, y)]) for i, (x, y) in enumerate([*ring, (9, 9)])]
    table = spark.createDataFrame(rows, "geocode bigint, boundary array<struct<lng:double,lat:double>>")
    clusters = spark.createDataFrame([(i, 0) for i in range(8)] + [(8, 1)], "geocode bigint, cluster int")
    out = boundary.cluster_boundary(clusters, table)
    shapes = {r["cluster"]: wkb.decode(bytes(r["geometry"])) for r in out.collect()}
    assert shapes[0][0] == "MultiPolygon" and len(shapes[0][1]) == 1 and len(shapes[0][1][0]) == 2
    assert shapes[1][0] == "Polygon"
    area = sum(boundary.signed_area([tuple(p) for p in r]) for r in shapes[0][1][0])
    assert area == pytest.approx(8)
    color = spark.createDataFrame([(0, "#ff0000", "#7f0000"), (1, "#00ff00", "#007f00"), (2, "#0000ff", "#00007f")], coloring.SCHEMA)
    collection = json.loads(export.feature_collection(out, color))
    assert [f["properties"]["cluster"] for f in collection["features"]] == [0, 1]
    assert collection["features"][0]["properties"] == {"color": "#7f0000", "fillColor": "#ff0000", "fillOpacity": 0.7, "weight": 1, "cluster": 0}


def test_chain_keeps_rings_that_touch_apart():
    a = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    b = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    edges = [*itertools.pairwise(a), *itertools.pairwise(b)]
    assert sorted(len(r) for r in boundary.chain(edges)) == [5, 5]


def test_percentiles_with_implicit_zeros(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for f in range(40):
        m = int(rng.integers(1, 12))
        v = rng.integers(1, 20, m)
        rows += [(f, int(x)) for x in v]
        want[f] = np.quantile(np.concatenate([np.zeros(12 - m), v]), [0.25, 0.5, 0.75])
    out = distances.implicit_percentiles(spark.createDataFrame(rows, "f int, v int"), "f", "v", 12)
    for r in out.collect():
        assert [r["p0"], r["p1"], r["p2"]] == pytest.approx(list(want[r["f"]]))


META = """<archive xmlns="http://rs.tdwg.org/dwc/text/"><core encoding="UTF-8" fieldsTerminatedBy="\\t" fieldsEnclosedBy="" ignoreHeaderLines="1"><files><location>occurrence.txt</location></files><id index="0"/><field index="0" term="http://rs.gbif.org/terms/1.0/gbifID"/><field index="2" term="http://rs.tdwg.org/dwc/terms/decimalLatitude"/><field default="WGS84" term="http://rs.tdwg.org/dwc/terms/geodeticDatum"/></core></archive>"""


def test_archive(spark, tmp_path):
    meta = darwin_core.parse_descriptor(META)
    assert (meta.location, meta.has_header, meta.separator, meta.quote, meta.columns, meta.defaults) == ("occurrence.txt", True, "\t", "", ("gbifID", "col_1", "decimalLatitude"), {"geodeticDatum": "WGS84"})
    (tmp_path / "meta.xml").write_text(META)
    (tmp_path / "occurrence.txt").write_text('gbifID\tx\tdecimalLatitude\n1\ta "quoted\t2.5\n')
    rows = darwin_core.scan(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("1", 'a "quoted', 2.5, "WGS84")]
    with pytest.raises(FileNotFoundError):
        darwin_core.scan_archive(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        darwin_core.parse_descriptor("<archive><core><files/></core></archive>")


def test_rename_keeps_unknown_and_makes_none(spark):
    df = spark.createDataFrame([], "decimallatitude double, taxonkey int, other_column string")
    assert darwin_core.rename_standard(df).columns == ["decimalLatitude", "taxonKey", "other_column"]


def test_box_filter_is_inclusive_and_drops_nulls(spark):
    df = spark.createDataFrame([(0.0, -130.0), (60.0, 20.0), (61.0, 0.0), (None, 1.0), (1.0, None)], "decimalLatitude double, decimalLongitude double")
    from terramosaic.operators.occurrences import in_box

    assert in_box(df, Bbox.of(0.0, 60.0, -130.0, 20.0)).count() == 2


def test_flagship_plan(spark):
    """The large path: pushed filters, a semi join, partial aggregates, no Python worker."""
    plan = standin.counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "LeftSemi" in plan and "Python" not in plan and "ArrowEval" not in plan


def test_stream_counts_equal_batch(spark, tmp_path):
    from terramosaic.streaming.counts import stream_counts, totals

    sf = "/root/testdata/sf0.001"
    rows = standin.occurrences(spark, sf)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    inner = standin.inner_cells(spark, sf)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_counts(stream, inner, standin.RES, standin.BOX, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    streamed = totals(spark, str(tmp_path / "out")).agg(F.sum("count"), F.count("*")).first()
    batch = standin.counts(spark, sf).agg(F.sum("count"), F.count("*")).first()
    assert tuple(streamed) == tuple(batch)


def test_whole_run(spark, tmp_path):
    from terramosaic.plans.regions import Settings, run

    rows = standin.occurrences(spark, "/root/testdata/sf0.001")
    out = run(spark, rows, Settings(box=standin.BOX, resolution=2, max_k=5, permutations=19, stage_dir=str(tmp_path)))
    assert 2 <= out.k <= 5
    assert out.tables["geocode_cluster"].select("cluster").distinct().count() == out.k
    assert len(json.loads(out.geojson())["features"]) == out.k
    assert len(json.loads(out.json())) == out.k
