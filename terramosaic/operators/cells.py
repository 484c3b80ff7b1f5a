"""Cell tables and adjacency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.functions import grid
from terramosaic.operators.occurrences import in_cells
from terramosaic.shipping import shared_folder
from terramosaic.types import Bbox

#: Cells up to which components are found and linked on the driver (a row a cell, six edges a cell).
DRIVER_CELLS = 50_000
FULL = len(grid.STEPS)


def cells(occurrences: DataFrame, res: int, box: Bbox) -> DataFrame:
    """Distinct cells with centre, closed boundary ring and edge flag; geometry only after the distinct."""
    found = in_cells(occurrences, box, res).select("geocode").distinct()
    return grid.with_geometry(found, res, box).select("geocode", "center", "boundary", "is_edge")


def without_edges(cell_table: DataFrame) -> DataFrame:
    return cell_table.where(~F.col("is_edge"))


def with_counts(cell_table: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells that still have counts."""
    return cell_table.join(counts.select("geocode").distinct(), "geocode", "left_semi")


def index(cell_table: DataFrame) -> DataFrame:
    """(geocode, i): the one row order that matrices, adjacency and labels share."""
    return cell_table.select("geocode", (F.row_number().over(Window.orderBy("geocode")) - 1).cast("int").alias("i"))


def position(cell_table: DataFrame, geocode: int) -> int:
    """Row position of a cell; KeyError if it is not there."""
    row = index(cell_table).where(F.col("geocode") == geocode).head(1)
    if not row:
        raise KeyError(geocode)
    return row[0]["i"]


def adjacency(cell_table: DataFrame) -> DataFrame:
    """(geocode, direct_neighbors): ring neighbours that are cells of the table; isolated cells keep an empty array."""
    known = cell_table.select("geocode")
    pairs = known.select("geocode", F.explode(grid.neighbors("geocode")).alias("neighbor"))
    pairs = pairs.join(known.withColumnRenamed("geocode", "neighbor"), "neighbor", "left_semi")
    lists = pairs.groupBy("geocode").agg(F.array_sort(F.collect_list("neighbor")).alias("direct_neighbors"))
    return known.join(lists, "geocode", "left").select("geocode", F.coalesce("direct_neighbors", F.array().cast("array<bigint>")).alias("direct_neighbors"))


def edges(neighbors: DataFrame, column: str = "direct_and_indirect_neighbors") -> DataFrame:
    """Undirected edges (a < b)."""
    pairs = neighbors.select(F.col("geocode").alias("x"), F.explode(column).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def local_components(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of the (ascending) nodes reaches; edges to other nodes are ignored."""
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    known = (x < len(nodes)) & (y < len(nodes))
    x, y = x[known], y[known]
    known = (nodes[x] == a[known]) & (nodes[y] == b[known])
    x, y, label = x[known], y[known], np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return nodes[label]


def components(nodes: DataFrame, edge_table: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(geocode, component): the smallest cell that each one reaches.

    Up to DRIVER_CELLS cells and ten edges a cell the graph is labelled on the
    driver; a larger one by min-label rounds with pointer jumps, which give the same.
    """
    found = nodes.select("geocode").distinct().limit(DRIVER_CELLS + 1).toArrow().column("geocode").to_numpy()
    if len(found) <= DRIVER_CELLS:
        pairs = edge_table.select("a", "b").limit(10 * DRIVER_CELLS + 1).toArrow()
        if pairs.num_rows <= 10 * DRIVER_CELLS:
            found = np.sort(found)
            labels = local_components(found, pairs.column("a").to_numpy(), pairs.column("b").to_numpy())
            return nodes.sparkSession.createDataFrame(pa.table({"geocode": pa.array(found, pa.int64()), "component": pa.array(labels, pa.int64())}))
    return spread_components(nodes, edge_table, max_rounds)


def spread_components(nodes: DataFrame, edge_table: DataFrame, max_rounds: int = 100) -> DataFrame:
    """As components(), in distributed rounds."""
    labels = nodes.select("geocode", F.col("geocode").alias("component"))
    labels, edge_table = cut(labels), cut(edge_table)
    both = edge_table.select("a", "b").union(edge_table.select(F.col("b").alias("a"), F.col("a").alias("b")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("geocode", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, labels["geocode"] == near["a"], "left").select("geocode", F.col("component").alias("before"), F.least("component", "low").alias("component"))
        jump = step.select(F.col("geocode").alias("component"), F.col("component").alias("further"))
        fresh = step.join(jump, "component").select("geocode", "before", F.col("further").alias("component"))
        fresh = cut(fresh)
        changed = fresh.where("component <> before").limit(1).count()
        labels = fresh.select("geocode", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration with a reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def component_links(rows: list[tuple[int, float, float, int, int]]) -> list[tuple[int, int]]:
    """Edges that join all components, each the nearest pair of cells between what is joined and the rest.

    ``rows`` are (geocode, lng, lat, component, direct degree) in table order.
    Starting from the first row's component, the nearest pair is added until one
    component is left; a cell of the far side with a full ring is no target.
    Ties go to the earlier rows. An error if no pair is left.
    """
    geo = [r[0] for r in rows]
    xy = np.array([r[1:3] for r in rows], float).reshape(-1, 2)
    component = np.array([r[3] for r in rows])
    target = np.array([r[4] < FULL for r in rows])
    best, source = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
    joined = np.zeros(len(rows), bool)
    links: list[tuple[int, int]] = []
    fresh = np.flatnonzero(component == component[0]) if len(rows) else np.zeros(0, np.int64)
    while len(fresh):
        joined[fresh] = True
        for i in fresh.tolist():
            d = ((xy - xy[i]) ** 2).sum(axis=1)
            better = (d < best) | ((d == best) & (i < source))
            best[better], source[better] = d[better], i
        if joined.all():
            break
        options = np.flatnonzero(~joined & target)
        if not len(options):
            raise ValueError("no pair of cells can join the components")
        pick = options[np.lexsort((options, source[options], best[options]))[0]]
        links.append((geo[source[pick]], geo[pick]))
        fresh = np.flatnonzero(component == component[pick])
    return links


def connected(neighbors: DataFrame, cell_table: DataFrame) -> DataFrame:
    """Add indirect neighbours so that the graph has one component.

    Components come from the direct lists; the pairs that join them are found on
    the driver, for at most DRIVER_CELLS cells. More are refused only if there
    is something to join.
    """
    cell_table, neighbors = cut(cell_table), cut(neighbors)
    labels = components(cell_table, edges(neighbors, "direct_neighbors"))
    if labels.select("component").distinct().count() <= 1:
        links = []
    elif (n := cell_table.count()) > DRIVER_CELLS:
        raise ValueError(f"{n} cells are too many to link on the driver; use a coarser grid")
    else:
        found = cell_table.join(labels, "geocode").join(neighbors.select("geocode", F.size("direct_neighbors").alias("degree")), "geocode")
        rows = found.select("geocode", "center.lng", "center.lat", "component", "degree").orderBy("geocode").collect()
        links = component_links([tuple(r) for r in rows])
    both = sorted([(a, b) for a, b in links] + [(b, a) for a, b in links])
    spark = neighbors.sparkSession
    more = spark.createDataFrame(both, "geocode bigint, other bigint").groupBy("geocode").agg(F.array_sort(F.collect_list("other")).alias("_more"))
    start = F.col("direct_and_indirect_neighbors") if "direct_and_indirect_neighbors" in neighbors.columns else F.col("direct_neighbors")
    return neighbors.join(more, "geocode", "left").select("geocode", "direct_neighbors", F.concat(start, F.coalesce("_more", F.array().cast("array<bigint>"))).alias("direct_and_indirect_neighbors"))


def geocode_neighbors(cell_table: DataFrame) -> DataFrame:
    return connected(adjacency(cell_table), cell_table)


def with_indirect_edge(neighbors: DataFrame, a: int, b: int) -> DataFrame:
    """Append b to a's list and a to b's."""
    column = F.col("direct_and_indirect_neighbors")
    return neighbors.withColumn("direct_and_indirect_neighbors", F.when(F.col("geocode") == a, F.concat(column, F.array(F.lit(b).cast("bigint")))).when(F.col("geocode") == b, F.concat(column, F.array(F.lit(a).cast("bigint")))).otherwise(column))


def restricted(neighbors: DataFrame, cell_table: DataFrame) -> DataFrame:
    """Neighbour lists cut down to the cells of a table."""
    known = cell_table.select("geocode")
    out = neighbors.join(known, "geocode", "left_semi")
    for column in ("direct_neighbors", "direct_and_indirect_neighbors"):
        pairs = out.select("geocode", F.posexplode(column).alias("at", "other")).join(known.withColumnRenamed("geocode", "other"), "other", "left_semi")
        lists = pairs.groupBy("geocode").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "other"))), lambda p: p["other"]).alias("_list"))
        out = out.join(lists, "geocode", "left").withColumn(column, F.coalesce("_list", F.array().cast("array<bigint>"))).drop("_list")
    return out


def geocode_neighbors_no_edges(neighbors: DataFrame, cell_table: DataFrame) -> DataFrame:
    """Neighbours among the given cells, joined to one component again, by cell."""
    return connected(restricted(neighbors, cell_table), cell_table).orderBy("geocode")


def connectivity(neighbors: DataFrame) -> DataFrame:
    """Edge table (i < j) in index order; an error unless there is one component."""
    neighbors = cut(neighbors)
    edge_table = edges(neighbors)
    if components(neighbors.select("geocode"), edge_table).select("component").distinct().count() > 1:
        raise ValueError("the neighbour graph has more than one component")
    idx = index(neighbors)
    return edge_table.join(idx.select(F.col("geocode").alias("a"), F.col("i").alias("x")), "a").join(idx.select(F.col("geocode").alias("b"), F.col("i").alias("y")), "b").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
