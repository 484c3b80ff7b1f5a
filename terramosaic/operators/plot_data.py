"""The data behind the plots; drawing is left to the reader."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.operators import distances as dist
from terramosaic.operators.ward import linkage_order


def heatmap(counts: DataFrame, clusters: DataFrame, statistics: DataFrame, differences: DataFrame, max_taxa: int | None = None) -> DataFrame | None:
    """(geocode, cluster, taxonId, value): a cell's share of a taxon less the overall share, min-max by taxon.

    Cells of clusters without counts show zeros; a constant taxon shows 0.5;
    None without significant taxa; a total of zero is an error.
    """
    taxa = differences.select("taxonId").distinct().orderBy("taxonId")
    taxa = taxa.limit(max_taxa) if max_taxa is not None else taxa
    if not taxa.head(1):
        return None
    if not (counts.agg(F.sum("count")).first()[0] or 0):
        raise ValueError("the counts add up to zero")
    totals = counts.groupBy("geocode").agg(F.sum("count").alias("total"))
    overall = statistics.where("cluster is null").select("taxonId", F.col("average").alias("overall"))
    grid = clusters.crossJoin(F.broadcast(taxa))
    shares = grid.join(counts, ["geocode", "taxonId"], "left").join(totals, "geocode", "left").join(overall, "taxonId", "left")
    value = F.coalesce(F.try_divide("count", "total"), F.lit(0.0)) - F.coalesce("overall", F.lit(0.0))
    raw = shares.select("geocode", "cluster", "taxonId", value.alias("v"))
    w = Window.partitionBy("taxonId")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return raw.select("geocode", "cluster", "taxonId", F.when(high == low, 0.5).otherwise((F.col("v") - low) / (high - low)).alias("value"))


def cells_without_counts(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    return clusters.join(counts.select("geocode").distinct(), "geocode", "left_anti")


def labelled(differences: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return differences.join(taxonomy, "taxonId", "left")


def heatmap_rows(pairs: DataFrame, cell_index: DataFrame) -> list[int]:
    """Cells in the order of an unconstrained Ward tree."""
    geocodes = [r["geocode"] for r in cell_index.orderBy("i").collect()]
    return [geocodes[i] for i in linkage_order(dist.matrix(pairs, len(geocodes)))]


def embedding(pairs: DataFrame, cell_index: DataFrame, clusters: DataFrame, reducer: str = "mds") -> DataFrame:
    """(geocode, x, y, cluster): the cells in two dimensions."""
    geocodes = [r["geocode"] for r in cell_index.orderBy("i").collect()]
    square = dist.matrix(pairs, len(geocodes))
    y = dist.mds(square, 2) if reducer == "mds" else dist.external(reducer, square, 2)
    rows = [(g, float(a), float(b)) for g, (a, b) in zip(geocodes, np.asarray(y).tolist(), strict=True)]
    return clusters.sparkSession.createDataFrame(rows, "geocode bigint, x double, y double").join(clusters, "geocode")


def silhouette_rows(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """Silhouettes of cells with their cluster, by cluster and falling score."""
    return table.where("geocode is not null").join(clusters, "geocode").orderBy("cluster", F.desc("silhouette_score"), "geocode")
