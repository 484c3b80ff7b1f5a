"""The whole run: occurrences to regions, stage by stage."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terramosaic import defaults, schemas
from terramosaic.operators import boundary, cells, coloring, distances, export, metrics, statistics, taxa, ward
from terramosaic.sources import darwin_core, images
from terramosaic.sources.sinks import materialize, write_geojson, write_text
from terramosaic.types import Bbox


@dataclass
class Settings:
    box: Bbox = Bbox.of()
    resolution: int = defaults.GRID_RESOLUTION
    min_k: int = defaults.MIN_CLUSTERS
    max_k: int = defaults.MAX_CLUSTERS
    limit: int | None = None
    taxon: str = ""
    max_taxa: int | None = None
    min_presence: float | None = None
    reducer: str = "identity"
    permutations: int = statistics.PERMUTATIONS
    stage_dir: str | None = None


@dataclass
class Regions:
    settings: Settings
    k: int
    tables: dict[str, DataFrame]

    def geojson(self) -> str:
        return export.feature_collection(self.tables["cluster_boundary"], self.tables["cluster_color"])

    def json(self) -> str:
        t = self.tables
        return export.output_json(t["cluster_significant_differences"], t["cluster_boundary"], t["taxonomy"], t["cluster_color"], t["significant_taxa_images"])

    def save(self, geojson_path: str, json_path: str) -> None:
        write_geojson(self.geojson(), geojson_path)
        write_text(self.json(), json_path)


def run(spark: SparkSession, source: str | DataFrame, settings: Settings | None = None, resolve=None) -> Regions:
    """Regions of a source (a path, or occurrence rows). Stages are written where later ones branch from them."""
    s, t, own = settings or Settings(), {}, uuid.uuid4().hex

    def keep(name: str, df: DataFrame) -> DataFrame:
        t[name] = materialize(schemas.check(df, name) if name in schemas.STAGES else df, f"{name}-{own}", s.stage_dir)
        return t[name]

    raw = darwin_core.scan(spark, source) if isinstance(source, str) else source
    rows = darwin_core.occurrences(raw, s.box, s.limit, s.taxon)
    if s.limit is not None:
        rows = keep("darwin_core", rows)  # a limit must not be drawn twice
    all_cells = keep("geocode", cells.cells(rows, s.resolution, s.box))
    neighbors = keep("geocode_neighbors", cells.geocode_neighbors(all_cells))
    inner = cells.without_edges(all_cells)
    taxonomy = keep("taxonomy", taxa.taxonomy(rows, inner, s.resolution, s.box))
    counts = keep("geocode_taxa_counts", taxa.filter_taxa(taxa.taxa_counts(rows, inner, taxonomy, s.resolution, s.box), s.max_taxa, s.min_presence))
    inner = keep("geocode_no_edges", cells.with_counts(inner, counts))
    near = keep("geocode_neighbors_no_edges", cells.geocode_neighbors_no_edges(neighbors, inner))
    idx = keep("index", cells.index(inner))
    pairs = keep("geocode_distance", distances.geocode_distances(counts, idx, s.reducer))
    multi = keep("geocode_cluster_multi_k", ward.cluster_multi_k(pairs, cells.connectivity(near), idx, s.min_k, s.max_k))
    labels = multi.join(idx, "geocode").select("num_clusters", "i", "cluster")
    square = distances.square(pairs, idx)
    scores = keep("geocode_cluster_metrics", metrics.cluster_metrics(pairs, square, labels))
    k = metrics.choose_k(scores)
    clusters = keep("geocode_cluster", statistics.select_k(multi, k))
    around = keep("cluster_neighbors", statistics.cluster_neighbors(near, clusters))
    stats = keep("cluster_taxa_statistics", statistics.cluster_taxa_statistics(counts, clusters, taxonomy))
    found = keep("cluster_significant_differences", statistics.significant_differences(stats, around))
    keep("significant_taxa_images", images.significant_taxa_images(found, taxonomy, resolve))
    keep("cluster_boundary", boundary.cluster_boundary(clusters, inner))
    keep("cluster_color", coloring.cluster_colors(around, stats, coloring.method_for(k)))
    chosen = labels.where(F.col("num_clusters") == k)
    keep("geocode_silhouette_score", metrics.silhouette_table(square, chosen, idx))
    order = [r["cluster"] for r in chosen.orderBy("i").collect()]
    t["permanova_results"] = statistics.permanova(distances.matrix(pairs, len(order)), np.array(order), spark, s.permutations)
    return Regions(s, k, t)
