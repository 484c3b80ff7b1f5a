"""The columns of every stage table, and the check that a stage keeps its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT = "struct<lng:double,lat:double>"

STAGES: dict[str, str] = {
    "darwin_core": "decimalLatitude double, decimalLongitude double, scientificName string, taxonKey bigint, individualCount int",
    "geocode": f"geocode bigint, center {POINT}, boundary array<{POINT}>, is_edge boolean",
    "geocode_neighbors": "geocode bigint, direct_neighbors array<bigint>, direct_and_indirect_neighbors array<bigint>",
    "taxonomy": "taxonId bigint, scientificName string, gbifTaxonId bigint",
    "geocode_taxa_counts": "geocode bigint, taxonId bigint, count bigint",
    "geocode_cluster_multi_k": "geocode bigint, num_clusters int, cluster int",
    "geocode_cluster": "geocode bigint, cluster int",
    "cluster_neighbors": "cluster int, direct_neighbors array<int>, direct_and_indirect_neighbors array<int>",
    "cluster_taxa_statistics": "cluster int, taxonId bigint, count bigint, average double",
    "cluster_boundary": "cluster int, geometry binary",
    "cluster_color": "cluster int, color string, darkened_color string",
    "geocode_silhouette_score": "geocode bigint, silhouette_score double, num_clusters int",
    "significant_taxa_images": "taxonId bigint, image_url string",
}


def check(df: DataFrame, stage: str) -> DataFrame:
    """The frame itself; an error if its names or types differ from the stage's (nullability aside)."""
    want = T.StructType.fromDDL(STAGES[stage])
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    if have != [(f.name, f.dataType.simpleString()) for f in want]:
        raise ValueError(f"{stage}: expected {want.simpleString()}, got {df.schema.simpleString()}")
    return df
