"""GeoJSON and JSON documents of the regions; a row a cluster, so small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.functions.wkb import geometry_json

TAXON_FIELDS = ("scientific_name", "gbif_taxon_id", "taxon_id", "log2_fold_change", "cluster_count", "neighbor_count", "high_log2_high_count_score", "low_log2_high_count_score", "image_url")
KEEP_NULLS = {"ignoreNullFields": "false"}


def features(boundary: DataFrame, color: DataFrame) -> DataFrame:
    """(cluster, feature): a GeoJSON feature for each cluster with a boundary and a colour."""
    joined = boundary.join(color, "cluster")
    properties = F.to_json(F.struct(F.col("darkened_color").alias("color"), F.col("color").alias("fillColor"), F.lit(0.7).cast("double").alias("fillOpacity"), F.lit(1).alias("weight"), F.col("cluster").alias("cluster")))
    return joined.select("cluster", F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry_json("geometry"), F.lit("}")).alias("feature"))


def feature_collection(boundary: DataFrame, color: DataFrame) -> str:
    """The collection as text, features by cluster."""
    rows = features(boundary, color).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "feature"))), lambda r: r["feature"]), ",").alias("all")).first()
    return f'{{"type":"FeatureCollection","features":[{rows["all"] or ""}]}}'


def significant_taxa(differences: DataFrame, taxonomy: DataFrame, images: DataFrame) -> DataFrame:
    """(cluster, and the fields of a significant taxon); taxa outside the taxonomy are dropped, a missing image is null."""
    joined = differences.join(taxonomy, "taxonId").join(images, "taxonId", "left")
    return joined.select("cluster", F.col("scientificName").alias("scientific_name"), F.col("gbifTaxonId").alias("gbif_taxon_id"), F.col("taxonId").alias("taxon_id"), *TAXON_FIELDS[3:])


def cluster_documents(differences: DataFrame, boundary: DataFrame, taxonomy: DataFrame, color: DataFrame, images: DataFrame) -> DataFrame:
    """(cluster, document): the front end's JSON object of each cluster with a boundary and a colour."""
    taxa = significant_taxa(differences, taxonomy, images).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(F.col("taxon_id").alias("_order"), F.struct(*TAXON_FIELDS).alias("taxon")))).alias("_taxa"))
    joined = boundary.join(color, "cluster").join(taxa, "cluster", "left")
    listed = F.coalesce(F.to_json(F.transform("_taxa", lambda t: t["taxon"]), KEEP_NULLS), F.lit("[]"))
    head = F.concat(F.lit('{"cluster":'), F.col("cluster").cast("string"), F.lit(',"boundary":'), geometry_json("geometry"), F.lit(',"significant_taxa":'), listed)
    return joined.select("cluster", F.concat(head, F.lit(',"color":"'), "color", F.lit('","darkened_color":"'), "darkened_color", F.lit('"}')).alias("document"))


def output_json(*frames: DataFrame) -> str:
    rows = cluster_documents(*frames).orderBy("cluster").collect()
    return "[" + ",".join(r["document"] for r in rows) + "]"


def envelope(cell_table: DataFrame) -> DataFrame:
    """The box around all boundaries."""
    points = cell_table.select(F.explode("boundary").alias("p"))
    return points.agg(F.min("p.lng").alias("west"), F.min("p.lat").alias("south"), F.max("p.lng").alias("east"), F.max("p.lat").alias("north"))


def with_images(taxa: DataFrame) -> DataFrame:
    return taxa.where(F.col("image_url").isNotNull())


SORTS = {
    "count": lambda: [F.desc("cluster_count"), F.asc("taxonId")],
    "p_value": lambda: [F.asc("p_value"), F.asc("taxonId")],
    "fold_change": lambda: [F.abs("log2_fold_change").desc(), F.asc("taxonId")],
    "high_score": lambda: [F.desc("high_log2_high_count_score"), F.asc("taxonId")],
    "low_score": lambda: [F.desc("low_log2_high_count_score"), F.asc("taxonId")],
}


def sorted_taxa(differences: DataFrame, by: str) -> DataFrame:
    return differences.orderBy(*SORTS[by]())
