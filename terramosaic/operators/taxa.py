"""Taxonomy, counts of taxa by cell, and the filter on taxa.

The two large stages are one plan each: a scan with pushed filters, a native
cell expression, a semi join with the cells, and a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.operators.occurrences import in_cells
from terramosaic.types import Bbox


def taxonomy(occurrences: DataFrame, cell_table: DataFrame, res: int, box: Bbox) -> DataFrame:
    """Distinct (scientificName, taxonKey) seen in the cells, numbered from 0 by name and key.

    The number is a window over distinct taxa, a small set next to the rows.
    """
    seen = in_cells(occurrences, box, res).join(cell_table.select("geocode"), "geocode", "left_semi")
    pairs = seen.select("scientificName", F.col("taxonKey").alias("gbifTaxonId")).distinct()
    number = (F.row_number().over(Window.orderBy("scientificName", "gbifTaxonId")) - 1).cast("bigint")
    return pairs.select(number.alias("taxonId"), "scientificName", "gbifTaxonId")


def taxa_counts(occurrences: DataFrame, cell_table: DataFrame, taxa: DataFrame, res: int, box: Bbox) -> DataFrame:
    """Individuals by (cell, taxon); a missing count is one; null names or keys match no taxon.

    Rows are added up by cell, name and key before the taxonomy is joined, so
    the join sees the reduced table.
    """
    seen = in_cells(occurrences, box, res).join(cell_table.select("geocode"), "geocode", "left_semi")
    sums = seen.groupBy("geocode", "scientificName", F.col("taxonKey").alias("gbifTaxonId")).agg(F.sum(F.coalesce("individualCount", F.lit(1))).cast("bigint").alias("count"))
    return sums.join(taxa, ["scientificName", "gbifTaxonId"]).select("geocode", "taxonId", "count")


def filter_taxa(counts: DataFrame, max_taxa: int | None = None, min_presence: float | None = None) -> DataFrame:
    """Taxa in at least int(cells * min_presence) cells, then the max_taxa with the most individuals (ties: smaller id)."""
    if min_presence is not None:
        needed = counts.select(F.floor(F.countDistinct("geocode") * F.lit(float(min_presence)) + F.lit(1e-9)).alias("needed"))
        present = counts.groupBy("taxonId").agg(F.countDistinct("geocode").alias("n")).join(F.broadcast(needed), F.col("n") >= F.col("needed"))
        counts = counts.join(present.select("taxonId"), "taxonId", "left_semi").select("geocode", "taxonId", "count")
    if max_taxa is not None:
        top = counts.groupBy("taxonId").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "taxonId").limit(max_taxa)
        counts = counts.join(top.select("taxonId"), "taxonId", "left_semi").select("geocode", "taxonId", "count")
    return counts
