"""Image links of taxa from a pluggable resolver."""

from __future__ import annotations

import json
import logging
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

#: Given outside taxon ids, a map from id to image link.
Resolver = Callable[[Iterable[int]], dict[int, str]]


def from_table(images: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Resolver over a table (gbifTaxonId, image_url); one link a taxon, joined where the data lies."""
    one = images.where(F.col("image_url").isNotNull()).groupBy("gbifTaxonId").agg(F.min("image_url").alias("image_url"))
    return lambda taxa: taxa.join(one, "gbifTaxonId", "left").select("taxonId", "image_url")


def sparql_resolver(endpoint: str, agent: str, timeout: float = 30.0) -> Resolver:
    """Opt-in lookup by HTTP POST; a failure is logged and gives no links."""

    def resolve(ids: Iterable[int]) -> dict[int, str]:
        values = " ".join(f'"{int(i)}"' for i in sorted(set(ids)))
        query = f"SELECT ?taxon (SAMPLE(?image) AS ?link) WHERE {{ VALUES ?taxon {{ {values} }} ?item wdt:P846 ?taxon . OPTIONAL {{ ?item wdt:P18 ?image . }} }} GROUP BY ?taxon"
        request = urllib.request.Request(endpoint, urllib.parse.urlencode({"query": query, "format": "json"}).encode(), {"User-Agent": agent, "Accept": "application/sparql-results+json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                rows = json.load(reply)["results"]["bindings"]
        except (OSError, ValueError, KeyError) as error:
            logger.warning("image lookup failed: %s", error)
            return {}
        return {int(r["taxon"]["value"]): r["link"]["value"] for r in rows if "link" in r}

    return resolve


def significant_taxa_images(differences: DataFrame, taxonomy: DataFrame, resolve: Callable[[DataFrame], DataFrame] | Resolver | None = None, by_table: bool = True) -> DataFrame:
    """(taxonId, image_url) of every significant taxon in the taxonomy; the link is null where none is known."""
    taxa = differences.select("taxonId").distinct().join(taxonomy, "taxonId").select("taxonId", "gbifTaxonId")
    if resolve is None:
        return taxa.select("taxonId", F.lit(None).cast("string").alias("image_url"))
    if by_table:
        return resolve(taxa)
    found = resolve([r["gbifTaxonId"] for r in taxa.select("gbifTaxonId").distinct().collect()])
    links = taxa.sparkSession.createDataFrame(sorted(found.items()), "gbifTaxonId bigint, image_url string")
    return taxa.join(links, "gbifTaxonId", "left").select("taxonId", "image_url")
