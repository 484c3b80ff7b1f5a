"""Statistics of clusters: adjacency, taxa, significance, permutation test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.functions.fisher import fisher_p
from terramosaic.operators.cells import cut

#: Fixed values.
MAX_P, MIN_COUNT = 0.05, 5
PERMUTATIONS = 999


def select_k(multi: DataFrame, k: int) -> DataFrame:
    return multi.where(F.col("num_clusters") == k).select("geocode", "cluster")


def cluster_of(clusters: DataFrame, geocode: int) -> int:
    """Cluster of a cell; KeyError if it has none."""
    rows = clusters.where(F.col("geocode") == geocode).head(1)
    if not rows:
        raise KeyError(geocode)
    return rows[0]["cluster"]


def members(clusters: DataFrame) -> DataFrame:
    """(cluster, geocodes), cells in order."""
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("geocode")).alias("geocodes"))


def last_label(clusters: DataFrame) -> int:
    return clusters.agg(F.max("cluster")).first()[0]


def cluster_neighbors(neighbors: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adjacent clusters by direct and by all cell neighbours; a neighbour cell without a cluster is an error."""
    out = clusters.select("cluster").distinct()
    other = clusters.select(F.col("geocode").alias("other"), F.col("cluster").alias("to"))
    for column in ("direct_neighbors", "direct_and_indirect_neighbors"):
        pairs = neighbors.join(clusters, "geocode").select("cluster", F.explode(column).alias("other")).join(other, "other", "left")
        checked = pairs.select("cluster", F.when(F.col("to").isNull(), F.raise_error(F.concat(F.lit("no cluster for cell "), F.col("other")))).otherwise(F.col("to")).cast("int").alias("to"))
        found = checked.where("to <> cluster").groupBy("cluster").agg(F.array_sort(F.collect_set("to")).alias(column))
        out = out.join(found, "cluster", "left").withColumn(column, F.coalesce(column, F.array().cast("array<int>")))
    return out.select(F.col("cluster").cast("int").alias("cluster"), "direct_neighbors", F.array_sort(F.array_union("direct_neighbors", "direct_and_indirect_neighbors")).alias("direct_and_indirect_neighbors")).orderBy("cluster")


def cluster_taxa_statistics(counts: DataFrame, clusters: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Totals and shares by taxon, overall (null cluster, cells without a cluster included) and by cluster."""
    known = counts.join(taxonomy.select("taxonId"), "taxonId", "left_semi").select("geocode", "taxonId", "count")
    overall = known.groupBy("taxonId").agg(F.sum("count").alias("count")).select(F.lit(None).cast("int").alias("cluster"), "taxonId", "count")
    by = known.join(clusters, "geocode").groupBy(F.col("cluster").cast("int").alias("cluster"), "taxonId").agg(F.sum("count").alias("count"))
    both = overall.unionByName(by)
    return both.select("cluster", "taxonId", "count", F.try_divide("count", F.sum("count").over(Window.partitionBy("cluster"))).alias("average"))


def neighbor_totals(statistics: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(cluster, taxonId, neighbor_count) over the union of neighbour clusters."""
    own = statistics.where(F.col("cluster").isNotNull())
    pairs = neighbors.select(F.col("cluster").alias("home"), F.explode("direct_and_indirect_neighbors").alias("cluster"))
    return pairs.join(own, "cluster").groupBy(F.col("home").alias("cluster"), "taxonId").agg(F.sum("count").alias("neighbor_count"))


def contingency(statistics: DataFrame, neighbors: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Per (cluster, taxon) with enough individuals on both sides: counts, totals and the log2 ratio of shares.

    Totals include taxa below the threshold; clusters without neighbours are
    skipped. The statistics are read four times, so they are cut off from what
    made them first.
    """
    statistics = cut(statistics)
    around = neighbor_totals(statistics, neighbors)
    own = statistics.where(F.col("cluster").isNotNull()).select("cluster", "taxonId", F.col("count").alias("cluster_count"))
    own_total, around_total = own.groupBy("cluster").agg(F.sum("cluster_count").alias("cluster_total")), around.groupBy("cluster").agg(F.sum("neighbor_count").alias("neighbor_total"))
    table = own.join(around, ["cluster", "taxonId"]).join(own_total, "cluster").join(around_total, "cluster").where((F.col("cluster_count") >= min_count) & (F.col("neighbor_count") >= min_count))
    ratio = (F.col("cluster_count") / F.col("cluster_total")) / (F.col("neighbor_count") / F.col("neighbor_total"))
    return table.withColumn("log2_fold_change", F.log2(ratio))


def with_scores(table: DataFrame) -> DataFrame:
    """Scores of the rows from min-max scaled fold change and log count; all 0 where a range is empty."""
    everything = Window.partitionBy()
    ln = F.log("cluster_count")
    low, high = F.min("log2_fold_change").over(everything), F.max("log2_fold_change").over(everything)
    few, many = F.min(ln).over(everything), F.max(ln).over(everything)
    fold, weight = (F.col("log2_fold_change") - low) / F.nullif(high - low, F.lit(0.0)), (ln - few) / F.nullif(many - few, F.lit(0.0))
    flat = (high - low == 0) | (many - few == 0)
    up = F.when(flat | (F.col("log2_fold_change") <= 0), 0.0).otherwise(fold * weight)
    down = F.when(flat | (F.col("log2_fold_change") >= 0), 0.0).otherwise((1 - fold) * weight)
    return table.withColumns({"high_log2_high_count_score": F.coalesce(up, F.lit(0.0)), "low_log2_high_count_score": F.coalesce(down, F.lit(0.0))})


def significant_differences(statistics: DataFrame, neighbors: DataFrame, max_p: float = MAX_P, min_count: int = MIN_COUNT) -> DataFrame:
    """Taxa that a cluster has significantly more or less of than its neighbours (two-sided Fisher)."""
    table = contingency(statistics, neighbors, min_count)
    p = fisher_p(F.col("cluster_count"), F.col("cluster_total") - F.col("cluster_count"), F.col("neighbor_count"), F.col("neighbor_total") - F.col("neighbor_count"))
    found = table.withColumn("p_value", p).where(F.col("p_value") < max_p)
    return with_scores(found).select("cluster", "taxonId", "p_value", "log2_fold_change", "cluster_count", "neighbor_count", "high_log2_high_count_score", "low_log2_high_count_score")


def pseudo_f(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (n, groups, test_statistic) of the permutational F over pairs i < j; labels are (i, cluster)."""
    a, b = labels.select("i", F.col("cluster").alias("ca")), labels.select(F.col("i").alias("j"), F.col("cluster").alias("cb"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    size = labels.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("groups"))
    joined = pairs.join(a, "i").join(b, "j").join(sizes.withColumnRenamed("cluster", "ca"), "ca")
    sums = joined.agg(F.sum(F.col("d") * F.col("d")).alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("d") * F.col("d") / F.col("size"))).alias("within"))
    s_t, s_w = F.col("all") / F.col("n"), F.coalesce("within", F.lit(0.0))
    value = F.try_divide((s_t - s_w) / (F.col("groups") - 1), s_w / (F.col("n") - F.col("groups")))
    return size.crossJoin(sums).select("n", "groups", value.alias("test_statistic"))  # one row each


def dense_codes(labels: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels numbered from 0 in their order, and how many there are."""
    names, codes = np.unique(labels, return_inverse=True)
    return codes, len(names)


def permanova(square: np.ndarray, labels: np.ndarray, spark, permutations: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """One row: method, pseudo-F and its permutation p (seeded; NaN for 0 permutations).

    Permutations are spread over tasks as batches of matrix products; the matrix
    is broadcast, and its size is bounded by the kernel's row limit. One group,
    or as many groups as rows, is an error.
    """
    n = len(square)
    if len(labels) != n:
        raise ValueError("labels and distances differ in length")
    codes, g = dense_codes(labels)
    if g < 2 or g == n:
        raise ValueError("the grouping needs at least two groups, and two rows in some group")
    d2 = square.astype(float) ** 2
    total = d2.sum() / 2 / n
    sizes = np.bincount(codes).astype(float)

    def f_of(order: np.ndarray) -> float:
        one_hot = np.zeros((n, g))
        one_hot[np.arange(n), codes[order]] = 1
        within = float((np.einsum("ig,ig->g", one_hot, d2 @ one_hot) / (2 * sizes)).sum())
        return ((total - within) / (g - 1)) / (within / (n - g)) if within else float("inf")

    own = f_of(np.arange(n))

    def run(batches):
        for pdf in batches:
            hits = [f_of(np.random.default_rng([seed, int(k)]).permutation(n)) >= own - 1e-12 * abs(own) for k in pdf["id"]]
            yield pd.DataFrame({"hit": np.array(hits, np.int64)})

    hits = spark.range(permutations).mapInPandas(run, "hit bigint").agg(F.sum("hit")).first()[0] or 0
    p = (1 + hits) / (1 + permutations) if permutations else float("nan")
    return spark.createDataFrame([("PERMANOVA", "pseudo-F", float(own), float(p), permutations)], "method_name string, test_statistic_name string, test_statistic double, p_value double, permutations bigint")
