"""Validation of clusterings, and the choice of the number of clusters.

Scores are SQL over a square pair table (i, j, d) and labels (num_clusters, i,
cluster), for all k at once. Calinski-Harabasz and Davies-Bouldin take a row of
the distance matrix as a feature vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (0.4, 0.3, 0.3)
COLUMNS = ("num_clusters", "silhouette_score", "calinski_harabasz_score", "davies_bouldin_score", "inertia", "silhouette_normalized", "calinski_harabasz_normalized", "davies_bouldin_normalized", "inertia_normalized", "combined_score")
K = "num_clusters"


def silhouettes(square: DataFrame, labels: DataFrame) -> DataFrame:
    """(num_clusters, i, silhouette_score) of every row; a row alone in its cluster scores 0."""
    to = labels.select(K, F.col("i").alias("j"), F.col("cluster").alias("c"))
    sizes = labels.groupBy(K, F.col("cluster").alias("c")).agg(F.count("*").alias("n"))
    sums = square.join(to, "j").groupBy(K, "i", "c").agg(F.sum("d").alias("s")).join(sizes, [K, "c"]).join(labels, [K, "i"])
    own = F.col("c") == F.col("cluster")
    per = sums.groupBy(K, "i").agg(F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    return per.select(K, "i", F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("silhouette_score"))


def silhouette_table(square: DataFrame, labels: DataFrame, cell_index: DataFrame) -> DataFrame:
    """(geocode, silhouette_score, num_clusters); a null geocode holds the mean of its k."""
    own = silhouettes(square, labels)
    rows = own.join(cell_index, "i").select("geocode", "silhouette_score", K)
    mean = own.groupBy(K).agg(F.avg("silhouette_score").alias("silhouette_score")).select(F.lit(None).cast("bigint").alias("geocode"), "silhouette_score", K)
    return mean.unionByName(rows)


def centroids(square: DataFrame, labels: DataFrame) -> DataFrame:
    return square.join(labels, "i").groupBy(K, "cluster", "j").agg(F.avg("d").alias("m"), F.count("*").alias("n"))


def calinski_harabasz(square: DataFrame, labels: DataFrame) -> DataFrame:
    """(num_clusters, calinski_harabasz_score); 1 where clusters have no dispersion."""
    mid = centroids(square, labels)
    whole = square.groupBy("j").agg(F.avg("d").alias("g"))
    between = mid.join(whole, "j").groupBy(K).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"))
    inside = square.join(labels, "i").join(mid.drop("n"), [K, "cluster", "j"]).groupBy(K).agg(F.sum(F.pow(F.col("d") - F.col("m"), 2)).alias("within"))
    size = labels.groupBy(K).agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("c"))
    score = F.when(F.col("within") == 0, 1.0).otherwise(F.try_divide(F.col("between") * (F.col("n") - F.col("c")), F.col("within") * (F.col("c") - 1)))
    return between.join(inside, K).join(size, K).select(K, score.alias("calinski_harabasz_score"))


def davies_bouldin(square: DataFrame, labels: DataFrame) -> DataFrame:
    """(num_clusters, davies_bouldin_score); 0 where all spreads or all centroid distances vanish."""
    mid = centroids(square, labels).drop("n")
    spread = square.join(labels, "i").join(mid, [K, "cluster", "j"]).groupBy(K, "cluster", "i").agg(F.sqrt(F.sum(F.pow(F.col("d") - F.col("m"), 2))).alias("r")).groupBy(K, "cluster").agg(F.avg("r").alias("s"))
    a, b = mid.select(K, F.col("cluster").alias("a"), "j", F.col("m").alias("x")), mid.select(K, F.col("cluster").alias("b"), "j", F.col("m").alias("y"))
    gaps = a.join(b, [K, "j"]).where("a <> b").groupBy(K, "a", "b").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("gap"))
    pairs = gaps.join(spread.select(K, F.col("cluster").alias("a"), F.col("s").alias("sa")), [K, "a"]).join(spread.select(K, F.col("cluster").alias("b"), F.col("s").alias("sb")), [K, "b"])
    ratio = F.when(F.col("gap") == 0, 0.0).otherwise(F.try_divide(F.col("sa") + F.col("sb"), F.col("gap")))
    worst = pairs.groupBy(K, "a").agg(F.max(ratio).alias("w"), F.max("sa").alias("s"), F.max("gap").alias("g"))
    out = worst.groupBy(K).agg(F.avg("w").alias("w"), F.max("s").alias("s"), F.max("g").alias("g"))
    return out.select(K, F.when((F.col("s") < 1e-9) | (F.col("g") < 1e-9), 0.0).otherwise(F.col("w")).alias("davies_bouldin_score"))


def inertia(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(num_clusters, inertia): squared distances within a cluster over its size, from pairs i < j."""
    a, b = labels.select(K, "i", "cluster"), labels.select(K, F.col("i").alias("j"), F.col("cluster").alias("c"))
    sizes = labels.groupBy(K, "cluster").agg(F.count("*").alias("n"))
    inside = pairs.join(a, "i").join(b, [K, "j"]).where("cluster = c").groupBy(K, "cluster").agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return sizes.join(inside, [K, "cluster"], "left").groupBy(K).agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("inertia"))


def combine(scores: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Normalised columns and the combined score over the rows of all k."""
    total = sum(weights)

    def span(c: str, down: bool):
        low, high = F.min(c).over(Window.partitionBy()), F.max(c).over(Window.partitionBy())
        width = F.when(high - low == 0, 1.0).otherwise(high - low)
        return (high - F.col(c)) / width if down else (F.col(c) - low) / width

    out = scores.withColumns({"silhouette_normalized": (F.col("silhouette_score") + 1) / 2, "calinski_harabasz_normalized": span("calinski_harabasz_score", False), "davies_bouldin_normalized": span("davies_bouldin_score", True), "inertia_normalized": span("inertia", True)})
    parts = ("silhouette_normalized", "calinski_harabasz_normalized", "davies_bouldin_normalized")
    return out.withColumn("combined_score", sum(F.col(c) * F.lit(w / total) for c, w in zip(parts, weights, strict=True))).select(*COLUMNS)


def cluster_metrics(pairs: DataFrame, square: DataFrame, labels: DataFrame, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    mean = silhouettes(square, labels).groupBy(K).agg(F.avg("silhouette_score").alias("silhouette_score"))
    scores = mean.join(calinski_harabasz(square, labels), K).join(davies_bouldin(square, labels), K).join(inertia(pairs, labels), K)
    return combine(scores, weights).orderBy(K)


# ---- choice of k: a handful of rows, on the driver -------------------------


def elbow(ks: list[float], values: list[float], sensitivity: float = 1.0) -> int | None:
    """The knee of a convex, falling curve; None if there is none or fewer than three points."""
    if len(ks) < 3:
        return None
    order = np.argsort(ks)
    x, y = np.array(ks, float)[order], np.array(values, float)[order]
    if x[-1] == x[0] or y.max() == y.min():
        return None
    u, v = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / (y.max() - y.min())
    d = v.max() - v - u
    before, after = np.concatenate([d[:1], d[:-1]]), np.concatenate([d[1:], d[-1:]])
    highs, lows = (d >= before) & (d >= after), (d <= before) & (d <= after)
    step = sensitivity * np.abs(np.diff(u).mean())
    threshold, candidate = None, None
    for i in range(len(d) - 1):
        if highs[i]:
            threshold, candidate = d[i] - step, i
        elif threshold is not None and lows[i]:
            threshold = 0.0
        if threshold is not None and d[i + 1] < threshold:
            return int(x[candidate])
    return None


def choose_k(table: DataFrame, sensitivity: float = 1.0) -> int | None:
    """The elbow of inertia, otherwise the k with the best combined score (ties: smallest); None for an empty table."""
    rows = table.select(K, "inertia", "combined_score").orderBy(K).collect()
    if not rows:
        return None
    found = elbow([r[0] for r in rows], [r[1] for r in rows], sensitivity)
    return found if found is not None else min(rows, key=lambda r: (-r[2], r[0]))[0]


def best_combined(table: DataFrame) -> DataFrame:
    """The row with the best combined score, ties to the smallest k."""
    return table.orderBy(F.desc("combined_score"), K).limit(1)


def differences(table: DataFrame) -> DataFrame:
    """First and second differences of inertia by k; the first of each is 0."""
    w = Window.orderBy(K)
    first = table.select(K, "inertia", F.coalesce(F.col("inertia") - F.lag("inertia").over(w), F.lit(0.0)).alias("delta"))
    return first.withColumn("delta2", F.coalesce(F.col("delta") - F.lag("delta").over(w), F.lit(0.0)))


def elbow_analysis(table: DataFrame, sensitivity: float = 1.0) -> dict:
    """k, inertia, elbow (0 for none), distances from the chord, and differences."""
    rows = differences(table).orderBy(K).collect()
    ks, values = [r[K] for r in rows], [r["inertia"] for r in rows]
    distances = [0.0] * len(rows)
    if len(rows) > 1 and max(values) > min(values):
        x, y = np.array(ks, float), np.array(values, float)
        x, y = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / (y.max() - y.min())
        distances = (np.abs((y[-1] - y[0]) * x - y + y[0]) / np.hypot(y[-1] - y[0], 1)).tolist()
    return {"k_values": ks, "inertia": values, "elbow_k": elbow(ks, values, sensitivity) or 0, "distances": distances, "first_derivative": [r["delta"] for r in rows], "second_derivative": [r["delta2"] for r in rows]}


def summary(table: DataFrame) -> DataFrame:
    """All metrics with the rank by combined score, from 1."""
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined_score"), K)).cast("int")).orderBy("rank")


def average_ranks(table: DataFrame) -> DataFrame:
    """Ranks of five scores by k, ties averaged; rank 1 is the best."""
    out = table
    for c, best_is_low in (("silhouette_score", False), ("calinski_harabasz_score", False), ("davies_bouldin_score", True), ("inertia", True), ("combined_score", False)):
        order = F.col(c) if best_is_low else F.desc(c)
        out = out.withColumn(f"{c}_rank", F.rank().over(Window.orderBy(order)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2)
    return out.select(K, *(c for c in out.columns if c.endswith("_rank")))


#: How to read the scores.
INTERPRETATIONS = {
    "silhouette_score": "-1 to 1. Above 0.7 the structure is strong, above 0.5 reasonable, above 0.25 weak; below that there is hardly any.",
    "calinski_harabasz_score": "0 and up. Spread between clusters over spread within; compare it across k, more is better.",
    "davies_bouldin_score": "0 and up. Mean likeness of each cluster to the one most like it; less is better, below 1 is good.",
    "inertia": "0 and up. Squared distances within clusters; it falls with k, and the bend is what counts.",
    "combined_score": "0 to 1. Weighted mean of the normalised scores; more is better.",
}
