"""Feature scaling and Bray-Curtis distances, kept in long form.

Counts are sparse: a row is (row id, feature, value) and missing means zero.
Medians and quartiles over all rows are read off the sorted non-zeros. A zero
becomes one and the same value in all rows of a feature, so a distance is made
of sums by row and a correction for the features that both rows hold: neither a
pivot nor a dense matrix is made, and the join is over non-zeros only. The pair
table is n * (n - 1) / 2 rows for n cells, which a coarse grid keeps to
thousands; MAX_ROWS guards it (5,000 cells are 12.5 million pairs and, in the
kernels, a matrix of 200 MB).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ROWS = 5_000


def dense(long: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """All (row, feature) cells with zeros filled in: the dense matrix itself, for those who ask for it."""
    rows, features = long.select(row).distinct(), long.select(feature).distinct()
    return rows.crossJoin(features).join(long, [row, feature], "left").select(row, feature, F.coalesce(value, F.lit(0)).cast("double").alias(value))


def implicit_percentiles(long: DataFrame, feature: str, value: str, n_rows: int | Column, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linear percentiles of each feature over n rows of which only the non-zeros (> 0) are listed."""
    ranked = long.where(F.col(value) > 0).select(feature, F.col(value).cast("double").alias("_v"), F.row_number().over(Window.partitionBy(feature).orderBy(value)).alias("_r"), F.count("*").over(Window.partitionBy(feature)).alias("_m"))
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    out = []
    for k, share in enumerate(shares):
        place = (n - 1) * F.lit(float(share))
        low = F.floor(place)
        part = place - low

        def at(rank: Column) -> Column:
            """The value at a 0-based rank among all rows: zeros first."""
            return F.coalesce(F.max(F.when(F.col("_r") - 1 == rank - (n - F.col("_m")), F.col("_v"))), F.lit(0.0))

        out.append((at(low) + (at(F.least(low + 1, n - 1)) - at(low)) * F.first(part)).alias(f"p{k}"))
    return ranked.groupBy(feature).agg(*out)


def scaled(long: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Robust scaling over all rows, zeros included: (x - median) / IQR, divisor 1 for IQR 0; dense result."""
    full = dense(long, row, feature, value)
    stats = full.groupBy(feature).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_p"))
    spread = F.col("_p")[2] - F.col("_p")[0]
    return full.join(stats, feature).select(row, feature, ((F.col(value) - F.col("_p")[1]) / F.when(spread == 0, 1.0).otherwise(spread)).alias(value))


def scaled_nonzeros(long: DataFrame, row: str, feature: str, value: str, n_rows: int) -> DataFrame:
    """(row, feature, x, z) of the non-zeros: the value and a zero, both robustly scaled over n rows."""
    spread = F.col("p2") - F.col("p0")
    stats = implicit_percentiles(long, feature, value, n_rows).select(feature, F.col("p1").alias("_m"), F.when(spread == 0, 1.0).otherwise(spread).alias("_w"))
    own = long.where(F.col(value) > 0).join(stats, feature)
    return own.select(row, feature, ((F.col(value) - F.col("_m")) / F.col("_w")).alias("x"), (-F.col("_m") / F.col("_w")).alias("z"))


def sparse_bray_curtis(long: DataFrame, row: str, feature: str, value: str, rows: DataFrame, undefined: float | None = 1.0) -> DataFrame:
    """(a < b, distance) of the scaled values of every two of ``rows``; ``long`` holds the non-zeros, none negative.

    As bray_curtis(scaled(...)), by sums over non-zeros. With z the scaled zero,
    a row against the zero row has D = sum |x - z| and S = sum |x + z| - |2z|;
    features that two rows share correct D(a) + D(b) and S(a) + S(b).
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    own = scaled_nonzeros(long, row, feature, value, rows.count())
    whole = own.groupBy(feature).agg(F.first("z").alias("z")).agg(F.coalesce(F.sum(F.abs(2 * z)), F.lit(0.0)).alias("_z"))
    alone = rows.join(own.groupBy(row).agg(F.sum(F.abs(x - z)).alias("_d"), F.sum(F.abs(x + z) - F.abs(2 * z)).alias("_s")), row, "left").na.fill(0.0, ["_d", "_s"])
    both = own.select(F.col(row).alias("a"), feature, "x", "z").join(own.select(F.col(row).alias("b"), feature, F.col("x").alias("y")), feature).where("a < b")
    shared = both.groupBy("a", "b").agg(F.sum(F.abs(x - y) - F.abs(x - z) - F.abs(y - z)).alias("d"), F.sum(F.abs(x + y) - F.abs(x + z) - F.abs(y + z) + F.abs(2 * z)).alias("s"))
    a, b = alone.select(F.col(row).alias("a"), F.col("_d").alias("da"), F.col("_s").alias("sa")), alone.select(F.col(row).alias("b"), F.col("_d").alias("db"), F.col("_s").alias("sb"))
    # Every two rows are the result itself; the one-row table of zeros comes along.
    pairs = a.join(b, F.col("a") < F.col("b")).join(shared, ["a", "b"], "left").crossJoin(whole)
    d = F.col("da") + F.col("db") + F.coalesce("d", F.lit(0.0))
    s = F.col("_z") + F.col("sa") + F.col("sb") + F.coalesce("s", F.lit(0.0))
    # Sums that cancel leave a rest of rounding: distances are not negative, and equal rows are at 0.
    rest = 1e-13 * (F.col("_z") + F.abs("sa") + F.abs("sb") + F.col("da") + F.col("db"))
    return pairs.select("a", "b", F.when(s <= rest, F.lit(undefined)).when(d <= rest, 0.0).otherwise(d / s).alias("distance"))


def bray_curtis(features: DataFrame, row: str, feature: str, value: str, undefined: float | None = 1.0) -> DataFrame:
    """(a < b, distance): sum |x - y| / sum |x + y| over features; ``undefined`` where that is no number."""
    a = features.select(F.col(row).alias("a"), F.col(feature).alias("f"), F.col(value).alias("x"))
    b = features.select(F.col(row).alias("b"), F.col(feature).alias("f"), F.col(value).alias("y"))
    sums = a.join(b, "f").where("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("d"), F.sum(F.abs(F.col("x") + F.col("y"))).alias("s"))
    return sums.select("a", "b", F.coalesce(F.try_divide("d", "s"), F.lit(undefined)).alias("distance"))


def geocode_distances(counts: DataFrame, cell_index: DataFrame, reducer: str = "identity", dims: int | None = None) -> DataFrame:
    """Pair table (i < j, d) of the cells, over scaled counts or their reduction."""
    n = cell_index.count()
    if n > MAX_ROWS:
        raise ValueError(f"{n} cells give too many pairs; use a coarser grid")
    long = counts.join(cell_index, "geocode").select("i", "taxonId", "count")
    if reducer != "identity":
        found = bray_curtis(reduced(scaled(long, "i", "taxonId", "count"), reducer, dims), "i", "feature", "value")
    else:
        found = sparse_bray_curtis(long, "i", "taxonId", "count", cell_index.select("i"))
    return found.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col("distance").alias("d"))


def reduced(features: DataFrame, reducer: str, dims: int | None = None) -> DataFrame:
    """(i, feature, value) of a reduction of a long matrix (i, taxonId, count) on the driver."""
    pdf = features.toPandas().pivot(index="i", columns="taxonId", values="count").fillna(0.0).sort_index()
    x = pdf.to_numpy(float)
    y = pca(x, dims or max(1, len(x) - 2)) if reducer == "pca" else mds(np.linalg.norm(x[:, None] - x[None], axis=2), dims or max(1, len(x) - 2)) if reducer == "mds" else external(reducer, x, dims)
    rows = [(int(i), k, float(v)) for i, row in zip(pdf.index, y, strict=True) for k, v in enumerate(row)]
    return features.sparkSession.createDataFrame(rows, "i int, feature int, value double")


def external(reducer: str, x: np.ndarray, dims: int | None) -> np.ndarray:
    if reducer != "umap":
        raise ValueError(f"unknown reducer {reducer!r}")
    import umap  # optional library

    return umap.UMAP(n_components=dims or max(1, len(x) - 2), metric="braycurtis", min_dist=0.5).fit_transform(x)


def pca(x: np.ndarray, dims: int) -> np.ndarray:
    centred = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    y = (u * s)[:, :dims]
    return y * np.where(np.abs(y).max(axis=0) == y.max(axis=0), 1, -1)  # signs made definite


def mds(d: np.ndarray, dims: int) -> np.ndarray:
    """Classical scaling of a distance matrix."""
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    order = np.argsort(values)[::-1][:dims]
    y = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    y = y * np.where(np.abs(y).max(axis=0) == y.max(axis=0), 1, -1)
    return np.pad(y, ((0, 0), (0, max(0, dims - y.shape[1]))))


def square(pairs: DataFrame, ids: DataFrame, a: str = "i", b: str = "j", d: str = "d") -> DataFrame:
    """Both directions and the zero diagonal."""
    swapped = pairs.select(F.col(b).alias(a), F.col(a).alias(b), d)
    diagonal = ids.select(F.col(a), F.col(a).alias(b), F.lit(0.0).alias(d))
    return pairs.select(a, b, d).union(swapped).union(diagonal)


def matrix(pairs: DataFrame, n: int) -> np.ndarray:
    """The square matrix of an (i < j, d) table, for kernels."""
    if n > MAX_ROWS:
        raise ValueError(f"{n} rows are too many for one matrix")
    table = pairs.select("i", "j", "d").toArrow()
    out = np.zeros((n, n))
    i, j, d = (table.column(c).to_numpy() for c in ("i", "j", "d"))
    out[i, j] = out[j, i] = d
    return out


def cluster_distances(statistics: DataFrame) -> DataFrame:
    """(a < b, distance) of clusters by their scaled average shares; one cluster is an error."""
    own = statistics.where(F.col("cluster").isNotNull()).select("cluster", "taxonId", "average")
    clusters = own.select("cluster").distinct()
    if clusters.limit(2).count() < 2:
        raise ValueError("distances need two clusters")
    return sparse_bray_curtis(own, "cluster", "taxonId", "average", clusters)


def cluster_distance(distances: DataFrame, a: int, b: int) -> float:
    """0 for equal clusters, 1 for an undefined distance; KeyError for an unknown one."""
    for x in (a, b):
        if not distances.where((F.col("a") == x) | (F.col("b") == x)).head(1):
            raise KeyError(x)
    if a == b:
        return 0.0
    value = distances.where((F.col("a") == min(a, b)) & (F.col("b") == max(a, b))).head(1)[0]["distance"]
    return 1.0 if value is None or not np.isfinite(value) else float(value)


def nearest_clusters(distances: DataFrame, cluster: int, n: int) -> DataFrame:
    """The n clusters nearest to one, ties to the smaller id."""
    other = F.when(F.col("a") == cluster, F.col("b")).otherwise(F.col("a")).alias("cluster")
    found = distances.where((F.col("a") == cluster) | (F.col("b") == cluster)).select(other, "distance")
    if not found.head(1):
        raise KeyError(cluster)
    return found.orderBy("distance", "cluster").limit(n)


def euclidean_to_mean(vectors: DataFrame, row: str, vector: str) -> DataFrame:
    """(row, squared, dist): each vector's squared and plain Euclidean distance to the mean vector of all.

    Work grows in proportion to the rows: sums by position are combined in the
    tasks, and the mean is one row. Null vectors have null distances.
    """
    own = vectors.select(row, F.col(vector).cast("array<double>").alias("_v"))
    by_position = own.select(F.posexplode("_v").alias("_at", "_x")).groupBy("_at").agg(F.avg("_x").alias("_x"))
    mean = by_position.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("_mean"))
    squared = F.aggregate(F.zip_with("_v", "_mean", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return own.crossJoin(F.broadcast(mean)).select(row, squared.alias("squared"), F.sqrt(squared).alias("dist"))
