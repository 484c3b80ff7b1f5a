"""Domain tables derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terramosaic.functions import grid
from terramosaic.operators import cells, distances, statistics, taxa
from terramosaic.types import Bbox

BOX = Bbox.of(26.0, 46.0, -86.0, -67.0)
RES = 3
KS = (2, 3, 4, 5)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.expr("25e0 + ((l_suppkey * 37 + l_partkey * 11) % 2200) / 100e0").alias("decimalLatitude"),
        F.expr("-87e0 + ((l_suppkey * 53 + l_orderkey * 7) % 2100) / 100e0").alias("decimalLongitude"),
        F.col("p_type").alias("scientificName"),
        F.col("p_size").cast("bigint").alias("taxonKey"),
        F.expr("CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS INT) END").alias("individualCount"),
    )


def cell_table(spark: SparkSession, sf_dir: str, res: int = RES) -> DataFrame:
    return cells.cells(occurrences(spark, sf_dir), res, BOX)


def inner_cells(spark: SparkSession, sf_dir: str, res: int = RES) -> DataFrame:
    return cells.without_edges(cell_table(spark, sf_dir, res))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxa.taxonomy(occurrences(spark, sf_dir), inner_cells(spark, sf_dir), RES, BOX)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = inner_cells(spark, sf_dir)
    rows = occurrences(spark, sf_dir)
    return taxa.taxa_counts(rows, inner, taxa.taxonomy(rows, inner, RES, BOX), RES, BOX)


# A small site-by-taxon table: nations by brands, clusters are regions.


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return read(spark, sf_dir, "part").select("p_brand").distinct().select((F.row_number().over(Window.orderBy("p_brand")) - 1).cast("bigint").alias("taxonId"), F.col("p_brand").alias("scientificName"), F.row_number().over(Window.orderBy("p_brand")).cast("bigint").alias("gbifTaxonId"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("geocode"), F.col("p_brand").alias("scientificName")).agg(F.sum("l_quantity").cast("bigint").alias("count"))
    return sums.join(brands(spark, sf_dir), "scientificName").select("geocode", "taxonId", "count")


def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.index(sites(spark, sf_dir).select("geocode").distinct())


def site_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair table, a stage of its own: scores read it many times."""
    index = cells.cut(site_index(spark, sf_dir))
    return cells.cut(distances.geocode_distances(cells.cut(sites(spark, sf_dir)), index))


def site_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.square(site_pairs(spark, sf_dir), site_index(spark, sf_dir))


def site_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_index(spark, sf_dir).select(F.explode(F.array(*map(F.lit, KS))).alias("num_clusters"), "i").select("num_clusters", "i", (F.col("i") % F.col("num_clusters")).cast("int").alias("cluster"))


def site_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("geocode"), F.col("n_regionkey").cast("int").alias("cluster"))


def site_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of all nations as direct neighbours; every nation is also an indirect neighbour of the one five further."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("geocode"))
    return n.select("geocode", F.expr("array((geocode + 1) % 25, (geocode + 24) % 25)").alias("direct_neighbors"), F.expr("array((geocode + 1) % 25, (geocode + 24) % 25, (geocode + 5) % 25, (geocode + 20) % 25)").alias("direct_and_indirect_neighbors"))


def region_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("cluster"))
    ring = F.expr("array_sort(array((cluster + 1) % 5, (cluster + 4) % 5))")
    return r.select("cluster", ring.alias("direct_neighbors"), ring.alias("direct_and_indirect_neighbors"))


def site_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cluster_taxa_statistics(sites(spark, sf_dir), site_clusters(spark, sf_dir), brands(spark, sf_dir))


# ---- the grid said again for SQL, from its definition and not from functions.grid ----
# Centres lie in rows 1.5 edges apart, sqrt(3) edges apart in a row, each row shifted by half of that. A point
# belongs to the nearest centre. An id is res * 2^56 + (q + 2^27) * 2^28 + r + 2^27.

_EDGE = f"sqrt(2 * (4 * pi() * 6371.0072 * 6371.0072 / (2 + 120 * power(7, {RES}))) / (3 * sqrt(3)))"


def nearest_center_sql(source: str, keep: tuple[str, ...]) -> str:
    """The cell of each row of ``source`` (lat, lng): the nearest of the two centres next to the point in the rows below and above it."""
    spots = f"SELECT *, row_number() OVER () AS spot, radians(lng) * 6371.0072e0 AS px, sin(radians(lat)) * 6371.0072e0 AS py, {_EDGE} AS edge FROM {source}"
    rows = f"SELECT *, unnest([floor(py / (1.5e0 * edge)), floor(py / (1.5e0 * edge)) + 1]) AS r FROM ({spots})"
    columns = f"SELECT *, unnest([floor(px / (sqrt(3) * edge) - r / 2), floor(px / (sqrt(3) * edge) - r / 2) + 1]) AS q FROM ({rows})"
    far = "power(sqrt(3) * edge * (q + r / 2) - px, 2) + power(1.5e0 * edge * r - py, 2)"
    id_ = f"({RES} * power(2, 56)::BIGINT + (q::BIGINT + power(2, 27)::BIGINT) * power(2, 28)::BIGINT + r::BIGINT + power(2, 27)::BIGINT)"
    return f"SELECT {', '.join(f'first({c}) AS {c}' for c in keep)}, arg_min({id_}, {far}) AS geocode FROM ({columns}) GROUP BY spot"


def center_of_sql() -> tuple[str, str]:
    """Centre (lng, lat) in degrees from the bits of ``geocode``."""
    q, r = f"(((geocode >> 28) & 268435455) - 134217728)", f"((geocode & 268435455) - 134217728)"
    return f"degrees(sqrt(3) * {_EDGE} * ({q} + {r} / 2) / 6371.0072e0)", f"degrees(asin(1.5e0 * {_EDGE} * {r} / 6371.0072e0))"


def corner_of_sql(k: str) -> tuple[str, str]:
    """Corner ``k`` (lng, lat), counted against the clock from the lower right one: at 60 k - 30 degrees around the centre."""
    lng, lat = center_of_sql()
    return f"({lng} + degrees({_EDGE} * cos(radians(60 * {k} - 30)) / 6371.0072e0))", f"degrees(asin(sin(radians({lat})) + {_EDGE} * sin(radians(60 * {k} - 30)) / 6371.0072e0))"


def edge_sql() -> str:
    """Whether a cell's sides (rows of x0, y0, x1, y1) meet the outline of the box, or the whole box lies in the cell."""
    w, e, s, n = (f"{v!r}e0" for v in (BOX.sw.lng, BOX.ne.lng, BOX.sw.lat, BOX.ne.lat))
    cross = []
    for at in (w, e):
        y = f"(CASE WHEN x1 = x0 THEN y0 ELSE y0 + ({at} - x0) / (x1 - x0) * (y1 - y0) END)"
        cross.append(f"((x0 - {at}) * (x1 - {at}) <= 0 AND {y} BETWEEN {s} AND {n})")
    for at in (s, n):
        x = f"(CASE WHEN y1 = y0 THEN x0 ELSE x0 + ({at} - y0) / (y1 - y0) * (x1 - x0) END)"
        cross.append(f"((y0 - {at}) * (y1 - {at}) <= 0 AND {x} BETWEEN {w} AND {e})")
    return f"bool_or({' OR '.join(cross)})"


# ---- the same in SQL: common table expressions, each on those it names ------

_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "occ": ((), "SELECT 25e0 + ((l_suppkey * 37 + l_partkey * 11) % 2200) / 100e0 AS lat, -87e0 + ((l_suppkey * 53 + l_orderkey * 7) % 2100) / 100e0 AS lng, p_type AS scientificName, CAST(p_size AS BIGINT) AS taxonKey, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS INT) END AS individualCount FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "boxed": (("occ",), "SELECT * FROM occ WHERE lat BETWEEN 26e0 AND 46e0 AND lng BETWEEN -86e0 AND -67e0"),
    "celled": (("boxed",), nearest_center_sql("boxed", ("scientificName", "taxonKey", "individualCount"))),
    "corner": (("celled",), f"SELECT geocode, k, {corner_of_sql('k')[0]} AS x, {corner_of_sql('k')[1]} AS y FROM (SELECT DISTINCT geocode FROM celled) CROSS JOIN range(0, 7) t(k)"),
    "side": (("corner",), "SELECT a.geocode, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corner a JOIN corner b ON b.geocode = a.geocode AND b.k = a.k + 1"),
    "allcells": (("side",), "SELECT geocode, " + edge_sql() + " AS is_edge FROM side GROUP BY geocode"),
    "innercells": (("allcells",), "SELECT geocode FROM allcells WHERE NOT is_edge"),
    "seen": (("celled", "innercells"), "SELECT * FROM celled WHERE geocode IN (SELECT geocode FROM innercells)"),
    "tax": (("seen",), "SELECT row_number() OVER (ORDER BY scientificName, gbifTaxonId) - 1 AS taxonId, scientificName, gbifTaxonId FROM (SELECT DISTINCT scientificName, taxonKey AS gbifTaxonId FROM seen)"),
    "counts": (("seen", "tax"), "SELECT geocode, taxonId, CAST(sum(coalesce(individualCount, 1)) AS BIGINT) AS count FROM seen JOIN tax ON seen.scientificName = tax.scientificName AND seen.taxonKey = tax.gbifTaxonId GROUP BY geocode, taxonId"),
    "center": (("allcells",), f"SELECT geocode, {center_of_sql()[0]} AS lng, {center_of_sql()[1]} AS lat FROM allcells"),
    "adj": (("center",), f"SELECT a.geocode, b.geocode AS neighbor FROM center a JOIN center b ON a.geocode <> b.geocode AND sqrt(power(radians(a.lng - b.lng) * 6371.0072e0, 2) + power((sin(radians(a.lat)) - sin(radians(b.lat))) * 6371.0072e0, 2)) < 1.1e0 * sqrt(3) * {_EDGE}"),
    "brands": ((), "SELECT row_number() OVER (ORDER BY p_brand) - 1 AS taxonId, p_brand AS scientificName, row_number() OVER (ORDER BY p_brand) AS gbifTaxonId FROM (SELECT DISTINCT p_brand FROM part)"),
    "site": (("brands",), "SELECT CAST(s_nationkey AS BIGINT) AS geocode, taxonId, CAST(sum(l_quantity) AS BIGINT) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN brands ON scientificName = p_brand GROUP BY 1, 2"),
    "idx": (("site",), "SELECT geocode, CAST(row_number() OVER (ORDER BY geocode) - 1 AS INT) AS i FROM (SELECT DISTINCT geocode FROM site)"),
    "filled": (("idx", "site"), "SELECT i, t.taxonId, CAST(coalesce(count, 0) AS DOUBLE) AS v FROM idx CROSS JOIN (SELECT DISTINCT taxonId FROM site) t LEFT JOIN site ON site.geocode = idx.geocode AND site.taxonId = t.taxonId"),
    "quart": (("filled",), "SELECT taxonId, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM filled GROUP BY taxonId"),
    "sc": (("filled", "quart"), "SELECT i, filled.taxonId, (v - q2) / (CASE WHEN q3 - q1 = 0 THEN 1e0 ELSE q3 - q1 END) AS x FROM filled JOIN quart ON filled.taxonId = quart.taxonId"),
    "dist": (("sc",), "SELECT a.i AS i, b.i AS j, CASE WHEN sum(abs(a.x + b.x)) = 0 THEN 1e0 ELSE sum(abs(a.x - b.x)) / sum(abs(a.x + b.x)) END AS d FROM sc a JOIN sc b ON a.taxonId = b.taxonId AND a.i < b.i GROUP BY 1, 2"),
    "sq": (("dist", "idx"), "SELECT i, j, d FROM dist UNION ALL SELECT j, i, d FROM dist UNION ALL SELECT i, i, 0e0 FROM idx"),
    "lab": (("idx",), "SELECT k AS num_clusters, i, CAST(i % k AS INT) AS cluster FROM idx CROSS JOIN (VALUES (2), (3), (4), (5)) t(k)"),
    "size": (("lab",), "SELECT num_clusters, cluster, count(*) AS n FROM lab GROUP BY 1, 2"),
    "silsum": (("sq", "lab", "size"), "SELECT l.num_clusters, s.i, l.cluster AS c, sum(d) AS s, any_value(z.n) AS n, any_value(o.cluster) AS own FROM sq s JOIN lab l ON l.i = s.j JOIN size z ON z.num_clusters = l.num_clusters AND z.cluster = l.cluster JOIN lab o ON o.num_clusters = l.num_clusters AND o.i = s.i GROUP BY 1, 2, 3"),
    "sil": (("silsum",), "SELECT num_clusters, i, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END AS s FROM (SELECT num_clusters, i, max(CASE WHEN c = own AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN c <> own THEN s / n END) AS b FROM silsum GROUP BY 1, 2)"),
    "mid": (("sq", "lab"), "SELECT num_clusters, cluster, j, avg(d) AS m, count(*) AS n FROM sq JOIN lab USING (i) GROUP BY 1, 2, 3"),
    "ch": (("mid", "sq", "lab"), "SELECT b.num_clusters, CASE WHEN w = 0 THEN 1e0 ELSE (bt * (n - c)) / (w * (c - 1)) END AS ch FROM (SELECT num_clusters, sum(mid.n * (m - g) * (m - g)) AS bt FROM mid JOIN (SELECT j, avg(d) AS g FROM sq GROUP BY j) USING (j) GROUP BY 1) b JOIN (SELECT lab.num_clusters, sum((d - m) * (d - m)) AS w FROM sq JOIN lab USING (i) JOIN mid ON mid.num_clusters = lab.num_clusters AND mid.cluster = lab.cluster AND mid.j = sq.j GROUP BY 1) x ON x.num_clusters = b.num_clusters JOIN (SELECT num_clusters, count(*) AS n, count(DISTINCT cluster) AS c FROM lab GROUP BY 1) z ON z.num_clusters = b.num_clusters"),
    "spread": (("mid", "sq", "lab"), "SELECT num_clusters, cluster, avg(r) AS s FROM (SELECT lab.num_clusters, lab.cluster, lab.i, sqrt(sum((d - m) * (d - m))) AS r FROM sq JOIN lab USING (i) JOIN mid ON mid.num_clusters = lab.num_clusters AND mid.cluster = lab.cluster AND mid.j = sq.j GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "db": (("mid", "spread"), "SELECT num_clusters, avg(w) AS db FROM (SELECT a.num_clusters, a.cluster, max((sa.s + sb.s) / gap) AS w FROM (SELECT a.num_clusters, a.cluster, b.cluster AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS gap FROM mid a JOIN mid b ON a.num_clusters = b.num_clusters AND a.j = b.j AND a.cluster <> b.cluster GROUP BY 1, 2, 3) a JOIN spread sa ON sa.num_clusters = a.num_clusters AND sa.cluster = a.cluster JOIN spread sb ON sb.num_clusters = a.num_clusters AND sb.cluster = a.other GROUP BY 1, 2) GROUP BY 1"),
    "inert": (("dist", "lab", "size"), "SELECT num_clusters, sum(s / n) AS inertia FROM (SELECT a.num_clusters, a.cluster, sum(d * d) AS s FROM dist JOIN lab a ON a.i = dist.i JOIN lab b ON b.i = dist.j AND b.num_clusters = a.num_clusters AND b.cluster = a.cluster GROUP BY 1, 2) JOIN size USING (num_clusters, cluster) GROUP BY 1"),
    "scores": (("sil", "ch", "db", "inert"), "SELECT s.num_clusters, sil, ch, db, inertia FROM (SELECT num_clusters, avg(s) AS sil FROM sil GROUP BY 1) s JOIN ch USING (num_clusters) JOIN db USING (num_clusters) JOIN inert USING (num_clusters)"),
    "norm": (("scores",), "SELECT *, (sil + 1) / 2 AS nsil, (ch - min(ch) OVER ()) / (max(ch) OVER () - min(ch) OVER ()) AS nch, (max(db) OVER () - db) / (max(db) OVER () - min(db) OVER ()) AS ndb, (max(inertia) OVER () - inertia) / (max(inertia) OVER () - min(inertia) OVER ()) AS nin FROM scores"),
    "metrics": (("norm",), "SELECT *, 0.4e0 * nsil + 0.3e0 * nch + 0.3e0 * ndb AS comb FROM norm"),
    "clus": ((), "SELECT CAST(n_nationkey AS BIGINT) AS geocode, CAST(n_regionkey AS INT) AS cluster FROM nation"),
    "stat": (("site", "clus", "brands"), "SELECT cluster, taxonId, count, count / sum(count) OVER (PARTITION BY cluster) AS average FROM (SELECT CAST(NULL AS INT) AS cluster, taxonId, CAST(sum(count) AS BIGINT) AS count FROM site GROUP BY 2 UNION ALL SELECT cluster, taxonId, CAST(sum(count) AS BIGINT) AS count FROM site JOIN clus USING (geocode) GROUP BY 1, 2)"),
    "ring": ((), "SELECT CAST(r_regionkey AS INT) AS cluster, unnest([CAST((r_regionkey + 1) % 5 AS INT), CAST((r_regionkey + 4) % 5 AS INT)]) AS other FROM region"),
    "around": (("stat", "ring"), "SELECT ring.cluster, taxonId, CAST(sum(count) AS BIGINT) AS neighbor_count FROM ring JOIN stat ON stat.cluster = ring.other GROUP BY 1, 2"),
    "cont": (("stat", "around"), "SELECT s.cluster, s.taxonId, s.count AS cluster_count, neighbor_count, cluster_total, neighbor_total, log2((s.count / cluster_total) / (neighbor_count / neighbor_total)) AS log2_fold_change FROM stat s JOIN around a ON a.cluster = s.cluster AND a.taxonId = s.taxonId JOIN (SELECT cluster, CAST(sum(count) AS BIGINT) AS cluster_total FROM stat WHERE cluster IS NOT NULL GROUP BY 1) x ON x.cluster = s.cluster JOIN (SELECT cluster, CAST(sum(neighbor_count) AS BIGINT) AS neighbor_total FROM around GROUP BY 1) y ON y.cluster = s.cluster WHERE s.count >= 5 AND neighbor_count >= 5"),
    "cdist": (("stat",), "SELECT a.cluster AS a, b.cluster AS b, CASE WHEN sum(abs(a.x + b.x)) = 0 THEN 1e0 ELSE sum(abs(a.x - b.x)) / sum(abs(a.x + b.x)) END AS distance FROM (SELECT cluster, taxonId, (average - q2) / (CASE WHEN q3 = q1 THEN 1e0 ELSE q3 - q1 END) AS x FROM stat JOIN (SELECT taxonId, quantile_cont(average, 0.25) AS q1, quantile_cont(average, 0.5) AS q2, quantile_cont(average, 0.75) AS q3 FROM stat WHERE cluster IS NOT NULL GROUP BY 1) USING (taxonId) WHERE cluster IS NOT NULL) a JOIN (SELECT cluster, taxonId, (average - q2) / (CASE WHEN q3 = q1 THEN 1e0 ELSE q3 - q1 END) AS x FROM stat JOIN (SELECT taxonId, quantile_cont(average, 0.25) AS q1, quantile_cont(average, 0.5) AS q2, quantile_cont(average, 0.75) AS q3 FROM stat WHERE cluster IS NOT NULL GROUP BY 1) USING (taxonId) WHERE cluster IS NOT NULL) b ON a.taxonId = b.taxonId AND a.cluster < b.cluster GROUP BY 1, 2"),
}


def sql(names: str, body: str) -> str:
    """A query over named tables, with the expressions that they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _CTE[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return "WITH " + ", ".join(f"{n} AS ({_CTE[n][1]})" for n in order) + " " + body
