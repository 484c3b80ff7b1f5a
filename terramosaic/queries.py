"""Queries of the engine's operators over the driver's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terramosaic import standin as d
from terramosaic.functions import colors, grid, wkb
from terramosaic.functions.fisher import fisher_p
from terramosaic.operators import boundary, cells, coloring, distances, export, metrics, occurrences, plot_data, statistics, taxa, ward
from terramosaic.shipping import shared_folder, ship
from terramosaic.sources import darwin_core, images
from terramosaic.standin import BOX, RES, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ---- sources ----------------------------------------------------------------


@query("SELECT count(*) AS n, sum(p_size) AS sizes FROM part WHERE p_size BETWEEN 10 AND 20")
def s4_parquet_scan(spark, sf):
    """Source detection, scan, pushed filter."""
    return darwin_core.scan(spark, f"{sf}/part.parquet").where("p_size BETWEEN 10 AND 20").agg(F.count("*").alias("n"), F.sum("p_size").cast("decimal(38,0)").alias("sizes"))


@query('SELECT p_size AS "taxonKey", p_type AS "scientificName", p_brand AS other FROM part')
def s5_column_rename(spark, sf):
    return darwin_core.rename_standard(d.read(spark, sf, "part").selectExpr("p_size AS taxonkey", "p_type AS scientificname", "p_brand AS other"))


@query('SELECT CAST(p_size AS BIGINT) AS "taxonKey", count(*) AS n FROM part GROUP BY 1')
def s6_taxon_key_cast(spark, sf):
    """A snapshot in which the key is text and its name in lower case, scanned."""
    path = shared(spark, "snapshot")
    d.read(spark, sf, "part").select(F.col("p_size").cast("string").alias("taxonkey")).write.parquet(path)
    return darwin_core.scan(spark, path).groupBy("taxonKey").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, 'WGS84' AS datum FROM nation")
def s7_default_columns(spark, sf):
    return d.read(spark, sf, "nation").select("n_nationkey").withColumn("datum", F.lit("WGS84"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS \"scientificName\", 'WGS84' AS \"geodeticDatum\" FROM nation")
def s2_s3_archive_scan(spark, sf):
    """An archive written to the shared folder by Spark, described by a meta.xml, and scanned."""
    path = archive(spark, d.read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("scientificName")))
    return darwin_core.scan(spark, path)


def shared(spark: SparkSession, stem: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def archive(spark: SparkSession, rows: DataFrame) -> str:
    path = shared(spark, "archive")
    rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/occurrence.txt")
    fields = "".join(f'<field index="{i}" term="http://rs.tdwg.org/dwc/terms/{c}"/>' for i, c in enumerate(rows.columns) if c != "id")
    xml = f'<archive xmlns="http://rs.tdwg.org/dwc/text/"><core encoding="UTF-8" fieldsTerminatedBy="\\t" linesTerminatedBy="\\n" fieldsEnclosedBy="" ignoreHeaderLines="1"><files><location>occurrence.txt</location></files><id index="0"/>{fields}<field default="WGS84" term="http://rs.tdwg.org/dwc/terms/geodeticDatum"/></core></archive>'
    spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(f"{path}/meta.xml")
    return path


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def s9_stage_materialization(spark, sf):
    from terramosaic.sources.sinks import materialize

    return materialize(d.read(spark, sf, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")), "nations", shared(spark, "stages"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"taxonId\", CASE WHEN n_nationkey % 3 = 0 THEN 'https://example.org/' || n_nationkey END AS image_url FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def s13_x5_images(spark, sf):
    """Images of taxa; those that the taxonomy does not have are left out."""
    return nation_images(spark, sf)


def nation_images(spark, sf) -> DataFrame:
    nations = d.read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("taxonId"), F.col("n_regionkey").alias("r_regionkey"))
    taxonomy = nations.join(d.read(spark, sf, "region").where("r_name <> 'ASIA'"), "r_regionkey").select("taxonId", (F.col("taxonId") + 100).alias("gbifTaxonId"))
    links = nations.where("taxonId % 3 = 0").select((F.col("taxonId") + 100).alias("gbifTaxonId"), F.concat(F.lit("https://example.org/"), "taxonId").alias("image_url"))
    return images.significant_taxa_images(nations, taxonomy, images.from_table(links))


@query("SELECT CAST(n_nationkey AS BIGINT) AS \"taxonId\", 'https://example.org/' || n_nationkey AS image_url FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def p12_with_images(spark, sf):
    return export.with_images(nation_images(spark, sf))


@query("SELECT CAST(n_nationkey AS BIGINT) AS geocode, CAST(n_regionkey AS INT) AS cluster FROM nation")
def p13_cluster_of(spark, sf):
    """The cluster of each cell, looked up one by one."""
    clusters = cells.cut(d.site_clusters(spark, sf))
    geocodes = [r["geocode"] for r in clusters.select("geocode").collect()]
    return spark.createDataFrame([(g, statistics.cluster_of(clusters, g)) for g in geocodes], "geocode bigint, cluster int")


@query(sql("innercells center", "SELECT geocode, round(lng, 6) + 0e0 AS lng, round(lat, 6) + 0e0 AS lat FROM center WHERE geocode IN (SELECT geocode FROM innercells)"))
def s14_f20_wkb_round_trip(spark, sf):
    """Centres encoded as WKB and read back as GeoJSON."""
    raw = d.inner_cells(spark, sf).select("geocode", wkb.point_wkb("center.lng", "center.lat").alias("w"))
    xy = F.from_json(F.get_json_object(wkb.geometry_json("w"), "$.coordinates"), "array<double>")
    return rounded(raw.select("geocode", xy[0].alias("lng"), xy[1].alias("lat")), "lng", "lat")


# ---- projections and filters -------------------------------------------------


@query(sql("boxed", "SELECT count(*) AS n, CAST(sum(taxonKey) AS BIGINT) AS keys FROM boxed"))
def p1_box_filter(spark, sf):
    return occurrences.in_box(d.occurrences(spark, sf), BOX).agg(F.count("*").alias("n"), F.sum("taxonKey").alias("keys"))


@query(sql("boxed", 'SELECT "scientificName", count(*) AS n, count("individualCount") AS counted FROM boxed GROUP BY 1'))
def p2_core_columns(spark, sf):
    rows = darwin_core.occurrences(d.occurrences(spark, sf), BOX)
    return rows.groupBy("scientificName").agg(F.count("*").alias("n"), F.count("individualCount").alias("counted"))


@query(sql("boxed", "SELECT least(count(*), 1000) AS n FROM boxed"))
def p3_limit(spark, sf):
    return darwin_core.occurrences(d.occurrences(spark, sf), BOX, limit=1000).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS family, count(*) AS n FROM part WHERE p_brand = 'Brand#13' OR p_type = 'Brand#13' GROUP BY 1")
def p4_taxon_filter(spark, sf):
    rows = d.read(spark, sf, "part").selectExpr("p_brand AS family", "p_type AS genus")
    return darwin_core.named_taxon(rows, "Brand#13").groupBy("family").agg(F.count("*").alias("n"))


@query(sql("innercells", "SELECT geocode FROM innercells"))
def p5_edge_filter(spark, sf):
    return d.inner_cells(spark, sf).select("geocode")


@query(sql("lab idx", "SELECT geocode, cluster FROM lab JOIN idx USING (i) WHERE num_clusters = 3"))
def p6_select_k(spark, sf):
    return statistics.select_k(d.site_labels(spark, sf).join(d.site_index(spark, sf), "i"), 3)


@query(sql("stat", "SELECT cluster IS NULL AS overall, count(*) AS n FROM stat GROUP BY 1"))
def p7_null_cluster(spark, sf):
    return d.site_statistics(spark, sf).groupBy(F.col("cluster").isNull().alias("overall")).agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS geocode, CASE WHEN n_nationkey IN (3, 17) THEN 5 ELSE 4 END AS n FROM nation")
def p8_f24_indirect_edge(spark, sf):
    return cells.with_indirect_edge(d.site_neighbors(spark, sf), 3, 17).select("geocode", F.size("direct_and_indirect_neighbors").alias("n"))


@query(sql("celled", "SELECT geocode, count(*) AS n FROM celled GROUP BY 1"))
def p9_p10_f1_geocode(spark, sf):
    return occurrences.with_geocode(occurrences.in_box(d.occurrences(spark, sf), BOX), RES).groupBy("geocode").agg(F.count("*").alias("n"))


# ---- joins and aggregates ----------------------------------------------------


@query(sql("seen", "SELECT geocode, count(*) AS n FROM seen GROUP BY 1"))
def j1_semi_known_cells(spark, sf):
    seen = occurrences.in_cells(d.occurrences(spark, sf), BOX, RES).join(d.inner_cells(spark, sf).select("geocode"), "geocode", "left_semi")
    return seen.groupBy("geocode").agg(F.count("*").alias("n"))


@query(sql("site", "SELECT * FROM site WHERE taxonId IN (SELECT taxonId FROM site GROUP BY 1 HAVING count(DISTINCT geocode) >= floor((SELECT count(DISTINCT geocode) FROM site) * 0.8e0 + 1e-9))"))
def j3_a4_a6_presence_filter(spark, sf):
    return taxa.filter_taxa(d.sites(spark, sf), min_presence=0.8)


@query(sql("site", "SELECT * FROM site WHERE taxonId IN (SELECT taxonId FROM site GROUP BY 1 ORDER BY sum(count) DESC, taxonId LIMIT 7)"))
def j4_a5_t2_top_taxa(spark, sf):
    return taxa.filter_taxa(d.sites(spark, sf), max_taxa=7)


@query(sql("site", "SELECT * FROM site WHERE taxonId IN (SELECT taxonId FROM (SELECT taxonId, sum(count) AS s FROM site GROUP BY 1 HAVING count(DISTINCT geocode) >= floor((SELECT count(DISTINCT geocode) FROM site) * 0.5e0 + 1e-9)) ORDER BY s DESC, taxonId LIMIT 5)"))
def x6_filter_taxa(spark, sf):
    return taxa.filter_taxa(d.sites(spark, sf), 5, 0.5)


@query(sql("innercells counts", "SELECT geocode FROM innercells WHERE geocode IN (SELECT geocode FROM counts)"))
def j5_cells_with_counts(spark, sf):
    return cells.with_counts(d.inner_cells(spark, sf), d.counts(spark, sf)).select("geocode")


@query(sql("site brands clus", ", known AS (SELECT * FROM site WHERE taxonId IN (SELECT taxonId FROM brands WHERE scientificName LIKE '%3')) SELECT cluster, taxonId AS \"taxonId\", CAST(sum(count) AS BIGINT) AS count FROM (SELECT NULL::INT AS cluster, taxonId, count FROM known UNION ALL SELECT cluster, taxonId, count FROM known JOIN clus USING (geocode)) GROUP BY 1, 2"))
def j6_known_taxa(spark, sf):
    """Statistics under a taxonomy that lacks most taxa: their counts are left out."""
    return statistics.cluster_taxa_statistics(d.sites(spark, sf), d.site_clusters(spark, sf), d.brands(spark, sf).where("scientificName LIKE '%3'")).select("cluster", "taxonId", "count")


@query(sql("site clus", "SELECT cluster, CAST(sum(count) AS BIGINT) AS n FROM site JOIN clus USING (geocode) GROUP BY 1"))
def j7_counts_by_cluster(spark, sf):
    return d.sites(spark, sf).join(F.broadcast(d.site_clusters(spark, sf)), "geocode").groupBy("cluster").agg(F.sum("count").alias("n"))


@query(sql("clus site", "SELECT geocode, geocode IN (SELECT geocode FROM site) AS has FROM (SELECT geocode FROM clus UNION ALL SELECT 100 + r_regionkey FROM region)"))
def j13_u5_semi_anti(spark, sf):
    """Cells with and without counts; the regions stand for cells in which nothing was seen."""
    some = d.site_clusters(spark, sf).unionByName(d.read(spark, sf, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("geocode"), F.lit(0).alias("cluster")))
    counts = d.sites(spark, sf)
    have = cells.with_counts(some, counts).select("geocode", F.lit(True).alias("has"))
    return have.union(plot_data.cells_without_counts(some, counts).select("geocode", F.lit(False)))


@query(sql("cont brands", 'SELECT cluster, "taxonId", "scientificName" FROM cont LEFT JOIN brands USING ("taxonId")'))
def j10_j14_labels(spark, sf):
    table = statistics.contingency(d.site_statistics(spark, sf), d.region_ring(spark, sf)).select("cluster", "taxonId")
    return plot_data.labelled(table, d.brands(spark, sf)).select("cluster", "taxonId", "scientificName")


@query(sql("seen", 'SELECT DISTINCT "scientificName", "taxonKey" FROM seen'))
def a2_distinct_taxa(spark, sf):
    return d.taxonomy(spark, sf).select("scientificName", F.col("gbifTaxonId").alias("taxonKey"))


@query(sql("allcells", "SELECT geocode, is_edge FROM allcells"))
def a3_g1_f5_cells(spark, sf):
    return d.cell_table(spark, sf).select("geocode", "is_edge")


@query(sql("tax", 'SELECT "taxonId", "scientificName", "gbifTaxonId" FROM tax'))
def x7_w1_taxonomy(spark, sf):
    return d.taxonomy(spark, sf)


@query(sql("counts", 'SELECT geocode, "taxonId", count FROM counts'))
def x8_geocode_taxa_counts(spark, sf):
    """The flagship: individuals of each taxon in each non-edge cell of the box."""
    return d.counts(spark, sf)


@query(sql("stat", "SELECT cluster, \"taxonId\", count, round(average, 9) AS average FROM stat"))
def x1_a7_u1_w6_statistics(spark, sf):
    return rounded(d.site_statistics(spark, sf), "average", digits=9)


@query(sql("around", "SELECT * FROM around"))
def a8_neighbor_totals(spark, sf):
    return statistics.neighbor_totals(d.site_statistics(spark, sf), d.region_ring(spark, sf))


@query("SELECT DISTINCT CAST(a.n_regionkey AS INT) AS cluster, CAST(b.n_regionkey AS INT) AS neighbor FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey + 1) % 25, (a.n_nationkey + 24) % 25, (a.n_nationkey + 5) % 25, (a.n_nationkey + 20) % 25) WHERE a.n_regionkey <> b.n_regionkey")
def g7_a9_j8_cluster_neighbors(spark, sf):
    return statistics.cluster_neighbors(d.site_neighbors(spark, sf), d.site_clusters(spark, sf)).select("cluster", F.explode("direct_and_indirect_neighbors").alias("neighbor"))


@query(sql("clus", "SELECT cluster, string_agg(CAST(geocode AS VARCHAR), ',' ORDER BY geocode) AS geocodes FROM clus GROUP BY 1"))
def a10_members(spark, sf):
    return statistics.members(d.site_clusters(spark, sf)).select("cluster", F.array_join("geocodes", ",").alias("geocodes"))


@query(sql("clus", "SELECT max(cluster) AS last FROM clus"))
def a13_cluster_labels(spark, sf):
    return spark.createDataFrame([(statistics.last_label(d.site_clusters(spark, sf)),)], "last int")


@query(sql("quart", 'SELECT "taxonId", round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3 FROM quart'))
def a12_percentiles(spark, sf):
    """Exact quartiles over all sites, read off the non-zero counts."""
    found = distances.implicit_percentiles(d.sites(spark, sf), "taxonId", "count", d.site_index(spark, sf).count())
    return rounded(found.select("taxonId", F.col("p0").alias("q1"), F.col("p1").alias("q2"), F.col("p2").alias("q3")), "q1", "q2", "q3")


@query(sql("corner", "SELECT round(min(x), 6) AS west, round(max(x), 6) AS east, round(min(y), 6) AS south, round(max(y), 6) AS north FROM corner"))
def a14_envelope(spark, sf):
    return rounded(export.envelope(d.cell_table(spark, sf)), "west", "east", "south", "north")


@query(sql("filled idx", f"SELECT geocode, {', '.join(f'max(CASE WHEN taxonId = {k} THEN v END) AS t{k}' for k in range(25))} FROM filled JOIN idx USING (i) GROUP BY 1"))
def a15_f19_pivot(spark, sf):
    """The dense matrix of sites and brands (25 brands at every scale)."""
    full = distances.dense(d.sites(spark, sf), "geocode", "taxonId", "count")
    return full.groupBy("geocode").pivot("taxonId", list(range(25))).agg(F.first("count")).toDF("geocode", *(f"t{k}" for k in range(25)))


# ---- windows, sorts ----------------------------------------------------------


@query(sql("metrics", "SELECT num_clusters, CAST(row_number() OVER (ORDER BY comb DESC, num_clusters) AS INT) AS rank FROM metrics"))
def v11_w2_summary(spark, sf):
    return metrics.summary(table_of_metrics(spark, sf)).select("num_clusters", "rank")


@query(sql("metrics", "SELECT num_clusters, rank() OVER (ORDER BY inertia) + (count(*) OVER (PARTITION BY inertia) - 1) / 2 AS inertia_rank, rank() OVER (ORDER BY sil DESC) + (count(*) OVER (PARTITION BY sil) - 1) / 2 AS silhouette_score_rank FROM metrics"))
def w3_average_ranks(spark, sf):
    return metrics.average_ranks(table_of_metrics(spark, sf)).select("num_clusters", "inertia_rank", "silhouette_score_rank")


@query(sql("inert", "SELECT num_clusters, round(coalesce(inertia - lag(inertia) OVER w, 0e0), 6) AS delta FROM inert WINDOW w AS (ORDER BY num_clusters)"))
def v10_w4_differences(spark, sf):
    return rounded(metrics.differences(metrics.inertia(d.site_pairs(spark, sf), d.site_labels(spark, sf))).select("num_clusters", "delta"), "delta")


@query(sql("clus", "SELECT geocode, CAST(dense_rank() OVER (ORDER BY 3 * cluster % 7) - 1 AS INT) AS label FROM clus"))
def w5_dense_labels(spark, sf):
    """Labels with gaps (0, 3, 6, 2, 5), numbered from 0 as the permutation test does."""
    rows = d.site_clusters(spark, sf).select("geocode", (3 * F.col("cluster") % 7).alias("label")).collect()
    codes, _ = statistics.dense_codes(np.array([r["label"] for r in rows]))
    return spark.createDataFrame(list(zip([r["geocode"] for r in rows], codes.tolist(), strict=True)), "geocode bigint, label int")


@query(sql("idx", "SELECT geocode, i FROM idx"))
def w8_t1_index(spark, sf):
    return d.site_index(spark, sf)


@query(sql("metrics", "SELECT num_clusters FROM metrics ORDER BY comb DESC, num_clusters LIMIT 1"))
def t3_best_combined(spark, sf):
    return metrics.best_combined(table_of_metrics(spark, sf)).select("num_clusters")


@query(sql("cdist", "SELECT CASE WHEN a = 2 THEN b ELSE a END AS cluster, round(distance, 6) AS distance FROM cdist WHERE a = 2 OR b = 2 ORDER BY distance, cluster LIMIT 3"))
def t4_nearest_clusters(spark, sf):
    return rounded(distances.nearest_clusters(distances.cluster_distances(d.site_statistics(spark, sf)), 2, 3), "distance")


@query(sql("cont", 'SELECT cluster, "taxonId" FROM cont ORDER BY abs(log2_fold_change) DESC, "taxonId" LIMIT 10'))
def t7_t8_sorted_taxa(spark, sf):
    table = statistics.contingency(d.site_statistics(spark, sf), d.region_ring(spark, sf))
    return export.sorted_taxa(table, "fold_change").limit(10).select("cluster", "taxonId")


# ---- functions ---------------------------------------------------------------


@query(sql("center", "SELECT geocode, round(lng, 6) + 0e0 AS lng, round(lat, 6) + 0e0 AS lat FROM center"))
def f2_center(spark, sf):
    return rounded(d.cell_table(spark, sf).select("geocode", "center.lng", "center.lat"), "lng", "lat")


@query(sql("corner", "SELECT geocode, k, round(x, 6) AS lng, round(y, 6) AS lat FROM corner"))
def f3_boundary(spark, sf):
    points = d.cell_table(spark, sf).select("geocode", F.posexplode("boundary").alias("k", "p"))
    return rounded(points.select("geocode", F.col("k").cast("bigint").alias("k"), F.col("p.lng").alias("lng"), F.col("p.lat").alias("lat")), "lng", "lat")


@query(sql("adj", "SELECT geocode, neighbor FROM adj"))
def f4_g2_adjacency(spark, sf):
    return cells.adjacency(d.cell_table(spark, sf)).select("geocode", F.explode("direct_neighbors").alias("neighbor"))


@query("SELECT CAST(n_nationkey AS INT) AS k, '#' || lower(printf('%02x%02x%02x', CAST(floor(n_nationkey * 10 * 0.5e0) AS INT), CAST(floor(n_nationkey * 0.5e0) AS INT), CAST(floor((255 - n_nationkey) * 0.5e0) AS INT))) AS dark FROM nation")
def f6_f7_darken(spark, sf):
    n = F.col("n_nationkey")
    color = F.format_string("#%02x%02x%02x", (n * 10).cast("int"), n.cast("int"), (255 - n).cast("int"))
    return d.read(spark, sf, "nation").select(n.cast("int").alias("k"), colors.darken_column(color).alias("dark"))


@query("SELECT * FROM (VALUES (0, '#fed976'), (1, '#fd8c3c'), (2, '#e2191c')) t(k, color)")
def f9_palette(spark, sf):
    return spark.createDataFrame(list(enumerate(colors.palette(3))), "k int, color string")


@query(sql("cont", "SELECT cluster, \"taxonId\", cluster_count, neighbor_count, cluster_total, neighbor_total, round(log2_fold_change, 6) AS log2_fold_change FROM cont"))
def x2_f10_contingency(spark, sf):
    table = statistics.contingency(d.site_statistics(spark, sf), d.region_ring(spark, sf))
    return rounded(table.select("cluster", "taxonId", "cluster_count", "neighbor_count", "cluster_total", "neighbor_total", "log2_fold_change"), "log2_fold_change")


@query(sql("cont", "SELECT cluster, \"taxonId\", round(CASE WHEN f <= 0 THEN 0e0 ELSE (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END, 6) AS high, round(CASE WHEN f >= 0 THEN 0e0 ELSE (1 - (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ())) * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END, 6) AS low FROM (SELECT cluster, \"taxonId\", log2_fold_change AS f, ln(cluster_count) AS c FROM cont)"))
def w7_f11_a11_scores(spark, sf):
    table = statistics.with_scores(statistics.contingency(d.site_statistics(spark, sf), d.region_ring(spark, sf)))
    return rounded(table.select("cluster", "taxonId", F.col("high_log2_high_count_score").alias("high"), F.col("low_log2_high_count_score").alias("low")), "high", "low")


#: p of tables ((a, 8 - a), (6 - a, 2 + a)), by the sum over a's support of the hypergeometric terms.
FISHER_SQL = """
WITH RECURSIVE fact(k, lf) AS (SELECT 0, 0e0 UNION ALL SELECT k + 1, lf + ln(k + 1) FROM fact WHERE k < 20),
prob AS (SELECT f.k AS a, exp(2 * f8.lf + f6.lf + f10.lf - f16.lf - f.lf - g.lf - h.lf - i.lf) AS p
  FROM (SELECT k, lf FROM fact WHERE k <= 6) f JOIN fact g ON g.k = 8 - f.k JOIN fact h ON h.k = 6 - f.k JOIN fact i ON i.k = 2 + f.k
  JOIN fact f8 ON f8.k = 8 JOIN fact f6 ON f6.k = 6 JOIN fact f10 ON f10.k = 10 JOIN fact f16 ON f16.k = 16)
SELECT x.a, round(sum(y.p), 9) AS p FROM prob x JOIN prob y ON y.p <= x.p * (1 + 1e-9) GROUP BY x.a
"""


@query(FISHER_SQL)
def f12_f13_fisher(spark, sf):
    a = spark.range(7).select(F.col("id").cast("int").alias("a"))
    return rounded(a.select("a", fisher_p(F.col("a"), 8 - F.col("a"), 6 - F.col("a"), 2 + F.col("a")).alias("p")), "p", digits=9)


# ---- graph ---------------------------------------------------------------------


@query(sql("adj", "SELECT count(*) AS edges FROM adj WHERE geocode < neighbor"))
def g6_edges(spark, sf):
    return cells.edges(cells.adjacency(d.cell_table(spark, sf)), "direct_neighbors").agg(F.count("*").alias("edges"))


def scattered(spark, sf) -> DataFrame:
    """Three groups of cells that do not touch."""
    return d.cell_table(spark, sf).where("center.lat < 31 OR center.lat > 41 OR (center.lat BETWEEN 35 AND 37 AND center.lng BETWEEN -78 AND -74)")


SCATTERED = "part_ AS (SELECT * FROM center WHERE lat < 31 OR lat > 41 OR (lat BETWEEN 35 AND 37 AND lng BETWEEN -78 AND -74))"
REACH = f"{SCATTERED}, near AS (SELECT geocode, neighbor FROM adj WHERE geocode IN (SELECT geocode FROM part_) AND neighbor IN (SELECT geocode FROM part_)), reach(a, b) AS (SELECT geocode, geocode FROM part_ UNION SELECT reach.a, near.neighbor FROM reach JOIN near ON near.geocode = reach.b), comp AS (SELECT a AS geocode, min(b) AS component FROM reach GROUP BY a)"


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(sql("adj center", f", {REACH} SELECT geocode, component FROM comp")))
def g3_components(spark, sf):
    """Components of cells by their direct neighbours."""
    parts = scattered(spark, sf)
    return cells.components(parts.select("geocode"), cells.edges(cells.adjacency(parts), "direct_neighbors"))


@query(recursive(sql("adj center", f", {REACH} SELECT (SELECT count(DISTINCT component) FROM comp) AS before, (SELECT count(DISTINCT component) FROM comp) - 1 AS links, CAST(1 AS BIGINT) AS after")))
def g3_connected(spark, sf):
    """Groups of cells joined into one component: as many links as there are groups, less one."""
    parts = cells.cut(scattered(spark, sf))
    found = cells.cut(cells.geocode_neighbors(parts))
    before = cells.components(parts.select("geocode"), cells.edges(found, "direct_neighbors")).agg(F.countDistinct("component").alias("before"))
    links = found.agg((F.sum(F.size("direct_and_indirect_neighbors") - F.size("direct_neighbors")) / 2).cast("bigint").alias("links"))
    after = cells.components(parts.select("geocode"), cells.edges(found)).agg(F.countDistinct("component").alias("after"))
    return before.crossJoin(links).crossJoin(after)


@query(recursive(sql("adj center", f", {REACH}, gap AS (SELECT x.component AS a, y.component AS b, min(power(p.lng - q.lng, 2) + power(p.lat - q.lat, 2)) AS d FROM comp x JOIN center p ON p.geocode = x.geocode JOIN comp y ON y.component <> x.component JOIN center q ON q.geocode = y.geocode WHERE (SELECT count(*) FROM near WHERE near.geocode = y.geocode) < 6 GROUP BY 1, 2) SELECT round(min(d), 9) AS nearest FROM gap")))
def g3_j17_nearest_link(spark, sf):
    """The shortest of the links that join the groups: the nearest pair of cells of two groups."""
    parts = cells.cut(scattered(spark, sf))
    found = cells.geocode_neighbors(parts).select("geocode", F.explode(F.array_except("direct_and_indirect_neighbors", "direct_neighbors")).alias("other"))
    spot = parts.select("geocode", "center.lng", "center.lat")
    both = found.join(spot, "geocode").join(spot.toDF("other", "x", "y"), "other")
    return rounded(both.agg(F.min(F.pow(F.col("lng") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2)).alias("nearest")), "nearest", digits=9)


@query(sql("innercells adj", "SELECT geocode, count(*) AS n FROM adj WHERE geocode IN (SELECT geocode FROM innercells) AND neighbor IN (SELECT geocode FROM innercells) GROUP BY 1"))
def g4_no_edges(spark, sf):
    table = d.cell_table(spark, sf)
    found = cells.geocode_neighbors_no_edges(cells.geocode_neighbors(table), cells.without_edges(table))
    return found.select("geocode", F.size("direct_neighbors").cast("bigint").alias("n")).where("n > 0")


@query("SELECT count(*) AS edges FROM (SELECT DISTINCT least(a, b), greatest(a, b) FROM (SELECT n_nationkey AS a, unnest([(n_nationkey + 1) % 25, (n_nationkey + 5) % 25]) AS b FROM nation))")
def g5_connectivity(spark, sf):
    return cells.connectivity(d.site_neighbors(spark, sf)).agg(F.count("*").alias("edges"))


def pick_sql(k: str) -> str:
    """Colours of regions 0..k - 1 one after the other: the smallest that no neighbour before it has."""
    return f"ring_ AS (SELECT cluster, list(other) AS others FROM ring GROUP BY 1), step(k, used) AS (SELECT 0, []::INT[] UNION ALL SELECT k + 1, list_append(used, (SELECT min(c) FROM range(0, 6) t(c) WHERE NOT list_contains([used[o + 1] FOR o IN others IF o < k], c))::INT) FROM step JOIN ring_ ON ring_.cluster = step.k WHERE k < {k})"


@query(recursive(sql("ring", f", {pick_sql('5')} SELECT CAST(i AS INT) AS cluster, ['#fed976', '#fd8c3c', '#e2191c'][used[i + 1] + 1] AS color FROM step, range(0, 5) t(i) WHERE k = 5")))
def g8_g9_g11_coloring(spark, sf):
    """Greedy colours of the ring of regions, through the map of colours; all have two neighbours, so they go by number."""
    found = coloring.as_map(coloring.cluster_colors(d.region_ring(spark, sf)))
    return spark.createDataFrame(sorted(found.items()), "cluster int, color string")


@query()
def g10_taxonomic_coloring(spark, sf):
    stats = statistics.cluster_taxa_statistics(d.sites(spark, sf), d.site_clusters(spark, sf).select("geocode", F.col("geocode").cast("int").alias("cluster")), d.brands(spark, sf))
    return coloring.cluster_colors(d.region_ring(spark, sf), stats, "taxonomic")


# ---- matrices ------------------------------------------------------------------


@query(sql("sc", 'SELECT i, "taxonId", round(x, 6) + 0e0 AS x FROM sc'))
def m1_f15_scaled(spark, sf):
    long = d.sites(spark, sf).join(d.site_index(spark, sf), "geocode").select("i", "taxonId", "count")
    return rounded(distances.scaled(long, "i", "taxonId", "count").withColumnRenamed("count", "x"), "x")


@query(sql("dist", "SELECT i, j, round(d, 6) AS d FROM dist"))
def m3_f14_j16_geocode_distances(spark, sf):
    return rounded(d.site_pairs(spark, sf), "d")


@query()
def m2_reduced_distances(spark, sf):
    return rounded(distances.geocode_distances(d.sites(spark, sf), d.site_index(spark, sf), "pca", 5), "d")


@query(sql("cdist", "SELECT a, b, round(distance, 6) AS distance FROM cdist"))
def m4_m5_cluster_distances(spark, sf):
    return rounded(distances.cluster_distances(d.site_statistics(spark, sf)), "distance")


@query(sql("sq", "SELECT count(*) AS n, round(sum(d), 6) AS total FROM sq"))
def f17_square(spark, sf):
    return rounded(d.site_square(spark, sf).agg(F.count("*").alias("n"), F.sum("d").alias("total")), "total")


@query("WITH mean AS (SELECT list(x ORDER BY p) AS v FROM (SELECT p, avg(x) AS x FROM (SELECT unnest(range(1, len(embedding) + 1)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY p)) SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), v) ** 2, 5) AS squared, round(list_distance(CAST(embedding AS DOUBLE[]), v), 5) AS dist FROM embeddings CROSS JOIN mean")
def f16_distance_to_mean(spark, sf):
    """Distances of all vectors to their mean vector."""
    return rounded(distances.euclidean_to_mean(d.read(spark, sf, "embeddings"), "vec_id", "embedding"), "squared", "dist", digits=5)


# ---- clustering ----------------------------------------------------------------


#: Constrained Ward by definition: 23 times the two touching clusters whose union adds the least to the sum of
#: squares become one (c is the smallest member). A row of the distance matrix is a feature vector.
WARD = """, link AS (SELECT DISTINCT x.i AS a, y.i AS b FROM (SELECT n_nationkey AS p, unnest([(n_nationkey + 1) % 25, (n_nationkey + 24) % 25, (n_nationkey + 5) % 25, (n_nationkey + 20) % 25]) AS q FROM nation) e JOIN idx x ON x.geocode = p JOIN idx y ON y.geocode = q),
tree(step, i, c) AS (
  SELECT 0, i, i FROM idx
  UNION ALL
  SELECT step + 1, i, CASE WHEN c = b THEN a ELSE c END FROM tree, (
    SELECT p.c AS a, q.c AS b
    FROM (SELECT c, j, avg(d) AS m, count(*) AS n FROM tree t JOIN sq ON sq.i = t.i GROUP BY c, j) p
    JOIN (SELECT c, j, avg(d) AS m, count(*) AS n FROM tree t JOIN sq ON sq.i = t.i GROUP BY c, j) q ON p.j = q.j AND p.c < q.c
    WHERE (p.c, q.c) IN (SELECT least(u.c, v.c), greatest(u.c, v.c) FROM tree u JOIN link ON link.a = u.i JOIN tree v ON v.i = link.b)
    GROUP BY 1, 2 ORDER BY any_value(p.n * q.n / (p.n + q.n)) * sum((p.m - q.m) * (p.m - q.m)) LIMIT 1)
  WHERE step < 23)"""


@query(recursive(sql("sq idx", WARD + " SELECT num_clusters, CAST(count(DISTINCT c) AS INT) AS clusters, count(*) AS cells, max(n) AS largest FROM (SELECT CAST(25 - step AS INT) AS num_clusters, c, count(*) OVER (PARTITION BY step, c) AS n FROM tree WHERE step BETWEEN 19 AND 23) GROUP BY 1")))
def c1_c2_c3_u3_ward(spark, sf):
    """Clusters, cells and the largest cluster by k of the constrained tree over the sites."""
    sizes = ward_labels(spark, sf).groupBy("num_clusters", "cluster").agg(F.count("*").alias("n"))
    return sizes.groupBy("num_clusters").agg(F.count("*").cast("int").alias("clusters"), F.sum("n").alias("cells"), F.max("n").alias("largest"))


def ward_labels(spark, sf) -> DataFrame:
    return ward.cluster_multi_k(d.site_pairs(spark, sf), cells.connectivity(d.site_neighbors(spark, sf)), d.site_index(spark, sf), 2, 6)


@query(recursive(sql("sq idx", WARD + " SELECT geocode, CAST(25 - step AS INT) AS num_clusters, first.f AS first FROM (SELECT step, i, c FROM tree WHERE step BETWEEN 19 AND 23) t JOIN idx USING (i) JOIN (SELECT step, c, min(geocode) AS f FROM tree JOIN idx USING (i) GROUP BY 1, 2) first USING (step, c)")))
def c3_ward_labels(spark, sf):
    """Which cells are together for each k; a cluster is named by its smallest cell."""
    multi = ward_labels(spark, sf)
    return multi.select("geocode", "num_clusters", F.min("geocode").over(Window.partitionBy("num_clusters", "cluster")).alias("first"))


#: Ward's update of squared distances, summed up: 2 |A| |B| / (|A| + |B|) times (mean across - half of both means within).
LINKAGE = """, tree(step, i, c, pos) AS (
  SELECT 0, i, i, 0 FROM idx
  UNION ALL
  SELECT step + 1, i, CASE WHEN c = b THEN a ELSE c END, CASE WHEN c = b THEN pos + size ELSE pos END FROM tree, (
    SELECT x.a, x.b, CAST(p.n AS INT) AS size
    FROM (SELECT u.c AS a, v.c AS b, sum(sq.d * sq.d) AS s FROM tree u JOIN sq ON sq.i = u.i JOIN tree v ON v.i = sq.j GROUP BY 1, 2) x
    JOIN (SELECT u.c, sum(sq.d * sq.d) AS s FROM tree u JOIN sq ON sq.i = u.i JOIN tree v ON v.i = sq.j AND v.c = u.c GROUP BY 1) pp ON pp.c = x.a
    JOIN (SELECT u.c, sum(sq.d * sq.d) AS s FROM tree u JOIN sq ON sq.i = u.i JOIN tree v ON v.i = sq.j AND v.c = u.c GROUP BY 1) qq ON qq.c = x.b
    JOIN (SELECT c, count(*) AS n FROM tree GROUP BY 1) p ON p.c = x.a JOIN (SELECT c, count(*) AS n FROM tree GROUP BY 1) q ON q.c = x.b
    WHERE x.a < x.b
    ORDER BY 2 * p.n * q.n / (p.n + q.n) * (x.s / (p.n * q.n) - pp.s / (2 * p.n * p.n) - qq.s / (2 * q.n * q.n)) LIMIT 1)
  WHERE step < 24)"""


@query(recursive(sql("sq idx", LINKAGE + " SELECT pos AS place, geocode FROM tree JOIN idx USING (i) WHERE step = 24")))
def c4_linkage_order(spark, sf):
    order = plot_data.heatmap_rows(d.site_pairs(spark, sf), d.site_index(spark, sf))
    return spark.createDataFrame(list(enumerate(order)), "place int, geocode bigint")


# ---- validation ----------------------------------------------------------------


def table_of_metrics(spark, sf) -> DataFrame:
    pairs, index = d.site_pairs(spark, sf), cells.cut(d.site_index(spark, sf))
    return metrics.cluster_metrics(pairs, distances.square(pairs, index), cells.cut(d.site_labels(spark, sf)))


@query(sql("sil", "SELECT num_clusters, round(avg(s), 6) + 0e0 AS silhouette FROM sil GROUP BY 1"))
def v1_silhouette_mean(spark, sf):
    return rounded(metrics.silhouettes(d.site_square(spark, sf), d.site_labels(spark, sf)).groupBy("num_clusters").agg(F.avg("silhouette_score").alias("silhouette")), "silhouette")


@query(sql("sil idx", "SELECT geocode, round(s, 6) + 0e0 AS silhouette_score, num_clusters FROM sil JOIN idx USING (i) UNION ALL SELECT NULL, round(avg(s), 6) + 0e0, num_clusters FROM sil GROUP BY num_clusters"))
def v2_u2_t6_silhouettes(spark, sf):
    return rounded(metrics.silhouette_table(d.site_square(spark, sf), d.site_labels(spark, sf), d.site_index(spark, sf)), "silhouette_score")


@query(sql("ch", "SELECT num_clusters, round(ch, 6) AS score FROM ch"))
def v3_calinski_harabasz(spark, sf):
    return rounded(metrics.calinski_harabasz(d.site_square(spark, sf), d.site_labels(spark, sf)).toDF("num_clusters", "score"), "score")


@query(sql("db", "SELECT num_clusters, round(db, 6) AS score FROM db"))
def v4_davies_bouldin(spark, sf):
    return rounded(metrics.davies_bouldin(d.site_square(spark, sf), d.site_labels(spark, sf)).toDF("num_clusters", "score"), "score")


@query(sql("inert", "SELECT num_clusters, round(inertia, 6) AS inertia FROM inert"))
def v5_inertia(spark, sf):
    return rounded(metrics.inertia(d.site_pairs(spark, sf), d.site_labels(spark, sf)), "inertia")


@query(sql("metrics", "SELECT num_clusters, round(nsil, 6) AS silhouette_normalized, round(nch, 6) AS calinski_harabasz_normalized, round(ndb, 6) AS davies_bouldin_normalized, round(nin, 6) AS inertia_normalized, round(comb, 6) AS combined_score FROM metrics"))
def v6_metrics(spark, sf):
    names = ("silhouette_normalized", "calinski_harabasz_normalized", "davies_bouldin_normalized", "inertia_normalized", "combined_score")
    return rounded(table_of_metrics(spark, sf).select("num_clusters", *names), *names)


@query("SELECT 3 AS k1, CAST(NULL AS INT) AS k2, 2 AS k3")
def v7_elbow(spark, sf):
    found = (metrics.elbow([1, 2, 3, 4, 5, 6], [100, 50, 20, 18, 17, 16]), metrics.elbow([1, 2, 3, 4, 5], [50, 40, 30, 20, 10]), metrics.elbow([2, 3, 4, 5, 6, 7], [90, 100, 50, 20, 18, 17]))
    return spark.createDataFrame([found], "k1 int, k2 int, k3 int")


#: The knee of inertia by k (differences from the diagonal, highs, and the first fall below a high less one step), else the best score.
KNEE = """, curve AS (SELECT num_clusters AS k, comb, (num_clusters - min(num_clusters) OVER ()) / (max(num_clusters) OVER () - min(num_clusters) OVER ()) AS u, (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS v FROM metrics),
bent AS (SELECT *, max(v) OVER () - v - u AS dd FROM curve),
marked AS (SELECT *, dd >= coalesce(lag(dd) OVER w, dd) AND dd >= coalesce(lead(dd) OVER w, dd) AS high, dd <= coalesce(lag(dd) OVER w, dd) AND dd <= coalesce(lead(dd) OVER w, dd) AS low, lead(dd) OVER w AS ahead, (SELECT abs(avg(g)) FROM (SELECT u - lag(u) OVER (ORDER BY k) AS g FROM bent)) AS stride FROM bent WINDOW w AS (ORDER BY k)),
tops AS (SELECT *, max(CASE WHEN high THEN k END) OVER (ORDER BY k) AS top FROM marked),
falls AS (SELECT t.k, t.top FROM tops t JOIN marked m ON m.k = t.top WHERE t.ahead < CASE WHEN EXISTS (SELECT 1 FROM marked l WHERE l.low AND NOT l.high AND l.k > t.top AND l.k <= t.k) THEN 0 ELSE m.dd - t.stride END)"""


@query(sql("metrics", KNEE + " SELECT CAST(coalesce((SELECT top FROM falls ORDER BY k LIMIT 1), (SELECT num_clusters FROM metrics ORDER BY comb DESC, num_clusters LIMIT 1)) AS INT) AS k"))
def v8_v9_choose_k(spark, sf):
    return spark.createDataFrame([(metrics.choose_k(table_of_metrics(spark, sf)),)], "k int")


@query(sql("metrics", KNEE + """, line AS (SELECT first(v ORDER BY k) AS v0, last(v ORDER BY k) AS v1 FROM bent) SELECT m.num_clusters AS k, round(m.inertia, 6) AS inertia, CAST(coalesce((SELECT top FROM falls ORDER BY k LIMIT 1), 0) AS INT) AS elbow_k, round(abs((v1 - v0) * b.u - b.v + v0) / sqrt(power(v1 - v0, 2) + 1), 6) + 0e0 AS distance, round(m.inertia - coalesce(lag(m.inertia) OVER w, m.inertia), 6) AS first, round((m.inertia - coalesce(lag(m.inertia) OVER w, m.inertia)) - coalesce(lag(m.inertia) OVER w - coalesce(lag(m.inertia, 2) OVER w, lag(m.inertia) OVER w), m.inertia - coalesce(lag(m.inertia) OVER w, m.inertia)), 6) AS second FROM metrics m JOIN bent b ON b.k = m.num_clusters, line WINDOW w AS (ORDER BY m.num_clusters)"""))
def v10_elbow_analysis(spark, sf):
    found = metrics.elbow_analysis(metrics.inertia(d.site_pairs(spark, sf), d.site_labels(spark, sf)))
    rows = zip(found["k_values"], found["inertia"], [found["elbow_k"]] * len(found["k_values"]), found["distances"], found["first_derivative"], found["second_derivative"], strict=True)
    return rounded(spark.createDataFrame([tuple(r) for r in rows], "k int, inertia double, elbow_k int, distance double, first double, second double"), "inertia", "distance", "first", "second")


@query(sql("cdist clus", "SELECT x.cluster AS a, y.cluster AS b, round(coalesce(distance, 0e0), 6) AS distance FROM (SELECT DISTINCT cluster FROM clus) x CROSS JOIN (SELECT DISTINCT cluster FROM clus) y LEFT JOIN cdist ON cdist.a = least(x.cluster, y.cluster) AND cdist.b = greatest(x.cluster, y.cluster) AND x.cluster <> y.cluster"))
def m5_cluster_distance(spark, sf):
    """The distance of any two clusters, in either order, looked up one by one."""
    table = cells.cut(distances.cluster_distances(d.site_statistics(spark, sf)))
    names = sorted({x for r in table.select("a", "b").collect() for x in r})
    rows = [(a, b, distances.cluster_distance(table, a, b)) for a in names for b in names]
    return rounded(spark.createDataFrame(rows, "a int, b int, distance double"), "distance")


@query("SELECT CAST(n_nationkey AS INT) AS k, '#' || printf('%02x%02x%02x', CAST(floor(f(5) * 255) AS INT), CAST(floor(f(3) * 255) AS INT), CAST(floor(f(1) * 255) AS INT)) AS color FROM nation".replace("f(5)", "(0.8e0 - 0.4e0 * greatest(0, least(least((5 + n_nationkey / 25e0 * 6) % 6, 4 - (5 + n_nationkey / 25e0 * 6) % 6), 1)))").replace("f(3)", "(0.8e0 - 0.4e0 * greatest(0, least(least((3 + n_nationkey / 25e0 * 6) % 6, 4 - (3 + n_nationkey / 25e0 * 6) % 6), 1)))").replace("f(1)", "(0.8e0 - 0.4e0 * greatest(0, least(least((1 + n_nationkey / 25e0 * 6) % 6, 4 - (1 + n_nationkey / 25e0 * 6) % 6), 1)))"))
def f8_hsv(spark, sf):
    """A colour wheel of the nations: hue by number, saturation 0.5, value 0.8."""
    keys = sorted(r["n_nationkey"] for r in d.read(spark, sf, "nation").select("n_nationkey").collect())
    return spark.createDataFrame([(k, colors.hsv_hex(k / 25, 0.5, 0.8)) for k in keys], "k int, color string")


# ---- tests, outlines, exports ----------------------------------------------------


@query(sql("dist clus idx", "SELECT n, groups, round(((st - sw) / (groups - 1)) / (sw / (n - groups)), 6) AS test_statistic FROM (SELECT (SELECT count(*) FROM idx) AS n, (SELECT count(DISTINCT cluster) FROM clus JOIN idx USING (geocode)) AS groups, (SELECT sum(d * d) FROM dist) / (SELECT count(*) FROM idx) AS st, (SELECT sum(d * d / z.n) FROM dist JOIN idx x ON x.i = dist.i JOIN idx y ON y.i = dist.j JOIN clus a ON a.geocode = x.geocode JOIN clus b ON b.geocode = y.geocode AND b.cluster = a.cluster JOIN (SELECT cluster, count(*) AS n FROM clus JOIN idx USING (geocode) GROUP BY 1) z ON z.cluster = a.cluster) AS sw)"))
def x3_pseudo_f(spark, sf):
    labels = d.site_index(spark, sf).join(d.site_clusters(spark, sf), "geocode").select("i", "cluster")
    return rounded(statistics.pseudo_f(d.site_pairs(spark, sf), labels), "test_statistic")


@query()
def x3_permanova(spark, sf):
    rows = d.site_index(spark, sf).join(d.site_clusters(spark, sf), "geocode").orderBy("i").collect()
    return statistics.permanova(distances.matrix(d.site_pairs(spark, sf), len(rows)), np.array([r["cluster"] for r in rows]), spark)


#: Fisher's two-sided p by definition: the hypergeometric terms over the whole support that are no larger than the table's own.
FISHER = """, t AS (SELECT *, CAST(cluster_count AS BIGINT) AS a, CAST(cluster_total AS BIGINT) AS r1, CAST(neighbor_total AS BIGINT) AS r2, CAST(cluster_count + neighbor_count AS BIGINT) AS c1 FROM cont),
term AS (SELECT cluster, taxonId, a, k, lgamma(r1 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) + lgamma(r2 + 1) - lgamma(c1 - k + 1) - lgamma(r2 - c1 + k + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1) AS lp FROM (SELECT *, unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) AS k FROM t)),
own AS (SELECT cluster, taxonId, lp AS mine FROM term WHERE k = a),
pv AS (SELECT cluster, taxonId, least(1e0, sum(exp(lp))) AS p_value FROM term JOIN own USING (cluster, taxonId) WHERE lp <= mine + 1e-7 GROUP BY 1, 2),
sig AS (SELECT cont.*, p_value, log2_fold_change AS f, ln(cluster_count) AS c FROM cont JOIN pv USING (cluster, taxonId) WHERE p_value < 0.05),
scored AS (SELECT *, CASE WHEN f <= 0 OR max(f) OVER () = min(f) OVER () OR max(c) OVER () = min(c) OVER () THEN 0e0 ELSE (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END AS high, CASE WHEN f >= 0 OR max(f) OVER () = min(f) OVER () OR max(c) OVER () = min(c) OVER () THEN 0e0 ELSE (1 - (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ())) * (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) END AS low FROM sig)"""


@query(sql("cont", FISHER + ' SELECT cluster, taxonId AS "taxonId", round(p_value, 6) + 0e0 AS p_value, round(log2_fold_change, 6) AS log2_fold_change, cluster_count, neighbor_count, round(high, 6) + 0e0 AS high_log2_high_count_score, round(low, 6) + 0e0 AS low_log2_high_count_score FROM scored'))
def x2_significant_differences(spark, sf):
    found = statistics.significant_differences(d.site_statistics(spark, sf), d.region_ring(spark, sf))
    return rounded(found, "p_value", "log2_fold_change", "high_log2_high_count_score", "low_log2_high_count_score")


def banded(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cells of the grid in four bands of longitude."""
    table = d.inner_cells(spark, sf)
    return table, table.select("geocode", F.floor((F.col("center.lng") + 90) / 6).cast("int").alias("cluster"))


BANDS = ", band AS (SELECT geocode, CAST(floor((lng + 90) / 6) AS INT) AS cluster FROM center WHERE geocode IN (SELECT geocode FROM innercells))"
#: Sides of cells that no second cell of the same cluster has.
OUTLINE = BANDS + ", lone AS (SELECT cluster, any_value(round(x0, 6)) AS x0, any_value(round(y0, 6)) AS y0, any_value(round(x1, 6)) AS x1, any_value(round(y1, 6)) AS y1 FROM side JOIN band USING (geocode) GROUP BY cluster, round((x0 + x1) / 2, 6), round((y0 + y1) / 2, 6) HAVING count(*) = 1)"


@query(sql("side center innercells", BANDS + " SELECT cluster, round(sum(x0 * y1 - x1 * y0) / 2, 4) AS area FROM side JOIN band USING (geocode) GROUP BY 1"))
def x4_boundary_area(spark, sf):
    """Area (square degrees) inside each dissolved outline; equal to the sum over its cells."""
    table, clusters = banded(spark, sf)
    edges = boundary.outline_edges(clusters, table)
    area = F.sum((F.col("x0") / boundary.SNAP) * (F.col("y1") / boundary.SNAP) - (F.col("x1") / boundary.SNAP) * (F.col("y0") / boundary.SNAP)) / 2
    return rounded(edges.groupBy("cluster").agg(area.alias("area")), "area", digits=4)


def coordinates(df: DataFrame, geometry: str) -> DataFrame:
    """(cluster, polygon, ring, at, lng, lat) of each point of a MultiPolygon's GeoJSON text."""
    rings = df.select("cluster", F.posexplode(F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")).alias("polygon", "p"))
    points = rings.select("cluster", "polygon", F.posexplode("p").alias("ring", "r")).select("cluster", "polygon", "ring", F.posexplode("r").alias("at", "xy"))
    return points.select("cluster", "polygon", "ring", "at", F.col("xy")[0].alias("lng"), F.col("xy")[1].alias("lat"))


@query(sql("side center innercells", OUTLINE + " SELECT cluster, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT cluster, CAST(round(x0 * 1e4) AS BIGINT) || ' ' || CAST(round(y0 * 1e4) AS BIGINT) AS a, CAST(round(x1 * 1e4) AS BIGINT) || ' ' || CAST(round(y1 * 1e4) AS BIGINT) AS b FROM lone)"))
def x4_j15_cluster_boundary(spark, sf):
    """Every step along every ring of the dissolved outlines, as a pair of points on a lattice of 1e-4 degrees."""
    table, clusters = banded(spark, sf)
    points = coordinates(boundary.cluster_boundary(clusters, table).select("cluster", wkb.geometry_json("geometry").alias("g")), "g")
    spot = F.concat_ws(" ", *(F.round(F.col(c) * 1e4).cast("bigint").cast("string") for c in ("lng", "lat")))
    steps = points.select("cluster", "at", spot.alias("a"), F.lead(spot).over(Window.partitionBy("cluster", "polygon", "ring").orderBy("at")).alias("b")).where("b IS NOT NULL")
    return steps.select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query(sql("side center innercells", OUTLINE + " SELECT cluster, count(*) AS steps FROM lone GROUP BY 1"))
def x4_outline_edges(spark, sf):
    table, clusters = banded(spark, sf)
    return boundary.outline_edges(clusters, table).groupBy("cluster").agg(F.count("*").alias("steps"))


def export_frames(spark, sf) -> tuple[DataFrame, DataFrame]:
    table, clusters = banded(spark, sf)
    outline = boundary.cluster_boundary(clusters, table)
    shades = colors.palette(8)
    pairs = spark.createDataFrame([(k, shades[k], colors.darken(shades[k])) for k in range(8)], coloring.SCHEMA)
    return outline, pairs


@query(sql("side center innercells", OUTLINE + """ SELECT cluster, 'FeatureCollection' AS collection, 'Feature' AS type, 'MultiPolygon' AS geometry, 0.7e0 AS opacity, CAST(1 AS INT) AS weight, cluster AS property, n AS steps, round(area, 4) AS area FROM (SELECT cluster, count(*) AS n FROM lone GROUP BY 1) JOIN (SELECT cluster, sum(x0 * y1 - x1 * y0) / 2 AS area FROM side JOIN band USING (geocode) GROUP BY 1) USING (cluster)"""))
def j9_f21_f22_features(spark, sf):
    """The feature collection, written as text and read again: properties, and steps and area of each geometry."""
    text = export.feature_collection(*export_frames(spark, sf))
    found = spark.createDataFrame([(text,)], "t string").select(F.get_json_object("t", "$.type").alias("collection"), F.explode(F.from_json(F.get_json_object("t", "$.features"), "array<string>")).alias("f"))
    part = lambda path: F.get_json_object("f", path)
    rows = found.select(part("$.properties.cluster").cast("int").alias("cluster"), "collection", part("$.type").alias("type"), part("$.geometry.type").alias("geometry"), part("$.properties.fillOpacity").cast("double").alias("opacity"), part("$.properties.weight").cast("int").alias("weight"), part("$.properties.cluster").cast("int").alias("property"), part("$.geometry").alias("g"))
    ring = Window.partitionBy("cluster", "polygon", "ring").orderBy("at")
    x, y = F.lead("lng").over(ring), F.lead("lat").over(ring)
    steps = coordinates(rows, "g").select("cluster", (F.col("lng") * y - x * F.col("lat")).alias("turn")).where("turn IS NOT NULL")
    sizes = steps.groupBy("cluster").agg(F.count("*").alias("steps"), (F.sum("turn") / 2).alias("area"))
    return rounded(rows.drop("g").join(sizes, "cluster"), "area", digits=4)


@query("SELECT CAST(n_nationkey AS INT) AS cluster, lower(c) AS \"fillColor\", lower('#' || printf('%02x%02x%02x', n_nationkey * 5, n_nationkey, 100)) AS color FROM (SELECT n_nationkey, '#' || printf('%02x%02x%02x', n_nationkey * 10, n_nationkey * 2, 200) AS c FROM nation)")
def f21_feature_colors(spark, sf):
    """Fill and line colours of features, one for each nation."""
    n = F.col("n_nationkey")
    fill = F.format_string("#%02x%02x%02x", n * 10, n * 2, F.lit(200))
    rows = d.read(spark, sf, "nation").select(n.cast("int").alias("cluster"), fill.alias("color"), colors.darken_column(fill).alias("darkened_color"), wkb.point_wkb(n.cast("double"), F.lit(1.5)).alias("geometry"))
    found = export.features(rows.select("cluster", "geometry"), rows.select("cluster", "color", "darkened_color"))
    return found.select("cluster", F.get_json_object("feature", "$.properties.fillColor").alias("fillColor"), F.get_json_object("feature", "$.properties.color").alias("color"))


@query(sql("cont brands center innercells", FISHER + BANDS + """ SELECT s.cluster, s.taxonId AS taxon_id, b.scientificName AS scientific_name, b.gbifTaxonId AS gbif_taxon_id, round(f, 6) AS log2_fold_change, cluster_count, neighbor_count, round(high, 6) + 0e0 AS high, round(low, 6) + 0e0 AS low, CASE WHEN s.taxonId % 2 = 0 THEN 'https://example.org/' || s.taxonId END AS image_url FROM scored s JOIN brands b ON b.taxonId = s.taxonId AND b.scientificName NOT LIKE '%5' WHERE s.cluster IN (SELECT cluster FROM band)"""))
def f23_j10_j11_documents(spark, sf):
    """The clusters' JSON documents read again: significant taxa known to the taxonomy, with images where there are any."""
    outline, shades = export_frames(spark, sf)
    found = cells.cut(statistics.significant_differences(d.site_statistics(spark, sf), d.region_ring(spark, sf)))
    taxonomy = d.brands(spark, sf).where("scientificName NOT LIKE '%5'")
    links = taxonomy.where("taxonId % 2 = 0").select("gbifTaxonId", F.concat(F.lit("https://example.org/"), "taxonId").alias("image_url"))
    text = export.output_json(found, outline, taxonomy, shades, images.significant_taxa_images(found, taxonomy, images.from_table(links)))
    documents = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", "array<struct<cluster:int,significant_taxa:array<struct<scientific_name:string,gbif_taxon_id:bigint,taxon_id:bigint,log2_fold_change:double,cluster_count:bigint,neighbor_count:bigint,high_log2_high_count_score:double,low_log2_high_count_score:double,image_url:string>>>>")).alias("c"))
    taxa_rows = documents.select("c.cluster", F.explode("c.significant_taxa").alias("x")).select("cluster", "x.*")
    return rounded(taxa_rows.withColumnsRenamed({"high_log2_high_count_score": "high", "low_log2_high_count_score": "low"}), "log2_fold_change", "high", "low")


@query(sql("site stat clus", 'SELECT geocode, cluster, "taxonId", round(CASE WHEN hi = lo THEN 0.5e0 ELSE (v - lo) / (hi - lo) END, 6) AS value FROM (SELECT *, min(v) OVER (PARTITION BY "taxonId") AS lo, max(v) OVER (PARTITION BY "taxonId") AS hi FROM (SELECT c.geocode, c.cluster, t."taxonId", coalesce(s.count / z.total, 0e0) - coalesce(o.average, 0e0) AS v FROM clus c CROSS JOIN (SELECT DISTINCT "taxonId" FROM site) t LEFT JOIN site s ON s.geocode = c.geocode AND s."taxonId" = t."taxonId" LEFT JOIN (SELECT geocode, sum(count) AS total FROM site GROUP BY 1) z ON z.geocode = c.geocode LEFT JOIN stat o ON o.cluster IS NULL AND o."taxonId" = t."taxonId"))'))
def l1_heatmap(spark, sf):
    picked = d.brands(spark, sf).select("taxonId")
    return rounded(plot_data.heatmap(d.sites(spark, sf), d.site_clusters(spark, sf), d.site_statistics(spark, sf), picked), "value")


@query()
def l2_embedding(spark, sf):
    return rounded(plot_data.embedding(d.site_pairs(spark, sf), d.site_index(spark, sf), d.site_clusters(spark, sf)), "x", "y")


@query(sql("sil idx clus", "SELECT geocode, cluster, round(s, 6) + 0e0 AS silhouette_score FROM sil JOIN idx USING (i) JOIN clus USING (geocode) WHERE num_clusters = 5"))
def l3_silhouette_rows(spark, sf):
    labels = d.site_labels(spark, sf).where("num_clusters = 5")
    table = metrics.silhouette_table(d.site_square(spark, sf), labels, d.site_index(spark, sf))
    return rounded(plot_data.silhouette_rows(table, d.site_clusters(spark, sf)).select("geocode", "cluster", "silhouette_score"), "silhouette_score")
