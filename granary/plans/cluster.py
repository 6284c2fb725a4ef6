"""Cluster queries: embeddings, their labels as first clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import cluster as ops
from granary.sources.tables import table


def _points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def cluster_summary(spark, sf):
    return ops.summaries(_points(spark, sf), "label").select("label", "pos", "n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


def mahalanobis_assign(spark, sf):
    p = _points(spark, sf)
    found = ops.collected(p, "label")
    return ops.nearest(p, found, 2 * 64**0.5, "key").select("id", F.col("key").cast("int").alias("cluster"))


def summary_merge_distance(spark, sf):
    found = ops.collected(_points(spark, sf), "label")
    rows = [(a, b, round(ops.distance(found[a], found[b]), 4)) for a in sorted(found) for b in sorted(found) if a < b]
    return spark.createDataFrame(rows, "a int, b int, distance double")


def kmeans_sizes(spark, sf):
    return ops.kmeans(_points(spark, sf), 10).groupBy("cluster").agg(F.count("*").alias("n"))


def bfr(spark, sf):
    return ops.by_chunks(_points(spark, sf), 10)[0]


def bfr_rounds(spark, sf):
    _, history = ops.by_chunks(_points(spark, sf), 10)
    return spark.createDataFrame([tuple(h.values()) for h in history], "round int, main_points long, small_clusters long, small_points long, kept_points long")


_L = "x AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS pos FROM embeddings), s AS (SELECT label, pos, count(*) AS n, sum(x) AS total, sum(x * x) AS squares FROM x GROUP BY ALL), v AS (SELECT *, total / n AS m, greatest(squares / n - (total / n) * (total / n), 0) AS var FROM s)"
QUERIES = {f.__name__: f for f in (cluster_summary, mahalanobis_assign, summary_merge_distance, kmeans_sizes, bfr, bfr_rounds)}
ORACLE = {
    "cluster_summary": f"WITH {_L} SELECT label, pos, n, round(total, 6) AS total, round(squares, 6) AS squares FROM s",
    "mahalanobis_assign": f"WITH {_L}, d AS (SELECT id, v.label, sqrt(sum((x - m) * (x - m) / CASE WHEN var <= 1e-20 THEN 1e-20 ELSE var END)) AS d FROM x JOIN v USING (pos) GROUP BY ALL) SELECT id, CASE WHEN min(d) < 16 THEN arg_min(label, d) END AS cluster FROM d GROUP BY id",
    "summary_merge_distance": f"WITH {_L} SELECT p.label AS a, q.label AS b, round(sqrt(sum(pow((p.m - q.m) / (sqrt(p.var) + 1e-10), 2))), 4) AS distance FROM v p JOIN v q ON p.pos = q.pos AND p.label < q.label GROUP BY ALL",
}
