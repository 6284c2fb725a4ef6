"""Clusters by summaries: count, sums and sums of squares; assignment, merging, and clustering by chunks."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.columns import chunk_of, mahalanobis
from granary.plans.lineage import keep

Summary = tuple[int, list[float], list[float]]


def summaries(points: DataFrame, key: str) -> DataFrame:
    """(key, pos, n, total, squares): a row for each cluster and component, by partial sums."""
    long = points.select(key, F.posexplode("features").alias("pos", "x"))
    return long.groupBy(key, "pos").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def collected(points: DataFrame, key: str) -> dict[object, Summary]:
    """The same on the driver: as many rows as there are clusters and components."""
    out: dict[object, Summary] = {}
    for r in summaries(points, key).orderBy(key, "pos").collect():
        n, total, squares = out.setdefault(r[key], (r["n"], [], []))
        total.append(r["total"])
        squares.append(r["squares"])
    return out


def merged(a: Summary, b: Summary) -> Summary:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])], [x + y for x, y in zip(a[2], b[2])]


def distance(a: Summary, b: Summary) -> float:
    """Between centroids, scaled by the first's deviations (1e-10 added)."""
    total = 0.0
    for s, q, t in zip(a[1], a[2], b[1]):
        m = s / a[0]
        std = max(q / a[0] - m * m, 0.0) ** 0.5 + 1e-10
        total += ((m - t / b[0]) / std) ** 2
    return total**0.5


def nearest(points: DataFrame, found: dict, threshold: float, name: str) -> DataFrame:
    """points + the key (string) of the nearest summary to `features` that is nearer than the threshold; of equal ones the least key.

    Summaries are one row that all tasks get, as many numbers as there are clusters and components;
    the plan is the same for any number of them.
    """
    if not found:
        return points.withColumn(name, F.lit(None).cast("string"))
    rows = sorted((str(k), float(n), [float(x) for x in t], [float(x) for x in q]) for k, (n, t, q) in found.items())
    one = points.sparkSession.createDataFrame([(rows,)], "__all array<struct<k:string,n:double,t:array<double>,q:array<double>>>")
    each = F.transform("__all", lambda c: F.struct(mahalanobis(F.col("features"), c["n"], c["t"], c["q"]).alias("d"), c["k"].alias("k")))
    best = F.array_min(each)
    joined = points.crossJoin(F.broadcast(one))  # one row
    return joined.withColumn("__best", best).withColumn(name, F.when(F.col("__best.d") < threshold, F.col("__best.k"))).drop("__all", "__best")


def renamed(members: DataFrame, names: dict[str, str], column: str) -> DataFrame:
    """members + the new name of their key, null for a key that has none."""
    if not names:
        return members.withColumn(column, F.lit(None).cast("string"))
    table = members.sparkSession.createDataFrame(sorted(names.items()), f"__from string, {column} string")
    # At most a row for each cluster.
    return members.join(F.broadcast(table), F.col("key") == F.col("__from"), "left").drop("__from")


def kmeans(points: DataFrame, k: int, seed: int = 3, rounds: int = 20) -> DataFrame:
    """points + cluster (int)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = points.withColumn("__v", array_to_vector("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v", predictionCol="cluster").fit(vectors).transform(vectors).drop("__v")


def merge_close(found: dict[str, Summary], threshold: float) -> tuple[dict[str, Summary], dict[str, str]]:
    """Merges pairs nearer than the threshold, beginning anew after each; -> summaries, and which key became which."""
    found, became = dict(found), {}
    again = True
    while again:
        again = False
        keys = sorted(found)
        for i, a in enumerate(keys):
            b = next((b for b in keys[i + 1 :] if distance(found[a], found[b]) < threshold), None)
            if b is not None:
                found[a] = merged(found[a], found.pop(b))
                became = {x: a if y == b else y for x, y in became.items()} | {b: a}
                again = True
                break
    return found, became


def _singles(df: DataFrame) -> tuple[set, set]:
    sizes = {r["cluster"]: r["count"] for r in df.groupBy("cluster").count().collect()}  # as many rows as clusters
    return {c for c, n in sizes.items() if n == 1}, {c for c, n in sizes.items() if n > 1}


def by_chunks(points: DataFrame, k: int, chunks: int = 5, seed: int = 11) -> tuple[DataFrame, list[dict]]:
    """Summary-based clustering of points (id, features) in chunks -> ((id, cluster), counters of each round).

    Points near a cluster's summary (2 sqrt(d)) join it, else a compressed set, else they are
    kept; enough of those are clustered again.  A chunk is assigned against the summaries that
    stood before it, so the result doesn't depend on the order of rows.  What is left in
    compressed sets or kept at the end has cluster -1.
    """
    d = len(points.select("features").first()[0])
    threshold = 2 * d**0.5
    dealt = keep(points.select("id", "features", chunk_of(F.col("id"), chunks, seed).alias("chunk")))
    one = dealt.filter("chunk = 0")
    # First chunk: lone clusters of many stay aside, the rest gives the main clusters.
    many = keep(kmeans(one, min(5 * k, max(1, one.count())), seed))
    lone, _ = _singles(many)
    aside = keep(many.filter(F.col("cluster").isin(list(lone)) if lone else F.lit(False)).select("id", "features"))
    start = keep(kmeans(many.filter(~F.col("cluster").isin(list(lone)) if lone else F.lit(True)).select("id", "features"), k, seed))
    main = {str(c): s for c, s in collected(start, "cluster").items()}
    members = keep(start.select("id", F.lit("main").alias("kind"), F.col("cluster").cast("string").alias("key")))
    small: dict[str, Summary] = {}
    history = []
    for r in range(chunks):
        if r:
            now = keep(nearest(nearest(dealt.filter(F.col("chunk") == r), main, threshold, "m"), small, threshold, "s"))
            joined = now.withColumn("kind", F.when(F.col("m").isNotNull(), "main").when(F.col("s").isNotNull(), "small")).withColumn("key", F.coalesce("m", "s"))
            for kind, found in (("main", main), ("small", small)):
                for c, s in collected(joined.filter(F.col("kind") == kind), "key").items():
                    found[c] = merged(found[c], s)
            members = members.unionByName(joined.filter("kind is not null").select("id", "kind", "key"))
            aside = keep(aside.unionByName(joined.filter("kind is null").select("id", "features")))
        n = aside.count()
        if n >= 5 * k and n > 1:
            again = keep(kmeans(aside, 5 * k, seed))
            lone, grown = _singles(again)
            packed = keep(again.filter(F.col("cluster").isin(list(grown)) if grown else F.lit(False)).withColumn("key", F.concat(F.lit(f"{r}-"), F.col("cluster").cast("string"))))
            small |= collected(packed, "key")
            members = members.unionByName(packed.select("id", F.lit("small").alias("kind"), "key"))
            aside = keep(again.filter(F.col("cluster").isin(list(lone)) if lone else F.lit(False)).select("id", "features"))
        if r:
            small, became = merge_close(small, threshold)
            if became:
                members = renamed(members, became, "now").withColumn("key", F.when(F.col("kind") == "small", F.coalesce("now", "key")).otherwise(F.col("key"))).drop("now")
        members = keep(members)
        kinds = Counter({x["kind"]: x["count"] for x in members.groupBy("kind").count().collect()})
        history.append({"round": r + 1, "main_points": kinds["main"], "small_clusters": len(small), "small_points": kinds["small"], "kept_points": aside.count()})
    last = {}
    for c, s in small.items():
        near = min(((distance(m, s), x) for x, m in main.items()), default=(threshold, ""))
        if near[0] < threshold:
            last[c] = near[1]
    named = renamed(members, last, "near")
    final = named.select("id", F.when(F.col("kind") == "main", F.col("key")).otherwise(F.coalesce(F.when(F.col("kind") == "small", F.col("near")), F.lit("-1"))).cast("int").alias("cluster"))
    return final.unionByName(aside.select("id", F.lit(-1).alias("cluster"))), history
