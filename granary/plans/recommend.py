"""Rating queries: users rate event keys, 1 to 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import recommend as ops
from granary.plans.lineage import keep
from granary.sources.tables import table


def _ratings(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("user"), F.get_json_object("props", "$.k").alias("item"), (1 + F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(5))).cast("double").alias("rating"))


def _all(spark, sf):
    return keep(ops.one_rating(_ratings(spark, sf)))


def _train(spark, sf):
    """Without the tenth that predictions are asked for."""
    return keep(ops.one_rating(_ratings(spark, sf).filter("event_id % 10 <> 0")))


def _queries(spark, sf):
    cold = spark.createDataFrame([(-1, "1"), (1, "none"), (-1, "none")], "user long, item string")
    return _ratings(spark, sf).filter("event_id % 10 = 0").select("user", "item").unionByName(cold).distinct()


def user_means(spark, sf):
    return ops.means(_all(spark, sf), "user").select("user", F.round("user_mean", 6).alias("user_mean"))


def item_means(spark, sf):
    return ops.means(_all(spark, sf), "item").select("item", F.round("item_mean", 6).alias("item_mean"))


def centred_ratings(spark, sf):
    return ops.centred(_all(spark, sf)).select("user", "item", F.round("deviation", 6).alias("deviation"))


def pearson_item_pairs(spark, sf):
    return ops.pearson(ops.centred(_all(spark, sf))).select("a", "b", "n", F.round("similarity", 6).alias("similarity"))


def item_cf_predict(spark, sf):
    return ops.item_cf(_train(spark, sf), _queries(spark, sf)).select("user", "item", F.round("prediction", 5).alias("prediction"))


def _features(spark, sf):
    """Every line as a rating of a supplier by a customer, with what is known of both from all orders and lines."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    pairs = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = pairs.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("user"), F.col("l_suppkey").alias("item"), (1 + F.col("l_quantity") % 5).alias("rating"))
    users = orders.groupBy(F.col("o_custkey").alias("user")).agg(F.avg("o_totalprice").alias("user_average"), F.count("*").alias("user_count"), F.min("o_orderdate").cast("date").cast("string").alias("since"))
    items = lines.groupBy(F.col("l_suppkey").alias("item")).agg(F.avg("l_extendedprice").alias("item_average"), F.count("*").alias("item_count"))
    return ops.features(pairs, users, items, "2002-01-01")


def feature_assembly(spark, sf):
    return _features(spark, sf).select("l_orderkey", "l_linenumber", "user", "item", F.round("user_average", 7).alias("user_average"), "user_count", F.round("item_average", 7).alias("item_average"), "item_count", "days")


def gbt_predict(spark, sf):
    """Predictions for the lines of a tenth of the orders by trees fitted on all others."""
    f = keep(_features(spark, sf))
    return ops.boosted_trees(f.filter("l_orderkey % 10 <> 0"), f.filter("l_orderkey % 10 = 0")).select("user", "item", F.round("prediction", 4).alias("prediction"))


def hybrid_predict(spark, sf):
    """The neighbourhood's predictions and those of trees, both fitted on the same ratings."""
    train, asked = _train(spark, sf), keep(_queries(spark, sf))
    since = table(spark, sf, "events").groupBy(F.col("user_id").alias("user")).agg(F.min("ts").cast("date").cast("string").alias("since"))
    users = train.groupBy("user").agg(F.avg("rating").alias("user_average"), F.count("*").alias("user_count")).join(since, "user")
    items = train.groupBy("item").agg(F.avg("rating").alias("item_average"), F.count("*").alias("item_count"))
    trees = ops.boosted_trees(ops.features(train, users, items, "2025-01-01"), ops.features(asked, users, items, "2025-01-01"))
    overall = train.agg(F.avg("rating")).first()[0]
    return ops.hybrid(asked, ops.item_cf(train, asked), trees, overall).select("user", "item", F.round("prediction", 5).alias("prediction"))


_R = """
r AS (SELECT user_id AS "user", json_extract_string(props, '$.k') AS item, avg((1 + (event_id * 7 + user_id) % 5)::DOUBLE) AS rating FROM events WHERE event_id % 10 <> 0 GROUP BY ALL),
um AS (SELECT "user", avg(rating) AS um FROM r GROUP BY ALL), im AS (SELECT item, avg(rating) AS im FROM r GROUP BY ALL),
d AS (SELECT r."user", r.item, rating - um AS x FROM r JOIN um USING ("user"))"""
_P = """
ps AS (SELECT p.item AS a, q.item AS b, count(*) AS n, sum(p.x) AS sx, sum(q.x) AS sy, sum(p.x * p.x) AS xx, sum(q.x * q.x) AS yy, sum(p.x * q.x) AS xy FROM d p JOIN d q ON p."user" = q."user" AND p.item < q.item GROUP BY ALL),
pear AS (SELECT a, b, n, CASE WHEN xx - sx * sx / n > 1e-9 AND yy - sy * sy / n > 1e-9 THEN (xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) END AS similarity FROM ps)"""
_Q = """
q AS (SELECT DISTINCT user_id AS "user", json_extract_string(props, '$.k') AS item FROM events WHERE event_id % 10 = 0 UNION VALUES (-1, '1'), (1, 'none'), (-1, 'none')),
qa AS (SELECT q.*, um, im FROM q LEFT JOIN um USING ("user") LEFT JOIN im USING (item)),
o AS (SELECT qa."user", qa.item, d.item AS other, d.x, im2.im AS om, qa.im, coalesce(similarity, CASE WHEN qa.im / im2.im BETWEEN 0.9 AND 1.1 THEN 0.9 WHEN qa.im / im2.im BETWEEN 0.8 AND 1.2 THEN 0.7 WHEN qa.im / im2.im BETWEEN 0.7 AND 1.3 THEN 0.5 WHEN qa.im / im2.im BETWEEN 0.6 AND 1.4 THEN 0.3 ELSE 0.1 END) AS s
  FROM qa JOIN d ON d."user" = qa."user" AND d.item <> qa.item JOIN im im2 ON im2.item = d.item LEFT JOIN pear ON a = least(qa.item, d.item) AND b = greatest(qa.item, d.item) WHERE um IS NOT NULL AND qa.im IS NOT NULL),
w AS (SELECT *, round(CASE WHEN s < 0 THEN s * 0.5 ELSE s END, 9) AS w FROM o),
t AS (SELECT "user", item, sum(w * x) AS num, sum(abs(w)) AS den FROM (SELECT *, row_number() OVER (PARTITION BY "user", item ORDER BY abs(w) DESC, other) AS k FROM w) WHERE k <= 18 GROUP BY ALL),
cf AS (SELECT qa."user", qa.item, CASE WHEN um IS NOT NULL AND im IS NOT NULL AND den IS NOT NULL THEN least(greatest(um + CASE WHEN den > 1e-9 THEN num / den ELSE 0 END, 1), 5) WHEN um IS NOT NULL AND im IS NOT NULL THEN 0.6 * um + 0.4 * im ELSE coalesce(im, um, (SELECT avg(rating) FROM r)) END AS prediction FROM qa LEFT JOIN t USING ("user", item))"""
#: The same over all ratings, none held back.
_WHOLE = _R.replace(" WHERE event_id % 10 <> 0", "")
QUERIES = {f.__name__: f for f in (user_means, item_means, centred_ratings, pearson_item_pairs, item_cf_predict, feature_assembly, gbt_predict, hybrid_predict)}
ORACLE = {
    "user_means": f'WITH {_WHOLE} SELECT "user", round(um, 6) AS user_mean FROM um',
    "item_means": f"WITH {_WHOLE} SELECT item, round(im, 6) AS item_mean FROM im",
    "centred_ratings": f'WITH {_WHOLE} SELECT "user", item, round(x, 6) AS deviation FROM d',
    "pearson_item_pairs": f"WITH {_WHOLE}, {_P} SELECT a, b, n, round(similarity, 6) AS similarity FROM pear",
    "item_cf_predict": f'WITH {_R}, {_P}, {_Q} SELECT "user", item, round(prediction, 5) AS prediction FROM cf',
    "feature_assembly": """
WITH p AS (SELECT l_orderkey, l_linenumber, o_custkey AS "user", l_suppkey AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT o_custkey AS "user", avg(o_totalprice) AS a, count(*) AS n, min(o_orderdate)::DATE AS since FROM orders GROUP BY ALL),
i AS (SELECT l_suppkey AS item, avg(l_extendedprice) AS a, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, p."user", p.item, round(u.a, 7) AS user_average, u.n AS user_count, round(i.a, 7) AS item_average, i.n AS item_count, (DATE '2002-01-01' - since)::INT AS days
FROM p LEFT JOIN u USING ("user") LEFT JOIN i USING (item)""",
}
