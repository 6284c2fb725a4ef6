"""Exploration queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.columns import char_sum, chunk_of
from granary.operators import explore
from granary.sources.tables import table

_K = "get_json_object(props, '$.k')"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("k", F.expr(_K))


def _averages(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    places = table(spark, sf, "supplier").filter("s_acctbal > 2000").join(table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    return explore.average_by_group(lines, places, "s_suppkey", "l_quantity", "n_name")


def explore_counts(spark, sf):
    return explore.summary(_events(spark, sf), "user_id", "k", "ts", "2024-01-1")


def top10_user(spark, sf):
    return explore.top_keys(table(spark, sf, "events"), "user_id")


def top10_item(spark, sf):
    return explore.top_keys(_events(spark, sf), "k")


def avg_by_group_left_join(spark, sf):
    return _averages(spark, sf).select("n_name", F.round("average", 6).alias("average"), "n")


def top10_group_avg(spark, sf):
    return explore.top_groups(_averages(spark, sf), "n_name").select("n_name", F.round("average", 6).alias("average"), "n")


def top10_group_avg_on_driver(spark, sf):
    return explore.top_groups_on_driver(_averages(spark, sf), "n_name").select("n_name", F.round("average", 6).alias("average"), "n")


def _priorities(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority")


def partition_sizes_custom(spark, sf):
    return explore.partition_sizes(explore.dealt_by(_priorities(spark, sf), 7, char_sum(F.col("o_orderpriority"), 7)), "o_orderpriority")


def partition_sizes_default(spark, sf):
    return explore.partition_sizes(_priorities(spark, sf).repartition(7, "o_orderpriority"), "o_orderpriority")


def partition_study(spark, sf):
    """Both ways to deal out rows by key, without their times: partitions, and that all keys are in them once."""
    found = explore.partition_study(_priorities(spark, sf), "o_orderpriority", 7, char_sum(F.col("o_orderpriority"), 7))
    return spark.createDataFrame([(k, v["n_partition"], sum(v["n_items"])) for k, v in found.items()], "name string, n_partition int, n_keys long")


def sort_study(spark, sf):
    """Both ways to sort, without their times: whether they agree."""
    return spark.createDataFrame([(explore.sort_study(_averages(spark, sf), "n_name")["same"],)], "same boolean")


def json_extract(spark, sf):
    parsed = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").select("event_id", parsed.alias("k"), F.coalesce(F.from_json("props", "absent int")["absent"], F.lit(0)).alias("absent"))


def substring_filter(spark, sf):
    return table(spark, sf, "events").filter(F.contains(F.col("ts").cast("string"), F.lit("-01-05"))).select("event_id", "user_id")


def concat_key(spark, sf):
    return table(spark, sf, "events").select("event_id", F.concat_ws("-", F.to_date("ts").cast("string"), F.col("user_id").cast("string")).alias("basket"))


def dirty_cast(spark, sf):
    dirty = F.concat(F.lit("000"), F.col("p_size").cast("string"), F.lit(".0"))
    return table(spark, sf, "part").select("p_partkey", dirty.cast("double").cast("bigint").alias("n"))


def union_all_rows(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return orders.select(F.col("o_orderkey").alias("key")).unionAll(lines.select(F.col("l_orderkey").alias("key"))).groupBy("key").agg(F.count("*").alias("n"))


def set_intersection(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key")).intersect(table(spark, sf, "orders").select("o_custkey"))


def set_difference(spark, sf):
    """Part keys that are no supplier's key."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key")).subtract(table(spark, sf, "supplier").select("s_suppkey"))


def distinct_pairs(spark, sf):
    return _events(spark, sf).select("user_id", "k").distinct()


def first_row(spark, sf):
    return table(spark, sf, "nation").orderBy("n_nationkey").limit(1).select("n_nationkey", "n_name")


def city_lines(spark, sf):
    """The averages as CSV fields would be written, nulls last."""
    return _averages(spark, sf).select(F.concat_ws(",", F.coalesce("n_name", F.lit("None")), F.format_number("average", 3)).alias("line"))


def chunk_sizes(spark, sf):
    """The five chunks in which points are clustered."""
    return table(spark, sf, "embeddings").groupBy(chunk_of(F.col("vec_id"), 5).alias("chunk")).agg(F.count("*").alias("n"))


def report_json(spark, sf):
    """One JSON document, pairs as arrays of two."""
    top = explore.top_keys(table(spark, sf, "events"), "event_type", 3)
    pairs = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg"), "event_type", "n"))).alias("a"))
    text = F.concat_ws(",", F.transform("a", lambda r: F.concat(F.lit('["'), r["event_type"], F.lit('",'), r["n"].cast("string"), F.lit("]"))))
    return pairs.select(F.concat(F.lit('{"top":['), text, F.lit("]}")).alias("document"))


_AVG = """
  SELECT n_name, avg(l_quantity) AS average, count(*) AS n FROM lineitem
  LEFT JOIN (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 2000) s ON s_suppkey = l_suppkey
  GROUP BY n_name
"""
_TOP = f"SELECT n_name, round(average, 6) AS average, n FROM ({_AVG}) ORDER BY average DESC, n_name NULLS LAST LIMIT 10"
_EK = "(SELECT *, json_extract_string(props, '$.k') AS k FROM events)"

QUERIES = {f.__name__: f for f in (explore_counts, top10_user, top10_item, avg_by_group_left_join, top10_group_avg, top10_group_avg_on_driver, partition_sizes_custom, partition_sizes_default, partition_study, sort_study, json_extract, substring_filter, concat_key, dirty_cast, union_all_rows, set_intersection, set_difference, distinct_pairs, first_row, city_lines, chunk_sizes, report_json)}
ORACLE = {
    "explore_counts": f"SELECT count(*) AS n_rows, count(*) FILTER (contains(ts::VARCHAR, '2024-01-1')) AS n_matching, count(DISTINCT user_id) AS n_users, count(DISTINCT k) AS n_items FROM {_EK}",
    "top10_user": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "top10_item": f"SELECT k, count(*) AS n FROM {_EK} GROUP BY k ORDER BY n DESC, k LIMIT 10",
    "avg_by_group_left_join": f"SELECT n_name, round(average, 6) AS average, n FROM ({_AVG})",
    "top10_group_avg": _TOP,
    "top10_group_avg_on_driver": _TOP,
    "partition_sizes_custom": "SELECT (list_sum(list_transform(string_split(o_orderpriority, ''), lambda c: ord(c))) % 7)::INT AS partition, count(*) AS n, count(DISTINCT o_orderpriority) AS n_keys FROM orders GROUP BY 1",
    "partition_study": "SELECT unnest(['default', 'customized']) AS name, 7::INT AS n_partition, count(DISTINCT o_orderpriority) AS n_keys FROM orders",
    "sort_study": "SELECT TRUE AS same",
    "json_extract": "SELECT event_id, json_extract(props, '$.k')::INT AS k, 0 AS absent FROM events",
    "substring_filter": "SELECT event_id, user_id FROM events WHERE contains(ts::VARCHAR, '-01-05')",
    "concat_key": "SELECT event_id, concat_ws('-', ts::DATE::VARCHAR, user_id::VARCHAR) AS basket FROM events",
    "dirty_cast": "SELECT p_partkey, p_size::BIGINT AS n FROM part",
    "union_all_rows": "SELECT key, count(*) AS n FROM (SELECT o_orderkey AS key FROM orders UNION ALL SELECT l_orderkey FROM lineitem) GROUP BY key",
    "set_intersection": "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders",
    "set_difference": "SELECT p_partkey AS key FROM part EXCEPT SELECT s_suppkey FROM supplier",
    "first_row": "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1",
    "city_lines": f"SELECT concat_ws(',', coalesce(n_name, 'None'), printf('%.3f', average)) AS line FROM ({_AVG})",
    "chunk_sizes": "SELECT (vec_id * 48271 + 11) % 2147483647 % 5 AS chunk, count(*) AS n FROM embeddings GROUP BY 1",
    "distinct_pairs": f"SELECT DISTINCT user_id, k FROM {_EK}",
    "report_json": """SELECT '{"top":[' || string_agg('["' || event_type || '",' || n || ']', ',' ORDER BY n DESC, event_type) || ']}' AS document FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3)""",
}
