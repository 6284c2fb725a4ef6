"""Queries through text files: whole tables written in each format to the shared folder, read back with stated schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.plans.lineage import shared_dir
from granary.sources import tables as io
from granary.sources.tables import table


def _path(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _reviews(spark, sf):
    e = table(spark, sf, "events")
    stars = (1 + F.pmod(F.col("event_id"), F.lit(5))).cast("double")
    return e.select(F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("business_id"), stars.alias("stars"), F.col("ts").cast("string").alias("date"))


def json_lines_read(spark, sf):
    """Reviews as JSON lines."""
    path = _path(spark)
    _reviews(spark, sf).select(F.to_json(F.struct("*")).alias("line")).write.text(path)
    return io.json_lines(spark, path, io.REVIEW)


def json_defaults_read(spark, sf):
    """Businesses, some without a count: an absent field has its default."""
    path = _path(spark)
    count = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("int"))
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("business_id"), F.col("s_nationkey").cast("string").alias("city"), count.alias("review_count"), F.col("s_acctbal").alias("stars"))
    rows.select(F.to_json(F.struct("*")).alias("line")).write.text(path)
    return io.json_lines(spark, path, io.BUSINESS, {"review_count": 0})


def headed_csv_read(spark, sf):
    """Ratings as comma-separated values below a header, in order."""
    path = _path(spark)
    io.write_csv(_reviews(spark, sf).select("user_id", "business_id", "stars"), path, ["user_id", "business_id", "stars"])
    return io.headed_csv(spark, path, io.RATING)


def transactions_read(spark, sf):
    """Quoted transactions with product numbers in dirty text -> distinct baskets and items."""
    path = _path(spark)
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    dirty = F.concat(F.lit(" 000"), F.col("l_partkey").cast("string"), F.lit(".0 "))
    rows = lines.select(F.to_date("l_shipdate").cast("string").alias("date"), F.col("o_custkey").cast("string").alias("customer"), "l_quantity", "l_discount", F.concat(F.col("l_returnflag"), F.lit(", "), F.col("l_linestatus")).alias("note"), dirty.alias("product"))
    rows.write.option("header", True).option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.transactions(spark, path).distinct()


def points_read(spark, sf):
    """Points as numbers without a header."""
    path, width = _path(spark), 64
    e = table(spark, sf, "embeddings")
    e.select("vec_id", "label", *[F.get(F.col("embedding").cast("array<double>"), F.lit(i)).alias(f"x{i}") for i in range(width)]).write.csv(path)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return io.points(spark, path, width).select("id", "label", F.round(total, 6).alias("total"), F.size("features").alias("width"))


def text_lines_read(spark, sf):
    """An id a line."""
    path = _path(spark)
    table(spark, sf, "events").select(F.col("user_id").cast("string")).write.text(path)
    return io.lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def report_lines_read(spark, sf):
    """Report lines as one file holds them, and a report of one row as one JSON object."""
    lines, document = _path(spark), _path(spark)
    rows = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("line"))
    io.write_lines(rows.orderBy("line"), lines)
    io.write_json_document(rows.agg(F.count("*").alias("n"), F.max("line").alias("last"), F.lit(None).cast("string").alias("none")), document)
    return io.lines(spark, lines).unionByName(io.lines(spark, document))


_STARS = "1 + event_id % 5"
QUERIES = {f.__name__: f for f in (json_lines_read, json_defaults_read, headed_csv_read, transactions_read, points_read, text_lines_read, report_lines_read)}
ORACLE = {
    "json_lines_read": f"SELECT user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS business_id, ({_STARS})::DOUBLE AS stars, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS date FROM events",
    "json_defaults_read": "SELECT s_name AS business_id, s_nationkey::VARCHAR AS city, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::INT ELSE 0 END AS review_count, s_acctbal AS stars FROM supplier",
    "headed_csv_read": f"SELECT user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS business_id, ({_STARS})::DOUBLE AS stars FROM events",
    "transactions_read": "SELECT DISTINCT l_shipdate::DATE::VARCHAR || '-' || o_custkey AS basket, l_partkey::VARCHAR AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "points_read": "SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, len(embedding)::INT AS width FROM embeddings",
    "text_lines_read": "SELECT user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1",
    "report_lines_read": "WITH l AS (SELECT n_nationkey || ',' || n_name AS line FROM nation) SELECT line AS value FROM l UNION ALL SELECT '{\"n\":' || count(*) || ',\"last\":\"' || max(line) || '\",\"none\":null}' FROM l",
}
