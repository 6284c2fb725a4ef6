"""Readers and writers: schemas are stated, never inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string"
BUSINESS = "business_id string, city string, review_count int, stars double"
USER = "user_id string, review_count int, average_stars double, yelping_since string"
RATING = "user_id string, business_id string, stars double"
PAIR = "user_id string, business_id string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each line."""
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """One row for each object; a malformed line fails the job.  defaults replace absent and null fields."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.fillna(defaults) if defaults else df


def headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated values below a header line; quoted commas are part of a field."""
    return spark.read.schema(schema).option("header", True).csv(path)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Quoted transactions: first field date, second customer, sixth a product number in dirty text."""
    raw = spark.read.option("header", True).csv(path)
    date, customer, product = (F.trim(F.col(f"`{raw.columns[i]}`")) for i in (0, 1, 5))
    return raw.select(F.concat_ws("-", date, customer).alias("basket"), product.cast("double").cast("bigint").cast("string").alias("item"))


def points(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Numbers without a header: an index, a label, then features -> (id, label, features)."""
    raw = spark.read.schema(", ".join(f"c{i} double" for i in range(width + 2))).csv(path)
    return raw.select(F.col("c0").cast("bigint").alias("id"), F.col("c1").cast("int").alias("label"), F.array(*[f"c{i + 2}" for i in range(width)]).alias("features"))


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A table of literal rows."""
    return spark.createDataFrame(values, schema)


def write_json_document(df: DataFrame, path: str) -> None:
    """Each row as one JSON object to a line; a report of one row is one document."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """Comma-separated values below a header, in a stated order if there is one."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    """Report lines in one file, in the order of the rows."""
    df.select(column).coalesce(1).write.mode("overwrite").text(path)
