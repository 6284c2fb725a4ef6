"""Counts, top lists and averages over records, and how rows spread over partitions."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, user: str, item: str, when: str, part: str) -> DataFrame:
    """One row: all rows, those whose time holds a substring, distinct users and items.  Nulls aren't counted as values."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.contains(F.col(when).cast("string"), F.lit(part))).alias("n_matching"), F.countDistinct(user).alias("n_users"), F.countDistinct(item).alias("n_items"))


def top_keys(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most frequent keys, then by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def average_by_group(left: DataFrame, right: DataFrame, on: str, value: str, group: str) -> DataFrame:
    """Average of a left column by a right one; rows without a partner are a group of their own, null."""
    return left.select(on, value).join(right.select(on, group), on, "left").groupBy(group).agg(F.avg(value).alias("average"), F.count("*").alias("n"))


def top_groups(averages: DataFrame, group: str, n: int = 10) -> DataFrame:
    """By average, then name, nulls last: only the first n of each partition meet."""
    return averages.orderBy(F.desc("average"), F.asc_nulls_last(group)).limit(n)


#: Groups that a driver may sort.
DRIVER_ROWS = 1 << 20


def top_groups_on_driver(averages: DataFrame, group: str, n: int = 10) -> DataFrame:
    """The same by collecting the averages, for comparison; more than DRIVER_ROWS of them are refused."""
    held = averages.limit(DRIVER_ROWS + 1).collect()
    if len(held) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} groups: use top_groups")
    rows = sorted(held, key=lambda r: (-r["average"], r[group] is None, r[group] or ""))[:n]
    return averages.sparkSession.createDataFrame(rows, averages.schema)


def sort_study(averages: DataFrame, group: str, n: int = 10) -> dict:
    """Seconds of both ways to find the first groups, and whether they agree."""
    t = time.time()
    one = top_groups_on_driver(averages, group, n).collect()
    t, one_s = time.time(), time.time() - t
    two = top_groups(averages, group, n).collect()
    return {"driver_s": one_s, "distributed_s": time.time() - t, "same": one == two}


def dealt_by(df: DataFrame, n: int, place: Column) -> DataFrame:
    """Rows in n partitions, each row in the partition that `place` (0 .. n-1) names."""
    return df.repartitionById(n, place.cast("int"))


def partition_sizes(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys in each partition that has any."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"))


def partition_study(df: DataFrame, key: str, n: int, place: Column) -> dict:
    """Partition sizes and seconds of counts by key, by hash and by an own place."""
    out = {}
    for name, dealt in (("default", df.repartition(n, key)), ("customized", dealt_by(df, n, place))):
        t = time.time()
        dealt.groupBy(key).count().orderBy(F.desc("count"), key).limit(10).collect()
        sizes = [r["n_keys"] for r in partition_sizes(dealt, key).orderBy("partition").collect()]
        out[name] = {"n_partition": n, "n_items": sizes, "exe_time": time.time() - t}
    return out
