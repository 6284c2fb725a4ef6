"""Hand-checked fixtures for exploration, readers and writers."""

import json

from pyspark.sql import functions as F

from granary.functions.columns import big_int_mod, char_sum, primes_from, trailing_zeros
from granary.operators import explore
from granary.operators.numbering import numbered
from granary.sources import tables


def test_left_join_average(spark):
    reviews = spark.createDataFrame([("b1", 4.0), ("b1", 2.0), ("b2", 5.0), ("b9", 1.0)], "business_id string, stars double")
    business = spark.createDataFrame([("b1", "X"), ("b2", "Y")], "business_id string, city string")
    found = explore.average_by_group(reviews, business, "business_id", "stars", "city")
    assert {(r["city"], r["average"]) for r in found.collect()} == {("Y", 5.0), ("X", 3.0), (None, 1.0)}
    assert [r["city"] for r in explore.top_groups(found, "city").collect()] == ["Y", "X", None]
    study = explore.sort_study(found, "city")
    assert study["same"]


def test_ties_put_null_last(spark):
    found = spark.createDataFrame([("a", 1.0), (None, 1.0), ("b", 1.0)], "city string, average double")
    for top in (explore.top_groups, explore.top_groups_on_driver):
        assert [r["city"] for r in top(found, "city").collect()] == ["a", "b", None]


def test_rows_lie_where_the_own_place_says(spark):
    df = spark.createDataFrame([(c * k,) for c in "abcdef" for k in range(1, 8)], "key string")
    dealt = explore.dealt_by(df, 5, char_sum(F.col("key"), 5)).withColumn("p", F.spark_partition_id())
    assert all(sum(map(ord, r["key"])) % 5 == r["p"] for r in dealt.collect())
    study = explore.partition_study(df, "key", 5, char_sum(F.col("key"), 5))
    assert sum(study["customized"]["n_items"]) == sum(study["default"]["n_items"]) == 42


def test_scalars(spark):
    df = spark.createDataFrame([("aé𝄞",), ("",)], "s string")
    want = [int.from_bytes(s.encode(), "big") % 2_147_483_647 for s in ("aé𝄞", "")]
    assert [r[0] for r in df.select(big_int_mod(F.col("s"), 2_147_483_647)).collect()] == want
    zeros = spark.createDataFrame([(0,), (1,), (8,), (12,)], "h long").select(trailing_zeros(F.col("h"))).collect()
    assert [r[0] for r in zeros] == [1, 0, 3, 2]
    assert primes_from(10, 3) == [11, 13, 17]


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    rows = numbered(df, "x", "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1000))
    assert [r["x"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["x"] for r in rows)
    assert sorted(r["n"] for r in numbered(df, name="n").collect()) == list(range(1000))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"user_id": "u1", "average_stars": 3.5}\n{"user_id": "u2", "review_count": null, "yelping_since": "2015-01-01"}\n')
    users = tables.json_lines(spark, f"{tmp_path}/u.json", tables.USER, {"review_count": 0})
    assert [(r["user_id"], r["review_count"], r["average_stars"]) for r in users.orderBy("user_id").collect()] == [("u1", 0, 3.5), ("u2", 0, None)]
    (tmp_path / "r.csv").write_text('user,business,stars\nu1,"b,1",4\n')
    assert [tuple(r) for r in tables.headed_csv(spark, f"{tmp_path}/r.csv", tables.RATING).collect()] == [("u1", "b,1", 4.0)]
    (tmp_path / "t.csv").write_text('"d","c","x","y","z","p"\n"1/1/2000","C1","a","b","c","0001234.0"\n')
    assert [tuple(r) for r in tables.transactions(spark, f"{tmp_path}/t.csv").collect()] == [("1/1/2000-C1", "1234")]
    (tmp_path / "p.csv").write_text("0,1,2.5,3.5\n1,0,0,1\n")
    assert [(r["id"], r["label"], r["features"]) for r in tables.points(spark, f"{tmp_path}/p.csv", 2).orderBy("id").collect()] == [(0, 1, [2.5, 3.5]), (1, 0, [0.0, 1.0])]
    assert tables.lines(spark, f"{tmp_path}/p.csv").count() == 2
    tables.write_csv(users.select("user_id"), f"{tmp_path}/out", ["user_id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    tables.write_json_document(users.limit(1), f"{tmp_path}/json")
    assert set(json.loads(spark.read.text(f"{tmp_path}/json").first()[0])) == {"user_id", "review_count", "average_stars", "yelping_since"}
