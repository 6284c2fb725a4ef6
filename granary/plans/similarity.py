"""Similarity queries: event keys as sets of users, documents as sets of words."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import similarity as ops
from granary.plans.lineage import keep
from granary.sources.tables import table


def _sets(spark, sf):
    return table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("item"), F.col("user_id").alias("member")).distinct()


def _rounded(df):
    return df.select("a", "b", F.round("similarity", 6).alias("similarity"))


def jaccard_exact(spark, sf):
    return _rounded(ops.jaccard_pairs(_sets(spark, sf), 0.4))


def minhash_signature(spark, sf):
    sets = keep(_sets(spark, sf))
    ids = keep(ops.dense_ids(sets, "member"))
    return ops.signatures(sets, ids, ids.count(), ops.family()).select("item", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def lsh_similar(spark, sf):
    return _rounded(ops.lsh_pairs(_sets(spark, sf), 0.4))


def dense_user_ids(spark, sf):
    return ops.dense_ids(table(spark, sf, "events"), "user_id")


_SETS = "sets AS (SELECT DISTINCT json_extract_string(props, '$.k') AS item, user_id AS member FROM events)"
_J = "sizes AS (SELECT item, count(*) AS n FROM sets GROUP BY item), both_ AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM sets x JOIN sets y ON x.member = y.member AND x.item < y.item GROUP BY ALL), jac AS (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM both_ JOIN sizes p ON p.item = a JOIN sizes q ON q.item = b)"
_IDS = "ids AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS id FROM (SELECT DISTINCT member FROM sets)), bins AS (SELECT count(*) AS m FROM ids)"
_SIG = "sig AS (SELECT item, [" + ", ".join(f"min((id * {a} + {b}) % {p} % m)" for a, b, p in ops.family()) + "] AS s FROM sets JOIN ids USING (member), bins GROUP BY item)"
QUERIES = {f.__name__: f for f in (jaccard_exact, minhash_signature, lsh_similar, dense_user_ids)}
ORACLE = {
    "jaccard_exact": f"WITH {_SETS}, {_J} SELECT a, b, round(similarity, 6) AS similarity FROM jac WHERE similarity >= 0.4",
    "minhash_signature": f"WITH {_SETS}, {_IDS}, {_SIG} SELECT item, array_to_string(s, ',') AS signature FROM sig",
    "lsh_similar": f"WITH {_SETS}, {_J}, {_IDS}, {_SIG}, k AS (SELECT item, i, s[i * 3 + 1 : i * 3 + 3] AS r FROM sig, range({ops.BANDS}) t(i)), c AS (SELECT DISTINCT x.item AS a, y.item AS b FROM k x JOIN k y ON x.i = y.i AND x.r = y.r AND x.item < y.item) SELECT a, b, round(similarity, 6) AS similarity FROM c JOIN jac USING (a, b) WHERE similarity >= 0.4",
    "dense_user_ids": "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS id FROM (SELECT DISTINCT user_id FROM events)",
}
