"""Sketch queries: events as a stream of user ids in batches of a thousand."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import sketch as ops
from granary.sources.tables import table
from granary.streaming import replay

#: A small filter, so that some are taken wrongly.
_BITS, _FAMILY = 997, ops.bloom_family(997, 3)


def _stream(spark, sf):
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.expr("event_id div 1000").alias("batch"), F.col("user_id").alias("id"))


def _keys(spark, sf):
    """Many distinct ids: the time of the event as text."""
    return table(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.expr("event_id div 1000").alias("batch"), F.concat(F.lit("u"), ((F.col("event_id") * 7919) % 3001).cast("string")).alias("id"))


def bloom_fpr(spark, sf):
    return ops.false_positive_rate(_keys(spark, sf), _BITS, _FAMILY).select("batch", "fp", "tn", F.round("fpr", 6).alias("fpr"))


def fm_estimate(spark, sf):
    return ops.distinct_estimate(_keys(spark, sf))


def hll_estimate(spark, sf):
    return ops.production_estimate(_keys(spark, sf))


def reservoir(spark, sf):
    return ops.reservoir(_stream(spark, sf))


def reservoir_report(spark, sf):
    return ops.reservoir_report(_stream(spark, sf))


def stream_bloom(spark, sf):
    return replay.bloom(replay.source(_keys(spark, sf), "batch"), _BITS, _FAMILY).select("batch", "fp", "tn", F.round("fpr", 6).alias("fpr"))


def stream_fm(spark, sf):
    return replay.per_batch(replay.source(_keys(spark, sf), "batch"), ops.distinct_estimate)


def stream_reservoir(spark, sf):
    return replay.reservoir(replay.source(_stream(spark, sf), "batch"))


def black_box(spark, sf):
    """Two asks of five hundred ids with replacement; sizes only, as draws are Spark's own."""
    lines = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("value"))
    return replay.ask(lines, 500, 2).groupBy("batch").agg(F.count("*").alias("n"))


_X = """list_reduce(list_prepend(0::BIGINT, list_transform(string_split(hex(encode(s)), ''), lambda d: (instr('0123456789ABCDEF', d) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 2147483647)"""
_KEYS = f"k AS (SELECT event_id + 1 AS seq, event_id // 1000 AS batch, 'u' || (event_id * 7919) % 3001 AS s FROM events), xs AS (SELECT s, {_X} AS x FROM (SELECT DISTINCT s FROM k))"
_BLOOM = (
    f"WITH {_KEYS}, f AS (SELECT s, min(seq) AS seq, arg_min(batch, seq) AS batch FROM k GROUP BY s), p AS (SELECT f.*, unnest(["
    + ", ".join(f"(x * {a} + {b}) % {q} % {_BITS}" for a, b, q in _FAMILY)
    + "]) AS bit FROM f JOIN xs USING (s)), t AS (SELECT bit, min(seq) AS set_seq FROM p GROUP BY bit), j AS (SELECT s, p.seq, batch, max(set_seq) < p.seq AS taken FROM p JOIN t USING (bit) GROUP BY s, p.seq, batch), b AS (SELECT DISTINCT batch FROM k)"
    " SELECT batch, count(*) FILTER (taken) AS fp, count(*) FILTER (NOT taken) AS tn, round(coalesce(count(*) FILTER (taken) / nullif(count(*) FILTER (taken IS NOT NULL), 0), 0), 6) AS fpr FROM b LEFT JOIN j USING (batch) GROUP BY batch"
)
_TZ = "CASE WHEN h = 0 THEN 1 ELSE instr(reverse(bin(h)), '1') - 1 END"
_FM = (
    f"WITH {_KEYS}, h AS (SELECT k.batch, k.s, i, h FROM k JOIN (SELECT s, unnest(range({ops.FM_HASHES})) AS i, unnest(["
    + ", ".join(f"(x * {a} + {b}) % {q} % {ops.FM_RANGE}" for a, b, q in ops.fm_family())
    + f"]) AS h FROM xs) USING (s)), r AS (SELECT batch, i, max({_TZ}) AS r FROM h GROUP BY ALL), g AS (SELECT batch, i // {ops.FM_GROUP} AS g, pow(2.0, sum(r) / {ops.FM_GROUP}) AS v FROM r GROUP BY ALL),"
    f" m AS (SELECT batch, list_sort(list(v))[{ops.FM_HASHES // ops.FM_GROUP // 2 + 1}] AS v FROM g GROUP BY batch)"
    " SELECT batch, n_rows, n_distinct, floor(v)::BIGINT AS estimate FROM m JOIN (SELECT batch, count(*) AS n_rows, count(DISTINCT s) AS n_distinct FROM k GROUP BY batch) USING (batch)"
)
_SLOT = "e AS (SELECT event_id + 1 AS seq, event_id // 1000 AS batch, user_id AS id FROM events), t AS (SELECT *, CASE WHEN seq <= 100 THEN seq - 1 WHEN (seq * 1103515 + 12345) % 2147483647 * 48271 % 2147483647 % seq < 100 THEN (seq * 1103515 + 12345) % 2147483647 * 48271 % 2147483647 % seq END AS slot FROM e)"
_REPORT = f"WITH {_SLOT}, b AS (SELECT batch, max(seq) AS seqnum FROM e GROUP BY batch) SELECT b.batch, seqnum, " + ", ".join(f"arg_max(id, seq) FILTER (slot = {s}) AS slot_{s}" for s in (0, 20, 40, 60, 80)) + " FROM b JOIN t ON t.batch <= b.batch GROUP BY ALL"
QUERIES = {f.__name__: f for f in (bloom_fpr, fm_estimate, hll_estimate, reservoir, reservoir_report, stream_bloom, stream_fm, stream_reservoir, black_box)}
ORACLE = {
    "bloom_fpr": _BLOOM,
    "fm_estimate": _FM,
    "reservoir": f"WITH {_SLOT} SELECT slot, max(seq) AS seq, arg_max(id, seq) AS id FROM t WHERE slot IS NOT NULL GROUP BY slot",
    "reservoir_report": _REPORT,
    "stream_bloom": _BLOOM,
    "stream_fm": _FM,
    "stream_reservoir": _REPORT,
    "black_box": "SELECT unnest(range(2)) AS batch, 500::BIGINT AS n",
}
