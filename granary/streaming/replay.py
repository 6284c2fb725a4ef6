"""Structured Streaming forms: one micro-batch for each file, which holds some whole batches; state in tables of the shared folder.

Every micro-batch writes its result and its state under its own number, so that one which runs
again after a failure overwrites what it had written and reads the same state as before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import sketch
from granary.operators.numbering import numbered
from granary.plans.lineage import keep, release, shared_dir


def ask(lines: DataFrame, size: int, asks: int, seed: int = 553) -> DataFrame:
    """(batch, seq, id): in each batch `size` lines (value) drawn with replacement, by a seeded draw of line numbers."""
    rows = keep(numbered(lines.select(F.col("value").alias("id")), name="line"))
    n = rows.count()
    draws = lines.sparkSession.range(size * asks).select(F.expr(f"id div {size}").alias("batch"), (F.col("id") + 1).alias("seq"), F.floor(F.rand(seed) * n).cast("long").alias("line"))
    return keep(draws).join(rows, "line").select("batch", "seq", "id")


#: Micro-batches that a backlog comes in (or one for each batch, if there are fewer), and rows of one, beyond which there are more.
MICRO_BATCHES, MICRO_ROWS = 24, 1 << 20


def source(rows: DataFrame, batch: str) -> DataFrame:
    """A stream that brings the rows by the batch column, in order: a micro-batch has all rows of some consecutive values.

    What a micro-batch costs besides its rows is paid for each micro-batch, so their number grows
    with the rows and not with the batches; results are by batch all the same.
    """
    spark = rows.sparkSession
    path, parts = (f"{shared_dir(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    held = keep(rows)
    batches = keep(numbered(held.select(batch).distinct(), batch, "at"))
    n, total = batches.count(), held.count()
    each = max(1, n // max(MICRO_BATCHES, -(-total // MICRO_ROWS)))
    dealt = held.join(batches.select(F.col(batch).alias("__batch"), F.expr(f"at div {each}").alias("__part")), F.col(batch).eqNullSafe(F.col("__batch"))).drop("__batch")
    dealt.repartition("__part").write.partitionBy("__part").parquet(parts)
    for k in range(-(-n // each)):
        spark.read.schema(rows.schema).parquet(f"{parts}/__part={k}").coalesce(1).write.mode("append").parquet(path)
    release(held, batches)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None]) -> None:
    """Runs all that there is through step."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}").trigger(availableNow=True).start().awaitTermination()


def _results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/result/*")


def per_batch(stream: DataFrame, summary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A summary by batch: a micro-batch has whole batches, so nothing is carried over."""
    path = f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}"
    _run(stream, lambda df, n: summary(df).write.mode("overwrite").parquet(f"{path}/result/{n}"))
    return _results(stream.sparkSession, path)


def _spans(n: int) -> list[tuple[int, int]]:
    """The batches before n as stretches whose lengths are powers of two, the longest first."""
    out, at = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((at, at + (1 << k)))
            at += 1 << k
    return out


def bloom(stream: DataFrame, bits: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """Per batch, the rate of false positives of a filter that is carried over, as false_positive_rate has it.

    State: ids known so far, and when each bit was set.  Ids are in tables of 1, 2, 4, ... batches,
    merged as a binary counter carries, so a batch reads few tables and an id is seldom written anew.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}"

    def step(df: DataFrame, n: int) -> None:
        ids = sketch.firsts(df)
        before = {(a, b): spark.read.parquet(f"{path}/known/{a}-{b}") for a, b in _spans(n)}
        for known in before.values():
            ids = ids.join(known.select("id"), "id", "left_anti")
        ids.write.mode("overwrite").parquet(f"{path}/new/{n}")
        ids = merged = spark.read.parquet(f"{path}/new/{n}")
        first = _spans(n + 1)[-1][0]
        for (a, _), known in before.items():
            if a >= first:
                merged = merged.unionByName(known)
        merged.write.mode("overwrite").parquet(f"{path}/known/{first}-{n + 1}")
        set_at = sketch.bit_firsts(ids, bits, family)
        if n:
            set_at = set_at.unionByName(spark.read.parquet(f"{path}/bits/{n - 1}")).groupBy("bit").agg(F.min("seq").alias("seq"))
        set_at.write.mode("overwrite").parquet(f"{path}/bits/{n}")
        found = sketch.judged(ids, spark.read.parquet(f"{path}/bits/{n}"), bits, family)
        counts = df.select("batch").distinct().join(found.groupBy("batch").agg(F.count_if("taken").alias("fp"), F.count_if(~F.col("taken")).alias("tn")), "batch", "left")
        counts = counts.select("batch", F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("tn", F.lit(0)).alias("tn"))
        counts.withColumn("fpr", F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0))).write.mode("overwrite").parquet(f"{path}/result/{n}")

    _run(stream, step)
    return _results(spark, path)


def reservoir(stream: DataFrame, size: int = sketch.RESERVOIR, shown: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """Per batch: elements so far and the ids in some slots.  State: the reservoir, a row for each slot."""
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}"

    def step(df: DataFrame, n: int) -> None:
        held, before = sketch.reservoir(df, size), None
        if n:
            before = spark.read.parquet(f"{path}/held/{n - 1}")
            held = held.unionByName(before).groupBy("slot").agg(F.max(F.struct("seq", "id")).alias("m")).select("slot", "m.seq", "m.id")
        held.coalesce(1).write.mode("overwrite").parquet(f"{path}/held/{n}")
        sketch.reservoir_report(df, size, shown, before).coalesce(1).write.mode("overwrite").parquet(f"{path}/result/{n}")

    _run(stream, step)
    return _results(spark, path)
