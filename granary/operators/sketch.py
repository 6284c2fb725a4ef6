"""Stream sketches in relational form: Bloom filter, distinct counts by trailing zeros, reservoir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.columns import big_int_mod, hash_family, hash_rows
from granary.plans.lineage import importable, spread

FIELD = 2_147_483_647
BITS, BLOOM_HASHES = 69_997, 10
FM_RANGE, FM_HASHES, FM_GROUP = 1000, 100, 10
RESERVOIR = 100


def bloom_family(bits: int = BITS, hashes: int = BLOOM_HASHES, seed: int = 5) -> list[tuple[int, int, int]]:
    return hash_family(hashes, bits, 10 * bits, 10 * bits, seed)


def fm_family(hashes: int = FM_HASHES, limit: int = FM_RANGE, seed: int = 6) -> list[tuple[int, int, int]]:
    return hash_family(hashes, limit, 10 * limit, 10 * limit, seed)


def positions(c: Column, bits: int, family: list[tuple[int, int, int]]) -> Column:
    """The bits of an element, given as a number below FIELD."""
    return F.transform(hash_rows(c, family, bits), lambda r: r["h"])


def firsts(stream: DataFrame) -> DataFrame:
    """(seq, batch, id) -> each id's first seq, and that one's batch."""
    return stream.groupBy("id").agg(F.min(F.struct("seq", "batch")).alias("f")).select("id", F.col("f.seq").alias("seq"), F.col("f.batch").alias("batch"))


def bit_firsts(ids: DataFrame, bits: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """(id, seq, ...) -> (bit, seq): when each bit was first set."""
    numbers = ids.select("seq", big_int_mod(F.col("id").cast("string"), FIELD).alias("x"))
    return numbers.select(F.explode(positions(F.col("x"), bits, family)).alias("bit"), "seq").groupBy("bit").agg(F.min("seq").alias("seq"))


def judged(ids: DataFrame, set_at: DataFrame, bits: int, family: list[tuple[int, int, int]]) -> DataFrame:
    """Ids as they first come -> with `taken`: all their bits were set before, so the filter takes them for known."""
    numbers = ids.select("id", "seq", "batch", big_int_mod(F.col("id").cast("string"), FIELD).alias("x"))
    each = numbers.select("id", "seq", "batch", F.explode(positions(F.col("x"), bits, family)).alias("bit"))
    met = each.join(set_at.select("bit", F.col("seq").alias("set_seq")), "bit")
    return met.groupBy("id", "seq", "batch").agg((F.max("set_seq") < F.col("seq")).alias("taken"))


def false_positive_rate(stream: DataFrame, bits: int = BITS, family: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Per batch of (seq, batch, id): false positives, true negatives and their rate, of a filter that is never reset.

    Only an id's first coming can be either: later its bits are set and it is known.  So the
    filter is exact from distinct ids alone: an id is taken wrongly if the last of its bits to
    be set was set before it came.
    """
    family = family or bloom_family(bits)
    ids = firsts(stream)
    found = judged(ids, bit_firsts(ids, bits, family), bits, family)
    per = found.groupBy("batch").agg(F.count_if("taken").alias("fp"), F.count_if(~F.col("taken")).alias("tn"))
    every = stream.select("batch").distinct().join(per, "batch", "left").select("batch", F.coalesce("fp", F.lit(0)).alias("fp"), F.coalesce("tn", F.lit(0)).alias("tn"))
    return every.withColumn("fpr", F.coalesce(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.lit(0.0)))


def _most_zeros(family: list[tuple[int, int, int]], limit: int):
    """For mapInArrow: (batch, x, n) -> for each batch of an Arrow batch, rows, distinct ids, and its hashes' trailing zeros, packed; and the bits of each.

    The most trailing zeros of a hash are the highest bit of all its values' lowest bits or'ed, so
    some hashes go in a number (null without an id), and parts of a batch are or'ed again.
    """
    width = max(2, (limit - 1).bit_length())
    each = 63 // width
    if max(a for a, _, _ in family) * FIELD + max(b for _, b, _ in family) >= 1 << 63:
        raise ValueError("hashes must fit in 63 bits")

    def packed(parts):
        import numpy as np
        import pyarrow as pa

        for part in parts:
            if not part.num_rows:
                continue
            names = part.column("batch").dictionary_encode()
            code = names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            known = part.column("x").is_valid().to_numpy(zero_copy_only=False)[order]
            x = part.column("x").fill_null(0).to_numpy()[order].astype(np.uint64)
            words = np.zeros((-(-len(family) // each), len(x)), np.uint64)
            for i, (a, b, p) in enumerate(family):
                h = x * np.uint64(a) + np.uint64(b)
                for m in (np.uint64(p), np.uint64(limit)):
                    h -= h // m * m  # several times as fast as %
                low = h & (~h + np.uint64(1))
                low[h == 0] = 2  # as trailing_zeros has it
                words[i // each] |= low << np.uint64(i % each * width)
            words[:, ~known] = 0
            ored = np.bitwise_or.reduceat(words, starts, axis=1).T.astype(np.int64)
            values = pa.array(ored.ravel(), mask=ored.ravel() == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ored.size + 1, len(words)), pa.int32()), values)
            n = part.column("n").to_numpy()[order]
            counts = [pa.array(np.add.reduceat(c, starts), pa.int64()) for c in (n, known.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(code[order][starts])), *counts, lists], ["batch", "n_rows", "n_distinct", "w"])

    return packed, width


def distinct_estimate(stream: DataFrame, group: int = FM_GROUP, limit: int = FM_RANGE, family: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Per batch: rows, distinct ids, and the estimate: the upper median of 2 ** (mean of each group's most trailing zeros), cut to an integer."""
    family = family or fm_family(limit=limit)
    importable(stream.sparkSession)
    # An id is one row of its batch before it is dealt; keys in this order, or Spark takes the rows as dealt and puts few in a task each.
    ids = spread(stream.filter("batch is not null").groupBy("batch", "id").agg(F.count("*").alias("n")), "id", "batch")
    packed, width = _most_zeros(family, limit)
    each, words = 63 // width, -(-len(family) // (63 // width))
    parts = ids.select("batch", big_int_mod(F.col("id").cast("string"), FIELD).alias("x"), "n").mapInArrow(packed, f"batch {ids.schema['batch'].dataType.simpleString()}, n_rows long, n_distinct long, w array<long>")
    ored = F.array(*[F.bit_or(F.get("w", F.lit(i))) for i in range(words)])
    most = parts.groupBy("batch").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_distinct").alias("n_distinct"), ored.alias("w"))
    lows = F.expr(f"transform(sequence(0, {len(family) - 1}), i -> shiftright(get(w, i div {each}), i % {each} * {width}) & {(1 << width) - 1}L)")
    rows = most.select("batch", "n_rows", "n_distinct", F.transform(lows, lambda low: F.length(F.bin(low)) - 1).alias("r"))
    groups = len(family) // group
    powers = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.pow(F.lit(2.0), F.aggregate(F.slice("r", g * group + 1, group), F.lit(0), lambda a, v: a + v) / F.lit(group)))
    return rows.select("batch", "n_rows", "n_distinct", F.sort_array(powers)[groups // 2].cast("bigint").alias("estimate"))


def production_estimate(stream: DataFrame) -> DataFrame:
    """Per batch, by HyperLogLog: what to use outside of comparisons."""
    return stream.groupBy("batch").agg(F.approx_count_distinct("id").alias("estimate"))


def slot(seq: Column, size: int = RESERVOIR) -> Column:
    """The slot that element seq (from 1) takes, null if none: all first ones, then one in seq / size of them."""
    u = (seq * 1_103_515 + 12_345) % FIELD * 48_271 % FIELD % seq
    return F.when(seq <= size, seq - 1).when(u < size, u)


def reservoir(stream: DataFrame, size: int = RESERVOIR) -> DataFrame:
    """(slot, seq, id): what a reservoir holds at the end: the last element that took each slot."""
    taken = stream.withColumn("slot", slot(F.col("seq"), size)).filter("slot is not null")
    return taken.groupBy("slot").agg(F.max(F.struct("seq", "id")).alias("m")).select("slot", "m.seq", "m.id")


def reservoir_report(stream: DataFrame, size: int = RESERVOIR, shown: tuple[int, ...] = (0, 20, 40, 60, 80), before: DataFrame | None = None) -> DataFrame:
    """Per batch: elements so far, and the ids in some slots then (null while empty); before: (slot, seq, id) held when the first batch came."""
    taken = stream.withColumn("slot", slot(F.col("seq"), size)).filter(F.col("slot").isin(*shown))
    last = taken.groupBy("batch", "slot").agg(F.max(F.struct("seq", "id")).alias("m"))
    ends = stream.groupBy("batch").agg(F.max("seq").alias("seqnum"))
    grid = ends.withColumn("slot", F.explode(F.array(*[F.lit(s).cast("bigint") for s in shown]))).join(last, ["batch", "slot"], "left")
    w = Window.partitionBy("slot").orderBy("batch")
    if before is not None:  # a row for each slot
        grid = grid.join(F.broadcast(before.select("slot", F.col("id").alias("old"))), "slot", "left")
    was = F.lit(None) if before is None else F.col("old")
    held = grid.withColumn("id", F.coalesce(F.last("m.id", ignorenulls=True).over(w), was))
    return held.groupBy("batch", "seqnum").agg(*[F.max(F.when(F.col("slot") == s, F.col("id"))).alias(f"slot_{s}") for s in shown])
