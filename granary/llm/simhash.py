"""SimHash near-duplicates: segment popcounts, a grid join under Manhattan distance, exact checks.

A fingerprint of 64 bits maps to 32 counts, one for each segment of two bits.  The Manhattan
distance of counts is at most the Hamming distance of fingerprints, so fingerprints within d
bits differ in at most d of d + k blocks of segments, and agree in the counts of some k
blocks: the cells of the grid.  k is 4, or more where fingerprints are so many that cells of four
blocks would be crowded; links are the same for any.  Cells hold distinct fingerprints only, so copies never meet as
pairs, and a crowded cell yields the edges of a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import keep, partitions, pieces, table
from granary.operators.components import connected_components

SEED = 42
_LOW = 0x5555555555555555
#: Fingerprints of a cell that are searched at once; more are split by their bits first.
CROWD = 4096


def fingerprint(hashes) -> int:
    """The bits that are set in over half of the hashes (u64, repeats counted); zero without any."""
    import numpy as np

    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 18):
        h = hashes[at : at + (1 << 18)].astype(">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def _fingerprints(batches: Iterator, n: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for part in pieces(batch, "text", 2 << 20):
            out = np.zeros(part.num_rows, dtype=np.uint64)
            for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                w = (text or b"").lower().split()
                if not w:
                    continue
                joined, k = b" ".join(w), min(n, len(w))
                ends = list(accumulate(len(x) + 1 for x in w))
                out[i] = fingerprint(np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): SimHash of n-word shingles, repeats counted, as a signed 64-bit integer."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _fingerprints(b, n), "doc_id long, fp long")


def kept_blocks(n: int, distance: int) -> int:
    """How many blocks a cell keeps: what makes rows and comparisons of n fingerprints least together."""

    def cost(k: int) -> float:
        # Two counts agree with probability 3/8; a comparison takes a tenth of what a row does.
        return comb(distance + k, k) * (1 + 0.1 * n * 0.375 ** (32 * k / (distance + k)))

    return min(range(4, 13), key=cost)


def _masks(distance: int, kept: int) -> list[int]:
    """Masks over the packed counts, each of some of distance + kept blocks of segments, as signed integers."""
    blocks = distance + kept
    cuts = [round(32 * i / blocks) for i in range(blocks + 1)]
    own = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(own, kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fps, distance: int):
    """Edges that connect all fingerprints which those within a distance connect.

    Of more than CROWD, those that are near agree in one of distance + 1 stretches of their bits:
    each stretch's groups are searched by themselves.
    """
    import numpy as np

    if len(fps) <= CROWD:
        return _search(fps, distance)
    edges: list = []
    cuts = [round(64 * i / (distance + 1)) for i in range(distance + 2)]
    for a, b in zip(cuts, cuts[1:]):
        part = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        order = np.argsort(part, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(own) > 1:
                edges += _search(fps[own], distance)
    return edges


def _search(fps, distance: int):
    """Edges of a spanning forest of the graph of fingerprints within a distance.

    A search from each fingerprint meets only those not reached yet, block by block; a dense
    group is reached in a few steps, so its pairs are not enumerated.
    """
    import numpy as np

    edges, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            # Manhattan distance of the counts first, which bounds the other from below.
            c, d = at - ((at >> np.uint64(1)) & np.uint64(_LOW)), rest - ((rest >> np.uint64(1)) & np.uint64(_LOW))
            low = np.zeros(len(rest), dtype=np.int64)
            for mask in (0x3333333333333333, 0xCCCCCCCCCCCCCCCC):
                a, b = np.uint64(c) & np.uint64(mask), d & np.uint64(mask)
                if mask >> 63:
                    a, b = a >> np.uint64(2), b >> np.uint64(2)
                # Per field |a - b| as (a - b + 4) - 4 in four bits.
                f = (a | np.uint64(0x4444444444444444)) - b
                one = np.uint64(0x1111111111111111)
                up = (f >> np.uint64(2)) & one  # 1 where a >= b
                low3 = f & np.uint64(0x3333333333333333)
                neg = (one - up) * np.uint64(3)
                low += _nibbles((low3 ^ neg) + (one - up))
            near = low <= distance
            if near.any():
                hit = np.flatnonzero(near)
                hit = hit[np.bitwise_count(rest[hit] ^ at) <= distance]
                if len(hit):
                    edges += [(at, x) for x in rest[hit]]
                    todo += list(rest[hit])
                    left = np.ones(len(rest), dtype=bool)
                    left[hit] = False
                    rest = rest[left]
    return edges


def _nibbles(x):
    """The sum of the sixteen four-bit fields of each value."""
    import numpy as np

    x = (x & np.uint64(0x0F0F0F0F0F0F0F0F)) + ((x >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F))
    return ((x * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.int64)


def _cells(batches: Iterator, distance: int) -> Iterator:
    """Rows sorted by cell -> edges; a cell may span batches."""
    import numpy as np
    import pyarrow as pa

    def edges(keys, fps):
        with np.errstate(over="ignore"):
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.concatenate([start, [len(keys)]]))
            two = start[size == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            a, b = [fps[two]], [fps[two + 1]]
            for s, n in zip(start[size > 2], size[size > 2]):
                if e := forest(fps[s : s + n], distance):
                    e = np.array(e, dtype=np.uint64)
                    a.append(e[:, 0])
                    b.append(e[:, 1])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    held_k, held_f = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    for batch in batches:
        k = np.concatenate([held_k, batch.column("cell").to_numpy()])
        f = np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if cut:
            yield edges(k[:cut], f[:cut])
        held_k, held_f = k[cut:], f[cut:]
    if len(held_k):
        yield edges(held_k, held_f)


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b), each within the distance, that connect all that such links connect."""
    spark = fps.sparkSession
    # Of each two bits, both set count two and either one: bit operations, which never overflow.
    odd, even = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(_LOW)), F.col("fp").bitwiseAND(F.lit(_LOW))
    counts = F.shiftleft(odd.bitwiseAND(even), 1).bitwiseOR(odd.bitwiseXOR(even))
    cells = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("counts").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(distance, kept_blocks(fps.count(), distance)))]))
    grid = fps.withColumn("counts", counts).select(cells.alias("cell"), "fp")
    dealt = grid.repartition(partitions(spark), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lambda b: _cells(b, distance), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within `distance` bits link; component_id is the least doc_id reachable, the
    own one included.  A null text counts as empty: fingerprint zero, linked like any other.
    Rows with a null doc_id are linked and returned, but give no component its name (null if
    a component has no other).  Repeated rows are returned as often as they come.  An empty
    table gives an empty result; further columns are ignored.
    """
    rows = keep(fingerprints(docs, n))
    classes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes.select("fp"), distance))
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(names, "root").select("fp", "component_id")
    # Few classes hold many rows; rows meet their class in a join that may be split, not in a group.
    return rows.join(by_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": op7_simhash}
ORACLE: dict[str, str] = {}
