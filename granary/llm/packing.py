"""Packing documents into sequences: a linear grouping scheme over the lengths of their pieces.

Only counts by length (at most `capacity` of them) reach the driver.  Large lengths are dealt
into groups of equal cardinality and rounded up to each group's largest; configurations of few
sizes are chosen for the rounded counts; actual lengths take their slots, which leaves room;
small lengths then go to the fullest sequences that hold them.  Sequences that rounding has left
with room are packed again at their own lengths, if that saves any.  The plan is a list of runs,
each of so many alike sequences, and pieces find their slot from their rank among those as long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import keep, pieces, table

#: Lengths up to capacity / SMALL are small; the others are dealt into groups, fewer than there can be lengths at 1024:
#: as many as one of GROUPS says, whichever plan takes the fewest sequences.
SMALL, GROUPS = 8, (512, 448, 416)


def _group(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded length, [[length, count], ...]) of groups of equal cardinality, the longest first."""
    if len(counts) <= groups:  # a group for each length: nothing to round
        return [(k, [[k, counts[k]]]) for k in sorted(counts, reverse=True)]
    size = -(-sum(counts.values()) // groups)
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room == 0:
                out.append((length, []))
                room = size
            n = min(left, room)
            out[-1][1].append([length, n])
            left -= n
            room -= n
    merged: dict[int, list[list[int]]] = {}
    for rounded, members in out:
        merged.setdefault(rounded, []).extend(members)
    return sorted(merged.items(), reverse=True)


def _configurations(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (sizes that share a sequence) with multiplicities that use up all counts.

    The largest size left takes the fullest complement of one, two or three further pieces of
    at most two sizes, as often as counts allow.
    """
    left = dict(sizes)
    out = []
    while left:
        order = sorted(left, reverse=True)
        big = order[0]
        room = capacity - big
        best: tuple[int, tuple[int, ...]] = (0, ())
        fits = [s for s in order if s <= room]
        have = set(fits)
        for s in fits:
            for k in (1, 2, 3):
                if k * s > room or left[s] - (s == big) < k:
                    break
                own = (s,) * k
                if k * s > best[0]:
                    best = (k * s, own)
                if k < 3:
                    # The largest other size that still fits.
                    rest = room - k * s
                    t = next((t for t in range(min(rest, s - 1), 0, -1) if t in have and left[t] - (t == big) > 0), 0) if rest >= fits[-1] else 0
                    if t and k * s + t > best[0]:
                        best = (k * s + t, (*own, t))
            if best[0] == room:
                break
        config = (big, *best[1])
        need: dict[int, int] = {}
        for s in config:
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((config, times))
    return out


def plan(counts: dict[int, int], capacity: int, small: int = SMALL, groups: tuple[int, ...] = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """counts by length -> runs of (lengths in one sequence, number of such sequences): the best plan of some groupings."""
    return min((_repacked(grouped(counts, capacity, small, g), capacity, small) for g in groups), key=_sequences)


def _sequences(runs: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in runs)


def _repacked(runs: list[tuple[tuple[int, ...], int]], capacity: int, small: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences with room are packed again, a group for each length, if that saves any."""
    loose, counts = [r for r in runs if sum(r[0]) < capacity], {}
    for lengths, n in loose:
        for x in lengths:
            counts[x] = counts.get(x, 0) + n
    again = grouped(counts, capacity, small, capacity)
    return [r for r in runs if sum(r[0]) == capacity] + again if _sequences(again) < _sequences(loose) else runs


def grouped(counts: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan of the scheme itself."""
    large = {k: n for k, n in counts.items() if k > capacity // small and n}
    little = {k: n for k, n in counts.items() if 0 < k <= capacity // small and n}
    stock = {r: [list(x) for x in members] for r, members in _group(large, groups)}
    runs: list[list] = []  # [lengths, times]
    for config, times in _configurations({r: sum(n for _, n in m) for r, m in stock.items()}, capacity):
        # Actual lengths take the slots of their group; a run ends where one of them changes.
        while times:
            taken: list[tuple[list[int], int]] = []  # [length, stock], pieces a sequence
            n = times
            for r in dict.fromkeys(config):
                k = config.count(r)
                for member in stock[r]:
                    use = min(k, member[1])
                    taken.append((member, use))
                    n, k = min(n, member[1] // use), k - use
                    if not k:
                        break
            for member, use in taken:
                member[1] -= use * n
            for r in dict.fromkeys(config):
                stock[r] = [m for m in stock[r] if m[1]]
            runs.append([tuple(sorted((m[0] for m, use in taken for _ in range(use)), reverse=True)), n])
            times -= n
    # Small lengths, the longest first, each into the fullest sequences that hold it.
    by_room: dict[int, list[list]] = {}
    for lengths, n in runs:
        by_room.setdefault(capacity - sum(lengths), []).append([lengths, n])
    for s in sorted(little, reverse=True):
        left = little[s]
        while left:
            room = next((r for r in range(s, capacity + 1) if by_room.get(r)), None)
            if room is None:
                k = min(capacity // s, left)
                n = left // k
                by_room.setdefault(capacity - k * s, []).append([(s,) * k, n])
                left -= n * k
                continue
            lengths, have = by_room[room].pop()
            # As many of this length as fit at once, or one each for the last few.
            k = max(1, min(room // s, left // have))
            n = min(have, left // k)
            if n < have:
                by_room[room].append([lengths, have - n])
            by_room.setdefault(room - k * s, []).append([(*lengths, *(s,) * k), n])
            left -= n * k
    return [(lengths, n) for room in sorted(by_room) for lengths, n in by_room[room]]


def _slots(runs: list[tuple[tuple[int, ...], int]], capacity: int):
    """For each length: first ranks, first sequences and offsets of its slots, in rank order."""
    import numpy as np

    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in runs:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64).T for k, v in rows.items()}


def _cut(batches: Iterator, path: str, capacity: int, end: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from granary.llm.bpe import encoder

    enc, part = encoder(path), TaskContext.get().partitionId()
    ranks = np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        for chunk in pieces(batch, "text", 2 << 20):
            ids, at = enc.encode([t or "" for t in chunk.column("text").to_pylist()])
            ids = ids.astype("<u4")
            rows = []
            for d, a, b in zip(chunk.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist()):
                raw = ids[a:b].tobytes() + end.to_bytes(4, "little")
                n = b - a + 1
                first = n % capacity or capacity
                lo, k = 0, 0
                while lo < n:
                    hi = first if lo == 0 else lo + capacity
                    rows.append((d, k, lo, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), int(ranks[hi - lo])))
                    ranks[hi - lo] += 1
                    lo, k = hi, k + 1
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, [part] * len(rows)], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()])], ["doc_id", "piece", "start", "length", "ids_crc32", "local", "part"])


def _place(batches: Iterator, slots: dict) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            ranks, seqs, offs = slots[int(length[own[0]])]
            i = np.searchsorted(ranks, rank[own], side="right") - 1
            sequence[own], offset[own] = seqs[i] + rank[own] - ranks[i], offs[i]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id; only those longer than `capacity` are cut, into
    pieces as long as it, but for the first.  A null text counts as empty: one piece, the end id.
    Null doc_ids and repeated rows are packed like others; an empty table gives an empty result;
    further columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, local long, part int"
    rows = keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _cut(b, path, capacity, end), schema))
    # Ranks among pieces of one length: within each part as written, then over the parts' counts.
    by_part = rows.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = by_part.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    slots = _slots(plan(counts, capacity), capacity)
    ranked = rows.join(before, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(lambda b: _place(b, slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE: dict[str, str] = {}
