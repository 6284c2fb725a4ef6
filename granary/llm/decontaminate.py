"""Benchmark decontamination by spaced seeds: masks that ignore some places, then checks around hits.

Thirteen places are cut into four blocks; each of six masks keeps two blocks and ignores the
others.  Two substitutions touch two blocks at most, so two sequences of thirteen words that
differ in no more agree under some mask.  Hashes of masked windows of the benchmark are joined to
those of all documents; each hit gives an alignment, and the words along it decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import pieces, table

SPAN, SUBSTITUTIONS, SHORTEST = 13, 2, 5
_BLOCKS = ((0, 1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 12))
MASKS = tuple(tuple(sorted(a + b)) for a, b in combinations(_BLOCKS, 2))
#: Bytes of benchmark text whose seeds are sent to executors at once; more of it takes more passes.
SEED_BYTES = 8 << 20
_BITS = 22
#: Pairs of equal windows that are looked at together; of a text with more, all shifts are.
_PAIRS = 1 << 20


def _words(texts: list[bytes]):
    """Hashes of the lower-case words of letters, digits and non-ASCII bytes, and where each text's begin."""
    import numpy as np

    from granary.llm.bytescan import buffer, word_hashes, words

    fold = np.full(256, 0x20, dtype=np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    for a, b in ((0x30, 0x3A), (0x61, 0x7B)):
        fold[a:b] = np.arange(a, b)
    fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    data, begins = buffer(texts)
    data = fold[data]
    starts, ends = words(data)
    return word_hashes(data, starts, ends), np.searchsorted(starts, begins)


def _merged(ranges):
    """Rows (text, item, low, high) with ranges of shifts that overlap or touch made one, in order."""
    import numpy as np

    ranges = ranges[:, np.lexsort((ranges[3], ranges[2], ranges[1], ranges[0]))]
    if ranges.shape[1] < 2:
        return ranges
    pair = np.concatenate([[0], np.cumsum((ranges[0, 1:] != ranges[0, :-1]) | (ranges[1, 1:] != ranges[1, :-1]))])
    # The greatest shift so far of each pair, by offsets that keep pairs apart.
    step = int(ranges[3].max() - ranges[2].min()) + 3
    reach = np.maximum.accumulate(ranges[3] + pair * step) - pair * step
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (ranges[2, 1:] > reach[:-1] + 1)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(new) - 1]])
    return np.stack([ranges[0, new], ranges[1, new], ranges[2, new], reach[last]])


class Seeds:
    """The masked windows of benchmark items: sorted hashes, a bitmap before them, and where each comes from."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        import numpy as np

        from granary.llm.bytescan import sequence_hashes

        self.ids = [i for i, _ in items]
        self.hashes, self.firsts = _words([(t or "").encode() for _, t in items])
        keys, item, place = [], [], []
        #: Lengths of items that count as a whole; the shorter ones only as a document's whole text.
        self.lengths, self.whole = set(), set()
        for i, (a, b) in enumerate(zip(self.firsts.tolist(), self.firsts[1:].tolist())):
            h = self.hashes[a:b]
            if len(h) >= SPAN:
                found = [sequence_hashes(h, SPAN, mask, salt=m) for m, mask in enumerate(MASKS)]
            elif len(h):
                (self.lengths if len(h) >= SHORTEST else self.whole).add(len(h))
                found = [sequence_hashes(h, len(h), salt=100 + len(h))]
            else:
                continue
            for f in found:
                keys.append(f)
                item.append(np.full(len(f), i))
                place.append(np.arange(len(f)))
        keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        item = (np.concatenate(item) if item else np.empty(0, dtype=np.int64))[order]
        place = (np.concatenate(place) if place else np.empty(0, dtype=np.int64))[order]
        self.keys, self.item, self.place = keys, item, place
        self.near = np.zeros(1 << _BITS, dtype=bool)
        self.near[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _alignments(self, keys, at, text, firsts):
        """(text, item, least shift, greatest) of all alignments that equal windows propose, some of them more than that."""
        import numpy as np

        maybe = np.flatnonzero(self.near[(keys >> np.uint64(64 - _BITS)).astype(np.int64)])
        keys, at, text = keys[maybe], at[maybe], text[maybe]
        n = np.searchsorted(self.keys, keys, side="right") - np.searchsorted(self.keys, keys, side="left")
        out = []
        # A text whose windows meet so many: every shift along each item that one of them meets.
        pairs = np.bincount(text, weights=n, minlength=len(firsts) - 1)
        for t in np.flatnonzero(pairs > _PAIRS):
            items = np.unique(self.item[np.isin(self.keys, keys[text == t])])
            size = np.diff(self.firsts)[items]
            out.append(np.stack([np.full(len(items), t), items, firsts[t] - size, np.full(len(items), firsts[t + 1])]))
        few = (pairs <= _PAIRS)[text] & (n > 0)
        keys, at, text, n = keys[few], at[few], text[few], n[few]
        lo, total, i = np.searchsorted(self.keys, keys, side="left"), np.cumsum(n), 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS, side="right")))
            m = n[i:j]
            seed = np.repeat(lo[i:j] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            shift = np.repeat(at[i:j], m) - self.place[seed]
            out.append(_merged(np.stack([np.repeat(text[i:j], m), self.item[seed], shift, shift])))
            i = j
        return _merged(np.concatenate(out, axis=1)) if out else np.empty((4, 0), dtype=np.int64)

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, words of the item that overlap, substitutions among them), the best alignment of each pair."""
        import numpy as np

        from granary.llm.bytescan import sequence_hashes

        hashes, firsts = _words(texts)
        at = np.arange(len(hashes))
        text = np.repeat(np.arange(len(texts)), np.diff(firsts))
        room = firsts[1:][text] - at
        whole = (firsts[:-1][text] == at) & (room < SHORTEST)
        found = []
        for n, mask, salt in [*((SPAN, mask, m) for m, mask in enumerate(MASKS)), *((n, None, 100 + n) for n in sorted(self.lengths | self.whole))]:
            keys = sequence_hashes(hashes, n, mask, salt)
            fits = room[: len(keys)] >= n if n not in self.whole else whole[: len(keys)] & (room[: len(keys)] == n)
            inside = np.flatnonzero(fits)
            found.append(self._alignments(keys[inside], inside, text[inside], firsts))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        ranges = _merged(np.concatenate(found, axis=1)) if found else np.empty((4, 0), dtype=np.int64)
        for text, item, low, high in ranges.T.tolist():
            a, b = int(self.firsts[item]), int(self.firsts[item + 1])
            begin, end, span = int(firsts[text]), int(firsts[text + 1]), min(SPAN, b - a)
            for shift in range(low, high + 1):
                lo, hi = max(begin, shift), min(end, shift + b - a)
                have = best.get((text, item), (0, 0))
                if hi - lo < max(span, have[0]) or have == (b - a, 0):  # can't be better
                    continue
                differ = hashes[lo:hi] != self.hashes[a + lo - shift : a + hi - shift]
                total = np.concatenate([[0], np.cumsum(differ)])
                good = np.flatnonzero(total[span:] - total[:-span] <= (SUBSTITUTIONS if span == SPAN else 0))
                if not len(good):
                    continue
                cover = np.zeros(len(differ) + 1, dtype=np.int64)
                np.add.at(cover, good, 1)
                np.add.at(cover, good + span, -1)
                cover = np.cumsum(cover)[:-1] > 0
                n, subs = int(cover.sum()), int((cover & differ).sum())
                if (n, -subs) > have:
                    best[text, item] = (n, -subs)
        return [(t, i, n, -s) for (t, i), (n, s) in sorted(best.items())]


def _shards(items: DataFrame) -> list[DataFrame]:
    """Parts of the benchmark, each with about SEED_BYTES of text at most."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // SEED_BYTES)
    if n <= 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _seeds(items: DataFrame):
    """Seeds of one part, sent to executors: at most SEED_BYTES of text."""
    rows = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]
    return items.sparkSession.sparkContext.broadcast(Seeds(rows))


def _pairs(batches: Iterator, held) -> Iterator:
    import pyarrow as pa

    seeds = held.value
    for batch in batches:
        for part in pieces(batch, "text"):
            ids = part.column("doc_id").to_pylist()
            rows = [(ids[t], seeds.ids[i], n, s, int(seeds.firsts[i + 1] - seeds.firsts[i])) for t, i, n, s in seeds.find([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "n_overlap", "n_substituted", "n_item"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of rows that overlap: doc_id, item_id, n_overlap, n_substituted, n_item (words).

    They overlap if thirteen aligned words of both differ in two at most; items of five to
    twelve words if they stand whole and unchanged, shorter ones if they are all there is of a
    document, items without words never.  Case and ASCII
    punctuation don't count.  Null texts are empty; null ids and repeated rows are returned as
    they come; empty tables give an empty result; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    out = None
    for shard in _shards(items):
        seeds = _seeds(shard)
        found = docs.mapInArrow(lambda b, s=seeds: _pairs(b, s), "doc_id long, item_id long, n_overlap long, n_substituted long, n_item long")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(batches: Iterator, held) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in pieces(batch, "text"):
            good = np.ones(part.num_rows, dtype=bool)
            good[[t for t, *_ in held.value.find([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])]] = False
            yield part.filter(pa.array(good))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps no benchmark item.

    Null and empty texts overlap none and stay, and so do null ids and repeated rows of clean
    texts; an empty table gives an empty result, an empty benchmark all rows; further columns
    are kept, whatever their names.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for shard in _shards(items):
        seeds = _seeds(shard)
        docs = docs.mapInArrow(lambda b, s=seeds: _clean(b, s), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE: dict[str, str] = {}
