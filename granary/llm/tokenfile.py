"""Token-id segments: patched frame-of-reference blocks with a document table and a block index.

A segment holds whole documents in ascending doc_id order; it is a binary cell of a Parquet file,
so that Spark's commit protocol covers lost executors, and `write_segment` gives the same bytes
for a file of its own.  Ids are cut into blocks of 128: each block subtracts its minimum and packs
the rest at the width that some percentile of them needs, the one that makes block and exceptions
least together; the others' high bits go to an exception list.  Layout, little-endian:

    magic "PFR2", u32 documents, u64 ids, u32 blocks, u32 exceptions, u8 bytes of high bits (2 or 4)
    i64 doc_id, u8 null flag, u32 ids                                      of each document
    u32 minimum, u8 width, u8 exceptions, u32 start of packed words        of each block (the index)
    u64 packed words
    u8 place in the block, u16 or u32 high bits                            of each exception

One document is read through the index, without unpacking any block but its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import keep, partitions, pieces, table

BLOCK = 128
_HEAD = struct.Struct("<4sIQIIB")


def _lanes(width: int):
    for lane in range(BLOCK):
        word, shift = divmod(lane * width, 64)
        yield lane, word, shift, shift + width > 64


def _bits(x):
    """How many bits each value takes."""
    import numpy as np

    return np.frexp(x.astype(np.float64))[1]


def pack(ids) -> tuple:
    """ids (u32) -> minima, widths, starts, words, exceptions of each block, their places in it, their high bits."""
    import numpy as np

    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    minima = full.min(axis=1) if blocks else np.empty(0, dtype=np.uint32)
    rest = full - minima[:, None]
    bits = _bits(rest)
    # Values of each block that a width holds, and what block and exceptions take at it.
    held = np.cumsum(np.bincount((np.arange(blocks)[:, None] * 33 + bits).ravel(), minlength=33 * blocks).reshape(blocks, 33), axis=1)
    high_bytes = 2 if not blocks or bits.max() <= 16 else 4
    widths = (BLOCK // 8 * np.arange(33) + (BLOCK - held) * (1 + high_bytes)).argmin(axis=1).astype(np.uint8)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * 2)])
    words = np.zeros(int(starts[-1]), dtype=np.uint64)
    high = rest >> np.minimum(widths, 31)[:, None] >> (widths == 32)[:, None]
    odd = high > 0
    for w in np.unique(widths):
        w = int(w)
        if w == 0:
            continue
        own = np.flatnonzero(widths == w)
        low = np.ascontiguousarray((rest[own] & np.uint32((1 << w) - 1)).T.astype(np.uint64))
        out = np.zeros((2 * w, len(own)), dtype=np.uint64)
        for lane, word, shift, over in _lanes(w):
            out[word] |= low[lane] << np.uint64(shift)
            if over:
                out[word + 1] |= low[lane] >> np.uint64(64 - shift)
        words[(starts[own][:, None] + np.arange(2 * w)).ravel()] = out.T.ravel()
    return minima, widths, starts[:-1], words, odd.sum(axis=1).astype(np.uint8), np.nonzero(odd)[1].astype(np.uint8), high[odd], high_bytes


def unpack(n: int, minima, widths, starts, words, counts, places, high):
    """The inverse of pack, for any consecutive blocks with their own exceptions."""
    import numpy as np

    rest = np.zeros((len(minima), BLOCK), dtype=np.uint32)
    for w in np.unique(widths):
        w = int(w)
        if w == 0:
            continue
        own = np.flatnonzero(widths == w)
        got = np.ascontiguousarray(words[starts[own][:, None] + np.arange(2 * w)].T)
        low = np.empty((BLOCK, len(own)), dtype=np.uint32)
        mask = np.uint64((1 << w) - 1)
        for lane, word, shift, over in _lanes(w):
            v = got[word] >> np.uint64(shift)
            if over:
                v = v | (got[word + 1] << np.uint64(64 - shift))
            low[lane] = (v & mask).astype(np.uint32)
        rest[own] = low.T
    block = np.repeat(np.arange(len(minima)), counts)
    rest[block, places] |= (high.astype(np.uint64) << widths[block].astype(np.uint64)).astype(np.uint32)
    return (rest + minima[:, None]).ravel()[:n]


def write_segment(doc_ids: list, firsts, ids) -> bytes:
    import numpy as np

    minima, widths, starts, words, counts, places, high, high_bytes = pack(ids)
    parts = [_HEAD.pack(b"PFR2", len(doc_ids), len(ids), len(minima), len(places), high_bytes)]
    parts += [np.array([d or 0 for d in doc_ids], dtype="<i8"), np.array([d is None for d in doc_ids], dtype=np.uint8), np.diff([*firsts, len(ids)]).astype("<u4")]
    parts += [minima.astype("<u4"), widths, counts, starts.astype("<u4"), words.astype("<u8"), places, high.astype(f"<u{high_bytes}")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Segment:
    """A segment's tables, without its ids; those are unpacked when asked for."""

    def __init__(self, data: bytes):
        import numpy as np

        magic, docs, self.n, blocks, odd, high = _HEAD.unpack_from(data)
        if magic != b"PFR2":
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(kind: str, count: int):
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.firsts = np.concatenate([[0], np.cumsum(take("<u4", docs).astype(np.int64))])
        self.minima, self.widths, self.counts, self.starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u4", blocks).astype(np.int64)
        self.words = take("<u8", int(self.widths.sum(dtype=np.int64)) * 2)
        self.places, self.high = take("u1", odd), take(f"<u{high}", odd)
        self.odd = np.concatenate([[0], np.cumsum(self.counts.astype(np.int64))])

    def ids(self, lo: int = 0, hi: int | None = None):
        """Ids lo to hi: only the blocks that hold them are unpacked."""
        hi = self.n if hi is None else hi
        a, b = lo // BLOCK, -(-hi // BLOCK)
        o = slice(self.odd[a], self.odd[b])
        got = unpack((b - a) * BLOCK, self.minima[a:b], self.widths[a:b], self.starts[a:b], self.words, self.counts[a:b], self.places[o], self.high[o])
        return got[lo - a * BLOCK : hi - a * BLOCK]

    def document(self, k: int):
        """The ids of the k-th document of the segment."""
        return self.ids(int(self.firsts[k]), int(self.firsts[k + 1]))


def read_segment(data: bytes) -> tuple[list, list[int], object]:
    """doc_ids, where each document's ids begin (and the end), all ids."""
    s = Segment(data)
    return s.doc_ids, s.firsts.tolist(), s.ids()


def _write(batches: Iterator, path: str, end: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from granary.llm.bpe import encoder

    enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for piece in pieces(batch, "text", 1 << 20):
            ids, at = enc.encode([t or "" for t in piece.column("text").to_pylist()])
            n = piece.num_rows
            firsts = at[:-1] + np.arange(n)
            out = np.full(len(ids) + n, end, dtype=np.uint32)
            keep_at = np.ones(len(out), dtype=bool)
            keep_at[at[1:] + np.arange(n)] = False
            out[keep_at] = ids
            data = write_segment(piece.column("doc_id").to_pylist(), firsts, out)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(out)], pa.int64()), "doc_ids": pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), "data": pa.array([data], pa.binary())})
            seq += 1


def write(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Segments (part, seq, n_ids, doc_ids, data) in ascending doc_id order by (part, seq), written to the shared folder.

    Null doc_ids come first; rows of one doc_id follow each other by a hash of their text, so that
    many of them are dealt over many parts.  A null text counts as empty; an empty table gives no
    segments; repeated rows are written as often as they come; further columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    dealt = texts.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return keep(dealt.mapInArrow(lambda b: _write(b, path, end), "part int, seq int, n_ids long, doc_ids array<long>, data binary"))


def _read(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            part, seq = batch.column("part")[k].as_py(), batch.column("seq")[k].as_py()
            doc_ids, firsts, ids = read_segment(batch.column("data")[k].as_buffer().to_pybytes())
            raw = memoryview(ids.astype("<u4").tobytes())
            n = len(doc_ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * n, pa.int32()),
                    "seq": pa.array([seq] * n, pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "first": pa.array(firsts[:-1], pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(firsts, firsts[1:])], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(firsts, firsts[1:])], pa.int64()),
                }
            )


def read(segments: DataFrame) -> DataFrame:
    """One row per document from its segment: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.  No segments give no rows."""
    sizes = segments.select("part", "seq", "n_ids")
    # Within a part, then over the parts' sums: no window holds all segments.
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    base = parts.select("part", F.coalesce(F.sum("all_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    places = sizes.withColumn("before", before).join(base, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("at"))
    docs = segments.select("part", "seq", "data").mapInArrow(_read, "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["part", "seq"]).select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents that `wanted` (doc_id) names, each read through its segment's index.

    Null ids match none; a document that occurs more than once comes as often.
    """

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data, asked in zip(batch.column("data"), batch.column("asked").to_pylist()):
                segment, asked = Segment(data.as_buffer().to_pybytes()), set(asked)
                hits = [k for k, d in enumerate(segment.doc_ids) if d in asked]
                yield pa.RecordBatch.from_arrays([pa.array([segment.doc_ids[k] for k in hits], pa.int64()), pa.array([segment.document(k).astype("i8") for k in hits], pa.list_(pa.int64()))], ["doc_id", "ids"])

    ids = F.explode("doc_ids").alias("doc_id")
    places = segments.select("part", "seq", ids).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    # As many ids to a segment as it holds documents.
    asked = places.groupBy("part", "seq").agg(F.collect_set("doc_id").alias("asked"))
    return segments.join(asked, ["part", "seq"]).select("data", "asked").mapInArrow(found, "doc_id long, ids array<long>")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op9_token_file": op9_token_file}
ORACLE: dict[str, str] = {}
