"""Substring dedup: suffixes split by variable-length prefixes, a tree for each group, repeats from its deep nodes.

A suffix starts at each word that has `window` words from there on in its document.  Its code
stands for its path in the tree of suffixes: eight bits of the hash of its first 1, 2, 4 and 8
words each, then all 64 bits of the hash of its first `window` words.  Codes in order are the
tree from left to right, cut off at depth `window`, since nothing below changes what repeats:
suffixes whose codes agree throughout share an internal node at that depth or deeper, which is a
passage that repeats.  Prefixes are cut longer where counts over all texts say that a group would
be too large, so each group of suffixes is sorted in memory.

Documents are dealt by ranges of doc_id, and each batch of them sends a code once, with how often
it holds it; a passage that all documents share is a row for each batch, not for each document.
Groups answer for each code in a deep internal node: has an earlier batch got it, and how many
suffixes are below?  Batches turn answers into the runs of words that repeat and, where these
branch, into maximal repeats: as long as a passage and a longer one occur equally often, the path
between them has no branch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import partitions, pieces, table

WINDOW = 13
#: Depths, in words, at which a code has eight bits of its prefix.
LEVELS = (1, 2, 4, 8)
#: Bytes of text in a batch: the more, the fewer codes are sent more than once.
BATCH = 8 << 20
#: Suffixes that a group should hold: by the root of their number, between these bounds.
GROUP, GROUP_ROOT, GROUP_MOST = 1 << 20, 64, 1 << 24
#: Ranges of doc_id with about equal numbers of rows; more batches than these are cut evenly inside.
QUANTILES = 4096
_LAST = 1 << 62


def _windows(texts: list[bytes], window: int):
    """Word hashes of all texts, where each text's words begin (and the end), where windows start."""
    import numpy as np

    from granary.llm.bytescan import buffer, words, word_hashes

    data, begins = buffer(texts)
    starts, ends = words(data)
    firsts = np.searchsorted(starts, begins)
    at = np.arange(len(starts))
    room = np.repeat(firsts[1:], np.diff(firsts)) - at
    return word_hashes(data, starts, ends), firsts, at[room >= window]


def _codes(hashes, at, window: int):
    """Codes of the suffixes that start at some words: 32 bits of prefixes and 32 of the window, then its other 32."""
    import numpy as np

    from granary.llm.bytescan import _C, U, mix

    acc = np.ones(len(at), dtype=np.uint64)
    top = np.zeros(len(at), dtype=np.uint64)
    depths = [d for d in LEVELS if d < window]
    for k in range(window):
        acc *= U(_C)
        acc += hashes[at + k]
        if k + 1 in depths:
            top = (top << U(8)) | (mix(acc) >> U(56))
    top <<= U(8 * (4 - len(depths)))
    deep = mix(acc + U(0x5851F42D4C957F2D))
    return (top << U(32)) | (deep >> U(32)), (deep & U(0xFFFFFFFF)).astype(np.uint32)


def _unique(key, extra):
    """Distinct codes in order, how often each comes, and for each suffix the number of its code."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    k, x = key[order], extra[order]
    if ((k[1:] == k[:-1]) & (x[1:] < x[:-1])).any():
        order = np.lexsort((extra, key))
        k, x = key[order], extra[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    number = np.cumsum(new) - 1
    inverse = np.empty(len(k), dtype=np.int64)
    inverse[order] = number
    return k[new], x[new], np.bincount(number).astype(np.uint32), inverse


def _planes(x) -> bytes:
    """Numbers as byte planes, which compress well."""
    import numpy as np

    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(raw, n: int, kind: str):
    import numpy as np

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw[: size * n].reshape(size, n).T).view(kind).ravel()


def _squeeze(key, extra, count) -> bytes:
    """Codes in order and how often each comes: differences by byte plane, the further bits, the counts."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(key, prepend=np.uint64(0)).astype("<u8")) + extra.astype("<u4").tobytes() + _planes(count.astype("<u4")))


def _expand(data: bytes, n: int):
    import numpy as np
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.cumsum(_numbers(raw, n, "<u8"), dtype=np.uint64), raw[8 * n : 12 * n].view("<u4"), _numbers(raw[12 * n :], n, "<u4")


def _count(batches: Iterator, window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        for part in pieces(batch, "text"):
            hashes, _, at = _windows([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], window)
            total += np.bincount((_codes(hashes, at, window)[0] >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["prefix", "n"])


def prefixes(counts: dict[int, int], group: int) -> list[int]:
    """Where groups begin, in the first 32 bits of codes, from counts by their first 16 bits.

    Neighbouring short prefixes share a group; a frequent one is cut by longer prefixes.
    """
    out, room = [0], group
    for prefix in sorted(counts):
        n = counts[prefix]
        if n > group:
            parts = min(1 << 16, -(-n // group))
            out += [(prefix << 16) + (i << 16) // parts for i in range(parts)]
            out.append((prefix + 1) << 16)
            room = group
        else:
            if n > room:
                out.append(prefix << 16)
                room = group
            room -= n
    return sorted({x for x in out if x < 1 << 32})


def _batches(rows: Iterator) -> Iterator:
    """Sorted (bucket, doc_id, text) -> (rank, doc_ids, texts), never cut within a doc_id."""
    bucket = seq = size = None
    ids: list = []
    texts: list = []
    for b, d, t in rows:
        if ids and (b != bucket or (size >= BATCH and d != ids[-1])):
            yield _LAST if ids[0] is None else (bucket << 20) + seq, bucket, ids, texts
            ids, texts = [], []
        if b != bucket:
            bucket, seq, size = b, -1, 0
        if not ids:
            seq, size = seq + 1, 0
        ids.append(d)
        texts.append(t or b"")
        size += len(texts[-1])
    if ids:
        yield _LAST if ids[0] is None else (bucket << 20) + seq, bucket, ids, texts


def _rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield from zip(batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())


def _send(batches: Iterator, cuts: list[int], window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    bounds = np.array(cuts, dtype=np.uint64) << np.uint64(32)
    for rank, bucket, _, texts in _batches(_rows(batches)):
        hashes, _, at = _windows(texts, window)
        key, extra, count, _ = _unique(*_codes(hashes, at, window))
        place = np.searchsorted(bounds, key, side="right") - 1
        # Only groups that the batch has suffixes for.
        cut = np.flatnonzero(np.diff(place, prepend=-1, append=-1)).tolist()
        rows = [(int(place[a]), rank, bucket, a, b - a, _squeeze(key[a:b], extra[a:b], count[a:b])) for a, b in zip(cut, cut[1:])]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["grp", "rank", "bucket", "first", "n", "data"])


def _tree(group):
    """One group's suffixes in order -> for each that is in a deep internal node: is an earlier batch there, and how many are."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    n = group.column("n").to_pylist()
    got = [_expand(d, k) for d, k in zip(group.column("data").to_pylist(), n)]
    rank = np.repeat(group.column("rank").to_numpy(), n)
    key, extra, count = (np.concatenate([g[i] for g in got]) for i in range(3))
    del got
    order = np.lexsort((rank, extra, key))
    key, extra, rank = key[order], extra[order], rank[order]
    start = np.ones(len(key), dtype=bool)
    start[1:] = (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])
    del key, extra
    node = np.cumsum(start, dtype=np.int32) - 1
    below = np.bincount(node, weights=count[order]).astype(np.uint64)
    seen, total = np.empty(len(node), dtype=bool), np.empty(len(node), dtype=np.uint32)
    seen[order] = rank > rank[start][node]
    total[order] = np.minimum(below, 0xFFFFFFFF)[node].astype(np.uint32)
    rows = []
    for b, r, f, k, e in zip(group.column("bucket").to_pylist(), group.column("rank").to_pylist(), group.column("first").to_pylist(), n, np.cumsum(n).tolist()):
        deep = total[e - k : e] > 1
        if deep.any():
            rows.append((b, r, f, k, zstandard.compress(np.packbits(seen[e - k : e]).tobytes() + np.packbits(deep).tobytes() + _planes(total[e - k : e][deep].astype("<u4")))))
    cols = list(zip(*rows)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])], names=["bucket", "rank", "first", "n", "bits"])


def _cover(docs, flags, window: int):
    """A bucket's documents with the bits of its batches' codes -> repeats and what is left."""
    from itertools import compress

    import numpy as np
    import pyarrow as pa
    import zstandard

    bits: dict[int, list] = {}
    for r, f, n, b in zip(*(flags.column(c).to_pylist() for c in ("rank", "first", "n", "bits"))):
        bits.setdefault(r, []).append((f, n, b))
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    rows = []
    for rank, _, ids, texts in _batches(_rows(docs.to_batches())):
        hashes, firsts, at = _windows(texts, window)
        key, _, total, inverse = _unique(*_codes(hashes, at, window))
        seen = np.zeros(len(key), dtype=bool)
        for f, n, b in bits.get(rank, ()):
            raw, size = np.frombuffer(zstandard.decompress(b), dtype=np.uint8), -(-n // 8)
            seen[f : f + n], deep = (np.unpackbits(raw[i * size : (i + 1) * size], count=n).astype(bool) for i in (0, 1))
            total[f : f + n][deep] = _numbers(raw[2 * size :], int(deep.sum()), "<u4")
        # Within the batch: the place in order of each window's doc_id, equal for equal ones.
        change = np.concatenate([[0], np.cumsum([a != b for a, b in zip(ids[1:], ids)])]).astype(np.int64)
        own = np.repeat(change, np.diff(firsts))[at]
        least = np.full(len(key), len(ids), dtype=np.int64)
        np.minimum.at(least, inverse, own)
        again = seen[inverse] | (least[inverse] < own)
        hit, total = at[again], total[inverse[again]]
        covered = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + window, -1)
        covered = np.cumsum(covered)[:-1] > 0
        # Windows that follow each other and occur equally often are one path without a branch.
        text = np.searchsorted(firsts, hit, side="right")
        new = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(text, prepend=-1) != 0) | (np.diff(total.astype(np.int64), prepend=-1) != 0))
        paths = np.stack([hit[new], hit[np.append(new[1:], len(hit)) - 1] + window if len(new) else hit[new], total[new]])
        cut = np.searchsorted(paths[0], firsts)
        for i, (d, t) in enumerate(zip(ids, texts)):
            c, w = covered[firsts[i] : firsts[i + 1]], t.split()
            if c.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                longest = [{"start": int(a - firsts[i]), "end": int(b - firsts[i]), "occurrences": int(n)} for a, b, n in paths[:, cut[i] : cut[i + 1]].T]
                rows.append((d, len(w), spans, longest, b" ".join(compress(w, ~c))))
            else:
                rows.append((d, len(w), [], [], b" ".join(w)))
    cols = list(zip(*rows)) or [[]] * 5
    span = [("start", pa.int32()), ("end", pa.int32())]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("occurrences", pa.int64())]))]
    return pa.Table.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(cols[4], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "repeats", "maximal", "kept"])


def _bucket(docs: DataFrame) -> Column:
    """Ranges of doc_id in order, of about a batch of text each: quantiles, and even steps between them where there are more."""
    size, least, most = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
    many = max(1, -(-int(size or 0) // BATCH))
    if least is None:
        ranged = F.lit(0).cast("long")
    else:
        parts = min(many, QUANTILES)
        # Where ranges begin: at most as many numbers as there are quantiles.
        cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100_000)).first()[0] if parts > 1 else []
        bounds = sorted({least, *cuts})
        held, steps = F.lit(bounds), -(-many // len(bounds)) if many > QUANTILES else 1
        # The last bound that is not above, by halving; null for a null doc_id.
        halves = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
        i = F.aggregate(halves, F.lit(0), lambda at, h: F.when((at + h < len(bounds)) & (F.get(held, at + h) <= F.col("doc_id")), (at + h).cast("int")).otherwise(at))
        low, high = F.get(held, i).cast("double"), F.coalesce(F.get(held, i + 1), F.lit(most)).cast("double")
        inner = F.floor((F.col("doc_id").cast("double") - low) * steps / F.greatest(high - low, F.lit(1.0)))
        ranged = F.when(F.col("doc_id").isNotNull(), i.cast("long") * steps + F.least(inner, F.lit(steps - 1)).cast("long"))
    # Documents without an id come after all others, and don't precede each other.
    return F.coalesce(ranged, (1 << 40) + F.pmod(F.xxhash64("text"), F.lit(many)))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, repeats (runs of words, [start, end)), maximal, kept (text without repeats).

    maximal has the maximal repeats within those runs: start, end, and how many suffixes of all
    texts begin with each window of it, which is one number throughout.

    A word repeats if it lies in `window` consecutive words whose sequence also starts in a
    document with a smaller doc_id; all judged on the input.  A null text counts as empty.
    A row with a null doc_id comes after all that have one, and none of those precedes
    another; rows of one doc_id don't precede each other either.  Any 64-bit id will do, however
    uneven; rows of one id stay together.  An empty table gives an empty result; further columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = docs.select("text").mapInArrow(lambda b: _count(b, window), "prefix int, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    counts = {r["prefix"]: r["n"] for r in counts.collect()}  # 65,536 rows at most
    cuts = prefixes(counts, min(GROUP_MOST, max(GROUP, int(GROUP_ROOT * sum(counts.values()) ** 0.5))))
    n = partitions(spark)
    dealt = docs.withColumn("bucket", _bucket(docs)).repartition(n, "bucket")
    sent = dealt.sortWithinPartitions("bucket", "doc_id", "text").mapInArrow(lambda b: _send(b, cuts, window), "grp int, rank long, bucket long, first long, n long, data binary")
    flags = sent.groupBy("grp").applyInArrow(_tree, "bucket long, rank long, first long, n long, bits binary")
    both = dealt.groupBy("bucket").cogroup(flags.groupBy("bucket"))
    return both.applyInArrow(lambda a, b: _cover(a, b, window), "doc_id long, n_words long, repeats array<struct<start:int,end:int>>, maximal array<struct<start:int,end:int,occurrences:long>>, kept string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, w, string_agg(w, ' ') OVER f AS k, count(*) OVER f AS n FROM w
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), least_ AS (SELECT k, min(doc_id) AS m FROM g WHERE n = 13 GROUP BY k
), h AS (SELECT g.doc_id, g.i, g.w, coalesce(g.n = 13 AND m < g.doc_id, FALSE) AS hit FROM g LEFT JOIN least_ USING (k)
), c AS (
  SELECT doc_id, i, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS cut FROM h
), r AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS first FROM c)
SELECT d.doc_id, count(w)::BIGINT AS n_words, (count(*) FILTER (cut))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256, (count(*) FILTER (first))::INT AS n_repeats
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE = {"op4_substring_dedup": ORACLE_SQL}
