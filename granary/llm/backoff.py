"""Language-model scores with stupid backoff, from n-gram counts of the whole corpus.

Documents are gathered into batches of some megabytes of text.  Each batch sends every n-gram
it holds once, with its count, to the part of the count tables that the n-gram's hash falls in;
each part sums counts over batches and sends each batch the totals of its n-grams.  A batch then
looks up its exploded n-grams and sums their scores by document.  As counts are summed in each
batch first, a frequent n-gram is a row for each batch, and no part of the tables is larger for it.

The score of a word after its context is c(context, word) / c(context) if the n-gram occurs
min_count times, else alpha times the score after the context without its first word; a word
alone scores c(word) / c(all words).  Contexts don't reach beyond a document's first word.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import partitions, pieces, table

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Bytes of text in a batch: the more, the fewer n-grams are sent more than once.
BATCH = 8 << 20
#: N-grams, as batches send them, that a part of the count tables should hold.
PART = 1 << 22


def _gather(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    base, seq = TaskContext.get().partitionId() << 32, 0
    squeeze = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for part in pieces(batch, "text", BATCH):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            lens = np.fromiter(map(len, texts), dtype="<i8", count=len(texts))
            data = squeeze.compress(lens.tobytes() + b"".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([base + seq]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], ["batch", "doc_ids", "data"])
            seq += 1


def _words(batches: Iterator) -> Iterator:
    import pyarrow as pa

    n = 0
    for batch in batches:
        n += sum(len(t.split()) for t in batch.column("text").cast(pa.binary()).to_pylist() if t)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _texts(data: bytes, n: int) -> list[bytes]:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, dtype="<i8", count=n)) + 8 * n
    return [raw[a:b] for a, b in zip([8 * n, *ends.tolist()], ends.tolist())]


def _grams(texts: list[bytes], order: int):
    """64-bit hashes of n-grams of each order, one row after the other, and what says where they end.

    -> (all hashes, [places of their last words for each order], where each text's words begin and end)
    """
    import numpy as np

    from granary.llm.bytescan import buffer, sequence_hashes, word_hashes, words

    data, begins = buffer(texts)
    starts, ends = words(data)
    hashes = word_hashes(data, starts, ends)
    firsts = np.searchsorted(starts, begins)
    inside = np.arange(len(hashes)) - np.repeat(firsts[:-1], np.diff(firsts))
    keys, places = [], []
    for k in range(1, order + 1):
        at = np.flatnonzero(inside >= k - 1)
        keys.append(sequence_hashes(hashes, k, salt=k)[at - (k - 1)])
        places.append(at)
    return np.concatenate(keys), places, firsts


def _send(batches: Iterator, order: int, parts: int) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)
    for batch in batches:
        for i in range(batch.num_rows):
            key, count = np.unique(_grams(_texts(batch.column("data")[i].as_py(), len(batch.column("doc_ids")[i])), order)[0], return_counts=True)
            place = np.searchsorted(bounds, key, side="right")
            # Only parts that the batch has n-grams for.
            cut = np.flatnonzero(np.diff(place, prepend=-1, append=-1)).tolist()
            rows = []
            for a, b in zip(cut, cut[1:]):
                planes = np.diff(key[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
                counts = count[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T
                rows.append((int(place[a]), a, b - a, squeeze.compress(np.ascontiguousarray(planes).tobytes() + np.ascontiguousarray(counts).tobytes())))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([batch.column("batch")[i].as_py()] * len(rows), pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["part", "batch", "first", "n", "data"])


def _sum(part):
    """One part of the count tables: totals over all batches, for each batch's n-grams in their order."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    n = part.column("n").to_pylist()
    keys, counts = [], []
    for data, k in zip(part.column("data").to_pylist(), n):
        raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
        keys.append(np.cumsum(np.ascontiguousarray(raw[: 8 * k].reshape(8, k).T).view("<u8").ravel(), dtype=np.uint64))
        counts.append(np.ascontiguousarray(raw[8 * k :].reshape(4, k).T).view("<u4").ravel())
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate(counts)
    # What other batches add: nothing for most, which takes little room.
    totals = np.bincount(inverse, weights=counts).astype("<u8")[inverse] - counts
    squeeze = zstandard.ZstdCompressor(level=1)
    ends = np.cumsum(n).tolist()
    packed = [squeeze.compress(np.ascontiguousarray(totals[e - k : e].view(np.uint8).reshape(-1, 8).T).tobytes()) for e, k in zip(ends, n)]
    return pa.Table.from_arrays([part.column("batch"), part.column("first"), part.column("n"), pa.array(packed, pa.binary())], names=["batch", "first", "n", "totals"])


def _score(docs, totals, order: int, alpha: float, min_count: int, all_words: int):
    import numpy as np
    import pyarrow as pa
    import zstandard

    if docs.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log10_score": pa.array([], pa.float64())})
    doc_ids = docs.column("doc_ids")[0].as_py()
    keys, places, firsts = _grams(_texts(docs.column("data")[0].as_py(), len(doc_ids)), order)
    # The batch's own counts, in the order in which it sent its n-grams.
    by_key = np.argsort(keys)
    keys = keys[by_key]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    del keys
    number = np.cumsum(new, dtype=np.int32) - 1
    table = np.bincount(number, minlength=0).astype(np.uint64)
    for f, n, t in zip(*(totals.column(c).to_pylist() for c in ("first", "n", "totals"))):
        raw = np.frombuffer(zstandard.decompress(t), dtype=np.uint8)
        table[f : f + n] += np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()
    spread = np.empty(len(number), dtype=np.float64)
    spread[by_key] = table[number]
    del by_key, number, new
    found = np.split(spread, np.cumsum([len(p) for p in places])[:-1])
    words = int(firsts[-1])
    log = np.zeros(words)
    count = []
    for at, c in zip(places, found):
        full = np.zeros(words)
        full[at] = c
        count.append(full)
    open_ = np.ones(words, dtype=bool)  # not scored yet
    for k in range(order, 1, -1):
        at = places[k - 1][open_[places[k - 1]]]
        hit = at[count[k - 1][at] >= min_count]
        log[hit] += np.log10(count[k - 1][hit] / count[k - 2][hit - 1])
        open_[hit] = False
        log[at[open_[at]]] += np.log10(alpha)
    log[open_] += np.log10(count[0][open_] / max(all_words, 1))
    total = np.array([log[a:b].sum() for a, b in zip(firsts[:-1], firsts[1:])])
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_words": pa.array(np.diff(firsts).astype(np.int64)), "log10_score": pa.array(total)})


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, log10_score (the sum over words), log10_per_word (null without words).

    Words are runs of bytes other than space and 0x09-0x0D.  A null text counts as empty; null
    doc_ids and repeated rows are returned as they come, and all count; an empty table gives an
    empty result; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    words = docs.select("text").mapInArrow(_words, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # One exchange of the texts, which both the counts and the scores read.
    gathered = docs.mapInArrow(_gather, "batch long, doc_ids array<long>, data binary").repartition(partitions(docs.sparkSession), "batch")
    grams = max(1, order * words)
    parts = -(-grams // PART)
    sent = gathered.mapInArrow(lambda b: _send(b, order, parts), "part int, batch long, first long, n long, data binary")
    totals = sent.groupBy("part").applyInArrow(_sum, "batch long, first long, n long, totals binary")
    both = gathered.groupBy("batch").cogroup(totals.groupBy("batch"))
    scored = both.applyInArrow(lambda a, b: _score(a, b, order, alpha, min_count, words), "doc_id long, n_words long, log10_score double")
    return scored.withColumn("log10_per_word", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log10_score", 4).alias("log10_score"), F.round("log10_per_word", 6).alias("log10_per_word"))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, w AS w1, lag(w, 1) OVER p AS w2, lag(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), c1 AS (SELECT w1, count(*) AS c FROM g GROUP BY ALL
), c2 AS (SELECT w2, w1, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY ALL
), c3 AS (SELECT w3, w2, w1, count(*) AS c FROM g WHERE w3 IS NOT NULL GROUP BY ALL
), s AS (
  SELECT g.doc_id,
    CASE WHEN t.c >= 2 THEN log10(t.c / tb.c)
         WHEN b.c >= 2 THEN (CASE WHEN g.w3 IS NOT NULL THEN log10(0.4::DOUBLE) ELSE 0 END) + log10(b.c / ub.c)
         ELSE (CASE WHEN g.w3 IS NOT NULL THEN 2 WHEN g.w2 IS NOT NULL THEN 1 ELSE 0 END) * log10(0.4::DOUBLE) + log10(u.c / (SELECT count(*) FROM g)) END AS s
  FROM g JOIN c1 u ON u.w1 = g.w1
  LEFT JOIN c2 b ON b.w2 = g.w2 AND b.w1 = g.w1
  LEFT JOIN c3 t ON t.w3 = g.w3 AND t.w2 = g.w2 AND t.w1 = g.w1
  LEFT JOIN c1 ub ON ub.w1 = g.w2
  LEFT JOIN c2 tb ON tb.w2 = g.w3 AND tb.w1 = g.w2
)
SELECT d.doc_id, count(s.s)::BIGINT AS n_words, round(coalesce(sum(s.s), 0), 4) AS log10_score, round(sum(s.s) / count(s.s), 6) AS log10_per_word
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""

QUERIES = {"op2_lm_score": op2_lm_score}
ORACLE = {"op2_lm_score": ORACLE_SQL}
