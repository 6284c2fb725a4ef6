"""Span scans: an Arrow pass that runs a Python scanner over every whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import pieces

SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def _scan(batches: Iterator, scan: Callable) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in batches:
        for part in pieces(batch, "text"):
            rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in scan(t or "")] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, type=kind)], ["doc_id", "spans"])


def scan_documents(docs: DataFrame, scan: Callable) -> DataFrame:
    """(doc_id, text) -> (doc_id, spans), each span with kind, start, end (code points, end exclusive) and score."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda b: _scan(b, scan), SCHEMA)


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def joined(kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans, of some kinds or all, comma-joined in their order."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
