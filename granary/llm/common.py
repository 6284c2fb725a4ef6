"""What the operators of this subpackage share: tables, cut lineage, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from granary.plans.lineage import importable, keep, release, shared_dir

__all__ = ["BATCH_BYTES", "keep", "partitions", "pieces", "release", "shared_dir", "table"]

#: Bytes of text that Python works on at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch, column: str, most: int = BATCH_BYTES) -> Iterator:
    """Slices of an Arrow batch of at most so many bytes of text each; a longer text is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
