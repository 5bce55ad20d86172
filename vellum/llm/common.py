"""Shared plumbing: tables, durable intermediate results, Arrow byte views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellum.sources.durable import discard, release, setting, store  # noqa: F401

#: Rows of an Arrow batch in stored steps; a worker holds one batch at a time.
BATCH_ROWS = 256
#: Bytes of text that the numpy kernels take at once (one longer text is taken alone).
SLICE_BYTES = 1 << 19
#: Rows that the numpy kernels take at once.
MOST_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of so many rows for the steps that are stored inside; outside, the
    session's own settings bound a batch (64 MB unless set otherwise)."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def free_name(columns, wanted: str) -> str:
    """``wanted``, with underscores in front until no column has the name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after another, and offsets (n + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of MOST_ROWS rows at most whose texts hold ``most`` bytes together, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, first + MOST_ROWS, n)
        yield first, last
        first = last
