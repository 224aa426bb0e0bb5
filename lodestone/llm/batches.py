"""Helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestone.ship import ship_package

#: Text bytes worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 2 << 20


#: Settings for tables of rows of several MB: rows that a reader decodes at once, and bytes from which a batch goes to a Python worker.
LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "4", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside, tables of rows of several MB are read and handed to Python workers a few rows at a time. By default a task decodes up to 4,096 rows
    at once and sends batches of 64 MB, each in buffers of up to twice that: memory would follow the number of rows in a task."""
    before = {key: spark.conf.get(key) for key in LARGE_ROWS}
    try:
        for key, value in LARGE_ROWS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def row_schema(df: DataFrame, key: str, more: str) -> StructType:
    """The schema of a key column of ``df`` with further fields (as DDL)."""
    return StructType([*df.select(key).schema.fields, *StructType.fromDDL(more).fields])


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` text bytes (or one row), so that working
    memory follows the slice and not the number of rows that Spark puts into a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(column: pa.Array) -> list[str]:
    """Texts, a null as an empty one."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts, a null as none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def list_column(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes, cut from ``values`` one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of every range ``starts[i] .. starts[i] + sizes[i] - 1``, one range after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int64)
