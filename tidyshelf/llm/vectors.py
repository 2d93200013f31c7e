"""Rows of vectors inside tasks: what may take part, matrices out of Arrow batches, runs as blobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str, bound: float) -> tuple[DataFrame, int]:
    """Rows whose vector has finite entries only, all below ``bound`` in size, and the width that most of
    them have (of equals the larger; 0 without rows). Vectors of another width take no part."""
    fine = rows.where(F.col(vector).isNotNull()).where(F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < bound)))
    most = (fine.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.desc("width")).first())
    width = most["width"] if most else 0
    return fine.where(F.size(vector) == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one width as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def runs(batches: Iterator[pa.RecordBatch], rows: int, key: str | None,
         build: Callable[[pa.Table, int], dict]) -> Iterator[pa.RecordBatch]:
    """Packs rows in the order they come into runs of at most ``rows`` with one value of ``key`` (any, if
    None); each run becomes the one row that ``build(run, number)`` returns. Holds one run at a time."""
    waiting: list[pa.RecordBatch] = []
    held, number, value = 0, 0, None

    def packed():
        return pa.RecordBatch.from_pylist([build(pa.Table.from_batches(waiting), number)])

    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(len(batch), np.int64)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(starts[:-1], starts[1:]):
            if start == stop:
                continue
            if held and keys[start] != value:
                yield packed()
                waiting, held, number = [], 0, number + 1
            value = keys[start]
            while start < stop:
                part = min(stop - start, rows - held)
                waiting.append(batch.slice(start, part))
                held, start = held + part, start + part
                if held == rows:
                    yield packed()
                    waiting, held, number = [], 0, number + 1
    if held:
        yield packed()


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def longs(column: pa.ChunkedArray | pa.Array, null: int) -> np.ndarray:
    """A column of longs, with ``null`` in place of nulls."""
    return column.fill_null(null).to_numpy().astype(np.int64)
