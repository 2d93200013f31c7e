"""Reading text columns inside tasks: bounded slices of Arrow batches as bytes.

Every operator of this subpackage gets its columns by selecting them, so extra columns of the input,
also such as bear the names of results, are left out before any work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once. A longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(lengths(batch.column(text)))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    return np.diff(utf8(column)[1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the n + 1 offsets in it. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, kind)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def encoded(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8; null is empty."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def held_out(ids: pa.Array) -> np.ndarray:
    """True where crc32 of the id as text has remainder 2 modulo 4; a null id is the empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2
                        for i in ids.to_pylist()), bool, len(ids))


def with_text(docs: DataFrame, row: Column, text: Column, changed: Column | None = None) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``, with a new text where ``changed`` (always, if
    not given); ``n_chars``, where there is one, is counted again for it."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return [(row[c] if c not in new else new[c] if changed is None
             else F.when(changed, new[c]).otherwise(row[c])).alias(c) for c in docs.columns]
