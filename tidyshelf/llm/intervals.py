"""Half-open intervals as arrays of (start, end), in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<start:long,end:long>>"


def merged(sorted_spans: Column) -> Column:
    """Union of intervals that are sorted by start; touching ones become one."""
    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(
            span["start"].alias("start"), span["end"].alias("end")))))

    return F.aggregate(sorted_spans, F.array().cast(KIND), add)


def covered(spans: Column) -> Column:
    """Places in intervals sorted by start, each counted once, in one pass."""
    state = "struct<count:long,end:long>"
    return F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("end"))
        .cast(state),
        lambda done, span: F.struct(
            (done["count"] + F.greatest(F.lit(0), span["end"] - F.greatest(done["end"], span["start"])))
            .cast("long").alias("count"),
            F.greatest(done["end"], span["end"]).alias("end")),
        lambda done: done["count"])


def gaps(union: Column, length: Column) -> Column:
    """What a union of intervals leaves of 0..length, as intervals, also empty ones."""
    return F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(union, lambda s: s["end"])),
        F.concat(F.transform(union, lambda s: s["start"]), F.array(length.cast("long"))),
        lambda a, b: F.struct(a.alias("start"), b.alias("end")))
