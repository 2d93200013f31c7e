"""Records of delimited files that may break lines inside quotes, found in parallel.

A split cannot tell whether it starts inside a quoted cell, so each one is read for both cases: how many
records it starts, and whether it ends inside quotes, if it begins outside or inside them. These two answers
are a function from state to state; composing the functions of a file's splits in order, one row a
split, gives every split its true starting state, its place among the records, and the file's encoding.
A second reading cuts the lines on breaks outside quotes only. Only pieces of records with line breaks
are brought together; all other lines pass straight through, already numbered.

Quotes count at the start of a cell only, as everywhere in such files: a lone inch mark within a
cell opens nothing. A file is UTF-8 if all its bytes are, else ISO-8859-1, each file by itself. Lines end
with a line feed, alone or after a carriage return. A quote that is never closed makes the rest of its file
one record, as it does for any reader.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyshelf.session import cut

#: Splits whose states are broadcast; with more of them the lines are brought to the states.
BROADCAST_SPLITS = 200_000


class Quotes:
    """Whether a line ends inside a quoted cell, by whether it starts in one."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        self.rest = re.compile(b'(?:[^"]|"")*+')
        self.after = re.compile(b"[^" + s + b"]*+(?:" + s + b"|$)")
        self.cells = re.compile(b'(?:(?:"(?:[^"]|"")*+"|(?!"))[^' + s + b"]*+" + s + b")*+"
                                b'(?:(?:"(?:[^"]|"")*+"|(?!"))[^' + s + b"]*+)?\\Z")

    def inside(self, line: bytes, inside: bool) -> bool:
        at = 0
        if inside:
            at = self.rest.match(line).end()
            if at == len(line):
                return True
            at = self.after.match(line, at + 1).end()
        return self.cells.match(line, at) is None


class _Split:
    """A split while its lines go by: the state for one assumed start, and records started so far."""

    def __init__(self, inside: bool):
        self.inside, self.records = inside, 0

    def take(self, quotes: Quotes, quoted: list[int], lines: list[bytes], filled: np.ndarray) -> np.ndarray:
        """Moves over some lines; returns whether each starts inside. ``quoted`` are those with quotes."""
        starts, at = np.zeros(len(filled), bool), 0
        for k, line in zip(quoted, lines):
            starts[at:k + 1] = self.inside
            self.inside, at = quotes.inside(line, self.inside), k + 1
        starts[at:] = self.inside
        self.records += int((filled & ~starts).sum())
        return starts


def _parts(batch: pa.RecordBatch):
    """The rows of each split in a batch: its name, the lines, which are not blank, which have quotes."""
    path, at = batch.column("_path").to_pylist(), batch.column("_at").to_numpy()
    edges = [0, *(i for i in range(1, len(path)) if at[i] != at[i - 1] or path[i] != path[i - 1]), len(path)]
    for start, stop in zip(edges[:-1], edges[1:]):
        if start < stop:
            lines = batch.column("line").slice(start, stop - start)
            quoted = np.flatnonzero(pc.count_substring(lines, pattern=b'"').to_numpy(zero_copy_only=False)).tolist()
            filled = pc.binary_length(pc.ascii_trim_whitespace(lines.view(pa.string()).cast(pa.string()))).to_numpy(
                zero_copy_only=False) > 0
            yield start, (path[start], int(at[start])), lines, filled, quoted


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"),
        F.is_valid_utf8("value").alias("_valid"))


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """Stored (_path, _at, inside, first, latin, before): the state a split starts in, the place of its first
    record in the file, whether the file is not UTF-8, and the data records of all files before it."""
    def read(batches):
        quotes, now, ways, valid = Quotes(sep), None, [], True

        def row():
            return pa.RecordBatch.from_pylist([{
                "_path": now[0], "_at": now[1], "end_out": ways[0].inside, "end_in": ways[1].inside,
                "n_out": ways[0].records, "n_in": ways[1].records, "valid": valid}])

        for batch in batches:
            flags = batch.column("_valid").to_numpy(zero_copy_only=False)
            for start, split, part, filled, quoted in _parts(batch):
                if split != now:
                    if now:
                        yield row()
                    now, ways, valid = split, [_Split(False), _Split(True)], True
                taken = part.take(pa.array(quoted, pa.int64())).to_pylist()
                for way in ways:
                    way.take(quotes, quoted, taken, filled)
                valid = valid and bool(flags[start:start + len(part)].all())
        if now:
            yield row()

    found = cut(lines.mapInArrow(
        read, "_path string, _at long, end_out boolean, end_in boolean, n_out long, n_in long, valid boolean"))
    before = W.partitionBy("_path").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    # A split either forces the state at its end, or flips it, or leaves it.
    fixed, flip = F.col("end_out") == F.col("end_in"), F.col("end_out") & ~F.col("end_in")
    flips = F.coalesce(F.sum(flip.cast("int")).over(before), F.lit(0))
    counted = found.withColumn("_flips", flips).withColumn("_last", F.last(F.when(
        fixed, F.struct("end_out", F.col("_flips").alias("flips"))), True).over(before))
    odd = (F.col("_flips") - F.coalesce(F.col("_last.flips"), F.lit(0))) % 2 == 1
    known = counted.withColumn("inside", F.coalesce(F.col("_last.end_out"), F.lit(False)) != odd)
    known = known.withColumn("_n", F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))).withColumn(
        "first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    files = known.groupBy("_path").agg(F.greatest(F.sum("_n") - 1, F.lit(0)).alias("_rows"),
                                       (~F.bool_and("valid")).alias("latin"))
    earlier = W.orderBy("_path").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("_path", "latin", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("before"))
    return cut(known.join(files, "_path").select("_path", "_at", "inside", "first", "latin", "before"))


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(_path, place, row_idx, text): each record of the files; place 0 is the header of its file, and
    ``row_idx`` numbers the data records of all files in order, densely."""
    lines = _lines(spark, path)
    states = split_states(lines, sep)
    if states.count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(states), ["_path", "_at"])
    else:
        placed = lines.join(states, ["_path", "_at"]).repartition("_path", "_at").sortWithinPartitions("_path", "_at", "_id")

    def assemble(batches):
        quotes, now, state = Quotes(sep), None, None
        for batch in batches:
            for start, split, part, filled, quoted in _parts(batch):
                if split != now:
                    inside, first, latin, before = (batch.column(c)[start].as_py() for c in (
                        "inside", "first", "latin", "before"))
                    now, state = split, _Split(inside)
                done = state.records
                starts_in = state.take(quotes, quoted, part.take(pa.array(quoted, pa.int64())).to_pylist(), filled)
                ends_in = np.append(starts_in[1:], state.inside)
                opens = filled & ~starts_in
                place = first + done + np.cumsum(opens) - 1
                keep = np.flatnonzero(opens | starts_in)
                whole = (opens & ~ends_in)[keep]
                text = part.take(pa.array(keep)).to_pylist()
                text = [t[:-1] if not e and t.endswith(b"\r") else t for t, e in zip(text, ends_in[keep].tolist())]
                text = [t.decode("latin-1") if latin else t.decode("utf-8") for t in text]
                ids = batch.column("_id").slice(start, len(part)).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([
                    pa.array([split[0]] * len(keep), pa.string()), pa.array(place[keep], pa.int64()),
                    pa.array(before + place[keep] - 1, pa.int64()), pa.array(np.full(len(keep), split[1]), pa.int64()), ids,
                    pa.array(whole), pa.array(text, pa.string())],
                    ["_path", "place", "row_idx", "_at", "_id", "whole", "text"])

    pieces = placed.select("_path", "_at", "_id", "line", "inside", "first", "latin", "before").mapInArrow(
        assemble, "_path string, place long, row_idx long, _at long, _id long, whole boolean, text string")
    joined = pieces.where("NOT whole").groupBy("_path", "place", "row_idx").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_at", "_id", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return pieces.where("whole").select("_path", "place", "row_idx", "text").unionByName(joined)


# The code of the tasks travels with them, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
