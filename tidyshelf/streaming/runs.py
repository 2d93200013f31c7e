"""Runs of jobs from their events: begun, finished by a terminal event, or stalled by silence.

The events of a job, by time and then by tie, make runs: a run begins with the first event, with the one after a
terminal event, and with one that comes more than ``patience`` after the event before it. A run is

* ``finished`` if its last event is terminal;
* ``stalled`` if it is not and the time known to have passed (``upto``) is beyond its last event and ``patience``;
* ``open`` otherwise.

``runs`` states that over a table, ``watch`` over a stream: keyed state with event-time timers, which holds one open
run and the events the watermark has not passed yet per job, so events that come out of order within the watermark
change nothing, and forgets a job at its terminal event or when it is marked stalled. What a stream has written
equals the finished and stalled rows of ``runs`` over the events before its watermark.

Events without job or time take no part; a null tie or count is zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidyshelf.streaming.progress import TERMINAL

PATIENCE = 1800          # seconds
SLICE = 86_400           # seconds of a job that one task orders
_FIELDS = "started timestamp, updated timestamp, event_count long, processed long, ended_by string, status string"
_EVENT = np.dtype([("at", "<i8"), ("tie", "<i8"), ("processed", "<i8"), ("end", "<i8")])


def _events(events: DataFrame, job: str, ts: str, tie: str, processed: str, event: str, terminal: list[str]) -> DataFrame:
    """(job, at in microseconds, tie, processed, end: 0 or the place of a terminal event)."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in terminal]), F.col(event)), F.lit(0))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    return events.where(F.col(job).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(job).alias("job_id"), F.col(ts).cast("timestamp").alias("_ts"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), number(tie).alias("tie"),
        number(processed).alias("processed"), place.cast("long").alias("end"))


def _numbered(df: DataFrame, keys: list[str], order: list[str], first: str, last: str, patience: int) -> DataFrame:
    """Adds ``_run``: how many runs have begun so far among the rows of equal keys."""
    by = W.partitionBy(*keys).orderBy(*order)
    gap = F.col(first) - F.lag(last).over(by)
    begins = gap.isNull() | (gap > patience * 1_000_000) | (F.lag("end").over(by) > 0)
    return df.withColumn("_begins", begins.cast("int")).withColumn(
        "_run", F.sum("_begins").over(by.rowsBetween(W.unboundedPreceding, 0)))


def runs(events: DataFrame, job: str = "job_id", ts: str = "ts", tie: str = "event_id", processed: str = "processed",
         event: str = "event", terminal: list[str] = TERMINAL, patience: int = PATIENCE,
         upto: Column | None = None, width: int = SLICE) -> DataFrame:
    """All runs of a table. ``upto`` (microseconds) leaves later events out; without it the last event's time counts.

    Events are ordered within slices of a job's time; only the pieces of runs of a job, not its events, meet in one
    task, so a job that owns most events is spread.
    """
    rows = _events(events, job, ts, tie, processed, event, terminal)
    rows = rows if upto is None else rows.where(F.col("at") < upto)
    now = F.lit(rows.agg(F.max("at")).first()[0]).cast("long") if upto is None else upto
    sliced = rows.withColumn("_slice", F.floor(F.col("at") / (width * 1_000_000)))
    pieces = _numbered(sliced, ["job_id", "_slice"], ["at", "tie"], "at", "at", patience).groupBy(
        "job_id", "_slice", "_run").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"),
        F.max("processed").alias("processed"), F.max("end").alias("end")).drop("_run")
    # in a slice only the last event of a piece can be terminal, so the largest mark is that of the last
    whole = _numbered(pieces, ["job_id"], ["_slice", "first", "end"], "first", "last", patience).groupBy(
        "job_id", "_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("event_count"),
        F.max("processed").alias("processed"), F.max("end").alias("end"))
    return whole.select(
        "job_id", F.timestamp_micros("first").alias("started"), F.timestamp_micros("last").alias("updated"),
        "event_count", "processed", _name(F.col("end"), terminal).alias("ended_by"),
        F.when(F.col("end") > 0, "finished").when(F.col("last") + patience * 1_000_000 < now, "stalled")
        .otherwise("open").alias("status"))


def _name(end: Column, terminal: list[str]) -> Column:
    return F.get(F.array(*[F.lit(t) for t in terminal]), (end - 1).cast("int"))


def watch(events: DataFrame, late: str = "10 minutes", job: str = "job_id", ts: str = "ts", tie: str = "event_id",
          processed: str = "processed", event: str = "event", terminal: list[str] = TERMINAL,
          patience: int = PATIENCE) -> DataFrame:
    """Stream of finished and stalled runs, each written once, when the watermark has passed its end."""
    rows = _events(events, job, ts, tie, processed, event, terminal).withWatermark("_ts", late)
    names, wait = list(terminal), patience * 1_000_000
    key = f"job_id {dict(rows.dtypes)['job_id']}"

    def step(job_key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # first, last, count, processed of the open run (count 0: none), then the events not settled yet
        first, last, count, most, kept = state.get if state.exists else (0, 0, 0, 0, b"")
        parts = [np.frombuffer(bytes(kept), _EVENT)]
        for batch in batches:
            part = np.empty(len(batch), _EVENT)
            for name in _EVENT.names:
                part[name] = batch[name].to_numpy()
            parts.append(part)
        passed = max(state.getCurrentWatermarkMs(), 0) * 1000
        pending = np.concatenate(parts)
        pending = pending[np.lexsort((pending["tie"], pending["at"]))]
        settled, pending = np.split(pending, [np.searchsorted(pending["at"], passed)])
        done: list[tuple] = []

        def close(end: int) -> None:
            done.append((*job_key, first, last, count, most, names[end - 1] if end else None,
                         "finished" if end else "stalled"))

        if len(settled):
            begins = np.ones(len(settled), bool)
            begins[1:] = (np.diff(settled["at"]) > wait) | (settled["end"][:-1] > 0)
            begins[0] = count > 0 and settled["at"][0] - last > wait
            for piece in np.split(settled, np.flatnonzero(begins)):
                if not len(piece):
                    continue
                if count and (piece["at"][0] - last > wait):
                    close(0)
                    count = 0
                if not count:
                    first, most = int(piece["at"][0]), int(piece["processed"][0])
                last, count = int(piece["at"][-1]), count + len(piece)
                most = max(most, int(piece["processed"].max()))
                if piece["end"][-1]:
                    close(int(piece["end"][-1]))
                    count = 0
        if count and last + wait < passed:
            close(0)
            count = 0
        if count or len(pending):
            state.update((first, last, count, most, pending.tobytes()))
            due = min(([last + wait] if count else []) + ([int(pending["at"][0])] if len(pending) else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if done:
            out = pd.DataFrame(done, columns=["job_id", "started", "updated", "event_count", "processed", "ended_by",
                                              "status"])
            for name in ("started", "updated"):
                out[name] = pd.to_datetime(out[name], unit="us", utc=True)
            yield out

    return rows.groupBy("job_id").applyInPandasWithState(
        step, f"{key}, {_FIELDS}", "first long, last long, count long, most long, kept binary", "append",
        GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per key and session: those less than ``gap`` apart. Native, for tables and streams."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("session"), key).agg(
        F.count(F.lit(1)).alias("event_count")).select(
        key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "event_count")
