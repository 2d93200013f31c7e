"""Joins to tables of few rows a key, where single keys may hold a large share of the rows.

A frequency sketch of the many-rowed side, mergeable and of fixed size, names the keys that hold a
good part of a task's share, with their counts. It is a scalar subquery: one narrow pass over the key columns,
whose result, a map of at most ``KEYS`` entries, both sides look salts up in. Rows of a heavy key get one
of its salts, its rows on the other side are repeated once a salt, all other rows keep salt 0. So the join
stays one shuffle join without a broadcast, and no row is dropped or sampled: an estimate that is off
changes the balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = 1000     # keys split at most; one below a thousandth of the rows is left whole
PART = 4        # a key is heavy from this part of a task's share on: unsplit keys may share a task
PIECES = 32     # salts for a task's share of rows, so that their places even out
_SAFE = ("inner", "left", "left_semi", "left_anti")


def salts(rows: DataFrame, on: list[str], tasks: int | None = None) -> Column:
    """Subquery: key hash -> number of salts, of the keys heavy for so many ``tasks``."""
    if tasks is None:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(2, min(tasks, KEYS // PART))
    most = tasks * PART
    top = f"approx_top_k(_h, {most}, {8 * most})"
    return rows.select(F.xxhash64(*on).alias("_h")).agg(F.expr(f"""
        map_from_entries(transform(
            filter({top}, t -> t.count * {most} > count(*)),
            t -> struct(t.item, cast(ceil(t.count * {tasks * PIECES}D / count(*)) AS int))))""")
        .alias("salts")).scalar()


def join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner",
         counted: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` with the rows of heavy keys of ``left`` dealt out by the columns ``spread``.

    ``right`` should have few rows a key: those of heavy keys are repeated, in sum at most
    ``tasks * PIECES`` times their number a key. ``counted`` is a cheaper frame with the keys of ``left``
    in about the same shares, if there is one. NULL keys match nothing and are dealt out as well. Keys must have one type on
    both sides, as their hashes must agree, and be no floating point numbers.
    """
    if how not in _SAFE:
        raise ValueError(f"how must be one of {_SAFE}, not {how!r}")
    a, b = dict(left.dtypes), dict(right.dtypes)
    for k in on:
        if a[k] != b[k] or a[k] in ("float", "double"):
            raise ValueError(f"key {k}: {a[k]} and {b[k]}; cast both to one type that is exact")
    heavy = salts(left if counted is None else counted, on, tasks)
    number = lambda: F.coalesce(F.try_element_at(heavy, F.xxhash64(*on)), F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), number()).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), number() - 1)))
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")
