"""Profile of all columns from all their values, in bounded space.

``column_counts`` is one pass: per column how many values there are and how many pass each test, as sums in one wide
row per task. ``first_distinct`` finds the first values by row; each task passes on at most ``k`` of a column, so
columns x k x tasks rows are shuffled, however many values differ. A telling value counts wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text
from tidyshelf.operators import mapping
from tidyshelf.operators.normalize import quoted

#: Rows in which most columns have shown ``k`` values; only columns that have not are read further.
PREFIX = 4096

#: Test -> whether a value passes.
TESTS = {
    "address": mapping._is_address,
    "number_with_unit": lambda v: v.rlike(mapping.NUMBER_WITH_UNIT),
    "currency": lambda v: v.rlike("[$€£]"),
    "link": lambda v: v.startswith("http://") | v.startswith("https://"),
    "pdf": lambda v: v.contains(".pdf"),
    "short": lambda v: F.length(v) < 30,
    "numeric": lambda v: v.rlike(mapping.NUMBER),
    "voltage": lambda v: v.rlike(mapping.VOLTAGE),
    "power": lambda v: v.rlike(mapping.POWER_HEADER),
    "power_unit": lambda v: v.rlike(mapping.POWER_CHECK),
    "weight": lambda v: v.rlike(mapping.WEIGHT_HEADER),
    "weight_unit": lambda v: v.rlike(mapping.WEIGHT_CHECK),
    "ip_code": lambda v: v.rlike(mapping.IP_CODE),
}


def _values(df: DataFrame, row_idx: str, columns: list[str]) -> DataFrame:
    """(row, c0, c1, ...): trimmed values, NULL where there is none."""
    def value(c: str) -> Column:
        v = text.strip(F.coalesce(quoted(c).cast("string"), F.lit("")))
        return F.when((v != "") & ~F.lower(v).isin(fv.BLANK_WORDS), v)

    return df.select(quoted(row_idx).cast("bigint").alias("row"), *[
        value(c).alias(f"c{i}") for i, c in enumerate(columns)])


def column_counts(df: DataFrame, row_idx: str = "row_idx", columns: list[str] | None = None) -> DataFrame:
    """One row per column: position, column, n_values, distinct_values (a sketch's estimate), and a count per test."""
    columns = columns or [c for c in df.columns if c != row_idx]
    wide = _values(df, row_idx, columns).agg(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.count(f"c{i}").alias("n_values"),
                 F.approx_count_distinct(f"c{i}").alias("distinct_values"),
                 *[F.count_if(test(F.col(f"c{i}"))).alias(name) for name, test in TESTS.items()]).alias(f"s{i}")
        for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def first_distinct(df: DataFrame, row_idx: str = "row_idx", columns: list[str] | None = None, k: int = 15,
                   prefix: int = PREFIX) -> DataFrame:
    """(position, value, first_row, rank) of the first ``k`` different values of each column, by row."""
    columns = columns or [c for c in df.columns if c != row_idx]
    early = mapping.distinct_values(df.where(quoted(row_idx) < prefix), row_idx, None, columns)
    early = mapping.first_values(early, k).select("position", "value", "first_row")
    done = {r["position"] for r in early.groupBy("position").count().where(F.col("count") >= k).collect()}
    left = [i for i in range(len(columns)) if i not in done]
    if left:
        late = _values(df, row_idx, columns).select("row", *[f"c{i}" for i in left]).mapInPandas(
            lambda batches: _first_of_task(batches, left, k), "position int, value string, first_row bigint")
        merged = late.groupBy("position", "value").agg(F.min("first_row").alias("first_row"))
        early = early.where(~F.col("position").isin(left)).unionByName(merged)
    return mapping.first_values(early, k).select("position", "value", "first_row", "rank")


def _first_of_task(batches: Iterable[pd.DataFrame], positions: list[int], k: int) -> Iterator[pd.DataFrame]:
    """The first ``k`` values of each column among a task's rows; never more than ``k`` are held."""
    kept: dict[int, pd.DataFrame] = {}
    for batch in batches:
        for i in positions:
            have = kept.get(i)
            new = pd.DataFrame({"value": batch[f"c{i}"], "first_row": batch["row"]}).dropna()
            if have is not None and len(have) == k:
                new = new[new["first_row"] < have["first_row"].iloc[-1]]
            if len(new):
                both = new if have is None else pd.concat([have, new])
                kept[i] = both.sort_values(["first_row", "value"]).drop_duplicates("value").head(k)
    for i, rows in kept.items():
        yield rows.assign(position=i)[["position", "value", "first_row"]]


class Counts:
    """What the rules ask of a column, answered by its counts over all values."""

    def __init__(self, samples: Column):
        self.samples = samples
        self.some = F.col("n_values") > 0
        self.all_short = F.col("short") == F.col("n_values")
        self.all_numeric = F.col("numeric") == F.col("n_values")
        self.currency, self.link, self.pdf = (F.col(c) > 0 for c in ("currency", "link", "pdf"))

    def any(self, pattern: str) -> Column:
        name = {mapping.VOLTAGE: "voltage", mapping.POWER_HEADER: "power", mapping.POWER_CHECK: "power_unit",
                mapping.WEIGHT_HEADER: "weight", mapping.WEIGHT_CHECK: "weight_unit",
                mapping.IP_CODE: "ip_code"}[pattern]
        return F.col(name) > 0


def whole_profile(df: DataFrame, row_idx: str = "row_idx", columns: list[str] | None = None,
                  sample_size: int = 15) -> DataFrame:
    """``column_counts`` with the first values (``samples``) and the type that the shares of all values give."""
    columns = columns or [c for c in df.columns if c != row_idx]
    samples = first_distinct(df, row_idx, columns, sample_size).groupBy("position").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples"))
    share = lambda name: F.col(name) / F.greatest(F.col("n_values"), F.lit(1))
    kind = (F.when(share("address") >= 0.5, F.lit("url"))
            .when(share("number_with_unit") >= 0.8, F.lit("number")).otherwise(F.lit("string")))
    return column_counts(df, row_idx, columns).join(samples, "position", "left").withColumns({
        "samples": F.coalesce("samples", F.array().cast("array<string>")), "inferred_type": kind})
