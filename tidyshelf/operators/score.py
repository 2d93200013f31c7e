"""Quality scores per row and for the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text

BANDS = [("excellent", 85.0), ("good", 70.0), ("fair", 50.0), ("poor", None)]
SCORES = ["quality_score", "completeness_score", "validity_score", "consistency_score",
          "source_agreement_score"]


def completeness() -> Column:
    """Share of the core fields that are filled; a price of 0 counts as empty."""
    filled = ", ".join("coalesce(price, 0) <> 0" if f == "price" else f"{f} <> ''"
                       for f in fv.CORE_FIELDS)
    return F.expr(f"round(size(filter(array({filled}), f -> f)) / {len(fv.CORE_FIELDS)}D, 3)")


def validity() -> Column:
    penalty = " ".join(f"WHEN '{s}' THEN {p}D" for s, p in fv.SEVERITY_PENALTY.items())
    return F.expr(f"greatest(0D, round(1 - aggregate(issues, 0D, (a, i) -> a + "
                  f"CASE i.severity {penalty} ELSE 0D END), 3))")


def consistency() -> Column:
    """Upper-case units expected, as the normalised form writes them."""
    return F.expr("""round(1 - 0.2D * size(filter(array(
        power <> '' AND NOT contains(power, 'W') AND NOT contains(power, 'kVA'),
        voltage <> '' AND NOT contains(voltage, 'V'), brand = ''), f -> f)), 3)""")


def score(validated: DataFrame, conflict_rows: DataFrame | None = None) -> DataFrame:
    """Adds the four dimension scores and the composite.

    ``conflict_rows`` holds the distinct ``row_idx`` that take part in a
    conflict; a left join marks them.
    """
    if conflict_rows is None:
        marked = validated.withColumn("_hit", F.lit(False))
    else:
        marked = validated.join(
            conflict_rows.select("row_idx", F.lit(True).alias("_hit")), "row_idx", "left")
    rated = marked.select(
        "*",
        completeness().alias("completeness_score"),
        validity().alias("validity_score"),
        consistency().alias("consistency_score"),
        F.when(F.coalesce("_hit", F.lit(False)), F.lit(fv.AGREEMENT_IN_CONFLICT))
        .otherwise(F.lit(1.0)).alias("source_agreement_score"),
    ).drop("_hit")
    # The dimensions have three decimals and the weights two, so the weighted sum
    # is exact in units of 1/1000 percent; rounding it there avoids stray last digits.
    w = fv.SCORE_WEIGHTS
    milli = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    total = (
        milli("completeness_score") * round(w["completeness"] * 100)
        + milli("validity_score") * round(w["validity"] * 100)
        + milli("consistency_score") * round(w["consistency"] * 100)
        + milli("source_agreement_score") * round(w["agreement"] * 100)
    )
    return rated.withColumn("quality_score", F.floor((total + 50) / 100) / 10)


def mean_scores() -> list[Column]:
    """The five catalogue averages as aggregate expressions; dimensions in percent."""
    out = [F.round(F.avg("quality_score"), 1).alias("quality_score")]
    for s in SCORES[1:]:
        out.append(F.round(F.avg(s) * 100, 1).alias(s))
    return out


def band_tests(value: Column, bands=None) -> dict[str, Column]:
    """Band -> whether the value lies in it, for bands of falling lower bounds."""
    out, upper = {}, None
    for name, lower in bands or BANDS:
        inside = F.lit(True) if lower is None else value >= lower
        if upper is not None:
            inside = inside & (value < upper)
        out[name] = inside & value.isNotNull()
        upper = lower
    return out


def band_counts(column: str, bands=None) -> list[Column]:
    """Histogram as one ``count_if`` per band."""
    return [F.count_if(test).alias(name)
            for name, test in band_tests(F.col(column), bands).items()]


def catalog_quality(scored: DataFrame) -> DataFrame:
    """Averages and quality histogram of the whole catalogue in one aggregate."""
    return scored.agg(*mean_scores(), *band_counts("quality_score"))


def trust_score() -> Column:
    """Quality, completeness, validity and agreement blended, in percent."""
    return F.round(
        F.col("quality_score") * 0.4
        + text.percent(F.col("completeness_score")) * 0.2
        + text.percent(F.col("validity_score")) * 0.2
        + text.percent(F.col("source_agreement_score")) * 0.2, 1)
