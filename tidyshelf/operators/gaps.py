"""Data gaps and reconciliation opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text, units

FEEDS = ["unilog_brand", "e1_brand", "dib_brand"]
TEXT_GAPS = ["manufacturer", "power", "voltage", "ip_rating", "dimensions", "weight"]
FIELDS = FEEDS + TEXT_GAPS + ["price"]


def is_gap(field: str, raw_columns: list[str]) -> Column:
    """True where the field carries no data."""
    if field in FEEDS:
        cells = [F.coalesce(F.try_element_at("raw_data", F.lit(c)), F.lit(""))
                 for c in raw_columns if field in c.lower()]
        filled = F.lit(False)
        for c in cells:
            filled = filled | text.is_source_value(c)
        return ~filled
    if field == "price":
        return F.col("price").isNull() | (F.col("price") <= 0)
    return ~text.is_source_value(F.col(field))


def data_gaps(products: DataFrame, raw_columns: list[str]) -> DataFrame:
    """Missing count and coverage per reported field, with the total of all ten counters.

    All counters come from one aggregate; the single row is then laid out as rows.
    """
    return gap_rows(products.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(is_gap(f, raw_columns)).alias(f"gap_{f}") for f in FIELDS]))


def gap_rows(counted: DataFrame) -> DataFrame:
    """The report of one row of counters: ``total`` and ``gap_<field>``."""
    every = F.lit(0)
    for f in FIELDS:
        every = every + F.col(f"gap_{f}")
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("field_name"),
                 F.col(f"gap_{f}").alias("missing_count"), F.lit(status).alias("status"))
        for i, (name, f, status) in enumerate(fv.GAP_ROWS)])
    coverage = (F.col("total") - F.col("missing_count")) / F.greatest("total", F.lit(1))
    return counted.select("total", every.alias("total_data_gaps"), F.inline(rows)).select(
        "position", "field_name", "missing_count", text.percent(coverage).alias("coverage_pct"),
        "status", F.col("total").alias("total_products"), "total_data_gaps")


def gap_samples(products: DataFrame, limit: int = 10) -> DataFrame:
    """First rows that lack power or brand, with the labels of what is missing."""
    missing = lambda f, label: F.when(~text.is_source_value(F.col(f)), F.lit(label))
    lacking = ~text.is_source_value(F.col("power")) | ~text.is_source_value(F.col("brand"))
    return products.where(lacking).orderBy("row_idx").limit(limit).select(
        "row_idx", "product_id", "product_name",
        F.array_compact(F.array(missing("brand", "Brand Feed"), missing("power", "Power Rating"),
                                missing("voltage", "Voltage Spec"))).alias("missing_fields"),
        text.first_filled(F.col("source"), F.lit("Supplier Ingestion")).alias("catalog_source"))


def inferred_brand(context: Column) -> Column:
    """Canonical brand of the first pattern found in the text, else null."""
    out = None
    for pattern, brand in fv.BRAND_PATTERNS:
        hit = context.rlike(f"(?i){pattern}")
        out = F.when(hit, F.lit(brand)) if out is None else out.when(hit, F.lit(brand))
    return out


def reconciliation(products: DataFrame, limit: int | None = None) -> DataFrame:
    """Brands and power ratings that can be read off name and description.

    A rating found in horsepower is converted to kilowatts.
    """
    part = text.strip(text.first_filled(
        F.try_element_at("raw_data", F.lit("Part_Desc")),
        F.try_element_at("raw_data", F.lit("part_desc"))))
    base = products.select(
        "row_idx", "product_id", "product_name", "brand", "power", part.alias("part"),
        F.concat_ws(" ", text.strip(F.col("product_name")), text.strip(F.col("description")), part)
        .alias("context"))
    shown = F.coalesce(F.nullif(F.left("part", F.lit(60)), F.lit("")),
                       F.left("product_name", F.lit(60)))
    rating = r"(?i)(\d+(?:\.\d+)?)\s*(?:kw|hp)"
    reading = F.regexp_extract("context", rating, 0)

    def offer(target: str, when: Column, evidence: Column, value: Column, confidence: int):
        return F.when(when, F.struct(
            F.lit(target).alias("target_field"), evidence.alias("evidence_source"),
            value.alias("inferred_value"), F.lit(confidence).alias("confidence_pct")))

    brand = inferred_brand(F.col("context"))
    offers = base.withColumn("_brand", F.when(~text.is_source_value(F.col("brand")), brand)
                             ).withColumn("_reading", F.when(
                                 ~text.is_source_value(F.col("power")), F.nullif(reading, F.lit(""))))
    listed = F.array_compact(F.array(
        offer("Brand / Manufacturer", F.col("_brand").isNotNull(),
              F.concat(F.lit('Inferred from Part Description: "'), shown, F.lit('..."')),
              F.col("_brand"), 96),
        offer("Power Rating", F.col("_reading").isNotNull(),
              F.concat(F.lit('Extracted from specification text: "'), F.col("_reading"),
                       F.lit('"')), units.power_text(F.col("_reading")), 94)))
    out = offers.select(
        F.concat(F.lit("OPP-"), _padded(F.col("row_idx") + 1)).alias("id"), "row_idx",
        "product_id", "product_name", F.inline_outer(listed)).where("target_field is not null").withColumn(
        "status", F.lit("Ready to Auto-Reconcile"))
    return out if limit is None else out.orderBy("row_idx", "target_field").limit(limit)


def _padded(number: Column) -> Column:
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), "0")
