"""Product grid: search, filters, lookup, sorting, paging, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf.functions import text

SEARCHED = ["product_name", "model_number", "brand", "product_id", "description"]
SEARCHED_CONFLICTS = ["product_name", "model_number", "field"]
SORTABLE = ["row_idx", "quality_score", "price", "product_name", "ai_confidence",
            "completeness_score"]


def search(df: DataFrame, term: str | None, columns: list[str] = SEARCHED) -> DataFrame:
    """Rows with the term in any of the columns, whatever the case.

    ``%`` and ``_`` in the term act as wildcards.
    """
    if not term:
        return df
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns]))


def where_equal(df: DataFrame, **values: str | None) -> DataFrame:
    """Equality filters; None, "" and "All" mean no filter."""
    for column, value in values.items():
        if value and value != "All":
            df = df.where(F.col(column) == value)
    return df


def where_quality(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    if low is not None:
        df = df.where(F.col("quality_score") >= low)
    if high is not None:
        df = df.where(F.col("quality_score") <= high)
    return df


def where_enriched(df: DataFrame, enriched: bool = True) -> DataFrame:
    return df.where(F.col("ai_enriched") == enriched)


def find_product(products: DataFrame, key: str) -> DataFrame:
    """The product with this row number, else the first with this id or model number."""
    by_text = (F.col("product_id") == key) | (F.col("model_number") == key)
    by_row = F.col("row_idx") == int(key) if key.isdigit() else F.lit(False)
    return (
        products.where(by_row | by_text)
        .withColumn("_prio", F.when(by_row, 0).otherwise(1))
        .orderBy("_prio", "row_idx").limit(1).drop("_prio"))


def page(df: DataFrame, number: int = 1, size: int = 25, sort_by: str = "row_idx",
         descending: bool = False, tie: str = "row_idx") -> DataFrame:
    """One page in a total order. Spark keeps only the top rows per task."""
    column = F.col(sort_by)
    order = [column.desc() if descending else column.asc()]
    if tie != sort_by:
        order.append(F.col(tie).asc())
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 25) -> DataFrame:
    """Total rows and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "total_pages", F.ceil(F.col("total") / size).cast("bigint"))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    return df.where(F.coalesce(F.col(column), F.lit("")) != "").select(column).distinct().orderBy(
        column)


def grid(products: DataFrame, term: str | None = None, category: str | None = None,
         brand: str | None = None, status: str | None = None, min_quality: float | None = None,
         max_quality: float | None = None, sort_by: str = "row_idx", descending: bool = False,
         number: int = 1, size: int = 25) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(page, page info, facets): the product listing with all its parameters."""
    if sort_by not in SORTABLE:
        raise ValueError(f"cannot sort by {sort_by!r}")
    hits = search(products, term)
    hits = where_equal(hits, category=category, brand=brand, validation_status=status)
    hits = where_quality(hits, min_quality, max_quality)
    shown = page(hits, number, size, sort_by, descending)
    ratios = [c for c in shown.columns if c.endswith("_score") and c != "quality_score"]
    shown = shown.withColumns({c: text.percent(F.col(c)) for c in ratios})
    return shown, page_info(hits, size), {c: facet(products, c) for c in ("category", "brand")}


def conflict_list(conflicts: DataFrame, term: str | None = None, status: str | None = None,
                  severity: str | None = None, field: str | None = None, number: int = 1,
                  size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(page, page info) of conflicts."""
    hits = search(conflicts, term, SEARCHED_CONFLICTS)
    hits = where_equal(hits, status=status, severity=severity, field=field)
    ordered = hits.orderBy("row_idx", "field").offset((number - 1) * size).limit(size)
    return ordered, page_info(hits, size)


def issue_list(issues: DataFrame, severity: str | None = None, field: str | None = None,
               number: int = 1, size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(page, page info) of validation issues, in row order."""
    hits = where_equal(issues, severity=severity, field=field)
    ordered = hits.orderBy("row_idx", "field", "issue_type").offset(
        (number - 1) * size).limit(size)
    return ordered, page_info(hits, size)
