"""Rule-based validation: the twelve rules, row status and issue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text, units

def _rule(broken: str, field: str, kind: str, severity: str, message: str,
          raw: str = "cast(NULL AS string)") -> str:
    q = text.quote
    return (f"CASE WHEN {broken} THEN named_struct('field', {q(field)}, 'issue_type', {q(kind)}, "
            f"'severity', {q(severity)}, 'message', {message}, 'raw_value', {raw}) END")


def issue_rules() -> list[str]:
    """SQL text of one nullable issue per rule, in report order; ``_price_text`` is the
    price as text."""
    q = text.quote
    noted = lambda message, value: f"concat({q(message)}, {value})"
    url, ip = q(fv.URL_PATTERN), q(fv.IP_PATTERN)
    return [
        _rule("product_id = ''", "product_id", "missing_value", "high", q(fv.MSG_ID)),
        _rule("length(product_name) < 3", "product_name", "missing_value", "high",
              q(fv.MSG_NAME), "product_name"),
        _rule("category = ''", "category", "missing_value", "high", q(fv.MSG_CATEGORY)),
        _rule("brand = ''", "brand", "missing_value", "medium", q(fv.MSG_BRAND)),
        _rule("price IS NULL", "price", "missing_value", "low", q(fv.MSG_NO_PRICE),
              "coalesce(try_element_at(raw_data, 'price'), '')"),
        _rule("price < 0", "price", "out_of_range", "high",
              noted(fv.MSG_NEGATIVE, "_price_text"), "_price_text"),
        _rule(f"power <> '' AND NOT lower(power) RLIKE {q(fv.POWER_UNITS_PATTERN)}", "power",
              "unit_mismatch", "medium", noted(fv.MSG_POWER, "power"), "power"),
        _rule("voltage <> '' AND NOT contains(lower(voltage), 'v')", "voltage",
              "invalid_format", "low", noted(fv.MSG_VOLTAGE, "voltage"), "voltage"),
        _rule(f"ip_rating <> '' AND NOT ip_rating RLIKE {ip} AND NOT startswith(ip_rating, 'EX')",
              "ip_rating", "invalid_format", "low", noted(fv.MSG_IP, "ip_rating"), "ip_rating"),
        _rule(f"product_url <> '' AND NOT product_url RLIKE {url}", "product_url", "invalid_url",
              "low", noted(fv.MSG_URL, "product_url"), "product_url"),
        _rule(f"technical_document <> '' AND NOT technical_document RLIKE {url}",
              "technical_document", "invalid_url", "low",
              noted(fv.MSG_DOC, "technical_document"), "technical_document"),
        _rule("length(description) < 20", "description", "missing_value", "low",
              q(fv.MSG_DESCRIPTION), "description"),
    ]


def validate(products: DataFrame) -> DataFrame:
    """Adds ``issues`` (array) and ``validation_status``; one pass, no shuffle."""
    rules = ", ".join(issue_rules())
    return products.withColumn("_price_text", units.float_text(F.col("price"))).withColumn(
        "issues", F.expr(f"array_compact(array({rules}))")).drop("_price_text").withColumn(
        "validation_status", F.expr("""
            CASE WHEN exists(issues, i -> i.severity = 'high') THEN 'invalid'
                 WHEN exists(issues, i -> i.severity = 'medium') THEN 'warning'
                 ELSE 'valid' END"""))


def issue_rows(validated: DataFrame) -> DataFrame:
    """One row per issue.

    The outer form with a test afterwards: for the plain one Spark would push a
    second evaluation of all rules below the projection as a filter.
    """
    return validated.select("row_idx", "product_id", F.inline_outer("issues")).where(
        "field is not null")
