"""Column-level analysis: which canonical field is each column of a catalogue?"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text
from tidyshelf.operators.normalize import quoted

# Patterns that decide types and units of sample values.
NUMBER_WITH_UNIT = r"^[-+]?[0-9.,]+(?:\s*[a-zA-Z%]+)?$"
NUMBER = r"^[-+]?[0-9.]+$"
VOLTAGE = r"(?i)^[0-9]+[0-9.\-]*\s*(?:v|vac|vdc|kv)\b"
POWER_HEADER = r"(?i)^[0-9]+[0-9.]*\s*(?:kw|hp|kva|mw|watts?|w)\b"
POWER_CHECK = r"(?i)^[0-9]+[0-9.]*\s*(?:kw|hp|kva|mw|w)\b"
WEIGHT_HEADER = r"(?i)^[0-9]+[0-9.]*\s*(?:kg|lbs|pounds|grams?|g)\b"
WEIGHT_CHECK = r"(?i)^[0-9]+[0-9.]*\s*(?:kg|lbs|g)\b"
IP_CODE = r"(?i)^ip[0-9]{2}[a-z]?$"

TEXT_FIELDS = ["product_description", "product_name"]
NOT_NUMERIC = ["brand", "manufacturer", "product_name", "product_description"]
NOT_NUMERIC_CHECK = NOT_NUMERIC + ["supplier", "country"]


# -- profiles ------------------------------------------------------------------------

def distinct_values(df: DataFrame, row_idx: str = "row_idx", sample_rows: int | None = 20,
                    columns: list[str] | None = None) -> DataFrame:
    """(position, column, value, first_row) of non-placeholder values.

    The table is turned to long form and reduced to distinct values before the
    shuffle, so repeats never travel.
    """
    columns = columns or [c for c in df.columns if c != row_idx]
    scope = df if sample_rows is None else df.where(F.col(row_idx) < sample_rows)
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 text.strip(F.coalesce(quoted(c).cast("string"), F.lit(""))).alias("value"))
        for i, c in enumerate(columns)])
    long = scope.select(F.col(row_idx).cast("bigint").alias("first_row"), F.inline(cells))
    kept = long.where((F.col("value") != "") & ~F.lower("value").isin(fv.BLANK_WORDS))
    return kept.groupBy("position", "column", "value").agg(F.min("first_row").alias("first_row"))


def first_values(values: DataFrame, sample_size: int = 15) -> DataFrame:
    """First ``sample_size`` distinct values per column, in order of appearance.

    Spark cuts each task's share to the sample size before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("position").orderBy("first_row", "value"))
    return values.withColumn("rank", rank).where(F.col("rank") <= sample_size)


def profile(df: DataFrame, row_idx: str = "row_idx", sample_size: int = 15,
            sample_rows: int | None = 20, columns: list[str] | None = None) -> DataFrame:
    """One row per column: samples in order of appearance and inferred type."""
    columns = columns or [c for c in df.columns if c != row_idx]
    sampled = first_values(distinct_values(df, row_idx, sample_rows, columns), sample_size)
    found = sampled.groupBy("position").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))),
                    lambda s: s["value"]).alias("samples"))
    headers = df.sparkSession.createDataFrame(
        [(i, c) for i, c in enumerate(columns)], "position int, column string")
    out = headers.join(found, "position", "left").select(
        "position", "column",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
    return out.select("*", inferred_type(F.col("samples")).alias("inferred_type"),
                      F.size("samples").alias("sample_count"))


def _share(samples: Column, test) -> Column:
    return F.size(F.filter(samples, test)) / F.greatest(F.size(samples), F.lit(1))


def _is_address(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://") | s.contains("www.")


def inferred_type(samples: Column) -> Column:
    return (
        F.when(_share(samples, _is_address) >= 0.5, F.lit("url"))
        .when(_share(samples, lambda s: s.rlike(NUMBER_WITH_UNIT)) >= 0.8, F.lit("number"))
        .otherwise(F.lit("string")))


# -- header and sample heuristics -------------------------------------------------------

def normal_header(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\-\s]+", "_")


def _alias_table() -> Column:
    """(ord, field, alias, is_key) in match order as one constant array."""
    rows, ord_ = [], 0
    for field, (_, _, aliases) in fv.CANONICAL_FIELDS.items():
        for i, alias in enumerate([field, *aliases]):
            rows.append({"ord": ord_, "field": field, "alias": alias, "is_key": i == 0})
            ord_ += 1
    schema = "array<struct<ord:int,field:string,alias:string,is_key:boolean>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _guess(field, confidence, evidence) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(field).alias("field"), lit(confidence).cast("double").alias("confidence"),
                    lit(evidence).alias("evidence"))


def header_match(header: Column) -> Column:
    """Struct(field, confidence, evidence, exact) from the header alone.

    An exact hit anywhere beats every partial one; among equals the earlier
    entry of the table wins. A field key counts only when it is hit exactly.
    """
    table = _alias_table()
    exact = F.get(F.filter(table, lambda a: a["alias"] == header), F.lit(0))
    partial = F.filter(table, lambda a: ~a["is_key"] & header.contains(a["alias"]))
    long_ = F.get(F.filter(partial, lambda a: F.length(a["alias"]) >= 4), F.lit(0))
    short = F.get(partial, F.lit(0))
    contains = lambda a: F.concat(F.lit("Header contains keyword alias '"), a, F.lit("'"))
    key = F.get(F.filter(table, lambda a: a["is_key"] & (a["alias"] == header)), F.lit(0))
    return (
        F.when(exact["is_key"], _guess(exact["field"], 0.99, F.concat(
            F.lit("Header exactly matches standard canonical field '"), key["field"], F.lit("'"))))
        .when(exact.isNotNull(), _guess(exact["field"], 0.98, F.concat(
            F.lit("Header matches standard alias for '"), exact["field"], F.lit("'"))))
        .when(long_.isNotNull(), _guess(long_["field"], 0.88, contains(long_["alias"])))
        .when(short.isNotNull(), _guess(short["field"], 0.78, contains(short["alias"])))
        .otherwise(_guess(fv.LEFTOVERS, 0.50, "General catalog attribute")))


def _any(samples: Column, pattern: str) -> Column:
    return F.exists(samples, lambda s: s.rlike(pattern))


def _head(samples: Column) -> Column:
    return F.slice(samples, 1, 5)


def _all_short(samples: Column) -> Column:
    return F.forall(_head(samples), lambda s: F.length(s) < 30)


def _all_numeric(samples: Column) -> Column:
    return F.forall(_head(samples), lambda s: s.rlike(NUMBER))


class Samples:
    """What the rules ask of a column, answered by some of its values."""

    def __init__(self, samples: Column):
        self.samples = samples
        self.some = F.size(samples) > 0
        self.all_short, self.all_numeric = _all_short(samples), _all_numeric(samples)
        self.currency = _any(samples, "[$€£]")
        self.link = F.exists(samples, lambda s: s.startswith("http://") | s.startswith("https://"))
        self.pdf = F.exists(samples, lambda s: s.contains(".pdf"))

    def any(self, pattern: str) -> Column:
        return _any(self.samples, pattern)


def sample_override(header: Column, match: Column, seen) -> Column:
    """Guess after looking at the values; exact header hits are final. ``seen`` is an array of samples, or
    ``Samples`` or ``profile.Counts``."""
    seen = Samples(seen) if isinstance(seen, Column) else seen
    samples = seen.samples
    field, confidence = match["field"], match["confidence"]
    exact = confidence >= 0.98
    settled = field.isin(TEXT_FIELDS) & (confidence >= 0.85)
    look = seen.some & ~settled
    short = look & seen.all_short
    document = header.rlike("doc|pdf|spec") | seen.pdf
    link = seen.link
    return (
        F.when(exact, match)
        .when(look & seen.currency, _guess(
            "price", 0.95, "Sample values contain currency symbols and numeric values"))
        .when(look & link & document, _guess(
            "technical_document", 0.96, "Sample values are PDF / technical documentation URLs"))
        .when(look & link, _guess("product_url", 0.95, "Sample values are web product URLs"))
        .when(short & seen.any(VOLTAGE), _guess(
            "voltage", 0.96, "Sample values contain standardized voltage units (V/VAC/VDC)"))
        .when(short & seen.any(POWER_HEADER), _guess(
            "power", 0.96, "Sample values contain standardized power units (kW/HP/W/kVA)"))
        .when(short & seen.any(WEIGHT_HEADER), _guess(
            "weight", 0.96, "Sample values contain standardized weight/mass units (kg/lbs)"))
        .when(short & seen.any(IP_CODE), _guess(
            "ip_rating", 0.97, "Sample values contain standardized Ingress Protection (IP) ratings"))
        .when(look & seen.all_numeric & field.isin(NOT_NUMERIC), _guess(
            fv.LEFTOVERS, 0.60, F.concat(F.lit("Sample values are numeric ("),
                                         F.get(samples, F.lit(0)),
                                         F.lit("), contradicting text field interpretation"))))
        .when(confidence < 0.70, _guess(
            fv.LEFTOVERS, 0.65,
            "Extensible product parameter preserved in additional attributes"))
        .otherwise(match))


def cross_check(guess: Column, seen) -> Column:
    """Last check of a guess (from any origin) against the values."""
    seen = Samples(seen) if isinstance(seen, Column) else seen
    field, samples, some = guess["field"], seen.samples, seen.some
    text_field = field.isin(TEXT_FIELDS)
    short = some & ~text_field & seen.all_short
    shown = F.concat_ws(", ", F.slice(samples, 1, 3))
    clamped = _guess(field, F.least(F.lit(1.0), F.greatest(F.lit(0.0), guess["confidence"])),
                     guess["evidence"])
    return (
        F.when(~some, guess)
        .when(seen.all_numeric & field.isin(NOT_NUMERIC_CHECK), _guess(
            fv.LEFTOVERS, 0.65, F.concat(
                F.lit("AI suggested '"), field,
                F.lit("' but sample values are purely numeric ("), shown,
                F.lit("). Classified as additional attribute."))))
        .when(text_field, guess)
        .when(short & seen.any(VOLTAGE) & (field != "voltage"), _guess(
            "voltage", 0.95,
            "Sample values exhibit voltage electrical specifications (V/VAC/VDC)."))
        .when(short & seen.any(POWER_CHECK) & (field != "power"), _guess(
            "power", 0.95, "Sample values exhibit power specifications (kW/HP/W)."))
        .when(short & seen.any(WEIGHT_CHECK) & (field != "weight"), _guess(
            "weight", 0.95, "Sample values exhibit weight units (kg/lbs)."))
        .otherwise(clamped))


def alternatives(match: Column, override: Column, final: Column) -> Column:
    """Other fields to offer: the header's own guess if overruled, else the leftovers."""
    overruled = (override["field"] == "price") & (match["field"] != "price") & (
        override["evidence"].startswith("Sample values contain currency"))
    numeric = override["evidence"].startswith("Sample values are numeric (")
    offer = F.when(overruled, F.struct(match["field"].alias("canonical_field"),
                                       F.round(match["confidence"], 2).alias("confidence"))
                   ).when(numeric, F.struct(match["field"].alias("canonical_field"),
                                            F.lit(0.40).alias("confidence")))
    kept = F.filter(F.array_compact(F.array(offer)),
                    lambda a: a["canonical_field"] != final["field"])
    spare = F.array(F.struct(F.lit(fv.LEFTOVERS).alias("canonical_field"),
                             F.lit(0.50).alias("confidence")))
    return F.when((F.size(kept) == 0) & (final["field"] != fv.LEFTOVERS), spare).otherwise(kept)


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, F.lit("high")).when(
        confidence >= 0.75, F.lit("medium")).otherwise(F.lit("low"))


def analyze(df: DataFrame, row_idx: str = "row_idx", sample_rows: int | None = 20,
            columns: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Mapping report: one row per column of the catalogue.

    With ``whole`` types, units and the like are judged on all values of all rows, else on the first 15 of
    ``sample_rows`` rows.
    """
    labels = F.create_map(*[F.lit(x) for k, v in fv.CANONICAL_FIELDS.items() for x in (k, v[0])])
    if whole:
        from tidyshelf.operators import profile as profiles
        base, seen = profiles.whole_profile(df, row_idx, columns), profiles.Counts(F.col("samples"))
    else:
        base, seen = profile(df, row_idx, 15, sample_rows, columns), Samples(F.col("samples"))
    base = base.withColumn("header", normal_header(F.col("column")))
    matched = base.withColumn("match", header_match(F.col("header")))
    guessed = matched.withColumn("guess", sample_override(
        F.col("header"), F.col("match"), seen))
    final = guessed.withColumn("final", cross_check(F.col("guess"), seen))
    return final.select(
        "position", F.col("column").alias("original_column"),
        F.col("final.field").alias("canonical_field"),
        F.try_element_at(labels, F.col("final.field")).alias("canonical_label"),
        F.try_element_at(labels, F.col("guess.field")).alias("semantic_meaning"),
        F.col("inferred_type").alias("data_type"),
        F.round("final.confidence", 2).alias("confidence"),
        tier(F.col("final.confidence")).alias("confidence_level"),
        F.col("final.evidence").alias("evidence"), F.slice("samples", 1, 6).alias("sample_values"),
        alternatives(F.col("match"), F.col("guess"), F.col("final")).alias("alternatives"))


def summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("confidence_level").isin("high", "medium")).alias("recognized_count"),
        F.count_if(F.col("confidence_level") == "low").alias("review_required_count"))


def mapping_of(report: DataFrame) -> dict[str, str]:
    """Column -> field as a dict; as many entries as the catalogue has columns."""
    return {r["original_column"]: r["canonical_field"]
            for r in report.select("original_column", "canonical_field").toLocalIterator()}


def canonical_fields(spark) -> DataFrame:
    return spark.createDataFrame(
        [(k, v[0], v[1]) for k, v in fv.CANONICAL_FIELDS.items()],
        "key string, label string, type string")


def fingerprint(df: DataFrame, row_idx: str = "row_idx",
                columns: list[str] | None = None) -> DataFrame:
    """SHA-256 over the sorted headers and the first five rows (20 characters a cell)."""
    columns = columns or [c for c in df.columns if c != row_idx]
    ordered = sorted(columns, key=lambda c: c.strip().lower())
    cells = [F.left(text.strip(F.coalesce(quoted(c).cast("string"), F.lit(""))), F.lit(20))
             for c in ordered]
    head = df.where(F.col(row_idx) < 5).select(
        F.col(row_idx).alias("i"), F.concat_ws("|", *cells).alias("line"))
    lines = head.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))),
                                 lambda s: s["line"]).alias("lines"))
    names = "::".join(c.strip().lower() for c in ordered)
    return lines.select(F.sha2(F.concat(F.lit(names + "___"), F.array_join("lines", "###")), 256)
                        .alias("fingerprint"))


def whole_fingerprint(df: DataFrame, row_idx: str = "row_idx", columns: list[str] | None = None,
                      by: str | None = None) -> DataFrame:
    """(row_count, fingerprint) of all rows and whole cells, in any order of rows; per value of ``by``, such as the
    file a row is from, if given.

    Each row's digest is cut into four numbers, and the sums of these over all rows stand for the multiset
    of rows: a changed, added or repeated row changes them, another order does not, and sums of parts
    add up. One pass, one row per task and group is shuffled.
    """
    columns = columns or [c for c in df.columns if c not in (row_idx, by)]
    ordered = sorted(columns, key=lambda c: c.strip().lower())
    cells = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in ordered]
    # With its length before it, no cell can be taken for parts of two.
    line = F.concat(*[x for c in cells for x in (F.length(c).cast("string"), F.lit(":"), c)])
    hashed = df.select(*([quoted(by).alias(by)] if by else []), F.sha2(line, 256).alias("_digest"))
    parts = [F.sum(F.conv(F.substring("_digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"_{k}")
             for k in range(4)]
    sums = hashed.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("row_count"), *parts)
    names = "::".join(c.strip().lower() for c in ordered)
    return sums.select(*([by] if by else []), "row_count", F.sha2(F.concat_ws(
        ":", F.lit(names), "row_count", *[F.coalesce(F.col(f"_{k}"), F.lit(0)).cast("decimal(38,0)").cast("string")
                                          for k in range(4)]), 256).alias("fingerprint"))
