"""The all-round view of single products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text
from tidyshelf.operators import conflicts as conflict_ops
from tidyshelf.operators import score


def with_defaults(products: DataFrame) -> DataFrame:
    """Display defaults where a field is blank."""
    shown = {c: text.first_filled(F.col(c), F.lit(d)) for c, d in fv.DETAIL_DEFAULTS.items()
             if c in products.columns}
    if "manufacturer" in products.columns:
        shown["manufacturer"] = text.first_filled(
            F.col("manufacturer"), F.col("brand"), F.lit("OEM"))
    return products.select(*[shown.get(c, F.col(c)).alias(c) for c in products.columns])


def enrichment_view(products: DataFrame, enrichment: DataFrame, stored: str | None = None) -> DataFrame:
    """Enrichment per product: its result if there is one, else its stored payload, else built from the fields.

    ``stored`` names a map column; an empty map or NULL is no payload, and what the payload lacks comes
    from the fields. Its confidence is a share or a percentage.
    """
    c = F.col
    built = F.struct(
        text.first_filled(c("category"), F.lit("Industrial Equipment")).alias("category"),
        text.first_filled(c("subcategory"), F.lit("General")).alias("subcategory"),
        text.first_filled(c("brand"), F.lit("Standard")).alias("brand"),
        F.create_map(*[x for label, f in (("Power", "power"), ("Voltage", "voltage"),
                                          ("IP_Rating", "ip_rating"))
                       for x in (F.lit(label), text.first_filled(c(f), F.lit("Standard")))])
        .alias("attributes"),
        F.array().cast("array<string>").alias("missing_attributes"),
        text.first_filled(c("description"), F.concat(
            F.lit("Commercial specification for "), c("product_name"))).alias("description"),
        F.array(text.first_filled(c("category"), F.lit("Industrial")),
                text.first_filled(c("brand"), F.lit("OEM")),
                text.first_filled(c("model_number"), F.lit("Equipment"))).alias("keywords"),
        F.lit(None).cast("double").alias("confidence"))
    given = enrichment.select("row_idx", F.struct(
        "category", "subcategory", "brand", "attributes", "missing_attributes",
        c("normalized_description").alias("description"), c("commerce_keywords").alias("keywords"),
        text.percent(c("confidence_score")).alias("confidence")).alias("given"))
    payload = F.lit(None)
    if stored is not None:
        of = lambda k: F.try_element_at(stored, F.lit(k))
        sure = of("confidence_score").try_cast("double")
        payload = F.when(F.size(stored) > 0, F.struct(
            text.first_filled(of("category"), c("category"), F.lit("Industrial Equipment")).alias("category"),
            text.first_filled(of("subcategory"), c("subcategory"), F.lit("General")).alias("subcategory"),
            text.first_filled(of("brand"), c("brand"), F.lit("Standard")).alias("brand"),
            F.coalesce(F.from_json(of("attributes"), "map<string, string>"),
                       F.create_map().cast("map<string, string>")).alias("attributes"),
            F.coalesce(F.from_json(of("missing_attributes"), "array<string>"),
                       F.array().cast("array<string>")).alias("missing_attributes"),
            text.first_filled(of("normalized_description"), c("description"), F.lit("")).alias("description"),
            F.coalesce(F.from_json(of("commerce_keywords"), "array<string>"),
                       F.array().cast("array<string>")).alias("keywords"),
            F.when(sure <= 1, text.percent(sure)).otherwise(F.round(sure, 1)).alias("confidence")))
    return products.withColumn("built", built).withColumn("kept", payload).join(given, "row_idx", "left").select(
        "row_idx", F.coalesce("given", "kept", "built").alias("ai_intelligence"))


def group_membership(items: DataFrame, groups: DataFrame) -> DataFrame:
    """Group of each member with the group's size, counted once per group."""
    return items.select("row_idx", "centre").join(
        groups.select(F.col("canonical_row_idx").alias("centre"), "group_code", "canonical_name",
                      "status", F.col("members").alias("total_duplicates_in_group"),
                      text.percent(F.col("similarity")).alias("similarity_score")), "centre"
    ).drop("centre")


def product_detail(chosen: DataFrame, issues: DataFrame, enrichment: DataFrame,
                   items: DataFrame, groups: DataFrame, conflicts: DataFrame,
                   attributes: DataFrame) -> DataFrame:
    """Everything known about the chosen products, one row each.

    ``chosen`` is a looked-up handful (see ``grid.find_product``); each table is
    first cut down to it, so lists stay as short as those products need. Conflicts
    match by row or by model number through two equality joins.
    """
    ids = chosen.select("row_idx")
    per_row = lambda df, item, name: (
        df.join(ids, "row_idx", "left_semi").groupBy("row_idx")
        .agg(F.sort_array(F.collect_list(item)).alias(name)))
    issue_list = per_row(issues, F.struct("field", "issue_type", "severity", "message",
                                          "raw_value"), "validation_issues")
    by_row = conflicts.join(ids, "row_idx", "left_semi").withColumn("_owner", F.col("row_idx"))
    by_model = conflicts.join(
        chosen.select(F.col("row_idx").alias("_owner"), "model_number"), "model_number")
    matched = by_row.unionByName(by_model).dropDuplicates(["_owner", "row_idx", "field"])
    shown = conflict_ops.display(matched)
    conflict_list = shown.groupBy("_owner").agg(F.sort_array(F.collect_list(F.struct(
        "row_idx", "field", "source_a", "value_a", "source_b", "value_b", "severity",
        "explanation", "status"))).alias("conflicts")).withColumnRenamed("_owner", "row_idx")
    attribute_map = attributes.join(ids, "row_idx", "left_semi").groupBy("row_idx").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("attribute_name", "normalized_value")))).alias("attributes"))
    membership = group_membership(items.join(ids, "row_idx", "left_semi"), groups).select(
        "row_idx", F.struct("group_code", "canonical_name", "status", "similarity_score",
                            "total_duplicates_in_group").alias("duplicate_membership"))
    ai = enrichment_view(chosen, enrichment)
    base = with_defaults(chosen.drop("additional_attributes", "issues")).withColumn(
        "trust_score", score.trust_score())
    for part in (issue_list, conflict_list, attribute_map, membership, ai):
        base = base.join(part, "row_idx", "left")
    return base
