"""Rule-based enrichment, reuse by key, coverage and best-value merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text
from tidyshelf.operators import heavy
from tidyshelf.session import beside

# Everything the enrichment depends on, so equal keys mean equal results.
INPUTS = ["brand", "model_number", "product_name", "power", "voltage", "category",
          "subcategory", "frequency", "rpm", "ip_rating", "weight", "dimensions", "material",
          "warranty", "technical_document"]
SHORT_KEY = ["brand", "model_number", "product_name", "power", "voltage"]


def enrichment_key(fields: list[str] = INPUTS) -> Column:
    return F.sha2(F.concat_ws("_", *fields), 256)


def _or(field: str, default: str) -> Column:
    return text.first_filled(F.col(field), F.lit(default))


def enrich(products: DataFrame, limit: int | None = None) -> DataFrame:
    """Attribute map, missing list, keywords, description and confidence per product.

    One projection. ``limit`` restricts it to the first rows by ``row_idx``.
    """
    scope = products if limit is None else products.where(F.col("row_idx") < limit)
    named = scope.select(
        "*", _or("category", "Industrial Equipment").alias("_cat"),
        _or("subcategory", "Standard Component").alias("_sub"),
        _or("brand", "Industrial OEM").alias("_brand"), _or("model_number", "N/A").alias("_model"))
    attributes = F.map_from_entries(F.array_compact(F.array(*[
        F.when(F.col(f) != "", F.struct(F.lit(name).alias("k"), F.col(f).alias("v")))
        for name, f in fv.ENRICHED_ATTRIBUTES])))
    missing = F.array_compact(F.array(*[
        F.when(F.col(f) == "", F.lit(label)) for label, f in fv.ENRICHED_MISSING]))
    c = F.col
    join = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    keywords = F.array(
        F.lower(join(c("_brand"), " ", c("_cat"))), join(c("_model"), " industrial"),
        join(c("_sub"), " B2B"), join(c("_brand"), " spare parts"),
        F.lit("commercial grade replacement"))
    description = join(
        "Commercial grade ", c("_sub"), " manufactured by ", c("_brand"), " (Model: ", c("_model"),
        "). Engineered for high-duty continuous operation in demanding industrial facilities.",
        F.when(c("power") != "", join(" Rated power specification: ", c("power"), "."))
        .otherwise(F.lit("")),
        F.when(c("voltage") != "", join(" Operating voltage: ", c("voltage"), "."))
        .otherwise(F.lit("")))
    return named.select(
        "row_idx", "product_id", c("_cat").alias("category"), c("_sub").alias("subcategory"),
        c("_brand").alias("brand"), c("_model").alias("model_number"),
        attributes.alias("attributes"), missing.alias("missing_attributes"),
        description.alias("normalized_description"), keywords.alias("commerce_keywords"),
        F.lit(fv.ENRICHED_CONFIDENCE).alias("confidence_score"))


def enrich_once_per_key(products: DataFrame, enricher: Callable[[DataFrame], DataFrame],
                        key: Column | None = None) -> DataFrame:
    """Runs a costly enricher on one row per key and hands its result to all its rows.

    ``enricher`` takes products and returns rows with ``row_idx``. The key's first
    row stands for it; the others look its result up.
    """
    keyed = products.withColumn("_key", enrichment_key() if key is None else key)
    first = keyed.groupBy("_key").agg(F.min("row_idx").alias("_first"))
    lead = keyed.join(first.select(F.col("_first").alias("row_idx")), "row_idx", "left_semi")
    done = enricher(lead.drop("_key")).withColumnRenamed("row_idx", "_first").drop("product_id")
    # One result a key first, then the rows: only one join meets them, and it splits heavy keys.
    return heavy.join(keyed.select("row_idx", "product_id", "_key"), first.join(done, "_first").drop("_first"),
                      ["_key"], ["row_idx"]).drop("_key")


def reuse_stats(products: DataFrame, fields: list[str] = INPUTS) -> DataFrame:
    """Rows, distinct keys and the share of rows served by an earlier result."""
    per_key = products.groupBy(enrichment_key(fields).alias("k")).agg(
        F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("cache_hits"),
    ).withColumn("cache_hit_rate_pct",
                 text.percent(F.col("cache_hits") / F.greatest("total_requests", F.lit(1))))


def attribute_map(attributes: Column) -> Column:
    """Array of (name, value, unit) to a map name -> "value unit"; the last of a name wins."""
    entries = F.transform(attributes, lambda a: F.struct(
        a["name"].alias("k"),
        F.trim(F.concat(a["value"], F.lit(" "), F.coalesce(a["unit"], F.lit("")))).alias("v")))
    last_wins = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last_wins)


def coverage(products: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Share of enriched products and totals of attributes and keywords."""
    sizes = enrichment.join(products.select("row_idx"), "row_idx", "left_semi").agg(
        F.count(F.lit(1)).alias("enriched_products"),
        F.coalesce(F.sum(F.size(F.map_keys("attributes"))), F.lit(0))
        .alias("total_attributes_extracted"),
        F.coalesce(F.sum(F.size("commerce_keywords")), F.lit(0)).alias("total_keywords_generated"))
    total = products.agg(F.count(F.lit(1)).alias("total_products"))
    return beside(total, sizes).withColumn(
        "enrichment_coverage_pct",
        text.percent(F.col("enriched_products") / F.greatest("total_products", F.lit(1))))


def samples(products: DataFrame, enrichment: DataFrame, limit: int = 10) -> DataFrame:
    """First enriched products with their enrichment."""
    result = enrichment.drop("product_id", "model_number").withColumnsRenamed({
        "category": "predicted_category", "subcategory": "predicted_subcategory",
        "brand": "predicted_brand"})
    head = products.select("row_idx", "product_id", "product_name", "model_number").join(
        result, "row_idx").orderBy("row_idx").limit(limit)
    return head.withColumn("confidence_score", text.percent(F.col("confidence_score")))


def upsert(enrichment: DataFrame, renewed: DataFrame) -> DataFrame:
    """Old results with those of the renewed rows replaced."""
    return enrichment.join(renewed, "row_idx", "left_anti").unionByName(renewed)


def best_values(products: DataFrame, enrichment: DataFrame,
                stored: str | None = None) -> DataFrame:
    """Products with category, subcategory, brand, description and confidence from the
    enrichment, else from a stored payload (map column), else from the product itself."""
    e = enrichment.select(
        "row_idx", F.col("category").alias("_e_category"),
        F.col("subcategory").alias("_e_subcategory"), F.col("brand").alias("_e_brand"),
        F.col("normalized_description").alias("_e_description"),
        F.col("confidence_score").alias("_e_confidence"))
    payload = lambda k: (F.lit(None).cast("string") if stored is None
                         else F.try_element_at(stored, F.lit(k)))
    payload_key = {"description": "normalized_description"}
    merged = {
        f: text.first_filled(F.col(f"_e_{f}"), payload(payload_key.get(f, f)), F.col(f))
        for f in ("category", "subcategory", "brand", "description")}
    base = F.col("ai_confidence") if "ai_confidence" in products.columns else F.lit(None)
    confidence = F.coalesce("_e_confidence", payload("confidence_score").try_cast("double"),
                            base.cast("double"), F.lit(0.0))
    keep = [c for c in products.columns if c != "ai_confidence"]
    return products.join(e, "row_idx", "left").select(
        *[merged.get(c, F.col(c)).alias(c) for c in keep], confidence.alias("ai_confidence"))


def mark_enriched(products: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Adds ``ai_enriched`` and ``ai_confidence``."""
    hit = enrichment.select("row_idx", F.col("confidence_score").alias("_conf"))
    return products.join(hit, "row_idx", "left").select(
        *products.columns, F.col("_conf").isNotNull().alias("ai_enriched"),
        F.coalesce("_conf", F.lit(0.0)).alias("ai_confidence"))
