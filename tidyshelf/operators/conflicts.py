"""Contradictions between sources: detection, listing, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text, units
from tidyshelf.operators import heavy

SPEC_FIELDS = ["power", "voltage", "price"]
COLUMNS = ["row_idx", "other_row_idx", "product_id", "product_name", "model_number", "field",
           "source_a", "value_a", "source_b", "value_b", "severity", "explanation", "status",
           "resolution_notes"]


def brand_feed_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if any(tag in c.lower() for tag in fv.BRAND_FEED_TAGS)]


def _shown_model() -> Column:
    return F.coalesce(F.nullif("model_number", F.lit("")), F.nullif("mpn", F.lit("")), F.lit("N/A"))


def brand_conflicts(products: DataFrame, raw_columns: list[str]) -> DataFrame:
    """Rows whose brand feeds disagree; no shuffle.

    The feeds stand in one array, leftover columns first. If any two of them
    differ then some feed differs from the first one, so comparing with the
    first finds the first disagreeing pair. Each array is bound before it is used
    twice, and the outer form keeps Spark from pushing a second evaluation of all
    feeds below the projection as a filter.
    """
    feeds = brand_feed_columns(raw_columns)
    if not feeds:
        return products.select(*_empty_columns()).limit(0)
    once = lambda c, body: F.get(F.transform(F.array(c), body), F.lit(0))
    cells = F.array(*[F.struct(
        F.lit(c.replace("_", " ").title()).alias("source"),
        F.map_contains_key("additional_attributes", F.lit(c)).alias("leftover"),
        text.strip(F.coalesce(F.try_element_at("raw_data", F.lit(c)), F.lit(""))).alias("value"))
        for c in feeds])
    given = F.filter(cells, lambda x: text.is_source_value(x["value"]))
    ordered = once(given, lambda g: F.concat(
        F.filter(g, lambda x: x["leftover"]), F.filter(g, lambda x: ~x["leftover"])))
    compared = F.transform(ordered, lambda x: F.struct(
        x["source"].alias("source"), x["value"].alias("value"),
        text.compare_string(x["value"]).alias("cmp")))
    pair = once(compared, lambda f: F.array(F.struct(
        F.get(f, F.lit(0)).alias("a"),
        F.get(F.filter(f, lambda x: x["cmp"] != F.get(f, F.lit(0))["cmp"]), F.lit(0)).alias("b"))))
    paired = products.select(
        "row_idx", "product_id", "product_name", "model_number", "mpn", F.inline_outer(pair))
    a, b = "a.source", "b.source"
    explanation = F.concat(
        F.lit("Multi-source brand disagreement: "), F.col(a), F.lit(" reports '"),
        F.col("a.value"), F.lit("' whereas "), F.col(b), F.lit(" lists '"), F.col("b.value"),
        F.lit("'."))
    return paired.where("b is not null").select(
        "row_idx", F.col("row_idx").alias("other_row_idx"), "product_id", "product_name",
        _shown_model().alias("model_number"), F.lit("brand").alias("field"),
        F.col(a).alias("source_a"), F.col("a.value").alias("value_a"),
        F.col(b).alias("source_b"), F.col("b.value").alias("value_b"),
        F.lit("high").alias("severity"), explanation.alias("explanation"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("resolution_notes"))


def _empty_columns() -> list[Column]:
    longs = ("row_idx", "other_row_idx")
    return [F.lit(None).cast("bigint" if c in longs else "string").alias(c) for c in COLUMNS]


def _spec_values(prefix: str) -> Column:
    """The compared fields of one side as an array of text values."""
    return F.array(*[
        F.coalesce(units.float_text(F.col(f"{prefix}.price")), F.lit(""))
        if f == "price" else F.coalesce(F.col(f"{prefix}.{f}"), F.lit("")) for f in SPEC_FIELDS])


def spec_conflicts(products: DataFrame, clusters: DataFrame, pairs: str = "first") -> DataFrame:
    """Power, voltage and price disagreements between a cluster centre and members.

    ``pairs="first"`` compares the centre with its next member only, one
    aggregate over the clusters (pre-aggregated before the shuffle, so a huge
    cluster is no hot spot). ``pairs="all"`` compares it with every member and
    keeps, per field, the first member that disagrees.
    """
    fields = ["row_idx", "product_id", "product_name", "model_number", "mpn", "source",
              *SPEC_FIELDS]
    packed = F.struct(*fields)
    member = clusters.join(products.select(*fields), "row_idx").select(
        "centre", "row_idx", packed.alias("p"))
    is_centre = F.col("row_idx") == F.col("centre")
    if pairs == "first":
        sides = member.groupBy("centre").agg(
            F.min_by(F.when(is_centre, F.col("p")), F.when(is_centre, F.col("row_idx"))).alias("a"),
            F.min_by(F.when(~is_centre, F.col("p")), F.when(~is_centre, F.col("row_idx")))
            .alias("b"))
    elif pairs == "all":
        centres = member.where(is_centre).select("centre", F.col("p").alias("a"))
        others = member.where(~is_centre).select("centre", "row_idx", F.col("p").alias("b"))
        sides = heavy.join(others, centres, ["centre"], ["row_idx"], counted=clusters)
    else:
        raise ValueError(f"pairs must be 'first' or 'all', not {pairs!r}")
    long = sides.where("a is not null and b is not null").select(
        "a", "b", F.explode(F.arrays_zip(
            F.array(*[F.lit(f) for f in SPEC_FIELDS]).alias("field"),
            _spec_values("a").alias("va"), _spec_values("b").alias("vb"))).alias("x")
    ).select("a", "b", F.col("x.field").alias("field"), text.strip(F.col("x.va")).alias("va"),
             text.strip(F.col("x.vb")).alias("vb"))
    clash = long.where(
        text.is_source_value(F.col("va")) & text.is_source_value(F.col("vb"))
        & (text.compare_string(F.col("va")) != text.compare_string(F.col("vb"))))
    is_price = F.col("field") == "price"
    source_a = text.first_filled(F.col("a.source"), F.lit("Supplier Feed A"))
    source_b = text.first_filled(F.col("b.source"), F.lit("Supplier Feed B"))
    price_note = F.concat(F.lit("Commercial pricing variance: "), "va", F.lit(" vs "), "vb",
                          F.lit(" across vendor catalog feeds."))
    spec_note = F.concat(
        F.lit("Critical specification mismatch: Source A lists '"), "va",
        F.lit("' vs Source B at '"), "vb", F.lit("' for model "), F.col("a.model_number"),
        F.lit("."))
    out = clash.select(
        F.col("a.row_idx").alias("row_idx"), F.col("b.row_idx").alias("other_row_idx"),
        F.col("a.product_id").alias("product_id"), F.col("a.product_name").alias("product_name"),
        F.coalesce(F.nullif("a.model_number", F.lit("")), F.nullif("a.mpn", F.lit("")),
                   F.lit("N/A")).alias("model_number"),
        "field", source_a.alias("source_a"), F.col("va").alias("value_a"),
        F.when(source_a == source_b, F.concat(source_b, F.lit(" (Datasheet 2)")))
        .otherwise(source_b).alias("source_b"), F.col("vb").alias("value_b"),
        F.when(is_price, F.lit("medium")).otherwise(F.lit("high")).alias("severity"),
        F.when(is_price, price_note).otherwise(spec_note).alias("explanation"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("resolution_notes"))
    if pairs == "all":
        row = F.struct(*[c for c in COLUMNS if c not in ("row_idx", "field")])
        first = out.groupBy("row_idx", "field").agg(F.min_by(row, "other_row_idx").alias("r"))
        out = first.select("row_idx", "field", "r.*").select(*COLUMNS)
    return out


def detect_conflicts(products: DataFrame, raw_columns: list[str],
                     clusters: DataFrame | None = None, pairs: str = "first",
                     limit: int | None = None) -> DataFrame:
    """In-row brand disagreements and, given clusters, specification mismatches.

    Both kinds give at most one row per (row, field) and never the same field,
    so a plain union keeps that key unique. There is no cap unless asked for.
    """
    found = brand_conflicts(products, raw_columns)
    if clusters is not None:
        found = found.unionByName(spec_conflicts(products, clusters, pairs))
    return found if limit is None else found.orderBy("row_idx", "field").limit(limit)


def conflict_row_ids(conflicts: DataFrame) -> DataFrame:
    """Distinct rows that take part in any conflict, on either side."""
    return conflicts.select(F.explode(F.array("row_idx", "other_row_idx")).alias("row_idx")
                            ).where("row_idx is not null").distinct()


def summary_counts() -> list[Column]:
    pending = F.col("status") == "pending"
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
        F.count_if(pending).alias("pending"), F.count_if(~pending).alias("resolved")]


def conflict_summary(conflicts: DataFrame, *keys: str) -> DataFrame:
    """Counters by severity and status, for the whole table or per key (job_id)."""
    return conflicts.groupBy(*keys).agg(*summary_counts()) if keys else conflicts.agg(
        *summary_counts())


def display(conflicts: DataFrame) -> DataFrame:
    """Listing form with the display defaults filled in."""
    shown = {
        "product_name": "Industrial Catalog Item", "model_number": "N/A",
        "source_a": "Datasheet A", "value_a": "Not available", "source_b": "Datasheet B",
        "value_b": "Not available", "severity": "medium", "status": "pending"}
    return conflicts.select(*[
        text.first_filled(F.col(c), F.lit(shown[c])).alias(c) if c in shown else F.col(c)
        for c in conflicts.columns])


CONFLICT_ACTIONS = ["accept_a", "accept_b", "keep_for_review"]


def latest_actions(actions: DataFrame) -> DataFrame:
    """(row_idx, field) -> latest valid action and notes."""
    return (
        actions.where(F.col("action").isin(CONFLICT_ACTIONS)).groupBy("row_idx", "field")
        .agg(F.max_by(F.struct("action", "notes"), "acted_at").alias("last"))
        .select("row_idx", "field", "last.action", "last.notes"))


def resolve_conflicts(conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Conflicts with the latest action as their status."""
    return conflicts.join(latest_actions(actions), ["row_idx", "field"], "left").select(
        *[c for c in conflicts.columns if c not in ("status", "resolution_notes")],
        F.coalesce("action", "status").alias("status"),
        F.when(F.col("action").isNotNull(), F.coalesce(
            F.nullif("notes", F.lit("")),
            F.concat(F.lit("Resolved with action: "), "action")))
        .otherwise(F.col("resolution_notes")).alias("resolution_notes"))


def apply_resolutions(products: DataFrame, conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Writes the accepted value into the product field; price is parsed.

    One row per product comes back from the pivot, so the join keeps the rows.
    """
    fields = ["brand", *SPEC_FIELDS]
    chosen = conflicts.join(latest_actions(actions), ["row_idx", "field"]).where(
        F.col("action").isin("accept_a", "accept_b")).select(
        "row_idx", "field",
        F.when(F.col("action") == "accept_a", F.col("value_a")).otherwise(F.col("value_b"))
        .alias("value"))
    wide = chosen.groupBy("row_idx").agg(*[
        F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_new_{f}") for f in fields])
    new = lambda f: (F.col(f"_new_{f}").try_cast("double") if f == "price"
                     else F.col(f"_new_{f}"))
    return products.join(wide, "row_idx", "left").select(*[
        F.coalesce(new(c), c).alias(c) if c in fields else F.col(c) for c in products.columns])


def counts_per_product(products: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicts that concern a product, by its row or by its model number.

    The either-or join is split into two equality joins of pre-counted sides:
    by row, by model, less those that match both ways. Nothing multiplies.
    """
    by_row = conflicts.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n_row"))
    by_model = conflicts.groupBy("model_number").agg(F.count(F.lit(1)).alias("n_model"))
    by_both = conflicts.groupBy("row_idx", "model_number").agg(F.count(F.lit(1)).alias("n_both"))
    n = lambda c: F.coalesce(c, F.lit(0))
    by_rows = products.select("row_idx", "product_id", "model_number").join(
        by_row, "row_idx", "left").join(by_both, ["row_idx", "model_number"], "left")
    return (
        heavy.join(by_rows, by_model, ["model_number"], ["row_idx"], "left", counted=products)
        .select("row_idx", "product_id", "model_number",
                (n("n_row") + n("n_model") - n("n_both")).alias("conflict_count")))
