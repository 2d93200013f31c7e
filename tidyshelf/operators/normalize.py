"""Record assembly: any catalogue, mapped or not, to the canonical product row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text, units

TEXT_FIELDS = [
    "product_id", "mpn", "sku", "product_name", "brand", "manufacturer", "supplier",
    "category", "subcategory", "model_number", "description", "currency", "voltage",
    "power", "frequency", "rpm", "weight", "dimensions", "material", "ip_rating",
    "warranty", "country", "source", "technical_document", "product_url",
]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def columns_by_field(columns: list[str], mapping: dict[str, str] | None) -> dict[str, list[str]]:
    """Canonical field -> source columns in header order; leftovers are left out."""
    out: dict[str, list[str]] = {}
    for column in columns:
        field = column if mapping is None else (mapping.get(column) or fv.LEFTOVERS)
        if field != fv.LEFTOVERS:
            out.setdefault(field, []).append(column)
    return out


def _cell(column: str) -> str:
    """SQL text of a raw cell, never null."""
    name = "`" + column.replace("`", "``") + "`"
    return f"coalesce(cast({name} AS string), '')"


def raw_map(columns: list[str]) -> Column:
    """The whole raw row as a map; built from fixed keys, so no key can repeat."""
    keys = ", ".join(text.quote(c) for c in columns)
    return F.expr(f"map_from_arrays(array({keys}), array({', '.join(map(_cell, columns))}))")


def leftovers(columns: list[str], mapping: dict[str, str] | None) -> Column:
    """Non-blank cells no field has taken.

    That is every unmapped cell, and the cells of a field's second and later
    columns once an earlier column of the same field has a value.
    """
    entries = []
    taken: dict[str, list[str]] = {}
    for column in columns if mapping is not None else []:
        value = _cell(column)
        field = mapping.get(column) or fv.LEFTOVERS
        free = f"trim({value}) <> ''"
        if field != fv.LEFTOVERS:
            earlier = taken.setdefault(field, [])
            settled = " OR ".join(f"{_cell(c)} <> ''" for c in earlier)
            free = f"{free} AND ({settled})" if earlier else ""
            earlier.append(column)
        if free:
            entries.append(f"CASE WHEN {free} THEN struct({text.quote(column)} AS k, "
                           f"{value} AS v) END")
    if not entries:
        return F.expr("cast(map() AS map<string, string>)")
    return F.expr(f"map_from_entries(array_compact(array({', '.join(entries)})))")


def normalize(df: DataFrame, mapping: dict[str, str] | None = None, row_idx: str = "row_idx",
              fill_defaults: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Canonical products, one row per raw row, in two projections and no shuffle.

    ``mapping`` is column -> canonical field. Two columns may claim one field;
    per row the first non-empty one wins. Without a mapping the columns are
    looked up by their own names. ``fill_defaults=False`` leaves out the made-up
    name, description, category and source, so that the rules on them can fire.
    Columns in ``keep`` are passed through.
    """
    keep = keep or []
    columns = [c for c in df.columns if c != row_idx and c not in keep]
    sources = columns_by_field(columns, mapping)
    # The first projection settles, per lookup key, the mapped and the raw cell.
    mapped = {
        f: quoted(cs[0]) if len(cs) == 1 else text.first_filled(*[quoted(c) for c in cs])
        for f, cs in sources.items()
    }

    def candidates(key: str) -> list[Column]:
        out = [mapped[key]] if key in mapped else []
        if key in columns and sources.get(key) != [key]:
            out.append(quoted(key))
        return out

    def raw_cell(field: str) -> Column:
        found = candidates(field)
        return found[0].cast("string") if found else F.lit(None).cast("string")

    def lookup(keys: list[str]) -> Column:
        found = list({str(c): c for k in keys for c in candidates(k)}.values())
        if not found:
            return F.lit("")
        cleaned = [text.clean_text(c.cast("string")) for c in found]
        return cleaned[0] if len(cleaned) == 1 else text.first_filled(*cleaned)

    picked = df.select(
        F.col(row_idx).cast("bigint").alias("row_idx"), *keep,
        *[lookup(keys).alias(field) for field, keys in fv.FIELD_KEYS.items()],
        raw_cell("price").alias("_price"),
        text.clean_text(raw_cell("currency")).alias("_currency"),
        raw_map(columns).alias("raw_data"),
        leftovers(columns, mapping).alias("additional_attributes"),
    )
    return _assemble(picked, keep, fill_defaults)


def _assemble(picked: DataFrame, keep: list[str], fill_defaults: bool) -> DataFrame:
    """Each projection names what the next one uses more than once."""
    col = F.col
    stage = picked.select(
        "*", text.known_brand(col("brand")).alias("_b"),
        text.known_brand(col("manufacturer")).alias("_m"),
        text.strip_promo(col("description")).alias("_desc"),
        units.price_value(col("_price")).alias("price"),
    ).select("*", text.first_filled(col("_b"), col("_m")).alias("_brand"),
             text.first_filled(col("_m"), col("_b")).alias("_maker"))
    if fill_defaults:
        stage = stage.withColumn("_name", text.synthesize_name(
            col("product_name"), col("_desc"), col("_brand"), col("model_number"), col("mpn"),
            col("product_id")))
        desc = text.first_filled(col("_desc"), F.concat(
            col("_name"), F.lit(fv.DESCRIPTION_FROM_NAME)))
        ident = text.first_filled(col("product_id"), F.concat(
            F.lit("PID-"), (F.lit(10000) + col("row_idx")).cast("string")))
        default = lambda c, d: text.first_filled(col(c), F.lit(d))
    else:
        stage = stage.withColumn("_name", col("product_name"))
        desc, ident = col("_desc"), col("product_id")
        default = lambda c, d: col(c)
    final = {
        "product_id": ident, "product_name": col("_name"), "brand": col("_brand"),
        "manufacturer": col("_maker"), "description": desc,
        "category": default("category", fv.DEFAULT_CATEGORY),
        "source": default("source", fv.DEFAULT_SOURCE),
        "power": units.power_text(col("power")), "voltage": units.voltage_text(col("voltage")),
        "frequency": units.frequency_text(col("frequency")), "rpm": units.rpm_text(col("rpm")),
        "weight": units.weight_text(col("weight")),
        "dimensions": units.dimensions_text(col("dimensions")),
        "ip_rating": units.ip_text(col("ip_rating")),
        "currency": units.currency_code(col("_price"), col("_currency")),
        "product_url": text.repair_url(col("product_url")),
    }
    return stage.select(
        "row_idx", *keep, *[final.get(f, col(f)).alias(f) for f in TEXT_FIELDS], "price",
        col("price").cast("decimal(18,2)").alias("price_exact"),
        "raw_data", "additional_attributes",
    )


def product_attributes(products: DataFrame) -> DataFrame:
    """Leftover cells in long form, one row per product and attribute."""
    return (
        # The outer form, as the plain one would push a test of the whole map below.
        products.select("row_idx", F.col("source"), F.explode_outer("additional_attributes"))
        .where(F.trim("value") != "")
        .select("row_idx", F.col("key").alias("attribute_name"), F.col("value").alias("raw_value"),
                F.col("value").alias("normalized_value"), F.lit("").alias("unit"),
                F.when(F.col("source") != "", F.col("source"))
                .otherwise(F.lit("Dataset Column")).alias("source"),
                F.lit(1.0).alias("confidence"))
    )
