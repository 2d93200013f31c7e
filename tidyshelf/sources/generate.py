"""Messy-catalogue generator for load tests: noisy units, blanks, near copies.

All choices are hashes of the row number, so the data do not depend on the
partitioning and need no driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv

KINDS = ["Motor", "Pump", "Valve", "Sensor", "Bearing", "Compressor", "Controller", "Breaker",
         "Guard Switch", "Generator"]
STYLES = ["Heavy Duty", "Compact", "Explosion Proof", "Stainless", "High Pressure"]
COLUMNS = ["product_id", "product_name", "brand", "category", "subcategory", "model_number",
           "description", "price", "currency", "voltage", "power", "frequency", "rpm", "weight",
           "dimensions", "material", "ip_rating", "warranty", "manufacturer", "country",
           "supplier", "source", "technical_document", "product_url"]


def _hash(key: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 31))


def _pick(key: Column, salt: str, options: list[str]) -> Column:
    at = F.pmod(_hash(key, salt), F.lit(len(options))).cast("int")
    return F.get(F.array(*[F.lit(o) for o in options]), at)


def _number(key: Column, salt: str, low: int, high: int) -> Column:
    return F.pmod(_hash(key, salt), F.lit(high - low)) + low


def _blank(key: Column, salt: str, share: float, value: Column) -> Column:
    return F.when(_number(key, salt + "?", 0, 1000) < share * 1000, F.lit("")).otherwise(value)


def generate_catalog(spark: SparkSession, rows: int = 1050, items: int = 120,
                     variants: int = 150) -> DataFrame:
    """``rows`` text rows with ``row_idx``; the first ``variants`` vary ``items`` items."""
    i = F.col("id")
    varied = i < variants
    base = F.when(varied, i % items).otherwise(i + items)
    brands = sorted(set(fv.BRANDS.values()))
    df = spark.range(rows).select(
        i.alias("row_idx"), i.alias("id"), base.alias("k"), varied.alias("varied"))
    k = F.col("k")
    df = df.select("*", _pick(k, "kind", KINDS).alias("kind"), _pick(k, "style", STYLES)
                   .alias("style"), _pick(k, "brand", brands).alias("maker"))
    size = _number(k, "power", 1, 200).cast("string")
    model = F.concat(F.upper(F.left("maker", F.lit(3))), F.lit("-"), F.upper(F.left("kind", F.lit(3))),
                     F.lit("-"), _number(k, "model", 100, 10000).cast("string"))
    df = df.withColumn("model", model).withColumn(
        "plain", F.concat_ws(" ", "maker", "style", "kind", "model"))
    spelled = F.when(F.col("varied"), F.get(F.array(
        F.col("plain"), F.upper("plain"), F.concat_ws(" ", F.lower("maker"), "style", "kind", "model"),
        F.concat_ws(" ", "maker", "model", F.lit("-"), "style", "kind")),
        F.pmod(_hash(i, "spelling"), F.lit(4)).cast("int"))).otherwise(F.col("plain"))
    side = lambda s: _number(i, s, 100, 1200)
    text_of = {
        "product_id": F.concat(F.lit("PID-"), (i + 10000).cast("string")),
        "product_name": spelled,
        "brand": F.when(F.col("varied") & (_number(i, "case", 0, 7) == 0), F.lower("maker"))
        .otherwise(F.col("maker")),
        "category": F.concat(F.col("kind"), F.lit("s")),
        "subcategory": _blank(i, "sub", 0.04, F.concat_ws(" ", "style", "kind")),
        "model_number": F.when(F.col("varied") & (_number(i, "dash", 0, 10) == 0),
                               F.replace("model", F.lit("-"), F.lit(" "))).otherwise(F.col("model")),
        "description": F.get(F.array(
            F.concat(F.lit("<div><p>"), "plain", F.lit("</p> <br>certified</div>")),
            F.concat(F.lit("*** PROMO *** "), "plain", F.lit(", long life, low vibration.")),
            F.concat("plain", F.lit(" for continuous use in harsh sites."))),
            _number(i, "text", 0, 3).cast("int")),
        "price": F.when(_number(i, "sale", 0, 100) < 3, F.lit("CONTACT SALES")).otherwise(
            _blank(i, "price", 0.03, F.concat(_number(k, "price", 85, 24000).cast("string"),
                                              F.lit(".50")))),
        "currency": _blank(i, "cur", 0.05, _pick(i, "cur", ["USD", "EUR", "$", "€", "GBP"])),
        "voltage": _blank(i, "volt", 0.06, _pick(
            k, "volt", ["400 V", "0.4 kV", "24VDC", "230/400V", "415 VAC", "N/A"])),
        "power": _blank(i, "pow", 0.07, F.concat(size, _pick(
            i, "unit", [" kW", " HP", "kw", " KVA", "000 W"]))),
        "frequency": _pick(i, "hz", ["50 Hz", "60Hz", "50/60 Hz", "N/A"]),
        "rpm": _pick(i, "rpm", ["1450 RPM", "3000 rpm", "N/A"]),
        "weight": _blank(i, "wt", 0.05, F.concat(_number(i, "wt", 2, 450).cast("string"), F.lit(".5"),
                                                 _pick(i, "wu", [" kg", " lbs", " g", " KG."]))),
        "dimensions": _blank(i, "dim", 0.08, F.concat(
            side("l").cast("string"), F.lit(" x "), side("w").cast("string"), F.lit(" x "),
            side("h").cast("string"), _pick(i, "du", [" mm", " cm", " inch"]))),
        "material": _pick(i, "mat", ["Cast Iron", "Aluminum", "Bronze"]),
        "ip_rating": _blank(i, "ip", 0.08, _pick(i, "ip", ["IP55", "ip 68", "IP65", "Open"])),
        "warranty": _pick(i, "war", ["12 Months", "2 Years", ""]),
        "manufacturer": F.col("maker"),
        "country": _pick(i, "co", ["Germany", "Japan", "Italy"]),
        "supplier": _pick(i, "sup", ["North Hub", "Apex Supply", "Drive Parts"]),
        "source": _pick(i, "src", ["feed-a", "feed-b", "feed-c"]),
        "technical_document": _blank(i, "doc", 0.1, F.concat(
            F.lit("https://docs.example.com/"), F.lower("model"), F.lit(".pdf"))),
        "product_url": F.when(_number(i, "url", 0, 100) < 8, F.lit("invalid-url-item")).otherwise(
            F.concat(F.lit("https://www.example.com/item/"), F.lower("model"))),
    }
    return df.select("row_idx", *[text_of[c].alias(c) for c in COLUMNS])
