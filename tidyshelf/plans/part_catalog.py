"""A messy catalogue over the ``part`` table, and the frames derived from it.

The column rules are plain SQL text that Spark and DuckDB read alike, so a check
query can start from the same catalogue.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf.operators import conflicts as conflict_ops
from tidyshelf.operators import duplicates, enrich, report_states, score, validate
from tidyshelf.operators.normalize import normalize
from tidyshelf.session import cut, spread, use_checkpoint_dir


def _case(modulus: int, *values: str, otherwise: str = "''") -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE p_partkey % {modulus} {whens} ELSE {otherwise} END"


def _unless(modulus: int, value: str, blank: str = "''") -> str:
    return f"CASE WHEN p_partkey % {modulus} = 0 THEN {blank} ELSE {value} END"


_SIZE = "cast(p_size AS string)"
_DIGITS = "substr(p_brand, 7)"
_SLUG = f"concat({_DIGITS}, '-', {_SIZE})"

# Header -> rule. Headers are as untidy as the cells.
COLUMNS = {
    "Item_Code": _unless(97, "concat('PID-', cast(10000 + p_partkey AS string))"),
    "Item_Title": _unless(53, _unless(
        59, "concat(p_brand, ' ', p_name, '  ', p_type)", "'X'")),
    "Part_Desc": _case(
        8, "concat('<div><p>', p_name, '</p> rated ', " + _SIZE + ", ' kW</div>')",
        "concat('*** SPECIAL PROMO *** ', p_brand, ' ', p_name, '. Order now from stock.')",
        "concat('Heavy duty ', p_name, ' by Siemens for ', lower(p_type), ' plants.')",
        "'short text'", "''", "'N/A'",
        otherwise="concat(p_brand, ' ', p_name, ' with ', " + _SIZE
                  + ", ' HP drive. Second sentence.')"),
    "Brand_Name": "CASE WHEN p_partkey % 13 = 0 THEN 'siemens simatic' "
                  "WHEN p_partkey % 17 = 0 THEN 'SKF' ELSE "
                  + _case(5, "lower(p_brand)", "concat('  ', p_brand, ' ')", "'n/a'",
                          otherwise="p_brand") + " END",
    "E1_Brand": _unless(19, "p_brand", "'-- unbranded --'"),
    "Unilog_Brand": _unless(11, "p_brand", "concat(p_brand, '0')"),
    "Dib_Brand": "'-- no dib brand --'",
    "Category": _unless(41, "p_type"),
    "Sub_Category": _unless(23, "concat(lower(p_type), ' parts')"),
    "Model": _unless(29, _unless(31, _SLUG, f"concat({_DIGITS}, ' ', {_SIZE})")),
    "Price": "CASE WHEN p_partkey % 43 = 0 THEN '-12.5' ELSE " + _case(
        6, "concat('$', cast(p_retailprice AS string))", "'CONTACT SALES'", "''",
        "concat('1,', cast(p_retailprice AS string), ' EUR')",
        otherwise="cast(p_retailprice AS string)") + " END",
    "Curr": _case(7, "'usd'", "'€'", "''", "'GBP'", "'$'", "'n/a'", otherwise="'Eur'"),
    "Power": _case(7, f"concat({_SIZE}, ' HP')", f"concat({_SIZE}, '000 W')",
                   f"concat({_SIZE}, ' kW')", f"concat({_SIZE}, 'KVA')", "''",
                   f"concat({_SIZE}, ' A Rating')", otherwise=_SIZE),
    "Voltage": _case(7, "'0.4 kV'", "'24VDC'", "'230/400V'", "'LOOP POWERED'", "''",
                     "'380-415 volts'", otherwise="'415 VAC'"),
    "Freq": _case(6, "'50Hz'", "'50/60 hz'", "'60 HZ'", "'dc'", "'N/A'",
                  otherwise="'0-400 Hz Output'"),
    "Speed": _case(4, f"concat({_SIZE}, '00 RPM')", f"concat('max ', {_SIZE}, '50rpm')", "'N/A'",
                   otherwise="'variable'"),
    "Weight": _case(6, f"concat({_SIZE}, ' lbs')", f"concat({_SIZE}, '00 g')",
                    f"concat({_SIZE}, '.5 kg.')", "''", f"concat({_SIZE}, '.5')",
                    otherwise=f"concat('approx ', {_SIZE}, ' kilograms')"),
    "Dimensions": _case(
        6, f"concat({_SIZE}, ' x 20 x 30 mm')", f"concat({_SIZE}, '.5x12.1x3.3 cm')",
        f"concat({_SIZE}, '\" x 2\" x 3\"')", f"concat('L:', {_SIZE}, ' W:7 H:9')",
        "'1.2.3 x 4 x 5 inch'", otherwise="'N/A'"),
    "Material": _case(3, "'Cast Iron'", "'none'", otherwise="'Bronze'"),
    "IP_Rating": _case(7, "'IP55'", "'ip 68'", "'IP54 Outdoor'", "'Ex d IIC T6'", "''",
                       "'Open'", otherwise="'ip69k'"),
    "Warranty": _case(3, "'12 Months'", "''", otherwise="'2 Years'"),
    "Country": _case(3, "'Germany'", "'Japan'", otherwise="'-'"),
    "Supplier": "concat('Supplier-', cast(p_partkey % 10 AS string))",
    "Source": _unless(37, "concat('feed-', cast(p_partkey % 4 AS string))"),
    "Datasheet": _case(5, f"concat('https://docs.example.com/', {_SLUG}, '.pdf')", "''",
                       "'see web'", otherwise="'http://10.0.0.1:8080/a.pdf'"),
    "URL": _case(6, f"concat('https://www.example.com/item/', {_SLUG})", "'bad-url'",
                 "'www.example.com/x y'", "''", "'example.com/ok'",
                 otherwise="'httpx://example.com'"),
    "Finish": _unless(4, "lower(p_name)"),
    "Lead_Time": _case(3, "' '", "'N/A'", otherwise="'6 weeks'"),
}

# Column -> canonical field; four columns claim the brand, two stay unmapped.
MAPPING = {
    "Item_Code": "product_identifier", "Item_Title": "product_name",
    "Part_Desc": "product_description", "Brand_Name": "brand", "E1_Brand": "brand",
    "Unilog_Brand": "brand", "Dib_Brand": "brand", "Category": "category",
    "Sub_Category": "subcategory", "Model": "model_number", "Price": "price",
    "Curr": "currency", "Power": "power", "Voltage": "voltage", "Freq": "frequency",
    "Speed": "rpm", "Weight": "weight", "Dimensions": "dimensions", "Material": "material",
    "IP_Rating": "ip_rating", "Warranty": "warranty", "Country": "country",
    "Supplier": "supplier", "Source": "source", "Datasheet": "technical_document",
    "URL": "product_url",
}


def raw_sql() -> str:
    """The catalogue as a SELECT over ``part`` for either engine."""
    return "SELECT p_partkey AS row_idx, " + ", ".join(
        f"{rule} AS {name}" for name, rule in COLUMNS.items()) + " FROM part"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "p_partkey AS row_idx", *[f"{rule} AS {name}" for name, rule in COLUMNS.items()])


def fresh(spark: SparkSession, sf_dir: str, fill_defaults: bool = True) -> DataFrame:
    """Products normalised from the scan on."""
    return normalize(raw(spark, sf_dir), MAPPING, fill_defaults=fill_defaults)


# -- result tables -----------------------------------------------------------------
# Reports read stored tables, as they would after a run of the job. Each is written
# once per session and source folder.

_stored: dict[tuple, DataFrame] = {}


def remembered(build):
    """One frame per session and source folder."""
    @functools.wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _stored:
            _stored[key] = build(spark, sf_dir)
        return _stored[key]

    return get


def stored(build):
    return remembered(functools.wraps(build)(lambda spark, sf_dir: cut(build(spark, sf_dir))))


@stored
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh(spark, sf_dir)


@stored
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(products(spark, sf_dir))


@stored
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issue_rows(validated(spark, sf_dir))


@stored
def model_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by the model rule alone."""
    return duplicates.cluster_by_model(products(spark, sf_dir))


@stored
def name_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by model and name similarity."""
    return duplicates.cluster(products(spark, sf_dir))


@stored
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_items(products(spark, sf_dir), name_clusters(spark, sf_dir))


@stored
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_groups(items(spark, sf_dir))


@stored
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict_ops.detect_conflicts(
        products(spark, sf_dir), list(COLUMNS), name_clusters(spark, sf_dir))


@stored
def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(products(spark, sf_dir))


@stored
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score(validated(spark, sf_dir),
                       conflict_ops.conflict_row_ids(conflicts(spark, sf_dir)))


@stored
def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored products with the enrichment marks."""
    return enrich.mark_enriched(scored(spark, sf_dir), enrichment(spark, sf_dir))


BATCHES = 3


@remembered
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report states of the whole catalogue, which comes in batches, each under its source as job."""
    folder = f"{use_checkpoint_dir(spark)}/states-{uuid.uuid4().hex}"
    batch = F.pmod(F.xxhash64("row_idx"), F.lit(BATCHES))
    for i in range(BATCHES):
        part = lambda df: df.where(batch == i)
        report_states.add_batch(report_states.state(
            part(full(spark, sf_dir)), list(COLUMNS), F.col("source"), part(conflicts(spark, sf_dir)),
            part(name_clusters(spark, sf_dir))), folder, i)
    return report_states.read(spark, folder)


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User decisions on conflicts, derived from the conflicts themselves: two per row
    in order of time, the later one counts."""
    actions = F.array(*[F.lit(a) for a in conflict_ops.CONFLICT_ACTIONS])
    found = conflicts(spark, sf_dir).select("row_idx", "field")
    return found.select("row_idx", "field", F.explode(F.array(F.lit(1), F.lit(2))).alias("acted_at")
                        ).withColumn("action", F.get(actions, F.pmod(
                            F.col("row_idx") + F.col("acted_at"), F.lit(3)).cast("int"))
                        ).withColumn("notes", F.when(F.col("row_idx") % 2 == 0, F.lit("checked")))
