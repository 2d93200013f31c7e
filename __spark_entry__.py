"""Queries of the catalogue data-quality engine and their DuckDB twins.

``queries()`` runs every operator over the given tables; ``oracle_sql()`` holds
the same question as SQL wherever SQL can ask it.
"""

from __future__ import annotations

import importlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text, units
from tidyshelf.operators import (conflicts, detail, duplicates, enrich, gaps, grid, mapping,
                                 pages, profile, report_states, reports, score, search_index, validate)
from tidyshelf.operators.normalize import TEXT_FIELDS, product_attributes
from tidyshelf.plans import changes
from tidyshelf.plans import part_catalog as pc
from tidyshelf.plans import pipeline
from tidyshelf.plans import twins as tw
from tidyshelf.session import use_checkpoint_dir
from tidyshelf.sources import catalog, sinks
from tidyshelf.streaming import clusters, progress, runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Wide projections run faster as split code than as one huge method.
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return fn(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return fn
    return add


# -- flagship ---------------------------------------------------------------------

@_query("category_quality", tw.over("plain_scored", """
SELECT category, count(*) AS product_count, round(avg(price), 2) AS avg_price,
  count(*) FILTER (validation_status = 'valid') AS valid_count,
  count(*) FILTER (validation_status = 'warning') AS warning_count,
  count(*) FILTER (validation_status = 'invalid') AS invalid_count,
  round(avg(quality_score), 1) AS avg_quality
FROM scored GROUP BY category"""))
def category_quality(spark, d):
    return score.score(validate.validate(pc.fresh(spark, d))).groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"), F.round(F.avg("price"), 2).alias("avg_price"),
        *[F.count_if(F.col("validation_status") == s).alias(f"{s}_count")
          for s in ("valid", "warning", "invalid")],
        F.round(F.avg("quality_score"), 1).alias("avg_quality"))


# -- scans -------------------------------------------------------------------------

@_query("scan_row_numbers", """
SELECT count(*) AS row_count, min(row_number) AS first_number, max(row_number) AS last_number,
  count(DISTINCT row_number) AS distinct_numbers
FROM (SELECT row_number() OVER () - 1 AS row_number FROM orders)""")
def scan_row_numbers(spark, d):
    return catalog.with_row_idx(pc.table(spark, d, "orders").select("o_orderkey")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("row_idx").alias("first_number"),
        F.max("row_idx").alias("last_number"),
        F.count_distinct("row_idx").alias("distinct_numbers"))


@_query("scan_clean_cells", """
SELECT c_custkey AS row_idx, cast(c_custkey AS varchar) AS c_custkey, trim(c_name) AS c_name,
  cast(c_nationkey AS varchar) AS c_nationkey, coalesce(trim(c_mktsegment), '') AS c_mktsegment
FROM customer""")
def scan_clean_cells(spark, d):
    raw = pc.table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_idx"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return catalog.clean_cells(raw, keep=["row_idx"])


def _fresh_folder(spark, kind: str) -> str:
    return f"{use_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@_query("csv_roundtrip", """
SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, cast(s_suppkey AS varchar) AS s_suppkey,
  trim(s_name) AS s_name, cast(s_nationkey AS varchar) AS s_nationkey,
  'He said "yes, ' || trim(s_name) || '"; no' AS remark, s_acctbal
FROM supplier""")
def csv_roundtrip(spark, d):
    """The table as delimited text with quotes and separators in its cells, read as a catalogue."""
    path = _fresh_folder(spark, "csv")
    suppliers = pc.table(spark, d, "supplier").orderBy("s_suppkey").select(
        "s_suppkey", "s_name", "s_nationkey",
        F.concat(F.lit('He said "yes, '), F.trim("s_name"), F.lit('"; no')).alias("remark"), "s_acctbal")
    sinks.write_csv(suppliers, path)
    return catalog.read_catalog(spark, path, "csv").withColumn(
        "s_acctbal", F.col("s_acctbal").cast("double"))


@_query("csv_multiline", """
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, cast(p_partkey AS varchar) AS p_partkey,
  p_name || chr(10) || '"' || p_type || '",' || chr(10) || chr(10) || p_brand AS remark,
  CASE WHEN p_partkey % 3 = 0 THEN p_type || chr(10) || 'loose' ELSE p_type END AS kind, p_size
FROM part""")
def csv_multiline(spark, d):
    """The table as delimited text with line breaks, quotes and separators in its cells, read as a catalogue."""
    path = _fresh_folder(spark, "csv")
    parts = pc.table(spark, d, "part").orderBy("p_partkey").selectExpr(
        "p_partkey", "concat(p_name, '\\n\"', p_type, '\",\\n\\n', p_brand) AS remark",
        "CASE WHEN p_partkey % 3 = 0 THEN concat(p_type, '\\nloose') ELSE p_type END AS kind", "p_size")
    sinks.write_csv(parts, path)
    return catalog.read_catalog(spark, path, "csv").withColumn("p_size", F.col("p_size").cast("int"))


@_query("csv_mixed_encodings", """
SELECT row_number() OVER (ORDER BY s_suppkey % 2, s_suppkey) - 1 AS row_idx, cast(s_suppkey AS varchar) AS s_suppkey,
  'Größe é ' || trim(s_name) AS label FROM supplier""")
def csv_mixed_encodings(spark, d):
    """One catalogue out of files of two encodings."""
    root = _fresh_folder(spark, "csv")
    suppliers = pc.table(spark, d, "supplier").orderBy("s_suppkey").select(
        "s_suppkey", F.concat(F.lit("Größe é "), F.trim("s_name")).alias("label"))
    for rest, encoding in enumerate(["UTF-8", "ISO-8859-1"]):
        suppliers.where(F.col("s_suppkey") % 2 == rest).write.option("header", True).option(
            "encoding", encoding).csv(f"{root}/{rest}")
    return catalog.read_catalog(spark, f"{root}/*", "csv")


@_query("table_roundtrip", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority AS job_id FROM orders""")
def table_roundtrip(spark, d):
    """Rows written as a result table by job, one job of them written twice, and read back."""
    root = _fresh_folder(spark, "tables")
    orders = pc.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("job_id"))
    sinks.write_table(orders, root, "orders")
    urgent = orders.where("job_id = '1-URGENT'").drop("job_id")
    sinks.write_table(urgent, root, "orders", "1-URGENT")
    return sinks.read_table(spark, root, "orders")


@_query("job_scoped_scan", """
SELECT o_orderpriority AS job_id, count(*) AS row_count FROM orders
WHERE o_orderpriority = '2-HIGH' GROUP BY 1""")
def job_scoped_scan(spark, d):
    return catalog.job_scan(pc.table(spark, d, "orders").withColumnRenamed(
        "o_orderpriority", "job_id"), "2-HIGH").groupBy("job_id").agg(
        F.count(F.lit(1)).alias("row_count"))


@_query("newest_job_rows", """
SELECT event_id, user_id AS job_id, event_type FROM events
WHERE user_id = (SELECT max_by(user_id, (ts, event_id)) FROM events)""")
def newest_job_rows(spark, d):
    events = pc.table(spark, d, "events").withColumnRenamed("user_id", "job_id")
    jobs = events.select("job_id", F.struct("ts", "event_id").alias("created_at"))
    return catalog.newest_job_rows(events, jobs).select("event_id", "job_id", "event_type")


# -- column mapping --------------------------------------------------------------------

def _unpivot(table: str, row: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {row} AS r, {i} AS position, '{c}' AS col, trim(cast({c} AS varchar)) AS v "
        f"FROM {table}" for i, c in enumerate(columns))


_LINE_COLUMNS = ["l_orderkey", "l_quantity", "l_returnflag", "l_linestatus"]
_PROFILE = f"""
WITH cells AS ({{cells}}), seen AS (
  SELECT position, col, v, min(r) AS first_row FROM cells
  WHERE v <> '' AND lower(v) NOT IN {tw._in(fv.BLANK_WORDS)} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY first_row, v) AS rank
  FROM seen)"""


@_query("column_profile_lines", _PROFILE.format(cells=_unpivot(
    "lineitem", "l_orderkey * 10 + l_linenumber", _LINE_COLUMNS)) + """
SELECT position, col AS column_name, rank, v AS value, first_row FROM ranked WHERE rank <= 15""")
def column_profile_lines(spark, d):
    lines = pc.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), *_LINE_COLUMNS)
    return mapping.first_values(mapping.distinct_values(lines, sample_rows=None)).select(
        "position", F.col("column").alias("column_name"), "rank", "value", "first_row")


_CATALOG_COLUMNS = list(pc.COLUMNS)


@_query("column_types", f"WITH {tw.RAW}, " + _PROFILE.format(cells=_unpivot(
    "raw", "row_idx", _CATALOG_COLUMNS)).replace("WITH cells", "cells", 1) + r""",
top AS (SELECT * FROM ranked WHERE rank <= 15),
names AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name" for i, c in enumerate(_CATALOG_COLUMNS)) + r""")
SELECT n.position, n.column_name, count(v) AS sample_count,
  CASE WHEN avg((starts_with(v, 'http://') OR starts_with(v, 'https://') OR contains(v, 'www.'))
      ::int) >= 0.5 THEN 'url'
    WHEN avg(regexp_matches(v, '^[-+]?[0-9.,]+(?:\s*[a-zA-Z%]+)?$')::int) >= 0.8 THEN 'number'
    ELSE 'string' END AS inferred_type
FROM names n LEFT JOIN top t USING (position) GROUP BY 1, 2""")
def column_types(spark, d):
    return mapping.profile(pc.raw(spark, d), sample_rows=None).select(
        "position", F.col("column").alias("column_name"),
        F.col("sample_count").cast("bigint").alias("sample_count"), "inferred_type")


_COUNTED = {
    "address": "starts_with(v, 'http://') OR starts_with(v, 'https://') OR contains(v, 'www.')",
    "number_with_unit": f"regexp_matches(v, '{mapping.NUMBER_WITH_UNIT}')", "currency": "regexp_matches(v, '[$€£]')",
    "link": "starts_with(v, 'http://') OR starts_with(v, 'https://')", "pdf": "contains(v, '.pdf')",
    "short": "length(v) < 30", "numeric": f"regexp_matches(v, '{mapping.NUMBER}')",
    "voltage": f"regexp_matches(v, '{mapping.VOLTAGE}')", "power": f"regexp_matches(v, '{mapping.POWER_HEADER}')",
    "power_unit": f"regexp_matches(v, '{mapping.POWER_CHECK}')",
    "weight": f"regexp_matches(v, '{mapping.WEIGHT_HEADER}')",
    "weight_unit": f"regexp_matches(v, '{mapping.WEIGHT_CHECK}')", "ip_code": f"regexp_matches(v, '{mapping.IP_CODE}')"}


@_query("column_profile_whole", f"WITH {tw.RAW}, " + _PROFILE.format(cells=_unpivot(
    "raw", "row_idx", _CATALOG_COLUMNS)).replace("WITH cells", "cells", 1) + """,
shown AS (SELECT position, string_agg(v, ' | ' ORDER BY rank) AS samples FROM ranked WHERE rank <= 15 GROUP BY 1),
n AS (SELECT position, col, count(v) FILTER (ok) AS n_values, """ + ", ".join(
    f'count(*) FILTER (ok AND ({test})) AS "{name}"' for name, test in _COUNTED.items()) + f"""
  FROM (SELECT *, v <> '' AND lower(v) NOT IN {tw._in(fv.BLANK_WORDS)} AS ok FROM cells) GROUP BY 1, 2)
SELECT n.* EXCLUDE (col), col AS column_name, coalesce(samples, '') AS samples,
  CASE WHEN address / greatest(n_values, 1) >= 0.5 THEN 'url'
    WHEN number_with_unit / greatest(n_values, 1) >= 0.8 THEN 'number' ELSE 'string' END AS inferred_type
FROM n LEFT JOIN shown USING (position)""")
def column_profile_whole(spark, d):
    """Counts over all values of each column, its first values and the type that all of them give."""
    return profile.whole_profile(pc.raw(spark, d)).select(
        "position", F.col("column").alias("column_name"), "n_values", *_COUNTED,
        F.array_join("samples", " | ").alias("samples"), "inferred_type")


_ALIASES = ", ".join(
    f"({i}, {tw.quote(f)}, {tw.quote(a)}, {str(k == 0).lower()})"
    for i, (f, k, a) in enumerate(
        (f, k, a) for f, v in fv.CANONICAL_FIELDS.items() for k, a in enumerate([f, *v[2]])))
_TABLE_COLUMNS = [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                        "p_retailprice")] + [
    ("supplier", c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")] + [
    ("pages", "url")]


@_query("header_match", f"""
WITH aliases(ord, field, alias, is_key) AS (VALUES {_ALIASES}),
headers AS (""" + " UNION ALL ".join(
    f"SELECT DISTINCT {tw.quote(c)} AS header FROM {t}" for t, c in _TABLE_COLUMNS) + """),
hits AS (SELECT header, field, ord, CASE WHEN header = alias AND is_key THEN 0.99
    WHEN header = alias THEN 0.98 WHEN length(alias) >= 4 THEN 0.88 ELSE 0.78 END AS confidence,
    header = alias AS exact
  FROM headers JOIN aliases ON header = alias OR (NOT is_key AND contains(header, alias))),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (
  PARTITION BY header ORDER BY exact DESC, CASE WHEN exact THEN 0 ELSE -confidence END, ord) = 1)
SELECT h.header, coalesce(field, 'additional_attributes') AS field,
  cast(coalesce(confidence, 0.5) AS double) AS confidence
FROM headers h LEFT JOIN best USING (header)""")
def header_match(spark, d):
    """Headers are taken from the rows of the tables, so that the scan is part of it."""
    parts = None
    for name in ("part", "supplier", "pages"):
        columns = [c for t, c in _TABLE_COLUMNS if t == name]
        one = pc.table(spark, d, name).select(
            F.explode(F.array(*[F.lit(c) for c in columns])).alias("header")).distinct()
        parts = one if parts is None else parts.unionByName(one)
    return parts.withColumn("m", mapping.header_match(mapping.normal_header(F.col("header")))
                            ).select("header", "m.field", "m.confidence")


@_query("mapping_report")
def mapping_report(spark, d):
    return mapping.analyze(pc.raw(spark, d), sample_rows=None).select(
        "position", "original_column", "canonical_field", "canonical_label", "data_type",
        "confidence", "confidence_level", "evidence",
        F.array_join("sample_values", " | ").alias("sample_values"),
        F.to_json("alternatives").alias("alternatives"))


@_query("mapping_report_whole")
def mapping_report_whole(spark, d):
    """The mapping that all values of all rows give."""
    return mapping.analyze(pc.raw(spark, d), whole=True).select(
        "position", "original_column", "canonical_field", "canonical_label", "data_type",
        "confidence", "confidence_level", "evidence")


@_query("mapping_summary")
def mapping_summary(spark, d):
    return mapping.summary(mapping.analyze(pc.raw(spark, d), sample_rows=None))


_FP = ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"]


@_query("dataset_fingerprint", f"""
SELECT sha256('{"::".join(_FP)}___' || string_agg(line, '###' ORDER BY r)) AS fingerprint
FROM (SELECT c_custkey AS r, concat_ws('|', {", ".join(f"left(trim(cast({c} AS varchar)), 20)"
                                                        for c in _FP)}) AS line
  FROM customer WHERE c_custkey < 5)""")
def dataset_fingerprint(spark, d):
    customers = pc.table(spark, d, "customer").select(
        F.col("c_custkey").alias("row_idx"), *_FP)
    return mapping.fingerprint(customers)


_WHOLE_FP = sorted((c for c in pc.COLUMNS if c != "Supplier"), key=str.lower)


@_query("catalogue_fingerprints", tw.over("norm", f"""
SELECT Supplier, count(*) AS row_count, sha256('{"::".join(c.lower() for c in _WHOLE_FP)}:' || count(*) || {
    " || ':' || ".join(f"':' || sum(('0x' || h[{1 + 15 * k}:{15 + 15 * k}])::hugeint)::hugeint" if not k else
                       f"sum(('0x' || h[{1 + 15 * k}:{15 + 15 * k}])::hugeint)::hugeint" for k in range(4))}) AS fingerprint
FROM (SELECT Supplier, sha256({" || ".join(f"length({c}) || ':' || {c}" for c in _WHOLE_FP)}) AS h FROM raw) GROUP BY Supplier"""))
def catalogue_fingerprints(spark, d):
    """Whole-table fingerprint of each supplier's rows."""
    return mapping.whole_fingerprint(pc.raw(spark, d), by="Supplier")


# -- normalisation ------------------------------------------------------------------------

_NORM_FIELDS = ["row_idx", *TEXT_FIELDS, "price"]


@_query("normalized_products", tw.over("norm", f"SELECT {', '.join(_NORM_FIELDS)} FROM norm"))
def normalized_products(spark, d):
    return pc.fresh(spark, d).select(*_NORM_FIELDS)


@_query("power_values", tw.over("norm", """
SELECT row_idx, power, power_kw FROM norm"""))
def power_values(spark, d):
    cell = text.clean_text(F.col("Power"))
    return pc.raw(spark, d).select("row_idx", units.power_text(cell).alias("power"),
                                   units.power_value(cell).alias("power_kw"))


@_query("price_by_currency", tw.over("norm", """
SELECT currency, count(*) AS product_count, count(price) AS priced,
  cast(sum(cast(price AS decimal(18, 2))) AS double) AS price_sum
FROM norm GROUP BY currency"""))
def price_by_currency(spark, d):
    return pc.fresh(spark, d).groupBy("currency").agg(
        F.count(F.lit(1)).alias("product_count"), F.count("price").alias("priced"),
        F.sum("price_exact").cast("double").alias("price_sum"))


_CLEAN_DOC = tw.clean("text")


@_query("clean_documents", f"""
SELECT doc_id, length({_CLEAN_DOC}) AS clean_length, md5({_CLEAN_DOC}) AS clean_hash
FROM documents""")
def clean_documents(spark, d):
    cleaned = text.clean_text(F.col("text"))
    return pc.table(spark, d, "documents").select("doc_id", cleaned.alias("c")).select(
        "doc_id", F.length("c").alias("clean_length"), F.md5("c").alias("clean_hash"))


_CLEAN_PAGE = tw.clean("html")


@_query("clean_pages", f"""
SELECT page_id, length({_CLEAN_PAGE}) AS clean_length, md5({_CLEAN_PAGE}) AS clean_hash,
  regexp_matches(url, {tw.quote(fv.URL_PATTERN)}) AS url_ok
FROM pages""")
def clean_pages(spark, d):
    return pc.table(spark, d, "pages").select(
        "page_id", "url", text.clean_text(F.col("html")).alias("c")).select(
        "page_id", F.length("c").alias("clean_length"), F.md5("c").alias("clean_hash"),
        text.is_url(F.col("url")).alias("url_ok"))


@_query("key_strings", f"""
SELECT s_suppkey, {tw.key('s_name')} AS key_string, {tw.compare('s_name')} AS compare_string,
  {tw.is_value('s_name')} AS is_value FROM supplier""")
def key_strings(spark, d):
    name = F.col("s_name")
    return pc.table(spark, d, "supplier").select(
        "s_suppkey", text.key_string(name).alias("key_string"),
        text.compare_string(name).alias("compare_string"),
        text.is_source_value(name).alias("is_value"))


@_query("field_labels", tw.over("issues", """
SELECT DISTINCT field, """ + tw.title("issue_type") + """ AS type_label FROM issues"""))
def field_labels(spark, d):
    return pc.issues(spark, d).select(
        "field", text.title_label(F.col("issue_type")).alias("type_label")).distinct()


_LEFTOVER_SQL = """
SELECT row_idx, attribute_name, raw_value, source FROM (
  SELECT row_idx, source, 'E1_Brand' AS attribute_name, e1 AS raw_value FROM norm
    WHERE brand_name <> ''
  UNION ALL SELECT row_idx, source, 'Unilog_Brand', unilog FROM norm
  UNION ALL SELECT row_idx, source, 'Dib_Brand', dib FROM norm
  UNION ALL SELECT row_idx, source, 'Finish', Finish FROM norm
  UNION ALL SELECT row_idx, source, 'Lead_Time', Lead_Time FROM norm)
WHERE trim(raw_value) <> ''"""


@_query("product_attributes", tw.over("norm", _LEFTOVER_SQL))
def leftover_attributes(spark, d):
    return product_attributes(pc.fresh(spark, d)).select(
        "row_idx", "attribute_name", "raw_value", "source")


# -- validation and scores ---------------------------------------------------------------

@_query("validation_issues", tw.over("issues", """
SELECT row_idx, product_id, field, issue_type, severity, message, raw_value FROM issues"""))
def validation_issues(spark, d):
    return validate.issue_rows(validate.validate(pc.fresh(spark, d)))


@_query("row_status", tw.over("plain_scored", "SELECT row_idx, validation_status FROM scored"))
def row_status(spark, d):
    return validate.validate(pc.fresh(spark, d)).select("row_idx", "validation_status")


@_query("issue_page", tw.over("issues", """
SELECT row_idx, field, message FROM issues WHERE severity = 'low' AND field = 'price'
ORDER BY row_idx, field, issue_type LIMIT 25 OFFSET 50"""))
def issue_page(spark, d):
    page, _ = grid.issue_list(pc.issues(spark, d), severity="low", field="price", number=3)
    return page.select("row_idx", "field", "message")


_SCORES = ["quality_score", "completeness_score", "validity_score", "consistency_score",
           "source_agreement_score"]


@_query("row_scores", tw.over("scored", f"SELECT row_idx, {', '.join(_SCORES)} FROM scored"))
def row_scores(spark, d):
    return pc.scored(spark, d).select("row_idx", *_SCORES)


_TRUST = """round(quality_score * 0.4 + round(completeness_score * 100, 1) * 0.2
  + round(validity_score * 100, 1) * 0.2 + round(source_agreement_score * 100, 1) * 0.2, 1)"""


@_query("trust_scores", tw.over("scored", f"SELECT row_idx, {_TRUST} AS trust_score FROM scored"))
def trust_scores(spark, d):
    return pc.scored(spark, d).select("row_idx", score.trust_score().alias("trust_score"))


_MEANS = ", ".join(["round(avg(quality_score), 1) AS quality_score"] + [
    f"round(avg({s}) * 100, 1) AS {s}" for s in _SCORES[1:]])
_BANDS = """count(*) FILTER (quality_score >= 85) AS excellent,
  count(*) FILTER (quality_score >= 70 AND quality_score < 85) AS good,
  count(*) FILTER (quality_score >= 50 AND quality_score < 70) AS fair,
  count(*) FILTER (quality_score < 50) AS poor"""


@_query("catalog_quality", tw.over("scored", f"SELECT {_MEANS}, {_BANDS} FROM scored"))
def catalog_quality(spark, d):
    return score.catalog_quality(pc.scored(spark, d))


# -- duplicates --------------------------------------------------------------------------

_BLOCKS = f"""
keys AS (SELECT row_idx, left({tw.key('brand')}, 6) || '|' || left({tw.key('category')}, 6) AS a,
  nullif(left({tw.key('model_number')}, 5), '') AS b FROM norm)"""


@_query("duplicate_blocks", tw.over("norm", """
SELECT block, count(*) AS block_rows FROM (
  SELECT 'bc|' || a AS block FROM keys
  UNION ALL SELECT 'm|' || b FROM keys WHERE b IS NOT NULL) GROUP BY block""", _BLOCKS))
def duplicate_blocks(spark, d):
    return duplicates.blocks(pc.products(spark, d)).groupBy("block").agg(
        F.count(F.lit(1)).alias("block_rows"))


@_query("candidate_pairs", tw.over("norm", """
SELECT count(*) AS candidate_pairs FROM keys x JOIN keys y
  ON x.row_idx < y.row_idx AND (x.a = y.a OR x.b = y.b)""", _BLOCKS))
def candidate_pairs(spark, d):
    return duplicates.candidate_counts(pc.products(spark, d))


@_query("model_rule_pairs", tw.over("clusters", """
SELECT x.mk AS model_key, any_value(n) AS product_count,
  count(*) FILTER (x.bk = y.bk OR x.bk = '' OR y.bk = '') AS pairs_same_brand,
  count(*) FILTER (x.bk <> y.bk AND x.bk <> '' AND y.bk <> '') AS pairs_other_brand
FROM model_keys x JOIN model_keys y ON x.mk = y.mk AND x.row_idx < y.row_idx AND x.mk <> ''
JOIN (SELECT mk, count(*) AS n FROM model_keys GROUP BY mk) c ON c.mk = x.mk GROUP BY x.mk"""))
def model_rule_pairs(spark, d):
    return duplicates.model_rule_counts(pc.products(spark, d))


@_query("token_sorted_names", tw.over("norm", r"""
SELECT row_idx, array_to_string(list_sort(list_filter(
  string_split_regex(lower(product_name), '\s+'), lambda w: w <> '')), ' ') AS sorted_name FROM norm"""))
def token_sorted_names(spark, d):
    return duplicates.with_keys(pc.products(spark, d)).select(
        "row_idx", F.col("ts").alias("sorted_name"))


@_query("similarity_to_block_head", tw.over("names", """
SELECT a AS head, b AS row_idx, score / 1000 AS similarity FROM to_head""", tw.name_scores("to_head", """
SELECT h.head AS a, n.row_idx AS b FROM compared n
JOIN (SELECT block, min(row_idx) AS head FROM compared GROUP BY block) h USING (block)
WHERE n.row_idx <> h.head""")))
def similarity_to_block_head(spark, d):
    """Each product against the first one of its brand and category block."""
    keyed = duplicates.with_keys(pc.products(spark, d)).withColumnRenamed("row_idx", "node")
    keyed = keyed.withColumn("block", F.get(duplicates.block_keys(
        F.col("bk"), F.col("ck"), F.col("mk")), F.lit(0)))
    heads = keyed.groupBy("block").agg(F.min("node").alias("node"))
    a = duplicates._side(keyed.join(heads, ["block", "node"], "left_semi"), "a", "block")
    b = duplicates._side(keyed, "b", "block")
    return duplicates.score_pairs(a.join(b, "block").where("a_node <> b_node")).select(
        F.col("a_node").alias("head"), F.col("b_node").alias("row_idx"), "similarity")


@_query("model_clusters", tw.over("clusters", "SELECT row_idx, centre FROM clusters"))
def model_clusters(spark, d):
    return pc.model_clusters(spark, d)


@_query("name_clusters", tw.over("name_clusters", "SELECT row_idx, centre FROM clusters"))
def name_clusters(spark, d):
    return pc.name_clusters(spark, d)


_FEED_BATCHES = 3


@_query("feed_clusters", tw.over("name_clusters", "SELECT row_idx, centre FROM clusters"))
def feed_clusters(spark, d):
    """The same clusters from a feed of batches, each against the stored centres; the last is sent twice."""
    rows = pc.products(spark, d)
    last = rows.agg(F.max("row_idx")).first()[0] or 0
    state, step = _fresh_folder(spark, "clusters"), last // _FEED_BATCHES + 1
    for batch in [*range(_FEED_BATCHES), _FEED_BATCHES - 1]:
        clusters.add_batch(rows.where(F.floor(F.col("row_idx") / step) == batch), state, batch)
    return clusters.clusters(spark, state)


@_query("name_cluster_members", tw.over("name_clusters", """
SELECT centre, row_idx, product_id, product_name, similarity, specs_summary FROM items"""))
def name_cluster_members(spark, d):
    return duplicates.duplicate_items(pc.products(spark, d), pc.name_clusters(spark, d)).select(
        "centre", "row_idx", "product_id", "product_name", "similarity", "specs_summary")


@_query("name_cluster_groups", tw.over("name_clusters", """
SELECT group_code, canonical_row_idx, canonical_product_id, canonical_name, similarity, members,
  'pending' AS status, cast(NULL AS varchar) AS resolution_notes FROM groups"""))
def name_cluster_groups(spark, d):
    return duplicates.duplicate_groups(duplicates.duplicate_items(
        pc.products(spark, d), pc.name_clusters(spark, d)))


@_query("cluster_members", tw.over("name_clusters", """
SELECT row_idx, centre, product_id, brand, model_number, similarity, specs_summary FROM items"""))
def cluster_members(spark, d):
    return pc.items(spark, d).select("row_idx", "centre", "product_id", "brand", "model_number",
                                     "similarity", "specs_summary")


@_query("duplicate_groups", tw.over("name_clusters", """
SELECT group_code, canonical_row_idx, canonical_product_id, canonical_name, similarity, members,
  'pending' AS status FROM groups"""))
def duplicate_groups(spark, d):
    return pc.groups(spark, d).select("group_code", "canonical_row_idx", "canonical_product_id",
                                      "canonical_name", "similarity", "members", "status")


@_query("group_listing", tw.over("all", """
SELECT g.group_code, round(g.similarity * 100, 1) AS group_similarity, i.row_idx, i.product_id,
  round(i.similarity * 100, 1) AS member_similarity, s.currency, s.quality_score
FROM groups g LEFT JOIN items i ON i.centre = g.canonical_row_idx
LEFT JOIN scored s ON s.row_idx = i.row_idx"""))
def group_listing(spark, d):
    return duplicates.group_listing(
        pc.groups(spark, d), pc.items(spark, d), pc.scored(spark, d)).select(
        "group_code", "group_similarity", "row_idx", "product_id", "member_similarity",
        "currency", "quality_score")


def _group_actions(spark, d):
    """Decisions on groups, derived from them: every third merged, every third ignored."""
    number = F.regexp_extract("group_code", "([0-9]+)", 1).cast("bigint")
    return pc.groups(spark, d).select("group_code", number.alias("n")).where("n % 3 < 2").select(
        "group_code", F.when(F.col("n") % 3 == 0, "merge").otherwise("ignore").alias("action"),
        F.lit(None).cast("string").alias("notes"), F.lit(1).alias("acted_at"))


_RESOLVED_GROUPS = """
resolved AS (SELECT *, cast(group_code[5:] AS bigint) % 3 AS r FROM groups)"""


@_query("group_counters", tw.over("name_clusters", """
SELECT count(*) AS total_groups, cast(sum(members) AS bigint) AS total_duplicate_items,
  count(*) FILTER (r = 2) AS pending_groups, count(*) FILTER (r = 0) AS merged_groups
FROM resolved""", _RESOLVED_GROUPS))
def group_counters(spark, d):
    return duplicates.group_counters(duplicates.resolve_groups(
        pc.groups(spark, d), _group_actions(spark, d)))


@_query("resolved_groups", tw.over("name_clusters", """
SELECT group_code, CASE r WHEN 0 THEN 'merged' WHEN 1 THEN 'ignored' ELSE 'pending' END AS status,
  CASE r WHEN 0 THEN 'Duplicate cluster marked as merged'
    WHEN 1 THEN 'Duplicate cluster marked as ignored' END AS resolution_notes
FROM resolved""", _RESOLVED_GROUPS))
def resolved_groups(spark, d):
    return duplicates.resolve_groups(pc.groups(spark, d), _group_actions(spark, d)).select(
        "group_code", "status", "resolution_notes")


@_query("catalog_without_merged", tw.over("name_clusters", """
SELECT row_idx, product_id FROM norm WHERE row_idx NOT IN (
  SELECT c.row_idx FROM clusters c JOIN resolved r ON r.canonical_row_idx = c.centre
  WHERE r.r = 0 AND c.row_idx <> c.centre)""", _RESOLVED_GROUPS))
def catalog_without_merged(spark, d):
    groups = duplicates.resolve_groups(pc.groups(spark, d), _group_actions(spark, d))
    return duplicates.without_merged(
        pc.products(spark, d).select("row_idx", "product_id"), groups,
        pc.name_clusters(spark, d))


# -- conflicts ---------------------------------------------------------------------------

_CONFLICT = ["row_idx", "other_row_idx", "product_id", "product_name", "model_number", "field",
             "source_a", "value_a", "source_b", "value_b", "severity", "explanation"]


@_query("conflicts", tw.over("conflicts", f"SELECT {', '.join(_CONFLICT)} FROM conflicts"))
def all_conflicts(spark, d):
    return pc.conflicts(spark, d).select(*_CONFLICT)


@_query("spec_conflicts_all_members", tw.over("conflicts", f"""
SELECT row_idx, field, min(other_row_idx) AS other_row_idx FROM spec GROUP BY row_idx, field""",
"seconds_all AS (SELECT centre, row_idx AS other FROM clusters WHERE row_idx <> centre)",
"spec AS (" + " UNION ALL ".join(
    tw._spec(f).replace("FROM seconds s", "FROM seconds_all s")
    for f in ("power", "voltage", "price")) + ")"))
def spec_conflicts_all_members(spark, d):
    return conflicts.spec_conflicts(
        pc.products(spark, d), pc.name_clusters(spark, d), pairs="all").select(
        "row_idx", "field", "other_row_idx")


@_query("conflict_rows", tw.over("conflicts", """
SELECT row_idx FROM conflicts UNION SELECT other_row_idx FROM conflicts"""))
def conflict_rows(spark, d):
    return conflicts.conflict_row_ids(pc.conflicts(spark, d))


# A third of the decisions of each row is the last one: see part_catalog.resolutions.
_ACTIONS = """
decided AS (SELECT *, ['accept_a', 'accept_b', 'keep_for_review'][(row_idx + 2) % 3 + 1] AS action
  FROM conflicts)"""


@_query("conflict_summary", tw.over("conflicts", """
SELECT count(*) AS total, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  count(*) AS pending, 0 AS resolved FROM conflicts"""))
def conflict_summary(spark, d):
    return conflicts.conflict_summary(pc.conflicts(spark, d)).withColumn(
        "resolved", F.col("resolved").cast("int"))


@_query("conflict_counts_by_status", tw.over("conflicts", """
SELECT action AS status, severity, count(*) AS conflict_count FROM decided GROUP BY ALL""",
                                             _ACTIONS))
def conflict_counts_by_status(spark, d):
    return conflicts.resolve_conflicts(
        pc.conflicts(spark, d), pc.resolutions(spark, d)).groupBy("status", "severity").agg(
        F.count(F.lit(1)).alias("conflict_count"))


@_query("conflict_page", tw.over("conflicts", """
SELECT row_idx, field, value_a, value_b FROM conflicts
WHERE severity = 'high' AND (product_name ILIKE '%red%' OR model_number ILIKE '%red%'
  OR field ILIKE '%red%') ORDER BY row_idx, field LIMIT 25"""))
def conflict_page(spark, d):
    page, _ = grid.conflict_list(
        conflicts.display(pc.conflicts(spark, d)), term="Red", severity="high")
    return page.select("row_idx", "field", "value_a", "value_b")


@_query("resolved_conflicts", tw.over("conflicts", """
SELECT row_idx, field, action AS status, CASE WHEN row_idx % 2 = 0 THEN 'checked'
  ELSE 'Resolved with action: ' || action END AS resolution_notes FROM decided""", _ACTIONS))
def resolved_conflicts(spark, d):
    return conflicts.resolve_conflicts(pc.conflicts(spark, d), pc.resolutions(spark, d)).select(
        "row_idx", "field", "status", "resolution_notes")


def _chosen(field: str) -> str:
    return (f"max(CASE WHEN field = '{field}' THEN CASE action WHEN 'accept_a' THEN value_a "
            "WHEN 'accept_b' THEN value_b END END)")


@_query("products_after_resolution", tw.over("conflicts", """
SELECT row_idx, coalesce(b, brand) AS brand, coalesce(p, power) AS power,
  coalesce(v, voltage) AS voltage, coalesce(try_cast(c AS double), price) AS price
FROM norm LEFT JOIN chosen USING (row_idx)""", _ACTIONS, f"""
chosen AS (SELECT row_idx, {_chosen('brand')} AS b, {_chosen('power')} AS p,
  {_chosen('voltage')} AS v, {_chosen('price')} AS c FROM decided GROUP BY row_idx)"""))
def products_after_resolution(spark, d):
    return conflicts.apply_resolutions(
        pc.products(spark, d).select("row_idx", "brand", "power", "voltage", "price"),
        pc.conflicts(spark, d), pc.resolutions(spark, d))


@_query("conflicts_per_source", tw.over("conflicts", """
SELECT source AS job_id, count(*) AS total, count(*) FILTER (c.severity = 'high') AS high
FROM conflicts c JOIN norm USING (row_idx) GROUP BY source"""))
def conflicts_per_source(spark, d):
    sources = pc.products(spark, d).select("row_idx", F.col("source").alias("job_id"))
    return conflicts.conflict_summary(
        pc.conflicts(spark, d).join(sources, "row_idx"), "job_id").select("job_id", "total", "high")


@_query("conflicts_per_product", tw.over("conflicts", """
SELECT row_idx, product_id, n_row + n_model - n_both AS conflict_count FROM (
  SELECT n.row_idx, n.product_id, coalesce(r.c, 0) AS n_row, coalesce(m.c, 0) AS n_model,
    coalesce(b.c, 0) AS n_both FROM norm n
  LEFT JOIN (SELECT row_idx, count(*) AS c FROM conflicts GROUP BY 1) r ON r.row_idx = n.row_idx
  LEFT JOIN (SELECT model_number, count(*) AS c FROM conflicts GROUP BY 1) m
    ON m.model_number = n.model_number
  LEFT JOIN (SELECT row_idx, model_number, count(*) AS c FROM conflicts GROUP BY 1, 2) b
    ON b.row_idx = n.row_idx AND b.model_number = n.model_number)"""))
def conflicts_per_product(spark, d):
    return conflicts.counts_per_product(pc.products(spark, d), pc.conflicts(spark, d)).select(
        "row_idx", "product_id", "conflict_count")


# -- gaps ------------------------------------------------------------------------------------

_GAPS = {"unilog_brand": f"NOT {tw.is_value('unilog')}", "e1_brand": f"NOT {tw.is_value('e1')}",
         "dib_brand": f"NOT {tw.is_value('dib')}", "price": "(price IS NULL OR price <= 0)",
         **{f: f"NOT {tw.is_value(f)}" for f in gaps.TEXT_GAPS}}


@_query("data_gaps", tw.over("norm", " UNION ALL ".join(
    f"SELECT {i} AS position, {tw.quote(n)} AS field_name, g_{f} AS missing_count, "
    f"round((total - g_{f}) / total * 100, 1) AS coverage_pct, {tw.quote(s)} AS status, "
    f"total AS total_products, {' + '.join('g_' + g for g in _GAPS)} AS total_data_gaps FROM counted"
    for i, (n, f, s) in enumerate(fv.GAP_ROWS)),
    "counted AS (SELECT count(*) AS total, " + ", ".join(
        f"count(*) FILTER ({c}) AS g_{f}" for f, c in _GAPS.items()) + " FROM norm)"))
def data_gaps(spark, d):
    return gaps.data_gaps(pc.products(spark, d), list(pc.COLUMNS))


@_query("gap_samples", tw.over("norm", f"""
SELECT row_idx, product_id, concat_ws(', ',
  CASE WHEN NOT {tw.is_value('brand')} THEN 'Brand Feed' END,
  CASE WHEN NOT {tw.is_value('power')} THEN 'Power Rating' END,
  CASE WHEN NOT {tw.is_value('voltage')} THEN 'Voltage Spec' END) AS missing_fields, source
FROM norm WHERE NOT {tw.is_value('brand')} OR NOT {tw.is_value('power')}
ORDER BY row_idx LIMIT 10"""))
def gap_samples(spark, d):
    return gaps.gap_samples(pc.products(spark, d)).select(
        "row_idx", "product_id", F.array_join("missing_fields", ", ").alias("missing_fields"),
        F.col("catalog_source").alias("source"))


_CONTEXT = "(product_name || ' ' || description || ' ' || part_desc)"


@_query("reconciliation", tw.over("norm", f"""
SELECT row_idx, target_field, evidence_source, inferred_value, confidence_pct FROM (
  SELECT row_idx, 'Brand / Manufacturer' AS target_field,
    'Inferred from Part Description: "' || coalesce(nullif(left(part_desc, 60), ''),
      left(product_name, 60)) || '..."' AS evidence_source,
    CASE {' '.join(f"WHEN regexp_matches({_CONTEXT}, {tw.quote(p)}, 'i') THEN {tw.quote(b)}"
                   for p, b in fv.BRAND_PATTERNS)} END AS inferred_value, 96 AS confidence_pct
  FROM norm WHERE NOT {tw.is_value('brand')}
  UNION ALL
  SELECT row_idx, 'Power Rating',
    'Extracted from specification text: "' || m || '"', {tw.power('m')}, 94
  FROM (SELECT row_idx, nullif(regexp_extract({_CONTEXT}, '([0-9]+(?:\\.[0-9]+)?)\\s*(?:kw|hp)',
      0, 'i'), '') AS m FROM norm WHERE NOT {tw.is_value('power')}))
WHERE inferred_value IS NOT NULL"""))
def reconciliation(spark, d):
    return gaps.reconciliation(pc.products(spark, d)).select(
        "row_idx", "target_field", "evidence_source", "inferred_value", "confidence_pct")


# -- enrichment ---------------------------------------------------------------------------

@_query("enrichment", tw.over("enrichment", """
SELECT row_idx, product_id, category, subcategory, brand, model_number, attributes,
  missing_attributes, normalized_description, keywords, 0.88::double AS confidence_score FROM enrichment"""))
def enrichment(spark, d):
    return pc.enrichment(spark, d).select(
        "row_idx", "product_id", "category", "subcategory", "brand", "model_number",
        F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(
            e["key"], F.lit("="), e["value"])), "; ").alias("attributes"),
        F.array_join("missing_attributes", "; ").alias("missing_attributes"),
        "normalized_description", F.array_join("commerce_keywords", "; ").alias("keywords"),
        "confidence_score")


_KEYS = "concat_ws('_', {})"


@_query("enrichment_reuse", tw.over("norm", f"""
SELECT count(*) AS total_requests, count(DISTINCT k) AS distinct_keys,
  count(*) - count(DISTINCT k) AS cache_hits,
  round((count(*) - count(DISTINCT k)) / count(*) * 100, 1) AS cache_hit_rate_pct
FROM (SELECT sha256({_KEYS.format(', '.join(enrich.SHORT_KEY))}) AS k FROM norm)"""))
def enrichment_reuse(spark, d):
    return enrich.reuse_stats(pc.products(spark, d), enrich.SHORT_KEY)


@_query("enriched_once_per_key", tw.over("enrichment", """
SELECT row_idx, product_id, category, normalized_description FROM enrichment"""))
def enriched_once_per_key(spark, d):
    return enrich.enrich_once_per_key(pc.products(spark, d), enrich.enrich).select(
        "row_idx", "product_id", "category", "normalized_description")


@_query("enrichment_first_rows", tw.over("enrichment", """
SELECT row_idx, brand, normalized_description FROM enrichment WHERE row_idx < 80"""))
def enrichment_first_rows(spark, d):
    return enrich.enrich(pc.products(spark, d), limit=80).select(
        "row_idx", "brand", "normalized_description")


@_query("enrichment_coverage", tw.over("enrichment", """
SELECT count(*) AS total_products, count(*) AS enriched_products, 100.0::double AS enrichment_coverage_pct,
  cast(sum(attribute_count) AS bigint) AS total_attributes_extracted,
  count(*) * 5 AS total_keywords_generated FROM enrichment"""))
def enrichment_coverage(spark, d):
    return enrich.coverage(pc.products(spark, d), pc.enrichment(spark, d))


@_query("enrichment_samples", tw.over("enrichment", """
SELECT row_idx, n.product_name, e.category AS predicted_category, 88.0::double AS confidence_score
FROM enrichment e JOIN norm n USING (row_idx) ORDER BY row_idx LIMIT 10"""))
def enrichment_samples(spark, d):
    return enrich.samples(pc.products(spark, d), pc.enrichment(spark, d)).select(
        "row_idx", "product_name", "predicted_category", "confidence_score")


@_query("enrichment_upsert", tw.over("enrichment", """
SELECT row_idx, brand, cast(CASE WHEN row_idx % 3 = 0 THEN 0.5 ELSE 0.88 END AS double) AS confidence_score
FROM enrichment"""))
def enrichment_upsert(spark, d):
    old = pc.enrichment(spark, d)
    renewed = old.where("row_idx % 3 = 0").withColumn("confidence_score", F.lit(0.5))
    return enrich.upsert(old, renewed).select("row_idx", "brand", "confidence_score")


@_query("attribute_lists", """
SELECT p_partkey, 'size=' || cast(p_size AS varchar) || ' mm; type=' || p_type AS attributes
FROM part""")
def attribute_lists(spark, d):
    entry = lambda n, v, u: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"),
                                     F.lit(u).cast("string").alias("unit"))
    listed = F.array(entry("type", F.lit("old"), None), entry("size", F.col("p_size"), "mm"),
                     entry("type", F.col("p_type"), None))
    made = pc.table(spark, d, "part").select(
        "p_partkey", enrich.attribute_map(listed).alias("m"))
    return made.select("p_partkey", F.array_join(F.transform(
        F.array_sort(F.map_entries("m")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ").alias("attributes"))


# -- grid ------------------------------------------------------------------------------------

_GRID = ["row_idx", "product_id", "product_name", "price", "quality_score", "validation_status"]


@_query("product_search", tw.over("scored", f"""
SELECT {', '.join(_GRID)} FROM scored WHERE product_name ILIKE '%blue_r%'
  OR model_number ILIKE '%blue_r%' OR brand ILIKE '%blue_r%' OR product_id ILIKE '%blue_r%'
  OR description ILIKE '%blue_r%'"""))
def product_search(spark, d):
    return grid.search(pc.scored(spark, d), "Blue_R").select(*_GRID)


#: Plain, with wildcards, too short for the index, frequent, without a hit, with a sign that SQL patterns escape by.
_TERMS = ["Blue_R", "steel", "SIEMENS", "e%brass", "-4", "%", "a", "PID-1000", "no such thing", "50\\", "rand#1", "promo *"]
_SEARCHED_SQL = " OR ".join(f"{c} ILIKE pattern" for c in grid.SEARCHED)


@_query("indexed_search", tw.over("scored", f"""
SELECT term, row_idx FROM scored, (SELECT term, concat('%', term, '%') AS pattern
  FROM (VALUES {', '.join(f"({tw.quote(t)})" for t in _TERMS)}) t(term)) WHERE {_SEARCHED_SQL}"""))
def indexed_search(spark, d):
    """Several terms against one index of the catalogue."""
    index, hits = _fresh_folder(spark, "index"), None
    search_index.build(pc.scored(spark, d).select("row_idx", *grid.SEARCHED), index)
    for term in _TERMS:
        one = search_index.search(spark, index, term).select(F.lit(term).alias("term"), "row_idx")
        hits = one if hits is None else hits.unionByName(one)
    return hits


@_query("deep_pages", """
SELECT * FROM (SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority,
  row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS total FROM orders)
WHERE (rank - 1) // 100 IN (0, (total - 1) // 200, (total - 1) // 100)""")
def deep_pages(spark, d):
    """The first, the middle and the last page of the orders by price, from the ranges that hold them."""
    target = _fresh_folder(spark, "pages")
    orders = pc.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority")
    pages.store(orders, target, "o_totalprice", True, "o_orderkey", range_rows=1 << 12)
    total, last = pages.page_info(spark, target, 100)
    shown = None
    for number in sorted({1, (total - 1) // 200 + 1, last}):
        one = pages.page(spark, target, number, 100, "o_totalprice", True, "o_orderkey")
        shown = one if shown is None else shown.unionByName(one)
    return shown.withColumn("total", F.lit(total).cast("long"))


@_query("product_page", tw.over("scored", f"""
SELECT {', '.join(_GRID)} FROM scored WHERE validation_status = 'warning'
  AND quality_score BETWEEN 60 AND 90 ORDER BY price DESC NULLS LAST, row_idx LIMIT 25 OFFSET 25"""))
def product_page(spark, d):
    page, _, _ = grid.grid(pc.scored(spark, d), category="All", status="warning", min_quality=60,
                           max_quality=90, sort_by="price", descending=True, number=2)
    return page.select(*_GRID)


@_query("page_count", tw.over("scored", """
SELECT count(*) AS total, cast(ceil(count(*) / 25) AS bigint) AS total_pages FROM scored
WHERE brand = 'SKF'"""))
def page_count(spark, d):
    return grid.page_info(grid.where_equal(pc.scored(spark, d), brand="SKF"))


@_query("sorted_orders_page", """
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200""")
def sorted_orders_page(spark, d):
    hits = grid.where_equal(pc.table(spark, d, "orders"), o_orderstatus="F")
    return grid.page(hits, 3, 100, "o_totalprice", True, "o_orderkey").select(
        "o_orderkey", "o_totalprice", "o_orderpriority")


@_query("category_facet", tw.over("norm", """
SELECT DISTINCT category FROM norm WHERE category <> ''"""))
def category_facet(spark, d):
    return grid.facet(pc.products(spark, d), "category")


@_query("brand_facet", tw.over("norm", "SELECT DISTINCT brand FROM norm WHERE brand <> ''"))
def brand_facet(spark, d):
    return grid.facet(pc.products(spark, d), "brand")


@_query("find_product", tw.over("norm", """
SELECT row_idx, product_id, model_number FROM norm WHERE product_id = 'PID-10042'
  OR model_number = 'PID-10042' ORDER BY row_idx LIMIT 1"""))
def find_product(spark, d):
    return grid.find_product(pc.products(spark, d), "PID-10042").select(
        "row_idx", "product_id", "model_number")


@_query("enriched_only", tw.over("all", "SELECT row_idx, ai_confidence FROM scored"))
def enriched_only(spark, d):
    return grid.where_enriched(pc.full(spark, d)).select("row_idx", "ai_confidence")


# -- reports ---------------------------------------------------------------------------------

@_query("mean_scores", tw.over("scored", f"SELECT {_MEANS} FROM scored"))
def mean_scores(spark, d):
    return reports.averages(pc.scored(spark, d))


@_query("ai_confidence", tw.over("all", """
SELECT round(avg(ai_confidence) * 100, 1) AS ai_confidence FROM scored"""))
def ai_confidence(spark, d):
    return reports.ai_confidence(pc.full(spark, d))


@_query("kpis", tw.over("scored", f"""
SELECT (SELECT count(*) FROM issues) AS total_validation_issues,
  (SELECT count(*) FROM issues WHERE issue_type = 'missing_value') AS missing_attributes,
  (SELECT count(*) FROM conflicts) AS conflicts_detected,
  (SELECT count(*) FROM groups) AS duplicate_groups,
  count(*) AS products_processed, {_MEANS} FROM scored"""))
def kpis(spark, d):
    return reports.kpis(pc.scored(spark, d), pc.issues(spark, d), pc.conflicts(spark, d),
                        pc.groups(spark, d))


@_query("category_distribution", tw.over("norm", """
SELECT category AS name, count(*) AS count FROM norm GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10"""))
def category_distribution(spark, d):
    return reports.category_distribution(pc.products(spark, d))


@_query("quality_histogram", tw.over("scored", f"SELECT {_BANDS} FROM scored"))
def quality_histogram(spark, d):
    return reports.quality_histogram(pc.scored(spark, d))


@_query("issues_by_field", tw.over("issues", """
SELECT field AS raw_field, count(*) AS count, CASE field """ + " ".join(
    f"WHEN {tw.quote(k)} THEN {tw.quote(v)}" for k, v in fv.FIELD_LABELS.items()) + f""" ELSE {tw.title('field')} END AS field
FROM issues GROUP BY field"""))
def issues_by_field(spark, d):
    return reports.issues_by_field(pc.issues(spark, d))


@_query("issues_by_type", tw.over("issues", f"""
SELECT {tw.title('issue_type')} AS type, count(*) AS count FROM issues GROUP BY 1"""))
def issues_by_type(spark, d):
    return reports.issues_by_type(pc.issues(spark, d))


@_query("issues_by_severity", tw.over("issues", """
SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM issues"""))
def issues_by_severity(spark, d):
    return reports.issues_by_severity(pc.issues(spark, d))


@_query("missing_attributes", tw.over("issues", """
SELECT count(*) AS missing_attributes FROM issues WHERE issue_type = 'missing_value'"""))
def missing_attributes(spark, d):
    return reports.missing_attributes(pc.issues(spark, d))


_STAGES = [("Uploaded", "t"), ("Parsed & Schema", "t"), ("Normalized", "t"),
           ("Deduplicated", "t - redundant"), ("Deduplicated (by groups)", "t - g"),
           ("AI Enriched", "t"), ("Validated", "v"), ("Commerce Ready", "r")]


@_query("funnel", tw.over("all", " UNION ALL ".join(
    f"SELECT {i} AS position, {tw.quote(n)} AS stage, {e} AS count, "
    f"round(({e}) / t * 100, 1) AS percentage FROM c" for i, (n, e) in enumerate(_STAGES)),
    """c AS (SELECT count(*) AS t,
  count(*) FILTER (validation_status = 'valid') AS v, count(*) FILTER (quality_score >= 70) AS r,
  (SELECT count(*) FROM clusters WHERE row_idx <> centre) AS redundant,
  (SELECT count(*) FROM groups) AS g FROM scored)"""))
def funnel(spark, d):
    return reports.funnel(pc.full(spark, d), pc.name_clusters(spark, d))


@_query("brand_breakdown", tw.over("scored", """
SELECT coalesce(nullif(brand, ''), 'Unknown') AS name, count(*) AS count,
  round(avg(quality_score), 1) AS avg_quality FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""))
def brand_breakdown(spark, d):
    return reports.brand_breakdown(pc.scored(spark, d))


@_query("supplier_breakdown", tw.over("scored", """
SELECT coalesce(nullif(supplier, ''), 'Direct') AS name, count(*) AS count,
  round(avg(quality_score), 1) AS avg_quality FROM scored GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"""))
def supplier_breakdown(spark, d):
    return reports.supplier_breakdown(pc.scored(spark, d))


@_query("confidence_histogram", tw.over("all", """
SELECT count(*) FILTER (ai_confidence >= 0.9) AS conf_90_100,
  count(*) FILTER (ai_confidence >= 0.8 AND ai_confidence < 0.9) AS conf_80_89,
  count(*) FILTER (ai_confidence >= 0.7 AND ai_confidence < 0.8) AS conf_70_79,
  count(*) FILTER (ai_confidence < 0.7) AS conf_below_70 FROM scored"""))
def confidence_histogram(spark, d):
    return reports.confidence_histogram(pc.full(spark, d))


# Events as jobs: one job per user, its rows the events, its duration their span.
def _jobs(spark, d):
    e = pc.table(spark, d, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(
        F.concat(F.lit("feed-"), F.min("event_id").cast("string"), F.lit(".csv")).alias("filename"),
        F.sum(F.length("props")).alias("file_size"), F.count(F.lit(1)).alias("total_rows"),
        (progress.seconds(F.max("ts")) - progress.seconds(F.min("ts"))).alias("duration_seconds"),
        F.when(F.max_by("event_type", F.struct("ts", "event_id")) == "error", F.lit("failed"))
        .when(F.count(F.lit(1)) % 2 == 0, F.lit("completed")).otherwise(F.lit("running"))
        .alias("status"),
        F.create_map(F.lit("conflicts_count"), F.count_if(F.col("event_type") == "error")
                     .cast("string"), F.lit("progress"), F.lit("40")).alias("stats"),
        F.min("ts").alias("created_at"))


@_query("job_throughput", """
SELECT cast(user_id AS varchar) AS job_id, count(*) AS total_rows,
  round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0.1), 1)
    AS products_per_second FROM events GROUP BY 1""")
def job_throughput(spark, d):
    return reports.throughput(_jobs(spark, d)).drop("duration_seconds")


@_query("job_status", """
SELECT job_id, status, cast(CASE WHEN status = 'completed' THEN 100 ELSE 40 END AS double)
    AS progress_percentage, conflicts, file_size, total_rows,
  CASE WHEN status = 'completed' THEN 'Processing complete' ELSE 'Processing catalog...' END
    AS message FROM (
  SELECT cast(user_id AS varchar) AS job_id, count(*) AS total_rows,
    cast(sum(length(props)) AS bigint) AS file_size,
    count(*) FILTER (event_type = 'error') AS conflicts,
    CASE WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'failed'
      WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'processing' END AS status
  FROM events GROUP BY 1)""")
def job_status(spark, d):
    return reports.job_status(_jobs(spark, d)).select(
        "job_id", "status", "progress_percentage", "conflicts", "file_size", "total_rows",
        "message")


@_query("category_scores", tw.over("scored", """
SELECT category, round(avg(quality_score), 1) AS quality,
  round(avg(completeness_score) * 100, 1) AS completeness,
  round(avg(validity_score) * 100, 1) AS validity FROM scored GROUP BY category"""))
def category_scores(spark, d):
    return reports.category_scores(pc.scored(spark, d))


@_query("source_scores", tw.over("scored", """
SELECT source AS name, count(*) AS product_count,
  round(count(*) / (SELECT count(*) FROM scored) * 100, 1) AS share_percentage,
  round(avg(quality_score), 1) AS quality_score,
  round(avg(completeness_score) * 100, 1) AS completeness_score,
  round(avg(validity_score) * 100, 1) AS validity_score,
  CASE WHEN avg(quality_score) >= 80 THEN 'High' ELSE 'Medium' END AS reliability_tier
FROM scored GROUP BY source"""))
def source_scores(spark, d):
    return reports.source_scores(pc.scored(spark, d))


_COVER = [("Technical Document / PDF", "technical_document <> ''"),
          ("Direct Product URL", "product_url <> ''"), ("Supplier ID / Master", "supplier <> ''"),
          ("Manufacturer / Brand Lineage", "brand <> ''"),
          ("Power / Voltage Specs", "power <> '' AND voltage <> ''")]


@_query("field_coverage", tw.over("norm", " UNION ALL ".join(
    f"SELECT {i} AS position, {tw.quote(n)} AS field, count(*) FILTER ({c}) AS populated, "
    f"round(count(*) FILTER ({c}) / count(*) * 100, 1) AS coverage_pct FROM norm"
    for i, (n, c) in enumerate(_COVER))))
def field_coverage(spark, d):
    return reports.field_coverage(pc.products(spark, d))


@_query("biggest_problems", tw.over("issues", """
SELECT severity, issue_type, field, count(*) AS count FROM issues GROUP BY ALL
ORDER BY count DESC, severity, issue_type, field LIMIT 10"""))
def biggest_problems(spark, d):
    return reports.biggest_problems(pc.issues(spark, d))


@_query("needs_review", tw.over("scored", """
SELECT s.row_idx, product_id, validation_status, quality_score, coalesce(n, 0) AS pending_conflicts
FROM scored s LEFT JOIN (SELECT row_idx, count(*) AS n FROM conflicts GROUP BY 1) c
  ON c.row_idx = s.row_idx WHERE validation_status <> 'valid' OR n > 0"""))
def needs_review(spark, d):
    return reports.needs_review(pc.scored(spark, d), pc.conflicts(spark, d))


@_query("least_complete_categories", tw.over("scored", """
SELECT category, round(avg(completeness_score) * 100, 1) AS completeness,
  count(*) AS product_count, coalesce(any_value(w.field), '') AS most_missing_field
FROM scored LEFT JOIN (
  SELECT category, field FROM (SELECT category, field, count(*) AS n FROM issues
    JOIN norm USING (row_idx) WHERE issue_type = 'missing_value' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, field) = 1) w USING (category)
GROUP BY category"""))
def least_complete_categories(spark, d):
    return reports.least_complete_categories(pc.scored(spark, d), pc.issues(spark, d))


@_query("supplier_conflicts", tw.over("conflicts", """
SELECT supplier, count(*) AS conflict_count,
  round(count(*) / (SELECT count(*) FROM conflicts) * 100, 1) AS share_pct
FROM conflicts JOIN norm USING (row_idx) GROUP BY supplier"""))
def supplier_conflicts(spark, d):
    return reports.supplier_conflicts(pc.products(spark, d), pc.conflicts(spark, d))


# -- reports from states that add up ------------------------------------------------------------

_UNITS = ", ".join(f"sum(cast(round({s} * {k}) AS bigint))::bigint AS {s}"
                   for s, k in report_states.SUMS.items())
_STATE_COUNTS = {
    "excellent": "quality_score >= 85", "good": "quality_score >= 70 AND quality_score < 85",
    "fair": "quality_score >= 50 AND quality_score < 70", "poor": "quality_score < 50",
    "conf_90_100": "ai_confidence >= 0.9", "conf_80_89": "ai_confidence >= 0.8 AND ai_confidence < 0.9",
    "conf_70_79": "ai_confidence >= 0.7 AND ai_confidence < 0.8", "conf_below_70": "ai_confidence < 0.7",
    "enriched": "ai_enriched", "valid": "validation_status = 'valid'", "ready": "quality_score >= 70",
    **{f"cover_{i}": c for i, (_, c) in enumerate(_COVER)}, **{f"gap_{f}": c for f, c in _GAPS.items()}}
_STATE_SUMS = (f"count(*) AS n, {_UNITS}, sum(cast(round(ai_confidence * 1000000) AS bigint))::bigint AS confidence, "
               + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _STATE_COUNTS.items()))
_NO_SUMS = ", ".join(f"0 AS {m}" for m in report_states.MEASURES if m != "n")


@_query("report_states", tw.over("all", " UNION ALL ".join(
    f"SELECT source AS job_id, '{dim}' AS dim, {value} AS a, '' AS b, '' AS c, '' AS d, {_STATE_SUMS} "
    "FROM scored GROUP BY ALL" for dim, value in [
        ("all", "''"), ("category", "category"), ("brand", "brand"), ("supplier", "supplier"),
        ("source", "source")]) + f"""
UNION ALL SELECT source, 'issue', severity, issue_type, field, category, {_STATE_SUMS}
FROM issues JOIN scored USING (row_idx) GROUP BY ALL
UNION ALL SELECT source, 'conflict', c.severity, c.status, c.field, supplier, count(*), {_NO_SUMS}
FROM (SELECT *, 'pending' AS status FROM conflicts) c JOIN norm USING (row_idx) GROUP BY ALL
UNION ALL SELECT source, 'cluster', CASE WHEN row_idx = centre THEN 'group' ELSE 'redundant' END, '', '',
  supplier, count(*), {_NO_SUMS} FROM clusters JOIN norm USING (row_idx) GROUP BY ALL"""))
def merged_states(spark, d):
    return report_states.merge(pc.states(spark, d))


# Each gives the rows of the report of its name, so it has that report's twin.
_STATE_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mean_scores": report_states.averages, "ai_confidence": report_states.ai_confidence,
    "kpis": report_states.kpis, "quality_histogram": report_states.histogram,
    "confidence_histogram": lambda s: report_states.histogram(s, reports.CONFIDENCE_BANDS),
    "category_distribution": lambda s: report_states.top_groups(s, "category", 10, "Uncategorized", False),
    "brand_breakdown": lambda s: report_states.top_groups(s, "brand", 10, "Unknown"),
    "supplier_breakdown": lambda s: report_states.top_groups(s, "supplier", 8, "Direct"),
    "issues_by_field": report_states.issues_by_field, "issues_by_type": report_states.issues_by_type,
    "issues_by_severity": report_states.issues_by_severity,
    "biggest_problems": report_states.biggest_problems, "funnel": report_states.funnel,
    "category_scores": report_states.category_scores, "source_scores": report_states.source_scores,
    "field_coverage": report_states.field_coverage, "data_gaps": report_states.data_gaps,
    "least_complete_categories": report_states.least_complete_categories,
    "supplier_conflicts": report_states.supplier_conflicts,
}


def _from_states(report):
    return lambda spark, d: report(pc.states(spark, d))


for _name, _report in _STATE_REPORTS.items():
    _query(f"{_name}_from_states", _SQL[_name])(_from_states(_report))


# The same scorecard over the large fact table: every line an offer of a part.
@_query("offer_scorecard", """
SELECT l_shipyear AS source, count(*) AS offers, count(*) FILTER (l_discount = 0) AS full_price,
  cast(sum(cast(l_extendedprice AS decimal(18, 2))) AS double) AS value
FROM (SELECT *, cast(year(l_shipdate) AS varchar) AS l_shipyear FROM lineitem) GROUP BY 1""")
def offer_scorecard(spark, d):
    return pc.table(spark, d, "lineitem").groupBy(
        F.year("l_shipdate").cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("offers"), F.count_if(F.col("l_discount") == 0).alias("full_price"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value"))


# -- detail and exports -------------------------------------------------------------------

@_query("product_detail", tw.over("all", """
SELECT s.row_idx, s.product_id, coalesce(nullif(s.brand, ''), 'Unbranded') AS brand,
  coalesce(nullif(s.power, ''), 'Not available') AS power, """ + _TRUST + """ AS trust_score,
  (SELECT count(*) FROM issues i WHERE i.row_idx = s.row_idx) AS issue_count,
  (SELECT count(*) FROM conflicts c WHERE c.row_idx = s.row_idx
    OR c.model_number = s.model_number) AS conflict_count, g.group_code, g.members,
  e.normalized_description
FROM scored s LEFT JOIN clusters c ON c.row_idx = s.row_idx
LEFT JOIN groups g ON g.canonical_row_idx = c.centre
JOIN enrichment e ON e.row_idx = s.row_idx WHERE s.row_idx = 42"""))
def product_detail(spark, d):
    chosen = grid.find_product(pc.scored(spark, d), "42")
    full = detail.product_detail(
        chosen, pc.issues(spark, d), pc.enrichment(spark, d), pc.items(spark, d),
        pc.groups(spark, d), pc.conflicts(spark, d), product_attributes(pc.products(spark, d)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return full.select(
        "row_idx", "product_id", "brand", "power", "trust_score",
        size("validation_issues").alias("issue_count"), size("conflicts").alias("conflict_count"),
        "duplicate_membership.group_code",
        F.col("duplicate_membership.total_duplicates_in_group").alias("members"),
        F.col("ai_intelligence.description").alias("normalized_description"))


@_query("group_membership", tw.over("name_clusters", """
SELECT c.row_idx, g.group_code, g.members AS total_duplicates_in_group
FROM clusters c JOIN groups g ON g.canonical_row_idx = c.centre"""))
def group_membership(spark, d):
    return detail.group_membership(pc.items(spark, d), pc.groups(spark, d)).select(
        "row_idx", "group_code", "total_duplicates_in_group")


@_query("enrichment_fallback", tw.over("enrichment", """
SELECT row_idx, CASE WHEN n.row_idx % 2 = 0 THEN e.category ELSE n.category END AS category,
  CASE WHEN n.row_idx % 2 = 0 THEN e.brand ELSE coalesce(nullif(n.brand, ''), 'Standard') END
    AS brand,
  CASE WHEN n.row_idx % 2 = 0 THEN e.normalized_description ELSE n.description END AS description
FROM norm n JOIN enrichment e USING (row_idx)"""))
def enrichment_fallback(spark, d):
    given = pc.enrichment(spark, d).where("row_idx % 2 = 0")
    return detail.enrichment_view(pc.products(spark, d), given).select(
        "row_idx", "ai_intelligence.category", "ai_intelligence.brand",
        "ai_intelligence.description")


# Of three rows one has a result, one a stored payload, one neither.
_PAYLOAD = """
payload AS (SELECT *, CASE WHEN row_idx % 3 = 1 THEN upper(category) END AS p_category,
  CASE WHEN row_idx % 3 = 1 AND row_idx % 2 = 0 THEN brand || ' Group' END AS p_brand,
  CASE WHEN row_idx % 3 = 1 THEN (row_idx % 100)::double END AS p_confidence FROM norm)"""


def _with_payload(spark, d):
    given = F.create_map(F.lit("category"), F.upper("category"), F.lit("confidence_score"),
                         (F.col("row_idx") % 100).cast("string"))
    named = F.map_concat(given, F.create_map(F.lit("brand"), F.concat("brand", F.lit(" Group"))))
    return pc.products(spark, d).withColumn("payload", F.when(F.col("row_idx") % 3 == 1, F.when(
        F.col("row_idx") % 2 == 0, named).otherwise(given)))


@_query("enrichment_payload", tw.over("enrichment", """
SELECT row_idx, CASE row_idx % 3 WHEN 0 THEN e.category ELSE
    coalesce(nullif(p_category, ''), nullif(n.category, ''), 'Industrial Equipment') END AS category,
  CASE row_idx % 3 WHEN 0 THEN e.brand ELSE
    coalesce(nullif(p_brand, ''), nullif(n.brand, ''), 'Standard') END AS brand,
  CASE row_idx % 3 WHEN 0 THEN 88.0 WHEN 1 THEN CASE WHEN p_confidence <= 1 THEN 100 * p_confidence
    ELSE p_confidence END END::double AS confidence
FROM payload n JOIN enrichment e USING (row_idx)""", _PAYLOAD))
def enrichment_payload(spark, d):
    given = pc.enrichment(spark, d).where("row_idx % 3 = 0")
    return detail.enrichment_view(_with_payload(spark, d), given, "payload").select(
        "row_idx", "ai_intelligence.category", "ai_intelligence.brand", "ai_intelligence.confidence")


@_query("best_values_payload", tw.over("enrichment", """
SELECT row_idx, CASE row_idx % 3 WHEN 0 THEN e.category ELSE coalesce(nullif(p_category, ''), n.category) END
    AS category,
  CASE row_idx % 3 WHEN 0 THEN e.brand ELSE coalesce(nullif(p_brand, ''), n.brand) END AS brand,
  CASE row_idx % 3 WHEN 0 THEN 0.88 ELSE coalesce(p_confidence, 0) END::double AS ai_confidence
FROM payload n JOIN enrichment e USING (row_idx)""", _PAYLOAD))
def best_values_payload(spark, d):
    given = pc.enrichment(spark, d).where("row_idx % 3 = 0")
    return enrich.best_values(_with_payload(spark, d), given, "payload").select(
        "row_idx", "category", "brand", "ai_confidence")


# -- changes to a stored job ------------------------------------------------------------------

def _changed(sql: str) -> str:
    """A stage of the twins over the products as the decisions leave them."""
    return re.sub(r"\bnorm\b", "changed", sql)


_OPEN = """n.row_idx IN (SELECT row_idx FROM decided WHERE action = 'keep_for_review'
  UNION SELECT other_row_idx FROM decided WHERE action = 'keep_for_review')"""
_DECIDED = [_ACTIONS, f"""
chosen AS (SELECT row_idx, {_chosen('brand')} AS b, {_chosen('power')} AS p,
  {_chosen('voltage')} AS v, {_chosen('price')} AS c FROM decided GROUP BY row_idx)""", """
changed AS MATERIALIZED (SELECT norm.* REPLACE (coalesce(b, brand) AS brand, coalesce(p, power) AS power,
  coalesce(v, voltage) AS voltage, coalesce(try_cast(c AS double), price) AS price)
FROM norm LEFT JOIN chosen USING (row_idx))""", _changed(tw.ISSUES), _changed(tw.scored(_OPEN)),
            _changed(tw.ENRICHMENT)]
_JOB = "7"


def _changed_job(spark, d) -> str:
    """Folder of the job after its decisions are stored and its products in conflict are enriched anew."""
    def build(spark, d):
        root = _fresh_folder(spark, "changes")
        for name, df in [
                ("products", pc.full(spark, d).drop("issues")), ("validation_issues", pc.issues(spark, d)),
                ("conflicts", pc.conflicts(spark, d)), ("duplicate_groups", pc.groups(spark, d)),
                ("enrichment", pc.enrichment(spark, d))]:
            sinks.write_table(df, root, name, _JOB)
        sinks.write_table(sinks.job_record(spark, _JOB, "part", 0, "completed", {"message": "stored"}, 0),
                          root, "jobs")
        actions = pc.resolutions(spark, d)
        changes.decide_conflicts(spark, root, _JOB, actions)
        changes.decide_groups(spark, root, _JOB, _group_actions(spark, d))
        changes.reenrich(spark, root, _JOB, actions)
        return root
    build.__name__ = "changed_job"
    return pc.remembered(build)(spark, d)


@_query("rescored_products", tw.over("conflicts", f"""
SELECT row_idx, brand, power, voltage, price, validation_status, {', '.join(_SCORES)} FROM scored""", *_DECIDED))
def rescored_products(spark, d):
    return changes.table(spark, _changed_job(spark, d), "products", _JOB).select(
        "row_idx", "brand", "power", "voltage", "price", "validation_status", *_SCORES)


@_query("reenriched_products", tw.over("conflicts", """
SELECT row_idx, brand, category, attribute_count, normalized_description FROM enrichment""", *_DECIDED))
def reenriched_products(spark, d):
    return changes.table(spark, _changed_job(spark, d), "enrichment", _JOB).select(
        "row_idx", "brand", "category", F.size("attributes").alias("attribute_count"),
        "normalized_description")


@_query("stored_decisions", tw.over("conflicts", """
SELECT row_idx, field, action AS status, value_a, value_b FROM decided""", *_DECIDED))
def stored_decisions(spark, d):
    return changes.table(spark, _changed_job(spark, d), "conflicts", _JOB).select(
        "row_idx", "field", "status", "value_a", "value_b")


@_query("job_record", tw.over("conflicts", """
SELECT 'stored' AS message, count(*) AS total_products, count(*) AS ai_enriched_count,
  (SELECT count(*) FROM conflicts) AS conflicts_count, (SELECT count(*) FROM groups) AS duplicate_groups_count,
  (SELECT count(*) FROM issues) AS validation_issues_count,
  round(avg(quality_score), 1) AS quality_score FROM scored""", *_DECIDED))
def job_record(spark, d):
    record = changes.table(spark, _changed_job(spark, d), "jobs", _JOB)
    counts = ["total_products", "ai_enriched_count", "conflicts_count", "duplicate_groups_count",
              "validation_issues_count"]
    return record.select("stats.message", *[F.col(f"stats.{c}").cast("bigint").alias(c) for c in counts],
                         F.col("stats.quality_score").cast("double").alias("quality_score"))


_EXPORT = {"product_id": "s.product_id", "brand": "e.brand", "category": "e.category",
           "subcategory": "e.subcategory", "ai_confidence": "88.0::double",
           "description": "e.normalized_description"}


@_query("catalog_export", tw.over("all", "SELECT " + ", ".join(
    f'{_EXPORT.get(f, "s." + f)} AS "{n}"' for n, f in fv.EXPORT_COLUMNS)
    + " FROM scored s JOIN enrichment e USING (row_idx)"))
def catalog_export(spark, d):
    return sinks.catalog_export(pc.scored(spark, d), pc.enrichment(spark, d))


@_query("whole_job", tw.over("all", """
SELECT s.row_idx, s.product_name, s.validation_status, s.quality_score, s.ai_enriched, i.centre, i.similarity,
  (SELECT count(*) FROM conflicts c WHERE c.row_idx = s.row_idx) AS conflict_count
FROM scored s LEFT JOIN items i ON i.row_idx = s.row_idx"""))
def whole_job(spark, d):
    """The job itself over the whole catalogue: per row its score, cluster and conflicts."""
    done = pipeline.run(pc.raw(spark, d), pc.MAPPING)
    conflicts_ = done.conflicts.groupBy("row_idx").agg(F.count(F.lit(1)).alias("conflict_count"))
    return done.products.select(
        "row_idx", "product_name", "validation_status", "quality_score", "ai_enriched").join(
        done.items.select("row_idx", "centre", "similarity"), "row_idx", "left").join(
        conflicts_, "row_idx", "left").fillna({"conflict_count": 0})


@_query("conflict_export", tw.over("conflicts", """
SELECT cast(row_idx AS varchar) || '/' || field AS "Conflict ID", product_name AS "Product Name",
  model_number AS "Model Number", field AS "Field", source_a AS "Source A", value_a AS "Value A",
  source_b AS "Source B", value_b AS "Value B", severity AS "Severity",
  explanation AS "AI Explanation", 'pending' AS "Status",
  cast(NULL AS varchar) AS "Resolution Notes" FROM conflicts"""))
def conflict_export(spark, d):
    return sinks.conflict_export(pc.conflicts(spark, d))


@_query("duplicate_export", tw.over("name_clusters", """
SELECT g.group_code AS "Group Code", 'pending' AS "Group Status",
  round(g.similarity * 100, 1) AS "Cluster Similarity %", g.canonical_name AS "Canonical Product",
  i.product_id AS "Product ID", i.product_name AS "Product Name", i.brand AS "Brand", i.model_number AS "Model Number", i.specs_summary AS "Specs Summary"
FROM items i JOIN groups g ON g.canonical_row_idx = i.centre"""))
def duplicate_export(spark, d):
    return sinks.duplicate_export(pc.groups(spark, d), pc.items(spark, d))


@_query("validation_export", tw.over("issues", """
SELECT cast(row_idx AS varchar) || '/' || field || '/' || issue_type AS "Issue ID",
  product_id AS "Product ID", field AS "Field", issue_type AS "Issue Type",
  severity AS "Severity", message AS "Message", raw_value AS "Raw Value" FROM issues"""))
def validation_export(spark, d):
    return sinks.validation_export(pc.issues(spark, d))


# -- progress -----------------------------------------------------------------------------------

_PROGRESS = """
SELECT job_id, last_event, processed, total, event_count, round(elapsed, 3) AS elapsed_seconds,
  speed, CASE WHEN processed > 0 AND total > processed AND speed > 0
    THEN round((total - processed) / speed, 1) ELSE 0.0 END AS eta_seconds,
  last_event IN ('pipeline_complete', 'pipeline_error') AS finished
FROM (SELECT *, CASE WHEN processed > 0 THEN round(processed / greatest(elapsed, 0.05), 1)
    ELSE 0.0 END AS speed FROM (
  SELECT user_id AS job_id, max_by(event_type, (ts, event_type, event_id)) AS last_event,
    max(event_id) AS processed, max(event_id) + 5000 AS total, count(*) AS event_count,
    epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS elapsed
  FROM events GROUP BY user_id))"""


def _event_feed(spark, d):
    return pc.table(spark, d, "events").select(
        F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("processed"),
        (F.col("event_id") + 5000).alias("total"), F.col("event_type").alias("event"), "event_id",
        "value")


@_query("job_progress", _PROGRESS)
def job_progress(spark, d):
    return progress.progress(_event_feed(spark, d))


@_query("job_log_tail", """
SELECT user_id AS job_id, event_id, event_type AS event, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS line FROM events
QUALIFY line <= 100""")
def job_log_tail(spark, d):
    return progress.log_tail(_event_feed(spark, d)).select("job_id", "event_id", "event", "line")


_WINDOWED = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS event,
  count(*) AS event_count,
  cast(round(sum(cast(value AS decimal(18, 4))), 2) AS double) AS value_sum
FROM events GROUP BY ALL"""


@_query("windowed_events", _WINDOWED)
def windowed_events(spark, d):
    return progress.windowed_counts(_event_feed(spark, d), "event", value="value").drop(
        "window_end")


@_query("windowed_events_stream", _WINDOWED)
def windowed_events_stream(spark, d):
    """The same windows computed by a stream over the folder, read back from its sink."""
    schema = pc.table(spark, d, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = progress.windowed_counts(
        feed.withColumnRenamed("event_type", "event"), "event", value="value")
    base = _fresh_folder(spark, "stream")
    progress.keep_latest(counts, f"{base}/result", f"{base}/state").awaitTermination()
    landed = spark.read.parquet(f"{base}/result")
    return progress.latest(landed, "window_start", "event").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


# Runs of a job end with a purchase or an error, or by twelve hours of silence.
_ENDS = ["purchase", "error"]
_PATIENCE, _LATE = 43_200, 21_600


def _runs_sql(upto: str) -> str:
    return f"""
WITH e AS (SELECT user_id AS job_id, epoch_us(ts) AS us, ts, event_id, event_type, {upto} AS upto FROM events),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {_PATIENCE * 1_000_000}
    AND lag(event_type) OVER w NOT IN ('purchase', 'error') THEN 0 ELSE 1 END AS begins
  FROM e WHERE us <= upto WINDOW w AS (PARTITION BY job_id ORDER BY us, event_id)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY job_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT job_id, min(ts) AS started, max(ts) AS updated, count(*) AS event_count, max(event_id) AS processed,
  max(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END) AS ended_by,
  CASE WHEN max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) = 1 THEN 'finished'
    WHEN max(us) + {_PATIENCE * 1_000_000} < max(upto) THEN 'stalled' ELSE 'open' END AS status
FROM n GROUP BY job_id, run"""


def _local_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "updated")})


@_query("job_runs", _runs_sql("(SELECT epoch_us(max(ts)) FROM events)"))
def job_runs(spark, d):
    return _local_times(runs.runs(_event_feed(spark, d), terminal=_ENDS, patience=_PATIENCE))


@_query("job_runs_stream", "SELECT * FROM (" + _runs_sql(
    f"(SELECT (epoch_us(max(ts)) // 1000 - {_LATE * 1000}) * 1000 - 1 FROM events)") + ") WHERE status <> 'open'")
def job_runs_stream(spark, d):
    """Finished and stalled runs by keyed state with timers; every second event near a file's end comes a file late."""
    events = pc.table(spark, d, "events")
    first, last = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                             F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at, step = F.unix_micros(F.col("ts").cast("timestamp")) - (first or 0), ((last or 0) - (first or 0)) // 3 + 1
    delayed = (F.col("event_id") % 2 == 0) & (F.pmod(at, F.lit(step)) >= step - _LATE * 1_000_000 // 2)
    part = F.floor(at / step) + F.when(delayed & (at < 2 * step), 1).otherwise(0)
    base = _fresh_folder(spark, "runs")
    for k in range(3):
        events.where(part == k).coalesce(1).write.parquet(f"{base}/in/{k}")
    feed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    found = runs.watch(feed.withColumn("processed", F.col("event_id")), f"{_LATE} seconds", job="user_id",
                       event="event_type", terminal=_ENDS, patience=_PATIENCE)
    found.writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _local_times(spark.read.schema(found.schema).parquet(f"{base}/out"))


# -- text corpora --------------------------------------------------------------------------------

#: Without one of these the queries over text corpora are left out, and no others.
_OPTIONAL = ("tidyshelf.llm", "tidyshelf.llm.queries", "corpus_pipeline", "xxhash", "zstandard", "tiktoken",
             "tokenizers", "public_tokenizers")


def _corpus_part(kind: str) -> dict:
    """What the optional modules for text corpora add; nothing where they are not installed."""
    added = {}
    for module in ("tidyshelf.llm.queries", "corpus_pipeline"):
        try:
            added |= getattr(importlib.import_module(module), kind)()
        except ModuleNotFoundError as missing:
            if missing.name not in _OPTIONAL:
                raise
    return added


# -- contract -----------------------------------------------------------------------------------

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: quality and status counts per category of the messy catalogue."""
    return _QUERIES["category_quality"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, folder of the tables)."""
    return dict(_QUERIES) | _corpus_part("queries")


def oracle_sql() -> dict[str, str]:
    """DuckDB text per query that SQL can express."""
    return dict(_SQL) | _corpus_part("oracle_sql")
