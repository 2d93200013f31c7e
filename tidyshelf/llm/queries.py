"""Registered queries of the subpackage and the SQL that asks the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidyshelf.llm import decontaminate, secret_scan
from tidyshelf.llm.frames import table
from tidyshelf.llm.hard_negatives import hard_negatives
from tidyshelf.llm.language_id import predict
from tidyshelf.llm.license_scan import license_scan
from tidyshelf.llm.ngram_join import jaccard_join
from tidyshelf.llm.packing import pack
from tidyshelf.llm.quality_rules import quality_rules
from tidyshelf.llm.simhash import near_duplicates
from tidyshelf.llm.suffix_dedup import repeats
from tidyshelf.llm.toxicity import toxicity
from tidyshelf.llm.url_filters import ALLOW, BLOCK, url_filter
from tidyshelf.llm.whitening import whiten
from tidyshelf.session import use_checkpoint_dir

URL_RULES = (
    ("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))


def op1_suffix_dedup(spark, d):
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeats(table(spark, d, "documents")).select(
        "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_packing(spark, d):
    return pack(table(spark, d, "documents"))


def op4_url_filters(spark, d):
    return url_filter(table(spark, d, "pages"), URL_RULES)


def op5_license_scans(spark, d):
    return license_scan(table(spark, d, "documents"))


def op6_quality_rules(spark, d):
    return quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))


def new_ledger(spark) -> str:
    """An empty ledger in the shared folder; a job that runs again and again keeps its own."""
    return f"{use_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"


def op7_secret_scans(spark, d):
    """A ledger that knows half of the blobs under all rules but the last; the scan of all rows reads the other half
    under every rule and the known half under the last one, and joins what either found to all rows."""
    docs, ledger = table(spark, d, "documents"), new_ledger(spark)
    secret_scan.update(docs.where(F.xxhash64(F.coalesce("text", F.lit(""))) < 0), ledger, secret_scan.RULES[:-1])
    found = secret_scan.scan(docs, ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    count = [F.size(F.filter(F.col("spans")["kind"], lambda kind: kind == rule.kind)).cast("long")
             .alias(f"n_{rule.kind}") for rule in secret_scan.BASE_RULES]
    return found.select(
        "doc_id", *count, F.sha2(secret_scan.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_text(F.col("spans")).alias("spans"))


def op8_simhash(spark, d):
    return near_duplicates(table(spark, d, "documents"))


def op9_decontamination(spark, d):
    return decontaminate.scan(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op10_language_id(spark, d):
    return predict(table(spark, d, "documents"))


def op11_hard_negatives(spark, d):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_ngram_jaccard(spark, d):
    return jaccard_join(table(spark, d, "documents"))


def op13_whitening(spark, d):
    return whiten(table(spark, d, "embeddings"))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_URL_SQL = rf"""
WITH split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_RULE_ROWS}),
numbered AS (SELECT row_number() OVER () AS n, * FROM split),
fits AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM numbered LEFT JOIN fits USING (n)"""


_MATCHES_SQL = " UNION ALL ".join(rf"""
SELECT n, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least,
  unnest(regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', 0)) AS whole,
  unnest(regexp_extract_all(t, '{rule.pattern.replace("'", "''")}', {rule.group})) AS part,
  unnest(string_split_regex(t, '{rule.pattern.replace("'", "''")}')) AS gap,
  unnest(range(1 + len(string_split_regex(t, '{rule.pattern.replace("'", "''")}')))) AS k
FROM d""" for rank, rule in enumerate(secret_scan.RULES))

_SECRET_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({_MATCHES_SQL}),
ends AS (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY n, rank ORDER BY k) AS "end"
  FROM matches WHERE whole IS NOT NULL),
spans AS (
  SELECT n, kind, rank, "end" - length(whole) AS start,
    concat(kind, ':', "end" - length(whole), ':', "end") AS span
  FROM ends WHERE length(part) >= least),
found AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
    count(*) FILTER (kind = 'hex') AS c,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(span, ',' ORDER BY start, rank) AS every
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN found USING (n)"""

_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_LEAK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS width
  FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM b)),
doc_windows AS (
  SELECT n, i, width, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT n, w, width, unnest(range(1, len(w) - width + 2)) AS i
    FROM d, (SELECT DISTINCT width FROM b) WHERE len(w) >= width)),
hits AS (SELECT n, i, width, item_id FROM doc_windows JOIN item_windows USING (width, win)),
words AS (SELECT n, count(DISTINCT p) AS n_hit
  FROM (SELECT n, unnest(range(i, i + width)) AS p FROM hits) GROUP BY n),
items AS (SELECT n, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids
  FROM hits GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)"""


_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS y
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.y, b.y)::bigint AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER best AS integer) AS rank, vec_id AS negative_id, positive_score,
  score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5"""

_JACCARD_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
links AS (
  SELECT a.k AS a, b.k AS b FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k
  JOIN sizes x ON x.k = a.k JOIN sizes y ON y.k = b.k
  GROUP BY a.k, b.k, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT k AS a, k AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other.doc_id) AS component_id,
  coalesce(max(m), 0) AS n_links
FROM d JOIN reach ON reach.a = d.k JOIN d other ON other.k = reach.b LEFT JOIN sizes ON sizes.k = d.k
LEFT JOIN (SELECT a, count(*) AS m FROM links GROUP BY a) l ON l.a = d.k
GROUP BY d.k, d.doc_id"""


def queries():
    return {f.__name__: f for f in (
        op1_suffix_dedup, op2_toxicity, op3_packing, op4_url_filters, op5_license_scans, op6_quality_rules, op7_secret_scans,
        op8_simhash, op9_decontamination, op10_language_id, op11_hard_negatives, op12_ngram_jaccard, op13_whitening)}


def oracle_sql():
    return {"op4_url_filters": _URL_SQL, "op7_secret_scans": _SECRET_SQL,
            "op9_decontamination": _LEAK_SQL, "op11_hard_negatives": _NEGATIVES_SQL,
            "op12_ngram_jaccard": _JACCARD_SQL}
