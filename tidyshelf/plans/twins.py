"""DuckDB texts of the part catalogue's pipeline, for checking results side by side.

Each text is one SELECT; the shared stages are common table expressions.
"""

from __future__ import annotations

from tidyshelf import fixed_values as fv
from tidyshelf.plans import part_catalog as pc


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words) -> str:
    return "(" + ", ".join(quote(w) for w in words) + ")"


def clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    return (f"CASE WHEN lower(trim({x})) IN {_in(fv.BLANK_WORDS)} THEN '' ELSE "
            f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) END")


def known_brand(x: str) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in fv.BRANDS.items())
    return f"CASE lower({x}) {whens} ELSE {x} END"


def _num(x: str, pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract(lower({x}), '{pattern}', 1), '') AS double)"


_N = "([0-9.]+)\\s*"
_POWER = [(_N + "(?:hp|horse\\s*power)", "round({v} * 0.7457, 2)", "kW"),
          (_N + "(?:w|watts)(?:[^a-z0-9_]|$)", "round({v} / 1000, 3)", "kW"),
          (_N + "(?:mw|megawatts)", "round({v} * 1000, 2)", "kW"),
          (_N + "kva", "{v}", "kVA"), (_N + "(?:kw|kilowatts)", "{v}", "kW"),
          ("^([0-9.]+)$", "{v}", "kW")]
_WEIGHT = [(_N + "(?:lbs?|pounds?)", "round({v} * 0.453592, 1)", "kg"),
           (_N + "(?:g|grams?)(?:[^a-z0-9_]|$)", "round({v} / 1000, 2)", "kg"),
           (_N + "(?:kg|kilograms?)", "{v}", "kg"), ("^([0-9.]+)$", "{v}", "kg")]


def _reading(x: str, table) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({x}), '{p}') THEN "
        f"coalesce(cast({f.format(v=_num(x, p))} AS varchar) || ' {u}', {x})" for p, f, u in table)
    return f"CASE {whens} ELSE {x} END"


def power(x: str) -> str:
    return _reading(x, _POWER)


def power_value(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({x}), '{p}') THEN {f.format(v=_num(x, p))}"
                     for p, f, _ in _POWER)
    return f"CASE {whens} END"


def weight(x: str) -> str:
    return _reading(x, _WEIGHT)


def voltage(x: str) -> str:
    kv = _N + "(?:kv|kilovolts)"
    v = "([0-9.\\-]+)\\s*(?:v(?:olts?)?|vac|vdc)"
    low = f"lower({x})"
    return (f"CASE WHEN regexp_matches({low}, '{kv}') THEN "
            f"cast(cast(trunc({_num(x, kv)} * 1000) AS bigint) AS varchar) || ' V' "
            f"WHEN regexp_matches({low}, '{v}') THEN regexp_extract({low}, '{v}', 1) || ' V' || "
            f"CASE WHEN contains({low}, 'dc') THEN ' DC' ELSE '' END || "
            f"CASE WHEN contains({low}, 'ac') THEN ' AC' ELSE '' END ELSE {x} END")


def frequency(x: str) -> str:
    low = f"lower({x})"
    return (f"CASE WHEN regexp_matches({low}, '50[\\s/]*60\\s*hz') THEN '50/60 Hz' "
            f"WHEN regexp_matches({low}, '50\\s*hz') THEN '50 Hz' "
            f"WHEN regexp_matches({low}, '60\\s*hz') THEN '60 Hz' "
            f"WHEN {low} IN ('dc', 'direct current') THEN 'DC' ELSE {x} END")


def rpm(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '[0-9]') THEN "
            f"regexp_extract({x}, '([0-9]+)', 1) || ' RPM' ELSE {x} END")


def dimensions(x: str) -> str:
    parts = f"regexp_extract_all({x}, '[0-9.]+')"
    low = f"lower({x})"

    def laid(f):
        return " || ' x ' || ".join(f(f"{parts}[{i}]") for i in (1, 2, 3)) + " || ' mm'"

    def scaled(k):
        return laid(lambda p: f"cast(cast(round_even(try_cast({p} AS double) * {k}, 0) AS bigint)"
                              " AS varchar)")

    raw = laid(lambda p: p)
    return (f"CASE WHEN len({parts}) < 3 THEN {x} "
            f"WHEN contains({x}, '\"') OR contains({low}, 'inch') "
            f"THEN coalesce({scaled(25.4)}, {raw}) "
            f"WHEN contains({low}, 'cm') THEN coalesce({scaled(10.0)}, {raw}) ELSE {raw} END")


def ip(x: str) -> str:
    p = "ip\\s*([0-9][0-9][a-z]?)"
    return (f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN "
            f"'IP' || upper(regexp_extract(lower({x}), '{p}', 1)) "
            f"WHEN contains(lower({x}), 'ex d') THEN upper({x}) ELSE {x} END")


def price(x: str) -> str:
    digits = f"replace(regexp_extract({x}, '([0-9.,]+)', 1), ',', '')"
    value = f"round(try_cast(nullif({digits}, '') AS double), 2)"
    return (f"CASE WHEN regexp_matches({x}, '^\\s*[$€£]?\\s*-\\s*[$€£]?\\s*[0-9.,]') "
            f"THEN -({value}) ELSE {value} END")


def currency(p: str, c: str) -> str:
    whens = " ".join(f"WHEN contains({p}, '{s}') OR {c} = '{s}' THEN '{n}'"
                     for s, n in (("$", "USD"), ("€", "EUR"), ("£", "GBP")))
    return f"CASE {whens} WHEN {c} = '' THEN 'USD' ELSE upper({c}) END"


def key(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^a-zA-Z0-9]', '', 'g'))"


def compare(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(trim({x})), '\\s+', ' ', 'g'), "
            f"'[^\\w\\s.\\-]', '', 'g'))")


def is_value(x: str) -> str:
    return f"(lower(trim({x})) NOT IN {_in(fv.PLACEHOLDER_WORDS)})"


def title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


_FIRST_BRAND = ["Brand_Name", "E1_Brand", "Unilog_Brand", "Dib_Brand"]

_CLEANED = ", ".join(f"{clean(e)} AS {c}" for c, e in {
    "c_id": "Item_Code", "c_name": "Item_Title", "c_desc": "Part_Desc",
    "c_brand": "Brand_Name", "c_cat": "Category", "c_sub": "Sub_Category", "c_model": "Model",
    "c_curr": "Curr", "c_power": "Power", "c_volt": "Voltage", "c_freq": "Freq",
    "c_rpm": "Speed", "c_weight": "Weight", "c_dim": "Dimensions", "c_mat": "Material",
    "c_ip": "IP_Rating", "c_war": "Warranty", "c_country": "Country", "c_sup": "Supplier",
    "c_src": "Source", "c_doc": "Datasheet", "c_url": "URL"}.items())

_PROMO = r"trim(regexp_replace(c_desc, '\*{2,}[^*]+\*{2,}', '', 'g'))"

RAW = f"raw AS MATERIALIZED ({pc.raw_sql()})"

# The only brand keys of the lookup list that exist are the mapped brand itself, so
# brand and manufacturer are the same value here.
NORM = f"""
cleaned AS MATERIALIZED (SELECT *, {_CLEANED} FROM raw),
named AS MATERIALIZED (
  SELECT *, {known_brand('c_brand')} AS brand, {_PROMO} AS p_desc FROM cleaned),
titled AS MATERIALIZED (
  SELECT *, CASE WHEN c_name <> '' THEN c_name
    WHEN p_desc <> '' THEN CASE WHEN length(trim(split_part(p_desc, '.', 1))) > 5
      THEN left(trim(split_part(p_desc, '.', 1)), 90) ELSE left(p_desc, 90) END
    WHEN brand <> '' AND c_model <> '' THEN trim(brand || ' ' || c_model)
    WHEN coalesce(nullif(c_model, ''), c_id) <> ''
      THEN 'Industrial Component ' || coalesce(nullif(c_model, ''), c_id)
    ELSE 'Industrial Equipment Component' END AS product_name FROM named),
norm AS MATERIALIZED (
  SELECT row_idx,
    CASE WHEN c_id <> '' THEN c_id ELSE 'PID-' || cast(10000 + row_idx AS varchar) END
      AS product_id,
    c_model AS mpn, '' AS sku, product_name, brand, brand AS manufacturer, c_sup AS supplier,
    CASE WHEN c_cat <> '' THEN c_cat ELSE 'Industrial Equipment' END AS category,
    c_sub AS subcategory, c_model AS model_number,
    CASE WHEN p_desc <> '' THEN p_desc
      ELSE product_name || '. Certified industrial component specification.' END AS description,
    {currency('Price', 'c_curr')} AS currency, {voltage('c_volt')} AS voltage,
    {power('c_power')} AS power, {power_value('c_power')} AS power_kw,
    {frequency('c_freq')} AS frequency, {rpm('c_rpm')} AS rpm, {weight('c_weight')} AS weight,
    {dimensions('c_dim')} AS dimensions, c_mat AS material, {ip('c_ip')} AS ip_rating,
    c_war AS warranty, c_country AS country,
    CASE WHEN c_src <> '' THEN c_src ELSE 'Uploaded Catalog' END AS source,
    c_doc AS technical_document,
    CASE WHEN c_url <> '' AND NOT starts_with(c_url, 'http://')
      AND NOT starts_with(c_url, 'https://') AND contains(c_url, '.') AND contains(c_url, '/')
      THEN 'https://' || c_url ELSE c_url END AS product_url,
    {price('Price')} AS price,
    trim(Price) AS raw_price, trim(E1_Brand) AS e1, trim(Unilog_Brand) AS unilog,
    trim(Brand_Name) AS brand_name, trim(Dib_Brand) AS dib, trim(Part_Desc) AS part_desc,
    Finish, Lead_Time
  FROM titled)"""


def _issue(condition, field, kind, severity, message, raw="NULL"):
    return (f"SELECT row_idx, product_id, '{field}' AS field, '{kind}' AS issue_type, "
            f"'{severity}' AS severity, {message} AS message, "
            f"cast({raw} AS varchar) AS raw_value FROM norm WHERE {condition}")


def url_ok(x: str) -> str:
    return f"regexp_matches({x}, {quote(fv.URL_PATTERN)})"


ISSUES = "issues AS MATERIALIZED (" + " UNION ALL ".join([
    _issue("product_id = ''", "product_id", "missing_value", "high", quote(fv.MSG_ID)),
    _issue("length(product_name) < 3", "product_name", "missing_value", "high",
           quote(fv.MSG_NAME), "product_name"),
    _issue("category = ''", "category", "missing_value", "high", quote(fv.MSG_CATEGORY)),
    _issue("brand = ''", "brand", "missing_value", "medium", quote(fv.MSG_BRAND)),
    _issue("price IS NULL", "price", "missing_value", "low", quote(fv.MSG_NO_PRICE), "''"),
    _issue("price < 0", "price", "out_of_range", "high",
           f"{quote(fv.MSG_NEGATIVE)} || cast(price AS varchar)", "price"),
    _issue("power <> '' AND NOT regexp_matches(lower(power), 'kw|w|kva|hp|mw')", "power",
           "unit_mismatch", "medium", f"{quote(fv.MSG_POWER)} || power", "power"),
    _issue("voltage <> '' AND NOT contains(lower(voltage), 'v')", "voltage", "invalid_format",
           "low", f"{quote(fv.MSG_VOLTAGE)} || voltage", "voltage"),
    _issue(f"ip_rating <> '' AND NOT regexp_matches(ip_rating, {quote(fv.IP_PATTERN)}) "
           "AND NOT starts_with(ip_rating, 'EX')", "ip_rating", "invalid_format", "low",
           f"{quote(fv.MSG_IP)} || ip_rating", "ip_rating"),
    _issue(f"product_url <> '' AND NOT {url_ok('product_url')}", "product_url",
           "invalid_url", "low", f"{quote(fv.MSG_URL)} || product_url", "product_url"),
    _issue(f"technical_document <> '' AND NOT {url_ok('technical_document')}",
           "technical_document", "invalid_url", "low",
           f"{quote(fv.MSG_DOC)} || technical_document", "technical_document"),
    _issue("length(description) < 20", "description", "missing_value", "low",
           quote(fv.MSG_DESCRIPTION), "description"),
]) + ")"

CLUSTERS = f"""
model_keys AS MATERIALIZED (SELECT row_idx, {key('model_number')} AS mk, {key('brand')} AS bk
  FROM norm),
clusters AS MATERIALIZED (
  SELECT row_idx, min(row_idx) OVER (PARTITION BY mk) AS centre FROM model_keys WHERE mk <> ''
  QUALIFY count(*) OVER (PARTITION BY mk) > 1)"""

# Names: the longest common subsequence of two names is found bit by bit. A name is a map from its
# characters to the places they stand at, as bits of one integer; a text then runs over that state.

_SORTED_NAME = (r"array_to_string(list_sort(list_filter(string_split_regex(lower(product_name), "
                r"'\s+'), lambda w: w <> '')), ' ')")


def _lcs(masks: str, size: str, text: str) -> str:
    full = f"((1::hugeint << {size}::hugeint) - 1)"
    return (f"({size} - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({text}, ''), "
            f"lambda c: coalesce({masks}[c], 0::hugeint))), "
            f"lambda s, u: ((s + (s & u)) | (s & ~u)) & {full})))")


NAMES = f"""
compared AS MATERIALIZED (
  SELECT *, min(row_idx) OVER (PARTITION BY bk, ck, mk, nm) AS node,
    left(bk, 6) || '|' || left(ck, 6) AS block, nullif(left(mk, 5), '') AS model_block
  FROM (SELECT row_idx, {key('brand')} AS bk, {key('category')} AS ck, {key('model_number')} AS mk,
    lower(product_name) AS nm, {_SORTED_NAME} AS ts FROM norm)),
nodes AS MATERIALIZED (SELECT * FROM compared WHERE row_idx = node AND (mk <> '' OR nm <> '')),
letters AS MATERIALIZED (
  SELECT s, map_from_entries(list({{'k': c, 'v': bits}})) AS m FROM (
    SELECT s, s[i] AS c, sum(1::hugeint << (i - 1)::hugeint)::hugeint AS bits FROM (
      SELECT s, unnest(range(1, length(s) + 1)) AS i
      FROM (SELECT nm AS s FROM compared UNION SELECT ts FROM compared)) GROUP BY s, c) GROUP BY s)"""


def name_scores(out: str, pairs: str, floor: float = 0.0) -> str:
    """Table ``out`` (a, b, score in thousandths) of the pairs of rows (a, b) that reach the floor."""
    boost = "(x.bk <> '' AND x.bk = y.bk AND x.ck = y.ck)"
    # DuckDB's least() skips NULL, so a pair without a partial ratio is kept out of it.
    blend = ("cast(round_even(1000 * CASE WHEN {p} IS NULL THEN NULL WHEN boost THEN least(1.0::double, (0.7::double * token + 0.3::double * {p}) "
             "* 1.08::double) ELSE 0.7::double * token + 0.3::double * {p} END, 0) AS bigint)")
    least = round(floor * 1000)
    return f"""
{out}_keyed AS MATERIALIZED (
  SELECT p.a, p.b, x.nm AS na, y.nm AS nb, x.ts AS ta, y.ts AS tb, {boost} AS boost,
    CASE WHEN x.mk <> '' AND x.mk = y.mk THEN
      CASE WHEN x.bk = y.bk OR x.bk = '' OR y.bk = '' THEN 950 ELSE 850 END END AS rule
  FROM ({pairs}) p JOIN compared x ON x.row_idx = p.a JOIN compared y ON y.row_idx = p.b),
{out}_tokens AS MATERIALIZED (
  SELECT na, nb, ta, tb, 2.0::double * {_lcs('l.m', 'length(ta)', 'tb')} / (length(ta) + length(tb)) AS token
  FROM (SELECT DISTINCT na, nb, ta, tb FROM {out}_keyed WHERE rule IS NULL AND na <> '' AND nb <> '') k
  JOIN letters l ON l.s = k.ta),
{out}_hopeful AS MATERIALIZED (
  SELECT DISTINCT na, nb FROM {out}_keyed k JOIN {out}_tokens USING (na, nb, ta, tb)
  WHERE k.rule IS NULL AND {blend.format(p='1.0::double')} >= {least}),
{out}_ways AS (
  SELECT na, nb, CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS short,
    CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS long FROM {out}_hopeful
  UNION SELECT na, nb, nb, na FROM {out}_hopeful WHERE length(na) = length(nb)),
{out}_windows AS (
  SELECT *, length(short) AS size, greatest(step - length(short), 0) AS lo, least(step, length(long)) AS hi
  FROM (SELECT *, unnest(range(1, length(long) + length(short))) AS step FROM {out}_ways)),
{out}_partial AS MATERIALIZED (
  SELECT na, nb, max(2.0::double * {_lcs('l.m', 'size', 'substr(long, lo + 1, hi - lo)')} / (size + hi - lo)) AS partial
  FROM {out}_windows JOIN letters l ON l.s = short GROUP BY na, nb),
{out} AS MATERIALIZED (
  SELECT a, b, coalesce(rule, {blend.format(p='partial')}, 0) AS score
  FROM {out}_keyed LEFT JOIN {out}_tokens USING (na, nb, ta, tb) LEFT JOIN {out}_partial USING (na, nb)
  WHERE coalesce(rule, {blend.format(p='partial')}, 0) >= {least})"""


NAME_CLUSTERS = NAMES + "," + name_scores("edges", """
  SELECT x.node AS a, y.node AS b FROM nodes x JOIN nodes y ON x.block = y.block AND x.node < y.node
  UNION SELECT x.node, y.node FROM nodes x JOIN nodes y ON x.model_block = y.model_block AND x.node < y.node""",
                                                  0.80) + """,
turns AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY node) AS i, node, near FROM (
    SELECT node, list(e.a) FILTER (e.a IS NOT NULL) AS near
    FROM (SELECT a AS node FROM edges UNION SELECT b FROM edges) LEFT JOIN edges e ON e.b = node GROUP BY node)),
walk AS (
  SELECT 0::bigint AS i, []::bigint[] AS centres, NULL::bigint AS node, NULL::bigint AS centre
  UNION ALL
  SELECT i, CASE WHEN found IS NULL THEN list_append(centres, node) ELSE centres END, node, found FROM (
    SELECT t.i, w.centres, t.node::bigint AS node, list_min(list_filter(t.near, lambda x: list_contains(w.centres, x)))::bigint AS found
    FROM walk w JOIN turns t ON t.i = w.i + 1)),
clusters AS MATERIALIZED (
  SELECT row_idx, centre FROM (
    SELECT row_idx, coalesce(w.centre, n.node) AS centre FROM compared n
    LEFT JOIN (SELECT node, centre FROM walk WHERE node IS NOT NULL) w USING (node) WHERE n.mk <> '' OR n.nm <> '')
  QUALIFY count(*) OVER (PARTITION BY centre) > 1),""" + name_scores(
    "likeness", "SELECT centre AS a, row_idx AS b FROM clusters") + """,
items AS MATERIALIZED (
  SELECT c.row_idx, c.centre, CASE WHEN c.row_idx = c.centre THEN 1000 ELSE l.score END AS thousandths,
    CASE WHEN c.row_idx = c.centre THEN 1.0 ELSE floor((l.score + 5) / 10.0) / 100 END::double AS similarity,
    n.product_id, n.product_name, n.brand, n.model_number, n.price, n.power, n.voltage, n.source,
    'Power: ' || n.power || ', Voltage: ' || n.voltage || ', Price: '
      || coalesce(cast(n.price AS varchar), 'None') AS specs_summary
  FROM clusters c JOIN likeness l ON l.a = c.centre AND l.b = c.row_idx JOIN norm n ON n.row_idx = c.row_idx),
groups AS MATERIALIZED (
  SELECT centre AS canonical_row_idx, 'DUP-' || lpad(cast(row_number() OVER (ORDER BY centre)
    AS varchar), 4, '0') AS group_code,
    max(CASE WHEN row_idx = centre THEN product_id END) AS canonical_product_id,
    max(CASE WHEN row_idx = centre THEN product_name END) AS canonical_name,
    (floor((max(CASE WHEN row_idx <> centre THEN thousandths END) + 5) / 10.0) / 100)::double AS similarity,
    count(*) AS members FROM items GROUP BY centre)"""

_FEEDS = [("brand_name", "Brand Name"), ("e1", "E1 Brand"), ("unilog", "Unilog Brand"),
          ("dib", "Dib Brand")]
# Leftovers come first: the later brand columns, whenever an earlier one has a value.
_LEFT = {
    "e1": "brand_name <> ''", "unilog": "(brand_name <> '' OR e1 <> '')",
    "dib": "(brand_name <> '' OR e1 <> '' OR unilog <> '')", "brand_name": "false"}


def _feed_list() -> str:
    def entry(c, label, left):
        cond = f"({_LEFT[c]})" if left else f"NOT ({_LEFT[c]})"
        return (f"CASE WHEN {cond} AND {is_value(c)} THEN "
                f"{{'s': '{label}', 'v': {c}, 'c': {compare(c)}}} END")
    parts = [entry(c, l, True) for c, l in _FEEDS] + [entry(c, l, False) for c, l in _FEEDS]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


_SHOWN_MODEL = "coalesce(nullif(model_number, ''), nullif(mpn, ''), 'N/A')"


def _spec(field: str) -> str:
    col = "coalesce(cast({s}.price AS varchar), '')" if field == "price" else "{s}." + field
    va, vb = col.format(s="a"), col.format(s="b")
    severity = "medium" if field == "price" else "high"
    note = (f"'Commercial pricing variance: ' || {va} || ' vs ' || {vb} || "
            "' across vendor catalog feeds.'" if field == "price" else
            f"'Critical specification mismatch: Source A lists ''' || {va} || ''' vs Source B at '''"
            f" || {vb} || ''' for model ' || a.model_number || '.'")
    return f"""
  SELECT a.row_idx, b.row_idx AS other_row_idx, a.product_id, a.product_name,
    coalesce(nullif(a.model_number, ''), nullif(a.mpn, ''), 'N/A') AS model_number,
    '{field}' AS field, a.source AS source_a, {va} AS value_a,
    CASE WHEN a.source = b.source THEN b.source || ' (Datasheet 2)' ELSE b.source END AS source_b,
    {vb} AS value_b, '{severity}' AS severity, {note} AS explanation
  FROM seconds s JOIN norm a ON a.row_idx = s.centre JOIN norm b ON b.row_idx = s.other
  WHERE {is_value(va)} AND {is_value(vb)} AND {compare(va)} <> {compare(vb)}"""


CONFLICTS = f"""
feeds AS MATERIALIZED (SELECT *, {_feed_list()} AS f FROM norm),
disagree AS MATERIALIZED (
  SELECT *, f[1] AS a, list_filter(f, lambda x: x.c <> f[1].c)[1] AS b FROM feeds WHERE len(f) > 1),
seconds AS MATERIALIZED (
  SELECT centre, min(row_idx) AS other FROM clusters WHERE row_idx <> centre GROUP BY centre),
conflicts AS MATERIALIZED (
  SELECT row_idx, row_idx AS other_row_idx, product_id, product_name,
    {_SHOWN_MODEL} AS model_number, 'brand' AS field, a.s AS source_a, a.v AS value_a,
    b.s AS source_b, b.v AS value_b, 'high' AS severity,
    'Multi-source brand disagreement: ' || a.s || ' reports ''' || a.v || ''' whereas ' || b.s
      || ' lists ''' || b.v || '''.' AS explanation
  FROM disagree WHERE b IS NOT NULL
  UNION ALL {' UNION ALL '.join(_spec(f) for f in ('power', 'voltage', 'price'))})"""

_CORE = " + ".join(
    f"CASE WHEN {'coalesce(price, 0) <> 0' if f == 'price' else f + chr(32) + '<> ' + chr(39) * 2}"
    " THEN 1 ELSE 0 END" for f in fv.CORE_FIELDS)


def scored(hit: str) -> str:
    return f"""
tallies AS MATERIALIZED (
  SELECT row_idx, count(*) FILTER (severity = 'high') AS h,
    count(*) FILTER (severity = 'medium') AS m, count(*) FILTER (severity = 'low') AS l
  FROM issues GROUP BY row_idx),
rated AS MATERIALIZED (
  SELECT n.*, CASE WHEN coalesce(h, 0) > 0 THEN 'invalid' WHEN coalesce(m, 0) > 0 THEN 'warning'
      ELSE 'valid' END AS validation_status,
    round(({_CORE}) / 15.0, 3) AS completeness_score,
    cast(greatest(0.0, round(1 - (0.35 * coalesce(h, 0) + 0.15 * coalesce(m, 0)
      + 0.05 * coalesce(l, 0)), 3)) AS double) AS validity_score,
    cast(round(1 - 0.2 * ((power <> '' AND NOT contains(power, 'W') AND NOT contains(power, 'kVA'))::int
      + (voltage <> '' AND NOT contains(voltage, 'V'))::int + (brand = '')::int), 3)
      AS double) AS consistency_score,
    cast(CASE WHEN {hit} THEN 0.6 ELSE 1.0 END AS double) AS source_agreement_score
  FROM norm n LEFT JOIN tallies USING (row_idx)),
scored AS MATERIALIZED (
  SELECT *, floor((35 * cast(round(completeness_score * 1000) AS bigint)
      + 35 * cast(round(validity_score * 1000) AS bigint)
      + 20 * cast(round(consistency_score * 1000) AS bigint)
      + 10 * cast(round(source_agreement_score * 1000) AS bigint) + 50) / 100.0) / 10
      AS quality_score, true AS ai_enriched, 0.88::double AS ai_confidence FROM rated)"""


HIT = ("n.row_idx IN (SELECT row_idx FROM conflicts UNION SELECT other_row_idx FROM conflicts)")

_E_ATTR = " + ".join(f"({f} <> '')::int" for _, f in fv.ENRICHED_ATTRIBUTES)


def _listing(pairs, op) -> str:
    return ", ".join(f"CASE WHEN {f} {op} '' THEN {v} END" for v, f in pairs)


ENRICHMENT = f"""
enriched AS MATERIALIZED (
  SELECT row_idx, product_id, coalesce(nullif(category, ''), 'Industrial Equipment') AS category,
    coalesce(nullif(subcategory, ''), 'Standard Component') AS subcategory,
    coalesce(nullif(brand, ''), 'Industrial OEM') AS brand,
    coalesce(nullif(model_number, ''), 'N/A') AS model_number,
    {_E_ATTR} AS attribute_count,
    concat_ws('; ', {_listing([(f"'{n}=' || {f}", f) for n, f in fv.ENRICHED_ATTRIBUTES], '<>')})
      AS attributes,
    concat_ws('; ', {_listing([(quote(l), f) for l, f in fv.ENRICHED_MISSING], '=')})
      AS missing_attributes,
    power, voltage FROM norm),
enrichment AS MATERIALIZED (
  SELECT *, 'Commercial grade ' || subcategory || ' manufactured by ' || brand || ' (Model: '
    || model_number || '). Engineered for high-duty continuous operation in demanding industrial '
    || 'facilities.' || CASE WHEN power <> '' THEN ' Rated power specification: ' || power || '.'
    ELSE '' END || CASE WHEN voltage <> '' THEN ' Operating voltage: ' || voltage || '.' ELSE ''
    END AS normalized_description,
    concat_ws('; ', lower(brand || ' ' || category), model_number || ' industrial',
      subcategory || ' B2B', brand || ' spare parts', 'commercial grade replacement') AS keywords
  FROM enriched)"""

_STAGES = {
    "norm": [NORM], "issues": [NORM, ISSUES], "clusters": [NORM, CLUSTERS],
    "conflicts": [NORM, NAME_CLUSTERS, CONFLICTS],
    "scored": [NORM, ISSUES, NAME_CLUSTERS, CONFLICTS, scored(HIT)],
    "plain_scored": [NORM, ISSUES, scored("false")],
    "enrichment": [NORM, ENRICHMENT],
    "names": [NORM, NAMES], "name_clusters": [NORM, NAME_CLUSTERS],
    "all": [NORM, ISSUES, NAME_CLUSTERS, CONFLICTS, scored(HIT), ENRICHMENT],
}


def over(stage: str, select: str, *extra: str) -> str:
    """A SELECT over the named stage; ``extra`` are further common table expressions."""
    return "WITH RECURSIVE " + ",\n".join([RAW, *_STAGES[stage], *extra]) + "\n" + select
