"""Unit, price and rating normalisation as native column expressions.

Numbers with two dots ("1.2.3") do not parse; such cells keep their cleaned
text instead of failing the job. The functions expect text that went through
``clean_text`` already, which is what the record assembly feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv
from tidyshelf.functions import text

_NUM = r"(?i)([0-9.]+)\s*"

# Power readings in order of priority: pattern, conversion of the number n, unit.
POWER = [
    (_NUM + r"(?:hp|horse\s*power)", f"round(n * {fv.KW_PER_HP}D, 2)", "kW"),
    (_NUM + r"(?:w|watts)(?!\w)", "round(n / 1000D, 3)", "kW"),
    (_NUM + r"(?:mw|megawatts)", "round(n * 1000D, 2)", "kW"),
    (_NUM + r"(?:kva)", "n", "kVA"),
    (_NUM + r"(?:kw|kilowatts)", "n", "kW"),
    (r"^([0-9.]+)$", "n", "kW"),
]

# Weights likewise. A bare number is taken as kilograms.
WEIGHT = [
    (_NUM + r"(?:lbs?|pounds?)", f"round(n * {fv.KG_PER_LB}D, 1)", "kg"),
    (_NUM + r"(?:g|grams?)(?!\w)", "round(n / 1000D, 2)", "kg"),
    (_NUM + r"(?:kg|kilograms?)", "n", "kg"),
    (r"^([0-9.]+)$", "n", "kg"),
]


def _plain(v: str) -> str:
    """SQL text: double as decimal text, without E notation."""
    digits = f"regexp_replace(cast(try_cast({v} AS decimal(38, 10)) AS string), r'0+$', '')"
    return (f"CASE WHEN {v} = 0 OR (abs({v}) >= 1e-3 AND abs({v}) < 1e7) "
            f"THEN cast({v} AS string) ELSE regexp_replace({digits}, r'\\.$', '.0') END")


def float_text(c: Column) -> Column:
    """Double as plain decimal text ("15.0"), never in E notation."""
    return text.let(c, _plain("x"))


def _reading(table, render: str) -> str:
    """SQL text: ``render`` over value ``v`` and unit ``u`` of the first pattern that occurs.

    ``f`` holds the digits each pattern finds, "" where it finds none; ``n`` is the
    number read. The value is null where nothing is found or the number does not parse.
    """
    found = "array(" + ", ".join(f"regexp_extract(x, r'{p}', 1)" for p, _, _ in table) + ")"
    pick = lambda k: "CASE " + " ".join(
        f"WHEN get(f, {i}) <> '' THEN {k(row)}" for i, row in enumerate(table)) + " END"
    number = "try_cast(get(filter(f, d -> d <> ''), 0) AS double)"
    value = text.bind(pick(lambda r: r[1]), "v", render.replace(
        "{unit}", pick(lambda r: f"' {r[2]}'")))
    return text.bind(found, "f", text.bind(number, "n", value))


_AS_TEXT = f"coalesce(concat({_plain('v')}, {{unit}}), x)"


def power_text(c: Column) -> Column:
    """Power as kW (or kVA) text; "mW" reads as megawatt, as case is ignored."""
    return text.let(c, _reading(POWER, _AS_TEXT))


def power_value(c: Column) -> Column:
    """The number behind ``power_text``, null when there is none."""
    return text.let(c, _reading(POWER, "v"))


def weight_text(c: Column) -> Column:
    return text.let(c, _reading(WEIGHT, _AS_TEXT))


def voltage_text(c: Column) -> Column:
    """kV to whole volts; V, VAC and VDC readings get DC/AC suffixes.

    The suffix letters may stand anywhere in the text.
    """
    kilo = _NUM + r"(?:kv|kilovolts)"
    plain = r"(?i)([0-9.\-]+)\s*(?:v(?:olts?)?|vac|vdc)"
    volts = f"try_cast(try_cast(regexp_extract(x, r'{kilo}', 1) AS double) * 1000 AS bigint)"
    suffix = lambda s: f"CASE WHEN contains(lower(x), '{s}') THEN ' {s.upper()}' ELSE '' END"
    return text.let(c, f"""coalesce(
        CASE WHEN x RLIKE r'{kilo}' THEN concat(cast({volts} AS string), ' V')
             WHEN x RLIKE r'{plain}' THEN
               concat(regexp_extract(x, r'{plain}', 1), ' V', {suffix('dc')}, {suffix('ac')})
        END, x)""")


def frequency_text(c: Column) -> Column:
    return text.let(c, r"""CASE WHEN x RLIKE r'(?i)50[\s/]*60\s*hz' THEN '50/60 Hz'
        WHEN x RLIKE r'(?i)50\s*hz' THEN '50 Hz' WHEN x RLIKE r'(?i)60\s*hz' THEN '60 Hz'
        WHEN lower(x) IN ('dc', 'direct current') THEN 'DC' ELSE x END""")


def rpm_text(c: Column) -> Column:
    return text.let(
        c, "coalesce(concat(nullif(regexp_extract(x, '([0-9]+)', 1), ''), ' RPM'), x)")


def dimensions_text(c: Column) -> Column:
    """First three numbers as ``L x W x H mm``; inches and centimetres converted."""
    factor = (f"CASE WHEN contains(x, '\"') OR contains(lower(x), 'inch') THEN {fv.MM_PER_INCH}D "
              "WHEN contains(lower(x), 'cm') THEN 10D END")
    sized = ("transform(p, q -> cast(try_cast(bround(try_cast(q AS double) * k, 0) AS bigint) "
             "AS string))")
    chosen = text.bind(sized, "s", "CASE WHEN forall(s, q -> q IS NOT NULL) THEN s ELSE p END")
    laid_out = f"concat(array_join({text.bind(factor, 'k', chosen)}, ' x '), ' mm')"
    parts = "slice(regexp_extract_all(x, r'([0-9.]+)', 1), 1, 3)"
    return text.let(c, text.bind(parts, "p", f"CASE WHEN size(p) < 3 THEN x ELSE {laid_out} END"))


def ip_text(c: Column) -> Column:
    code = "nullif(regexp_extract(x, r'(?i)ip\\s*([0-9]{2}[a-z]?)', 1), '')"
    return text.let(c, f"coalesce(concat('IP', upper({code})), "
                       "CASE WHEN contains(lower(x), 'ex d') THEN upper(x) END, x)")


def price_value(c: Column) -> Column:
    """First run of digits, commas dropped, two decimals; a leading minus is kept."""
    digits = "nullif(replace(regexp_extract(x, r'([0-9.,]+)', 1), ',', ''), '')"
    sign = r"CASE WHEN x RLIKE r'^\s*[$€£]?\s*-\s*[$€£]?\s*[0-9.,]' THEN -1D ELSE 1D END"
    return text.let(c, f"round(try_cast({digits} AS double) * {sign}, 2)")


def currency_code(price: Column, currency: Column) -> Column:
    """Symbol in the price or currency cell, else the code in upper case, else USD."""
    code = F.upper(currency)
    text = F.coalesce(price, F.lit(""))
    out = None
    for symbol, name in (("$", "USD"), ("€", "EUR"), ("£", "GBP")):
        hit = text.contains(symbol) | (code == symbol)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.when(code == "", F.lit("USD")).otherwise(code)
