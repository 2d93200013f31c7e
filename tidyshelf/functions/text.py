"""Text functions: Column in, Column out, all native expressions.

The bodies are SQL text over one lambda variable ``x``. Binding the input as a
lambda variable computes it once however often the body uses it, keeps generated
code small, and keeps a filter that Spark pushes below a projection from
multiplying the work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf import fixed_values as fv

# Space characters as Python's ``str.strip`` and ``\s`` see them.
_SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_EDGE_SPACES = f"^{_SPACES}+|{_SPACES}+$"


# -- SQL text helpers ------------------------------------------------------------

def quote(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """SQL text: ``body`` with ``name`` standing for the value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def let(c: Column, body: str) -> Column:
    """Column of the SQL text ``body`` with ``x`` standing for ``c``."""
    return F.get(F.call_function("transform", F.array(c), F.expr(f"x -> {body}")), F.lit(0))


def _listed(words) -> str:
    return ", ".join(quote(w) for w in words)


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, r'{_SPACES}+', ' '))"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, r'{_EDGE_SPACES}', '')"


# Most cells need nothing: byte tests for stray blanks and one scan for anything but
# printable ASCII decide whether a new string is built.
_TIDY = (f"CASE WHEN startswith(x, ' ') OR endswith(x, ' ') OR contains(x, '  ') "
         f"OR x RLIKE '[^ -~]' THEN {_squeezed('x')} ELSE x END")
_UNTAG = (f"CASE WHEN octet_length(t) <= 4 AND lower(t) IN ({_listed(fv.BLANK_WORDS)}) THEN '' "
          f"WHEN contains(t, '<') THEN " + _squeezed("regexp_replace(t, r'<[^>]+>', ' ')")
          + " ELSE t END")


# -- functions --------------------------------------------------------------------

def strip(c: Column) -> Column:
    """Trim white space of every kind, not just blanks."""
    return F.regexp_replace(c, _EDGE_SPACES, "")


def tidy(c: Column) -> Column:
    """Squeeze runs of white space to one blank and trim."""
    return let(c, _TIDY)


def clean_text(c: Column) -> Column:
    """Blank out missing-value words, turn tags into spaces, squeeze white space.

    Never null: missing is the empty string.
    """
    return let(F.coalesce(c, F.lit("")), bind(_TIDY, "t", _UNTAG))


def first_filled(*columns: Column) -> Column:
    """First non-blank of several columns, else the empty string."""
    filled = F.call_function("filter", F.array(*columns), F.expr("x -> x <> ''"))
    return F.coalesce(F.get(filled, F.lit(0)), F.lit(""))


def key_string(c: Column) -> Column:
    """Letters and digits only, lower case: the form in which keys are compared."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]", ""))


def compare_string(c: Column) -> Column:
    """Form in which two source values are compared for disagreement."""
    text = tidy(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(text, r"(?U)[^\w\s.\-]", ""))


def is_source_value(c: Column) -> Column:
    """True when the cell carries data, not a placeholder."""
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin(fv.PLACEHOLDER_WORDS)


def title_label(c: Column) -> Column:
    """Header to display label: underscores become blanks, words are capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def field_label(c: Column) -> Column:
    """Display label of an issue field; the label table is a constant map."""
    labels = "map(" + ", ".join(
        f"{quote(k)}, {quote(v)}" for k, v in fv.FIELD_LABELS.items()) + ")"
    return F.coalesce(let(c, f"try_element_at({labels}, lower(x))"), title_label(c))


_BRAND_MAP = "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in fv.BRANDS.items()) + ")"


def known_brand(brand: Column) -> Column:
    """Canonical spelling of a cleaned brand; unknown brands pass through."""
    return let(brand, f"coalesce(try_element_at({_BRAND_MAP}, lower(x)), x)")


def canonical_brand(c: Column) -> Column:
    return known_brand(clean_text(c))


def strip_promo(c: Column) -> Column:
    """Drop ``**...**`` runs."""
    bare = _stripped(r"regexp_replace(x, r'\*{2,}[^*]+\*{2,}', '')")
    return let(c, f"CASE WHEN contains(x, '**') THEN {bare} ELSE x END")


def repair_url(c: Column) -> Column:
    """Prefix https:// when a scheme is missing and the text looks like an address."""
    return let(c, "CASE WHEN NOT startswith(x, 'http://') AND NOT startswith(x, 'https://') "
                  "AND contains(x, '.') AND contains(x, '/') THEN concat('https://', x) "
                  "ELSE x END")


def synthesize_name(name: Column, description: Column, brand: Column, model: Column,
                    mpn: Column, product_id: Column) -> Column:
    """Name when none is given: first sentence, else brand and model, else the id."""
    sentence = strip(F.substring_index(description, ".", 1))
    from_text = F.when(F.length(sentence) > 5, F.left(sentence, F.lit(90))).otherwise(
        F.left(description, F.lit(90)))
    part = first_filled(model, mpn)
    ident = first_filled(mpn, product_id)
    return (
        F.when(name != "", name)
        .when(description != "", from_text)
        .when((brand != "") & (part != ""), F.trim(F.concat(brand, F.lit(" "), part)))
        .when(ident != "", F.trim(F.concat(F.lit(fv.NAME_FROM_ID), ident)))
        .otherwise(F.lit(fv.DEFAULT_NAME))
    )


def is_url(c: Column) -> Column:
    return c.rlike(fv.URL_PATTERN)


def is_ip_rating(c: Column) -> Column:
    return c.rlike(fv.IP_PATTERN)


def specs_summary(power: Column, voltage: Column, price_text: Column) -> Column:
    return F.concat(F.lit("Power: "), F.coalesce(power, F.lit("")),
                    F.lit(", Voltage: "), F.coalesce(voltage, F.lit("")),
                    F.lit(", Price: "), F.coalesce(price_text, F.lit("None")))


def percent(c: Column) -> Column:
    """Ratio to percent with one decimal."""
    return F.round(c * 100, 1)
