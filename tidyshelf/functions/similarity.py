"""Name similarity for duplicate detection.

The one thing Spark has no built-in for is the Indel ratio, 2*LCS/(la+lb)
(Spark's ``levenshtein`` counts a substitution as one step, Indel as two). The
numpy kernel in ``indel`` works on an Arrow batch of pairs at once; everything
else is native, also the bounds that keep most pairs away from the kernel.
"""

from __future__ import annotations

import functools
import string

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyshelf.functions import indel, text
from tidyshelf.functions.indel import BOOST, PARTIAL_SHARE, TOKEN_SHARE

# The kernel travels with the task, so executors need numpy and pandas but not
# this package.
cloudpickle.register_pickle_by_value(indel)

MODEL_SAME_BRAND = 0.95
MODEL_OTHER_BRAND = 0.85

# Characters counted one by one, and the bits each has for its count, in two words of 63 bits at most.
_COUNTED = [[(c, 3) for c in "abcdefghijklmnopqrstu"],
            [(c, 3) for c in "vwxyz"] + [(c, 2) for c in string.digits] + [(" ", 6), ("#", 2), ("-", 3)]]


def token_sorted(name: Column) -> Column:
    """Words of a name in order, joined by blanks."""
    return F.array_join(F.array_sort(F.split(text.tidy(name), " ")), " ")


def letter_bits(name: Column) -> list[Column]:
    """Character counts of a lower-case name in unary, as two numbers: of a character found n times the
    first n of its bits are set."""
    words = []
    for counted in _COUNTED:
        word, at = F.lit(0).cast("long"), 0
        for c, width in counted:
            found = F.least(F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))), F.lit(width))
            ones = F.call_function("shiftleft", F.lit(1).cast("long"), found) - 1
            word = word.bitwiseOR(F.shiftleft(ones, at))
            at += width
        assert at < 64
        words.append(word)
    return words


def most_common_letters(length_a: Column, bits_a: list[Column], length_b: Column, bits_b: list[Column]) -> Column:
    """Upper bound of the characters two names share, hence of their common subsequence.

    Shared bits are shared characters; what the bits leave out can at most pair off.
    """
    shared = [F.bit_count(a.bitwiseAND(b)) for a, b in zip(bits_a, bits_b)]
    rest = lambda length, bits: length - functools.reduce(
        Column.__add__, [F.bit_count(b) for b in bits])
    return functools.reduce(Column.__add__, shared) + F.least(rest(length_a, bits_a), rest(length_b, bits_b))


def name_similarity():
    """Arrow-batched scorer of name pairs; a pair with a blank name scores 0."""
    score = indel.once_each(indel.name_similarities, 0.0)

    @F.pandas_udf("double")
    def scorer(ta: pd.Series, tb: pd.Series, na: pd.Series, nb: pd.Series, boosted: pd.Series) -> pd.Series:
        return score(ta, tb, na, nb, boosted)

    return scorer


def names_reach(floor: float):
    """Arrow-batched test whether name pairs reach ``floor``; a pair with a blank name does not."""
    kernel = indel.names_reach
    score = indel.once_each(lambda pairs: kernel(pairs, floor), False)

    @F.pandas_udf("boolean")
    def reaches(ta: pd.Series, tb: pd.Series, na: pd.Series, nb: pd.Series, boosted: pd.Series) -> pd.Series:
        return score(ta, tb, na, nb, boosted)

    return reaches


def model_similarity(model_a: Column, model_b: Column, brand_a: Column, brand_b: Column) -> Column:
    """Score of equal non-blank model keys, null when the rule does not apply."""
    same_brand = (brand_a == brand_b) | (brand_a == "") | (brand_b == "")
    return F.when((model_a != "") & (model_a == model_b),
                  F.when(same_brand, F.lit(MODEL_SAME_BRAND)).otherwise(F.lit(MODEL_OTHER_BRAND)))


def boosted(brand_a: Column, brand_b: Column, category_a: Column, category_b: Column) -> Column:
    return (brand_a != "") & (brand_a == brand_b) & (category_a == category_b)


def similarity_bound(shared: Column, total: Column, boost: Column) -> Column:
    """Highest similarity of two token-sorted names of ``total`` characters that share at most ``shared``."""
    top = 2 * shared / F.greatest(total, F.lit(1)) * TOKEN_SHARE + PARTIAL_SHARE
    return F.least(F.lit(1.0), F.when(boost, top * BOOST).otherwise(top))
