"""Exact amounts as canonical text; DECIMAL(38, 12) only where a value fits."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Digits, places before and behind the point that an amount may have.
MOST_DIGITS, MOST_EXPONENT, MOST_PLACES = 48, 35, 12
MAX_CELL = 256
#: Blanks inside printed numbers, and numbers that stand by themselves in a text.
BLANKS = "\u00a0\u202f"
_DIGITS = "(?:[0-9]{1,3}(?:[ \u00a0][0-9]{3})+|[0-9]+)(?:[.,][0-9]+)?"
QUOTED = rf"(?U)(?<![\w.,(])(?:\({_DIGITS}\)|[-+]?{_DIGITS})(?![\w.,)])"


def canonical_decimal(amount: Column) -> Column:
    """Text of a DECIMAL(38, s) without trailing zeros, exponent or negative zero."""
    text = amount.cast("decimal(38,12)").cast("string")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def canonical_text(value: str | None) -> str | None:
    """Canonical text of a JSON number of any allowed size; null if it is none or out of bounds."""
    if value is None or not re.fullmatch(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?", value) or len(value) > MAX_CELL:
        return None
    try:
        number = Decimal(value)
    except InvalidOperation:
        return None
    sign, digits, exponent = number.as_tuple()
    if len(digits) > MOST_DIGITS or number and number.adjusted() > MOST_EXPONENT or exponent < -MOST_PLACES:
        return None
    text = format(number, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


@pandas_udf(T.StringType())
def canonical_amount(lexemes: pd.Series) -> pd.Series:
    """canonical_text of number tokens; Arrow batches, as 48 digits exceed DECIMAL."""
    return lexemes.map(lambda x: canonical_text(None if pd.isna(x) else x))


#: Sign, whole part and fraction of a printed number: groups of three by blanks or by the mark that isn't the decimal one.
PRINTED = {
    None: r"^(?!-?[0-9]{1,3}[.,][0-9]{3}$)(-?)([0-9]+|[0-9]{1,3}(?: [0-9]{3})+|[0-9]{1,3}(?:\.[0-9]{3})+(?=,|$)|[0-9]{1,3}(?:,[0-9]{3})+(?=\.|$))(?:[.,]([0-9]+))?$",
    ".": r"^(-?)([0-9]+|[0-9]{1,3}(?: [0-9]{3})+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.([0-9]+))?$",
    ",": r"^(-?)([0-9]+|[0-9]{1,3}(?: [0-9]{3})+|[0-9]{1,3}(?:\.[0-9]{3})+)(?:,([0-9]+))?$",
}


def parse_localised(raw: Column, decimal_mark: str | None = None) -> Column:
    """Plain decimal text of a printed number; null if it is none, or if its lone three-digit group is ambiguous and no mark is given.

    Groups are set off by blanks, points or commas; brackets mean negative.  One
    pattern decides, so the expression stays small.
    """
    pattern = PRINTED[decimal_mark]
    text = F.translate(F.regexp_replace(raw, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), BLANKS + "\u2212", "  -")
    text = F.regexp_replace(F.regexp_replace(text, r"^\(([0-9].*)\)$", "-$1"), r"^\+(?=[0-9])", "")
    whole = lambda s: F.concat(F.regexp_extract(s, pattern, 1), F.translate(F.regexp_extract(s, pattern, 2), " .,", ""))
    fraction = lambda s: F.regexp_extract(s, pattern, 3)
    value = lambda s: F.when(s.rlike(pattern), F.concat(whole(s), F.when(fraction(s) != "", F.concat(F.lit("."), fraction(s))).otherwise("")))
    return F.when(F.length(raw) <= MAX_CELL, F.get(F.transform(F.array(text), value), F.lit(0)))


def canonical_plain(text: Column) -> Column:
    """Canonical text of a number written without exponent, of any length; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(text, "^[+]", ""), "^(-?)0+(?=[0-9])", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), F.when(bare == "-0", "0").otherwise(bare))


def quoted_number(value: Column, text: Column) -> Column:
    """Does a number that stands by itself in ``text`` equal the exact ``value``, a decimal or text without exponent, of any length?"""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUOTED), F.lit(0))
    plain = lambda x: F.translate(F.regexp_replace(x, r"^\((.*)\)$", "-$1"), ", \u00a0", ".")
    return F.coalesce(F.array_contains(F.transform(found, lambda x: canonical_plain(plain(x))), canonical_plain(value.cast("string"))), F.lit(False))
