"""Organisation numbers: normal form, modulus-11 check and verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)
FORMATTED = r"^(?i:NO ?)?([0-9]{9}|[0-9]{3}([\s.\-–—])[0-9]{3}[\s.\-–—][0-9]{3})(?i: ?MVA)?$"
CANDIDATE = r"(?<![0-9])([0-9]{9}|[0-9]{3}(?:[\s.\-][0-9]{3}){2})(?![0-9])"


def normalize_id(raw: Column) -> Column:
    """Digits of a wholly formatted identifier; other input is trimmed and left as it is, null becomes empty."""
    value = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    return F.when(value.rlike(FORMATTED), F.regexp_replace(F.regexp_extract(value, FORMATTED, 1), r"[\s.\-–—]", "")).otherwise(value)


def checksum_ok(digits: Column) -> Column:
    """Modulus 11 over nine digits; a check value of 10 is never valid."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(WEIGHTS)), F.lit(0))
    check = F.pmod(F.lit(11) - total % 11, F.lit(11))
    return (check != 10) & (check == F.substring(digits, 9, 1).cast("int"))


def validate_id(raw: Column) -> Column:
    """struct(value, valid, reason)."""
    value = normalize_id(raw)
    reason = (
        F.when(value == "", F.lit("empty input"))
        .when(value.rlike("^[0-9]{9}$"), F.when(checksum_ok(value), F.lit("valid format and checksum")).otherwise(F.lit("checksum failed (modulus 11)")))
        .when(value.rlike("^[0-9]+$"), F.concat(F.lit("expected 9 digits, got "), F.length(value).cast("string")))
        .otherwise(F.lit("contains non-digit characters"))
    )
    valid = value.rlike("^[0-9]{9}$") & F.coalesce(checksum_ok(F.when(value.rlike("^[0-9]{9}$"), value)), F.lit(False))
    return F.struct(value.alias("value"), valid.alias("valid"), reason.alias("reason"))


def valid_digits(raw: Column) -> Column:
    """The nine digits of a valid identifier, null for anything else; small enough to stand often in one expression."""
    digits = F.regexp_replace(F.regexp_extract(F.trim(raw), FORMATTED, 1), r"[\s.\-–—]", "")
    return F.get(F.transform(F.array(digits), lambda d: F.when((d != "") & checksum_ok(d), d)), F.lit(0))


def ids_in_text(text: Column, exclude: Column | None = None) -> Column:
    """Distinct valid identifiers of a text in order of appearance, without ``exclude``."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATE), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s.\-]", ""))
    found = F.array_distinct(F.filter(found, checksum_ok))
    return found if exclude is None else F.filter(found, lambda x: ~x.eqNullSafe(exclude))
