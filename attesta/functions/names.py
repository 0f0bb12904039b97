"""Names and hosts: normal forms and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal-form codes, which don't tell names apart.
LEGAL_FORMS = ["as", "asa", "a s", "nuf", "ks", "da", "ans", "ba", "enybf", "se", "sf", "fkf", "iks", "ktrf", "stiftelse"]
_FORMS = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))


def normalize_name(name: Column) -> Column:
    """Lower case, & and + as "og", without legal forms as whole words, other characters as one space."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[&+]", " og ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(?U)\b({_FORMS})\b", " "), "[^0-9a-zæøåäö]+", " "))


def similarity_of_normal(a: Column, b: Column) -> Column:
    """1 if equal, else shared words by the larger number of words, and 0.85 at least where one has all words of the other."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    shared, nx, ny = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
    share = shared / F.greatest(nx, ny)
    held = F.when((shared == nx) | (shared == ny), F.greatest(share, F.lit(0.85))).otherwise(share)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(held)


def name_similarity(a: Column, b: Column) -> Column:
    return similarity_of_normal(normalize_name(a), normalize_name(b))


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and outer dots; http is taken where no scheme is given."""
    value = F.coalesce(url, F.lit(""))
    value = F.when((value == "") | value.contains("://"), value).otherwise(F.concat(F.lit("http://"), value))
    return F.regexp_replace(F.lower(F.regexp_extract(value, r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^\.+|\.+$", "")


def registrable_domain(host: Column, suffixes: list[str] | None = None) -> Column:
    """The label before the longest listed public suffix, with it.

    Without a list the last label is the suffix, which is right for the generic
    and most national domains but not for such as co.uk.
    """
    labels = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    size = F.lit(1)
    for suffix in sorted(suffixes or [], key=lambda s: s.count(".")):
        n = suffix.count(".") + 1
        size = F.when(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".") == suffix, F.lit(n)).otherwise(size)
    take = F.least(F.size(labels), size + 1)
    return F.array_join(F.slice(labels, F.size(labels) - take + 1, take), ".")
