"""Rules over VARIANT values and conditions: what a document says, told apart by type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_failure(*chain: tuple[Column, str | Column]) -> Column:
    """The message of the first condition that isn't true; null if all are.  A null condition isn't true."""
    broken = [F.when(~F.coalesce(good, F.lit(False)), F.lit(said) if isinstance(said, str) else said) for good, said in chain]
    return F.coalesce(*broken)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def variant_at(value: Column, name: str) -> Column:
    """A member of an object; null if there is none."""
    return F.try_variant_get(value, f"$['{name}']", "variant")


def at(value: Column, path: str) -> Column:
    """What stands at a path of names parted by dots."""
    return F.try_variant_get(value, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")


def has(value: Column, name: str) -> Column:
    """Has an object this member, be it null?"""
    return variant_at(value, name).isNotNull()


def kind(value: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, VOID (a null), OBJECT or ARRAY and other types of numbers; null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def literal(value: Column) -> Column:
    """The text of a string; null for values of other types."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def flag(value: Column) -> Column:
    """A literal true or false; null for values of other types."""
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def whole(value: Column) -> Column:
    """A whole number; null for values of other types, true and false among them."""
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def items(value: Column, name: str) -> Column:
    """A member as a list: its items if it is one, else itself alone; empty if there is none."""
    there = variant_at(value, name)
    return F.when(there.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(F.try_variant_get(there, "$", "array<variant>"), F.array(there)))


def quoted(value: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def as_object(*pairs: tuple[str, Column]) -> Column:
    """Pairs as JSON with sorted names and a space behind commas and colons; a null value is left out."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in sorted(pairs, key=lambda p: p[0]))), F.lit("}"))
