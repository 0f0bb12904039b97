"""Values of registry documents by declared rules over VARIANT: (value, error) of what stands at a place.

Values are JSON texts with sorted names and a space behind commas and colons, so
that equality of texts is equality of values and of their types.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import web
from attesta.functions.identifiers import valid_digits
from attesta.functions.rules import as_object, at, first_failure, flag, kind, let, literal, quoted

#: The flags of an entity's state, and a subunit's further attributes, by where they stand.
FLAGS = ("konkurs", "underAvvikling", "underTvangsavviklingEllerTvangsopplosning")
SUBUNIT = {
    "municipality": "beliggenhetsadresse.kommune",
    "postal_code": "beliggenhetsadresse.postnummer",
    "postal_area": "beliggenhetsadresse.poststed",
    "industry": "naeringskode1.beskrivelse",
    "closure_date": "nedleggelsesdato",
    "deleted_date": "slettedato",
}
DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _or_null(text: Column) -> Column:
    return F.coalesce(quoted(text), F.lit("null"))


def said(value: Column) -> Column:
    """A string, or nothing at all, or a null?"""
    return value.isNull() | kind(value).isin("STRING", "VOID")


def real_day(text: Column) -> Column:
    return text.isNull() | (text.rlike(DAY) & F.try_to_date(text, "yyyy-MM-dd").isNotNull())


def status(doc: Column) -> Column:
    deleted = F.to_json(at(doc, "slettedato"))
    gone = F.when(~deleted.isin("null", '""', "false", "0", "[]", "{}"), "x")
    return quoted(web.registry_status(gone, *(flag(at(doc, f)) for f in FLAGS)))


def address(doc: Column) -> Column:
    text = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    return _or_null(web.address_line(F.try_variant_get(doc, "$.adresse", "array<string>"), text("postnummer"), text("poststed")))


def subunit(doc: Column) -> Column:
    """struct(value, error, item, parent) of a collection's record: its value or why it has none, its own number and its parent's."""
    attributes = {k: at(doc, path) for k, path in SUBUNIT.items()}
    place, trade, lines = at(doc, "beliggenhetsadresse"), at(doc, "naeringskode1"), at(doc, "beliggenhetsadresse.adresse")
    object_or_none = lambda x: x.isNull() | kind(x).isin("OBJECT", "VOID")
    each = F.try_variant_get(lines, "$", "array<variant>")
    parts = F.struct(
        valid_digits(literal(at(doc, "organisasjonsnummer"))).alias("item"),
        valid_digits(literal(at(doc, "overordnetEnhet"))).alias("parent"),
        literal(at(doc, "navn")).alias("name"),
        F.nullif(F.array_join(F.transform(each, literal), " "), F.lit("")).alias("street"),
        *(literal(x).alias(k) for k, x in attributes.items()),
        first_failure(
            (object_or_none(place) & object_or_none(trade), "subunit address/industry schema mismatch"),
            (lines.isNull() | F.forall(each, lambda x: literal(x).isNotNull()), "subunit address lines invalid"),
            (F.forall(F.array(*attributes.values()), said), "subunit attributes must be strings or unknown"),
        ).alias("shape"),
        (kind(doc) == "OBJECT").alias("object"),
    )

    def judged(p: Column) -> Column:
        error = first_failure(
            (p["object"], "subunit must be an object"),
            (p["item"] != p["parent"], "subunit and explicit parent identifiers must be distinct valid orgnrs"),
            (F.trim(F.regexp_replace(p["name"], r"(?U)\s+", " ")) != "", "subunit name missing or invalid"),
            (p["shape"].isNull(), p["shape"]),
            *((real_day(p[k]), "Invalid isoformat string") for k in ("closure_date", "deleted_date")),
        )
        value = as_object(("orgnr", quoted(p["item"])), ("parent_orgnr", quoted(p["parent"])), ("name", quoted(p["name"])), ("physical_address", _or_null(p["street"])), *((k, _or_null(p[k])) for k in attributes))
        return let(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error"), p["item"].alias("item"), p["parent"].alias("parent")))

    return let(parts, judged)


def derived(raw: Column, rule: Column) -> Column:
    """struct(value, error) that a rule makes of a JSON text."""
    odd = F.lit("normalization incompatible with source value")
    pair = lambda value, error: let(value, lambda v: F.struct(v.alias("value"), F.when(v.isNull(), error).alias("error")))

    def of(doc: Column) -> Column:
        is_object = kind(doc) == "OBJECT"
        return (
            F.when(rule == "identity", pair(raw, odd))
            .when((rule == "brreg-status-v1") & is_object, pair(status(doc), odd))
            .when((rule == "brreg-address-v1") & is_object, pair(address(doc), odd))
            .when((rule == "brreg-website-v1") & (kind(doc) == "STRING"), pair(quoted(web.website(literal(doc))), F.lit("unsupported website URL")))
            .when(rule == "brreg-subunit-v1", let(subunit(doc), lambda u: F.struct(u["value"].alias("value"), u["error"].alias("error"))))
            .otherwise(pair(F.lit(None).cast("string"), odd))
        )

    return let(F.try_parse_json(raw), of)
