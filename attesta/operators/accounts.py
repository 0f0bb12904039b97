"""Account statements and amounts from retained JSON bodies, number tokens unchanged.

One Arrow pass picks what is needed from each document's records; which of them
compete is decided by array functions in place, so nothing is shuffled and
nothing is read as a double.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attesta.functions.json_tokens import Number, canonical, strict_loads
from attesta.functions.numbers import canonical_text
from attesta.functions.rules import let
from attesta.functions.slices import cuts

#: Where each amount stands in a record.
AMOUNTS = {
    "total_operating_revenue": "/resultatregnskapResultat/driftsresultat/driftsinntekter/sumDriftsinntekter",
    "operating_result": "/resultatregnskapResultat/driftsresultat/driftsresultat",
    "annual_result": "/resultatregnskapResultat/aarsresultat",
    "total_assets": "/eiendeler/sumEiendeler",
    "equity": "/egenkapitalGjeld/egenkapital/sumEgenkapital",
    "total_liabilities": "/egenkapitalGjeld/gjeldOversikt/sumGjeld",
}
MOST_ID = 2147483647
#: A record's attributes, by where they stand.
FIELDS = {"org": "/virksomhet/organisasjonsnummer", "kind": "/regnskapstype", "currency": "/valuta", "start": "/regnskapsperiode/fraDato", "end": "/regnskapsperiode/tilDato"}
KEYS = ["document", "org_number"]

_text = lambda name: T.StructField(name, T.StringType())
_flag = lambda name: T.StructField(name, T.BooleanType())
_AMOUNT = T.StructType([_text("field"), _text("path"), _text("number"), _text("value")])
RECORD = T.ArrayType(
    T.StructType(
        [T.StructField("position", T.IntegerType()), *map(_text, ("pointer", "record_id", "currency", "period", "stated_period", "journal", "canonical"))]
        + [*map(_flag, ("object", "own", "group_scope", "placed", "stated", "going_concern")), T.StructField("amounts", T.ArrayType(_AMOUNT))]
    )
)


def _at(record, path: str):
    for name in path[1:].split("/"):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _string(value) -> str | None:
    return value if isinstance(value, str) and not isinstance(value, Number) else None


#: Weights of the check digit.
_WEIGHTS = (3, 2, 7, 6, 5, 4, 3, 2)
_FORMAT = re.compile(r"(?:NO ?)?([0-9]{9}|[0-9]{3}([\s.\-–—])[0-9]{3}[\s.\-–—][0-9]{3})(?: ?MVA)?", re.I)


def valid_number(stated: str) -> str | None:
    """The digits of a valid organisation number."""
    found = _FORMAT.fullmatch(stated.strip())
    digits = re.sub(r"\D", "", found[1]) if found else "0" * 9
    check = -sum(int(d) * w for d, w in zip(digits, _WEIGHTS)) % 11
    return digits if found and check == int(digits[8]) else None


def _day(text: str | None) -> str | None:
    """A real ISO date, else null."""
    try:
        return text if text and re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", text) and date.fromisoformat(text) else None
    except ValueError:
        return None


def _picked(position: int, pointer: str, record, org: str) -> dict:
    """What is needed of a record: its attributes, what can be said of it, and its amounts."""
    number, journal = _at(record, "/id"), _at(record, "/journalnr")
    held = {name: _string(_at(record, path)) for name, path in FIELDS.items()}
    named = isinstance(number, Number) and re.fullmatch("[1-9][0-9]{0,9}", number) and int(number) <= MOST_ID
    own = held["org"] is not None and valid_number(held["org"]) == org
    start, end = _day(held["start"]), _day(held["end"])
    period = f"{start}/{end}" if start and end and start <= end else None
    said = _string(journal)
    plain = journal is None or said is not None and said.strip() != "" and len(said) <= 128 and not re.search("[\x00-\x1f\x7f]", said)
    tokens = [(name, path, _at(record, path)) for name, path in AMOUNTS.items()]
    return {
        "position": position, "pointer": pointer, "record_id": str(number) if named else None, "currency": held["currency"], "period": period, "stated_period": "/".join(x for x in (held["start"], held["end"]) if x is not None),
        "journal": said, "canonical": blake2b(canonical(record).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), "object": isinstance(record, dict), "own": own, "group_scope": held["kind"] == "KONSERN", "placed": bool(start and end),
        "stated": bool(own and named and held["kind"] == "SELSKAP" and re.fullmatch("[A-Z]{3}", held["currency"] or "") and period and plain), "going_concern": _at(record, "/avviklingsregnskap") is False,
        "amounts": [{"field": name, "path": path, "number": str(x), "value": canonical_text(x)} for name, path, x in tokens if isinstance(x, Number)],
    }


def picked(document, org: str) -> list[dict]:
    """What is needed of each record of a document, in order, as the organisation's."""
    listed = isinstance(document, list)
    return [_picked(i, f"/{i}" if listed else "", r, org) for i, r in enumerate(document if listed else [document])]


def _picked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, org_number, records) of (document, org_number, body), a slice of a batch at a time; null records for what strict JSON doesn't allow."""

    def of(body, org):
        try:
            return None if body is None else picked(strict_loads(body), org)
        except (ValueError, RecursionError):
            return None

    kind = to_arrow_type(RECORD)
    for batch in batches:
        for a, b in cuts(batch["body"]):
            part = batch.slice(a, b - a)
            made = pa.array(map(of, part["body"].to_pylist(), part["org_number"].to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([part["document"], part["org_number"], made], [*KEYS, "records"])


def records(bodies: DataFrame, org: str = "org_number", body: str = "body", document: str = "org_number") -> DataFrame:
    """(document, org_number, records): each body's records and what can be said of them; ``document`` tells bodies apart where an organisation has several."""
    rows = bodies.select(F.col(document).alias("document"), F.col(org).alias("org_number"), F.col(body).alias("body"))
    made = T.StructType([*(T.StructField(name, rows.schema[name].dataType) for name in KEYS), T.StructField("records", RECORD)])
    return rows.mapInArrow(_picked_batches, made).filter("records IS NOT NULL")


def _agreed(rows: Column, key, said) -> Column:
    """The first record of each key whose records all say the same, for any number of records.

    Sorted by key and by what is said, equal ones lie side by side, so the first of
    each meet only their neighbours: a key that is left once has nothing against it.
    """
    ordered = F.array_sort(F.transform(rows, lambda r: F.struct(key(r).alias("key"), said(r).alias("said"), r["position"].alias("position"), r.alias("r"))))
    differs = lambda x, y: F.coalesce(x["key"] != y["key"], F.lit(True))
    firsts = lambda all_: F.filter(all_, lambda x, i: differs(F.get(all_, i - 1), x) | ~F.get(all_, i - 1)["said"].eqNullSafe(x["said"]))
    alone = lambda all_: F.filter(all_, lambda x, i: differs(F.get(all_, i - 1), x) & differs(F.get(all_, i + 1), x))
    return F.transform(let(let(ordered, firsts), alone), lambda x: x["r"])


def statements(made: DataFrame) -> DataFrame:
    """(document, org_number, record_id, pointer, currency, period, journal): the statement of each record id whose records all say the same."""
    named = F.filter("records", lambda r: r["record_id"].isNotNull())
    binding = lambda r: F.when(r["stated"], F.struct(r["currency"], r["period"], r["journal"]))
    alone = F.filter(_agreed(named, lambda r: r["record_id"], binding), lambda r: r["stated"])
    rows = made.select(*KEYS, F.explode(alone).alias("r"))
    return rows.select(*KEYS, "r.record_id", F.concat("r.pointer", F.lit("/id")).alias("pointer"), "r.currency", "r.period", "r.journal")


def amounts(made: DataFrame) -> DataFrame:
    """(document, org_number, pointer, field, source_field, source_number, value, record_pointer, record_id, currency, period, journal).

    Records of one period must be equal; a subject record without a period, or a
    record that is no object, withholds every amount of its document.
    """
    subject = lambda r: r["own"] & ~r["group_scope"]
    fit = made.filter(F.forall("records", lambda r: r["object"] & (~subject(r) | r["placed"])))
    alone = F.filter(_agreed(F.filter("records", subject), lambda r: r["stated_period"], lambda r: r["canonical"]), lambda r: r["stated"] & r["going_concern"])
    rows = fit.select(*KEYS, F.explode(alone).alias("r")).select(*KEYS, "r", F.explode("r.amounts").alias("a")).filter("a.value IS NOT NULL")
    return rows.select(
        *KEYS, F.concat("r.pointer", "a.path").alias("pointer"), "a.field", F.element_at(F.split("a.path", "/"), -1).alias("source_field"), F.col("a.number").alias("source_number"), "a.value",
        F.col("r.pointer").alias("record_pointer"), "r.record_id", "r.currency", "r.period", "r.journal",
    )


def activity(entities: DataFrame, key: str, events: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(key, kind, detail, date) of each registry signal that is there: kind -> (detail, date)."""
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), date.cast("string").alias("date")) for kind, (detail, date) in events.items()))
    return entities.select(key, F.inline(F.filter(listed, lambda e: e["detail"].isNotNull())))
