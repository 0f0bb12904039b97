"""JSON read without losing anything: number tokens, pointers and strictness.

Spark's JSON functions rewrite numbers and take duplicate keys.  One Arrow UDF
walks each document once; everything behind it is built in.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MOST_DEPTH, MOST_TOKEN = 64, 256
TOKENS = T.ArrayType(T.StructType([T.StructField("pointer", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


class Number(str):
    """A number's own characters."""


class Refused(ValueError):
    pass


def _pairs(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("duplicate key")
    return out


def _constant(name):
    raise Refused("non-finite number")


def _number(token: str) -> Number:
    value = float(token)
    vanished = value == 0 and re.search("[1-9]", re.split("[eE]", token)[0])
    if len(token) > MOST_TOKEN or not math.isfinite(value) or vanished:
        raise Refused("number out of range")
    return Number(token)


def strict_loads(body: str):
    """The document with numbers as their tokens; ValueError for what strict JSON doesn't allow."""
    if body.startswith("﻿"):
        body = body[1:]
    if body.count("[") + body.count("{") > MOST_DEPTH:
        depth = 0
        for c in re.findall(r"[\[{\]}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", body)):
            depth += 1 if c in "[{" else -1
            if depth > MOST_DEPTH:
                raise Refused("too deep")
    document = json.loads(body, object_pairs_hook=_pairs, parse_constant=_constant, parse_float=_number, parse_int=_number)
    if "\\u" in body and re.search("[\ud800-\udfff]", json.dumps(document, ensure_ascii=False)):
        raise Refused("lone surrogate")
    return document


def canonical(value) -> str:
    """Sorted, compact JSON text; equality of these is type-sensitive equality of values."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value)


def nodes(value, pointer: str = ""):
    """(pointer, value) of everything in a document, containers in front of what they hold."""
    yield pointer, value
    held = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for name, inner in held:
        yield from nodes(inner, f"{pointer}/{str(name).replace('~', '~0').replace('/', '~1')}")


def walk(value):
    """(pointer, kind, value) of every scalar and empty container."""
    for pointer, x in nodes(value):
        if isinstance(x, (dict, list)) and x:
            continue
        kind = "number" if isinstance(x, Number) else {dict: "object", list: "array", str: "string", bool: "boolean"}.get(type(x), "null")
        yield pointer, kind, None if kind in ("null", "object", "array") else str(x).lower() if kind == "boolean" else str(x)


#: What an RFC 6901 pointer looks like.
POINTER = re.compile("(?:/(?:[^~/]|~[01])*)*")


def at_pointers(document, pointers: list[str]) -> list[tuple[object, str | None]]:
    """(value, None) of what stands at each pointer, or (None, why nothing does)."""
    index = dict(nodes(document))

    def why(pointer: str) -> str:
        if not POINTER.fullmatch(pointer):
            return "invalid JSON pointer escape" if pointer.startswith("/") else "JSON pointer must start with /"
        # the longest part of the way that there is tells what went wrong behind it
        parts = pointer.split("/")
        there = next(k for k in range(len(parts) - 1, 0, -1) if "/".join(parts[:k]) in index)
        inside = index["/".join(parts[:there])]
        if not isinstance(inside, (dict, list)):
            return "JSON pointer traverses a scalar"
        odd = isinstance(inside, list) and not re.fullmatch("0|[1-9][0-9]*", parts[there])
        return "invalid JSON array index" if odd else "JSON pointer not found"

    return [(index[p], None) if p in index else (None, why(p)) for p in pointers]


@pandas_udf(TOKENS)
def json_tokens(bodies: pd.Series) -> pd.Series:
    """The tokens of each document in order; null for what strict JSON doesn't allow."""

    def of(body):
        if body is None:
            return None
        try:
            return [dict(zip(("pointer", "kind", "value"), x)) for x in walk(strict_loads(body))]
        except (ValueError, RecursionError):
            return None

    return bodies.map(of)


@pandas_udf(T.StringType())
def json_problem(bodies: pd.Series) -> pd.Series:
    """Why a text isn't strict JSON; null if it is."""

    def of(body):
        try:
            strict_loads(body or "")
        except (ValueError, RecursionError) as error:
            return str(error) if isinstance(error, Refused) else "invalid JSON"

    return bodies.map(of)


def at_pointer(tokens: Column, pointer: Column | str) -> Column:
    """The token at a pointer; null if there is none."""
    pointer = F.lit(pointer) if isinstance(pointer, str) else pointer
    return F.get(F.filter(tokens, lambda t: t["pointer"] == pointer), F.lit(0))


def claim_id(*parts: Column) -> Column:
    """Version mark and SHA-256 of a claim's ASCII key parts as a compact JSON array; null parts are null there."""
    quoted = [F.when(p.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.regexp_replace(p.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))) for p in parts]
    return F.concat(F.lit("claim_v1_"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256))
