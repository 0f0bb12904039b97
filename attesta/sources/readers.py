"""Readers of identifier lists, universes and retained captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.functions import web
from attesta.functions.json_tokens import json_problem, json_tokens
from attesta.functions.rules import at, flag, literal, whole
from attesta.operators.ordering import numbered_lines

#: Header labels that are dropped from the first record.
HEADERS = ["organisation_number", "organisasjonsnummer", "orgnr", "org_number", "org"]
CAPTURES = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("retrieved_at", T.TimestampType()),
    ]
)


def format_of(path: str) -> str:
    return "jsonl" if path.lower().endswith(".jsonl") else "csv"


def _first_of_file(df: DataFrame) -> Column:
    """True for the first row of each file that isn't blank; ids follow the order within a file."""
    return F.row_number().over(Window.partitionBy("_file").orderBy("_id")) == 1


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(position, supplied): first column of a CSV or text list, or the id of each line of JSONL.

    Blank lines are skipped, values trimmed, a header label dropped if it is all
    of a file's first record.  A JSONL line that isn't a strict object with a text
    id fails the read, as a part of a list is worse than none.
    """
    if format_of(path) == "jsonl":
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), F.col("value")).filter(F.trim("value") != "")
        token = F.filter(json_tokens("value"), lambda t: (t["pointer"] == "/organisation_number") & (t["kind"] == "string"))
        return lines.select("position", F.coalesce(F.get(token, F.lit(0))["value"], F.raise_error(F.concat(F.lit("not a strict record: "), F.left("value", F.lit(80))))).alias("supplied"))
    rows = spark.read.csv(path, header=False, inferSchema=False, encoding="UTF-8", unescapedQuoteHandling="RAISE_ERROR").select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"), F.trim(F.regexp_replace(F.coalesce("_c0", F.lit("")), "^﻿", "")).alias("supplied"))
    rows = rows.filter("supplied <> ''").withColumn("_first", _first_of_file(rows))
    return rows.filter(~(F.col("_first") & F.lower("supplied").isin(HEADERS))).select(F.col("_id").alias("position"), "supplied")


UNIVERSE = {"organisation_number": "string", "name": "string", "legal_form": "string", "employees": "bigint", "website": "string", "industry_code": "string", "industry_label": "string"}


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file's bytes as stored."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def read_universe(spark: SparkSession, path: str, sha256: str | None = None, most_line: int = 1 << 20, most_bytes: int | None = None) -> DataFrame:
    """A JSONL universe, gzip too: (line, and the columns of UNIVERSE).

    Fails where the file's hash is another than ``sha256``, where a line or all of
    them together are longer than allowed, and where a line is no strict object with
    a text identifier: of a universe that isn't whole no sample can be drawn.  Lines
    are numbered exactly, however many parts the file is read in; blank ones count
    and are left out.
    """
    if sha256 is not None and file_digest(spark, path) != sha256.lower():
        raise ValueError("compressed universe hash differs from expected source")
    lines = numbered_lines(spark, path).select("line", "value")
    if most_bytes is not None and (lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0) > most_bytes:
        raise ValueError("universe exceeds its capacity")
    v = F.try_parse_json("value")
    fields = [F.try_variant_get(v, f"$.{name}", kind).alias(name) for name, kind in UNIVERSE.items()]
    wrong = F.when(F.octet_length("value") > most_line, "line too long").when(F.try_variant_get(v, "$.organisation_number", "string").isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not a strict record")
    checked = lines.filter(F.trim(F.regexp_replace("value", "\\s+", " ")) != "").withColumn("line", F.when(wrong.isNull(), F.col("line")).otherwise(F.raise_error(F.concat(wrong, F.lit(" in line "), F.col("line").cast("string"))).cast("long")))
    return checked.select("line", *fields)


def read_captures(spark: SparkSession, metadata: str, blobs: str) -> DataFrame:
    """Capture rows with their bytes; blobs are files named by their SHA-256."""
    content = spark.read.format("binaryFile").load(blobs).select(F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1).alias("content_hash"), "content")
    return spark.read.schema(CAPTURES).parquet(metadata).join(content, "content_hash", "left")


#: An entity's columns by where they stand, and the type that each must have.
REGISTRY = {
    "_id": ("organisasjonsnummer", literal), "legal_name": ("navn", literal), "organisation_form": ("organisasjonsform.kode", literal), "deleted": ("slettedato", literal), "bankrupt": ("konkurs", flag), "liquidation": ("underAvvikling", flag),
    "compulsory": ("underTvangsavviklingEllerTvangsopplosning", flag), "postcode": ("forretningsadresse.postnummer", literal), "place": ("forretningsadresse.poststed", literal), "own_municipality": ("forretningsadresse.kommune", literal), "post_municipality": ("postadresse.kommune", literal),
    "industry_code": ("naeringskode1.kode", literal), "industry_description": ("naeringskode1.beskrivelse", literal), "site": ("hjemmeside", literal), "registration_date": ("registreringsdatoEnhetsregisteret", literal), "employee_count": ("antallAnsatte", whole),
}


def parse_entities(bodies: DataFrame, requested: str, body: str, keep: list[str] | None = None) -> DataFrame:
    """Identity columns of registry documents, behind the columns ``keep``; a document that isn't strict JSON, of another id or without a name is marked.

    Values keep their types: a number, true or false that stands for a text, or a text
    that stands for one of these, is no value.
    """
    rows = bodies.withColumn("_problem", json_problem(body)).withColumn("_doc", F.when(F.col("_problem").isNull(), F.try_parse_json(F.regexp_replace(body, "^\ufeff", ""))))
    rows = rows.withColumn("_r", F.struct(F.try_variant_get(at(F.col("_doc"), "forretningsadresse.adresse"), "$", "array<string>").alias("lines"), *(kind_of(at(F.col("_doc"), path)).alias(name) for name, (path, kind_of) in REGISTRY.items())))
    c = lambda name: F.col(f"_r.{name}")
    state = F.when(c("_id").isNull(), "failed").when(c("_id") != F.col(requested), "id differs").when(F.trim(F.coalesce(c("legal_name"), F.lit(""))) == "", "no name").otherwise("ok")
    plain = ("legal_name", "organisation_form", "industry_code", "industry_description", "registration_date", "employee_count")
    made = {
        "status": web.registry_status(c("deleted"), c("bankrupt"), c("liquidation"), c("compulsory")),
        "registered_address": web.address_line(c("lines"), c("postcode"), c("place")),
        "municipality": F.coalesce(c("own_municipality"), c("post_municipality")),
        "website": web.website(c("site")),
    }
    return rows.select(*(keep or []), requested, state.alias("state"), *(c(name).alias(name) for name in plain), *(x.alias(name) for name, x in made.items()))


def parse_roles(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, role_code, name, position): current, named holders; the first of one code and name."""
    schema = "rollegrupper array<struct<roller:array<struct<type:struct<kode:string>,avregistrert:boolean,person:struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,enhet:struct<navn:array<string>>>>>>"
    groups = bodies.select(key, F.posexplode(F.from_json(F.col(body), schema)["rollegrupper"]).alias("_g", "_group"))
    roles = groups.select(key, "_g", F.posexplode("_group.roller").alias("_i", "r")).filter(~F.coalesce("r.avregistrert", F.lit(False)))
    person = F.concat_ws(" ", "r.person.navn.fornavn", "r.person.navn.mellomnavn", "r.person.navn.etternavn")
    named = roles.select(key, "_g", "_i", F.col("r.type.kode").alias("role_code"), F.coalesce(F.nullif(F.trim(person), F.lit("")), F.get("r.enhet.navn", F.lit(0))).alias("name")).filter("name IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(key, "role_code", "name").orderBy("_g", "_i"))
    kept = named.withColumn("_n", nth).filter("_n = 1")
    return kept.select(key, "role_code", "name", F.row_number().over(Window.partitionBy(key).orderBy("_g", "_i")).alias("position"))
