"""Run bundles: ordered results, content-addressed objects and a manifest written last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.ordering import placed
from attesta.operators.publication import full_reasons
from attesta.operators.registry_scans import projection_differences
from attesta.sources.sinks import MANIFEST, file_manifest, new_blobs, write_jsonl


def export(envelopes: DataFrame, captures: DataFrame, path: str, key: str = "organisation_number", projection: DataFrame | None = None, most_bytes: int | None = None) -> None:
    """results (JSONL), objects (bytes by hash), a projection of the results where one is given, and the manifest; a bundle without a manifest isn't whole."""
    size = captures.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if most_bytes is not None and size > most_bytes:
        raise ValueError("bundle exceeds its capacity")
    if projection is not None:
        write_jsonl(projection, f"{path}/projection", [key])
    write_jsonl(envelopes, f"{path}/results", [key])
    new_blobs(captures, None).write.mode("error").parquet(f"{path}/objects")
    spark = envelopes.sparkSession
    file_manifest(spark, f"{path}/results", key).withColumn("objects", F.lit(spark.read.parquet(f"{path}/objects").count())).coalesce(1).write.mode("error").json(f"{path}/manifest")


def problems(spark: SparkSession, path: str, schema, key: str = "organisation_number", hashes: str | None = None, projected=None) -> DataFrame:
    """(problem, detail) of a bundle; empty if it is whole.

    ``hashes``: an expression for the hashes that a result refers to; ``projected``
    makes of the results what the bundle's projection must be.
    """
    results = spark.read.schema(schema).json(f"{path}/results")
    objects = spark.read.parquet(f"{path}/objects")
    stated = spark.read.schema(f"{MANIFEST}, objects bigint").json(f"{path}/manifest")
    seen = file_manifest(spark, f"{path}/results", key).withColumn("objects", F.lit(objects.count()))
    text = lambda df: F.to_json(F.struct(*(df[c].cast("string").alias(c) for c in ("rows", "keys", "digest", "objects"))))
    out = stated.select(text(stated).alias("a")).join(seen.select(text(seen).alias("b"))).filter("a <> b").select(F.lit("manifest differs").alias("problem"), F.col("b").alias("detail"))
    broken = objects.filter((F.sha2("content", 256) != F.col("content_hash")) | (F.octet_length("content") != F.col("byte_count"))).select(F.lit("object differs"), "content_hash")
    twice = results.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("result twice"), F.col(key).cast("string"))
    out = out.unionAll(broken).unionAll(twice)
    if hashes:
        used = results.select(F.explode(F.expr(hashes)).alias("content_hash")).distinct()
        out = out.unionAll(used.join(objects.select("content_hash"), "content_hash", "left_anti").select(F.lit("object missing"), "content_hash"))
    if projected is not None:
        wanted = projected(results)
        shown = spark.read.schema(wanted.schema).json(f"{path}/projection")
        out = out.unionAll(projection_differences(wanted, shown, key).select(F.concat(F.lit("projection "), F.col("problem")), F.col(key).cast("string")))
    return out


def claim_problems(results: DataFrame, objects: DataFrame, key: str = "organisation_number") -> DataFrame:
    """(key, fact_id, problem) of every claim in nested results that the bundle itself doesn't support, by the whole citation chain.

    results: key, and arrays of structs facts, evidence, sources and captures with the
    columns that operators/support.py names; objects: content_hash, content.
    """
    part = lambda name: results.select(F.inline(name))
    once = lambda name, id_: part(name).dropDuplicates([id_])
    reasons = full_reasons(part("facts"), once("sources", "source_id"), once("evidence", "evidence_id"), once("captures", "source_id"), objects)
    owners = results.select(key, F.explode("facts.fact_id").alias("fact_id"))
    bad = reasons.filter("reason <> 'ok'").select("fact_id", F.concat(F.lit("claim support failed: "), "reason").alias("problem"))
    return owners.join(bad, "fact_id").select(key, "fact_id", "problem")


def mapping_problems(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(problem, detail) of the mapping of inputs to results: places that don't follow each other, results out of the order of first inputs.

    inputs: position (from 0) and ``key``; results: position and ``key``.
    """
    gaps = inputs.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b"))
    gaps = gaps.filter("n > 0 AND (n <> d OR a <> 0 OR b <> n - 1)").select(F.lit("input positions differ").alias("problem"), F.col("n").cast("string").alias("detail"))
    first = inputs.groupBy(key).agg(F.min("position").alias("first"))
    wanted = placed(first, ["first"], "place").select(F.col(key).alias("_k"), "place")
    both = results.join(wanted, F.col(key) == F.col("_k"), "full_outer")
    wrong = F.when(F.col("_k").isNull(), "result without input").when(F.col(key).isNull(), "input without result").when(F.col("position") != F.col("place"), "result out of order")
    return gaps.unionByName(both.select(wrong.alias("problem"), F.coalesce(F.col(key), F.col("_k")).cast("string").alias("detail")).filter("problem IS NOT NULL"))


def capacity_problems(objects: DataFrame, most_bytes: int, most_object: int) -> DataFrame:
    """(problem, detail): objects that are too long, that stand twice, and all of them together if they are."""
    long = objects.filter(F.octet_length("content") > most_object).select(F.lit("object exceeds its capacity").alias("problem"), F.col("content_hash").alias("detail"))
    twice = objects.groupBy("content_hash").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("object twice").alias("problem"), F.col("content_hash").alias("detail"))
    total = objects.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("n")).filter(F.col("n") > most_bytes).select(F.lit("bundle exceeds its capacity").alias("problem"), F.col("n").cast("string").alias("detail"))
    return long.unionByName(twice).unionByName(total)
