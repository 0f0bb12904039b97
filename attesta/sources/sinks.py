"""Writers: immutable envelopes, content-addressed blobs and ordered bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.ordering import merkle, placed_lines


def new_rows(rows: DataFrame, stored: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Rows whose key isn't stored yet; fails where a stored key has another payload.

    Equal payloads are no operation, so a rerun after a lost job is safe.
    """
    had = stored.select(*keys, F.col(payload).alias("_had"))
    joined = rows.join(had, keys, "left")
    check = F.when(F.col("_had").isNull(), True).when(F.col("_had").eqNullSafe(F.col(payload)), False).otherwise(F.raise_error(F.concat(F.lit("stored with another payload: "), F.concat_ws("/", *keys))).cast("boolean"))
    return joined.filter(check).drop("_had")


def append_envelopes(rows: DataFrame, path: str, keys: list[str], payload: str, partition: str = "run_id") -> None:
    """Append what isn't there; Spark's commit protocol makes the files visible together."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = new_rows(rows, spark.read.parquet(path), keys, payload) if there else rows
    fresh.write.mode("append").partitionBy(partition).parquet(path)


def new_blobs(captures: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(content_hash, content, byte_count) of bytes not stored yet, each once."""
    blobs = captures.select(F.sha2("content", 256).alias("content_hash"), "content", F.octet_length("content").cast("long").alias("byte_count")).dropDuplicates(["content_hash"])
    return blobs if stored is None else blobs.join(stored.select("content_hash"), "content_hash", "left_anti")


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, ordered over all files: file names follow the ranges of the key."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").json(path)


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """Rows and an order-free digest: the sums of row hashes add up over partitions, as a running hash of lines can't."""
    row = F.xxhash64(*[F.to_json(F.struct(*rows.columns))])
    return rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


#: A manifest's columns.
MANIFEST = "rows bigint, keys bigint, digest string"


def file_manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row of a folder of JSON lines: rows, distinct keys, and a digest of the lines in order, which a swap of two changes (operators/ordering.py)."""
    lines = placed_lines(spark, path)
    counts = lines.agg(F.count("*").alias("rows"), F.count_distinct(F.get_json_object("value", f"$.{key}")).alias("keys"))
    digest = merkle(lines, "place", F.col("value")).withColumnRenamed("lines", "rows")
    return counts.join(digest, "rows", "left").select("rows", "keys", F.coalesce("digest", F.lit("")).alias("digest"))


def write_artifacts(path: str, artifacts: dict[str, tuple[DataFrame, str]]) -> None:
    """Each named table as ordered JSONL, and behind them a manifest with rows, keys and digest of each; without it the set isn't whole."""
    parts = []
    for name, (rows, key) in artifacts.items():
        write_jsonl(rows, f"{path}/{name}", [key])
        parts.append(file_manifest(rows.sparkSession, f"{path}/{name}", key).select(F.lit(name).alias("artifact"), "rows", "keys", "digest"))
    reduce(DataFrame.unionByName, parts).coalesce(1).write.mode("error").json(f"{path}/manifest")


def artifact_problems(spark: SparkSession, path: str, schemas: dict[str, tuple[T.StructType, str]]) -> DataFrame:
    """(artifact, problem) of a set: what isn't as its manifest says, or has no entry there."""
    stated = spark.read.schema(f"artifact string, {MANIFEST}").json(f"{path}/manifest")
    seen = reduce(DataFrame.unionByName, (file_manifest(spark, f"{path}/{name}", key).select(F.lit(name).alias("artifact"), "rows", "keys", "digest") for name, (_, key) in schemas.items()))
    both = stated.select("artifact", F.struct("rows", "keys", "digest").alias("a")).join(seen.select("artifact", F.struct("rows", "keys", "digest").alias("b")), "artifact", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "not in the manifest").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return both.select("artifact", problem.alias("problem")).filter("problem IS NOT NULL")
