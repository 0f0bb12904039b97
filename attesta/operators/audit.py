"""Integrity counters and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), "n")


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key is an orphan."""
    return rows.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def contamination(rows: DataFrame, owners: DataFrame, key: str, org: str) -> DataFrame:
    """Rows that belong to another organisation than what they refer to."""
    return rows.alias("a").join(owners.select(key, F.col(org).alias("_owner")), key).filter(F.col(org) != F.col("_owner"))


def urls_of_many_sources(sources: DataFrame) -> DataFrame:
    """(url, run_id) of more than one distinct source."""
    return sources.filter("url IS NOT NULL").groupBy("url", "run_id").agg(F.count_distinct("source_id").alias("n")).filter("n > 1")


def verdict(*counters: DataFrame) -> DataFrame:
    """All counters, each with whether it is zero."""
    return reduce(DataFrame.unionByName, counters).withColumn("ok", F.col("n") == 0)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, repetitions counted; empty if the two are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
