"""Reproducible stratified samples: two disjoint splits, round-robin quotas, hash ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: What ranks are for.
PARTITION, STRATUM_ORDER, SELECTION, OUTPUT = "partition", "stratum-order", "selection", "-output"
SPLITS = ("development", "held_out")


def rank(seed: str, purpose: str | Column, value: Column) -> Column:
    """SHA-256 of the compact JSON array of the three; hex text sorts as the number does.  Values are ASCII without quotes."""
    purpose = F.lit(purpose) if isinstance(purpose, str) else purpose
    return F.sha2(F.concat(F.lit(f'["{seed}","'), purpose, F.lit('","'), value, F.lit('"]')), 256)


def stratum(form: Column, employees: Column, website: Column, code: Column, label: Column) -> Column:
    band = F.when(employees.isNull() | (employees < 0), "unknown").when(employees == 0, "metadata_zero").when(employees < 10, "1_9").when(employees < 50, "10_49").otherwise("50_plus")
    site = F.when(F.trim(F.coalesce(website, F.lit(""))) != "", "recorded").otherwise("none_recorded")
    industry = F.when(F.lower(F.coalesce(label, F.lit(""))).contains("holding"), "holding_metadata").when(F.left(F.coalesce(code, F.lit("")), F.lit(2)).isin("64", "65", "66"), "64_66_metadata").otherwise("other")
    return F.concat_ws("|", F.when(form == "AS", "AS_metadata").otherwise("other_form"), band, site, industry)


def splits(universe: DataFrame, key: str, seed: str) -> DataFrame:
    """Adds split: an even hash is development, an odd one held_out."""
    even = F.substring(rank(seed, PARTITION, F.col(key).cast("string")), -1, 1).isin(*"02468ace")
    return universe.withColumn("split", F.when(even, "development").otherwise("held_out"))


def quotas(split: DataFrame, seed: str, size: int) -> DataFrame:
    """(split, stratum, population, quota): seats go round the strata, in order of their hash, while they have members.

    The k-th seat of a stratum comes in round k, so seats are numbered by (round,
    stratum) and the first ``size`` of a split are given: a stratum's quota is how
    many of its seats are among them.  Only min(population, size) seats of a
    stratum can be, which bounds what is expanded.
    """
    counts = split.groupBy("split", "stratum").agg(F.count("*").alias("population"))
    seats = counts.select("split", "stratum", "population", F.explode(F.sequence(F.lit(1), F.least("population", F.lit(size)))).alias("round"))
    order = Window.partitionBy("split").orderBy("round", rank(seed, STRATUM_ORDER, F.col("stratum")), "stratum")
    given = seats.withColumn("seat", F.row_number().over(order)).filter(F.col("seat") <= size)
    taken = given.groupBy("split", "stratum").agg(F.count("*").alias("quota"))
    return counts.join(taken, ["split", "stratum"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)))


def select(universe: DataFrame, key: str, seed: str, size: int) -> DataFrame:
    """The members with the smallest ranks of each (split, stratum), as many as its quota, with their output order."""
    split = splits(universe, key, seed)
    members = split.withColumn("_rank", rank(seed, SELECTION, F.col(key).cast("string")))
    nth = F.row_number().over(Window.partitionBy("split", "stratum").orderBy("_rank", key))
    chosen = members.withColumn("_nth", nth).filter(F.col("_nth") <= size).join(F.broadcast(quotas(split, seed, size)), ["split", "stratum"]).filter(F.col("_nth") <= F.col("quota"))
    out = F.row_number().over(Window.partitionBy("split").orderBy(rank(seed, F.concat("split", F.lit(OUTPUT)), F.col(key).cast("string")), key))
    return chosen.withColumn("position", out).drop("_rank", "_nth")


def manifest(quotas_: DataFrame) -> DataFrame:
    """(split, strata, population, selected, unrepresented): what a sample stands for, one row a split."""
    left_out = F.array_sort(F.collect_list(F.when(F.col("quota") == 0, F.col("stratum"))))
    return quotas_.groupBy("split").agg(F.count("*").alias("strata"), F.sum("population").alias("population"), F.sum("quota").alias("selected"), left_out.alias("unrepresented"))


def strata_manifest(quotas_: DataFrame) -> DataFrame:
    """(stratum, population, and of each split its population and quota): one row a stratum."""
    of = lambda column, split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col(column))), F.lit(0))
    parts = [c for s in SPLITS for c in (of("population", s).alias(f"{s}_population"), of("quota", s).alias(s))]
    return quotas_.groupBy("stratum").agg(F.sum("population").alias("population"), *parts)


def split_manifest(chosen: DataFrame, quotas_: DataFrame, key: str, line: Column) -> DataFrame:
    """(split, count, sha256, members, unrepresented) of the files of a sample: each member's ``line``, ended by a newline, in order of position.

    A split without members has no row.  A file holds what was asked for, so it is
    put together in one row.
    """
    rows = chosen.select("split", F.struct("position", F.col(key).cast("string").alias("key"), line.alias("line")).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    files = rows.groupBy("split").agg(F.count("*").alias("count"), ordered.alias("_m"))
    body = F.concat(F.array_join(F.transform("_m", lambda m: m["line"]), "\n"), F.lit("\n"))
    every = quotas_.select("stratum").distinct().withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    seated = quotas_.filter("quota > 0").select("split", "stratum")
    lacking = every.join(seated, ["split", "stratum"], "left_anti").groupBy("split").agg(F.array_sort(F.collect_list("stratum")).alias("unrepresented"))
    files = files.select("split", "count", F.sha2(body, 256).alias("sha256"), F.transform("_m", lambda m: m["key"]).alias("members"))
    return files.join(lacking, "split", "left").withColumn("unrepresented", F.coalesce("unrepresented", F.array().cast("array<string>")))


def manifest_head(universe: DataFrame, split: DataFrame, seed: str, source: dict[str, str]) -> DataFrame:
    """One row: what a sample is of and how it was drawn; ``source`` has its file, sha256 and uncompressed digest."""
    fixed = {"algorithm": "balanced-strata-sha256-v1", "seed": seed, **source, "partition_policy": "SHA256(seed, partition, normalized orgnr) parity, stable across sample sizes", "independent_accuracy": "not_measured"}
    counts = split.agg(F.count("*").alias("source_record_count"), *(F.count_if(F.col("split") == s).alias(f"{s}_population") for s in SPLITS))
    return counts.select(*(F.lit(v).alias(k) for k, v in fixed.items()), *counts.columns)


def guards(universe: DataFrame, key: str, valid: Column, size: int) -> DataFrame:
    """(problem, n) that would refuse a universe: members twice, invalid identifiers, fewer members than the sample."""
    twice = universe.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("duplicate").alias("problem"), F.count("*").alias("n"))
    wrong = universe.agg(F.lit("invalid").alias("problem"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("n"))
    short = universe.agg(F.lit("exceeded").alias("problem"), F.when(F.count("*") < size, size - F.count("*")).otherwise(0).cast("long").alias("n"))
    return twice.unionByName(wrong).unionByName(short)
