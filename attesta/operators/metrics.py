"""Roll-ups of a batch: histograms, distinct claims, nearest-rank quantiles, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.selection import nearest_ranks


def histogram(df: DataFrame, state: str) -> DataFrame:
    return df.groupBy(state).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, **quantiles: float) -> DataFrame:
    """The ceil(n q)-th smallest finite, non-negative value of each key."""
    return nearest_ranks(df, keys, value, quantiles)


def rollup(facts: DataFrame, org: str, claim: str, supported: Column, external: Column) -> DataFrame:
    """Per organisation: observations and distinct claims, all, supported and from outside the registry."""
    return facts.groupBy(org).agg(
        F.count("*").alias("observations"),
        F.count_if(supported).alias("supported_observations"),
        F.count_distinct(claim).alias("claims"),
        F.count_distinct(F.when(supported, F.col(claim))).alias("supported_claims"),
        F.count_distinct(F.when(supported & external, F.col(claim))).alias("external_claims"),
    )


def totals(rolled: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("observations", "supported_observations", "claims", "supported_claims", "external_claims")]
    return rolled.agg(F.count("*").alias("organisations"), *sums).withColumn("claims_each", F.round(F.try_divide("supported_claims", F.col("organisations")), 6))


def families(facts: DataFrame, org: str, category: str) -> DataFrame:
    """How many organisations have each category."""
    return facts.select(org, category).distinct().groupBy(category).agg(F.count("*").alias("organisations"))


def telemetry(events: DataFrame, labels: list[str], success: Column, retry: Column) -> DataFrame:
    """Counts for every label's values and over all, in one pass by grouping sets: (label, label_value, total, successful, failed, retries)."""
    flagged = events.select(*labels, success.alias("_ok"), retry.alias("_retry"))
    grouped = flagged.groupingSets([[F.col(x)] for x in labels] + [[]], *labels).agg(
        F.count("*").alias("total"),
        F.count_if("_ok").alias("successful"),
        F.count_if(~F.col("_ok")).alias("failed"),
        F.count_if("_retry").alias("retries"),
        F.grouping_id(*labels).alias("_g"),
    )
    label, value = F.lit("all"), F.lit("")
    for k, name in enumerate(labels):
        own = F.col("_g") == (1 << len(labels)) - 1 - (1 << (len(labels) - 1 - k))
        label, value = F.when(own, F.lit(name)).otherwise(label), F.when(own, F.col(name).cast("string")).otherwise(value)
    return grouped.select(label.alias("label"), value.alias("label_value"), "total", "successful", "failed", "retries")


def page_consistency(pages: DataFrame, parent: str) -> DataFrame:
    """Does each parent's set of pages add up?  Pages have number, size, total_elements, total_pages and rows."""
    seen = pages.groupBy(parent).agg(
        F.count("*").alias("pages"),
        F.count_distinct("number").alias("numbers"),
        F.min("total_elements").alias("least"),
        F.max("total_elements").alias("most"),
        F.max("total_pages").alias("total_pages"),
        F.max("size").alias("size"),
        F.sum("rows").alias("rows"),
    )
    whole = (F.col("least") == F.col("most")) & (F.col("pages") == F.col("numbers")) & (F.col("pages") == F.col("total_pages")) & (F.col("rows") == F.col("most")) & (F.col("total_pages") == F.ceil(F.col("most") / F.col("size")))
    return seen.select(parent, "pages", "rows", F.when(whole, "complete").otherwise("incomplete").alias("state"))


def period_competition(records: DataFrame, keys: list[str], record: str) -> DataFrame:
    """One record for each key and period, or none where records compete: (keys, records, canonical)."""
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.when(F.min(record).eqNullSafe(F.max(record)), F.min(record)).alias("canonical"))
