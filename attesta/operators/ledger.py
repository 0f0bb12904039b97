"""The fact ledger: duplicates, conflicts, current, previous and temporal values.

A slot is the list of key columns that names a claim; ``seq`` is the order of
arrival.  All rules are windows over the slot, one shuffle each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def current_values(facts: DataFrame, slot: list[str], at: str, seq: str) -> DataFrame:
    """The observation retrieved last in each slot; the earlier arrival wins ties, a null time is the least."""
    return first_by(facts, slot, F.col(at).desc_nulls_last(), F.col(seq).asc())


def latest_period(facts: DataFrame, keys: list[str], period: str, seq: str) -> DataFrame:
    return first_by(facts, keys, F.coalesce(F.col(period).cast("string"), F.lit("")).desc(), F.col(seq).asc())


def previous_facts(facts: DataFrame, runs: DataFrame, run: Column, slot: list[str], at: str) -> DataFrame:
    """Of all other runs the observation retrieved last; the run started last wins ties."""
    joined = facts.join(runs.select("run_id", "started_at", "run_seq"), "run_id").filter(F.col("run_id") != run)
    return first_by(joined, slot, F.col(at).desc_nulls_last(), F.col("started_at").desc(), F.col("run_seq").desc())


def temporal_view(facts: DataFrame, keys: list[str], valid_from: str, period: str, at: str, published: Column | None = None) -> DataFrame:
    """Published observations in order of validity, with the beginning of the next as their end; without ``published`` those of status PUBLISHED."""
    facts = facts.filter(F.col("status") == "PUBLISHED" if published is None else published)
    order = [F.coalesce(F.col(valid_from).cast("string"), F.col(period).cast("string"), F.lit("")), F.col(at)]
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumns({"position": F.row_number().over(w), "valid_until": F.lead(valid_from).over(w)})


def ledger(facts: DataFrame, slot: list[str], assertion: str, repeat: list[str], seq: str) -> DataFrame:
    """Status of each valid observation, as if they arrived one by one.

    ``assertion`` is the canonical text of what is claimed, ``repeat`` the columns
    that make an observation a repetition of an earlier one.  Up to the first that
    differs from the slot's first assertion, repetitions are dropped; once one
    differs, all that is left of the slot is in conflict.
    """
    w = Window.partitionBy(*slot).orderBy(*repeat, seq)
    whole = Window.partitionBy(*slot)
    # one sort by slot, repetition and arrival serves all; a repetition has its like right in front of it
    rows = facts.withColumn("_again", F.lag(F.struct(*repeat)).over(w).eqNullSafe(F.struct(*repeat)))
    rows = rows.withColumn("_first", F.min_by(assertion, F.struct(seq)).over(whole))
    rows = rows.withColumn("_breach", F.min(F.when(~F.col(assertion).eqNullSafe(F.col("_first")), F.col(seq))).over(whole))
    rows = rows.filter(~F.col("_again") | (F.col(seq) >= F.col("_breach")))
    return rows.withColumn("status", F.when(F.col("_breach").isNotNull(), "CONFLICT").otherwise("PUBLISHED")).drop("_first", "_breach", "_again")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; null keys are a group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def mark_unavailable(facts: DataFrame, org: Column, source: Column) -> DataFrame:
    hit = (F.col("status") == "PUBLISHED") & (F.col("org_number") == org) & (F.col("source_id") == source)
    return facts.withColumn("status", F.when(hit, "SOURCE_UNAVAILABLE").otherwise(F.col("status")))
