"""Profiles: coverage, identity projection, nested envelopes and briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ledger import first_by
from attesta.operators.views import top_each


def coverage(facts: DataFrame, org: str, category: str, categories: list[str], published: Column, conflict: Column) -> DataFrame:
    """One row an organisation, one column a category: ambiguous before found before not_found."""
    flags = facts.select(org, F.col(category).alias("_c"), published.alias("_p"), conflict.alias("_x"))
    state = lambda c: F.when(F.max((F.col("_c") == c) & F.col("_x")), "ambiguous").when(F.max((F.col("_c") == c) & F.col("_p")), "found").otherwise("not_found").alias(c)
    return flags.groupBy(org).agg(*map(state, categories))


def coverage_counts(covered: DataFrame, categories: list[str]) -> DataFrame:
    """Adds found and researched: categories found, and with any state but not_found."""
    count = lambda test: sum((F.when(test(F.col(c)), 1).otherwise(0) for c in categories), F.lit(0))
    return covered.withColumns({"found": count(lambda x: x == "found"), "researched": count(lambda x: x != "not_found")})


def identity_projection(facts: DataFrame, org: str, fields: list[str], field: str, value: str, at: str, seq: str) -> DataFrame:
    """One row an organisation: the last value of each field, and the sorted fields without one."""
    last = first_by(facts.filter(F.col(field).isin(fields)), [org, field], F.col(at).desc_nulls_last(), F.col(seq).desc())
    wide = last.groupBy(org).pivot(field, fields).agg(F.first(value))
    missing = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields))))
    return wide.withColumn("unresolved_fields", missing)


def envelopes(entities: DataFrame, facts: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Entities with their facts nested in order; a profile holds what one entity has."""
    nested = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("facts"))
    return entities.join(nested, key, "left").withColumn("facts", F.coalesce("facts", F.array().cast(nested.schema["facts"].dataType)))


def input_mapping(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every occurrence of an input, in order, with the one result of its key."""
    return inputs.join(results, key, "left")


def brief(facts: DataFrame, key: str, rank: Column, text: Column, most: int | None = None) -> DataFrame:
    """The cited sentences of each entity in order of rank, joined by spaces; only the first ``most`` are gathered."""
    rows = facts.select(key, rank.alias("r"), text.alias("t"))
    rows = top_each(rows, [key], most, "r", "t") if most else rows
    ordered = F.array_sort(F.collect_list(F.struct("r", "t")))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("brief"))
