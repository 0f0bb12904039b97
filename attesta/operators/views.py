"""Lookups, orders and selections over facts, runs, sources and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators.ledger import first_by


def in_order(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Adds position: the place of each row among those of its key."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def top_each(rows: DataFrame, keys: list[str], most: int, *order: str | Column) -> DataFrame:
    """The first ``most`` rows of each key, with their position; Spark drops the rest before the shuffle."""
    return in_order(rows, keys, *order).filter(F.col("position") <= most)


def selected_inputs(inputs: DataFrame, position: str, most: int) -> DataFrame:
    """Adds selected: is the input among the first ``most``?  The others are the excluded ones."""
    return inputs.withColumn("selected", F.col(position) < most)


def page_repeats(records: DataFrame, parent: str, item: str, content: list[str], *order: str | Column) -> DataFrame:
    """Adds state of each record of a paged collection: new, repeated (as the last one of that item was, so skipped) or changed (kept)."""
    w = Window.partitionBy(parent, item).orderBy(*order)
    value = F.struct(*content)
    rows = records.withColumns({"_nth": F.row_number().over(w), "_before": F.lag(value).over(w)})
    return rows.withColumn("state", F.when(F.col("_nth") == 1, "new").when(F.col("_before").eqNullSafe(value), "repeated").otherwise("changed")).drop("_nth", "_before")


def shown_facts(facts: DataFrame, slot: list[str], status: str, at: str, seq: str) -> DataFrame:
    """Of the facts that a view shows the one retrieved last in each slot; the earlier one wins ties, a null time is the least."""
    return first_by(facts.filter(F.col(status).isin("PUBLISHED", "CONFLICT", "SOURCE_UNAVAILABLE")), slot, F.coalesce(F.col(at).cast("string"), F.lit("")).desc(), F.col(seq).asc())


def previous_hash(sources: DataFrame, runs: DataFrame, run: Column) -> DataFrame:
    """(url, content_hash): what each URL gave in the run started last, successfully, other than ``run``."""
    fine = sources.filter((F.col("access_status") == "success") & F.col("url").isNotNull() & (F.col("run_id") != run)).join(runs.select("run_id", "started_at"), "run_id")
    return fine.groupBy("url").agg(F.max(F.struct("started_at", "run_id", "content_hash")).alias("_m")).select("url", "_m.content_hash")


def claims(current: DataFrame, conflicts: DataFrame, last_known: DataFrame) -> DataFrame:
    """All claims of a result, with the state that their list stands for."""
    listed = {"current": current, "conflicting": conflicts, "last_known": last_known}
    return reduce(DataFrame.unionByName, (df.withColumn("state", F.lit(name)) for name, df in listed.items()))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that both have; disjoint sets give none."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def evidence_view(all_claims: DataFrame, evidence: DataFrame, captures: DataFrame) -> DataFrame:
    """(evidence_id, source_id, claims array of (state, claim_id), snapshot) of evidence that any claim of a frozen run refers to.

    ``captures`` has source_id, state and support (null or the reason why a claim isn't supported).
    """
    listed = all_claims.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("state", "claim_id"))).alias("claims"))
    rows = evidence.join(listed, "evidence_id").join(captures.select("source_id", "state", "support"), "source_id", "left")
    return rows.withColumn("snapshot", F.when(F.coalesce(F.col("state"), F.lit("missing")) != "intact", "snapshot_unavailable").when(F.col("support").isNotNull(), "claim_support_invalid").otherwise("verified")).drop("state", "support")


def ordered_union(*lists: Column) -> Column:
    """The distinct values of several lists in order of first appearance."""
    return F.array_distinct(F.concat(*lists))


def filters() -> dict[str, Column]:
    """What a view shows of facts, changes and sources, by columns status, change and access_status."""
    c = F.col
    return {
        "published_facts": c("status") == "PUBLISHED",
        "changed": c("change") != "UNCHANGED",
        "reached_sources": c("access_status") == "success",
        "limited_sources": c("access_status") == "rate_limited",
    }


def latest_instant(at: str) -> Column:
    """Aggregate: the text of the latest instant; texts without a time zone, or that are none, don't count."""
    text = F.col(at)
    zoned = text.rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$")
    instant = F.when(zoned, F.try_to_timestamp(text))
    return F.max(F.when(instant.isNotNull(), F.struct(F.unix_micros(instant).alias("us"), text.alias("at"))))["at"]


def day_number(text: Column) -> Column:
    """Days of a time text since the beginning of the Julian period, by which times of different precision are ordered."""
    return F.unix_micros(F.try_to_timestamp(text)) / F.lit(86_400_000_000.0) + F.lit(2_440_587.5)


def remaining(limit: Column, elapsed: Column) -> Column:
    return F.greatest(F.lit(0.0), limit - elapsed)


def phase(seconds: Column) -> Column:
    """What a run should still begin with so many seconds left."""
    return F.when(seconds > 20 * 60, "full_research").when(seconds > 10 * 60, "prioritize_high_value").when(seconds > 2 * 60, "finish_incomplete").otherwise("serialize_results")


def request_counters(used: Column, limit: Column, successful: Column, failed: Column, unstarted: Column) -> list[Column]:
    """Counters that follow from those that are stored."""
    return [(limit - used).alias("remaining"), (successful + failed).alias("transport_operations"), (used - successful - failed - unstarted).alias("unresolved_reservations")]


#: Result schemas, in order.
VERSIONS = ["1.1", "1.2", "1.3"]


def version_of(kinds: Column) -> Column:
    """The least schema that can represent evidence with these kinds of locators."""
    return F.when(F.array_contains(kinds, "json_number"), "1.3").when(F.array_contains(kinds, "html_json_ld"), "1.2").otherwise("1.1")


def latest_version(version: str) -> Column:
    """Aggregate: the version that stands last in VERSIONS."""
    at = F.array_position(F.array(*map(F.lit, VERSIONS)), F.col(version))
    return F.coalesce(F.element_at(F.array(*map(F.lit, VERSIONS)), F.nullif(F.max(at), F.lit(0)).cast("int")), F.lit(VERSIONS[0]))


def ordered_digest(order: str, line: Column) -> Column:
    """Aggregate: SHA-256 over the SHA-256 of each line, in order; for groups that fit a row."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.sha2(line, 256).alias("h")))), lambda x: x["h"]), ""), 256)
