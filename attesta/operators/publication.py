"""Publication of results: what may be stored, what is refused, and all tables of a result at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.numbers import canonical_plain
from attesta.operators import history, support, verify
from attesta.operators.ledger import first_by
from attesta.sources.commits import CommitLog, compared


def plan(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Adds outcome to rows of one id each: insert, same (stored as it is) or refused (stored with other content)."""
    return compared(rows, stored, key)


def read_published(spark: SparkSession, path: str, name: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a table from publications that were completed, up to a version."""
    return CommitLog(spark, path).read(name, schema, version)


def publish(spark: SparkSession, path: str, tables: dict[str, tuple[DataFrame, str | list[str]]]) -> int | None:
    """Store the new rows of all ``tables`` (name: (rows, key)), visible together; the version of this publication, null where nothing is new.

    Rows of a stored id must be equal to it, those included that another writer
    publishes meanwhile (sources/commits.py).
    """
    return CommitLog(spark, path).publish(tables)


def latest_companies(seen: DataFrame, key: str, run: str, seq: str, columns: list[str]) -> DataFrame:
    """One row an organisation: the first run that saw it, and what the last one said."""
    first = F.min_by(run, seq).alias("first_seen_run")
    return seen.groupBy(key).agg(first, F.max_by(F.struct(F.col(run).alias("last_run"), *columns), seq).alias("_l")).select(key, "first_seen_run", "_l.*")


def replaced(stored: DataFrame, rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Stored rows with ``rows`` in place of those of their ids; of several new rows of one id the last."""
    fresh = first_by(rows, [key], F.col(seq).desc())
    return stored.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def batch_check(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: input_count, result_count, results missing, foreign and repeated, and whether the batch is complete."""
    named = inputs.select(key).distinct()
    counts = results.groupBy(key).agg(F.count("*").alias("n"))
    both = named.withColumn("_in", F.lit(True)).join(counts, key, "full_outer")
    seen = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_in").isNull()).alias("foreign"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("n"), F.lit(0)).alias("result_count"))
    return inputs.agg(F.count("*").alias("input_count")).join(seen).withColumn("complete", (F.col("missing") == 0) & (F.col("foreign") == 0) & (F.col("repeated") == 0))


def stable_id(kind: str, *parts: Column) -> Column:
    """An id of 64 bits that follows from its parts."""
    return F.concat(F.lit(f"{kind}_"), F.left(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), F.lit(16)))


# ---- comparison and refresh

ASSERTED = ["currency", "unit", "valid_from", "valid_to"]


def assertion(value: str = "value", category: str = "category", qualifiers: list[str] = ASSERTED) -> Column:
    """What an observation asserts: its qualifiers, and its value as exact decimal in financials, else as JSON text."""
    number = F.when(F.col(category) == "financials", canonical_plain(F.regexp_replace(value, '^"|"$', "")))
    return F.to_json(F.struct(*(F.coalesce(F.col(q).cast("string"), F.lit("\x00")).alias(q) for q in qualifiers), F.coalesce(number, F.col(value), F.lit("\x00")).alias("value")))


def full_reasons(facts: DataFrame, sources: DataFrame, evidence: DataFrame, captures: DataFrame, blobs: DataFrame) -> DataFrame:
    """(fact_id, reason): the first rule that a fact breaks of the citation chain and then of snapshot support, else ok."""
    bare = facts.withColumn("value", F.when(F.col("category") == "financials", F.regexp_replace("value", '^"|"$', "")).otherwise(F.col("value")))
    chain = verify.check_citations(bare, sources, evidence).select("fact_id", F.col("reason").alias("_chain"))
    retained = support.check_support(facts, sources, evidence, captures, blobs).select("fact_id", F.col("reason").alias("_support"))
    reason = F.when(F.col("_chain") != "ok", F.col("_chain")).when(F.col("_support") != "ok", F.concat(F.lit("snapshot support: "), F.col("_support"))).otherwise("ok")
    return chain.join(retained, "fact_id").select("fact_id", reason.alias("reason"))


def carried(previous: DataFrame, current: DataFrame, reasons: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """What of a previous result goes along: last_known facts, sources and evidence that they need, unknowns.

    previous: fact_id, claim_id, source_id, evidence_id; current: claim_id;
    reasons: fact_id, reason (of revalidation); evidence: evidence_id,
    identity_source_id.  Facts that no longer have support are dropped and said so.
    """
    judged = previous.join(reasons, "fact_id")
    fine = judged.filter("reason = 'ok'").drop("reason")
    sources = fine.select("source_id").unionByName(fine.join(evidence, "evidence_id").select(F.col("identity_source_id").alias("source_id")).filter("source_id IS NOT NULL")).distinct()
    said = F.concat(F.lit("Previous observation "), F.col("fact_id").cast("string"), F.lit(" failed support revalidation: "), F.col("reason"))
    return {
        "last_known": history.last_known(fine, current, ["claim_id"]),
        "sources": sources,
        "evidence": fine.select("evidence_id").distinct(),
        "unknowns": judged.filter("reason <> 'ok'").select("fact_id", said.alias("unknown")),
    }


def attempts(sources: DataFrame, outcomes: DataFrame, state: Column, reason: Column) -> DataFrame:
    """(source_id, state, reason) of every source: what its producer said, else what follows from the source."""
    said = outcomes.select("source_id", F.col("state").alias("_s"), F.col("reason").alias("_r"))
    joined = sources.withColumns({"state": state, "reason": reason}).join(said, "source_id", "left")
    own = F.col("_s").isNotNull()
    return joined.select("source_id", F.when(own, F.col("_s")).otherwise(F.col("state")).alias("state"), F.when(own, F.col("_r")).otherwise(F.col("reason")).alias("reason"))


# ---- validation

#: Fixed values.
TERMINAL = ["available", "not_available", "blocked", "not_applicable", "ambiguous", "failed"]
REQUIRED = ["run_id", "organisation_number", "status"]
FACT_REQUIRED = ["fact_id", "org_number", "category", "field", "source_id", "evidence_id"]


def envelope_error() -> Column:
    """The first rule of a result envelope that it breaks; null if none.

    Columns: schema_version, status, organisation_number, company_number, sources
    array<struct<source_id, org_number, access_status>>, evidence
    array<struct<evidence_id, source_id, org_number, locator_kind, identity_source_id>>,
    and facts, conflicts and last_known, arrays of
    struct<fact_id, claim_id, org_number, source_id, evidence_id, status>.
    """
    c = F.col
    ids = lambda name, field: F.transform(name, lambda x: x[field])
    once = lambda listed: F.size(F.array_distinct(listed)) == F.size(listed)
    kinds, observed = ids("evidence", "locator_kind"), F.concat("facts", "conflicts")
    everything = F.concat("facts", "conflicts", "last_known")
    own = lambda org: F.coalesce(org == c("organisation_number"), F.lit(False))
    source_of = lambda f: F.get(F.filter("sources", lambda s: s["source_id"] == f["source_id"]), F.lit(0))
    evidence_of = lambda f: F.get(F.filter("evidence", lambda e: e["evidence_id"] == f["evidence_id"]), F.lit(0))
    foreign = lambda x: x["org_number"].isNotNull() & (x["org_number"] != "") & ~own(x["org_number"])
    html = F.filter("evidence", lambda e: e["locator_kind"] == "html_json_ld")
    anchored = lambda e: F.exists("sources", lambda s: (s["source_id"] == e["identity_source_id"]) & (s["access_status"] == "success"))
    none_shared = lambda a, b: ~F.arrays_overlap(ids(a, "claim_id"), ids(b, "claim_id"))
    return support.first_failure(
        ((c("schema_version") != "1.1") | (F.size(html) == 0), "HTML evidence requires result schema_version 1.2"),
        ((c("schema_version") == "1.3") | ~F.coalesce(F.array_contains(kinds, "json_number"), F.lit(False)), "monetary number evidence requires result schema_version 1.3"),
        (c("status").isin(TERMINAL), "invalid terminal status"),
        (c("company_number").isNull() | own(c("company_number")), "identity belongs to another company"),
        (once(ids("sources", "source_id")) & once(ids("evidence", "evidence_id")), "duplicate source or evidence IDs"),
        (F.forall(html, anchored), "HTML identity anchor missing from result sources"),
        (F.forall("conflicts", lambda f: f["status"] == "CONFLICT"), "conflict observations must carry CONFLICT status"),
        (F.forall("last_known", lambda f: f["status"] == "SOURCE_UNAVAILABLE"), "last-known observations must carry SOURCE_UNAVAILABLE status"),
        (none_shared("facts", "last_known"), "current claim cannot also be last-known"),
        (none_shared("facts", "conflicts"), "conflicting claim cannot also be published"),
        (once(ids(observed, "fact_id")), "duplicate observation IDs in result"),
        (F.forall(everything, lambda f: own(f["org_number"])), "claim belongs to another company"),
        (F.forall(everything, lambda f: source_of(f).isNotNull() & F.coalesce(evidence_of(f)["source_id"] == f["source_id"], F.lit(False))), "claim has dangling source/evidence reference"),
        (F.forall(everything, lambda f: ~foreign(source_of(f))), "source belongs to another company"),
        (F.forall(everything, lambda f: ~foreign(evidence_of(f))), "evidence belongs to another company"),
        (F.forall("facts", lambda f: f["status"] == "PUBLISHED"), "published facts must carry PUBLISHED status"),
    )


def result_errors(body: Column) -> Column:
    """All structural errors of a legacy result, as JSON text; a result of a known schema has its envelope checked instead."""
    v = F.try_parse_json(body)
    at = lambda path, kind="string": F.try_variant_get(v, path, kind)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    there = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    filled = lambda path: there(path) & (kind(path) != "VOID")
    version = at("$.schema_version")
    facts = F.when(kind("$.facts").startswith("ARRAY"), F.try_variant_get(v, "$.facts", "array<variant>"))
    fact_errors = F.flatten(
        F.transform(
            facts,
            lambda f, i: F.when(~F.schema_of_variant(f).startswith("OBJECT"), F.array(F.concat(F.lit("facts["), i.cast("string"), F.lit("] must be an object")))).otherwise(
                F.array_compact(F.array(*(F.when(F.try_variant_get(f, f"$.{k}", "variant").isNull(), F.concat(F.lit("facts["), i.cast("string"), F.lit(f"] missing {k}"))) for k in FACT_REQUIRED)))
            ),
        )
    )
    number = F.regexp_replace(at("$.organisation_number"), " ", "")
    count, cost = at("$.research_metadata.request_count", "double"), at("$.research_metadata.estimated_cost_usd", "double")
    is_number = lambda path: kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    listed = F.array_compact(
        F.array(
            *(F.when(~there(f"$.{k}"), F.lit(f"missing required field: {k}")) for k in REQUIRED),
            F.when(filled("$.status") & ~at("$.status").isin(TERMINAL), F.concat(F.lit("invalid status: '"), at("$.status"), F.lit(f"' (expected one of {sorted(TERMINAL)})"))),
            F.when(filled("$.organisation_number") & ~number.rlike("^[0-9]{9}$"), F.concat(F.lit("invalid organisation_number format: '"), at("$.organisation_number"), F.lit("'"))),
            F.when(filled("$.research_metadata.request_count") & (~kind("$.research_metadata.request_count").startswith("BIGINT") | (count < 0)), F.lit("research_metadata.request_count must be a non-negative integer")),
            F.when(filled("$.research_metadata.estimated_cost_usd") & (~is_number("$.research_metadata.estimated_cost_usd") | (cost < 0)), F.lit("research_metadata.estimated_cost_usd must be a non-negative number")),
            F.when(filled("$.facts") & facts.isNull(), F.lit("facts must be a list")),
            F.when(filled("$.changes") & ~kind("$.changes").startswith("ARRAY"), F.lit("changes must be a list")),
        )
    )
    legacy = F.concat(listed, F.coalesce(fact_errors, F.array().cast("array<string>")))
    return (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("result must be a JSON object")))
        .when(version.isin("1.1", "1.2", "1.3"), F.array().cast("array<string>"))
        .when(there("$.schema_version"), F.array(F.concat(F.lit("unsupported schema_version: '"), version, F.lit("'; expected '1.1', '1.2' or '1.3'"))))
        .otherwise(legacy)
    )


def accounting_error() -> Column:
    """The first rule that a bundle's accounting breaks; null if none.

    Columns: observed_at, accounting_state, requests, estimated_cost_usd, budget
    (its limit of requests), finalized_run, completed_at, successful, failed,
    unstarted, retries, remaining, transport_operations, unresolved.
    """
    c = F.col
    totals = [c("requests"), c("estimated_cost_usd"), c("budget")]
    every = reduce(lambda a, b: a & b, (x.isNotNull() for x in totals))
    none = reduce(lambda a, b: a & b, (x.isNull() for x in totals))
    counted = c("budget").isNotNull() & c("requests").isNotNull()
    counters = [F.coalesce(c(k), F.lit(0)) for k in ("successful", "failed", "unstarted", "retries")]
    natural = reduce(lambda a, b: a & b, (x >= 0 for x in counters))
    unresolved = c("requests") - counters[0] - counters[1] - counters[2]
    agree = c("remaining").eqNullSafe(c("budget") - c("requests")) & c("transport_operations").eqNullSafe(counters[0] + counters[1]) & c("unresolved").eqNullSafe(unresolved) & (unresolved >= 0)
    return support.first_failure(
        (support.zoned(c("observed_at")), "accounting observation time must include a timezone"),
        ((c("accounting_state") != "recorded") | every, "recorded accounting requires totals and original budget"),
        ((c("accounting_state") != "unavailable") | none, "unavailable accounting must not invent totals or limits"),
        (~c("finalized_run") | c("completed_at").isNotNull(), "finalized accounting requires recorded completion time"),
        (~counted | natural, "request outcome counters must be nonnegative integers"),
        (~counted | agree, "request accounting counters disagree"),
    )
