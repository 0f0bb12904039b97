"""Citation checks: a fact against the records of its source and evidence, captures against the retained bytes' hash and length.

Deriving values again from the bytes by their locators is the matter of support.py.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.numbers import quoted_number

#: Years in a text: numbers of their own, not digits of a longer number (a record's id, an amount) and not what stands
#: before a decimal part; dates (2024.12.31) and lists of years (2023,2024) have them.
YEAR = r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])(?![.,](?!(?:19|20)[0-9]{2}(?![0-9]))[0-9]++(?![.,\-/][0-9]))"


def check_citations(facts: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ok and reason: the first rule of the chain that a fact breaks, else ok.

    facts: org_number, category, field, item_key, value, currency,
    reporting_period, entity_verdict, source_id, evidence_id.
    sources: source_id, access_status, source_type, content_type, org_number, content_hash.
    evidence: evidence_id, source_id, evidence_text, entity_verdict, org_number, content_hash, locator_kind.
    """
    s = sources.select(*(F.col(c).alias(f"s_{c}") for c in ("source_id", "access_status", "source_type", "content_type", "org_number", "content_hash")))
    e = evidence.select(*(F.col(c).alias(f"e_{c}") for c in ("evidence_id", "source_id", "evidence_text", "entity_verdict", "org_number", "content_hash", "locator_kind")))
    rows = facts.join(s, F.col("source_id") == F.col("s_source_id"), "left").join(e, F.col("evidence_id") == F.col("e_evidence_id"), "left")
    c = F.col
    given = lambda name: F.coalesce(c(name), F.lit("")) != ""
    differs = lambda a, b: given(a) & ~c(a).eqNullSafe(c(b))
    html = (c("s_source_type") == "company_website") | (F.trim(F.lower(F.substring_index(F.coalesce("s_content_type", F.lit("")), ";", 1))) == "text/html")
    year = F.regexp_extract(c("reporting_period"), "(?:19|20)[0-9]{2}", 0)
    money = c("category") == "financials"
    chain: list[tuple[Column, Column | str]] = [
        (~F.coalesce(c("entity_verdict"), F.lit("")).isin("VERIFIED", "LIKELY"), F.concat(F.lit("entity verdict "), F.coalesce("entity_verdict", F.lit("None")))),
        (F.concat_ws("/", "category", "field").isin("jobs/job_posting", "locations/branch") & (F.trim(F.coalesce("item_key", F.lit(""))) == ""), "collection claim requires a stable source item key"),
        (c("s_source_id").isNull(), "source not found in ledger"),
        (~c("s_access_status").eqNullSafe(F.lit("success")), F.concat(F.lit("source access_status="), F.coalesce("s_access_status", F.lit("None")))),
        (c("e_evidence_id").isNull(), "evidence not found in ledger"),
        (~c("e_source_id").eqNullSafe(c("source_id")), "evidence belongs to different source"),
        (F.coalesce(html, F.lit(False)) & ~c("e_locator_kind").eqNullSafe(F.lit("html_json_ld")), "HTML publication requires a typed retained-content locator"),
        (~given("e_evidence_text"), "evidence text empty"),
        (~c("e_entity_verdict").eqNullSafe(c("entity_verdict")), "claim and evidence identity verdicts disagree"),
        (differs("s_org_number", "org_number"), "source belongs to different company"),
        (differs("e_content_hash", "s_content_hash"), "source and evidence hashes disagree"),
        (differs("e_org_number", "org_number"), F.concat(F.lit("evidence belongs to different company ("), c("e_org_number"), F.lit(")"))),
        (c("value").isNull(), "fact value is None"),
        (money & ~given("currency"), "financial fact missing currency"),
        (money & ~given("reporting_period"), "financial fact missing reporting period"),
        (money & ~F.array_contains(F.regexp_extract_all("e_evidence_text", F.lit(r"\w+"), F.lit(0)), c("currency")), "financial currency absent from evidence"),
        (money & ((year == "") | ~F.array_contains(F.regexp_extract_all("e_evidence_text", F.lit(YEAR), F.lit(0)), year)), "financial reporting year absent from evidence"),
        (money & ~quoted_number(c("value"), c("e_evidence_text")), "financial value absent from evidence"),
    ]
    reason = reduce(lambda w, x: w.when(x[0], x[1]), chain[1:], F.when(*chain[0])).otherwise("ok")
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok").select(*facts.columns, "ok", "reason")


def check_captures(captures: DataFrame, blobs: DataFrame) -> DataFrame:
    """Does each capture have its bytes, with the stated hash and length?  (capture columns, state)."""
    b = blobs.select(F.col("content_hash").alias("_h"), "content")
    state = (
        F.when(F.col("content").isNull(), "missing")
        .when(F.sha2("content", 256) != F.col("content_hash"), "hash differs")
        .when(F.octet_length("content") != F.col("byte_count"), "length differs")
        .otherwise("intact")
    )
    return captures.join(b, F.col("content_hash") == F.col("_h"), "left").withColumn("state", state).select(*captures.columns, "state")


def envelope_errors(profiles: DataFrame) -> DataFrame:
    """(key, error) of profiles whose facts repeat an id, refer to nothing, or are of another organisation.

    profiles: organisation_number, facts array<struct<fact_id, org_number, source_id, status>>, sources array<struct<source_id>>.
    """
    ids, known = F.col("facts.fact_id"), F.col("sources.source_id")
    checks = {
        "duplicate fact id": F.size(F.array_distinct(ids)) < F.size(ids),
        "duplicate source id": F.size(F.array_distinct(known)) < F.size(known),
        "dangling source": F.size(F.array_except(F.col("facts.source_id"), known)) > 0,
        "foreign fact": F.exists("facts", lambda f: ~f["org_number"].eqNullSafe(F.col("organisation_number"))),
        "unpublished fact": F.exists("facts", lambda f: f["status"] != "PUBLISHED"),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    return profiles.select("organisation_number", F.explode(found).alias("error"))
