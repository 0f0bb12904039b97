"""Results in the starter shape: a projection of nested results, without joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
BASIS = "public starter illustrative OUTPUT_CONTRACT.md"
STRUCTURED = {
    "1.2": "Typed retained JSON/HTML locator and raw value; HTML assertions are source-authored",
    "1.3": "Typed retained JSON/HTML/JSON-number locator and raw value; HTML assertions are source-authored; amounts carry exact source lexemes, currency, full period and multiplier",
}
PLAIN = "JSON pointer and raw value; claim_span is null, never a generated quote"


def _with(item: Column, kept: list[str], **more: Column) -> Column:
    """A struct's members, but for those that are replaced or come with it."""
    return F.struct(*(item[n].alias(n) for n in kept if n not in more), *(x.alias(n) for n, x in more.items()))


def starter(results: DataFrame, shape: str) -> DataFrame:
    """Each result in the starter shape, its further columns unchanged; ``shape`` is what the shape's version is called.

    results: schema_version, status, run_id, started_at, completed_at, duration_sec,
    and arrays of structs: facts (claim_id, category, field, fact_confidence,
    evidence_id and others), evidence (evidence_id, source_id, source_type,
    content_hash, evidence_text, locator_kind and others), sources (source_id, url,
    final_url, source_type).  Evidence whose source isn't there has no URL; of sources
    of one id the last counts; a duration that is no time is unknown.
    """
    members = lambda name: results.schema[name].dataType.elementType.names
    by_id = F.map_from_arrays(F.array_distinct(F.transform("sources", lambda s: s["source_id"])), F.transform(F.array_distinct(F.transform("sources", lambda s: s["source_id"])), lambda i: F.element_at(F.filter("sources", lambda s: s["source_id"] == i), -1)))
    rows = results.withColumn("_by", by_id)
    site = lambda f: (f["category"] == "identity") & (f["field"] == "website")
    claims = F.transform(
        "facts",
        lambda f: _with(f, members("facts"), id=f["claim_id"], canonical_field=f["field"], field=F.when(site(f), "registered_website").otherwise(f["field"]), availability=F.lit("available"), confidence=f["fact_confidence"], evidence_ids=F.array(f["evidence_id"])),
    )
    source = lambda e: F.try_element_at(F.col("_by"), e["source_id"])
    evidence = F.transform(
        "evidence",
        lambda e: _with(
            e, members("evidence"), id=e["evidence_id"], source_url=F.coalesce(source(e)["final_url"], source(e)["url"]), source_class=F.coalesce(source(e)["source_type"], e["source_type"]), content_sha256=e["content_hash"],
            claim_span=F.lit(None).cast("string"), display_text=e["evidence_text"], support_representation=F.coalesce(e["locator_kind"], F.lit("unlocated_candidate")),
        ),
    )
    time = F.col("duration_sec")
    runtime = F.when((time >= 0) & (time < float("inf")) & ~F.isnan(time), time * 1000)
    structured = F.lit(PLAIN)
    for version, text in STRUCTURED.items():
        structured = F.when(F.col("schema_version") == version, F.lit(text)).otherwise(structured)
    unknown = F.lit(None).cast("double")
    made = {
        "canonical_schema_version": F.col("schema_version"),
        "availability": F.col("status"),
        "run": F.struct("run_id", "started_at", "completed_at", F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("terminal_status")),
        "claims": claims,
        "evidence": evidence,
        "operations": F.struct(unknown.alias("requests"), unknown.alias("third_party_cost_usd"), runtime.alias("runtime_ms"), F.lit("per_company_requests_and_cost_not_recorded").alias("attribution"), F.lit("manifest.json#/operations").alias("whole_run_operations")),
        "compatibility": F.struct(F.lit(BASIS).alias("basis"), F.lit("unverified").alias("organizer_acceptance"), structured.alias("structured_evidence")),
    }
    gone = {"_by", "facts", "run_id", "started_at", "completed_at", "duration_sec", "schema_version"}
    return rows.select(*(c for c in rows.columns if c not in gone and c not in made), F.lit(shape).alias("schema_version"), *(x.alias(n) for n, x in made.items()))
