"""Coverage, identity and benchmark rules over a result's facts in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.ledger import first_by
from attesta.operators.views import latest_instant

#: Categories of coverage; accounts outcomes that stand for missing financials; fields of identity and what they bring along.
CATEGORIES = ["identity", "business_description", "industry", "financials", "leadership", "locations", "products_services", "jobs", "recent_activity"]
ACCOUNTS = {"not_found": "not_available", "failed": "failed", "blocked": "blocked", "ambiguous": "ambiguous", "not_applicable": "not_applicable"}
INDUSTRY_FIELDS = ["industry_code", "industry_description"]
DEPENDENT = {"registered_address": ["municipality", "postal_code"], "status": ["bankrupt", "under_liquidation", "deleted_date"]}
REGISTRY = ["registry", "registry_accounts"]


def coverage_map(facts: DataFrame, org: str, accounts: DataFrame) -> DataFrame:
    """(org, coverage map): every category's state.

    facts: org, category, field, status (PUBLISHED or CONFLICT); accounts: org,
    accounts_status.  Conflicts make a category ambiguous; industry fields of the
    identity count for industry; missing financials take the accounts' outcome.
    """
    of_industry = F.col("field").isin(INDUSTRY_FIELDS)
    published, conflict = F.col("status") == "PUBLISHED", F.col("status") == "CONFLICT"
    moved = F.when((F.col("category") == "identity") & of_industry, "industry").otherwise(F.col("category"))
    found = lambda name: published & (of_industry if name == "industry" else F.col("category") == name)
    flags = [F.bool_or(F.coalesce(found(n), F.lit(False))).alias(f"p_{n}") for n in CATEGORIES] + [F.bool_or(conflict & (moved == n)).alias(f"x_{n}") for n in CATEGORIES]
    rows = accounts.select(org, "accounts_status").join(facts.groupBy(org).agg(*flags), org, "left")
    fallback = reduce(lambda w, kv: w.when(F.col("accounts_status") == kv[0], kv[1]), ACCOUNTS.items(), F.when(F.lit(False), F.lit(None).cast("string")))

    def state(name: str) -> Column:
        out = F.when(F.coalesce(f"x_{name}", F.lit(False)), "ambiguous").when(F.coalesce(f"p_{name}", F.lit(False)), "found")
        return (out.when(fallback.isNotNull(), fallback) if name == "financials" else out).otherwise("not_found")

    return rows.select(org, F.create_map(*(x for n in CATEGORIES for x in (F.lit(n), state(n)))).alias("coverage"))


def project_identity(facts: DataFrame, anchors: DataFrame, org: str, fields: list[str]) -> DataFrame:
    """(org, fields, last_verified_at, unresolved_fields): the supported value of each identity field.

    facts: org, category, field, value, status, subject_scope, item_key,
    retrieved_at, seq; anchors: org, and the fields as acquired.  Of several
    published observations the last counts.  A field without one is unresolved if
    the anchor had a value; a disputed one always, with what depends on it.  The
    name is then empty, the status unknown, the rest null.
    """
    own = facts.filter((F.col("category") == "identity") & F.col("field").isin(fields))
    seen = own.filter("status = 'PUBLISHED' AND subject_scope = 'legal_entity' AND item_key IS NULL")
    wide = first_by(seen, [org, "field"], F.col("seq").desc()).groupBy(org).pivot("field", fields).agg(F.first("value"))
    wide = wide.select(org, *(F.col(f).alias(f"_v_{f}") for f in fields))
    verified = facts.filter("category = 'identity' AND status = 'PUBLISHED' AND subject_scope = 'legal_entity' AND item_key IS NULL").groupBy(org).agg(latest_instant("retrieved_at").alias("last_verified_at"))
    disputed = own.filter("status = 'CONFLICT'").groupBy(org).agg(F.collect_set("field").alias("_disputed"))
    rows = anchors.join(wide, org, "left").join(verified, org, "left").join(disputed, org, "left").withColumn("_disputed", F.coalesce("_disputed", F.array().cast("array<string>")))
    brought = F.flatten(F.array(*(F.when(F.array_contains("_disputed", f), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")) for f, more in DEPENDENT.items())))
    had = lambda f: F.col(f).isNotNull() & ~F.col(f).isin("", "unknown")
    missing = F.array_compact(F.array(*(F.when(F.col(f"_v_{f}").isNull() & had(f), F.lit(f)) for f in fields)))
    rows = rows.withColumn("unresolved_fields", F.array_sort(F.array_distinct(F.concat(missing, "_disputed", brought))))
    empty = lambda f: F.lit({"legal_name": "", "status": "unknown"}.get(f)).cast("string")
    value = lambda f: F.when(F.array_contains("unresolved_fields", f), empty(f)).otherwise(F.coalesce(f"_v_{f}", empty(f))).alias(f)
    return rows.select(org, *map(value, fields), "last_verified_at", "unresolved_fields")


def result_rollup(facts: DataFrame, sources: DataFrame, rejected: DataFrame, org: str) -> DataFrame:
    """One row an organisation: observations, distinct claims, what of them has support, is external, is last-known; sources and rejections.

    facts: org, claim_id, source_id, source_type, supported, list (facts or
    last_known); sources: org, access_status; rejected: org.
    """
    current, old = F.col("list") == "facts", F.col("list") == "last_known"
    fine = current & F.col("supported")
    external = fine & ~F.col("source_type").isin(REGISTRY)
    distinct = lambda test, column: F.count_distinct(F.when(test, F.col(column)))
    rolled = facts.groupBy(org).agg(
        F.count_if(current).alias("published_observations"), F.count_if(fine).alias("supported_observations"), distinct(current, "claim_id").alias("published_claims"), distinct(fine, "claim_id").alias("supported_claims"),
        distinct(external, "claim_id").alias("external_supported_claims"), distinct(old, "claim_id").alias("last_known_claims"), distinct(old, "source_id").alias("last_known_source_records"),
    )
    reached = sources.groupBy(org).agg(F.count_if(F.col("access_status") == "success").alias("retained_successful_source_records"))
    refused = rejected.groupBy(org).agg(F.count("*").alias("rejected_candidates"))
    out = rolled.join(reached, org, "full_outer").join(refused, org, "full_outer")
    return out.select(org, *(F.coalesce(x, F.lit(0)).alias(x) for x in out.columns if x != org))


def rollup_ratios(rolled: DataFrame, requests: Column) -> DataFrame:
    """Totals over organisations, and ratios, null where there is nothing to divide by."""
    n = F.count("*")
    sums = {k: F.sum(k) for k in ("published_observations", "supported_observations", "supported_claims", "external_supported_claims", "rejected_candidates")}
    each = lambda name, by: F.round(F.try_divide(sums[name], by), 6)
    return rolled.agg(
        n.alias("batch_size"), *(s.alias(f"total_{k}") for k, s in sums.items()), each("supported_claims", n).alias("supported_claims_per_company"), each("external_supported_claims", n).alias("external_supported_claims_per_company"),
        F.round(F.try_divide(requests.cast("double"), n), 6).alias("requests_per_company"), each("supported_claims", F.nullif(requests, F.lit(0))).alias("supported_claims_per_request"),
    )


def final_state(conflicts: Column, skipped: Column, work_left: Column, requests_left: Column) -> Column:
    """struct(state, reason): available, unless observations conflict or a limit kept stages from running."""
    limit = F.when(work_left <= 0, "deadline_exceeded").when(requests_left <= 0, "request_budget_exhausted").otherwise("acquisition_budget_limited")
    state = F.when(skipped, "failed").when(conflicts, "ambiguous").otherwise("available")
    return F.struct(state.alias("state"), F.when(skipped, limit).when(conflicts, "conflicting_supported_observations").otherwise("research_completed").alias("reason"))


# ---- briefs

#: What a brief says of a category without observation.
PHRASES = {
    "not_found": "not verified in this run",
    "not_available": "no supported observation available",
    "blocked": "verification blocked",
    "ambiguous": "evidence unresolved or conflicting",
    "failed": "verification failed",
    "not_applicable": "not applicable",
}


def availability(state: Column) -> Column:
    out = F.lit(PHRASES["not_found"])
    for name, phrase in PHRASES.items():
        out = F.when(state == name, F.lit(phrase)).otherwise(out)
    return out


def shortened(text: Column, most: int = 40) -> Column:
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, F.lit("…")).otherwise(F.lit("")))


def change_text(field: Column, kind: Column, before: Column, after: Column, category: Column, claim: Column) -> Column:
    """What a brief says of a change; of amounts it names none, as a change has no qualifiers."""
    money = F.concat(field, F.lit(": "), F.lower(kind), F.lit(" monetary observation; inspect qualified evidence"))
    said = F.when(category == "financials", money).when(kind == "NEW", F.concat(field, F.lit(": "), shortened(after)))
    said = said.when(before.isNotNull(), F.concat(field, F.lit(": "), shortened(before), F.lit(" → "), shortened(after))).otherwise(F.concat(field, F.lit(": new ("), shortened(after), F.lit(")")))
    return F.concat(said, F.when(claim.isNotNull(), F.concat(F.lit(" ["), claim, F.lit("]"))).otherwise(F.lit("")))


def notices(changes: DataFrame, entities: DataFrame, key: str, most: int = 4) -> DataFrame:
    """(key, notice, stale): the brief's sentences on changes and on last-known observations.

    entities: key, previous_run_id, published, last_known (numbers of
    observations); changes: key, change, seq, text.  Only the first ``most`` of each
    kind are gathered.
    """
    kind = F.when(F.col("change").isin("CHANGED", "RETRACTED"), "changed").when(F.col("change") == "NEW", "new")
    ranked = first_n(changes.withColumn("_kind", kind).filter("_kind IS NOT NULL"), [key, "_kind"], most, "seq")
    said = ranked.groupBy(key).pivot("_kind", ["changed", "new"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "; "))
    said = said.select(key, *(F.nullif(c, F.lit("")).alias(c) for c in ("changed", "new")))
    rows = entities.join(said, key, "left")
    first = F.when(F.col("published") > 0, "Changes: first verified observations; no earlier run is available for comparison.").otherwise("Changes: no verified observations available for comparison.")
    later = F.when(F.col("changed").isNotNull(), F.concat(F.lit("Changes in verified observations: "), "changed", F.lit("."))).otherwise("Changes: no material changes established among comparable verified observations.")
    new = F.when(F.col("new").isNotNull(), F.concat(F.lit("Newly verified observations: "), "new", F.lit(".")))
    stale = F.when(F.col("last_known") > 0, F.concat(F.col("last_known").cast("string"), F.lit(" previously verified observations are last-known and were not reconfirmed. Their original verification times and supporting evidence remain available.")))
    return rows.select(key, F.when(F.col("previous_run_id").isNull(), first).otherwise(F.concat_ws(" ", later, new)).alias("notice"), F.coalesce(stale, F.lit("")).alias("stale"))


def first_n(rows: DataFrame, keys: list[str], most: int, order: str) -> DataFrame:
    from attesta.operators.views import top_each

    return top_each(rows, keys, most, order).drop("position")
