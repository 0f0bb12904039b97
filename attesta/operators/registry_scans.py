"""Scans of retained registry documents and of what stands for sources without a scan."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from attesta.functions.json_tokens import at_pointers, json_problem, strict_loads
from attesta.functions.rules import at, kind, whole
from attesta.functions.text import subject_ids
from attesta.operators.registry_values import subunit
from attesta.operators.support import _plain, intact
from attesta.sources.workspace import kept

#: How an acquisition that failed leaves its collection.
REFUSED_ACCESS, GONE = ("blocked", "robots_denied", "rate_limited"), (404, 410)


def _pages(pages: DataFrame, key: str, page_size: int) -> DataFrame:
    """Each retained page with what it holds and the first rule that it breaks, ``before`` its records are read or ``after``."""
    doc = pages.withColumn("_bad", json_problem("body")).withColumn("_doc", F.when(F.col("_bad").isNull(), F.try_parse_json(F.regexp_replace("body", "^\ufeff", ""))))
    inner, number = at(F.col("_doc"), "_embedded"), lambda name: whole(at(F.col("_doc"), f"page.{name}"))
    units = F.try_variant_get(at(F.col("_doc"), "_embedded.underenheter"), "$", "array<variant>")
    empty = F.array().cast("array<variant>")
    listed = F.when(kind(F.col("_doc")) == "OBJECT", F.when(inner.isNull(), empty).when(kind(inner) == "OBJECT", F.when(at(F.col("_doc"), "_embedded.underenheter").isNull(), empty).otherwise(units)))
    doc = doc.withColumns({"units": listed, "said": number("number"), "size": number("size"), "elements": number("totalElements"), "total": number("totalPages")})
    n = F.size("units")
    wanted = F.when(F.col("elements") == 0, F.col("total").isin(0, 1)).otherwise(F.col("total") == F.ceil(F.col("elements") / F.col("size")))
    failed = lambda why: F.struct(F.lit("failed").alias("state"), F.lit(why).alias("reason"))
    lost = F.when(F.col("http_status").isin(*GONE), "not_available").when(F.col("access_status").isin(*REFUSED_ACCESS), "blocked").otherwise("failed")
    before = (
        F.when(~F.coalesce(F.col("access_status") == "success", F.lit(False)), F.struct(lost.alias("state"), F.coalesce("error_detail", F.lit("Subunit page acquisition failed.")).alias("reason")))
        .when(F.col("units").isNull(), failed("Subunit response schema/JSON invalid."))
        .when((n > page_size) | (F.col("size") > page_size), failed("Response exceeds configured subunit page size."))
    )
    good = (F.col("said") == F.col("number")) & (F.col("size") > 0) & (F.col("total") >= 0) & (F.col("elements") >= 0)
    after = F.when(~F.coalesce(good, F.lit(False)), failed("Subunit pagination metadata invalid.")).when(~((n <= F.col("size")) & wanted), failed("Subunit page counts are inconsistent."))
    return doc.withColumns({"before": before, "after": after}).drop("_doc", "_bad")


def subunits(pages: DataFrame, key: str, parent: str, most_pages: int = 20, page_size: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The walk over each collection's retained pages in order, up to the first that fails: (found, refused, collections).

    pages: ``key``, which names a collection, ``parent``, the organisation that it
    was asked for, number (from 0), access_status, http_status, error_detail and body.
    found (key, number, position, item, value): supported records, those in front of
    a failure included.  refused (key, number, position, reason): records that their
    rule refuses, that are another parent's, or whose item was seen before; one that
    says something else than the one before is found as well.  collections (key,
    pages, rows, found, refused, state, reason, completeness), state being available,
    not_available, ambiguous, blocked or failed.

    At most ``most_pages`` pages of a collection are walked, so that is what a window
    over them holds.  Rows: of pages of one number the first by content counts;
    a page that isn't there ends the walk; an empty table gives empty tables.
    """
    order = Window.partitionBy(key).orderBy("number", "access_status", "body")
    once = pages.filter(F.col("number").between(0, most_pages - 1)).withColumn("_again", F.coalesce(F.lag("number").over(order) == F.col("number"), F.lit(False))).filter("NOT _again").drop("_again")
    made = _pages(once, key, page_size)
    ordered = Window.partitionBy(key).orderBy("number")
    totals = F.struct("elements", "total", "size")
    changed = F.lag(totals).over(ordered) != totals
    end = F.coalesce(
        "before",
        "after",
        F.when(changed, F.struct(F.lit("ambiguous").alias("state"), F.lit("Subunit pagination changed during acquisition.").alias("reason"))),
        F.when(F.col("number") + 1 >= F.col("total"), F.struct(F.lit("last").alias("state"), F.lit(None).cast("string").alias("reason"))),
    )
    walked = made.withColumn("end", end).withColumn("_row", F.row_number().over(ordered) - 1)
    ended = F.count_if(F.col("end").isNotNull() | (F.col("_row") != F.col("number"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    walked = kept(walked.filter(F.col("_row") == F.col("number")).withColumn("_ended", ended).filter(F.coalesce("_ended", F.lit(0)) == 0).drop("_ended", "_row", "body"), "walked-pages")

    records = walked.filter("before IS NULL").select(key, F.col(parent).alias("_asked"), "number", F.posexplode("units").alias("position", "_record"))
    records = records.withColumn("_unit", subunit(F.col("_record")))
    foreign = F.when(~F.col("_unit.parent").eqNullSafe(F.col("_asked")), F.lit("subunit record belongs to another parent"))
    records = kept(records.select(key, "number", "position", "_unit.item", "_unit.value", F.coalesce("_unit.error", foreign).alias("reason")), "collection-records")
    before = F.lag("value").over(Window.partitionBy(key, "item").orderBy("number", "position"))
    sound = records.filter("reason IS NULL").withColumn("_before", before)
    found = sound.filter("_before IS NULL OR _before <> value").select(key, "number", "position", "item", "value")
    repeated = sound.filter("_before IS NOT NULL").select(key, "number", "position", F.lit("Repeated subunit across pagination.").alias("reason"))
    refused = records.filter("reason IS NOT NULL").select(key, "number", "position", "reason").unionByName(repeated)

    sums = walked.groupBy(key).agg(F.count("*").alias("pages"), F.sum(F.when(F.coalesce(F.col("end.state") != "failed", F.lit(True)) | F.col("before").isNull(), F.size("units")).otherwise(0)).alias("rows"), F.max_by("end", "number").alias("end"), F.max("elements").alias("elements"))
    counts = found.groupBy(key).agg(F.count("*").alias("found")).join(refused.groupBy(key).agg(F.count("*").alias("refused")), key, "full_outer")
    every = pages.select(key).distinct().join(sums, key, "left").join(counts, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    whole_ = (F.col("end.state") == "last") & (n("rows") == F.col("elements")) & (n("refused") == 0)
    outcome = lambda state, why: F.struct(F.lit(state).alias("state"), F.lit(why).alias("reason"))
    end = (
        F.when(F.col("pages").isNull(), outcome("blocked", "Subunit pages aren't retained."))
        .when(whole_, F.struct(F.when(n("found") > 0, "available").otherwise("not_available").alias("state"), F.lit("All reported subunit pages traversed and parent mappings validated.").alias("reason")))
        .when(F.col("end.state") == "last", outcome("ambiguous", "Subunit collection incomplete or rejected records."))
        .when(F.col("end").isNotNull(), F.col("end"))
        .when(F.col("pages") == most_pages, outcome("blocked", "Configured subunit page limit reached."))
        .otherwise(outcome("blocked", "Subunit pages aren't retained."))
    )
    completeness = F.when(F.coalesce(whole_, F.lit(False)), "complete").when(F.col("pages").isNull(), "unknown").otherwise("partial")
    return found, refused, every.select(key, n("pages").alias("pages"), n("rows").alias("rows"), n("found").alias("found"), n("refused").alias("refused"), end["state"].alias("state"), end["reason"].alias("reason"), completeness.alias("completeness"))


#: Registers whose dates are events.
REGISTERS = {"registreringsdatoForetaksregisteret": "Foretaksregisteret", "registreringsdatoMerverdiavgiftsregisteret": "Merverdiavgiftsregisteret", "registreringsdatoFrivilligMerverdiavgiftsregisteret": "Frivillig MVA-registeret"}
STATUS_EVENTS = {"under_liquidation": "under_liquidation", "bankrupt": "bankruptcy_filing"}


def activity_events(entities: DataFrame, key: str, body: str) -> DataFrame:
    """(key, field, detail, date): at most eight signals of an entity document: states, employees, capital and registers.

    entities: key, under_liquidation, bankrupt, deleted_date, employee_count and the
    document's text.
    """
    j = lambda path: F.get_json_object(F.col(body), f"$.{path}")
    event = lambda field, there, detail, date: F.when(there, F.struct(F.lit(field).alias("field"), detail.alias("detail"), date.alias("date")))
    none = F.lit(None).cast("string")
    listed = [event("status_event", F.col(flag), F.lit(name), none) for flag, name in STATUS_EVENTS.items()]
    listed.append(event("status_event", F.coalesce("deleted_date", F.lit("")) != "", F.lit("deleted"), F.col("deleted_date")))
    listed.append(event("employee_registration", F.col("employee_count").isNotNull(), F.col("employee_count").cast("string"), j("registreringsdatoAntallAnsatteEnhetsregisteret")))
    listed.append(event("capital", j("kapital.belop").isNotNull(), F.concat_ws(" ", j("kapital.belop"), j("kapital.valuta")), j("kapital.innfortDato")))
    listed += [event("registration", F.coalesce(j(k), F.lit("")) != "", F.lit(label), j(k)) for k, label in REGISTERS.items()]
    return entities.select(key, F.inline(F.array_compact(F.array(*listed))))


def job_board(entities: DataFrame, key: str, url: str) -> DataFrame:
    """(key, url, access_status, reason): the source that stands for a job board which isn't asked; it never has postings."""
    return entities.select(key, F.lit(url).alias("url"), F.lit("blocked").alias("access_status"), F.lit("policy: the feed needs an authenticated client, postings are not acquired").alias("reason"))


def replayed(captures: DataFrame, blobs: DataFrame) -> DataFrame:
    """(source_id, status, content_type, body, error): stored responses as they were, without a request; an error where the bytes aren't what they were."""
    rows = intact(captures, blobs)
    fine = F.col("state") == "intact"
    return rows.select("source_id", F.when(fine, F.col("http_status")).alias("status"), F.when(fine, F.col("content_type")).alias("content_type"), F.when(fine, F.col("content")).alias("body"), F.when(~fine, F.col("state")).alias("error"))


def attached(text: Column, org: Column, name: Column, address: Column, rejected: Column) -> Column:
    """struct(attached, reason): does a homepage belong to the organisation?  By its labelled identifier, or its full legal name together with its registered address."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    page, who, where = plain(text), plain(name), plain(address)
    ends = F.split(F.concat(F.lit("\x01"), page, F.lit("\x01")), F.concat(F.lit(r"\Q"), who, F.lit(r"\E")), -1)
    whole = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ends) - 1)), lambda i: F.coalesce(F.get(ends, i - 1).rlike(r"(?U)(?:^|\W)$") & F.get(ends, i).rlike(r"(?U)^(?:\W|$)"), F.lit(False)))
    named = (who != "") & (F.size(ends) > 1) & whole & (where != "") & F.contains(page, where)
    state = lambda ok, why: F.struct(F.lit(ok).alias("attached"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    return (
        F.when(rejected.isNotNull(), state(False, rejected))
        .when(F.array_contains(subject_ids(text), org), state(True, "labelled organisation number identifies document subject"))
        .when(named, state(True, "full legal name and registered address present on page"))
        .otherwise(state(False, "legal attachment ambiguous: identifier or full legal name/address required"))
    )


def registrable(hosts: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Adds domain: one label more than the longest public suffix of a host.

    suffixes: suffix, as public suffix lists write them: *.x stands for any label
    before x, !y for an exception to such a rule.  A host under no rule has its last
    label as suffix, one that is a suffix itself no domain.
    """
    labels = F.split(F.col(host), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct((F.size(labels) - n + 1).alias("n"), F.array_join(F.slice(labels, n, F.size(labels)), ".").alias("tail")))
    distinct = hosts.select(host).filter(F.coalesce(F.col(host), F.lit("")) != "").distinct()
    each = distinct.select(host, F.inline(tails))
    named = each.withColumn("any", F.concat(F.lit("*."), F.regexp_replace("tail", r"^[^.]*\.?", "")))
    rules = suffixes.select(F.col("suffix").alias("_s")).distinct()
    exact = named.join(rules, F.col("tail") == F.col("_s")).select(host, "n")
    wild = named.join(rules, F.col("any") == F.col("_s")).select(host, "n")
    but = named.join(rules, F.concat(F.lit("!"), F.col("tail")) == F.col("_s")).select(host, (F.col("n") - 1).alias("m"))
    longest = exact.unionByName(wild).groupBy(host).agg(F.max("n").alias("n"))
    size = distinct.join(longest, host, "left").join(but.groupBy(host).agg(F.max("m").alias("m")), host, "left").select(host, (F.coalesce("m", "n", F.lit(1)) + 1).alias("take"))
    named = size.withColumn("domain", F.when(F.size(labels) >= F.col("take"), F.array_join(F.slice(labels, F.size(labels) - F.col("take") + 1, F.col("take")), "."))).select(host, "domain")
    return hosts.join(named, host, "left")


def starter_claims(facts: DataFrame) -> DataFrame:
    """Facts in the starter shape: the claim's id, its name there, and its evidence as a list."""
    site = (F.col("category") == "identity") & (F.col("field") == "website")
    return facts.select(
        F.col("claim_id").alias("id"), F.col("field").alias("canonical_field"), F.when(site, "registered_website").otherwise(F.col("field")).alias("field"), F.lit("available").alias("availability"), F.col("fact_confidence").alias("confidence"), F.array("evidence_id").alias("evidence_ids"),
    )


def projection_differences(canonical: DataFrame, projected: DataFrame, key: str) -> DataFrame:
    """(key, problem) of rows that a projection lacks, has too many of, or has otherwise than the canonical ones."""
    a, b = (df.select(F.col(key), F.to_json(F.struct(*sorted(c for c in canonical.columns if c != key))).alias(side)) for df, side in ((canonical, "_a"), (projected, "_b")))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "differs")
    return a.join(b, key, "full_outer").withColumn("problem", problem).filter("problem IS NOT NULL").select(key, "problem")


def concurrency(requests: DataFrame, domain: str, start: str, seconds: str, most: int) -> DataFrame:
    """(domain, most_at_once, kept): how many requests of a domain ran at once, and whether its limit was kept."""
    edges = requests.select(domain, F.col(start).alias("at"), F.lit(1).alias("step")).unionByName(requests.select(domain, (F.col(start) + F.col(seconds)).alias("at"), F.lit(-1).alias("step")))
    running = F.sum("step").over(Window.partitionBy(domain).orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("n", running).groupBy(domain).agg(F.max("n").alias("most_at_once")).withColumn("kept", F.col("most_at_once") <= most)


def bundle_problems(inputs: DataFrame, results: DataFrame, used: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(problem, n) of a bundle by its tables: inputs without a result, results without an input, twice or of another run, captures that no member holds, members that nothing uses.

    results: key, run_ok; used and members: content_hash.
    """
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    parts = [
        count(inputs.select(key).distinct().join(results.select(key), key, "left_anti"), "input without result"),
        count(results.select(key).distinct().join(inputs.select(key), key, "left_anti"), "result without input"),
        count(results.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), "result twice"),
        count(results.filter(~F.coalesce("run_ok", F.lit(False))), "result of another run"),
        count(used.select("content_hash").distinct().join(members, "content_hash", "left_anti"), "capture missing"),
        count(members.select("content_hash").distinct().join(used, "content_hash", "left_anti"), "unexpected member"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pandas_udf(T.StringType())
def pointer_result(bodies: pd.Series, pointers: pd.Series) -> pd.Series:
    """The canonical JSON of what stands at a pointer, containers too, or "! " and why nothing does."""
    def of(body, pointer):
        try:
            value, why = at_pointers(strict_loads(body or ""), [pointer or ""])[0]
        except (ValueError, RecursionError) as error:
            why = str(error)
        return f"! {why}" if why else json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([of(b, p) for b, p in zip(bodies, pointers)])
