"""Publication, validation, comparison and refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import history, publication
from attesta.plans.registry import query, read

c = F.col


@query(
    "batch_check",
    """WITH i AS (SELECT c_custkey % 700 AS k FROM customer), r AS (SELECT o_custkey % 800 AS k FROM orders WHERE o_orderkey % 3 = 0),
            n AS (SELECT k, count(*) AS n FROM r GROUP BY 1), d AS (SELECT DISTINCT k FROM i),
            s AS (SELECT (SELECT count(*) FROM i) AS input_count, (SELECT count(*) FROM r) AS result_count, (SELECT count(*) FROM d WHERE k NOT IN (SELECT k FROM n)) AS missing,
                         (SELECT count(*) FROM n WHERE k NOT IN (SELECT k FROM d)) AS "foreign", (SELECT count(*) FROM n WHERE n > 1) AS repeated)
       SELECT *, missing = 0 AND "foreign" = 0 AND repeated = 0 AS complete FROM s""",
)
def batch_check(spark, sf_dir):
    inputs = read(spark, sf_dir, "customer").select((c("c_custkey") % 700).alias("k"))
    return publication.batch_check(inputs, read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((c("o_custkey") % 800).alias("k")), "k")


@query(
    "publication_plan",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'insert' WHEN o_orderkey % 3 = 1 AND o_orderstatus = 'P' THEN 'refused' ELSE 'same' END AS outcome FROM orders""",
)
def publication_plan(spark, sf_dir):
    """Two thirds are stored, some of them with another status."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = rows.filter("o_orderkey % 3 > 0").withColumn("o_orderstatus", F.when((c("o_orderkey") % 3 == 1) & (c("o_orderstatus") == "P"), "F").otherwise(c("o_orderstatus")))
    return publication.plan(rows, stored, "o_orderkey").select("o_orderkey", "outcome")


@query(
    "latest_companies",
    """SELECT o_custkey, min(o_orderkey) AS first_seen_run, max(o_orderkey) AS last_run, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1""",
)
def latest_companies(spark, sf_dir):
    return publication.latest_companies(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", ["o_orderstatus"])


@query(
    "replaced_rows",
    """WITH n AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
       SELECT c_custkey AS k, -1 AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n""",
)
def replaced_rows(spark, sf_dir):
    stored = read(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    rows = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(c("o_custkey").alias("k"), c("o_orderkey").alias("v"))
    return publication.replaced(stored, rows, "k", "v")


@query(
    "assertion_diff",
    """WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderkey % 6 AS k FROM orders)
       SELECT o_orderkey, CASE WHEN k = 5 THEN 'NEW' WHEN k IN (1, 2, 4) THEN 'CHANGED' ELSE 'UNCHANGED' END AS change FROM b""",
)
def assertion_diff(spark, sf_dir):
    """100 and 100.00 are one amount; another unit, currency or type of value is a change; a text isn't read as a number outside financials."""
    k = c("o_orderkey") % 6
    cents = c("o_totalprice").cast("decimal(18,2)").cast("string")
    orders = read(spark, sf_dir, "orders")
    side = lambda value, currency, unit: orders.select("o_orderkey", value.alias("value"), F.when(k == 4, "identity").otherwise("financials").alias("category"), currency.alias("currency"), unit.alias("unit"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    nok, one = F.lit("NOK"), F.lit(None).cast("string")
    before = side(F.concat(F.lit('"'), cents, F.lit('"')), nok, one).filter("o_orderkey % 6 < 5")
    after = side(F.when(k == 3, F.concat(F.lit('"0'), cents, F.lit('00"'))).when(k == 4, cents).otherwise(F.concat(F.lit('"'), cents, F.lit('"'))), F.when(k == 1, "EUR").otherwise(nok), F.when(k == 2, "x").otherwise(one))
    stated = lambda df: df.select("o_orderkey", publication.assertion().alias("a"))
    return history.detect_changes(stated(before), stated(after), ["o_orderkey"], "a").select("o_orderkey", "change")


@query(
    "carry_forward",
    """WITH f AS (SELECT event_id, user_id, event_type, event_id % 5 = 0 AS broken FROM events),
            ok AS (SELECT * FROM f WHERE NOT broken)
       SELECT 'last_known' AS kind, count(*) AS n FROM ok WHERE event_type <> 'click' UNION ALL SELECT 'sources', count(*) FROM (SELECT user_id AS s FROM ok UNION SELECT user_id + 1000000 FROM ok WHERE user_id % 3 = 0)
       UNION ALL SELECT 'evidence', count(DISTINCT user_id) FROM ok UNION ALL SELECT 'unknowns', count(*) FROM f WHERE broken""",
)
def carry_forward(spark, sf_dir):
    """A fifth lost its support, clicks are confirmed, a third of the evidence has an anchor."""
    events = read(spark, sf_dir, "events")
    previous = events.select(c("event_id").alias("fact_id"), c("event_type").alias("claim_id"), c("user_id").alias("source_id"), c("user_id").alias("evidence_id"))
    reasons = events.select(c("event_id").alias("fact_id"), F.when(c("event_id") % 5 == 0, "value differs").otherwise("ok").alias("reason"))
    evidence = events.select(c("user_id").alias("evidence_id"), F.when(c("user_id") % 3 == 0, c("user_id") + 1_000_000).alias("identity_source_id")).distinct()
    parts = publication.carried(previous, spark.createDataFrame([("click",)], "claim_id string"), reasons, evidence)
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(
    "refresh_attempts",
    """SELECT page_id AS source_id, CASE WHEN page_id % 7 = 0 THEN 'ambiguous' WHEN page_id % 4 = 0 THEN 'available' WHEN page_id % 4 = 1 THEN 'blocked' WHEN page_id % 4 = 2 THEN 'not_available' ELSE 'failed' END AS state,
              CASE WHEN page_id % 7 = 0 THEN 'said by the producer' ELSE 'Acquisition state: ' || CASE page_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'not_found' ELSE 'timeout' END || '.' END AS reason FROM pages""",
)
def refresh_attempts(spark, sf_dir):
    access = F.when(c("source_id") % 4 == 0, "success").when(c("source_id") % 4 == 1, "rate_limited").when(c("source_id") % 4 == 2, "not_found").otherwise("timeout")
    sources = read(spark, sf_dir, "pages").select(c("page_id").alias("source_id")).withColumn("access_status", access)
    said = sources.filter("source_id % 7 = 0").select("source_id", F.lit("ambiguous").alias("state"), F.lit("said by the producer").alias("reason"))
    state = history.attempt_state(c("access_status"), F.lit(None).cast("int"), F.lit(True), F.lit(False), F.lit(False))
    return publication.attempts(sources, said, state, F.concat(F.lit("Acquisition state: "), c("access_status"), F.lit(".")))


@query(
    "envelope_audit",
    """SELECT c_custkey, CASE c_custkey % 17 WHEN 1 THEN 'HTML evidence requires result schema_version 1.2' WHEN 2 THEN 'monetary number evidence requires result schema_version 1.3' WHEN 3 THEN 'invalid terminal status' WHEN 4 THEN 'identity belongs to another company'
                WHEN 5 THEN 'duplicate source or evidence IDs' WHEN 6 THEN 'HTML identity anchor missing from result sources' WHEN 7 THEN 'conflict observations must carry CONFLICT status' WHEN 8 THEN 'last-known observations must carry SOURCE_UNAVAILABLE status'
                WHEN 9 THEN 'current claim cannot also be last-known' WHEN 10 THEN 'conflicting claim cannot also be published' WHEN 11 THEN 'duplicate observation IDs in result' WHEN 12 THEN 'claim belongs to another company'
                WHEN 13 THEN 'claim has dangling source/evidence reference' WHEN 14 THEN 'source belongs to another company' WHEN 15 THEN 'evidence belongs to another company' WHEN 16 THEN 'published facts must carry PUBLISHED status' END AS error FROM customer""",
)
def envelope_audit(spark, sf_dir):
    """One sound envelope and sixteen that each break a rule."""
    k, own, null = c("c_custkey") % 17, c("c_custkey").cast("string"), F.lit(None).cast("string")
    pick = lambda n, broken, whole: F.when(k == n, broken).otherwise(whole)
    html = F.when(k.isin(1, 6), "html_json_ld").when(k == 2, "json_number").otherwise("json_pointer")
    fact = lambda i, claim, status, org=own, source=F.lit("s"), evidence=F.lit("e"): F.struct(F.lit(i).alias("fact_id") if isinstance(i, str) else i.alias("fact_id"), (F.lit(claim) if isinstance(claim, str) else claim).alias("claim_id"), org.alias("org_number"), source.alias("source_id"), evidence.alias("evidence_id"), (F.lit(status) if isinstance(status, str) else status).alias("status"))
    source = F.struct(F.lit("s").alias("source_id"), pick(14, F.lit("x"), own).alias("org_number"), F.lit("success").alias("access_status"))
    item = F.struct(F.lit("e").alias("evidence_id"), F.lit("s").alias("source_id"), pick(15, F.lit("x"), own).alias("org_number"), html.alias("locator_kind"), F.when(k == 6, "gone").when(k == 1, "s").otherwise(null).alias("identity_source_id"))
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", pick(1, F.lit("1.1"), F.lit("1.2")).alias("schema_version"), pick(3, F.lit("done"), F.lit("available")).alias("status"), own.alias("organisation_number"), pick(4, F.lit("x"), own).alias("company_number"),
        F.when(k == 5, F.array(source, source)).otherwise(F.array(source)).alias("sources"), F.array(item).alias("evidence"),
        F.array(fact("f1", "c1", pick(16, F.lit("EXTRACTED"), F.lit("PUBLISHED")), org=pick(12, F.lit("x"), own), evidence=pick(13, F.lit("gone"), F.lit("e")))).alias("facts"),
        F.array(fact(pick(11, F.lit("f1"), F.lit("f2")), pick(10, F.lit("c1"), F.lit("c2")), pick(7, F.lit("PUBLISHED"), F.lit("CONFLICT")))).alias("conflicts"),
        F.array(fact("f3", pick(9, F.lit("c1"), F.lit("c3")), pick(8, F.lit("PUBLISHED"), F.lit("SOURCE_UNAVAILABLE")))).alias("last_known"),
    )
    return rows.select("c_custkey", publication.envelope_error().alias("error"))


@query(
    "result_errors",
    """SELECT c_custkey, CASE c_custkey % 9 WHEN 1 THEN 'result must be a JSON object' WHEN 2 THEN 'missing required field: status' WHEN 3 THEN 'invalid status: ''done'' (expected one of [''ambiguous'', ''available'', ''blocked'', ''failed'', ''not_applicable'', ''not_available''])'
                WHEN 4 THEN 'invalid organisation_number format: ''12''' WHEN 5 THEN 'research_metadata.request_count must be a non-negative integer;research_metadata.estimated_cost_usd must be a non-negative number'
                WHEN 6 THEN 'changes must be a list;facts[0] missing source_id;facts[1] must be an object' WHEN 7 THEN 'unsupported schema_version: ''9''; expected ''1.1'', ''1.2'' or ''1.3''' WHEN 8 THEN 'facts must be a list' ELSE '' END AS errors FROM customer""",
)
def result_errors(spark, sf_dir):
    k = c("c_custkey") % 9
    body = F.concat(
        F.lit('{"run_id":"r"'), F.when(k == 7, ',"schema_version":"9"').otherwise(""), F.lit(',"organisation_number":"'), F.when(k == 4, "12").otherwise("982 463 718"), F.lit('"'), F.when(k == 2, "").when(k == 3, ',"status":"done"').otherwise(',"status":"available"'),
        F.when(k == 5, ',"research_metadata":{"request_count":-1,"estimated_cost_usd":"x"}').otherwise(',"research_metadata":{"request_count":3,"estimated_cost_usd":0.5}'),
        F.when(k == 6, ',"facts":[{"fact_id":"f","org_number":"1","category":"c","field":"f","evidence_id":"e"},7],"changes":{}').when(k == 8, ',"facts":"x"').otherwise(',"facts":[],"changes":[]'), F.lit("}"),
    )
    body = F.when(k == 1, "[1]").otherwise(body)
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(publication.result_errors(body), ";").alias("errors"))


@query(
    "accounting_errors",
    """SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN 'accounting observation time must include a timezone' WHEN 2 THEN 'recorded accounting requires totals and original budget' WHEN 3 THEN 'unavailable accounting must not invent totals or limits'
                WHEN 4 THEN 'finalized accounting requires recorded completion time' WHEN 5 THEN 'request outcome counters must be nonnegative integers' WHEN 6 THEN 'request accounting counters disagree' END AS error FROM customer""",
)
def accounting_errors(spark, sf_dir):
    k, n = c("c_custkey") % 8, lambda x: F.lit(x).cast("long")
    given = lambda value: F.when(k == 7, F.lit(None).cast("long")).otherwise(value)
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 1, "2024-01-01T00:00:00").otherwise("2024-01-01T00:00:00Z").alias("observed_at"), F.when(k.isin(3, 7), "unavailable").otherwise("recorded").alias("accounting_state"), F.when(k == 2, F.lit(None).cast("long")).otherwise(given(n(10))).alias("requests"),
        given(n(1)).alias("estimated_cost_usd"), given(n(50)).alias("budget"), (k == 4).alias("finalized_run"), F.lit(None).cast("string").alias("completed_at"), F.when(k == 5, n(-1)).otherwise(n(6)).alias("successful"), n(2).alias("failed"), n(1).alias("unstarted"), n(0).alias("retries"),
        n(40).alias("remaining"), n(8).alias("transport_operations"), F.when(k == 6, n(0)).otherwise(n(1)).alias("unresolved"),
    )
    return rows.select("c_custkey", publication.accounting_error().alias("error"))


@query(
    "trace_events",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events",
)
def trace_events(spark, sf_dir):
    """Appended events, numbered within their run."""
    from attesta.operators.views import in_order

    return in_order(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", c("position").alias("seq"))
