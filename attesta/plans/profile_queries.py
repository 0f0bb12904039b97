"""Coverage, identity, benchmark and brief rules; leases, checkpoints, samples, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import control, ledger, matching, profile_rules, sampling
from attesta.plans.registry import epoch_us, query, read

c = F.col


def _facts(spark, sf_dir):
    """Events as facts: a category and field by event, some in conflict."""
    k = c("event_id") % 6
    category = F.when(k.isin(0, 1), "identity").when(k == 2, "financials").when(k == 3, "jobs").when(k == 4, "locations").otherwise("business_description")
    field = F.when(k == 0, "industry_code").when(k == 1, "legal_name").otherwise("x")
    status = F.when(c("event_type") == "error", "CONFLICT").when(c("event_type") == "view", "EXTRACTED").otherwise("PUBLISHED")
    return read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", category.alias("category"), field.alias("field"), status.alias("status"))


@query(
    "coverage_map",
    """WITH f AS (SELECT user_id, event_id % 6 AS k, CASE event_type WHEN 'error' THEN 'x' WHEN 'view' THEN 'e' ELSE 'p' END AS s FROM events),
            u AS (SELECT c_custkey AS user_id, ['not_found', 'failed', 'ok', 'blocked'][c_custkey % 4 + 1] AS acc FROM customer),
            g AS (SELECT user_id, count(*) FILTER (k IN (0, 1) AND s = 'p') AS id, count(*) FILTER (k = 1 AND s = 'x') AS xid, count(*) FILTER (k = 0 AND s = 'p') AS ind, count(*) FILTER (k = 0 AND s = 'x') AS xind,
                         count(*) FILTER (k = 2 AND s = 'p') AS fin, count(*) FILTER (k = 2 AND s = 'x') AS xfin, count(*) FILTER (k = 3 AND s = 'p') AS job, count(*) FILTER (k = 3 AND s = 'x') AS xjob FROM f GROUP BY 1)
       SELECT user_id, CASE WHEN coalesce(xid, 0) > 0 THEN 'ambiguous' WHEN coalesce(id, 0) > 0 THEN 'found' ELSE 'not_found' END AS identity, CASE WHEN coalesce(xind, 0) > 0 THEN 'ambiguous' WHEN coalesce(ind, 0) > 0 THEN 'found' ELSE 'not_found' END AS industry,
              CASE WHEN coalesce(xfin, 0) > 0 THEN 'ambiguous' WHEN coalesce(fin, 0) > 0 THEN 'found' WHEN acc = 'not_found' THEN 'not_available' WHEN acc = 'ok' THEN 'not_found' ELSE acc END AS financials,
              CASE WHEN coalesce(xjob, 0) > 0 THEN 'ambiguous' WHEN coalesce(job, 0) > 0 THEN 'found' ELSE 'not_found' END AS jobs, 'not_found' AS leadership
       FROM u LEFT JOIN g USING (user_id)""",
)
def coverage_map(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ("not_found", "failed", "ok", "blocked"))), (c("c_custkey") % 4 + 1).cast("int"))
    accounts = read(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), states.alias("accounts_status"))
    rows = profile_rules.coverage_map(_facts(spark, sf_dir), "user_id", accounts)
    return rows.select("user_id", *(c("coverage")[n].alias(n) for n in ("identity", "industry", "financials", "jobs", "leadership")))


FIELDS = ["legal_name", "status", "registered_address", "municipality"]


@query(
    "identity_fields",
    """WITH f AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, CASE event_id % 4 WHEN 0 THEN 'legal_name' WHEN 1 THEN 'status' WHEN 2 THEN 'registered_address' ELSE 'municipality' END AS field,
                         CASE WHEN event_type = 'purchase' THEN 'CONFLICT' WHEN event_type = 'click' THEN 'PUBLISHED' ELSE 'EXTRACTED' END AS s FROM events),
            v AS (SELECT user_id, max(CASE WHEN field = 'legal_name' THEN event_id END) AS a, max(CASE WHEN field = 'status' THEN event_id END) AS b, max(CASE WHEN field = 'registered_address' THEN event_id END) AS d, max(CASE WHEN field = 'municipality' THEN event_id END) AS e, max(t) AS t FROM f WHERE s = 'PUBLISHED' GROUP BY 1),
            x AS (SELECT user_id, bool_or(field = 'legal_name') AS a, bool_or(field = 'status') AS b, bool_or(field = 'registered_address') AS d, bool_or(field = 'municipality') AS e FROM f WHERE s = 'CONFLICT' GROUP BY 1),
            r AS (SELECT c_custkey AS user_id, v.t AS last_verified_at, v.a, v.b, v.d, v.e, coalesce(x.a, false) OR v.a IS NULL AS ua, coalesce(x.b, false) OR v.b IS NULL AND c_custkey % 2 = 0 AS ub, coalesce(x.d, false) OR v.d IS NULL AS ud, coalesce(x.e, false) OR coalesce(x.d, false) AS ue, coalesce(x.b, false) AS xb, coalesce(x.d, false) AS xd
                  FROM customer LEFT JOIN v ON c_custkey = v.user_id LEFT JOIN x ON c_custkey = x.user_id)
       SELECT user_id, CASE WHEN ua THEN '' ELSE CAST(a AS VARCHAR) END AS legal_name, CASE WHEN ub THEN 'unknown' ELSE coalesce(CAST(b AS VARCHAR), 'unknown') END AS status, CASE WHEN NOT ud THEN CAST(d AS VARCHAR) END AS registered_address, CASE WHEN NOT ue THEN CAST(e AS VARCHAR) END AS municipality, last_verified_at,
              concat_ws(',', CASE WHEN xb THEN 'bankrupt,deleted_date' END, CASE WHEN ua THEN 'legal_name' END, CASE WHEN ue THEN 'municipality' END, CASE WHEN xd THEN 'postal_code' END, CASE WHEN ud THEN 'registered_address' END, CASE WHEN ub THEN 'status' END, CASE WHEN xb THEN 'under_liquidation' END) AS unresolved FROM r""",
)
def identity_fields(spark, sf_dir):
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (c("event_id") % 4 + 1).cast("int"))
    status = F.when(c("event_type") == "purchase", "CONFLICT").when(c("event_type") == "click", "PUBLISHED").otherwise("EXTRACTED")
    facts = read(spark, sf_dir, "events").select(
        "user_id", F.lit("identity").alias("category"), field.alias("field"), c("event_id").cast("string").alias("value"), status.alias("status"), F.lit("legal_entity").alias("subject_scope"), F.lit(None).cast("string").alias("item_key"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"), c("event_id").alias("seq"),
    )
    anchors = read(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), c("c_name").alias("legal_name"), F.when(c("c_custkey") % 2 == 0, "active").otherwise("unknown").alias("status"), F.lit("road").alias("registered_address"), F.lit(None).cast("string").alias("municipality"))
    rows = profile_rules.project_identity(facts, anchors, "user_id", FIELDS)
    return rows.withColumn("unresolved", F.array_join("unresolved_fields", ",")).drop("unresolved_fields")


ROLLED = """f AS (SELECT user_id, event_id % 50 AS claim, event_id % 9 AS src, event_id % 3 = 0 AS registry, value < 70 AS ok, event_type <> 'view' AS cur FROM events),
     g AS (SELECT user_id, count(*) FILTER (cur) AS published_observations, count(*) FILTER (cur AND ok) AS supported_observations, count(DISTINCT claim) FILTER (cur) AS published_claims, count(DISTINCT claim) FILTER (cur AND ok) AS supported_claims,
                  count(DISTINCT claim) FILTER (cur AND ok AND NOT registry) AS external_supported_claims, count(DISTINCT claim) FILTER (NOT cur) AS last_known_claims, count(DISTINCT src) FILTER (NOT cur) AS last_known_source_records FROM f GROUP BY 1),
     s AS (SELECT o_custkey AS user_id, count(*) FILTER (o_orderstatus = 'F') AS retained_successful_source_records FROM orders GROUP BY 1), j AS (SELECT c_custkey AS user_id, 1 AS rejected_candidates FROM customer WHERE c_custkey % 2 = 0),
     r AS (SELECT user_id, coalesce(published_observations, 0) AS published_observations, coalesce(supported_observations, 0) AS supported_observations, coalesce(published_claims, 0) AS published_claims, coalesce(supported_claims, 0) AS supported_claims,
                  coalesce(external_supported_claims, 0) AS external_supported_claims, coalesce(last_known_claims, 0) AS last_known_claims, coalesce(last_known_source_records, 0) AS last_known_source_records,
                  coalesce(retained_successful_source_records, 0) AS retained_successful_source_records, CAST(coalesce(rejected_candidates, 0) AS BIGINT) AS rejected_candidates FROM g FULL JOIN s USING (user_id) FULL JOIN j USING (user_id))"""


def _rolled(spark, sf_dir):
    facts = read(spark, sf_dir, "events").select("user_id", (c("event_id") % 50).alias("claim_id"), (c("event_id") % 9).alias("source_id"), F.when(c("event_id") % 3 == 0, "registry").otherwise("company_website").alias("source_type"), (c("value") < 70).alias("supported"), F.when(c("event_type") == "view", "last_known").otherwise("facts").alias("list"))
    sources = read(spark, sf_dir, "orders").select(c("o_custkey").alias("user_id"), F.when(c("o_orderstatus") == "F", "success").otherwise("failed").alias("access_status"))
    return profile_rules.result_rollup(facts, sources, read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(c("c_custkey").alias("user_id")), "user_id")


@query("result_rollup", f"WITH {ROLLED} SELECT * FROM r")
def result_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query(
    "rollup_ratios",
    f"""WITH {ROLLED} SELECT count(*) AS batch_size, CAST(sum(published_observations) AS BIGINT) AS total_published_observations, CAST(sum(supported_observations) AS BIGINT) AS total_supported_observations, CAST(sum(supported_claims) AS BIGINT) AS total_supported_claims,
        CAST(sum(external_supported_claims) AS BIGINT) AS total_external_supported_claims, CAST(sum(rejected_candidates) AS BIGINT) AS total_rejected_candidates, round(sum(supported_claims) / count(*), 6) AS supported_claims_per_company,
        round(sum(external_supported_claims) / count(*), 6) AS external_supported_claims_per_company, round(1000.0 / count(*), 6) AS requests_per_company, round(sum(supported_claims) / 1000, 6) AS supported_claims_per_request FROM r""",
)
def rollup_ratios(spark, sf_dir):
    return profile_rules.rollup_ratios(_rolled(spark, sf_dir), F.lit(1000))


@query(
    "final_states",
    """SELECT event_id, CASE WHEN value < 20 THEN 'failed' WHEN event_type = 'error' THEN 'ambiguous' ELSE 'available' END AS state,
              CASE WHEN value < 20 THEN CASE WHEN value < 5 THEN 'deadline_exceeded' WHEN event_id % 2 = 0 THEN 'request_budget_exhausted' ELSE 'acquisition_budget_limited' END WHEN event_type = 'error' THEN 'conflicting_supported_observations' ELSE 'research_completed' END AS reason FROM events""",
)
def final_states(spark, sf_dir):
    state = profile_rules.final_state(c("event_type") == "error", c("value") < 20, F.when(c("value") < 5, 0).otherwise(9), c("event_id") % 2)
    return read(spark, sf_dir, "events").select("event_id", state["state"].alias("state"), state["reason"].alias("reason"))


@query(
    "brief_notices",
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
            t AS (SELECT user_id, event_id, event_type, n, CASE event_type WHEN 'click' THEN 'amount: changed monetary observation; inspect qualified evidence [k' || event_id || ']' WHEN 'error' THEN 'name: ' || event_id || ' → ' || repeat('y', 40) || '…' ELSE 'site: x' END AS said FROM e WHERE event_type IN ('click', 'error', 'view')),
            k AS (SELECT user_id, event_id, said, CASE WHEN event_type = 'view' THEN 'new' ELSE 'changed' END AS kind FROM t),
            r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS m FROM k),
            g AS (SELECT user_id, string_agg(said, '; ' ORDER BY event_id) FILTER (kind = 'changed') AS ch, string_agg(said, '; ' ORDER BY event_id) FILTER (kind = 'new') AS nw FROM r WHERE m <= 4 GROUP BY 1)
       SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'Changes: first verified observations; no earlier run is available for comparison.' ELSE 'Changes: no verified observations available for comparison.' END
                ELSE concat_ws(' ', CASE WHEN ch IS NULL THEN 'Changes: no material changes established among comparable verified observations.' ELSE 'Changes in verified observations: ' || ch || '.' END, 'Newly verified observations: ' || nw || '.') END AS notice,
              CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 5) || ' previously verified observations are last-known and were not reconfirmed. Their original verification times and supporting evidence remain available.' ELSE '' END AS stale
       FROM customer LEFT JOIN g ON user_id = c_custkey""",
)
def brief_notices(spark, sf_dir):
    kind = F.when(c("event_type") == "view", "NEW").when(c("event_type").isin("click", "error"), "CHANGED").otherwise("UNCHANGED")
    number = c("event_id").cast("string")
    null = F.lit(None).cast("string")
    said = F.when(c("event_type") == "click", profile_rules.change_text(F.lit("amount"), kind, null, null, F.lit("financials"), F.concat(F.lit("k"), number)))
    said = said.when(c("event_type") == "error", profile_rules.change_text(F.lit("name"), kind, number, F.lit("y" * 60), F.lit("identity"), null)).otherwise(profile_rules.change_text(F.lit("site"), kind, null, F.lit("x"), F.lit("identity"), null))
    changes = read(spark, sf_dir, "events").select("user_id", kind.alias("change"), c("event_id").alias("seq"), said.alias("text"))
    entities = read(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), F.when(c("c_custkey") % 3 > 0, "r").alias("previous_run_id"), (c("c_custkey") % 2).alias("published"), (c("c_custkey") % 5).alias("last_known"))
    return profile_rules.notices(changes, entities, "user_id")


@query(
    "lease_replay",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 3 AS owner, epoch_us(ts) / 1000000.0 AS sec, event_type = 'error' AS done, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       r AS (SELECT user_id, event_id, n, true AS claimed, sec + 7200 AS until, done FROM e WHERE n = 1
             UNION ALL SELECT e.user_id, e.event_id, e.n, NOT r.done AND r.until <= e.sec, CASE WHEN NOT r.done AND r.until <= e.sec THEN e.sec + 7200 ELSE r.until END, r.done OR (e.done AND NOT r.done AND r.until <= e.sec) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
       SELECT user_id, event_id, claimed FROM r""",
)
def lease_replay(spark, sf_dir):
    """Claims of two hours; an error stands for a claim whose work was published at once."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", (epoch_us(c("ts")) / 1_000_000).alias("at"), (c("event_type") == "error").alias("published"))
    return control.lease_replay(events, "user_id", "at", "event_id", "published", 7200.0)


@query(
    "run_merge",
    """WITH k AS (SELECT l_orderkey, max(l_quantity) AS q, max(l_linenumber) AS n FROM lineitem GROUP BY 1)
       SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE 'running' END AS state, CAST(greatest(o_orderkey % 40, coalesce(q, 0)) AS BIGINT) AS request_count, CAST(greatest(3, coalesce(n, 0)) AS BIGINT) AS cost FROM orders LEFT JOIN k ON l_orderkey = o_orderkey""",
)
def run_merge(spark, sf_dir):
    """Checkpoints may be stale: counters only grow, and a published status overrides."""
    stored = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), F.lit("running").alias("state"), (c("o_orderkey") % 40).alias("request_count"), F.lit(3).cast("long").alias("cost"))
    later = read(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("run_id")).agg(F.max("l_quantity").cast("long").alias("request_count"), F.max("l_linenumber").cast("long").alias("cost"))
    published = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("run_id"), c("o_orderstatus").alias("status"))
    return control.merged_runs(stored, later, published, "run_id", ["request_count", "cost"]).select(c("run_id").alias("o_orderkey"), "state", "request_count", "cost")


@query(
    "sampling_manifest",
    """WITH u AS (SELECT *, CASE WHEN contains('02468ace', right(sha256('["m","partition","' || c_custkey || '"]'), 1)) THEN 'development' ELSE 'held_out' END AS split FROM customer),
            p AS (SELECT split, c_mktsegment AS stratum, count(*) AS population FROM u GROUP BY ALL)
       SELECT split, count(*) AS strata, CAST(sum(population) AS BIGINT) AS population, CAST(least(25, sum(population)) AS BIGINT) AS selected, 0 AS unrepresented FROM p GROUP BY 1""",
)
def sampling_manifest(spark, sf_dir):
    universe = read(spark, sf_dir, "customer").select("c_custkey", c("c_mktsegment").alias("stratum"))
    rows = sampling.manifest(sampling.quotas(sampling.splits(universe, "c_custkey", "m"), "m", 25))
    return rows.select("split", "strata", "population", "selected", F.size("unrepresented").alias("unrepresented"))


@query(
    "sampling_guards",
    """SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'invalid', count(*) FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT 'exceeded', 0""",
)
def sampling_guards(spark, sf_dir):
    universe = read(spark, sf_dir, "orders").select("o_custkey", (c("o_custkey") % 7 > 0).alias("valid"))
    return sampling.guards(universe, "o_custkey", c("valid"), 20)


@query(
    "match_signals",
    """SELECT c_custkey, c_custkey % 5 = 1 AS orgnr_match, c_custkey % 5 IN (0, 2) AS foreign_id, c_custkey % 4 = 0 AND c_custkey % 5 NOT IN (0, 2) AS domain_match, c_custkey % 4 = 1 AND c_custkey % 5 NOT IN (0, 1, 2) AS domain_conflict,
              c_custkey % 3 = 0 AND c_custkey % 5 NOT IN (0, 2) AS municipality_match, c_custkey % 2 = 0 AND c_custkey % 5 NOT IN (0, 2) AS industry_match,
              CASE WHEN c_custkey % 5 IN (0, 2) THEN 'REJECTED' WHEN c_custkey % 4 = 1 AND c_custkey % 5 <> 1 THEN 'REJECTED' WHEN c_custkey % 5 = 1 THEN 'VERIFIED' WHEN c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'VERIFIED' ELSE 'AMBIGUOUS' END AS verdict FROM customer""",
)
def match_signals(spark, sf_dir):
    """Signals from texts, URLs, places and codes; a foreign identifier ends it, another owner's domain rejects unless the identifier matches."""
    k = c("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.lit("971277025").alias("t_org"), c("c_name").alias("t_name"), F.lit("https://www.own.no").alias("t_website"), F.lit("BÆRUM").alias("t_municipality"), F.lit("62.010").alias("t_industry"),
        F.when(k % 5 == 0, "Org.nr: 982463718").when(k % 5 == 1, "Org.nr. 971 277 025").otherwise("nothing").alias("c_text"), F.when(k % 5 == 2, "982463718").alias("c_org"), c("c_name").alias("c_name_said"),
        F.when(k % 4 == 0, "https://own.no/x").when(k % 4 == 1, "https://taken.no/").alias("c_url"), F.when(k % 3 == 0, "Bærum").otherwise("Oslo").alias("c_municipality"), F.when(k % 2 == 0, " 62.010").alias("c_industry"),
    )
    owners = spark.createDataFrame([("taken.no", ["982463718"])], "domain string, owners array<string>")
    s = matching.signals(rows, owners)
    judged = matching.verdict(c("name_similarity"), matching.corroboration(), c("orgnr_match"), c("domain_conflict"), c("foreign_id"))["verdict"]
    return s.select("c_custkey", "orgnr_match", "foreign_id", "domain_match", "domain_conflict", "municipality_match", "industry_match", judged.alias("verdict"))


@query(
    "marked_unavailable",
    """SELECT user_id, CASE WHEN event_type = 'click' AND user_id % 4 = 1 AND event_id % 3 = 0 THEN 'SOURCE_UNAVAILABLE' WHEN event_type = 'click' THEN 'PUBLISHED' ELSE 'CONFLICT' END AS status, count(*) AS n FROM events GROUP BY ALL""",
)
def marked_unavailable(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", (c("user_id") % 4).alias("org_number"), (c("event_id") % 3).alias("source_id"), F.when(c("event_type") == "click", "PUBLISHED").otherwise("CONFLICT").alias("status"))
    return ledger.mark_unavailable(events, F.lit(1), F.lit(0)).groupBy("user_id", "status").agg(F.count("*").alias("n"))
