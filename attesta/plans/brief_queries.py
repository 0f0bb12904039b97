"""Briefs, sample manifests, lookups by key and results in the starter shape, over customers and their orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.rules import as_object, quoted
from attesta.operators import briefs, lookups, ordering, sampling, starter
from attesta.plans.batch_queries import RANK, SAMPLE_SQL, SEED, SIZE, _universe
from attesta.plans.registry import ORACLES, query, read
from attesta.plans.registry_queries import full_citations  # noqa: F401  (its SQL is used below)
from attesta.plans.support_queries import amount_tables
from attesta.sources import bundle

c = F.col
ONCE = {"currency": None, "unit": None, "period": None, "item_key": None, "scope": "legal_entity", "from_page": False}


def _fact(rows, claim, category, field, value, seq, **more):
    """One fact a row; ``more`` in place of what facts have in common."""
    columns = {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in ONCE.items()} | more
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(c("k").cast("string").alias("org"), F.concat(F.lit(claim), c("i").cast("string")).alias("claim_id"), F.lit(category).alias("category"), text(field).alias("field"), value.alias("value"), (c("i") if seq is None else F.lit(seq)).cast("long").alias("seq"), *(x.alias(n) for n, x in columns.items()))


def brief_facts(spark, sf_dir) -> DataFrame:
    own = read(spark, sf_dir, "customer").select("*", c("c_custkey").alias("k"), c("c_custkey").alias("i"))
    orders = read(spark, sf_dir, "orders").select("*", c("o_custkey").alias("k"), c("o_orderkey").alias("i"), F.year("o_orderdate").cast("string").alias("y"))
    key, number, text = c("k").cast("string"), c("i").cast("string"), lambda x: quoted(F.lit(x))
    year = F.concat(c("y"), F.lit("-01-01/"), c("y"), F.lit("-12-31"))
    money = dict(currency=F.when(c("k") % 6 == 0, "nok").otherwise("NOK"), unit=F.lit("currency_unit_x1"))
    stated = as_object(("record_id", quoted(number)), ("period_start", quoted(F.concat(c("y"), F.lit("-01-01")))), ("period_end", quoted(F.concat(c("y"), F.lit("-12-31")))), ("currency", text("NOK")))
    unit = as_object(("orgnr", quoted(number)), ("parent_orgnr", quoted(key)), ("name", quoted(F.concat(F.lit("Unit "), number))), ("postal_area", text("OSLO")), ("physical_address", F.when(c("i") % 2 == 0, text("Vei 1")).otherwise("null")), ("closure_date", F.when(c("i") % 3 == 0, text("2024-02-29")).otherwise("null")))
    parts = [
        _fact(own.filter("k % 7 <> 0"), "n", "identity", "legal_name", quoted(c("c_name")), 1),
        _fact(own.filter("k % 3 = 0"), "d", "business_description", "description", quoted(F.concat(F.lit("We sell "), c("c_mktsegment"))), 2, from_page=c("k") % 2 == 0),
        _fact(own.filter("k % 5 <> 0"), "s", "identity", "industry_description", quoted(c("c_mktsegment")), 3),
        _fact(own.filter("k % 2 = 0"), "c", "identity", "industry_code", quoted(F.concat(F.lit("62."), (c("k") % 10).cast("string"))), 4),
        _fact(own.filter("k % 4 = 0"), "e", "identity", "employee_count", (c("k") * 37).cast("string"), 5),
        _fact(own, "old", "financials", "total_assets", text("1"), 6, period=F.lit("2022-01-01/2022-12-31"), **money),
        _fact(own, "a", "financials", "total_assets", quoted(c("c_acctbal").cast("decimal(18,2)").cast("string")), 7, period=F.lit("2023-01-01/2023-12-31"), **money),
        _fact(own.filter("k % 3 = 0"), "q", "financials", "equity", F.lit("-1234567.5"), 8, period=F.lit("2023"), currency=F.lit("EUR"), unit=F.lit("thousands"), scope=F.lit("group")),
        _fact(orders, "f", "accounting_filings", "statement", stated, None, period=year, item_key=number),
        _fact(orders.filter("k % 3 = 1"), "b", "locations", "branch", unit, None, item_key=number),
        _fact(own.filter("k % 2 = 1"), "r", "leadership", "styreleder", as_object(("name", quoted(F.concat(F.lit("Kari "), key)))), 11),
        _fact(own.filter("k % 2 = 1"), "l", "leadership", "daglig leder", as_object(("name", text("Ola Berg")), ("role", text("CEO"))), 12),
        _fact(own.filter("k % 4 = 1"), "v", "recent_activity", "capital", as_object(("event", text("capital")), ("date", text("2020-02-02"))), 13),
        _fact(own.filter("k % 8 = 1"), "w", "recent_activity", "note", text("Moved"), 14),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "full_briefs",
    r"""WITH k AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS org, c_name, c_mktsegment AS seg, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS bal FROM customer),
      o AS (SELECT o_custkey AS k, o_orderkey AS i, CAST(o_orderkey AS VARCHAR) AS n, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderstatus AS s FROM orders),
      st AS (SELECT k, string_agg('Accounts record ' || n || ': ' || y || '-01-01 to ' || y || '-12-31; source currency NOK; legal entity. [f' || n || ']', ' ' ORDER BY rn) AS t
             FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, i) AS rn FROM o) WHERE rn <= 2 GROUP BY 1),
      br AS (SELECT k, string_agg('Unit ' || n || ' (orgnr ' || n || '), ' || CASE WHEN i % 2 = 0 THEN 'Vei 1 ' ELSE '' END || 'OSLO' || CASE WHEN i % 3 = 0 THEN ', closed 2024-02-29' ELSE '' END || ' [b' || n || ']', '; ' ORDER BY rn) FILTER (rn <= 3) AS t, count(*) AS m
             FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS rn FROM o WHERE k % 3 = 1) GROUP BY 1),
      ch AS (SELECT k, string_agg('o' || n || ' changed', '; ' ORDER BY i) FILTER (s = 'P' AND rn <= 4) AS changed, string_agg('o' || n || ' new', '; ' ORDER BY i) FILTER (s = 'F' AND rn <= 4) AS new
             FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY i) AS rn FROM o) GROUP BY 1),
      u AS (SELECT *, 'not verified in this run' AS nv, CASE k % 4 WHEN 0 THEN 'found' WHEN 1 THEN 'blocked' WHEN 2 THEN 'ambiguous' ELSE 'not_available' END AS fin FROM k),
      p AS (SELECT *, CASE fin WHEN 'blocked' THEN 'verification blocked' WHEN 'ambiguous' THEN 'evidence unresolved or conflicting' WHEN 'not_available' THEN 'no supported observation available' ELSE nv END AS phrase,
                   regexp_replace(split_part(bal, '.', 1), '([0-9])([0-9]{3})$', '\1 \2') || '.' || split_part(bal, '.', 2) AS money FROM u)
      SELECT org, concat_ws(' ',
        CASE WHEN k % 7 = 0 THEN 'Organisation ' || org || ' (legal name unresolved)' ELSE c_name || ' (orgnr ' || org || ') [n' || org || ']' END,
        CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'Website description' ELSE 'What it does' END || ': We sell ' || seg || ' [d' || org || ']' ELSE 'What it does: ' || nv || '.' END,
        CASE WHEN k % 5 = 0 THEN 'Industry: not verified in this run.' ELSE 'Industry: ' || seg || ' [s' || org || ']' || CASE WHEN k % 2 = 0 THEN ' (62.' || k % 10 || ' [c' || org || '])' ELSE '' END END,
        CASE WHEN k % 3 <> 0 AND k % 6 = 0 THEN 'x' ELSE 'Financials: ' || concat_ws('; ', CASE WHEN k % 3 = 0 THEN 'equity EUR -1 234 567.5 (unit: thousands; period: 2023; group) [q' || org || ']' END,
          CASE WHEN k % 6 <> 0 THEN 'total assets NOK ' || money || ' (unit: whole currency units; period: 2023-01-01/2023-12-31; legal entity) [a' || org || ']' END) || '.' END,
        CASE WHEN k % 6 = 0 THEN 'Some monetary observations could not be safely rendered and are withheld.' END,
        CASE WHEN k % 4 = 0 THEN 'Registered employees: ' || regexp_replace(CAST(k * 37 AS VARCHAR), '([0-9])([0-9]{3})$', '\1 \2') || '. [e' || org || ']' END,
        st.t, CASE WHEN br.t IS NOT NULL THEN 'Registered subunits observed: ' || br.t || '.' END, CASE WHEN br.m > 3 THEN 'Additional verified subunit observations appear in the profile.' END,
        CASE WHEN k % 2 = 1 THEN 'Key roles: Ola Berg (CEO) [l' || org || '], Kari ' || org || ' (styreleder) [r' || org || '].' ELSE 'Key roles: ' || nv || '.' END,
        CASE WHEN k % 4 = 1 THEN 'Activity observations: capital (2020-02-02) [v' || org || ']' || CASE WHEN k % 8 = 1 THEN '; Moved [w' || org || ']' ELSE '' END || '.' ELSE 'Recent activity: ' || nv || '.' END,
        CASE WHEN k % 2 = 0 THEN 'Changes: first verified observations; no earlier run is available for comparison.'
             ELSE concat_ws(' ', CASE WHEN ch.changed IS NOT NULL THEN 'Changes in verified observations: ' || ch.changed || '.' ELSE 'Changes: no material changes established among comparable verified observations.' END, 'Newly verified observations: ' || ch.new || '.') END,
        'Unknowns: ' || concat_ws('; ', CASE WHEN fin <> 'found' THEN 'Annual accounts (' || phrase || ')' END, 'Board/management roles (' || nv || ')', 'Products/services (' || nv || ')', 'Job postings (not applicable)', 'Recent public activity (' || nv || ')', 'Business description (' || nv || ')', 'Location details (' || nv || ')', 'Company website (' || nv || ')') || '.',
        CASE WHEN k % 9 = 0 THEN 'Some sources disagree. Disputed values are withheld; their evidence remains available.' END) AS brief
      FROM p LEFT JOIN st USING (k) LEFT JOIN br USING (k) LEFT JOIN ch USING (k)""",
)
def full_briefs(spark, sf_dir):
    """Every section of the brief, with and without what it needs."""
    k = c("c_custkey")
    fin = F.when(k % 4 == 0, "found").when(k % 4 == 1, "blocked").when(k % 4 == 2, "ambiguous").otherwise("not_available")
    entities = read(spark, sf_dir, "customer").select(k.cast("string").alias("org"), F.create_map(F.lit("financials"), fin, F.lit("jobs"), F.lit("not_applicable")).alias("coverage"), F.when(k % 2 == 1, "earlier").alias("previous_run_id"), (k % 9 == 0).cast("long").alias("conflicts"))
    kind = F.when(c("o_orderstatus") == "P", "CHANGED").when(c("o_orderstatus") == "F", "NEW").otherwise("UNCHANGED")
    changes = read(spark, sf_dir, "orders").select(c("o_custkey").cast("string").alias("org"), kind.alias("change"), c("o_orderkey").alias("seq"), F.concat(F.lit("o"), c("o_orderkey").cast("string"), F.when(kind == "NEW", " new").otherwise(" changed")).alias("text"))
    return briefs.briefs(brief_facts(spark, sf_dir), entities, changes, "org")


@query(
    "sample_strata_manifest",
    SAMPLE_SQL + """ SELECT stratum, CAST(sum(population) AS BIGINT) AS population, CAST(coalesce(sum(population) FILTER (split = 'development'), 0) AS BIGINT) AS development_population, CAST(coalesce(sum(quota) FILTER (split = 'development'), 0) AS BIGINT) AS development,
                     CAST(coalesce(sum(population) FILTER (split = 'held_out'), 0) AS BIGINT) AS held_out_population, CAST(coalesce(sum(quota) FILTER (split = 'held_out'), 0) AS BIGINT) AS held_out FROM quotas GROUP BY 1""",
)
def sample_strata_manifest(spark, sf_dir):
    return sampling.strata_manifest(sampling.quotas(sampling.splits(_universe(spark, sf_dir), "c_custkey", SEED), SEED, SIZE))


@query(
    "sample_files",
    SAMPLE_SQL
    + f""", m AS (SELECT u.*, row_number() OVER (PARTITION BY split, stratum ORDER BY {RANK.format("selection", "c_custkey")}, c_custkey) AS nth FROM u),
  chosen AS (SELECT m.split, c_custkey FROM m JOIN quotas q ON m.split = q.split AND m.stratum = q.stratum WHERE nth <= quota),
  placed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {RANK.format("' || split || '-output", "c_custkey")}, c_custkey) AS position FROM chosen),
  lack AS (SELECT s.split, count(*) AS n FROM (SELECT DISTINCT stratum FROM quotas) t CROSS JOIN (VALUES ('development'), ('held_out')) s(split) WHERE NOT EXISTS (SELECT 1 FROM quotas q WHERE q.split = s.split AND q.stratum = t.stratum AND quota > 0) GROUP BY 1)
  SELECT split, count(*) AS count, sha256(string_agg('{{"id":' || c_custkey || '}}' || chr(10), '' ORDER BY position)) AS sha256, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY position) AS members, coalesce(any_value(n), 0) AS unrepresented
  FROM placed LEFT JOIN lack USING (split) GROUP BY 1""",
)
def sample_files(spark, sf_dir):
    """Digest, members in order and strata left out of each split's file."""
    universe = _universe(spark, sf_dir)
    quotas = sampling.quotas(sampling.splits(universe, "c_custkey", SEED), SEED, SIZE)
    line = F.concat(F.lit('{"id":'), c("c_custkey").cast("string"), F.lit("}"))
    files = sampling.split_manifest(sampling.select(universe, "c_custkey", SEED, SIZE), quotas, "c_custkey", line)
    return files.select("split", "count", "sha256", F.array_join("members", ",").alias("members"), F.size("unrepresented").cast("long").alias("unrepresented"))


@query(
    "table_lookups",
    """SELECT 'run' AS what, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey = 7 LIMIT 1) UNION ALL SELECT 'company', count(*) FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'result', count(*) FROM orders WHERE o_custkey = 5 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 5)
       UNION ALL SELECT 'results', count(*) FROM orders WHERE o_custkey = 5 UNION ALL SELECT 'sources', count(*) FROM orders WHERE o_custkey = 5 AND o_orderstatus = 'F' UNION ALL SELECT 'facts', count(*) FROM events WHERE user_id = 3 AND event_type IN ('click', 'error')
       UNION ALL SELECT 'evidence', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 5) UNION ALL SELECT 'changes', count(*) FROM events WHERE user_id = 3 UNION ALL SELECT 'trace', count(*) FROM events WHERE event_type = 'click' AND user_id = 3 UNION ALL SELECT 'run_inputs', count(*) FROM lineitem WHERE l_returnflag = 'A'""",
)
def table_lookups(spark, sf_dir):
    """Each lookup by key, by how many rows it finds."""
    t = lambda n: read(spark, sf_dir, n)
    orders = t("orders").select(c("o_custkey").alias("run_id"), c("o_orderkey").alias("result_key"), c("o_custkey").alias("org_number"), "o_orderstatus", c("o_orderdate").alias("retrieved_at"), c("o_orderkey").alias("source_id"))
    events = t("events").select(c("user_id").alias("org_number"), c("event_type").alias("status"), c("event_type").alias("run_id"), "event_id", c("event_id").alias("fact_id"), c("event_id").alias("change_id"), c("ts").alias("retrieved_at"), c("ts").alias("detected_at"))
    lines = t("lineitem").select(c("l_orderkey").alias("source_id"), c("l_linenumber").alias("evidence_id"), c("l_returnflag").alias("run_id"), c("l_linenumber").alias("position"))
    first = orders.filter("org_number = 5").agg(F.min("result_key")).first()[0]
    found = {
        "run": lookups.run(orders.withColumn("run_id", c("result_key")), 7), "company": lookups.company(t("customer").select(c("c_custkey").alias("org_number")), 5), "result": lookups.result(orders, 5, first), "results": lookups.results(orders, 5),
        "sources": lookups.sources(orders.withColumn("run_id", c("o_orderstatus")), 5, "F"), "facts": lookups.facts(events, 3, statuses=["click", "error"]), "evidence": lookups.evidence(lines, orders, 5), "changes": lookups.changes(events, 3),
        "trace": lookups.trace(events, "click", 3), "run_inputs": lookups.run_inputs(lines, "A"),
    }
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in found.items()))


@query(
    "starter_results",
    """WITH f AS (SELECT o_custkey AS k, string_agg('c' || o_orderkey || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'registered_website' WHEN o_orderkey % 3 = 1 THEN 'website' ELSE 'legal_name' END, ',' ORDER BY o_orderkey) AS claims,
                   string_agg(CASE WHEN o_orderkey % 2 = 0 THEN 'https://s' || o_orderkey || '.no/final' ELSE 'https://s' || o_orderkey || '.no' END || '/' || CASE WHEN o_orderkey % 4 = 0 THEN 'json_pointer' ELSE 'unlocated_candidate' END, ',' ORDER BY o_orderkey) AS evidence FROM orders GROUP BY 1)
       SELECT c_custkey, 'starter-example-v1' AS schema_version, '1.' || (1 + c_custkey % 3) AS canonical_schema_version, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS terminal_status, claims, evidence,
              CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey % 4 * 1500 AS DOUBLE) END AS runtime_ms, c_custkey % 3 = 0 AS plain FROM customer JOIN f ON c_custkey = k""",
)
def starter_results(spark, sf_dir):
    """Whole results in the starter shape: claims, evidence with its source's URL, operations and compatibility."""
    i, number = c("o_orderkey"), c("o_orderkey").cast("string")
    named = lambda prefix: F.concat(F.lit(prefix), number)
    site = F.concat(F.lit("https://s"), number, F.lit(".no"))
    fact = F.struct(named("c").alias("claim_id"), F.when(i % 3 == 1, "jobs").otherwise("identity").alias("category"), F.when(i % 3 == 2, "legal_name").otherwise("website").alias("field"), F.lit(0.9).alias("fact_confidence"), named("e").alias("evidence_id"))
    seen = F.struct(named("e").alias("evidence_id"), named("s").alias("source_id"), F.lit("registry").alias("source_type"), named("h").alias("content_hash"), named("t").alias("evidence_text"), F.when(i % 4 == 0, "json_pointer").alias("locator_kind"))
    source = F.struct(named("s").alias("source_id"), site.alias("url"), F.when(i % 2 == 0, F.concat(site, F.lit("/final"))).alias("final_url"), F.lit("registry").alias("source_type"))
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(*(F.transform(F.array_sort(F.collect_list(F.struct(i.alias("i"), x.alias("x")))), lambda p: p["x"]).alias(n) for n, x in (("facts", fact), ("evidence", seen), ("sources", source))))
    k = c("c_custkey")
    results = read(spark, sf_dir, "customer").join(lists, k == c("o_custkey")).select(
        "c_custkey", F.concat(F.lit("1."), (1 + k % 3).cast("string")).alias("schema_version"), F.when(k % 5 == 0, "failed").otherwise("available").alias("status"), F.lit("r").alias("run_id"), F.lit("t0").alias("started_at"), F.lit("t1").alias("completed_at"),
        F.when(k % 4 > 0, k % 4 * 1.5).otherwise(F.lit(float("inf"))).alias("duration_sec"), "facts", "evidence", "sources",
    )
    out = starter.starter(results, "starter-example-v1")
    claims = F.array_join(F.transform("claims", lambda x: F.concat_ws("/", x["id"], x["field"])), ",")
    evidence = F.array_join(F.transform("evidence", lambda x: F.concat_ws("/", x["source_url"], x["support_representation"])), ",")
    return out.select("c_custkey", "schema_version", "canonical_schema_version", c("run.terminal_status").alias("terminal_status"), claims.alias("claims"), evidence.alias("evidence"), c("operations.runtime_ms").alias("runtime_ms"), c("compatibility.structured_evidence").startswith("JSON pointer").alias("plain"))


@query("unsupported_claims", f"SELECT '9' || fact_id AS organisation_number, fact_id, 'claim support failed: ' || reason AS problem FROM ({ORACLES['full_citations']}) WHERE reason <> 'ok'")
def unsupported_claims(spark, sf_dir):
    """Claims of nested results that a bundle's own objects don't support."""
    facts, sources, evidence, captures, blobs = amount_tables(spark, sf_dir)
    nest = lambda df, name, id_: df.select(F.regexp_replace(c(id_).cast("string"), "^[a-z]+", "").alias("_k"), F.array(F.struct(*df.columns)).alias(name))
    parts = [nest(facts, "facts", "fact_id"), nest(sources, "sources", "source_id"), nest(evidence, "evidence", "evidence_id"), nest(captures, "captures", "source_id")]
    results = reduce(lambda a, b: a.join(b, "_k"), parts).withColumn("organisation_number", F.concat(F.lit("9"), "_k"))
    return bundle.claim_problems(results, blobs)


@query(
    "input_order_problems",
    """SELECT 'result out of order' AS problem, CAST(o_custkey AS VARCHAR) AS detail FROM (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY 1) WHERE place % 10 = 3
       UNION ALL SELECT 'input without result', CAST(o_custkey AS VARCHAR) FROM (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS place FROM orders GROUP BY 1) WHERE place % 10 = 7 UNION ALL SELECT 'result without input', '-1'""",
)
def input_order_problems(spark, sf_dir):
    """Results by the first order of each customer; a tenth stands elsewhere, a tenth is missing, one is foreign."""
    inputs = ordering.placed(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "position").select("position", "o_custkey")
    results = ordering.placed(inputs.groupBy("o_custkey").agg(F.min("position").alias("first")), ["first"], "position").select("position", "o_custkey").filter("position % 10 <> 7")
    results = results.withColumn("position", c("position") + F.when(c("position") % 10 == 3, 1000).otherwise(0))
    foreign = results.agg(F.max("position").alias("position")).select(c("position"), F.lit(-1).cast("long").alias("o_custkey"))
    return bundle.mapping_problems(inputs, results.unionByName(foreign), "o_custkey")
