"""Ledger, audit and coverage operators over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators import audit, ledger, metrics, profile, verify
from attesta.plans.registry import epoch_us, query, read


@query(
    "current_value",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id ASC) AS rn FROM events)
       WHERE rn = 1""",
)
def current_value(spark, sf_dir):
    return ledger.current_values(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    "latest_period",
    """SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS period FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def latest_period(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("period", F.year("o_orderdate").cast("long"))
    return ledger.latest_period(orders, ["o_custkey"], "period", "o_orderkey").select("o_custkey", "o_orderkey", "period")


@query(
    "temporal_view",
    """SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS position, epoch_us(ts) AS from_us, epoch_us(lead(ts) OVER w) AS until_us
       FROM events WHERE event_type = 'purchase' WINDOW w AS (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id)""",
)
def temporal_view(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("status", F.when(F.col("event_type") == "purchase", "PUBLISHED").otherwise("DUPLICATE")).withColumn("from_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    rows = ledger.temporal_view(events.withColumn("period", F.lit(None).cast("string")), ["user_id"], "from_text", "period", "event_id")
    return rows.select("user_id", "event_id", F.col("position").cast("long").alias("position"), epoch_us(F.col("ts")).alias("from_us"), epoch_us(F.col("valid_until").cast("timestamp_ntz")).alias("until_us"))



def _ledger(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = lines.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("assertion"), "l_linestatus", seq.alias("seq"))
    return ledger.ledger(rows, ["l_orderkey", "l_linenumber"], "assertion", ["assertion", "l_linestatus"], "seq")


@query(
    "slot_ledger",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
       f AS (SELECT *, first_value(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY seq) AS head,
                    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, l_linestatus ORDER BY seq) AS nth FROM o),
       b AS (SELECT *, min(CASE WHEN l_returnflag <> head THEN seq END) OVER (PARTITION BY l_orderkey, l_linenumber) AS breach FROM f)
       SELECT l_orderkey, l_linenumber, l_returnflag AS assertion, l_linestatus, CASE WHEN breach IS NULL THEN 'PUBLISHED' ELSE 'CONFLICT' END AS status, count(*) AS n
       FROM b WHERE nth = 1 OR seq >= breach GROUP BY ALL""",
)
def slot_ledger(spark, sf_dir):
    """The sequential ledger as windows: repetitions go, a differing claim puts its slot in conflict."""
    same = Window.partitionBy("l_orderkey", "l_linenumber", "assertion", "l_linestatus")
    # counted in the ledger's own order, without a table of groups in memory
    rows = _ledger(spark, sf_dir).withColumns({"_nth": F.row_number().over(same.orderBy("seq")), "n": F.count("*").over(same)})
    return rows.filter("_nth = 1").select("l_orderkey", "l_linenumber", "assertion", "l_linestatus", "status", "n")


@query(
    "slot_conflicts",
    """SELECT l_orderkey, l_linenumber, count(*) AS observations, count(DISTINCT l_returnflag) AS assertions
       FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1""",
)
def slot_conflicts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("observations"), F.count_distinct("l_returnflag").alias("assertions"))
    return rows.filter("assertions > 1")


@query(
    "duplicate_observations",
    "SELECT l_orderkey, l_linenumber, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def duplicate_observations(spark, sf_dir):
    return ledger.duplicate_groups(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_linestatus"])


@query(
    "duplicate_source_urls",
    """SELECT regexp_extract(url, '^[^:]*://([^/]*)', 1) AS url, CAST(page_id % 30 AS BIGINT) AS run_id, count(DISTINCT page_id) AS n FROM pages WHERE url IS NOT NULL
       GROUP BY 1, 2 HAVING count(DISTINCT page_id) > 1""",
)
def duplicate_source_urls(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^:]*://([^/]*)", 1).alias("url"), (F.col("page_id") % 30).alias("run_id"), F.col("page_id").alias("source_id"))
    return audit.urls_of_many_sources(pages)


@query(
    "integrity_counters",
    """WITH c AS (
         SELECT 'duplicate_slots' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n
         UNION ALL SELECT 'orphan_lines', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
         UNION ALL SELECT 'orphan_orders', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
         UNION ALL SELECT 'orphan_labels', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
         UNION ALL SELECT 'foreign_supply', (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey))
       SELECT check_name, CAST(n AS BIGINT) AS n, n = 0 AS ok FROM c""",
)
def integrity_counters(spark, sf_dir):
    t = lambda n: read(spark, sf_dir, n)
    lines, orders, customers = t("lineitem"), t("orders"), t("customer")
    owners = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("org"))
    made = lines.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("org"))
    return audit.verdict(
        audit.counter("duplicate_slots", ledger.duplicate_groups(lines, ["l_orderkey", "l_linenumber"])),
        audit.counter("orphan_lines", audit.orphans(lines, orders, "l_orderkey", "o_orderkey")),
        audit.counter("orphan_orders", audit.orphans(orders, customers, "o_custkey", "c_custkey")),
        audit.counter("orphan_labels", audit.orphans(t("labels"), t("documents"), "doc_id", "doc_id")),
        audit.counter("foreign_supply", audit.contamination(made, owners, "l_orderkey", "org")),
    )


@query(
    "set_differences",
    """(SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer))
       UNION ALL (SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders))""",
)
def set_differences(spark, sf_dir):
    return audit.differing(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query(
    "dup_sources_by_hash",
    "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def dup_sources_by_hash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(
    "capture_states",
    """WITH blobs AS (SELECT sha256(text) AS h, any_value(octet_length(encode(text))) AS n FROM documents WHERE doc_id % 5 > 0 GROUP BY 1),
       caps AS (SELECT doc_id, sha256(text) AS h, octet_length(encode(text)) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM documents)
       SELECT doc_id, CASE WHEN blobs.h IS NULL THEN 'missing' WHEN blobs.n <> caps.n THEN 'length differs' ELSE 'intact' END AS state
       FROM caps LEFT JOIN blobs ON caps.h = blobs.h""",
)
def capture_states(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumns({"content": F.encode("text", "UTF-8")}).withColumn("content_hash", F.sha2("content", 256))
    blobs = docs.filter("doc_id % 5 > 0").dropDuplicates(["content_hash"]).select("content_hash", "content")
    captures = docs.select("doc_id", "content_hash", (F.octet_length("content") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("byte_count"))
    return verify.check_captures(captures, blobs).select("doc_id", "state")


@query(
    "coverage_matrix",
    """SELECT user_id, CASE WHEN bool_or(event_type = 'click' AND value > 60) THEN 'ambiguous' WHEN bool_or(event_type = 'click') THEN 'found' ELSE 'not_found' END AS click,
              CASE WHEN bool_or(event_type = 'error' AND value > 60) THEN 'ambiguous' WHEN bool_or(event_type = 'error') THEN 'found' ELSE 'not_found' END AS error,
              CASE WHEN bool_or(event_type = 'purchase' AND value > 60) THEN 'ambiguous' WHEN bool_or(event_type = 'purchase') THEN 'found' ELSE 'not_found' END AS purchase,
              CAST(bool_or(event_type = 'click' AND value <= 60) AND NOT bool_or(event_type = 'click' AND value > 60) AS INTEGER)
              + CAST(bool_or(event_type = 'error' AND value <= 60) AND NOT bool_or(event_type = 'error' AND value > 60) AS INTEGER)
              + CAST(bool_or(event_type = 'purchase' AND value <= 60) AND NOT bool_or(event_type = 'purchase' AND value > 60) AS INTEGER) AS found,
              CAST(bool_or(event_type = 'click') AS INTEGER) + CAST(bool_or(event_type = 'error') AS INTEGER) + CAST(bool_or(event_type = 'purchase') AS INTEGER) AS researched
       FROM events GROUP BY user_id""",
)
def coverage_matrix(spark, sf_dir):
    kinds = ["click", "error", "purchase"]
    events = read(spark, sf_dir, "events")
    return profile.coverage_counts(profile.coverage(events, "user_id", "event_type", kinds, F.lit(True), F.col("value") > 60), kinds)


@query(
    "identity_projection",
    """WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type IN ('click', 'error', 'purchase')) WHERE rn = 1),
       p AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'error' THEN value END) AS error, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM l GROUP BY 1)
       SELECT *, concat_ws(',', CASE WHEN click IS NULL THEN 'click' END, CASE WHEN error IS NULL THEN 'error' END, CASE WHEN purchase IS NULL THEN 'purchase' END) AS unresolved FROM p""",
)
def identity_projection(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    rows = profile.identity_projection(events, "user_id", ["click", "error", "purchase"], "event_type", "value", "ts", "event_id")
    return rows.withColumn("unresolved", F.array_join("unresolved_fields", ",")).drop("unresolved_fields")


@query(
    "period_competition",
    """SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS period, count(*) AS records, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS canonical
       FROM orders GROUP BY 1, 2""",
)
def period_competition(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("period", F.year("o_orderdate").cast("long"))
    return metrics.period_competition(orders, ["o_custkey", "period"], "o_orderstatus")


@query(
    "citation_chain",
    """WITH f AS (
         SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'AMBIGUOUS' ELSE 'VERIFIED' END AS verdict, d.doc_id % 11 AS s, d.lang, d.source, d.text, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       SELECT doc_id, CASE WHEN verdict = 'AMBIGUOUS' THEN 'entity verdict AMBIGUOUS'
                WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'collection claim requires a stable source item key'
                WHEN s = 0 THEN 'source not found in ledger' WHEN s = 1 THEN 'source access_status=blocked'
                WHEN doc_id % 13 = 0 THEN 'evidence not found in ledger' WHEN s = 2 THEN 'HTML publication requires a typed retained-content locator'
                WHEN toxic = 1 THEN 'claim and evidence identity verdicts disagree' WHEN s = 3 THEN 'source belongs to different company'
                WHEN lang = 'fr' THEN 'fact value is None' ELSE 'ok' END AS reason FROM f""",
)
def citation_chain(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    c = F.col
    facts = docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.lit("1").alias("org_number"),
        F.when(c("lang") == "de", "locations").otherwise("identity").alias("category"),
        F.when(c("lang") == "de", "branch").otherwise("name").alias("field"),
        F.when(c("doc_id") % 2 == 1, "k").otherwise(" ").alias("item_key"),
        F.when(c("lang") != "fr", "v").alias("value"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("reporting_period"),
        F.when(c("quality").isNull(), "AMBIGUOUS").otherwise("VERIFIED").alias("entity_verdict"),
        (c("doc_id") % 11).cast("string").alias("source_id"),
        c("doc_id").cast("string").alias("evidence_id"),
        "toxic",
    )
    s = spark.range(1, 11).select(
        c("id").cast("string").alias("source_id"),
        F.when(c("id") == 1, "blocked").otherwise("success").alias("access_status"),
        F.when(c("id") == 2, "company_website").otherwise("registry").alias("source_type"),
        F.lit("application/json").alias("content_type"),
        F.when(c("id") == 3, "2").otherwise("1").alias("org_number"),
        F.lit("h").alias("content_hash"),
    )
    e = facts.filter("doc_id % 13 > 0").select(
        "evidence_id", "source_id", F.lit("t").alias("evidence_text"), F.when(c("toxic") == 1, "LIKELY").otherwise("VERIFIED").alias("entity_verdict"),
        F.lit("1").alias("org_number"), F.lit("h").alias("content_hash"), F.lit("json_pointer").alias("locator_kind"),
    )
    return verify.check_citations(facts, s, e).select("doc_id", "reason")
