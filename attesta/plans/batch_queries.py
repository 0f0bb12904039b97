"""Sampling, matching, metrics and profile operators over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import matching, metrics, profile, sampling, verify
from attesta.plans.registry import query, read

SEED, SIZE = "s1", 100
STRATUM = """CASE WHEN c_mktsegment = 'BUILDING' THEN 'AS_metadata' ELSE 'other_form' END || '|' ||
  CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN floor(c_acctbal / 100) = 0 THEN 'metadata_zero' WHEN floor(c_acctbal / 100) < 10 THEN '1_9' WHEN floor(c_acctbal / 100) < 50 THEN '10_49' ELSE '50_plus' END || '|' ||
  CASE WHEN c_custkey % 2 = 0 THEN 'recorded' ELSE 'none_recorded' END || '|' ||
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'holding_metadata' WHEN c_nationkey < 3 THEN '64_66_metadata' ELSE 'other' END"""
RANK = "sha256('[\"" + SEED + "\",\"{0}\",\"' || {1} || '\"]')"
SAMPLE_SQL = f"""WITH u AS (SELECT c_custkey, {STRATUM} AS stratum, CASE WHEN contains('02468ace', right({RANK.format("partition", "c_custkey")}, 1)) THEN 'development' ELSE 'held_out' END AS split FROM customer),
  counts AS (SELECT split, stratum, count(*) AS population FROM u GROUP BY 1, 2),
  seats AS (SELECT split, stratum, unnest(range(1, population + 1)) AS round FROM counts),
  given AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round, {RANK.format("stratum-order", "stratum")}, stratum) AS seat FROM seats),
  quotas AS (SELECT c.split, c.stratum, population, coalesce(q, 0) AS quota FROM counts c LEFT JOIN (SELECT split, stratum, count(*) AS q FROM given WHERE seat <= {SIZE} GROUP BY 1, 2) g ON c.split = g.split AND c.stratum = g.stratum)"""


def _universe(spark, sf_dir):
    c = F.col
    employees = F.floor(c("c_acctbal") / 100).cast("long")
    code = F.when(c("c_nationkey") < 3, F.concat((F.lit(64) + c("c_nationkey")).cast("string"), F.lit(".200"))).otherwise("10.1")
    label = F.when(c("c_mktsegment") == "HOUSEHOLD", "Holding company")
    site = F.when(c("c_custkey") % 2 == 0, "https://x")
    form = F.when(c("c_mktsegment") == "BUILDING", "AS").otherwise("ANS")
    return read(spark, sf_dir, "customer").select("c_custkey", sampling.stratum(form, employees, site, code, label).alias("stratum"))


@query("sample_strata", f"SELECT c_custkey, {STRATUM} AS stratum FROM customer")
def sample_strata(spark, sf_dir):
    return _universe(spark, sf_dir)


@query("sample_split", SAMPLE_SQL + " SELECT c_custkey, split FROM u")
def sample_split(spark, sf_dir):
    return sampling.splits(_universe(spark, sf_dir), "c_custkey", SEED).select("c_custkey", "split")


@query("sample_quota", SAMPLE_SQL + " SELECT * FROM quotas")
def sample_quota(spark, sf_dir):
    return sampling.quotas(sampling.splits(_universe(spark, sf_dir), "c_custkey", SEED), SEED, SIZE)


@query(
    "sample_select",
    SAMPLE_SQL
    + f""", m AS (SELECT u.*, row_number() OVER (PARTITION BY split, stratum ORDER BY {RANK.format("selection", "c_custkey")}, c_custkey) AS nth FROM u),
  chosen AS (SELECT m.split, m.stratum, c_custkey FROM m JOIN quotas q ON m.split = q.split AND m.stratum = q.stratum WHERE nth <= quota)
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY {RANK.format("' || split || '-output", "c_custkey")}, c_custkey) AS position FROM chosen""",
)
def sample_select(spark, sf_dir):
    rows = sampling.select(_universe(spark, sf_dir), "c_custkey", SEED, SIZE)
    return rows.select("split", "stratum", "c_custkey", F.col("position").cast("long").alias("position"))


NAME_SQL = """WITH p AS (SELECT p_name AS a, count(*) AS parts FROM part GROUP BY 1), q AS (SELECT p_name AS b, count(*) AS others FROM part GROUP BY 1),
  w AS (SELECT a, b, parts, others, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM p, q),
  s AS (SELECT *, len(list_intersect(x, y)) AS shared FROM w),
  sim AS (SELECT a, b, parts * others AS pairs, CASE WHEN a = b THEN 1.0 WHEN shared = len(x) OR shared = len(y) THEN greatest(shared / greatest(len(x), len(y)), 0.85) ELSE shared / greatest(len(x), len(y)) END AS similarity FROM s WHERE shared > 0)"""


def _name_pairs(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    others = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("other_key"), F.col("p_name").alias("other_name"))
    names = parts.groupBy("p_name").agg(F.count("*").alias("parts")), others.groupBy("other_name").agg(F.count("*").alias("others"))
    pairs = matching.blocked_pairs(names[0].withColumn("n1", F.col("p_name")), names[1].withColumn("n2", F.col("other_name")), "n1", "p_name", "n2", "other_name")
    return pairs.join(names[0], F.col("n1") == F.col("p_name")).join(names[1], F.col("n2") == F.col("other_name")).withColumn("pairs", F.col("parts") * F.col("others"))


@query("name_similarity", NAME_SQL + " SELECT a, b, pairs, round(similarity, 6) AS similarity FROM sim")
def name_similarity(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select(F.col("n1").alias("a"), F.col("n2").alias("b"), "pairs", F.round("similarity", 6).alias("similarity"))


@query("likely_names", NAME_SQL + " SELECT a, b, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.7")
def likely_names(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("n1")).distinct()
    pairs = matching.likely_pairs(names, names.withColumnRenamed("n1", "n2"), "n1", "n1", "n2", "n2")
    return pairs.select(F.col("n1").alias("a"), F.col("n2").alias("b"), F.round("similarity", 6).alias("similarity"))


@query(
    "match_verdicts",
    NAME_SQL
    + """, sig AS (SELECT *, length(a) % 3 AS corr, length(b) % 7 = 0 AS id_match, length(a) + length(b) = 20 AS conflict FROM sim)
  SELECT a, b, CASE WHEN conflict THEN 'REJECTED' WHEN id_match THEN 'VERIFIED' WHEN similarity >= 0.9 AND corr >= 1 THEN 'VERIFIED' WHEN similarity >= 0.7 AND corr >= 1 THEN 'LIKELY'
                    WHEN similarity >= 0.95 AND corr = 0 THEN 'AMBIGUOUS' WHEN similarity >= 0.4 AND similarity < 0.7 AND corr >= 2 THEN 'LIKELY' WHEN similarity < 0.35 THEN 'REJECTED' ELSE 'AMBIGUOUS' END AS verdict,
         round(CASE WHEN conflict THEN -1 WHEN id_match THEN 1 WHEN similarity >= 0.9 AND corr >= 1 THEN least(1.0, (similarity * 2 + corr * 0.5) / 3) WHEN similarity >= 0.7 AND corr >= 1 THEN (similarity * 2 + corr * 0.5) / 3
                    WHEN similarity >= 0.95 AND corr = 0 THEN 0.3 WHEN similarity >= 0.4 AND similarity < 0.7 AND corr >= 2 THEN (similarity * 2 + corr * 0.5) / 3 WHEN similarity < 0.35 THEN 0 ELSE 0.2 END, 6) AS score
  FROM sig""",
)
def match_verdicts(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir)
    n1, n2 = F.length("n1"), F.length("n2")
    judged = matching.verdict(F.col("similarity"), n1 % 3, n2 % 7 == 0, n1 + n2 == 20, F.lit(False))
    return pairs.select(F.col("n1").alias("a"), F.col("n2").alias("b"), judged["verdict"].alias("verdict"), F.round(judged["score"], 6).alias("score"))


@query(
    "domain_owners",
    """WITH h AS (SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '^[^:]*://([^/?#]*)', 1), '.'), -2, -1), '.') AS domain FROM pages)
       SELECT domain, count(DISTINCT page_id) AS owners, min(page_id) AS first_owner FROM h GROUP BY 1""",
)
def domain_owners(spark, sf_dir):
    from attesta.functions.names import host_of, registrable_domain

    pages = read(spark, sf_dir, "pages").select("page_id", registrable_domain(host_of(F.col("url"))).alias("domain"))
    return matching.domain_owners(pages, "domain", "page_id")


@query("terminal_histogram", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def terminal_histogram(spark, sf_dir):
    return metrics.histogram(read(spark, sf_dir, "orders"), "o_orderstatus")


ROLLUP = """SELECT l_suppkey, count(*) AS observations, count(*) FILTER (l_returnflag <> 'R') AS supported_observations, count(DISTINCT l_orderkey) AS claims,
  count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END) AS supported_claims, count(DISTINCT CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN l_orderkey END) AS external_claims
  FROM lineitem GROUP BY 1"""


def _rollup(spark, sf_dir):
    return metrics.rollup(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", F.col("l_returnflag") != "R", F.col("l_linestatus") == "O")


@query("rollup_metrics", ROLLUP)
def rollup_metrics(spark, sf_dir):
    return _rollup(spark, sf_dir)


@query(
    "rollup_totals",
    f"""SELECT count(*) AS organisations, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(supported_observations) AS BIGINT) AS supported_observations, CAST(sum(claims) AS BIGINT) AS claims,
        CAST(sum(supported_claims) AS BIGINT) AS supported_claims, CAST(sum(external_claims) AS BIGINT) AS external_claims, round(CAST(sum(supported_claims) AS DOUBLE) / count(*), 6) AS claims_each FROM ({ROLLUP})""",
)
def rollup_totals(spark, sf_dir):
    return metrics.totals(_rollup(spark, sf_dir))


@query("companies_per_family", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS organisations FROM orders GROUP BY 1")
def companies_per_family(spark, sf_dir):
    return metrics.families(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "nearest_rank",
    "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem WHERE l_extendedprice >= 0 GROUP BY 1",
)
def nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", p50=0.5, p95=0.95)


@query(
    "telemetry_labels",
    """WITH e AS (SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS bucket, event_type <> 'error' AS ok, value > 50 AS retry FROM events)
       SELECT 'event_type' AS label, event_type AS label_value, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (retry) AS retries FROM e GROUP BY event_type
       UNION ALL SELECT 'bucket', bucket, count(*), count(*) FILTER (ok), count(*) FILTER (NOT ok), count(*) FILTER (retry) FROM e GROUP BY bucket
       UNION ALL SELECT 'all', '', count(*), count(*) FILTER (ok), count(*) FILTER (NOT ok), count(*) FILTER (retry) FROM e""",
)
def telemetry_labels(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("bucket", (F.col("user_id") % 10).cast("string"))
    return metrics.telemetry(events, ["event_type", "bucket"], F.col("event_type") != "error", F.col("value") > 50)


@query(
    "page_consistency",
    """WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
       g AS (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS number FROM orders WHERE o_orderkey % 50 > 0),
       s AS (SELECT o_custkey, number, count(*) AS rows FROM g GROUP BY 1, 2)
       SELECT s.o_custkey, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, CASE WHEN count(*) = ceil(max(n) / 4) AND sum(rows) = max(n) THEN 'complete' ELSE 'incomplete' END AS state
       FROM s JOIN p ON s.o_custkey = p.o_custkey GROUP BY 1""",
)
def page_consistency(spark, sf_dir):
    from pyspark.sql.window import Window

    orders = read(spark, sf_dir, "orders")
    totals = orders.groupBy("o_custkey").agg(F.count("*").alias("total_elements"))
    number = F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 4)
    pages = orders.filter("o_orderkey % 50 > 0").select("o_custkey", number.alias("number")).groupBy("o_custkey", "number").agg(F.count("*").alias("rows"))
    pages = pages.join(totals, "o_custkey").withColumns({"size": F.lit(4), "total_pages": F.ceil(F.col("total_elements") / 4)})
    return metrics.page_consistency(pages, "o_custkey")


@query(
    "input_mapping",
    """SELECT conv_id, turn, role, n FROM conversations LEFT JOIN (SELECT role AS r, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1) ON role = r""",
)
def input_mapping(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return profile.input_mapping(rows, rows.filter("role <> 'system'").groupBy("role").agg(F.count("*").alias("n")), "role")


def _envelopes(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return profile.envelopes(customers, orders, "o_custkey", ["o_orderkey"], ["o_orderstatus", "price"])


@query(
    "profile_envelope",
    """SELECT c_custkey AS o_custkey, c_name, count(o_orderkey) AS facts, coalesce(string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey), '') AS listed
       FROM customer LEFT JOIN orders ON c_custkey = orders.o_custkey GROUP BY 1, 2""",
)
def profile_envelope(spark, sf_dir):
    listed = F.array_join(F.transform("facts", lambda f: F.concat(f["o_orderkey"].cast("string"), f["o_orderstatus"])), ",")
    return _envelopes(spark, sf_dir).select("o_custkey", "c_name", F.size("facts").cast("long").alias("facts"), listed.alias("listed"))


@query(
    "brief_text",
    """SELECT o_custkey, string_agg('Order ' || o_orderkey || ' is ' || o_orderstatus || '.', ' ' ORDER BY o_orderkey) AS brief FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 5 GROUP BY 1""",
)
def brief_text(spark, sf_dir):
    text = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is "), F.col("o_orderstatus"), F.lit("."))
    return profile.brief(read(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderkey"), text, 5)


@query(
    "envelope_errors",
    """SELECT CAST(o_custkey AS VARCHAR) AS organisation_number, 'unpublished fact' AS error FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P')
       UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'dangling source' FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 9 = 0)
       UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'foreign fact' FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 100 = 0)""",
)
def envelope_errors(spark, sf_dir):
    c = F.col
    org = c("o_custkey").cast("string")
    fact = F.struct(
        c("o_orderkey").cast("string").alias("fact_id"),
        F.when(c("o_orderkey") % 100 == 0, "other").otherwise(org).alias("org_number"),
        (c("o_orderkey") % 9).cast("string").alias("source_id"),
        F.when(c("o_orderstatus") == "P", "FAILED").otherwise("PUBLISHED").alias("status"),
    )
    sources = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.cast("string").alias("source_id")))
    profiles = read(spark, sf_dir, "orders").groupBy(org.alias("organisation_number")).agg(F.collect_list(fact).alias("facts")).withColumn("sources", sources)
    return verify.envelope_errors(profiles)
