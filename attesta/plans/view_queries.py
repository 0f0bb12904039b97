"""Lookups, orders, set operations, instants and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import views
from attesta.plans.registry import query, read

c = F.col


@query("facts_in_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS position FROM events")
def facts_in_order(spark, sf_dir):
    return views.in_order(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_id", "position")


@query("recent_changes", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 40")
def recent_changes(spark, sf_dir):
    """A top-k report."""
    return read(spark, sf_dir, "events").orderBy(c("ts").desc(), "event_id").limit(40).select("event_id", "user_id", "event_type")


@query(
    "top_statements",
    """SELECT o_custkey, o_orderkey, n AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) DESC, o_orderkey) AS n FROM orders) WHERE n <= 2""",
)
def top_statements(spark, sf_dir):
    return views.top_each(read(spark, sf_dir, "orders"), ["o_custkey"], 2, F.year("o_orderdate").desc(), "o_orderkey").select("o_custkey", "o_orderkey", "position")


@query("selected_inputs", "SELECT c_custkey, c_custkey < 90 AS selected FROM customer")
def selected_inputs(spark, sf_dir):
    return views.selected_inputs(read(spark, sf_dir, "customer"), "c_custkey", 90).select("c_custkey", "selected")


@query(
    "latest_result",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
)
def latest_result(spark, sf_dir):
    from attesta.operators.ledger import first_by

    return first_by(read(spark, sf_dir, "orders"), ["o_custkey"], c("o_orderkey").desc()).select("o_custkey", "o_orderkey")


@query(
    "page_repeats",
    """WITH w AS (SELECT l_partkey, l_suppkey, l_returnflag, l_linestatus, lag(l_returnflag || l_linestatus) OVER s AS before, row_number() OVER s AS n FROM lineitem
                  WINDOW s AS (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice))
       SELECT l_partkey, l_suppkey, CASE WHEN n = 1 THEN 'new' WHEN before = l_returnflag || l_linestatus THEN 'repeated' ELSE 'changed' END AS state, count(*) AS records FROM w GROUP BY ALL""",
)
def page_repeats(spark, sf_dir):
    rows = views.page_repeats(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", ["l_returnflag", "l_linestatus"], "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rows.groupBy("l_partkey", "l_suppkey", "state").agg(F.count("*").alias("records"))


@query(
    "shown_facts",
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d') END, '') DESC, event_id) AS n
         FROM events WHERE event_type <> 'view') WHERE n = 1""",
)
def shown_facts(spark, sf_dir):
    status = F.when(c("event_type") == "click", "PUBLISHED").when(c("event_type") == "purchase", "CONFLICT").when(c("event_type") == "view", "EXTRACTED").otherwise("SOURCE_UNAVAILABLE")
    events = read(spark, sf_dir, "events").withColumns({"status": status, "day": F.when(c("event_id") % 4 > 0, F.date_format("ts", "yyyy-MM-dd"))})
    return views.shown_facts(events, ["user_id", "event_type"], "status", "day", "event_id").select("user_id", "event_type", "event_id")


@query(
    "previous_hashes",
    """SELECT o_custkey AS url, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS content_hash FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey <> 7 GROUP BY 1""",
)
def previous_hashes(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    sources = orders.select(c("o_custkey").alias("url"), c("o_orderkey").alias("run_id"), F.when(c("o_orderstatus") != "P", "success").otherwise("failed").alias("access_status"), c("o_totalprice").alias("content_hash"))
    return views.previous_hash(sources, orders.select(c("o_orderkey").alias("run_id"), c("o_orderdate").alias("started_at")), F.lit(7))


def _claims(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(c("event_id").alias("claim_id"), c("user_id").alias("evidence_id"), "event_type")
    kind = lambda *kinds: events.filter(c("event_type").isin(*kinds)).drop("event_type")
    return kind("click"), kind("error"), kind("view", "purchase")


@query(
    "claim_sets",
    """SELECT CASE event_type WHEN 'click' THEN 'current' WHEN 'error' THEN 'conflicting' ELSE 'last_known' END AS state, count(*) AS claims FROM events WHERE event_type IN ('click', 'error', 'view', 'purchase') GROUP BY 1
       UNION ALL SELECT 'in two lists', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')""",
)
def claim_sets(spark, sf_dir):
    """Claims by list, and evidence that current and conflicting claims share."""
    current, conflicts, last = _claims(spark, sf_dir)
    shared = views.overlaps(current, conflicts, ["evidence_id"]).agg(F.lit("in two lists").alias("state"), F.count("*").alias("claims"))
    return views.claims(current, conflicts, last).groupBy("state").agg(F.count("*").alias("claims")).unionByName(shared)


@query(
    "evidence_view",
    """WITH u AS (SELECT user_id, count(*) AS n, min(event_id) AS first_claim FROM events WHERE event_type IN ('click', 'error', 'view', 'purchase') GROUP BY 1)
       SELECT user_id AS evidence_id, n AS claims, CASE WHEN user_id % 9 = 0 THEN 'snapshot_unavailable' WHEN user_id % 7 = 0 THEN 'claim_support_invalid' ELSE 'verified' END AS snapshot FROM u""",
)
def evidence_view(spark, sf_dir):
    claims = views.claims(*_claims(spark, sf_dir))
    ids = read(spark, sf_dir, "events").select(c("user_id").alias("evidence_id")).distinct().withColumn("source_id", c("evidence_id"))
    captures = ids.select("source_id", F.when(c("source_id") % 9 == 0, "missing").otherwise("intact").alias("state"), F.when(c("source_id") % 7 == 0, "claim value differs").alias("support"))
    return views.evidence_view(claims, ids, captures).select("evidence_id", F.size("claims").cast("long").alias("claims"), "snapshot")


@query(
    "ui_filters",
    """SELECT count(*) FILTER (event_type = 'click') AS published_facts, count(*) FILTER (event_id % 3 > 0) AS changed, count(*) FILTER (event_id % 5 = 0) AS reached_sources, count(*) FILTER (event_id % 5 = 1) AS limited_sources FROM events""",
)
def ui_filters(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        F.when(c("event_type") == "click", "PUBLISHED").otherwise("CONFLICT").alias("status"), F.when(c("event_id") % 3 == 0, "UNCHANGED").otherwise("NEW").alias("change"),
        F.when(c("event_id") % 5 == 0, "success").when(c("event_id") % 5 == 1, "rate_limited").otherwise("failed").alias("access_status"),
    )
    return events.agg(*(F.count_if(test).alias(name) for name, test in views.filters().items()))


@query(
    "ordered_unknowns",
    """WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2),
            s AS (SELECT conv_id, role, t FROM r UNION ALL SELECT DISTINCT conv_id, x, 1000000 + i FROM conversations, (VALUES ('user', 0), ('reviewer', 1), ('tool', 2)) v(x, i) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = conversations.conv_id AND r.role = x))
       SELECT conv_id, string_agg(role, ',' ORDER BY t, role) AS unknowns FROM s GROUP BY 1""",
)
def ordered_unknowns(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = read(spark, sf_dir, "conversations").filter("role IS NOT NULL").groupBy("conv_id").agg(turns.alias("roles"))
    return rows.select("conv_id", F.array_join(views.ordered_union(c("roles"), F.array(*map(F.lit, ("user", "reviewer", "tool")))), ",").alias("unknowns"))


@query(
    "latest_instants",
    """WITH t AS (SELECT user_id, ts - INTERVAL 1 HOUR * (event_id % 3) AS instant, strftime(ts, '%Y-%m-%dT%H:%M:%S') || ['+00:00', '+01:00', '+02:00'][event_id % 3 + 1] AS text FROM events WHERE event_id % 5 > 0)
       SELECT user_id, arg_max(text, struct_pack(i := date_trunc('second', instant), t := text)) AS latest FROM t GROUP BY 1""",
)
def latest_instants(spark, sf_dir):
    """Times of several zones compared as instants; those without one don't count."""
    zone = F.when(c("event_id") % 5 == 0, "").when(c("event_id") % 3 == 0, "+00:00").when(c("event_id") % 3 == 1, "+01:00").otherwise("+02:00")
    events = read(spark, sf_dir, "events").select("user_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("at"))
    return events.groupBy("user_id").agg(views.latest_instant("at").alias("latest")).filter("latest IS NOT NULL")


@query(
    "day_numbers",
    """SELECT o_orderkey, round(epoch(CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE)::TIMESTAMP ELSE date_trunc('second', o_orderdate::TIMESTAMP) END) / 86400.0 + 2440587.5, 4) AS day FROM orders""",
)
def day_numbers(spark, sf_dir):
    """Dates and times in one numeric order."""
    text = F.when(c("o_orderkey") % 2 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("Z")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(views.day_number(text), 4).alias("day"))


@query(
    "run_phases",
    """SELECT event_id, greatest(0.0, 2700 - value * 30) AS left_sec, CASE WHEN 2700 - value * 30 > 1200 THEN 'full_research' WHEN 2700 - value * 30 > 600 THEN 'prioritize_high_value' WHEN 2700 - value * 30 > 120 THEN 'finish_incomplete' ELSE 'serialize_results' END AS phase FROM events""",
)
def run_phases(spark, sf_dir):
    left = views.remaining(F.lit(2700.0), c("value") * 30)
    return read(spark, sf_dir, "events").select("event_id", left.alias("left_sec"), views.phase(left).alias("phase"))


@query(
    "request_counters",
    """WITH u AS (SELECT user_id, count(*) AS used, count(*) FILTER (event_type = 'click') AS ok, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'view' AND value > 90) AS unstarted FROM events GROUP BY 1)
       SELECT user_id, 100 - used AS remaining, ok + bad AS transport_operations, used - ok - bad - unstarted AS unresolved_reservations FROM u""",
)
def request_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used"), F.count_if(c("event_type") == "click").alias("ok"), F.count_if(c("event_type") == "error").alias("bad"), F.count_if((c("event_type") == "view") & (c("value") > 90)).alias("unstarted"))
    return rows.select("user_id", *views.request_counters(c("used"), F.lit(100).cast("long"), c("ok"), c("bad"), c("unstarted")))


@query(
    "schema_versions",
    """WITH v AS (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN '1.3' WHEN bool_or(o_orderpriority LIKE '1%') THEN '1.2' ELSE '1.1' END AS version FROM orders GROUP BY 1)
       SELECT c_nationkey, coalesce(max(version), '1.1') AS version FROM customer LEFT JOIN v ON c_custkey = o_custkey GROUP BY 1""",
)
def schema_versions(spark, sf_dir):
    """The least schema of each customer's results, and the latest of each nation's."""
    kind = F.when(c("o_orderstatus") == "P", "json_number").when(c("o_orderpriority").startswith("1"), "html_json_ld").otherwise("json_pointer")
    each = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(kind).alias("kinds")).select(c("o_custkey").alias("c_custkey"), views.version_of(c("kinds")).alias("version"))
    return read(spark, sf_dir, "customer").join(each, "c_custkey", "left").groupBy("c_nationkey").agg(views.latest_version("version").alias("version"))


@query(
    "ordered_digests",
    """SELECT o_custkey, count(*) AS lines, sha256(string_agg(sha256(o_orderkey || '|' || o_orderstatus), '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1""",
)
def ordered_digests(spark, sf_dir):
    line = F.concat_ws("|", c("o_orderkey").cast("string"), "o_orderstatus")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("lines"), views.ordered_digest("o_orderkey", line).alias("digest"))
