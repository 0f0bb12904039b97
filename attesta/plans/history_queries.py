"""History, refresh and control operators over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import control, history, ledger
from attesta.plans.registry import epoch_us, query, read

SLOT = ["user_id", "event_type"]
DAYS = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


def _days(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long"))


@query(
    "run_diff",
    f"""WITH e AS (SELECT *, {DAYS} AS day FROM events), m AS (SELECT max(day) AS last FROM e),
        s AS (SELECT user_id, event_type, day, CAST(round(value) AS BIGINT) AS v FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id DESC) AS rn FROM e) WHERE rn = 1),
        a AS (SELECT s.* FROM s, m WHERE day = last - 1), b AS (SELECT s.* FROM s, m WHERE day = last)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.v AS before, b.v AS after,
               CASE WHEN b.v IS NULL THEN 'SOURCE_UNAVAILABLE' WHEN a.v IS NULL THEN 'NEW' WHEN a.v = b.v THEN 'UNCHANGED' ELSE 'CHANGED' END AS change,
               CASE WHEN b.v IS NULL THEN 1 WHEN a.v IS NULL THEN 3 WHEN a.v = b.v THEN 4 ELSE 0 END AS rank
        FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""",
)
def run_diff(spark, sf_dir):
    days = _days(spark, sf_dir).withColumn("v", F.round("value").cast("long"))
    last = days.agg(F.max("day").alias("last"))
    side = lambda back: history.last_per_slot(days.join(F.broadcast(last), F.col("day") == F.col("last") - back), SLOT, "event_id")
    changes = history.detect_changes(side(1), side(0), SLOT, "v")
    return changes.withColumn("rank", history.change_rank(F.col("change")))


@query(
    "last_known_carry",
    f"""WITH e AS (SELECT *, {DAYS} AS day FROM events), m AS (SELECT max(day) AS last FROM e),
        p AS (SELECT user_id, event_type, event_id FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id ASC) AS rn FROM e, m WHERE day < last) WHERE rn = 1),
        c AS (SELECT DISTINCT user_id, event_type FROM e, m WHERE day = last)
        SELECT p.*, 'SOURCE_UNAVAILABLE' AS status FROM p ANTI JOIN c ON p.user_id = c.user_id AND p.event_type = c.event_type""",
)
def last_known_carry(spark, sf_dir):
    days = _days(spark, sf_dir)
    days = days.join(F.broadcast(days.agg(F.max("day").alias("last"))))
    before = ledger.current_values(days.filter("day < last"), SLOT, "ts", "event_id").select(*SLOT, "event_id")
    return history.last_known(before, days.filter("day = last"), SLOT)


@query(
    "previous_as_of",
    """WITH r AS (SELECT o_custkey, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS started_at, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INTEGER) AS completed_at,
                      CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS seq, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey + o_orderkey % 5 * 1000 END AS cutoff FROM orders),
            p AS (SELECT c.o_custkey, c.run_id, p.run_id AS prev_run, row_number() OVER (PARTITION BY c.run_id ORDER BY p.started_at DESC, p.seq DESC NULLS LAST, p.run_id DESC) AS rn
                  FROM r c JOIN r p ON c.o_custkey = p.o_custkey AND c.run_id <> p.run_id AND p.started_at <= c.started_at
                                   AND (p.seq < c.cutoff OR (p.seq IS NULL AND p.completed_at < c.started_at)))
       SELECT o_custkey, run_id, prev_run FROM p WHERE rn = 1""",
)
def previous_as_of(spark, sf_dir):
    c = F.col
    day = F.to_date("o_orderdate")
    runs = read(spark, sf_dir, "orders").select(
        "o_custkey", c("o_orderkey").alias("run_id"), day.alias("started_at"), F.date_add(day, (c("o_orderkey") % 200).cast("int")).alias("completed_at"),
        F.when(c("o_orderstatus") != "P", c("o_orderkey")).alias("sequence"), F.when(c("o_orderkey") % 7 > 0, c("o_orderkey") + c("o_orderkey") % 5 * 1000).alias("cutoff"),
    )
    return history.previous_as_of(runs, "o_custkey")


@query(
    "previous_facts",
    f"""WITH e AS (SELECT *, {DAYS} AS day FROM events), m AS (SELECT max(day) AS last FROM e)
        SELECT user_id, event_type, event_id FROM (
          SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, day DESC, event_id DESC) AS rn FROM e, m WHERE day <> last) WHERE rn = 1""",
)
def previous_facts(spark, sf_dir):
    facts = _days(spark, sf_dir).withColumn("run_id", F.col("day"))
    runs = facts.groupBy("run_id").agg(F.min("ts").alias("started_at")).withColumn("run_seq", F.col("run_id"))
    last = facts.agg(F.max("day").alias("last"))
    return ledger.previous_facts(facts.join(F.broadcast(last)), runs, F.col("last"), SLOT, "ts").select(*SLOT, "event_id")


@query(
    "attempt_states",
    """SELECT event_id, CASE WHEN event_type = 'error' AND value < 5 THEN 'not_available' WHEN event_type = 'error' THEN 'failed'
                WHEN event_type = 'click' THEN CASE WHEN value > 60 THEN 'ambiguous' WHEN value > 20 THEN 'available' ELSE 'not_available' END
                WHEN event_type = 'view' THEN 'blocked' ELSE 'not_available' END AS state,
              CASE WHEN event_id % 3 = 0 THEN 'found' WHEN event_type = 'error' AND value < 5 THEN 'not_available' WHEN event_type = 'error' THEN 'failed'
                WHEN event_type = 'click' THEN CASE WHEN value > 60 THEN 'ambiguous' ELSE 'not_available' END
                WHEN event_type = 'view' THEN 'blocked' ELSE 'not_available' END AS coverage
       FROM events""",
)
def attempt_states(spark, sf_dir):
    c = F.col
    access = F.when(c("event_type") == "click", "success").when(c("event_type") == "view", "robots_denied").when(c("event_type") == "error", "timeout").otherwise("not_found")
    http = F.when((c("event_type") == "error") & (c("value") < 5), 404)
    state = history.attempt_state(access, http, c("value") > 20, c("value") > 60, F.lit(False))
    covered = history.backfilled(F.when(c("event_id") % 3 == 0, F.lit("found")), state)
    return read(spark, sf_dir, "events").select("event_id", state.alias("state"), covered.alias("coverage"))


@query(
    "budget_cutoff",
    """SELECT user_id, event_id, CAST(least(u, 40) AS BIGINT) AS used, u <= 40 AS granted FROM (
         SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS u FROM events)""",
)
def budget_cutoff(spark, sf_dir):
    rows = control.budget_cutoff(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 40)
    return rows.select("user_id", "event_id", F.col("used").cast("long").alias("used"), "granted")


NUMBERED = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) / 1000000.0 AS sec FROM events)"


@query(
    "budget_replay",
    f"""WITH RECURSIVE {NUMBERED}, u AS (SELECT user_id, event_id, n, CAST(ceil(value / 10) AS BIGINT) AS units FROM e),
        r AS (SELECT user_id, event_id, n, units, CASE WHEN units <= 100 THEN units ELSE 0 END AS used, units <= 100 AS granted FROM u WHERE n = 1
              UNION ALL SELECT u.user_id, u.event_id, u.n, u.units, CASE WHEN r.used + u.units <= 100 THEN r.used + u.units ELSE r.used END, r.used + u.units <= 100
              FROM r JOIN u ON u.user_id = r.user_id AND u.n = r.n + 1)
        SELECT user_id, event_id, units, CAST(used AS BIGINT) AS used, granted FROM r""",
)
def budget_replay(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("units", F.ceil(F.col("value") / 10).cast("long"))
    return control.budget_replay(events, "user_id", ["ts", "event_id"], "units", 100).select("user_id", "event_id", "units", "used", "granted")


@query(
    "breaker_replay",
    f"""WITH RECURSIVE {NUMBERED}, u AS (SELECT user_id, event_id, n, sec, event_type <> 'error' AS ok, CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 4 END AS least, CASE user_id % 3 WHEN 0 THEN 90000.0 WHEN 1 THEN 60000.0 ELSE 60.0 END AS wait FROM e),
        r AS (SELECT user_id, event_id, n, true AS allowed, NOT ok AND least <= 1 AS open, CAST(NOT ok AS BIGINT) AS failures, CASE WHEN NOT ok AND least <= 1 THEN sec END AS opened, 1 AS multiple FROM u WHERE n = 1
              UNION ALL
              SELECT user_id, event_id, n, allowed, CASE WHEN NOT allowed THEN was ELSE NOT ok AND failed >= least END,
                     CASE WHEN NOT allowed THEN failed - 1 WHEN ok THEN 0 ELSE failed END,
                     CASE WHEN NOT allowed THEN since WHEN ok THEN NULL WHEN failed >= least THEN sec END,
                     CASE WHEN NOT allowed OR ok OR failed < least THEN multiple WHEN was THEN least(2 * multiple, 4) ELSE 1 END
              FROM (SELECT u.*, r.open AS was, r.opened AS since, r.failures + 1 AS failed, r.multiple, NOT r.open OR u.sec - r.opened >= u.wait * r.multiple AS allowed
                    FROM r JOIN u ON u.user_id = r.user_id AND u.n = r.n + 1))
        SELECT user_id, event_id, allowed, open, CAST(failures AS BIGINT) AS failures FROM r""",
)
def breaker_replay(spark, sf_dir):
    """Three policies, by user; a user stands for a domain."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", (epoch_us(F.col("ts")) / 1_000_000).alias("at"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 3).alias("kind"))
    policies = {0: control.Policy(2, 90_000.0), 1: control.Policy(1, 60_000.0), 2: control.Policy()}
    sides = [control.breaker_replay(events.filter(F.col("kind") == k), "user_id", "at", "ok", "event_id", default=p) for k, p in policies.items()]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


@query(
    "cache_hits",
    f"""WITH RECURSIVE {NUMBERED},
        r AS (SELECT user_id, event_id, n, sec AS fetched, false AS hit FROM e WHERE n = 1
              UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.sec - r.fetched < 3600 THEN r.fetched ELSE e.sec END, e.sec - r.fetched < 3600 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id, event_id, hit FROM r""",
)
def cache_hits(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", (epoch_us(F.col("ts")) / 1_000_000).alias("at"))
    return control.cache_hits(events, "user_id", "at", "event_id", 3600.0)


@query(
    "request_spacing",
    """SELECT user_id, event_id, round(gap, 3) AS gap, coalesce(gap >= 60, true) AS spaced FROM (
         SELECT user_id, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 AS gap FROM events)""",
)
def request_spacing(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("us", epoch_us(F.col("ts")))
    rows = control.spacing(events, "user_id", "us", "event_id", 60_000_000)
    return rows.select("user_id", "event_id", F.round(F.col("gap") / 1_000_000.0, 3).alias("gap"), "spaced")


@query(
    "resume_pending",
    "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def resume_pending(spark, sf_dir):
    return control.pending(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query(
    "checkpoint_merge",
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, l.s, 'none') AS status FROM orders
       LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
)
def checkpoint_merge(spark, sf_dir):
    checks = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("s"))
    orders = read(spark, sf_dir, "orders").join(checks, "o_orderkey", "left")
    return orders.select("o_orderkey", F.coalesce(control.merged_checkpoint(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.col("s")), F.lit("none")).alias("status"))
