"""Batch control as replays over logs: budgets, breakers, resume and caches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators.replay import in_order

#: Fixed value: how often a breaker's wait may double up.
MOST_MULTIPLE = 4


def budget_cutoff(requests: DataFrame, run: str, order: list[str], limit: int) -> DataFrame:
    """Requests of one unit each, granted while the run's budget lasts; a running sum."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.count("*").over(w)
    return requests.withColumns({"used": F.least(used, F.lit(limit)), "granted": used <= limit})


def _with(rows: DataFrame, **kinds: str):
    """The schema of ``rows`` with more columns."""
    schema = rows.schema
    for name, kind in kinds.items():
        schema = schema.add(name, kind)
    return schema


def budget_replay(requests: DataFrame, run: str, order: list[str], units: str, limit: int) -> DataFrame:
    """As budget_cutoff for requests of unequal units: a refused one uses nothing, so each run is replayed in order."""
    rows = requests.select(run, *order, units)

    def replay(group):
        used = 0
        for row in group:
            granted = used + row[-1] <= limit
            used += row[-1] if granted else 0
            yield *row, used, granted

    return in_order(rows, [run], order, _with(rows, used="long", granted="boolean"), replay)


@dataclass(frozen=True)
class Policy:
    """Failures in a row that open a domain's breaker, and seconds until one attempt is let through again."""

    threshold: int = 4
    cooldown: float = 60.0


class Breaker:
    """A circuit breaker that waits longer when it fails again while open."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.failures, self.opened, self.multiple = 0, None, 1

    def allows(self, at: float) -> bool:
        return self.opened is None or at - self.opened >= self.policy.cooldown * self.multiple

    def record(self, ok: bool, at: float) -> None:
        if ok:
            self.failures, self.opened = 0, None
            return
        self.failures += 1
        if self.failures >= self.policy.threshold:
            self.multiple = 1 if self.opened is None else min(2 * self.multiple, MOST_MULTIPLE)
            self.opened = at


def breaker_replay(attempts: DataFrame, domain: str, at: str, ok: str, seq: str, policies: dict[str, Policy] | None = None, default: Policy = Policy()) -> DataFrame:
    """(domain, seq, allowed, open, failures) of each attempt in time order, under the domain's policy.  Refused attempts change nothing."""
    log = attempts.select(domain, F.col(at).cast("double").alias("_at"), F.col(seq).cast("long").alias(seq), F.col(ok).alias("_ok"))
    policies = policies or {}

    def replay(group):
        breaker = None
        for key, t, number, good in group:
            breaker = breaker or Breaker(policies.get(key, default))
            allowed = breaker.allows(t)
            if allowed:
                breaker.record(bool(good), t)
            yield key, number, allowed, breaker.opened is not None, breaker.failures

    return in_order(log, [domain], ["_at", seq], _with(log.select(domain, seq), allowed="boolean", open="boolean", failures="long"), replay)


def pending(inputs: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Distinct inputs without a terminal state."""
    return inputs.select(key).distinct().join(finished.select(key), key, "left_anti")


def merged_checkpoint(status: Column, checkpoint: Column) -> Column:
    """A published status overrides a checkpoint."""
    return F.coalesce(status, checkpoint)


def spacing(requests: DataFrame, domain: str, at: str, seq: str, least: float) -> DataFrame:
    """Seconds since the domain's last request and whether they are at least ``least``."""
    gap = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(Window.partitionBy(domain).orderBy(at, seq))
    return requests.withColumns({"gap": gap, "spaced": F.coalesce(gap >= least, F.lit(True))})


def cache_hits(requests: DataFrame, key: str, at: str, seq: str, ttl: float) -> DataFrame:
    """A request is answered from the cache if the entry fetched last is younger than ``ttl``.

    Entries are made by misses only.  A miss starts a new entry, so hits and misses
    depend on each other in order and each key is replayed.
    """
    log = requests.select(key, F.col(at).cast("double").alias("_at"), F.col(seq).cast("long").alias(seq))

    def replay(group):
        fetched = None
        for name, t, number in group:
            hit = fetched is not None and t - fetched < ttl
            fetched = fetched if hit else t
            yield name, number, hit

    return in_order(log, [key], ["_at", seq], _with(log.select(key, seq), hit="boolean"), replay)


def lease_replay(claims: DataFrame, key: str, at: str, seq: str, published: str, lease: float) -> DataFrame:
    """(key, seq, claimed): may a worker have a task?  If nobody has it, or its lease has expired, and no result is published."""
    log = claims.select(key, F.col(at).cast("double").alias("_at"), F.col(seq).cast("long").alias(seq), F.col(published).alias("_done"))

    def replay(group):
        until, done = None, False
        for name, t, number, ends in group:
            claimed = not done and (until is None or until <= t)
            if claimed:
                until, done = t + lease, bool(ends)
            yield name, number, claimed

    return in_order(log, [key], ["_at", seq], _with(log.select(key, seq), claimed="boolean"), replay)


def merged_runs(stored: DataFrame, later: DataFrame, published: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Stored runs with a later checkpoint: counters take the larger value, a published result's status overrides the state."""
    more = later.select(key, *(F.col(k).alias(f"_{k}") for k in counters))
    rows = stored.join(more, key, "left").join(published.select(key, F.col("status").alias("_status")), key, "left")
    return rows.withColumns({**{k: F.greatest(k, f"_{k}") for k in counters}, "state": F.coalesce("_status", "state")}).select(*stored.columns)
