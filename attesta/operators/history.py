"""Run-over-run history: diffs, as-of lookup, carry-forward and refresh states."""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.operators.ledger import first_by
from attesta.operators.replay import in_order

#: Order in which changes are listed.
CHANGE_RANK = {"CHANGED": 0, "SOURCE_UNAVAILABLE": 1, "RETRACTED": 2, "NEW": 3, "UNCHANGED": 4}
ATTEMPT_STATES = {"blocked": "blocked", "robots_denied": "blocked", "rate_limited": "blocked", "not_found": "not_available", "discovered": "not_available"}


def last_per_slot(facts: DataFrame, slot: list[str], seq: str) -> DataFrame:
    return first_by(facts, slot, F.col(seq).desc())


def detect_changes(previous: DataFrame, current: DataFrame, slot: list[str], assertion: str) -> DataFrame:
    """One row a slot of either side, which have one row a slot: (slot, before, after, change).

    What is missing now is only unavailable; that it is gone is never concluded.
    """
    a = previous.select(*slot, F.col(assertion).alias("before"), F.lit(True).alias("_had"))
    b = current.select(*slot, F.col(assertion).alias("after"), F.lit(True).alias("_has"))
    kind = (
        F.when(F.col("_has").isNull(), "SOURCE_UNAVAILABLE")
        .when(F.col("_had").isNull(), "NEW")
        .when(F.col("before").eqNullSafe(F.col("after")), "UNCHANGED")
        .otherwise("CHANGED")
    )
    return a.join(b, slot, "full_outer").withColumn("change", kind).drop("_had", "_has")


def change_rank(change: Column) -> Column:
    out = F.lit(len(CHANGE_RANK))
    for name, rank in CHANGE_RANK.items():
        out = F.when(change == name, F.lit(rank)).otherwise(out)
    return out


def previous_as_of(runs: DataFrame, key: str) -> DataFrame:
    """(key, run_id, prev_run) of each run that has a predecessor with its key.

    ``runs`` has run_id, started_at, completed_at, sequence (its place in the
    order of publication, null if unpublished) and cutoff (how far publication
    had come when it started).  A predecessor started no later, and was published
    before the cutoff, or if unpublished was completed before the start.  Of
    several the last started one counts, then the last published, then the largest
    run_id.  The runs of a key stream by start; of earlier ones only those are kept
    that no later one can stand in for, in order, so that a bisection finds the one
    that counts.
    """
    rows = runs.select(key, "started_at", "run_id", "completed_at", "sequence", "cutoff")
    schema = T.StructType([runs.schema[key], T.StructField("run_id", runs.schema["run_id"].dataType), T.StructField("prev_run", runs.schema["run_id"].dataType)])
    return in_order(rows.filter("started_at IS NOT NULL"), [key], ["started_at", "run_id"], schema, _predecessors)


class _Latest:
    """Finds the last added entry below a limit: an entry goes when a later one is no higher, so heights rise."""

    def __init__(self):
        self.heights, self.entries = [], []

    def add(self, height, entry) -> None:
        at = bisect_left(self.heights, height)
        del self.heights[at:], self.entries[at:]
        self.heights.append(height)
        self.entries.append(entry)

    def below(self, limit):
        at = bisect_left(self.heights, limit)
        return self.entries[at - 1] if at else None


class _Earliest:
    """The same with entries added from the last to the first: one goes in only if it is lower than all before."""

    def __init__(self):
        self.heights, self.entries = [], []

    def add(self, height, entry) -> None:
        if not self.heights or height < self.heights[-1]:
            self.heights.append(height)
            self.entries.append(entry)

    def below(self, limit):
        at = bisect_left(self.heights, True, key=lambda h: h < limit)
        return self.entries[at] if at < len(self.heights) else None


def _predecessors(group):
    """(key, run, predecessor) of the runs of one key, by start."""
    published, finished, place = _Latest(), _Latest(), 0
    for start, same in groupby(group, key=lambda r: r[1]):
        same = sorted(same, key=lambda r: (-1 if r[4] is None else r[4], r[2]))
        numbered = [(place + k, *r) for k, r in enumerate(same)]
        place += len(same)
        # runs behind a run in its own start's order come first, then those in front of it
        behind, late, early = [], _Earliest(), _Earliest()
        for run in reversed(numbered):
            behind.append(max(filter(None, (late.below(run[6]) if run[6] is not None else None, early.below(start))), default=None))
            if run[5] is not None:
                late.add(run[5], (run[0], run[3]))
            elif run[4] is not None:
                early.add(run[4], (run[0], run[3]))
        for run, after in zip(numbered, reversed(behind)):
            front = max(filter(None, (published.below(run[6]) if run[6] is not None else None, finished.below(start))), default=None)
            found = after or front
            if found:
                yield run[1], run[3], found[1]
            if run[5] is not None:
                published.add(run[5], (run[0], run[3]))
            elif run[4] is not None:
                finished.add(run[4], (run[0], run[3]))


def last_known(previous: DataFrame, current: DataFrame, slot: list[str]) -> DataFrame:
    """Earlier observations whose slot this run didn't confirm, marked so."""
    return previous.join(current.select(*slot).distinct(), slot, "left_anti").withColumn("status", F.lit("SOURCE_UNAVAILABLE"))


def attempt_state(access: Column, http: Column, supported: Column, conflicting: Column, parse_failed: Column) -> Column:
    state = F.lit("failed")
    for name, value in ATTEMPT_STATES.items():
        state = F.when(access == name, F.lit(value)).otherwise(state)
    ok = F.when(conflicting, "ambiguous").when(supported, "available").when(parse_failed, "failed").otherwise("not_available")
    return F.when(access == "success", ok).when(http.isin(404, 410), "not_available").otherwise(state)


def backfilled(coverage: Column, attempt: Column) -> Column:
    """Only unset, not_found and not_available are overwritten; an available attempt gives not_available."""
    open_ = coverage.isNull() | coverage.isin("not_found", "not_available")
    return F.when(open_ & attempt.isNotNull(), F.when(attempt == "available", "not_available").otherwise(attempt)).otherwise(coverage)
