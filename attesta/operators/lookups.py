"""Lookups by key over stored tables: filters that reach the scan, in the order in which a reader wants the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of(rows: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; None asks for nothing."""
    for column, value in keys.items():
        if value is not None:
            rows = rows.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return rows


def run(runs: DataFrame, run_id) -> DataFrame:
    return _of(runs, run_id=run_id).limit(1)


def company(companies: DataFrame, org_number) -> DataFrame:
    return _of(companies, org_number=org_number).limit(1)


def result(results: DataFrame, run_id, result_key) -> DataFrame:
    return _of(results, run_id=run_id, result_key=result_key).limit(1)


def results(results: DataFrame, run_id) -> DataFrame:
    return _of(results, run_id=run_id).orderBy("result_key")


def sources(sources: DataFrame, org_number, run_id=None) -> DataFrame:
    return _of(sources, org_number=org_number, run_id=run_id).orderBy("retrieved_at", "source_id")


def facts(facts: DataFrame, org_number, run_id=None, statuses: list[str] | None = None) -> DataFrame:
    return _of(facts, org_number=org_number, run_id=run_id, status=statuses).orderBy("retrieved_at", "fact_id")


def evidence(evidence: DataFrame, sources: DataFrame, org_number, run_id=None) -> DataFrame:
    """Evidence has no organisation of its own: its source's counts."""
    return evidence.join(_of(sources, org_number=org_number, run_id=run_id).select("source_id"), "source_id", "left_semi").orderBy("evidence_id")


def changes(changes: DataFrame, org_number, run_id=None) -> DataFrame:
    return _of(changes, org_number=org_number, run_id=run_id).orderBy(F.col("detected_at").desc(), "change_id")


def trace(events: DataFrame, run_id, org_number=None) -> DataFrame:
    return _of(events, run_id=run_id, org_number=org_number).orderBy("event_id")


def run_inputs(inputs: DataFrame, run_id) -> DataFrame:
    return _of(inputs, run_id=run_id).orderBy("position")
