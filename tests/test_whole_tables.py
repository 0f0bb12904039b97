"""Operators over absent categories, beside the registered queries over whole tables."""

from pyspark.sql import functions as F

from attesta.operators import profile
from attesta.plans import catalog

KINDS = ["click", "error", "purchase"]


def test_no_query_cuts_its_tables():
    for name in ("identity_projection", "coverage_matrix", "set_differences", "name_similarity", "match_verdicts", "figure_lines", "localised_numbers"):
        assert not any(cut in catalog.ORACLES[name] for cut in ("ts >=", "l_quantity", "p_size", "o_totalprice >="))


def test_absent_categories(spark):
    events = spark.createDataFrame([("a", "click", 1.0, 1), ("a", "click", 2.0, 2), ("b", "error", 70.0, 3), ("b", "purchase", 5.0, 4)], "user_id string, event_type string, value double, event_id long")
    got = {r.user_id: r for r in profile.identity_projection(events, "user_id", KINDS, "event_type", "value", "event_id", "event_id").collect()}
    assert [(r.click, r.error, r.purchase, r.unresolved_fields) for r in (got["a"], got["b"])] == [(2.0, None, None, ["error", "purchase"]), (None, 70.0, 5.0, ["click"])]
    rows = profile.coverage_counts(profile.coverage(events, "user_id", "event_type", KINDS, F.lit(True), F.col("value") > 60), KINDS)
    assert sorted(map(tuple, rows.collect())) == [("a", "found", "not_found", "not_found", 1, 1), ("b", "not_found", "ambiguous", "found", 1, 2)]
