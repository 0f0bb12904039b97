"""Briefs, manifests and lookups on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attesta.operators import briefs, ledger, lookups, sampling, starter
from attesta.sources import readers

FACTS = "org string, claim_id string, category string, field string, item_key string, scope string, period string, value string, currency string, unit string, from_page boolean, seq long"
CHANGES = "org string, change string, seq long, text string"


def brief(spark, facts, changes=(), **entity):
    row = {"org": "9", "coverage": {}, "previous_run_id": None, "conflicts": 0} | entity
    entities = spark.createDataFrame([tuple(row.values())], "org string, coverage map<string,string>, previous_run_id string, conflicts long")
    return briefs.briefs(spark.createDataFrame(facts, FACTS), entities, spark.createDataFrame(list(changes), CHANGES), "org").first().brief


def amount(value, **more):
    row = dict(org="9", claim_id="a", category="financials", field="equity", item_key=None, scope="legal_entity", period="2023", value=value, currency="NOK", unit="currency_unit_x1", from_page=False, seq=1) | more
    return tuple(row.values())


def test_nothing_is_known(spark):
    said = brief(spark, [], coverage={"financials": "blocked"})
    assert said.startswith("Organisation 9 (legal name unresolved) What it does: not verified in this run. Industry: not verified in this run. Financials: verification blocked. Key roles:")
    assert "Changes: no verified observations available for comparison." in said and "Annual accounts (verification blocked); Board/management roles (not verified" in said


@pytest.mark.parametrize(
    "value, shown",
    [('"1234567.50"', "1 234 567.50"), ("-999", "-999"), ("0", "0"), ('"1000"', "1 000"), ("true", None), ('"x"', None), ('"1e5"', None), ('"' + "9" * 257 + '"', None), ("null", None), ('"-1234"', "-1 234")],
)
def test_amounts(spark, value, shown):
    said = brief(spark, [amount(value)])
    wanted = "Financials: monetary values could not be safely rendered." if shown is None else f"Financials: equity NOK {shown} (unit: whole currency units; period: 2023; legal entity) [a]."
    assert wanted in said


@pytest.mark.parametrize("more", [{"currency": None}, {"currency": "nok"}, {"unit": " "}, {"unit": None}, {"period": None}, {"scope": "unknown"}])
def test_amounts_without_qualifiers(spark, more):
    assert "monetary values could not be safely rendered" in brief(spark, [amount("1", **more)])


def test_latest_period_counts_and_first_arrival_of_one(spark):
    rows = [amount("1", period="2021", claim_id="x", seq=9), amount("2", period="2022", claim_id="y", seq=2), amount("3", period="2022", claim_id="z", seq=3), amount("4", field="total_assets", currency="?", seq=4)]
    said = brief(spark, rows)
    assert "equity NOK 2 " in said and "[y]" in said and "[z]" not in said and "withheld" in said


def test_changes_and_conflicts(spark):
    said = brief(spark, [amount("1")], [("9", "NEW", 1, "n1"), ("9", "UNCHANGED", 2, "u")], previous_run_id="r", conflicts=2)
    assert "Changes: no material changes established among comparable verified observations. Newly verified observations: n1." in said and said.endswith("their evidence remains available.")
    assert "Newly" not in brief(spark, [amount("1")], [("9", "CHANGED", 1, "c1")], previous_run_id="r")


def test_split_manifest(spark):
    universe = spark.createDataFrame([(f"{i:09d}", "abc"[i % 3] if i % 40 else "rare") for i in range(300)], "org string, stratum string")
    quotas = sampling.quotas(sampling.splits(universe, "org", "s"), "s", 7)
    chosen = sampling.select(universe, "org", "s", 7)
    files = {r.split: r for r in sampling.split_manifest(chosen, quotas, "org", F.concat(F.lit("<"), "org", F.lit(">"))).collect()}
    for split in sampling.SPLITS:
        own = sorted((r for r in chosen.collect() if r.split == split), key=lambda r: r.position)
        digest = lambda purpose, org: hashlib.sha256(f'["s","{purpose}","{org}"]'.encode()).hexdigest()
        assert [r.org for r in own] == sorted((r.org for r in own), key=lambda o: digest(f"{split}-output", o))
        assert files[split].members == [r.org for r in own] and files[split]["count"] == 7
        assert files[split].sha256 == hashlib.sha256("".join(f"<{r.org}>\n" for r in own).encode()).hexdigest()
        assert files[split].unrepresented == sorted({r.stratum for r in quotas.collect()} - {r.stratum for r in own})
    head = sampling.manifest_head(universe, sampling.splits(universe, "org", "s"), "s", {"source_file": "u", "source_sha256": "h"}).first()
    assert head.source_record_count == 300 == head.development_population + head.held_out_population and head.seed == "s"
    strata = sampling.strata_manifest(quotas).collect()
    assert sum(r.population for r in strata) == 300 and sum(r.development for r in strata) == 7


def test_lookups(spark):
    facts = spark.createDataFrame([("f1", "1", "r", "PUBLISHED", 2), ("f2", "1", "r", "CONFLICT", 1), ("f3", "2", "r", "PUBLISHED", 0), ("f4", "1", "q", "PUBLISHED", 0)], "fact_id string, org_number string, run_id string, status string, retrieved_at int")
    ids = lambda df: [r.fact_id for r in df.collect()]
    assert ids(lookups.facts(facts, "1")) == ["f4", "f2", "f1"] and ids(lookups.facts(facts, "1", "r", ["PUBLISHED"])) == ["f1"] and ids(lookups.facts(facts, "3")) == []


def test_temporal_view_shows_what_is_published(spark):
    rows = spark.createDataFrame([("k", "2021", None, 1, "PUBLISHED"), ("k", "2022", None, 2, "CONFLICT"), ("k", "2023", None, 3, "PUBLISHED")], "k string, f string, p string, at int, status string")
    assert [(r.f, r.valid_until) for r in ledger.temporal_view(rows, ["k"], "f", "p", "at").orderBy("f").collect()] == [("2021", "2023"), ("2023", None)]


def test_entities_keep_types(spark):
    bodies = ['{"organisasjonsnummer":"1","navn":"N","konkurs":"false","antallAnsatte":"7"}', '{"organisasjonsnummer":"1","navn":"N","navn":"M"}', '{"organisasjonsnummer":1,"navn":"N"}', '{"organisasjonsnummer":"1","navn":"N","konkurs":false,"underAvvikling":false,"underTvangsavviklingEllerTvangsopplosning":false,"antallAnsatte":7}', None]
    rows = readers.parse_entities(spark.createDataFrame([("1", b, n) for n, b in enumerate(bodies)], "org string, body string, n int"), "org", "body", ["n"]).orderBy("n").collect()
    assert [r.state for r in rows] == ["ok", "failed", "failed", "ok", "failed"] and [r.employee_count for r in rows] == [None, None, None, 7, None]
    assert rows[0].status == "unknown" and rows[3].status == "active"


def test_starter_without_its_source(spark):
    schema = "id int, schema_version string, status string, run_id string, started_at string, completed_at string, duration_sec double, facts array<struct<claim_id:string,category:string,field:string,fact_confidence:double,evidence_id:string>>, evidence array<struct<evidence_id:string,source_id:string,source_type:string,content_hash:string,evidence_text:string,locator_kind:string>>, sources array<struct<source_id:string,url:string,final_url:string,source_type:string>>"
    rows = [(1, "1.2", "failed", "r", "a", "b", -1.0, [], [("e", "gone", "own", "h", "t", None)], []), (2, "1.1", "available", "r", "a", "b", 2.0, [("c", "identity", "website", 0.5, "e")], [("e", "s", "own", "h", "t", "json_number")], [("s", "u1", None, "old"), ("s", "u2", None, "new")])]
    first, second = starter.starter(spark.createDataFrame(rows, schema), "v").orderBy("id").collect()
    assert first.evidence[0].source_url is None and first.evidence[0].source_class == "own" and first.operations.runtime_ms is None and first.run.terminal_status == "failed"
    assert second.evidence[0].source_url == "u2" and second.claims[0].field == "registered_website" and second.operations.runtime_ms == 2000.0
