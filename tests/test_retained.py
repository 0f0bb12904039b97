"""Retained bytes: pages, JSON-LD rules, registry values, the store of captures and the plan that reads it."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import structured_data
from attesta.functions.identifiers import valid_digits, validate_id
from attesta.functions.json_tokens import Refused, at_pointers, strict_loads
from attesta.operators import jsonld, registry_values, support
from attesta.plans import support_queries
from attesta.sources.captures import CaptureStore

ORG = "971277025"
NODE = {"@context": "https://schema.org", "@type": "Organization", "legalName": "X as", "vatID": "NO 971277025 MVA", "description": " About  us "}


def page(*nodes):
    return "<html><body><p>a<b>b</b></p><div>c</div><script>x</script>" + "".join(f'<script type="application/ld+json">{n if isinstance(n, str) else json.dumps(n)}</script>' for n in nodes)


def judged(spark, *nodes, name="X AS", number=ORG):
    rows = jsonld.descriptions(spark.createDataFrame([(1, page(*nodes))], "k int, h string"), "k", F.col("h"), F.lit(name), F.lit(number)).collect()
    return sorted((r.script, r.pointer, r.text if r.reason is None else r.reason) for r in rows)


def test_descriptions(spark):
    assert judged(spark, NODE) == [(1, "/description", " About  us ")]
    listed = {"@context": "https://schema.org", "@graph": [{"@type": "Person"}, NODE | {"identifier": [{"@type": "PropertyValue", "propertyID": "Org.nr", "value": ORG}]}]}
    assert judged(spark, [listed]) == [(1, "/0/@graph/0/description", "unsupported literal organization type"), (1, "/0/@graph/1/description", " About  us ")]
    plain = {k: v for k, v in NODE.items() if k != "vatID"}
    bad = {
        "exact legal name not established": NODE | {"legalName": "Y"},
        "Norwegian VAT country prefix missing": NODE | {"vatID": "971277025"},
        "VAT subject differs or is invalid": NODE | {"taxID": "NO 982463718"},
        "description must be a bounded nonempty literal text": NODE | {"description": "x" * 5000},
        "unsupported literal organization type": NODE | {"@type": []},
        "labelled organisation subject differs or is invalid": NODE | {"identifier": {"propertyID": "orgnr", "@type": "PropertyValue", "value": "982463718"}},
        "unsupported identifier vocabulary/type": NODE | {"identifier": {"propertyID": "orgnr", "value": ORG}},
        "identifier capacity exceeded": NODE | {"identifier": ["x"] * 17},
        "explicit Norwegian identifier not established": plain,
    }
    assert [r[2] for r in judged(spark, *bad.values())] == list(bad)
    assert judged(spark, NODE, number="1")[0][2] == "invalid target organisation number"


@pytest.mark.parametrize(
    "script, why",
    [
        ('{"a":1,"a":2}', "duplicate key"),
        ("[1]", "unsupported JSON root"),
        ('{"@context":{"x":1},"@type":"Organization"}', "unsupported root literal context"),
        ('{"@graph":{}}', "graph must be a literal array"),
        ('{"@graph":[1]}', "graph item must be an object"),
        (json.dumps([{"@type": "x"}] * 129), "structured node capacity exceeded"),
        ("", "structured script missing or too large"),
        ("{broken", "invalid JSON"),
    ],
)
def test_refused_scripts(spark, script, why):
    assert [r[2] for r in judged(spark, script)] == [why]


def test_visible_text():
    of = lambda html: structured_data.page_of(html)["text"]
    assert of("<title>t</title><p>a<b>b</b> c<i>d</i></p>") == "t\na b c d"
    assert of("<div>a<p>b</p>c<br>d <span>e</span></div>f<style>g</style><template>h</template>") == "a\nb\nc\nd e\nf"
    assert of("<div>a<p></p>b<!-- x -->c</div>") == "a b c" and of("") == ""


def test_pointers_and_numbers():
    document = {"a": [1, {"": 2, "x/y~": 3}], "b": "s"}
    asked = ["", "/a/1/", "/a/1/x~1y~0", "/b", "/c", "/a/2", "/a/01", "/b/x", "a", "/a~2", "/a/1//z"]
    got = at_pointers(document, asked)
    assert [v for v, why in got if why is None] == [document, 2, 3, "s"]
    assert [why for _, why in got[4:]] == ["JSON pointer not found", "JSON pointer not found", "invalid JSON array index", "JSON pointer traverses a scalar", "JSON pointer must start with /", "invalid JSON pointer escape", "JSON pointer traverses a scalar"]
    for body in ("1e-400", "1e400", "[-0.5e-999]"):
        with pytest.raises(Refused):
            strict_loads(body)
    assert strict_loads("[0e-999, 0.0]") == ["0e-999", "0.0"]


def test_valid_digits(spark):
    stated = [ORG, "NO 971 277 025 MVA", "971277024", "x", "", None, "974.760.673", " 982463718 "]
    rows = spark.createDataFrame([(s,) for s in stated], "s string").select(valid_digits(F.col("s")).alias("d"), validate_id(F.col("s")).alias("v")).collect()
    assert [r.d for r in rows] == [r.v.value if r.v.valid else None for r in rows]


def test_subunits(spark):
    good = {"organisasjonsnummer": "974760673", "overordnetEnhet": ORG, "navn": "U", "beliggenhetsadresse": {"adresse": ["A", "B"], "kommune": "OSLO"}, "nedleggelsesdato": None, "slettedato": "2024-02-29"}
    cases = [good, [], good | {"overordnetEnhet": "974760673"}, good | {"navn": " "}, good | {"naeringskode1": []}, good | {"beliggenhetsadresse": {"adresse": None}}, good | {"beliggenhetsadresse": {"kommune": 7}}, good | {"slettedato": "2023-02-29"}, good | {"beliggenhetsadresse": None}]
    rows = spark.createDataFrame([(json.dumps(c),) for c in cases], "j string").select(registry_values.subunit(F.try_parse_json("j")).alias("u")).collect()
    assert [r.u.error for r in rows] == [None, "subunit must be an object", "subunit and explicit parent identifiers must be distinct valid orgnrs", "subunit name missing or invalid", "subunit address/industry schema mismatch", "subunit address lines invalid", "subunit attributes must be strings or unknown", "Invalid isoformat string", None]
    assert json.loads(rows[0].u.value) == {"orgnr": "974760673", "parent_orgnr": ORG, "name": "U", "physical_address": "A B", "municipality": "OSLO", "postal_code": None, "postal_area": None, "industry": None, "closure_date": None, "deleted_date": "2024-02-29"}
    assert json.loads(rows[-1].u.value)["physical_address"] is None


def test_store_is_read_once_without_a_shuffle(spark, tmp_path):
    tables = support_queries.amount_tables(spark, "/root/testdata/sf0.001")
    store = CaptureStore(spark, "retained_test", str(tmp_path), buckets=4)
    store.add(*tables[3:])
    bodies = store.bodies().count()
    store.add(*tables[3:])
    assert store.bodies().count() == bodies and store.captures().count() == tables[3].count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = support.intact(store.captures(), store.bodies())._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("sha2(") == 1
        linked = tables[0].join(support.prefixed(tables[2], "e_"), F.col("evidence_id") == F.col("e_evidence_id"), "left").withColumn("family", support.family(F.col("category"), F.col("e_locator_kind")))
        spark.sparkContext.setJobDescription(None)
        read = support.read_captures(store.captures(), store.bodies(), support.wanted(linked))
        assert "content" not in read.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = support.check_support(*tables[:3], store.captures(), store.bodies())._jdf.queryExecution().executedPlan().toString()
    assert "sha2(content" not in plan and "retained_test_bodies" not in plan and "ArrowEvalPython" not in plan
    for part in ("bodies", "captures"):
        spark.sql(f"DROP TABLE retained_test_{part}")
