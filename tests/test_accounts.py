import ipaddress
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.functions import names, net, slices, structured_data, text
from attesta.operators import accounts
from attesta.sources import bundle, sinks

ORG = "971277025"


def record(**more):
    base = {"id": 7, "journalnr": "J1", "virksomhet": {"organisasjonsnummer": ORG}, "regnskapstype": "SELSKAP", "valuta": "NOK", "avviklingsregnskap": False, "regnskapsperiode": {"fraDato": "2024-01-01", "tilDato": "2024-12-31"}, "eiendeler": {"sumEiendeler": 5}}
    return base | more


def run(spark, body):
    body = body if isinstance(body, str) else json.dumps(body)
    made = accounts.records(spark.createDataFrame([(ORG, body)], "org_number string, body string"))
    return {(r.pointer, r.value) for r in accounts.amounts(made).collect()}, {(r.record_id, r.period, r.journal) for r in accounts.statements(made).collect()}


def test_amount_tokens_stay_exact(spark):
    for token, want in {"882017.0": "882017", "0.0": "0", "-12.5": "-12.5", "9007199254740993": "9007199254740993", "-0.0": "0", "1.5E3": "1500"}.items():
        body = json.dumps(record()).replace('"sumEiendeler": 5', f'"sumEiendeler": {token}')
        assert run(spark, body) == ({("/eiendeler/sumEiendeler", want)}, {("7", "2024-01-01/2024-12-31", "J1")})


def test_amounts_abstain(spark):
    both = record(id=8, eiendeler={"sumEiendeler": 6})
    assert run(spark, [record(), both])[0] == set() and len(run(spark, [record(), both])[1]) == 2
    assert run(spark, [record(), record()])[0] == {("/0/eiendeler/sumEiendeler", "5")}
    assert run(spark, [record(), record(id=8, regnskapstype="KONSERN")])[0] == {("/0/eiendeler/sumEiendeler", "5")}
    unplaced = record(id=9, regnskapsperiode={"fraDato": "2024-01-01"})
    assert run(spark, [record(), unplaced])[0] == set()
    assert run(spark, [record(), record(id=9, virksomhet={"organisasjonsnummer": "982463718"})])[0] == {("/0/eiendeler/sumEiendeler", "5")}
    for change in ({"valuta": "nok"}, {"valuta": None}, {"id": True}, {"id": "7"}, {"avviklingsregnskap": None}, {"avviklingsregnskap": True}, {"journalnr": " "}, {"regnskapsperiode": {"fraDato": "2025-01-01", "tilDato": "2024-12-31"}}):
        assert run(spark, record(**change))[0] == set(), change
    for value in ("5", True, None, {}):
        assert run(spark, record(eiendeler={"sumEiendeler": value}))[0] == set()
    assert run(spark, '{"id":1,"id":2}') == (set(), set())


def test_url_policy_and_addresses(spark):
    urls = {"HTTPS://X.no:443/a?b#c": "https://x.no/a?b", "http://x.no": "http://x.no/", "ftp://x": None, "https://u@x.no/": None, "https://127.0.0.1/": None, "https://[::1]/": None, "https://x.no:8080/": None, "": None, None: None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(net.normalized_url(F.col("u"))["url"]).collect()
    assert [r[0] for r in got] == list(urls.values())


def test_unsafe_addresses(spark):
    """Against the standard library's classes, over edges of all networks and texts that are no addresses."""
    texts = ["8.8.8.8", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "x", "", None, "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "fe80::1%eth0", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:808:808", "2001:4860::8.8.8.8", "12345::", "g::", "2001:DB8::1", "2606:4700::1111", "::ffff:256.1.1.1", " 8.8.8.8"]
    for network in map(ipaddress.ip_network, net.UNSAFE + net.SAFE):
        first, last = int(network[0]), int(network[-1])
        texts += [str(type(network[0])(n)) for n in (first, last, max(0, first - 1), min(last + 1, 2**network.max_prefixlen - 1))]

    def plain(x):
        try:
            ip = ipaddress.ip_address((x or "").split("%")[0])
        except ValueError:
            return True
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified or ip.version == 4 and ip in ipaddress.ip_network("100.64.0.0/10"))

    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", net.is_unsafe_address(F.col("a")).alias("u")).collect()
    assert {r.a: r.u for r in rows} == {t: plain(t) for t in texts}


def test_text(spark):
    said = "Org.nr: 971 277 025. Our customer has org nr 982463718; VAT NO 923609016"
    page = '<a href="stilling/1#a">Utvikler s\u00f8kes</a><a href="/a/stilling/1">again same</a><a href="/om">About us</a><a href="/jobs?x=/om">Les om stillingen \u201cRen \u00d8ker\u201d her</a><a href="mailto:jobs">write us</a><a href="//b.no/r.pdf#p">pdf</a><a href="https://www.x.no/y#z">Y</a>'
    row = spark.createDataFrame([(said, page)], "t string, h string")
    assert row.select(text.subject_ids(F.col("t"))).first()[0] == [ORG, "923609016"]
    found = row.select(structured_data.anchors("h", F.lit("https://x.no/a/b")).alias("a"))
    assert [(r.url, r.title) for r in found.select(text.job_links(F.col("a"))).first()[0]] == [("https://x.no/a/stilling/1", "Utvikler s\u00f8kes"), ("https://x.no/jobs?x=/om", "Ren \u00d8ker")]
    domain = lambda u: names.registrable_domain(names.host_of(u))
    links = found.select(text.page_links(F.col("a"), F.lit("x.no"), domain)).first()[0]
    assert links.internal == ["https://x.no/a/stilling/1", "https://x.no/om", "https://x.no/jobs?x=/om", "https://www.x.no/y"] and links.documents == ["https://b.no/r.pdf"]
    sites = lambda name, own: row.select(text.candidate_urls(F.lit(name), F.lit(own))).first()[0]
    assert sites("Kraft Norge Vest AS", "https://k.no/") == ["https://k.no/", "https://www.kraft.no", "https://www.kraft.com", "https://www.kraft-norge.no", "https://www.kraft-norge.com"]
    assert sites("Kraft AS", "https://www.kraft.no/") == ["https://www.kraft.no/", "https://www.kraft.com"] and sites("Kraft", None)[0] == "https://www.kraft.no"
    assert row.select(text.display_number(F.lit(1234567)), text.guessed_name(F.lit("Om Kraft Norge AS i dag"), F.lit("zz"))).first() == ("1 234 567", "Om Kraft Norge")


def test_bundle(spark, tmp_path):
    results = spark.createDataFrame([("1", ["a"]), ("2", [])], "organisation_number string, facts array<string>")
    captures = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    bundle.export(results, captures, str(tmp_path / "b"))
    assert bundle.problems(spark, str(tmp_path / "b"), results.schema).collect() == []
    assert {r.problem for r in bundle.problems(spark, str(tmp_path / "b"), results.schema, hashes="facts").collect()} == {"object missing"}
    (tmp_path / "b" / "results" / "more.json").write_text('{"organisation_number":"1"}\n')
    assert {r.problem for r in bundle.problems(spark, str(tmp_path / "b"), results.schema).collect()} == {"manifest differs", "result twice"}


def test_swapped_lines_differ(spark, tmp_path):
    results = spark.createDataFrame([(str(k),) for k in range(6)], "organisation_number string").coalesce(1)
    bundle.export(results, spark.createDataFrame([(bytearray(b"x"),)], "content binary"), str(tmp_path / "b"))
    [file] = [p for p in (tmp_path / "b" / "results").glob("*.json") if p.read_text().count("\n") > 1][:1]
    lines = file.read_text().splitlines(keepends=True)
    (tmp_path / "b" / "results" / f".{file.name}.crc").unlink()
    file.write_text("".join([lines[1], lines[0], *lines[2:]]))
    assert [r.problem for r in bundle.problems(spark, str(tmp_path / "b"), results.schema).collect()] == ["manifest differs"]


def test_mapping_and_capacity(spark):
    inputs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c")], "position long, k string")
    of = lambda *rows: sorted(map(tuple, bundle.mapping_problems(inputs, spark.createDataFrame(list(rows), "position long, k string"), "k").collect()))
    assert of((0, "a"), (1, "b"), (2, "c")) == [] and of((0, "b"), (1, "a"), (2, "x")) == [("input without result", "c"), ("result out of order", "a"), ("result out of order", "b"), ("result without input", "x")]
    assert [r.problem for r in bundle.mapping_problems(inputs.filter("position <> 1"), inputs.limit(0), "k").collect()].count("input positions differ") == 1
    objects = spark.createDataFrame([("h", bytearray(b"xyz")), ("h", bytearray(b"xyz")), ("i", bytearray(b""))], "content_hash string, content binary")
    assert sorted(map(tuple, bundle.capacity_problems(objects, 5, 2).distinct().collect())) == [("bundle exceeds its capacity", "6"), ("object exceeds its capacity", "h"), ("object twice", "h")]


def test_bundle_with_projection_and_artifacts(spark, tmp_path):
    results = spark.createDataFrame([("1", ["a"]), ("2", [])], "organisation_number string, facts array<string>")
    captures = spark.createDataFrame([(bytearray(b"xyz"),)], "content binary")
    projected = lambda r: r.select("organisation_number", F.size("facts").alias("claims"))
    bundle.export(results, captures, str(tmp_path / "b"), projection=projected(results), most_bytes=3)
    assert bundle.problems(spark, str(tmp_path / "b"), results.schema, projected=projected).collect() == []
    (tmp_path / "b" / "projection" / "more.json").write_text('{"organisation_number":"3","claims":0}\n')
    assert {tuple(r) for r in bundle.problems(spark, str(tmp_path / "b"), results.schema, projected=projected).collect()} == {("projection extra", "3")}
    with pytest.raises(ValueError):
        bundle.export(results, captures, str(tmp_path / "c"), most_bytes=2)
    sinks.write_artifacts(str(tmp_path / "set"), {"results": (results, "organisation_number"), "report": (projected(results), "organisation_number")})
    schemas = {"results": (results.schema, "organisation_number"), "report": (projected(results).schema, "organisation_number")}
    assert sinks.artifact_problems(spark, str(tmp_path / "set"), schemas).collect() == []
    (tmp_path / "set" / "report" / "more.json").write_text('{"organisation_number":"9","claims":1}\n')
    assert [tuple(r) for r in sinks.artifact_problems(spark, str(tmp_path / "set"), schemas).collect()] == [("report", "differs")]


def test_a_batch_is_picked_by_slices(spark, monkeypatch):
    """A batch's records are never Python objects all at once, and every row keeps its place, null and broken bodies too."""
    alive = most = 0

    class Kept(list):
        def __del__(self):
            nonlocal alive
            alive -= 1

    def of(body, org):
        nonlocal alive, most
        alive += 1
        most = max(most, alive)
        return Kept([{"record_id": f"{body}/{org}"}])

    monkeypatch.setattr(slices, "MOST_HELD", 1000)
    kind = pa.list_(pa.struct([("record_id", pa.string())]))
    bodies, orgs = ["x" * (k % 50) if k % 9 else None for k in range(500)] + ["y" * 5000, "z"], [str(k) for k in range(502)]
    got = slices.by_slices(of, kind, pa.array(bodies), pa.array(orgs))
    assert got.to_pylist() == [[{"record_id": f"{b}/{o}"}] for b, o in zip(bodies, orgs)] and 0 < most <= 20
    assert slices.by_slices(of, kind, pa.array([], pa.string()), pa.array([], pa.string())).to_pylist() == []
    texts = [json.dumps([record(id=k + 1)]) if k % 3 else "{" if k % 2 else None for k in range(3000)]
    rows = spark.createDataFrame([(k, ORG, x) for k, x in enumerate(texts)], "k int, org_number string, body string").coalesce(1)
    found = {(r.document, r.record_id) for r in accounts.statements(accounts.records(rows, document="k")).collect()}
    assert found == {(k, str(k + 1)) for k in range(3000) if k % 3}


def test_documents_of_any_number_of_records(spark):
    """Against the plain rules: the first record of an id, or of a period, whose records all say the same."""
    dice, documents = random.Random(5), []
    for size in (1, 2, 30, 100, 101, 400, 3000):
        for spread in (size // 8 + 1, 4 * size):
            picks = [dice.randrange(spread) for _ in range(size)]
            documents.append([record(id=k + 1, journalnr=dice.choice(["J"] * 9 + ["K", None]), valuta=dice.choice(["NOK"] * 30 + ["nok"]), regnskapsperiode={"fraDato": f"{1000 + k % 8000}-01-01", "tilDato": f"{1000 + k % 8000}-12-31"}) for k in picks])
    rows = spark.createDataFrame([(k, ORG, json.dumps(d)) for k, d in enumerate(documents)], "k int, org_number string, body string")
    made = accounts.records(rows, document="k")

    def agreed(document, key, said):
        groups = {}
        for i, r in enumerate(document):
            groups.setdefault(key(r), []).append((i, r))
        return {i for (i, first), *more in groups.values() if first["valuta"] == "NOK" and all(said(r) == said(first) for _, r in more)}

    period = lambda r: tuple(r["regnskapsperiode"].values())
    want = {(k, f"/{i}/id") for k, d in enumerate(documents) for i in agreed(d, lambda r: r["id"], lambda r: r["valuta"] == "NOK" and (period(r), r["journalnr"]))}
    got = [(r.document, r.pointer) for r in accounts.statements(made).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for k, _ in want} == set(range(14))
    want = {(k, f"/{i}/eiendeler/sumEiendeler") for k, d in enumerate(documents) for i in agreed(d, period, lambda r: r)}
    got = [(r.document, r.pointer) for r in accounts.amounts(made).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for k, _ in want} == set(range(14))
