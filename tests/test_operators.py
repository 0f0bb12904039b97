import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import audit, control, history, ledger, matching, profile, sampling, verify
from attesta.sources import readers, sinks
from attesta.streaming import ingest


def arrivals(rows):
    """The ledger's rule, one observation behind another."""
    slots = {}
    for slot, seq, claim, source in rows:
        kept = slots.setdefault(slot, [])
        conflict = any(k[1] != claim for k in kept)
        if not conflict and any(k[1] == claim and k[2] == source for k in kept):
            continue
        kept.append((seq, claim, source))
    return {(s, q): "CONFLICT" if len({c for _, c, _ in kept}) > 1 else "PUBLISHED" for s, kept in slots.items() for q, _, _ in kept}


def test_ledger_equals_arrival_by_arrival(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(120), i, rng.choice("aaab"), rng.choice("xy")) for i in range(700)]
    frame = spark.createDataFrame(rows, "slot int, seq int, claim string, source string")
    got = {(r.slot, r.seq): r.status for r in ledger.ledger(frame, ["slot"], "claim", ["claim", "source"], "seq").collect()}
    assert got == arrivals(rows) and len(set(got.values())) == 2


def test_ledger_is_one_sort(spark):
    """All of the ledger's windows share an order, so a task holds its rows once."""
    frame = spark.createDataFrame([(1, 2, "a", "x")], "slot int, seq int, claim string, source string")
    plan = ledger.ledger(frame, ["slot"], "claim", ["claim", "source"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_ledger_over_nulls(spark):
    """Null claims, sources and arrivals are values like others, the null arrival the first."""
    rows = [(1, None, None, "x"), (1, 2, None, "x"), (1, 3, None, None), (1, 4, None, None), (2, 1, "a", "x"), (2, 2, None, "x"), (2, 3, "a", "x"), (3, None, "a", "x"), (3, 1, "b", "x")]
    frame = spark.createDataFrame(rows, "slot int, seq int, claim string, source string")
    got = sorted(((r.slot, r.seq, r.status) for r in ledger.ledger(frame, ["slot"], "claim", ["claim", "source"], "seq").collect()), key=str)
    assert got == [(1, 3, "PUBLISHED"), (1, None, "PUBLISHED"), (2, 1, "CONFLICT"), (2, 2, "CONFLICT"), (2, 3, "CONFLICT"), (3, 1, "CONFLICT"), (3, None, "CONFLICT")]


def test_current_value_ties(spark):
    rows = spark.createDataFrame([("k", "2024", 2, "b"), ("k", "2024", 1, "a"), ("k", None, 0, "c"), ("j", None, 5, "d")], "k string, at string, seq int, v string")
    assert sorted(r.v for r in ledger.current_values(rows, ["k"], "at", "seq").collect()) == ["a", "d"]


def test_changes_and_carry(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "k string, v string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("w", "4"), ("z", None)], "k string, v string")
    got = {r.k: r.change for r in history.detect_changes(a, b, ["k"], "v").collect()}
    assert got == {"x": "UNCHANGED", "y": "CHANGED", "w": "NEW", "z": "UNCHANGED"}
    got = {r.k: r.change for r in history.detect_changes(a, b.limit(0), ["k"], "v").collect()}
    assert set(got.values()) == {"SOURCE_UNAVAILABLE"}
    assert [r.k for r in history.last_known(a, b.filter("k <> 'x'"), ["k"]).collect()] == ["x"]


def test_breaker_and_budget(spark):
    log = [("d", 1.0 * i, ok, i) for i, ok in enumerate([True, False, False, False, True])] + [("d", 70.0, False, 5), ("d", 100.0, True, 6), ("d", 200.0, True, 7)]
    frame = spark.createDataFrame(log, "domain string, at double, ok boolean, seq int")
    got = [(r.allowed, r.open) for r in control.breaker_replay(frame, "domain", "at", "ok", "seq", {"d": control.Policy(3, 60.0)}).orderBy("seq").collect()]
    assert got == [(True, False), (True, False), (True, False), (True, True), (False, True), (True, True), (False, True), (True, False)]
    asks = spark.createDataFrame([("r", i, n) for i, n in enumerate([4, 7, 3, 4, 2])], "run string, seq int, n long")
    got = control.budget_replay(asks, "run", ["seq"], "n", 10).orderBy("seq").collect()
    assert [r.granted for r in got] == [True, False, True, False, True] and got[-1].used == 9
    equal = control.budget_cutoff(asks, "run", ["seq"], 3).orderBy("seq").collect()
    assert [r.granted for r in equal] == [True, True, True, False, False]
    hits = spark.createDataFrame([("u", float(t), i) for i, t in enumerate([0, 5, 11, 12, 30])], "url string, at double, seq int")
    assert [r.hit for r in control.cache_hits(hits, "url", "at", "seq", 10.0).orderBy("seq").collect()] == [False, True, False, True, False]


def test_breaker_policies(spark):
    """Opens at its threshold; the wait doubles up to four times while it fails on, and starts anew after a success."""
    times = [0, 1, 2, 3, 4, 63, 64, 183, 200, 423, 500, 663, 700, 940, 950, 951, 952, 953]
    good = [False] * 13 + [True] + [False] * 4
    frame = spark.createDataFrame([("d", float(t), ok, i) for i, (t, ok) in enumerate(zip(times, good))], "domain string, at double, ok boolean, seq int")
    got = control.breaker_replay(frame, "domain", "at", "ok", "seq").orderBy("seq").collect()
    assert [r.allowed for r in got] == [True] * 4 + [False, True, False, True, False, True, False, True, False, True, True, True, True, True]
    assert [r.open for r in got][3:14] == [True] * 10 + [False] and got[-1].open and got[-1].failures == 4
    strict = control.breaker_replay(frame, "domain", "at", "ok", "seq", {"d": control.Policy(1, 1e9)}).orderBy("seq").collect()
    assert [r.allowed for r in strict] == [True] + [False] * 17


def test_previous_as_of_starts_no_later(spark):
    schema = "k int, run_id string, started_at int, completed_at int, sequence int, cutoff int"
    rows = [(1, "a", 5, 6, 1, 0), (1, "b", 9, 10, 2, 1), (1, "c", 7, 8, 3, 2), (1, "d", 7, 7, None, 9), (2, "e", 1, 1, None, None), (2, "f", 2, None, None, None), (2, "g", 3, 4, None, None)]
    got = {r.run_id: r.prev_run for r in history.previous_as_of(spark.createDataFrame(rows, schema), "k").collect()}
    assert got == {"b": "d", "c": "a", "d": "c", "f": "e", "g": "e"}


def loop_quotas(population, order, size):
    quota, given = dict.fromkeys(population, 0), 0
    while given < size and any(quota[s] < population[s] for s in population):
        for s in order:
            if given < size and quota[s] < population[s]:
                quota[s] += 1
                given += 1
    return quota


def test_sampling(spark):
    rng = random.Random(4)
    universe = spark.createDataFrame([(f"{i:09d}", rng.choice("aaaabbcd")) for i in range(400)], "org string, stratum string")
    split = sampling.splits(universe, "org", "s")
    for name in ("development", "held_out"):
        rows = [r for r in sampling.quotas(split, "s", 30).collect() if r.split == name]
        order = [r[0] for r in spark.createDataFrame([(r.stratum,) for r in rows], "x string").orderBy(sampling.rank("s", "stratum-order", F.col("x")), "x").collect()]
        assert {r.stratum: r.quota for r in rows} == loop_quotas({r.stratum: r.population for r in rows}, order, 30)
    chosen = sampling.select(universe, "org", "s", 30).collect()
    shuffled = sampling.select(universe.orderBy(F.rand(1)), "org", "s", 30).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, shuffled)) and len(chosen) == 60
    fewer = {r.org for r in sampling.select(universe, "org", "s", 10).collect()}
    assert fewer <= {r.org for r in chosen}
    assert not {r.org for r in chosen if r.split == "development"} & {r.org for r in chosen if r.split == "held_out"}


def test_verdict_ladder(spark):
    cases = [(1.0, 0, True, False, False, "VERIFIED"), (1.0, 2, True, True, False, "REJECTED"), (0.95, 1, False, False, False, "VERIFIED"), (0.8, 1, False, False, False, "LIKELY"), (1.0, 0, False, False, False, "AMBIGUOUS"), (0.5, 2, False, False, False, "LIKELY"), (0.2, 0, False, False, False, "REJECTED"), (0.6, 1, False, False, False, "AMBIGUOUS"), (1.0, 1, True, False, True, "REJECTED")]
    frame = spark.createDataFrame(cases, "s double, c int, id boolean, dom boolean, other boolean, want string")
    v = matching.verdict(F.col("s"), F.col("c"), F.col("id"), F.col("dom"), F.col("other"))
    judged = frame.select("want", v["verdict"].alias("verdict"), v["score"].alias("score"))
    assert all(r.want == r.verdict for r in judged.collect())
    good, bad = matching.firewall(judged)
    assert good.count() + bad.count() == len(cases) and bad.filter("reason LIKE 'entity verdict %'").count() == bad.count()


def test_citations(spark):
    base = dict(org_number="1", category="financials", field="revenue", item_key=None, value="1234", currency="NOK", reporting_period="2024", entity_verdict="VERIFIED", source_id="s", evidence_id="e")
    changes = [({}, "ok"), (dict(entity_verdict="REJECTED"), "entity verdict REJECTED"), (dict(source_id="none"), "source not found in ledger"), (dict(evidence_id="none"), "evidence not found in ledger"), (dict(value=None), "fact value is None"), (dict(currency=None), "financial fact missing currency"), (dict(currency="EUR"), "financial currency absent from evidence"), (dict(reporting_period="2023"), "financial reporting year absent from evidence"), (dict(value="999"), "financial value absent from evidence"), (dict(org_number="2"), "source belongs to different company"), (dict(category="jobs", field="job_posting"), "collection claim requires a stable source item key")]
    schema = "org_number string, category string, field string, item_key string, value string, currency string, reporting_period string, entity_verdict string, source_id string, evidence_id string, want string"
    facts = spark.createDataFrame([tuple((base | c).values()) + (w,) for c, w in changes], schema)
    sources = spark.createDataFrame([("s", "success", "registry", "application/json", "1", "h")], "source_id string, access_status string, source_type string, content_type string, org_number string, content_hash string")
    evidence = spark.createDataFrame([("e", "s", "Revenue 2024: 1 234 NOK", "VERIFIED", "1", "h", "json_pointer")], "evidence_id string, source_id string, evidence_text string, entity_verdict string, org_number string, content_hash string, locator_kind string")
    for r in verify.check_citations(facts, sources, evidence).collect():
        assert r.reason == r.want and r.ok == (r.want == "ok")


def test_reporting_year_is_a_number_of_its_own(spark):
    """Digits of a record's id, of a longer number or of an amount are no year; dates and lists of years have one."""
    has = {"FY2024": True, "2024-01-01/2024-12-31": True, "31.12.2024, NOK": True, "2024.12.31": True, "2023,2024": True, "2024,2025": True, "in 2024.": True, '"2024"': True}
    lacks = {'record_id "20244"': False, "52024": False, '"value":"2024.9"': False, '"source_number":"-2024.90"': False, "2024,50 kr": False, "2023-12-31": False}
    rows = spark.createDataFrame(list((has | lacks).items()), "said string, want boolean")
    for r in rows.withColumn("got", F.array_contains(F.regexp_extract_all("said", F.lit(verify.YEAR), F.lit(0)), "2024")).collect():
        assert r.got == r.want, r.said
    facts = spark.createDataFrame([(k, "1", "financials", "revenue", None, "1234", "NOK", "2024", "VERIFIED", "s", k) for k in "ab"], "fact_id string, org_number string, category string, field string, item_key string, value string, currency string, reporting_period string, entity_verdict string, source_id string, evidence_id string")
    sources = spark.createDataFrame([("s", "success", "registry", "application/json", "1", "h")], "source_id string, access_status string, source_type string, content_type string, org_number string, content_hash string")
    evidence = spark.createDataFrame([(k, "s", said, "VERIFIED", "1", "h", "json_number") for k, said in (("a", "1234 NOK 2023-12-31 id 20244"), ("b", "1234 NOK 2024-12-31 id 20244"))], "evidence_id string, source_id string, evidence_text string, entity_verdict string, org_number string, content_hash string, locator_kind string")
    assert {r.fact_id: r.reason for r in verify.check_citations(facts, sources, evidence).collect()} == {"a": "financial reporting year absent from evidence", "b": "ok"}


def test_profiles_and_audits(spark):
    facts = spark.createDataFrame([("1", "identity", "PUBLISHED"), ("1", "jobs", "CONFLICT"), ("2", "jobs", "PUBLISHED")], "org string, category string, status string")
    cats = ["identity", "jobs", "news"]
    rows = profile.coverage_counts(profile.coverage(facts, "org", "category", cats, F.col("status") == "PUBLISHED", F.col("status") == "CONFLICT"), cats).orderBy("org").collect()
    assert [(r.identity, r.jobs, r.news, r.found, r.researched) for r in rows] == [("found", "ambiguous", "not_found", 1, 2), ("not_found", "found", "not_found", 1, 1)]
    assert audit.differing(facts, facts).count() == 0 and audit.differing(facts, facts.limit(2)).count() == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("﻿orgnr,name\n982463718,a\n\n 971277025 ,b\n982463718,c\n", encoding="utf-8")
    got = readers.read_ids(spark, str(tmp_path / "ids.csv")).orderBy("position").collect()
    assert [r.supplied for r in got] == ["982463718", "971277025", "982463718"]
    (tmp_path / "ids.jsonl").write_text('{"organisation_number":"1"}\n\n{"organisation_number":"2","x":1}\n')
    assert [r.supplied for r in readers.read_ids(spark, str(tmp_path / "ids.jsonl")).orderBy("position").collect()] == ["1", "2"]
    (tmp_path / "bad.jsonl").write_text('{"organisation_number":"1","organisation_number":"2"}\n')
    try:
        readers.read_ids(spark, str(tmp_path / "bad.jsonl")).collect()
        raise AssertionError("must refuse")
    except Exception as error:
        assert "not a strict record" in str(error)
    rows = spark.createDataFrame([("r", "1", "p"), ("r", "2", "q")], "run_id string, org string, payload string")
    for _ in range(2):
        sinks.append_envelopes(rows, str(tmp_path / "out"), ["run_id", "org"], "payload")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    sinks.write_jsonl(rows, str(tmp_path / "bundle"), ["org"])
    assert sinks.manifest(rows, "org").first().rows == 2
    body = '{"organisasjonsnummer":"1","navn":"X AS","konkurs":false,"underAvvikling":false,"underTvangsavviklingEllerTvangsopplosning":false,"antallAnsatte":3,"forretningsadresse":{"adresse":["Gata 1"],"postnummer":"0001","poststed":"OSLO","kommune":"OSLO"},"hjemmeside":"X.no"}'
    r = readers.parse_entities(spark.createDataFrame([("1", body)], "org string, body string"), "org", "body").first()
    assert (r.state, r.status, r.registered_address, r.website) == ("ok", "active", "Gata 1 0001 OSLO", "https://x.no")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i, f"2024-01-01 00:00:{i % 60:02d}") for i in range(200)], "k int, seq int, at string")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.observations(spark, str(tmp_path / "in"), rows.schema, files_a_batch=2)
    ingest.run_batches(stream, str(tmp_path / "check"), lambda df, _: seen.extend(ledger.current_values(df, ["k"], "at", "seq").collect()))
    merged = ledger.current_values(spark.createDataFrame(seen, rows.schema), ["k"], "at", "seq").collect()
    assert sorted(map(tuple, merged)) == sorted(map(tuple, ledger.current_values(rows, ["k"], "at", "seq").collect()))


def test_universe(spark, tmp_path):
    rows = [{"organisation_number": f"{i:09d}", "employees": i, "legal_form": "AS"} for i in range(5)]
    good = tmp_path / "u.jsonl.gz"
    good.write_bytes(gzip.compress("".join(json.dumps(r) + "\n" for r in rows).encode()))
    got = readers.read_universe(spark, str(good), hashlib.sha256(good.read_bytes()).hexdigest(), most_bytes=10_000).collect()
    assert [(r.line, r.organisation_number, r.employees, r.website) for r in got] == [(i + 1, f"{i:09d}", i, None) for i in range(5)]
    for kwargs in ({"sha256": "0" * 64}, {"most_bytes": 10}):
        with pytest.raises(ValueError):
            readers.read_universe(spark, str(good), **kwargs)
    with pytest.raises(Exception, match="line too long in line 1"):
        readers.read_universe(spark, str(good), most_line=5).collect()
    for n, body in enumerate(('{"organisation_number":"1","organisation_number":"2"}', '{"organisation_number":NaN}', "[1]", '{"name":"x"}')):
        (tmp_path / f"bad{n}.jsonl").write_text(body + "\n")
        with pytest.raises(Exception, match="not a strict record in line 1"):
            readers.read_universe(spark, str(tmp_path / f"bad{n}.jsonl")).collect()


def test_strict_lists(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('982463718,a\n"97"1277025,b\n')
    with pytest.raises(Exception):
        readers.read_ids(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "ok.txt").write_text("Orgnr\n\n982463718\n971277025,x,y\n")
    assert [r.supplied for r in readers.read_ids(spark, str(tmp_path / "ok.txt")).orderBy("position").collect()] == ["982463718", "971277025"]


def test_captures_from_files(spark, tmp_path):
    digest = hashlib.sha256(b"body").hexdigest()
    (tmp_path / "blobs").mkdir()
    (tmp_path / "blobs" / f"{digest}.bin").write_bytes(b"body")
    rows = spark.createDataFrame([("s", "u", digest, 4, None), ("t", "u", "0" * 64, 4, None)], readers.CAPTURES)
    rows.write.parquet(str(tmp_path / "meta"))
    got = {r.source_id: r.content for r in readers.read_captures(spark, str(tmp_path / "meta"), str(tmp_path / "blobs")).collect()}
    assert got == {"s": bytearray(b"body"), "t": None}


def test_event_time_windows_and_first_sightings(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(30)] * 2, "k int, t string").select("k", F.to_timestamp("t").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.observations(spark, str(tmp_path / "in"), rows.schema)
    for name, df, mode in (("counts", ingest.windowed_counts(stream, "at", ["k"], "10 minutes", "1 minute"), "complete"), ("seen", ingest.first_sightings(stream, ["k", "at"], "at", "1 hour"), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted((str(r.start)[14:16], r.k, r.n) for r in spark.table("counts").collect())[:3] == [("00", 0, 8), ("00", 1, 6), ("00", 2, 6)]
    assert spark.table("seen").count() == 30
