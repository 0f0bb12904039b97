"""Snapshot support of claims about documents that are made of customers, one query a family of rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.functions.rules import as_object, quoted
from attesta.operators import support
from attesta.plans.registry import ORACLES, query, read
from attesta.sources.captures import CaptureStore
from attesta.sources.workspace import shared_folder

ORGS = ["982463718", "971277025", "923609016", "960514718", "958973306"]
AT = "2024-05-01T10:00:00+00:00"


def _chosen(number, *values):
    """The value of a case number, from 0; the last for all others."""
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(number == i, v).otherwise(out)
    return out


def _checked(customers, *, key, body, path, value, raw, display, org=None, source_type="registry", content_type="application/json", tier=0, kind="json_pointer", anchor=None, tables_only=False, **more):
    """The reasons of one claim a customer; ``key`` is the source's prefix, ``more`` overrides columns of facts (f_), evidence (e_), sources (s_) or captures (c_)."""
    c = F.col
    org = F.element_at(F.array(*map(F.lit, ORGS)), (c("c_custkey") % 5 + 1).cast("int")) if org is None else org
    rows = customers.select("*", org.alias("_org")).withColumns({"_body": body, "_source": F.concat(F.lit(key), c("c_custkey").cast("string"))})
    url = F.lit(path) if isinstance(path, str) else F.concat(F.lit("https://data.brreg.no"), path)
    content = F.encode("_body", "UTF-8")
    null = F.lit(None).cast("string")
    meta = dict(url=url, requested_url=null, final_url=null, redirect_chain=F.array().cast("array<string>"), source_type=F.lit(source_type), org_number=c("_org"), content_hash=F.sha2(content, 256), content_type=F.lit(content_type), http_status=F.lit(200), snapshot_representation=F.lit(support.BODY), retrieved_at=F.lit(AT), authority_tier=F.lit(tier), access_status=F.lit("success"))
    facts = dict(fact_id=c("c_custkey"), org_number=c("_org"), category=F.lit("identity"), field=F.lit("legal_name"), item_key=null, subject_scope=F.lit("legal_entity"), unit=null, currency=null, reporting_period=null, valid_from=null, valid_to=null, value=value, normalized_value=value, retrieved_at=F.lit(AT), entity_verdict=F.lit("VERIFIED"), source_id=c("_source"), evidence_id=c("_source"))
    seen = dict(evidence_id=c("_source"), source_id=c("_source"), content_hash=meta["content_hash"], retrieved_at=F.lit(AT), authority_tier=F.lit(tier), source_type=F.lit(source_type), evidence_text=display, entity_verdict=F.lit("VERIFIED"), org_number=c("_org"), extraction_rule=null, supporting_pointers=null, locator_kind=F.lit(kind), pointer=null, raw_value=raw, normalization=F.lit("identity"), record_pointer=null, record_id=null, script_index=F.lit(None).cast("int"), identity_source_id=null)
    blobs = dict(content_hash=meta["content_hash"], content=content)
    tables = {"f": facts, "e": seen, "s": dict(source_id=c("_source"), **meta), "c": dict(source_id=c("_source"), **meta, byte_count=F.octet_length(content)), "b": blobs}
    for name, column in more.items():
        tables[name[0]][name[2:]] = column
    f, e, s, cap, b = (rows.select(*(x.alias(n) for n, x in t.items())) for t in tables.values())
    cap = cap.join(rows.filter("_fault <> 1").select(F.col("_source").alias("source_id")), "source_id", "left_semi") if "_fault" in rows.columns else cap
    if anchor is not None:
        parts = anchor(rows, meta)
        s, cap, b = s.unionByName(parts[0]), cap.unionByName(parts[1]), b.unionByName(parts[2])
    tables = f, s, e, cap, b.dropDuplicates(["content_hash"])
    return tables if tables_only else support.check_support(*tables)


def _customers(spark, sf_dir, faults):
    return read(spark, sf_dir, "customer").withColumn("_fault", F.col("c_custkey") % faults)


def _named(**parts):
    return as_object(*parts.items())


FIELDS = list(support.IDENTITY_PATHS)


def _registry_body():
    c = F.col
    return F.concat(
        F.lit('{"organisasjonsnummer":'), quoted(c("_org")), F.lit(',"navn":'), quoted(c("c_name")), F.lit(',"organisasjonsform":{"kode":"AS"},"konkurs":false,"underAvvikling":'),
        F.when(c("c_custkey") % 4 == 0, "true").otherwise("false"), F.lit(',"underTvangsavviklingEllerTvangsopplosning":false,"forretningsadresse":{"adresse":["Gata '), c("c_custkey").cast("string"),
        F.lit('"],"postnummer":"0001","poststed":"OSLO","kommune":"OSLO"},"postadresse":{"kommune":"BERGEN"},"naeringskode1":{"kode":"62.010","beskrivelse":'), quoted(c("c_mktsegment")), F.lit('},"hjemmeside":"HTTPS://C'),
        c("c_custkey").cast("string"), F.lit('.No/A","registreringsdatoEnhetsregisteret":"2020-01-02","antallAnsatte":'), (c("c_custkey") % 50).cast("string"), F.lit("}"),
    )


@query(
    "identity_support",
    """WITH t AS (SELECT c_custkey AS fact_id, c_custkey % 11 AS fault, c_custkey % 10 AS field FROM customer)
       SELECT fact_id, CASE fault WHEN 1 THEN 'source capture i' || fact_id || ' is missing' WHEN 2 THEN 'acquisition metadata disagrees with captured source' WHEN 3 THEN 'capture retrieval time must include a timezone'
                WHEN 4 THEN 'evidence/claim provenance differs from capture' WHEN 5 THEN 'locator raw value differs from snapshot' WHEN 6 THEN 'registry identity acquisition requires the exact official entity endpoint'
                WHEN 7 THEN 'registry identity requires scalar legal-entity scope' WHEN 8 THEN CASE WHEN field = 4 THEN 'municipality pointer differs from registered address scope' ELSE 'claim value differs from supported normalized value' END
                WHEN 9 THEN 'structured evidence display differs from located value' WHEN 10 THEN 'snapshot integrity failure' ELSE 'ok' END AS reason FROM t""",
)
def identity_support(spark, sf_dir):
    """Ten identity fields, each with the value that its rule derives, and ten ways to break the support."""
    c, text = F.col, lambda x: quoted(F.lit(x))
    field, fault = c("c_custkey") % 10, c("_fault")
    street = F.concat(F.lit("Gata "), c("c_custkey").cast("string"))
    place = _named(adresse=F.concat(F.lit("["), quoted(street), F.lit("]")), postnummer=text("0001"), poststed=text("OSLO"), kommune=text("OSLO"))
    site = F.concat(F.lit("HTTPS://C"), c("c_custkey").cast("string"), F.lit(".No/A"))
    org = F.element_at(F.array(*map(F.lit, ORGS)), (c("c_custkey") % 5 + 1).cast("int"))
    going = F.when(c("c_custkey") % 4 == 0, "true").otherwise("false")
    whole = _named(
        organisasjonsnummer=quoted(org), navn=quoted(c("c_name")), organisasjonsform=F.lit('{"kode": "AS"}'), konkurs=F.lit("false"), underAvvikling=going, underTvangsavviklingEllerTvangsopplosning=F.lit("false"), forretningsadresse=place,
        postadresse=F.lit('{"kommune": "BERGEN"}'), naeringskode1=_named(kode=text("62.010"), beskrivelse=quoted(c("c_mktsegment"))), hjemmeside=quoted(site), registreringsdatoEnhetsregisteret=text("2020-01-02"), antallAnsatte=(c("c_custkey") % 50).cast("string"),
    )
    raw = _chosen(field, quoted(c("c_name")), text("AS"), whole, place, F.when(fault == 8, text("BERGEN")).otherwise(text("OSLO")), text("62.010"), quoted(c("c_mktsegment")), quoted(site), text("2020-01-02"), (c("c_custkey") % 50).cast("string"))
    status = F.when(c("c_custkey") % 4 == 0, text("under_liquidation")).otherwise(text("active"))
    value = _chosen(field, raw, raw, status, quoted(F.concat(street, F.lit(" 0001 OSLO"))), raw, raw, raw, quoted(F.concat(F.lower(F.left(site, F.length(site) - 1)), F.lit("A"))), raw, raw)
    pointers = [F.lit(p[0]) for p, _ in support.IDENTITY_PATHS.values()]
    pointers[4] = F.when(fault == 8, "/postadresse/kommune").otherwise(pointers[4])
    rows = _customers(spark, sf_dir, 11)
    return _checked(
        rows, key="i", body=_registry_body(), path=F.concat(F.lit("/enhetsregisteret/api/enheter/"), c("_org"), F.when(fault == 6, "?x=1").otherwise("")), raw=F.when(fault == 5, '"other"').otherwise(raw), display=F.when(fault == 9, "shown").otherwise(raw),
        value=F.when((fault == 8) & (field != 4), F.lit('"invented"')).otherwise(value), f_field=_chosen(field, *map(F.lit, FIELDS)), e_pointer=_chosen(field, *pointers), e_normalization=_chosen(field, *(F.lit(r) for _, r in support.IDENTITY_PATHS.values())),
        f_item_key=F.when(fault == 7, "k"), s_http_status=F.when(fault == 2, 404).otherwise(200), f_retrieved_at=F.when(fault == 4, "2024-05-02T10:00:00+00:00").when(fault == 3, "2024-05-01").otherwise(AT),
        s_retrieved_at=F.when(fault == 3, "2024-05-01").otherwise(AT), c_retrieved_at=F.when(fault == 3, "2024-05-01").otherwise(AT), e_retrieved_at=F.when(fault == 3, "2024-05-01").otherwise(AT), c_byte_count=F.octet_length(F.encode("_body", "UTF-8")) + F.when(fault == 10, 1).otherwise(0),
    )


@query(
    "subunit_support",
    """SELECT c_custkey AS fact_id, CASE c_custkey % 10 WHEN 1 THEN 'source capture u' || c_custkey || ' is missing' WHEN 2 THEN 'JSON pointer not found' WHEN 3 THEN 'subunit acquisition endpoint or parent filter differs' WHEN 4 THEN 'subunit name missing or invalid'
                WHEN 5 THEN 'subunit and explicit parent identifiers must be distinct valid orgnrs' WHEN 6 THEN 'subunit parent, item or relationship scope differs' WHEN 7 THEN 'subunit attributes differ from captured record' WHEN 8 THEN 'subunit evidence display differs from located record'
                WHEN 9 THEN 'subunit attributes must be strings or unknown' ELSE 'ok' END AS reason FROM customer""",
)
def subunit_support(spark, sf_dir):
    c, fault, text = F.col, F.col("_fault"), lambda x: quoted(F.lit(x))
    own, parent = F.lit("974760673"), F.when(fault == 5, "974760673").otherwise(c("_org"))
    name = F.when(fault == 4, F.lit('" "')).otherwise(quoted(c("c_name")))
    place = _named(adresse=F.lit('["Vei 1", "B"]'), kommune=F.when(fault == 9, "7").otherwise('"OSLO"'), postnummer=text("0002"))
    org = F.element_at(F.array(*map(F.lit, ORGS)), (c("c_custkey") % 5 + 1).cast("int"))
    record = lambda parent: _named(organisasjonsnummer=quoted(own), overordnetEnhet=quoted(parent), navn=name, beliggenhetsadresse=place, naeringskode1=F.lit("null"), nedleggelsesdato=text("2024-02-29"))
    raw = record(F.when(fault == 5, "974760673").otherwise(org))
    value = _named(orgnr=quoted(own), parent_orgnr=quoted(org), name=name, physical_address=text("Vei 1 B"), municipality=text("OSLO"), postal_code=text("0002"), postal_area=F.lit("null"), industry=F.when(fault == 7, '"x"').otherwise("null"), closure_date=text("2024-02-29"), deleted_date=F.lit("null"))
    return _checked(
        _customers(spark, sf_dir, 10), key="u", body=F.concat(F.lit('{"_embedded":{"underenheter":['), record(parent), F.lit("]}}")), path=F.concat(F.lit("/enhetsregisteret/api/underenheter?overordnetEnhet="), F.when(fault == 3, F.lit("1")).otherwise(c("_org")), F.lit("&size=20")),
        raw=raw, display=F.when(fault == 8, "shown").otherwise(raw), value=value, f_category=F.lit("locations"), f_field=F.lit("branch"), f_item_key=F.when(fault == 6, F.lit("other")).otherwise(own), e_normalization=F.lit("brreg-subunit-v1"), e_pointer=F.when(fault == 2, "/_embedded/underenheter/1").otherwise("/_embedded/underenheter/0"),
    )


def _account_body(fault):
    c = F.col
    return F.concat(
        F.lit('[{"id":'), (c("c_custkey") + 1).cast("string"), F.lit(',"journalnr":"J \\"1\\"","virksomhet":{"organisasjonsnummer":'), quoted(c("_org")), F.lit('},"regnskapstype":"SELSKAP","valuta":"NOK","avviklingsregnskap":'), F.when(fault == 5, "null").otherwise("false"),
        F.lit(',"regnskapsperiode":{"fraDato":"2024-01-01","tilDato":"2024-12-31"},"eiendeler":{"sumEiendeler":'), c("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("}}"),
        F.when(fault == 4, F.concat(F.lit(',{"id":'), (c("c_custkey") + 1).cast("string"), F.lit("}"))).otherwise(""), F.lit("]"),
    )


def _accounts(spark, sf_dir, key, faults, **more):
    c, fault = F.col, F.col("_fault")
    path = F.concat(F.lit("/regnskapsregisteret/regnskap/"), c("_org"), F.when(fault == 3, "/other").when(c("c_custkey") % 2 == 0, F.concat(F.lit("/"), (c("c_custkey") + 1).cast("string"))).otherwise(""))
    period = dict(f_reporting_period=F.lit("2024-01-01/2024-12-31"), f_valid_from=F.lit("2024-01-01"), f_valid_to=F.when(fault == 7, "2024-12-30").otherwise("2024-12-31"))
    return _checked(_customers(spark, sf_dir, faults), key=key, body=_account_body(fault), path=path, source_type="registry_accounts", content_type="application/json; charset=utf-8", **period, **more)


@query(
    "statement_support",
    """SELECT c_custkey AS fact_id, CASE c_custkey % 9 WHEN 1 THEN 'source capture s' || c_custkey || ' is missing' WHEN 2 THEN 'unsupported statement metadata contract' WHEN 3 THEN 'account support requires exact official company/record endpoint'
                WHEN 4 THEN 'statement locator or record binding differs from capture' WHEN 6 THEN 'statement locator or record binding differs from capture' WHEN 7 THEN 'statement attributes differ from independently resolved record'
                WHEN 8 THEN 'statement attributes differ from independently resolved record' ELSE 'ok' END AS reason FROM customer""",
)
def statement_support(spark, sf_dir):
    """A contradicting record of the same id withholds the statement; a liquidation flag doesn't concern it."""
    c, fault, text = F.col, F.col("_fault"), lambda x: quoted(F.lit(x))
    number = (c("c_custkey") + 1).cast("string")
    value = _named(accounting_scope=text("legal_entity"), currency=text("NOK"), journal_number=text('J "1"'), period_end=text("2024-12-31"), period_start=text("2024-01-01"), record_id=quoted(number))
    paths = dict(record_id="/0/id", currency="/0/valuta", period_start="/0/regnskapsperiode/fraDato", period_end="/0/regnskapsperiode/tilDato", accounting_scope="/0/regnskapstype", subject="/0/virksomhet/organisasjonsnummer", journal_number="/0/journalnr")
    return _accounts(
        spark, sf_dir, "s", 9, raw=number, display=value, value=value, f_category=F.lit("accounting_filings"), f_field=F.lit("statement"), f_item_key=F.when(fault == 8, F.lit("0")).otherwise(number), e_pointer=F.when(fault == 6, "/id").otherwise("/0/id"),
        e_extraction_rule=F.when(fault == 2, "other").otherwise(support.STATEMENT_RULE), e_supporting_pointers=_named(**{k: text(v) for k, v in paths.items()}),
    )


@query(
    "amount_support",
    """SELECT c_custkey AS fact_id, CASE c_custkey % 10 WHEN 1 THEN 'source capture a' || c_custkey || ' is missing' WHEN 2 THEN 'unsupported monetary claim contract' WHEN 3 THEN 'account support requires exact official company/record endpoint'
                WHEN 5 THEN 'amount pointer is not an independently supported statement field' WHEN 6 THEN 'amount locator differs from retained statement' WHEN 7 THEN 'amount value or qualifiers differ from retained statement'
                WHEN 8 THEN 'amount value or qualifiers differ from retained statement' WHEN 9 THEN 'amount pointer is not an independently supported statement field' ELSE 'ok' END AS reason FROM customer""",
)
def amount_support(spark, sf_dir):
    """The exact amount of the retained token, its qualifiers and its display."""
    return _amount_claims(spark, sf_dir)


def _amount_claims(spark, sf_dir, **more):
    c, fault, text = F.col, F.col("_fault"), lambda x: quoted(F.lit(x))
    token = c("c_acctbal").cast("decimal(18,2)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(token, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.when(plain == "-0", "0").otherwise(plain)
    display = _named(source_field=text("sumEiendeler"), source_number=quoted(token), value=quoted(plain), currency=text("NOK"), period_start=text("2024-01-01"), period_end=text("2024-12-31"), record_id=quoted((c("c_custkey") + 1).cast("string")), journal_number=text('J "1"'), accounting_scope=text("legal_entity"))
    return _accounts(
        spark, sf_dir, "a", 10, kind="json_number", raw=F.when(fault == 6, F.concat(token, F.lit("0"))).otherwise(token), display=display, value=F.when(fault == 8, quoted(F.concat(plain, F.lit("1")))).otherwise(quoted(plain)), f_category=F.lit("financials"),
        f_field=F.lit("total_assets"), f_unit=F.lit(support.AMOUNT_UNIT), f_currency=F.lit("NOK"), e_pointer=F.when(fault == 9, "/0/egenkapitalGjeld/gjeldOversikt/sumGjeld").otherwise("/0/eiendeler/sumEiendeler"), e_record_pointer=F.lit("/0"), e_record_id=(c("c_custkey") + 1).cast("string"),
        e_extraction_rule=F.when(fault == 2, "other").otherwise(support.AMOUNT_RULE), **more,
    )


@query("stored_support", ORACLES["amount_support"])
def stored_support(spark, sf_dir):
    """The same from a store of captures: added twice, read bucket by bucket."""
    tables = _amount_claims(spark, sf_dir, tables_only=True)
    store = CaptureStore(spark, f"captures_{uuid.uuid4().hex}", f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}", buckets=8)
    for _ in range(2):
        store.add(*tables[3:])
    return support.check_support(*tables[:3], store.captures(), store.bodies())


def amount_tables(spark, sf_dir):
    """facts, sources, evidence, captures and blobs of one amount a customer, with seven kinds of faults."""
    c, fault, text = F.col, F.col("_fault") - 100, lambda x: quoted(F.lit(x))
    token = c("c_acctbal").cast("decimal(18,2)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(token, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.when(plain == "-0", "0").otherwise(plain)
    number = (c("c_custkey") + 1).cast("string")
    year = F.when(fault == 6, "2023").otherwise("2024")
    display = _named(source_field=text("sumEiendeler"), source_number=quoted(token), value=quoted(plain), currency=F.when(fault == 2, text("EUR")).otherwise(text("NOK")), period_start=quoted(F.concat(year, F.lit("-01-01"))), period_end=quoted(F.concat(year, F.lit("-12-31"))), record_id=quoted(number), journal_number=text('J "1"'), accounting_scope=text("legal_entity"))
    rows = read(spark, sf_dir, "customer").withColumn("_fault", c("c_custkey") % 7 + 100)
    said = F.when(fault == 3, F.concat(plain, F.lit("123456"))).otherwise(plain)
    return _checked(
        rows, key="f", body=_account_body(fault + 1000), path=F.concat(F.lit("/regnskapsregisteret/regnskap/"), c("_org")), source_type="registry_accounts", content_type="application/json", tables_only=True, kind="json_number", raw=F.when(fault == 5, F.concat(token, F.lit("0"))).otherwise(token), display=display, value=quoted(said),
        f_category=F.lit("financials"), f_field=F.lit("total_assets"), f_unit=F.lit(support.AMOUNT_UNIT), f_currency=F.lit("NOK"), f_reporting_period=F.lit("2024-01-01/2024-12-31"), f_valid_from=F.when(fault == 4, "2024-01-02").otherwise("2024-01-01"), f_valid_to=F.lit("2024-12-31"), s_access_status=F.when(fault == 1, "blocked").otherwise("success"),
        e_pointer=F.lit("/0/eiendeler/sumEiendeler"), e_record_pointer=F.lit("/0"), e_record_id=number, e_extraction_rule=F.lit(support.AMOUNT_RULE), e_org_number=c("_org"),
    )


@query(
    "html_support",
    """SELECT c_custkey AS fact_id, CASE c_custkey % 11 WHEN 1 THEN 'source capture h' || c_custkey || ' is missing' WHEN 2 THEN 'HTML requires unambiguous text/html UTF8 representation' WHEN 3 THEN 'HTML requires a retained registered website'
                WHEN 4 THEN 'HTML acquisition origin differs from retained registered website' WHEN 5 THEN 'HTML has unsupported trailing content after closed document' WHEN 6 THEN 'HTML page carries a contradictory subject identifier'
                WHEN 7 THEN 'HTML locator does not resolve to supported exact-subject literal' WHEN 8 THEN 'HTML value/display differs from retained literal' WHEN 9 THEN 'HTML anchor: snapshot integrity failure' WHEN 10 THEN 'HTML embedded charset differs from declared UTF8 representation'
                ELSE 'ok' END AS reason FROM customer""",
)
def html_support(spark, sf_dir):
    """A description in JSON-LD, on a page at the registered origin, with the registry document as its anchor."""
    c, fault = F.col, F.col("_fault")
    site = F.concat(F.lit("https://c"), c("c_custkey").cast("string"), F.lit(".no"))
    said = F.concat(F.lit("We sell "), c("c_mktsegment"), F.lit(' & "more".'))
    node = F.concat(F.lit('{"@context":"https://schema.org","@type":"Organization","legalName":'), quoted(F.upper("c_name")), F.lit(',"vatID":"NO '), c("_org"), F.lit(' MVA","description":'), quoted(said), F.lit("}"))
    body = F.concat(
        F.lit('<html><head><meta charset="'), F.when(fault == 10, "latin1").otherwise("utf-8"), F.lit('"></head><body><p>Org.nr: '), F.when(fault == 6, "974760673").otherwise(c("_org")), F.lit('</p><script>x</script><script type="application/ld+json">'), node,
        F.lit("</script></body></html>"), F.when(fault == 5, "<p>more</p>").otherwise("\n"),
    )

    def anchor(rows, meta):
        document = F.concat(F.lit('{"organisasjonsnummer":'), quoted(c("_org")), F.lit(',"navn":'), quoted(c("c_name")), F.lit(',"hjemmeside":'), F.when(fault == 3, F.lit("null")).otherwise(quoted(site)), F.lit("}"))
        rows = rows.withColumns({"_doc": F.encode(document, "UTF-8"), "_anchor": F.concat(F.lit("r"), c("c_custkey").cast("string"))})
        own = meta | dict(url=F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/enheter/"), c("_org")), source_type=F.lit("registry"), content_type=F.lit("application/json"), authority_tier=F.lit(0), content_hash=F.sha2("_doc", 256))
        sources = rows.select(c("_anchor").alias("source_id"), *(x.alias(n) for n, x in own.items()))
        kept = F.octet_length("_doc") + F.when(fault == 9, 1).otherwise(0)
        return sources, rows.select(c("_anchor").alias("source_id"), *(x.alias(n) for n, x in own.items()), kept.alias("byte_count")), rows.select(own["content_hash"].alias("content_hash"), c("_doc").alias("content"))

    return _checked(
        _customers(spark, sf_dir, 11), key="h", body=body, path="", anchor=anchor, raw=said, display=said, value=quoted(F.when(fault == 8, F.concat(said, F.lit(" "))).otherwise(said)), source_type="company_website", content_type="text/html", tier=1, kind="html_json_ld",
        f_category=F.lit("business_description"), f_field=F.lit("description"), e_script_index=F.lit(1), e_pointer=F.when(fault == 7, "/name").otherwise("/description"), e_identity_source_id=F.concat(F.lit("r"), c("c_custkey").cast("string")),
        **{f"{t}_content_type": F.when(fault == 2, "text/html; charset=latin1").otherwise("text/html; charset=UTF-8") for t in "sc"}, **{f"{t}_url": F.concat(F.when(fault == 4, F.lit("https://other.no")).otherwise(site), F.lit("/about")) for t in "sc"},
    )
