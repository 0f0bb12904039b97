import pytest
from pyspark.sql import functions as F

from attesta.functions import identifiers, json_tokens, names, numbers, text, web


def values(spark, rows, column, kind="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], kind).select(column).collect()]


def test_identifiers(spark):
    good = ["982463718", "971277025", "923609016", "960514718", "958973306", "982 463 718", "982-463-718", "982.463.718", " 982463718 ", "NO 982463718 MVA"]
    bad = {"917289121": "checksum", "911303793": "checksum", "12345678": "9 digits", "1234567890": "9 digits", "": "empty", None: "empty", "abcdefghi": "non-digit", "98246371a": "non-digit"}
    for r in values(spark, good, identifiers.validate_id(F.col("x"))):
        assert r.valid and len(r.value) == 9
    for (raw, part), r in zip(bad.items(), values(spark, list(bad), identifiers.validate_id(F.col("x")))):
        assert not r.valid and part in r.reason, raw
    said = "982463718 then 971 277 025, 982463718 and 123456789 or 9824637180"
    assert values(spark, [said], identifiers.ids_in_text(F.col("x"))) == [["982463718", "971277025"]]
    assert values(spark, [said], identifiers.ids_in_text(F.col("x"), F.lit("971277025"))) == [["982463718"]]


def test_names(spark):
    got = values(spark, ["Telenor ASA", "Å & B + C AS", "åas A S", None, "Stiftelse X"], names.normalize_name(F.col("x")))
    assert got == ["telenor", "å og b og c", "åas", "", "x"]
    pairs = spark.createDataFrame([("Telenor ASA", "telenor"), ("Telenor Norge", "Telenor"), ("a b c", "a d e"), ("", "x"), ("p q", "r s")], "a string, b string")
    assert [round(r[0], 4) for r in pairs.select(names.name_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.85, 0.3333, 0.0, 0.0]
    hosts = values(spark, ["https://User@WWW.Example.co.uk:8080/x", "example.com/path", "", None], names.host_of(F.col("x")))
    assert hosts == ["www.example.co.uk", "example.com", "", ""]
    assert values(spark, ["www.example.co.uk", "a.b.com", "com"], names.registrable_domain(F.col("x"), ["co.uk"])) == ["example.co.uk", "b.com", "com"]


def test_numbers(spark):
    lexemes = {"882017.0": "882017", "0.0": "0", "-12.5": "-12.5", "9007199254740993": "9007199254740993", "-0.0": "0", "1.5E3": "1500", "1" * 48: None, "x": None, "1e400": None, "1" * 36: "1" * 36}
    assert values(spark, list(lexemes), numbers.canonical_amount("x")) == list(lexemes.values())
    printed = {
        "1 234 567,89": "1234567.89", "1.234.567,89": "1234567.89", "1,234,567.89": "1234567.89", "(1 234)": "-1234", "−12,5": "-12.5", "1,234": None, "1.234": None, "12345": "12345", "1234.567": "1234.567",
        "1.234.567": "1234567", "1,23,4": None, "": None, "abc": None, "12 34": None, "5,": None, "+7": "7", "1 234 567": "1234567",
    }
    assert dict(zip(printed, values(spark, list(printed), numbers.parse_localised(F.col("x"))))) == printed
    hard = {"0,00": "0.00", "(1 234,50)": "-1234.50", "\u2212" + "1\u202f234,5": "-1234.5", "12,3456": "12.3456", "9" * 80: "9" * 80, "1 23 456": None, "1.234.56": None, "(-12)": None, "12,": None, "NOK 12": None, "NaN": None, "9" * 257: None, "1,234,567,89": None, "1.234,567": "1234.567", "1 234,567": "1234.567", "(0)": "-0"}
    assert dict(zip(hard, values(spark, list(hard), numbers.parse_localised(F.col("x"))))) == hard
    assert [values(spark, ["1,234", "1.234"], numbers.parse_localised(F.col("x"), m)) for m in ",."] == [["1.234", "1234"], ["1234", "1.234"]]
    cases = [("1234.5", "sum 1 234,50 NOK", True), ("1234.5", "sum 11 234,50", False), ("7", "in 7, yes", False), ("7", "17", False), ("999999999", "1999999999", False), ("0", "100 000", False), ("100", "(100)", False), ("-100", "(100)", True), ("123456789012345678901234567890", "it is 123456789012345678901234567890 now", True), ("1", None, False), (None, "1", False), ("00.50", "0,5", True)]
    quoted = spark.createDataFrame(cases, "v string, t string, want boolean")
    assert [r[0] for r in quoted.select(numbers.quoted_number(F.col("v"), F.col("t"))).collect()] == [c[2] for c in cases]


def test_figures(spark):
    said = {"Egenkapital 100 200": None, "Egenkapital 1\u00a0234": "1234", "  Sum eiendeler (1 234)  ": "-1234", "Omsetning: 12,5": "12.5", "Sum gjeld": None}
    rows = values(spark, list(said), text.figure_lines(F.col("x")))
    assert [r[0].value for r in rows] == list(said.values()) and values(spark, ["Omsetning 5" + " " * 10 + "x" * 300, "ingen 5"], text.figure_lines(F.col("x"))) == [[], []]


def test_web(spark):
    urls = {
        "https://x.no": ("HOME", 60), "https://x.no/jobb-i-x/": ("CAREERS", 75), "https://x.no/om-oss": ("ABOUT", 85), "https://x.no/produkter/a": ("PRODUCT", 80), "https://x.no/privacy": ("OTHER", 0),
        "https://x.no/a/b/jobs": ("OTHER", 20), "https://x.no/a.pdf": ("OTHER", 20), "https://x.no/a.css?x": ("OTHER", 0), "https://x.no/style.css": ("OTHER", 0), "https://x.no/no/kontakt": ("CONTACT", 75),
    }
    got = values(spark, list(urls), web.classify_url(F.col("x")))
    assert {u: (r.page_type, r.priority) for u, r in zip(urls, got)} == urls
    c = values(spark, ["mail a@b.no or c@d.com, tlf 22 33 44 55, Storgata 5", "none"], web.contacts(F.col("x")))
    assert c[0].emails[0] == "a@b.no" and c[0].phones and c[0].addresses == ["Storgata 5"] and c[1] is None
    assert [(r.name, r.role) for r in values(spark, ["Styreleder: Kari Nordmann\nCFO Ola Hansen."], web.role_names(F.col("x")))[0]] == [("Kari Nordmann", "styreleder"), ("Ola Hansen", "CFO")]
    assert values(spark, ["HTTPS://X.no/A#f", "x.no", "ftp://x", "u:p@x.no", None], web.website(F.col("x"))) == ["https://x.no/A", "https://x.no", None, None, None]
    flags = spark.createDataFrame([(None, True, None, None), (None, False, False, False), (None, False, None, False), ("2024", None, None, None), (None, None, True, None)], "d string, b boolean, l boolean, c boolean")
    assert [r[0] for r in flags.select(web.registry_status(*map(F.col, "dblc"))).collect()] == ["bankrupt", "active", "unknown", "deleted", "under_liquidation"]


def test_json_tokens(spark):
    bodies = ['{"a":{"b":[1.50,"x"]},"c/d~":true,"n":null}', '{"a":1,"a":2}', "[NaN]", "[1e999]", "[" * 70 + "]" * 70, '["\\ud800"]', "﻿[9007199254740993.01]", "", None]
    got = values(spark, bodies, json_tokens.json_tokens("x"))
    assert [tuple(t) for t in got[0]] == [("/a/b/0", "number", "1.50"), ("/a/b/1", "string", "x"), ("/c~1d~0", "boolean", "true"), ("/n", "null", None)]
    assert got[1:6] == [None] * 5 and got[6][0].value == "9007199254740993.01" and got[7:] == [None, None]
    assert json_tokens.canonical(json_tokens.strict_loads('{"b":1,"a":[1.0,false]}')) == '{"a":[1.0,false],"b":1}'
    with pytest.raises(ValueError):
        json_tokens.strict_loads("[1,]")
