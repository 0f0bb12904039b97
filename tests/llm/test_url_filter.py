import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import url_filter as U
from attesta.llm.queries import RULES

SCHEMA = "page_id long, url string, host string, verdict int"


def brute(rows):
    out = []
    for key, url, *_ in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER)), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        out.append([key, host, path, best and best.name, best and best.verdict])
    bad = {r[1] for r in out if r[4] == "block"}
    return [(k, h, p, r, v or ("block" if h in bad else "allow")) for k, h, p, r, v in out]


def rows():
    rng = random.Random(5)
    hosts = ["a.example.org", "example.org", "org", "b.com", "X.COM", "c.net", "", "éÉ.com"] + [f"h{i}.com" for i in range(400)]
    out = [(i, f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/fr/1', '/de/2?x=/es/', '/es/3', '/en/12#a', '/DE/', '/en'])}", "x", 1) for i in range(1500)]
    return out + [(1, None, "x", 1), (None, "no scheme", None, None), (3, "a://b://c/de/", "x", 1), (4, "x\ny://a.com/de/\n", "x", 1), (5, "", "x", 1), out[0], out[0]]


@pytest.mark.parametrize("most", [U.MOST_BYTES, 0])
def test_equals_brute_force(spark, most):
    data = rows()
    got = U.url_filter(spark.createDataFrame(data, SCHEMA), RULES, most_bytes=most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(data), key=str)


@pytest.mark.parametrize("most,send", [(U.MOST_BYTES, U.BROADCAST_BYTES), (0, U.BROADCAST_BYTES), (0, 0), (2_000, 0)])
def test_cascade_is_exact_for_all_keys(spark, monkeypatch, most, send):
    """As literals, as sharded tables that are sent or joined, and as some of each."""
    monkeypatch.setattr(U, "BROADCAST_BYTES", send)
    hosts = spark.range(30_000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), (F.col("id") % 3 == 0).alias("listed"))
    levels = U.cascade(hosts, most)
    assert len(levels) > 1 and (most or levels[0].shards == 3)
    assert U.with_listed(hosts, levels, "found").filter("found <> listed").count() == 0


def test_empty_table_and_plan(spark):
    assert U.url_filter(spark.createDataFrame([], SCHEMA), RULES).collect() == []
    plan = U.url_filter(spark.createDataFrame(rows(), SCHEMA), RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
