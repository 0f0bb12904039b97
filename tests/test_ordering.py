"""Places, line numbers, digests, exact ranks, the as-of sweep and the walk against plain ones."""

import hashlib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.operators import frontier, history, metrics, ordering, selection


def plain_digest(lines, fan):
    level = [hashlib.sha256((x or "").encode()).hexdigest() for x in lines]
    while True:
        level = [hashlib.sha256("\n".join(f"{p}:{h}" for p, h in enumerate(level[k : k + fan], k)).encode()).hexdigest() for k in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n", [1, 3, 4, 17, 65])
def test_digest_is_of_the_order(spark, monkeypatch, n):
    monkeypatch.setattr(ordering, "FAN", 4)
    lines = [None if k % 7 == 3 else f"l{k % 5}" for k in range(n)]
    of = lambda lines, parts: ordering.merkle(spark.createDataFrame(list(enumerate(lines)), "p long, v string").repartition(parts), "p", F.col("v")).collect()
    [one], [other] = of(lines, 1), of(lines, 5)
    assert one == other and tuple(one) == (n, plain_digest(lines, 4))
    if n > 3:
        assert of([lines[1], lines[0], *lines[2:]], 2)[0].digest != one.digest
    assert ordering.merkle(spark.createDataFrame([], "p long, v string"), "p", F.col("v")).collect() == []


@pytest.mark.parametrize("n", [1, 3, 17, 65])
def test_digest_of_two_levels(spark, monkeypatch, n):
    """A fixed height: below FAN lines and beyond FAN**2 the root is over the digests of all leaves."""
    monkeypatch.setattr(ordering, "FAN", 4)
    lines = [f"l{k % 5}" for k in range(n)]
    rows = spark.createDataFrame(list(enumerate(lines)), "p long, v string").repartition(3)
    node = lambda hashes, at=0: hashlib.sha256("\n".join(f"{p}:{h}" for p, h in enumerate(hashes, at)).encode()).hexdigest()
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    want = node([node(hashes[k : k + 4], k) for k in range(0, n, 4)])
    assert [tuple(r) for r in ordering.merkle(rows, "p", F.col("v"), levels=2).collect()] == [(n, want)]


def test_places(spark):
    rows = [(random.Random(k).randint(0, 50), k) for k in range(400)] + [(None, 7)]
    got = ordering.placed(spark.createDataFrame(rows, "a int, b int").repartition(6), ["a", "b"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == order and sorted(r.place for r in got) == list(range(401))


def test_line_numbers_of_files_in_parts(spark, tmp_path):
    texts = {"a.txt": [f"line {k} " + "x" * (k % 90) for k in range(900)], "b.txt": ["one"], "c.txt": ["", "a\rb", ""] * 50}
    for name, lines in texts.items():
        (tmp_path / name).write_bytes(("\n".join(lines) + "\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = ordering.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in rows.collect())
        digests = {r.file.rsplit("/", 1)[1]: (r.lines, r.digest) for r in ordering.digest_of_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((name, k, line) for name, lines in texts.items() for k, line in enumerate(lines, 1))
    assert digests == {name: (len(lines), plain_digest(lines, ordering.FAN)) for name, lines in texts.items()}


def test_exact_ranks(spark):
    dice = random.Random(2)
    groups = {"even": [dice.random() for _ in range(3000)], "tied": [dice.choice([1.0, 1.0, 1.0, 2.0, 3.0]) for _ in range(3000)], "same": [5.0] * 500, "one": [7.0], None: [dice.expovariate(1) for _ in range(2000)], "skewed": [0.0] * 2500 + [dice.random() for _ in range(500)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("even", -1.0), ("even", float("nan")), ("even", float("inf")), ("even", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(5)
    quantiles = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    expected = {g: tuple(sorted(v)[max(1, math.ceil(len(v) * q)) - 1] for q in quantiles.values()) for g, v in groups.items()}
    for few in (1, 50, 20_000):
        assert {r.g: tuple(r)[1:] for r in selection.nearest_ranks(frame, ["g"], "v", quantiles, few).collect()} == expected
    whole = sorted(v for values in groups.values() for v in values)
    assert tuple(selection.nearest_ranks(frame, [], "v", {"p50": 0.5}, 10).first()) == (whole[math.ceil(len(whole) / 2) - 1],)
    assert metrics.nearest_rank(frame.limit(0), ["g"], "v", p50=0.5).collect() == []


def plain_as_of(runs):
    out = {}
    for key, run, start, completed, seq, cutoff in runs:
        if start is None:
            continue
        fits = [(s, -1 if q is None else q, r) for k, r, s, c, q, _ in runs if k == key and r != run and s is not None and s <= start and (c is not None and c < start if q is None else cutoff is not None and q < cutoff)]
        if fits:
            out[run] = max(fits)[2]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_as_of_sweep(spark, seed):
    dice = random.Random(seed)
    maybe = lambda x: None if dice.random() < 0.25 else x
    runs = [(dice.randint(0, 3), f"r{n:03}", maybe(dice.randint(0, 25)) if n % 9 == 0 else dice.randint(0, 25), maybe(dice.randint(0, 40)), maybe(dice.randint(0, 60)), maybe(dice.randint(0, 70))) for n in range(250)]
    frame = spark.createDataFrame(runs, "k int, run_id string, started_at int, completed_at int, sequence int, cutoff int")
    assert {r.run_id: r.prev_run for r in history.previous_as_of(frame, "k").collect()} == plain_as_of(runs)


def test_as_of_sweep_of_a_long_key():
    """A hundred thousand runs, none of which has a predecessor but by the last few: no walk back over all of them."""
    n = 100_000
    began = time.time()
    assert len(list(history._predecessors(iter([("k", t // 3, t, None, n - t, 1) for t in range(n)])))) == 0
    assert len(list(history._predecessors(iter([("k", t, t, t + 1, None, None) for t in range(n)])))) == n - 2
    assert time.time() - began < 20


def test_walk(spark):
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    pages = [("https://a.no", link("/x", "/about", "/login", "/gone", "https://b.no/about", "/x")), ("https://a.no/x", link("/x/deep", "/styret")), ("https://a.no/about", None), ("https://a.no/x/deep", ""), ("https://a.no/styret", link("/")), ("https://a.no/login", ""), (None, "x"), ("https://b.no/about", "")]
    pages += [("https://c.no", link(*(f"/p{k}" for k in range(30))))] + [(f"https://c.no/p{k}", link("/styret")) for k in range(30)]
    homes = [(1, "https://a.no"), (3, "https://c.no"), (4, "https://not.no")]
    got = frontier.walk(spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame(homes, "site int, url string"), "site").collect()
    assert [r.url for r in sorted((r for r in got if r.site == 1), key=lambda r: r.position)] == ["https://a.no", "https://a.no/about", "https://a.no/x", "https://a.no/styret", "https://a.no/x/deep"]
    assert [(r.position, r.url[-2:], r.level) for r in sorted((r for r in got if r.site == 3), key=lambda r: r.position)] == [(0, "no", 0), *((k + 1, f"p{k}", 1) for k in range(8))] and not [r for r in got if r.site == 4]
