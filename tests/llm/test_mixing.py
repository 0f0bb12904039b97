import random
from collections import defaultdict

import pytest

from attesta.llm import mixing as M
from attesta.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, source string, size int, target string, weight double, rank int"


def words(n):
    return " ".join(["w"] * n)


def table(seed, sources=7, docs=60, heavy=True):
    dice = random.Random(seed)
    rows = []
    for s in range(sources):
        name = None if s == 3 else f"src{s:02}"
        for k in range(docs if s else 5 * docs):
            n = dice.choice([0, 1, 5, 20, 200, dice.randint(1, 2000) if heavy else 50])
            rows.append((1000 * s + k, words(n) if n or k % 2 else None, name, 1, "x", dice.choice([0.5, 1.0, 4.0]), 1))
    return rows


def wanted(rows):
    """The contract's targets, excess shared again and again."""
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    goal = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    while any(goal[s] > 3 * sizes[s] + 1e-6 for s in names):
        excess = sum(max(0, goal[s] - 3 * sizes[s]) for s in names)
        goal = {s: min(goal[s], 3 * sizes[s]) for s in names}
        free = [s for s in names if goal[s] < 3 * sizes[s]]
        for s in free:
            goal[s] += excess * weight[s] / sum(weight[f] for f in free)
    return sizes, goal


@pytest.mark.parametrize("seed", [1, 2])
def test_query_meets_targets(spark, tmp_path, seed):
    rows = table(seed)
    rows += [(9000, words(5000), "tiny", 1, "x", 1.0, 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = QUERIES["op12_mixing"](spark, f"{tmp_path}/a").collect()
    again = QUERIES["op12_mixing"](spark, f"{tmp_path}/b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes, goal = wanted(rows)
    source = {r[0]: r[2] for r in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], len((r[1] or "").split())) for r in rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s], rel=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    more = {r.doc_id: r.taken for r in got}
    for s in sizes:
        # no document that could be drawn comes nearer than one of these
        drawable = [r.size for r in got if source[r.doc_id] == s and r.size and more[r.doc_id] < r.size * -(-goal[s] // sizes[s])]
        assert abs(taken[s] - goal[s]) <= max(0.01 * goal[s], min(drawable, default=0) / 2 + 1), (s, taken[s], goal[s])


def plain(rows, budget):
    """Taken in order of rank, one by one, up to the first that doesn't fit: rows (rank, key, size)."""
    taken, used = set(), 0
    for rank, key, size in sorted(rows):
        if used + size > budget:
            break
        used += size
        taken.add(key)
    return taken


def test_ends_equal_plain_order(spark):
    dice = random.Random(4)
    for grain in (2, 16, 4096):
        before, M.GRAIN = M.GRAIN, grain
        try:
            units, expected = [], {}
            for s in range(12):
                own = [(dice.choice([dice.random(), 0.5]), k, dice.randint(1, 50)) for k in range(dice.randint(1, 80))]
                budget = dice.randint(1, 1500)
                units += [(str(s), rank, k, 0, size, budget) for rank, k, size in own]
                expected[str(s)] = plain(own, budget)
            got = {r["source"]: tuple(r["over"])[:2] for r in M.ends(spark.createDataFrame(units, "source string, rank double, key long, row long, size long, budget long")).collect()}
            for s, taken in expected.items():
                assert {k for s_, rank, k, *_ in units if s_ == s and (s not in got or (rank, k) < got[s])} == taken
        finally:
            M.GRAIN = before


def test_inclusion_follows_odds(spark):
    """Of documents of one size, the part that is drawn follows its own weight, to within four standard errors."""
    rows = [(k, words(10), "a" if k % 2 else "b", 1, "x", 1.0 if k % 4 < 2 else 3.0, 1) for k in range(8000)]
    got = M.mixed(spark.createDataFrame(rows, SCHEMA), weight="weight").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source, 1.0 if r.doc_id % 4 < 2 else 3.0].append(r.copies)
    # weights 5 and 2: targets of 57,143 and 22,857 words of 40,000
    for (source, weight), copies in by.items():
        ratio = {"a": 10 / 7, "b": 4 / 7}[source] * weight / 2
        p = ratio % 1
        assert abs(sum(copies) / len(copies) - ratio) < 4 * (p * (1 - p) / len(copies)) ** 0.5 + 0.005
        assert set(copies) <= {int(ratio), int(ratio) + 1}


def test_repeated_rows_and_empty_tables(spark):
    same = [(1, words(3), "a", 1, "x", 1.0, 1)] * 50 + [(2, words(3), "b", 1, "x", 1.0, 1)] * 10 + [(None, None, None, 1, "x", None, 1), (None, words(4), None, 1, "x", None, 1)]
    got = M.mixed(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 62 and len({r.copies for r in got if r.doc_id == 1}) == 1
    assert len([r for r in got if r.doc_id is None]) == 2
    assert M.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    none = M.mixed(spark.createDataFrame([(1, "", "a", 1, "x", 1.0, 1), (2, None, None, 1, "x", 1.0, 1)], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in none] == [(0, 0.0, 0)] * 2


def test_places_follow_code_points(spark):
    names = [None, "b", "a", "ä", "Z", "\U0001f600", "￿", ""] + [f"n{k:03}" for k in range(300)]
    rows = M.numbered(spark.createDataFrame([(n,) for n in names], "source string").repartition(7)).collect()
    order = [r["source"] for r in sorted(rows, key=lambda r: r["place"])]
    assert order == sorted(names, key=lambda n: (n is None, (n or "").encode())) and sorted(r["place"] for r in rows) == list(range(len(names)))
