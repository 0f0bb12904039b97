import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import periodic_runs as P
from attesta.llm.queries import QUERIES


def brute(words, least=6, exponent=4):
    """Every maximal stretch of each period, shorter periods first."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            primitive = not any(q % d == 0 and words[start : start + q] == words[start : start + d] * (q // d) for d in range(1, q))
            if primitive and length >= max(least, exponent * q):
                out.add((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    return [[tuple(int(x) for x in r) for r in runs] for runs in P.runs_of([[w.encode() for w in t] for t in texts])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=4))
def test_equals_brute_force(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_planted_periods():
    dice = random.Random(3)
    texts = []
    for _ in range(60):
        root = [dice.choice("abcd") for _ in range(dice.randint(1, 12))]
        texts.append([dice.choice("abcd") for _ in range(dice.randint(0, 20))] + (root * 9)[: dice.randint(1, 9 * len(root))] + root[:3])
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "a", "b"] * 30]
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=20, max_size=120), st.integers(0, 2))
def test_swapped_parts_equal_brute_force(text, much):
    before = P.MUCH
    P.MUCH = much
    try:
        assert found([text, text[::2]]) == [brute(text), brute(text[::2])]
    finally:
        P.MUCH = before


def test_smaller_half_moves_few_positions(monkeypatch):
    """A text of one word and one of a long period: moves grow as n log n, not with the square."""
    moved = []
    link = P._Classes._link
    monkeypatch.setattr(P._Classes, "_link", lambda self, at, names, length: (moved.append(len(at)), link(self, at, names, length))[1])
    for n in (4_000, 32_000):
        for words in ([b"a"] * n, [str(i % (n // 5)).encode() for i in range(n)]):
            moved.clear()
            assert len(P.runs_of([words])[0]) == 1
            assert sum(moved) <= 4 * n


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs))


def test_rows(spark):
    rows = [(1, "a b " * 5 + "c", 0, "x"), (1, "a b " * 5 + "c", 0, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, " z\t" * 7, 1, None), (4, "only once", 1, "x"), (5, "w\n" * 200_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string")
    got = P.periodic_runs(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == sorted([
        (1, 11, ((0, 10, 2),), "a b c"), (1, 11, ((0, 10, 2),), "a b c"), (2, 0, (), ""), (3, 0, (), ""), (0, 7, ((0, 7, 1),), "z"), (4, 2, (), "only once"), (5, 200_000, ((0, 200_000, 1),), "w"),
    ])
    assert P.digests(P.periodic_runs(docs.limit(0))).collect() == []


@pytest.mark.parametrize("id_", [None, 7, 11, 20, 23, 37, 40, 55])
def test_query_equals_brute_force(spark, tmp_path, id_):
    dice = random.Random(id_)
    texts = [" ".join(dice.choice(["og", "å b", "the", "c"]) for _ in range(dice.randint(0, 60))) for _ in range(12)] + [None, "", " a  a\n" * 9]
    ids = [None if id_ is None else id_ * 100 + k for k in range(len(texts))]
    spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha, expected = lambda s: hashlib.sha256(s.encode()).hexdigest(), []
    for doc, text in zip(ids, texts):
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        shown = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        expected.append((doc, len(runs), *shown, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(collapsed(words, runs))))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_kept():
    assert P.kept(10, np.array([[0, 6, 1], [4, 6, 1]])).tolist() == [True] + [False] * 3 + [False] * 6
