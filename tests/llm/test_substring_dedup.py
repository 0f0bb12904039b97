import hashlib
import random
import re

import pytest

from attesta.llm import anchors
from attesta.llm import substring_dedup as S
from attesta.llm.common import LONG_MAX

SCHEMA = "doc_id long, text string, row int, doc string, core int"


def brute(docs, width):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, split):
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            least[k] = min(least.get(k, LONG_MAX), LONG_MAX if i is None else i)
    out = []
    for (i, _), w in zip(docs, split):
        gone = set()
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < (LONG_MAX if i is None else i):
                gone |= set(range(s, s + width))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def documents(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["é", "ß\x1c", "\xa0"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [say(rng.randint(40, 160)) for _ in range(6)]
    docs = []
    for i in range(80):
        words = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(30, 160)] + say(rng.randint(0, 9))
        docs.append((rng.randrange(10_000), rng.choice([" ", "\n", " \t"]).join(words)))
    base = say(400)
    for k in range(12):  # near copies
        other = list(base)
        other[rng.randrange(400)] = "edit"
        docs.append((20_000 + k, " ".join(other)))
    docs += [(30_000, " ".join(base))] * 3 + [(i, " ".join(base)) for i in (5, 30_001, 30_002)]
    return docs + [(None, " ".join(base)), (None, None), (1, ""), (2, "same " * 300), (3, "same " * 200), (4, " ".join(say(6000)))]


@pytest.mark.parametrize("width,seed,kinds,block", [(50, 0, 500, 1 << 20), (50, 1, 3, 64), (50, 4, 1, 100), (7, 2, 500, 20)])
def test_equals_brute_force(spark, monkeypatch, width, seed, kinds, block):
    monkeypatch.setattr(S, "MOST_KINDS", kinds)
    monkeypatch.setattr(anchors, "BLOCK", block)
    monkeypatch.setattr(S, "HOT_LEAST", 3 if seed % 2 else 5_000)
    docs = documents(seed)
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    want = brute(docs, width)
    got = S.digests(frame, width=width).collect()
    assert sorted(map(tuple, got), key=str) == sorted((w[:4] for w in want), key=str)
    assert any(w[2] for w in want)


def test_one_phrase_in_all_documents(spark, monkeypatch):
    """A phrase with other words around it everywhere: its core is cut up, nothing is lost."""
    monkeypatch.setattr(S, "MOST_KINDS", 20)
    monkeypatch.setattr(S, "BATCH", 10)
    rng = random.Random(9)
    phrase, passage = [f"p{i}" for i in range(30)], [f"q{i}" for i in range(30)]
    say = lambda n: [f"v{rng.randrange(50)}" for _ in range(n)]
    docs = [(i, " ".join(say(40) + phrase + (passage if i % 10 == 0 else say(30)) + say(20))) for i in range(150)]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    want = brute(docs, 50)
    assert sorted(map(tuple, S.digests(frame).collect())) == sorted(w[:4] for w in want) and sum(w[2] > 0 for w in want) == 14


def test_cut_texts(spark):
    docs = documents(3)
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    cut = S.removed(frame)
    assert cut.columns == frame.columns
    got = sorted((str(r.doc_id), " ".join((r.text or "").encode().split() and re.findall("[^\x20\x09-\x0d]+", r.text))) for r in cut.collect())
    assert got == sorted((str(w[0]), " ".join(w[4])) for w in brute(docs, 50))


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert S.digests(frame).collect() == [] and S.removed(frame).collect() == []
