import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from attesta.llm import anchors, substring_dedup
from attesta.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, row int, part string, n int"


def brute(docs, width):
    raws = [(t or "").encode() for _, t in docs]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for (key, _), r in zip(docs, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def documents(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["th", "er ", "on", "é", "an ", "ñ", "\n", "漢"]) for _ in range(n))
    passages = [say(rng.randint(60, 400)) for _ in range(8)]
    docs = []
    for i in range(70):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randint(80, 400)] + say(rng.randint(0, 20))
        docs.append((i, text))
    base = say(700)
    for k in range(25):  # near copies
        at = rng.randrange(len(base))
        docs.append((100 + k, base[:at] + "#" + base[at + 1 :]))
    docs += [(200, base), (201, base), (201, base), (None, base), (None, None), (300, ""), (301, "x"), (302, "ab" * 400), (303, "c" * 250)]
    return docs + [(304, "c" * 199), (305, say(9000)), (306, passages[0][:205]), (307, "\0" * 220 + passages[1])]


@pytest.mark.parametrize("width,seed,part,run,kinds,block", [(200, 0, 40_000, 20_000, 5_000, 1 << 20), (200, 1, 20, 15, 4, 300), (200, 5, 20, 15, 1, 64), (37, 2, 50, 40, 10, 50), (12, 3, 50, 40, 5_000, 999)])
def test_equals_brute_force(spark, monkeypatch, width, seed, part, run, kinds, block):
    monkeypatch.setattr(S, "MOST_KINDS", kinds)
    monkeypatch.setattr(anchors, "BLOCK", block)
    monkeypatch.setattr(S, "PART", part)
    monkeypatch.setattr(S, "RUN", run)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 3 if seed % 2 else 5_000)
    docs = documents(seed)
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    want = brute(docs, width)
    got = S.digests(frame, width=width).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(w[3] > 1 for w in want)


def test_kept_bytes(spark):
    docs = documents(4)
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    got = [(r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in S.kept_bytes(frame).collect()]
    assert sorted(got, key=str) == sorted(((w[0], w[4]) for w in brute(docs, 200)), key=str)


def test_merge_orders_and_shares():
    rng = random.Random(6)
    for count in (1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(count)]
        coded = [S.front_code(r) if r else (b"", b"", b"") for r in runs]
        order, lcp = S.merge([S.decoded(*c) for c in coded])
        at = [iter(r) for r in runs]
        merged = [next(at[i]) for i in order.tolist()]
        assert merged == sorted(x for r in runs for x in r)
        for a, b, k in zip(merged, merged[1:], lcp.tolist()[1:]):
            assert a[:k] == b[:k] and a[: k + 1] != b[: k + 1] or a == b and k == len(a)


def test_long_texts_take_bounded_memory():
    """Blocks give the partition that the whole sequence has, with little beside it."""
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 6, 5_000_000).astype(np.uint8)
    tracemalloc.start()
    got = anchors.stretches(symbols, 200, 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and got[2].sum() == len(symbols) - 199
    want = anchors._of_block(symbols, 200, 16)
    assert all((a == b).all() for a, b in zip(got, want))
    with pytest.raises(ValueError):
        anchors.stretches(symbols, 400, 16)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert S.digests(frame).collect() == [] and S.kept_bytes(frame).collect() == []
