import random
import re

import xxhash
from pyspark.sql import functions as F

from attesta.llm import simhash as S
from attesta.llm.components import components

SCHEMA = "doc_id long, text string, fp int, row string, copies int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fp(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(fps, radius=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def documents():
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(40)] + ["É", "ß", "\x1cq"]
    out = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 40, 300]))]
        out.append((i, " ".join(words)))
        for k in range(rng.choice([0, 0, 3])):
            other = list(words)
            if other and k:
                other[rng.randrange(len(other))] = rng.choice(vocab)
            out.append((1000 + 10 * i + k, "\n".join(other).upper()))
    return out + [(5000, None), (None, out[0][1]), (None, "unlike anything else here at all"), (0, out[0][1]), (0, out[0][1]), (7000, "long text " * 9000)]


def expect(docs):
    fps = [(i, brute_fp(t)) for i, t in docs]
    roots = roots_of({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return [(i, f"{f:016x}", least.get(roots[f])) for i, f in fps], roots


def test_documents_equal_brute_force(spark):
    docs = documents()
    want, roots = expect(docs)
    frame = spark.createDataFrame([(*d, 1, "x", 1) for d in docs], SCHEMA)
    assert sorted(map(tuple, S.near_duplicates(frame).collect()), key=str) == sorted(want, key=str)
    kept = S.one_of_each(frame)
    assert kept.columns == frame.columns
    rows = kept.collect()
    assert sorted(roots[brute_fp(r.text)] for r in rows) == sorted(set(roots.values()))
    component = {f: c for _, f, c in want}
    assert all(r.doc_id == component[f"{brute_fp(r.text):016x}"] for r in rows)


def clustered(seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
            if rng.random() < 0.3:  # chains
                base = x
    fps |= {rng.getrandbits(64) for _ in range(50)} | {0, (1 << 64) - 1, 1 << 63, 1}
    return [(S._signed(f), rng.choice([1, 1, 5])) for f in fps]


def test_components_of_links_are_exact(spark):
    for seed in range(3):
        fps = clustered(seed)
        frame = spark.createDataFrame(fps, "fp long, copies long")
        made = S.links(frame)
        got = {r.node: r.root for r in components(made).collect()}
        want = roots_of({f for f, _ in fps})
        assert {f: got.get(f, f) for f, _ in fps} == want


def test_first_variant(spark):
    rng = random.Random(9)
    diffs = []
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x |= 1 << b
        diffs.append((S._signed(x),))
    for d, first in spark.createDataFrame(diffs, "d long").select("d", S.first_variant(F.col("d"))).collect():
        shared = []
        for low, high in S.SEGMENTS:
            part = d & ((1 << high) - (1 << low))
            shared += [b for b in range(low, high) if part & ~(1 << b) == 0]
        assert first == min(shared)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(frame).collect() == [] and S.one_of_each(frame).collect() == []
