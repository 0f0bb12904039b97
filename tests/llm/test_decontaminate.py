import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from attesta.llm import decontaminate as D

SCHEMA = "doc_id long, text string, n_words string, items int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for key, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            size = min(10, len(b))
            wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if size else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= {str(item)} if item is not None else set()
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def tables():
    rng = random.Random(2)
    vocab = ["alpha", "be", "Cé", "d1", "漢字", "x"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(11, 25))) for i in range(12)] + [(100, "one two THREE"), (101, ""), (102, None), (None, say(14)), (5, "again, five: four three two one zero now and then here"), (103, "alone")]
    docs = []
    for i in range(60):
        t = say(rng.randint(0, 80))
        if i % 3 == 0:
            t += "; " + (rng.choice(items)[1] or "").upper() + " -- " + say(5) if (items[i % 12][1]) else ""
        docs.append((i, t, "x", 1))
    long = say(5000) + " One, two\nthree " + items[0][1]
    return docs + [(None, None, None, None), (1007, "", "x", 1), (1008, long, "x", 1), (1008, long, "x", 1), (1009, "alone", "x", 1), (1010, "one two three", "x", 1)], items


def items_of(spark, items):
    return spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("most", [D.BLOCK_BYTES, 600])
def test_equals_brute_force(spark, most):
    docs, items = tables()
    items = [(a, b) for a, b in items]
    got = D.digests(spark.createDataFrame(docs, SCHEMA), items_of(spark, items), most=most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_clean_documents_and_spans(spark):
    docs, items = tables()
    frame, bench = spark.createDataFrame(docs, SCHEMA), items_of(spark, items)
    bad = {r[0] for r in brute(docs, items) if r[5]}
    kept = D.clean_documents(frame, bench)
    assert kept.columns == frame.columns and not bad & {r.doc_id for r in kept.collect()}
    assert kept.count() == sum(not r[5] for r in brute(docs, items))
    cut = D.clean_spans(frame, bench)
    assert cut.count() == len(docs)
    for before, after in zip(sorted(brute(docs, items), key=str), sorted(((r.doc_id, len(words(r.text))) for r in cut.collect()), key=str)):
        assert after[0] == before[0]
    total = sum(len(words(r.text)) for r in cut.collect())
    assert total == sum(r[1] - r[2] for r in brute(docs, items))


def test_empty_tables(spark):
    docs, items = tables()
    frame, bench = spark.createDataFrame(docs, SCHEMA), items_of(spark, items)
    assert D.digests(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.digests(frame, bench.limit(0)).collect())


def test_a_block_fits_a_worker():
    """Measured: what a full block takes for each byte of its items' text."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    items, size = [], 0
    while size < D.BLOCK_BYTES // 4:
        items.append((str(len(items)), " ".join(rng.choices(vocab, k=60))))
        size += len(items[-1][1])
    tracemalloc.start()
    windows = D.Windows(items, 10)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 25 * size and held < 6 * size + (8 << 20)
    text = items[7][1].lower()
    assert [h for h in windows.hits(D.words_of(text)) if windows.items_of({h[2]}) == {"7"}] and len(list(windows.hits(D.words_of(text)))) == 51


def test_a_window_of_many_items_is_verified_once(spark):
    stem = "which of the following statements about this passage is most likely true"
    items = [(i, f"{stem} number{i} is it so") for i in range(4000)] + [(4000, f"{stem} {stem}"), (None, stem)]
    windows = D.Windows([(None if i is None else str(i), t) for i, t in items], 10)
    docs = [(1, f"{stem} {stem} and {stem}", "x", 1), (2, f"{stem} number7 is", "x", 1), (3, "nothing of it", "x", 1)]
    hits = list(windows.hits(D.words_of(docs[0][1])))
    assert len({h[2] for h in hits}) <= 5 and len(windows.shared) <= 5
    got = D.digests(spark.createDataFrame(docs, SCHEMA), items_of(spark, items))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(D.Windows, "_rolled", lambda self, hashes, size: (hashes[: max(0, len(hashes) - size + 1)] % np.uint64(3)) << np.uint64(60))
    windows = D.Windows([(None if i is None else str(i), t) for i, t in items], 10)
    for key, text, *_ in docs:
        said, found, hit = D.words_of(text), set(), set()
        for i, size, bearers in windows.hits(said):
            found |= windows.items_of({bearers})
            hit |= set(range(i, i + size))
        row = next(r for r in brute([(key, text)], items))
        assert (len(hit), len(found)) == row[2:4]


def test_a_text_of_megabytes(spark):
    docs, items = tables()
    text = "filler words of no item " * 400_000 + items[0][1]
    row = D.digests(spark.createDataFrame([(1, text, "x", 1)], SCHEMA), items_of(spark, items)).first()
    n = len(items[0][1].split())
    assert (row.n_words, row.n_hit >= n, row.contaminated) == (2_000_000 + len(words(items[0][1])), True, True)
