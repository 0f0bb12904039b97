import random
import re

from pyspark.sql import functions as F

from attesta.llm import quality as Q

SCHEMA = "doc_id long, text string, n_words int, kept string, stats int"


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    rep = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(re.search("[^\x20\x09-\x0d]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def texts():
    rng = random.Random(3)
    vocab = ["a", "b", "cd", "é#", "\x1cx", "ß*", "\xa0"]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return out + [None, "", " \t\n\x0b\x0c\r ", "a\n\nb\na\n \n \nb", "x " * 30, "a\r\na\r\nb", "long " * 4000, "#*$%&|<>", "a b c d e a b c d e f"]


def test_counts_equal_brute_force():
    for t in texts():
        if t is None or len(t) < 5000:
            assert Q.measure(t)[:5] == brute(t), t


def labelled(n=900):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(30, 90))]
        if bad:
            words = [w + rng.choice(["***", "%%%"]) for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), 1, "x", 2))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_learns_and_keeps_held_out_good_documents(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = Q.fit(docs, marks.filter("doc_id % 3 > 0"))
    assert rules
    kept = {r.doc_id: r.kept for r in Q.judged(docs, rules).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    assert sum(kept[i] == bool(q) for i, q, _ in held) >= 0.97 * len(held)
    stay = Q.filtered(docs, rules)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {i for i, k in kept.items() if k}


def test_edge_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in enumerate(texts())] + [(None, None, None, None, None), (0, "x", 1, "x", 2), (0, "x", 1, "x", 2)], SCHEMA)
    none = spark.createDataFrame([(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert Q.fit(docs, none) == [] and Q.fit(docs, none.limit(0)) == []
    got = Q.judged(docs, []).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept == (not r.base_failed)
    assert Q.judged(docs.limit(0), []).collect() == []
    assert docs.limit(0).transform(lambda d: Q.filtered(d, [[("words", "<=", 3.0)]])).count() == 0


def test_expression_is_ordered(spark):
    one = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    rows = Q.with_stats(one, "s")
    assert rows.select(Q.expression([[("words", ">", 5.0), ("upper_share", "<=", 0.1)]], "s").alias("k")).first().k is False
    assert rows.select(Q.expression([[("words", ">", 50.0)]], "s").alias("k")).first().k is True
    assert rows.filter(F.col("s.n_words") == 27).count() == 1
