import random

from attesta.llm import license_scan as L

SCHEMA = "doc_id long, text string, n_words string, matches int"


def test_increasing_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        pairs = list(enumerate(rng.sample(range(30), rng.randint(0, 12))))
        best = [1] * len(pairs)
        for i in range(len(pairs)):
            best[i] += max([best[j] for j in range(i) if pairs[j][1] < pairs[i][1]], default=0)
        got = L.increasing(pairs)
        assert len(got) == max(best, default=0) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:]))


def test_alignment_pairs_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = L.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    words = "one two three four five six".split()
    assert len(L.align(words, words)) == 6
    assert L.align("x one y two two z three".split(), words) == [(1, 0), (3, 1), (6, 2)] or len(L.align("x one y two two z three".split(), words)) >= 2


def test_finds_planted_and_changed_notices(spark):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("aeiodlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))
    docs = []
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            docs.append((len(docs), f"{say(60)}\n{t}\n{say(40)}", name))
            docs.append((len(docs), f"{say(20)} the license {t.upper()} under the {say(40)} {t}", name))
            words = t.split()
            if len(words) > 12:
                words[3] = "changed"
                docs.append((len(docs), f"{say(500)} {' '.join(words)}", name))
    clean = [(1000 + i, say(200) + " the license is under a tree", "") for i in range(20)]
    rows = [(i, t, "x", 1) for i, t, _ in docs + clean] + [(None, None, None, None), (5000, "", "x", 1), (5001, say(30_000), "x", 1)]
    got = {r.doc_id: r for r in L.summary(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, name in docs:
        assert name in got[i].licenses.split(","), (t, got[i])
        assert got[i].best_coverage >= 0.8 and got[i].covered_words > 0
    for i in [c[0] for c in clean] + [None, 5000, 5001]:
        assert got[i].n_matches == 0 and got[i].licenses == "" and got[i].best_coverage is None
    twice = L.Scanner().scan("Released under the MIT License. " * 3)
    assert [m[0] for m in twice] == ["MIT"] * 3


def plain_align(text, template):
    """Patience alignment by its definition, recursively."""
    head = 0
    while head < min(len(text), len(template)) and text[head] == template[head]:
        head += 1
    tail = 0
    while tail < min(len(text), len(template)) - head and text[-1 - tail] == template[-1 - tail]:
        tail += 1
    inner_a, inner_b = text[head : len(text) - tail], template[head : len(template) - tail]
    once = [(i, inner_b.index(w)) for i, w in enumerate(inner_a) if inner_a.count(w) == 1 and inner_b.count(w) == 1]
    chain = L.increasing(once)
    pairs, a, b = [], 0, 0
    for i, j in [*chain, (len(inner_a), len(inner_b))] if chain else []:
        pairs += [(x + a, y + b) for x, y in plain_align(inner_a[a:i], inner_b[b:j])] + ([(i, j)] if i < len(inner_a) else [])
        a, b = i + 1, j + 1
    ends = [(i, i) for i in range(head)] + [(len(text) - k, len(template) - k) for k in range(1, tail + 1)]
    return sorted(ends + [(x + head, y + head) for x, y in pairs])


def test_coverage_equals_plain_alignment():
    rng = random.Random(12)
    for _ in range(400):
        a, b = ([rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert L.align(a, b) == plain_align(a, b)
    for texts in L.TEMPLATES.values():
        words = L.words_of(texts[-1])
        other = [w for w in words if rng.random() > 0.1]
        assert L.align(other, words) == plain_align(other, words)


def test_precision_and_recall_on_edited_notices():
    """Every template planted in prose with a word in thirty dropped or changed, names kept; and prose of the templates' own words as negatives."""
    rng = random.Random(13)
    scanner, found, planted, right = L.Scanner(), 0, 0, 0
    names = {w for said in L.NAMES.values() for n in said for w in n.split()} | {"2", "0", "4", "1", "3"}
    vocabulary = sorted({w for ts in L.TEMPLATES.values() for t in ts for w in L.words_of(t)})
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            for _ in range(8):
                words = [w if w in names or rng.random() > 1 / 30 else rng.choice(["", "edited"]) for w in L.words_of(text)]
                said = " ".join([*rng.choices(vocabulary, k=40), "so", *words, "end", *rng.choices(vocabulary, k=40)])
                got = {m[0] for m in scanner.scan(said)}
                planted, right, found = planted + 1, right + (name in got), found + len(got)
    clean = sum(len(scanner.scan(" ".join(rng.choices(vocabulary, k=400)))) for _ in range(200))
    assert right >= 0.97 * planted and right >= 0.97 * (found + clean)


def test_empty_table(spark):
    assert L.summary(spark.createDataFrame([], SCHEMA)).collect() == []
