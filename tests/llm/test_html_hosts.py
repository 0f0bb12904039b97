import random
import time

import pytest

from attesta.llm import html_extract as H
from attesta.llm import tree_match
from attesta.llm.dom import blocks, parse

SCHEMA = "page_id long, url string, html string"


def page(s):
    return f"<!DOCTYPE html><html><body>{s}</body></html>"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def tree(rng, n):
    kids = "".join(f"<{(t := rng.choice(['p', 'div', 'h2']))}>{rng.choice('abc')}{'<p>x</p><div>y</div>' * rng.randint(0, 2) if t == 'div' else ''}</{t}>" for _ in range(n))
    return H.Page.of(blocks(parse(f"<div>{kids}</div>"))).tree


def best(x, y, i=0, j=0):
    """The highest score of a matching, by plain recursion."""
    if x.name[i] != y.name[j]:
        return 0
    a, b = x.kids[i], y.kids[j]
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for m, p in enumerate(a, 1):
        for n, q in enumerate(b, 1):
            grid[m][n] = max(grid[m - 1][n], grid[m][n - 1], (w := best(x, y, p, q)) and grid[m - 1][n - 1] + w)
    return 2 + (x.text[i] == y.text[j]) + grid[-1][-1]


def test_matching_is_the_best_one_and_alike_for_long_lists(monkeypatch):
    rng = random.Random(5)
    for _ in range(80):
        x, y = tree(rng, rng.randint(1, 25)), tree(rng, rng.randint(1, 25))
        partner = tree_match.align(x, y)
        assert sum(2 + (x.text[i] == y.text[j]) for i, j in enumerate(partner) if j >= 0) == best(x, y)
        for i, j in enumerate(partner):
            assert j < 0 or x.name[i] == y.name[j] and (i == 0 or partner[x.up[i]] == y.up[j])
        with monkeypatch.context() as m:
            m.setattr(tree_match, "MOST_PAIRS", 0)
            assert tree_match.align(x, y) == partner


def listing(rows, first, shared=()):
    """A table of rows of two cells, whose texts are numbered from ``first`` or, every other row's, of ``shared``."""
    up, name, text = [0, 0], [0, 1], [0, 0]
    for r in range(rows):
        row = len(up)
        up, name = [*up, 1, row, row], [*name, 2, 3, 3]
        text += [0, first + r, shared[r // 2 % len(shared)] if shared and r % 2 else first + rows + r]
    return tree_match.Tree(up, name, text)


def test_kinds_give_what_plain_recursion_gives():
    rng = random.Random(7)
    for _ in range(40):
        shared = rng.sample(range(1, 9), rng.randint(0, 4))
        x, y = listing(rng.randint(1, 12), 100, shared), listing(rng.randint(1, 12), rng.choice([100, 106, 200]), shared[::-1])
        partner = tree_match.align(x, y)
        assert sum(2 + (x.text[i] == y.text[j]) for i, j in enumerate(partner) if j >= 0) == best(x, y)


def test_listings_of_thousands_of_rows():
    """Rows that differ in their own texts are of few kinds: two long lists take seconds, not minutes."""
    for shared in ((), range(1, 30)):
        x, y = listing(3000, 10_000, shared), listing(2900, 90_000, shared)
        start = time.perf_counter()
        partner = tree_match.align(x, y)
        assert sum(j >= 0 for j in partner) == len(y.up)
        assert time.perf_counter() - start < 10


def test_deep_markup(spark):
    rows = [(i, "http://deep.com/", "<div>" * n + f"text {i}" + "</div>" * n) for i, n in enumerate([1, 600, 3000, 20000])]
    assert texts(spark, rows) == {i: f"text {i}" for i in range(4)}


def test_induction_overrules_misleading_names(spark):
    """Text in a container named as a sidebar, constant chrome in one named as content."""
    rng = random.Random(10)
    rows, want = [], {}
    for i in range(14):
        paras = [words(rng, 25) for _ in range(rng.randint(2, 5))]
        rows.append((i, f"http://odd.com/{i}", page(f'<article><p>All of our offers</p></article><div class="content"><p>Call us</p></div><div class="sidebar widget">{"".join(f"<p>{p}</p>" for p in paras)}<p>Always this line</p></div>')))
        want[i] = " ".join(paras)
    assert texts(spark, rows) == want
    assert H.main_text(rows[0][2]) == "All of our offers"


def test_recall_and_precision_on_pages_without_article(spark):
    """Words of the text found, and found words that are the text's, over sites of different frames with varying adverts and menus."""
    rng = random.Random(11)
    rows, want = [], {}
    for site in range(8):
        box, name = rng.choice(["div", "section", "td"]), words(rng, 1)
        for i in range(15):
            key, paras = site * 100 + i, [words(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 7))]
            menu = "".join(f"<li>{words(rng, 1)}" for _ in range(rng.randint(3, 6)))
            inner = f"<h1>{words(rng, 4)}</h1>" + "".join(f"<p>{p}</p>" for p in paras)
            inner = f'<table><tr><td class="{name}">{inner}</td></tr></table>' if box == "td" else f'<{box} class="{name}">{inner}</{box}>'
            html = page(f'<div class="{name}t"><p>Welcome to site {site}</p></div><nav><ul>{menu}</ul></nav><div class="ad">{words(rng, 5)}</div>{inner}<div class="low"><p>All rights kept</p></div><footer>{words(rng, 3)}</footer>')
            rows.append((key, f"http://r{site}.com/{key}", html))
            want[key] = set(" ".join(paras).split())
    got = {k: set(t.split()) for k, t in texts(spark, rows).items()}
    hit = sum(len(got[k] & want[k]) for k in want)
    assert hit >= 0.99 * sum(map(len, want.values())) and hit >= 0.9 * sum(map(len, got.values()))


def test_trailing_block_of_long_pages_is_template(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(12):
        paras = [words(rng, 4) for _ in range(rng.randint(210, 400))]
        rows.append((i, f"http://long.com/{i}", page("<table><tr><td>" + "".join(f"<p>{p}</p>" for p in paras) + "<p>Always this line</p></table>")))
        want[i] = " ".join(paras)
    assert texts(spark, rows) == want


@pytest.mark.parametrize("stub", [page("<p>Not found"), "", None, "  "])
@pytest.mark.parametrize("least", [1_000, 5])
def test_template_that_the_model_page_lacks(spark, monkeypatch, stub, least):
    rng = random.Random(7)
    """The stub has the least number of the host's pages, so it is the model if it isn't empty."""
    monkeypatch.setattr(H, "HOT_LEAST", least)
    least = min(range(3000), key=lambda i: H._number(f"{stub}<!-- {i} -->"))
    stub = stub and f"{stub}<!-- {least} -->"
    rows, want = [(1000, "http://stub.com/s", stub)], {1000: "Not found" if stub and "N" in stub else ""}
    for i in range(12):
        paras = [words(rng, 30) for _ in range(rng.randint(2, 6))]
        inner = "".join(f"<p>{p}</p>" for p in paras)
        rows.append((i, f"http://stub.com/{i}", page(f'<div class="top"><p>Site of all</p></div><table><tr><td class="left"><p>Links here</p><td class="mid"><h2>{i} h</h2>{inner}<p>Always this line</p></table><div class="low"><p>Call us</p></div>')))
        want[i] = " ".join([f"{i} h", *paras])
    assert texts(spark, rows) == want


@pytest.mark.parametrize("tag", ["article", "main", 'div class="content"', 'div class="post"'])
def test_near_copies_that_differ_in_chrome_keep_their_text(spark, tag):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(60):
        paras = [words(rng, 20) for _ in range(3)] if i in (7, 31) else [f"same {k}" for k in range(3)]
        inner = "".join(f"<p>{p}</p>" for p in paras)
        rows.append((i, f"http://near.com/{i}", page(f'<nav>menu {rng.random()}</nav><div class="ad">{words(rng, 9)}</div><{tag}><h1>Report</h1>{inner}</{tag.split()[0]}><div class="comments">{words(rng, 5)}</div>')))
        want[i] = " ".join(["Report", *paras])
    assert texts(spark, rows) == want


def test_constant_headings_of_articles_stay(spark):
    rng = random.Random(9)
    said = [words(rng, 20) for _ in range(20)]
    rows = [(i, f"http://head.com/{i}", page(f"<p>Site line</p><article><h2>Summary</h2><p>{p}</p></article>")) for i, p in enumerate(said)]
    assert texts(spark, rows) == {i: f"Summary {p}" for i, p in enumerate(said)}
