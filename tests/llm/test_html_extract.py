import random

import pytest

from attesta.llm import html_extract as H

SCHEMA = "page_id long, url string, html string, text string, host int"


def body(s):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{s}</body></html>"


def test_markup_alone():
    page = body(
        '<header><a href="/">Home</a></header><nav><ul><li>A<li>B</ul></nav><div class="ad">Buy</div><div class="cookie-notice">OK?</div>'
        '<article><h1>Ti&amp;tle</h1><p><b>One <i>t</i>wo.<br><p>Three&nbsp;\n  four</p><script>var t="</p>";</script><form>f</form><ul><li>x<li>y</ul>'
        '<aside>side</aside><div class="share-buttons">s</div><p>a<!-- no --><span>b</span></p></article>'
        '<section id="comments"><article><p>Reader</p></article></section><footer>&copy; F</footer>'
    )
    assert H.main_text(page) == "Ti&tle One two. Three four x y ab"
    assert H.main_text("<article><h1>x</h1><p>cut <b>off") == "x cut off"
    assert H.main_text(body("<main><p>m</p></main><p>out</p>")) == "m"
    assert H.main_text(body('<div class="post"><p>d</p></div><p>out</p>')) == "d"
    assert H.main_text("plain &lt;text&gt; a < b") == "plain <text> a < b"
    assert H.main_text("") == H.main_text(None) == H.main_text("<script>x") == H.main_text("<!-- x") == ""
    assert H.main_text('<article><p title="a>b">q</p><p title="broken>r</p></article>') in ("q r", "q")


def test_names_are_whole():
    """A word of boilerplate in another name is none."""
    stays = ["share-price", "search-results", "ad-hoc", "notice-period", "banner-year", "related-work", "reply-rate", "social-policy", "menu-prices"]
    goes = ["ad", "site-footer", "ad-slot-2", "share-buttons", "related-posts", "comment-list", "cookie_banner", "sidebar left", "main-nav", "Promo:Box"]
    inner = "".join(f'<div class="{n}">{k}</div>' for k, n in enumerate(stays + goes))
    assert H.main_text(body(f"<article><p>p</p>{inner}</article>")) == "p " + " ".join(map(str, range(len(stays))))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def sites():
    rng = random.Random(2)
    rows, want = [], {}
    for site in range(3):
        for i in range(12):
            key = site * 100 + i
            paras = [words(rng, 30) for _ in range(rng.randint(2, 6))]
            inner = "".join(f"<p>{p}</p>" for p in paras)
            html = body(f'<div class="top"><p>Site {site} of all</p></div><table><tr><td class="left"><p>Links here</p><td class="mid"><h2>{key} h</h2>{inner}<p>Always this line</p></table><div class="low"><p>Call us</p></div>')
            rows.append((key, f"http://s{site}.com/{i}", html, "x", 1))
            want[key] = " ".join([f"{key} h", *paras])
    return rows, want


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_induced_template(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rows, want = sites()
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r.text for k, r in got.items()} == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_and_lone_pages_lose_nothing(spark):
    page = body("<nav>n</nav><article><h1>h</h1><p>one</p><p>two</p></article>")
    rows = [(i, f"http://c.com/{i}", page, "x", 1) for i in range(20)] + [(50, "http://lone.com/", page, "x", 1), (51, None, page, "x", 1), (52, None, None, None, None), (None, "x", "", "x", 1)]
    rows += [(60, "http://big.com/a", body("<article>" + "<p>w</p>" * 3000 + "</article>"), "x", 1), (61, "http://big.com/b", body("<article>" + "<p>v</p>" * 2500 + "</article>"), "x", 1)] + [rows[0]]
    got = sorted(((r.page_id, r.url, r.text) for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(k, u, "" if not h else "h one two" if k < 60 else " ".join("w" * 3000 if k == 60 else "v" * 2500)) for k, u, h, *_ in rows]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA)).collect() == []
