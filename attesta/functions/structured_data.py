"""Scripts, visible text and links of pages, by one Arrow UDF over the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from attesta.functions.json_tokens import Refused, strict_loads

#: Elements that set texts apart, and those whose text is never shown.
BLOCKS = set("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table td th tr ul".split())
BREAKS, UNSEEN = {"br", "hr"}, {"script", "style", "template"}
#: Fixed value: characters of a script.
MOST_SCRIPT = 65_536


class _Page(HTMLParser):
    """What a page says, text by text, each with the innermost block around it; its scripts and declared character sets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.said: list[tuple[int, str]] = []
        self.blocks, self.made, self.unseen = [("", 0)], 0, []
        self.scripts, self.charsets, self.types = [], [], []

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag in BREAKS:
            self.said.append((-1, ""))
        elif tag in BLOCKS:
            self.made += 1
            self.blocks.append((tag, self.made))
        elif tag in UNSEEN:
            self.unseen.append(tag)
        if tag == "script":
            self.scripts.append({"type": (held.get("type") or "").strip().lower(), "external": "src" in held, "text": ""})
        elif tag == "meta":
            self.charsets += [held["charset"] or ""] if "charset" in held else []
            self.types += [held.get("content") or ""] if (held.get("http-equiv") or "").lower() == "content-type" else []

    def handle_endtag(self, tag):
        if tag in self.unseen:
            del self.unseen[self.unseen.index(tag) :]
        else:
            opened = [k for k, (name, _) in enumerate(self.blocks) if name == tag]
            if opened:
                del self.blocks[opened[-1] :]

    def handle_data(self, data):
        if self.unseen:
            if self.unseen[-1] == "script":
                self.scripts[-1]["text"] += data
        elif data.strip():
            self.said.append((self.blocks[-1][1], data.strip()))

    def visible(self) -> str:
        """Texts of one block are parted by a space, others and those at a line break by a newline."""
        out, last = [], None
        for block, text in self.said:
            if block >= 0:
                out += ["" if not out else " " if block == last else "\n", text]
            last = block
        return "".join(out)


class _Words(HTMLParser):
    """Every element's edge separates words; footers are left out, titles are not.  Links with what they say."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.hidden, self.anchors, self.open = [], [], [], None

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        if tag == "a" and held.get("href") is not None:
            self.open = [held["href"], ""]
            self.anchors.append(self.open)
        if tag in ("script", "style", "noscript", "footer"):
            self.hidden.append(tag)
        self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        else:
            self.text.append(" ")
        if tag == "a":
            self.open = None

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.open:
                self.open[1] += data + " "


def parsed(html: str, reader: HTMLParser | None = None):
    reader = reader or _Page()
    reader.feed(html)
    reader.close()
    return reader


def _utf8_only(content_type: str) -> bool:
    kind, *parts = [p.strip() for p in content_type.split(";")]
    charsets = [p.split("=", 1)[1].strip().strip("\"'").lower() for p in parts if p.lower().startswith("charset") and "=" in p]
    return kind.lower() == "text/html" and len(charsets) <= 1 and all(c in ("utf-8", "utf8") for c in charsets)


SCRIPT = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("problem", T.StringType())])
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("count", T.IntegerType()), T.StructField("scripts", T.ArrayType(SCRIPT)), T.StructField("problem", T.StringType())])


def page_of(html: str) -> dict:
    """A page's visible text, number of scripts, JSON-LD scripts with what is wrong with each, and what is wrong with the page as a whole."""
    html = html.removeprefix("﻿")
    reader, end = parsed(html), re.search(r"</html\s*>", html, re.I)
    problem = None
    if end and html[end.end() :].strip():
        problem = "HTML has unsupported trailing content after closed document"
    elif any(c.lower() not in ("utf-8", "utf8") for c in reader.charsets):
        problem = "HTML embedded charset differs from declared UTF8 representation"
    elif not all(map(_utf8_only, reader.types)):
        problem = "HTML requires unambiguous text/html UTF8 representation"

    def wrong(script) -> str | None:
        if script["external"]:
            return "external script is not embedded data"
        if not 0 < len(script["text"]) <= MOST_SCRIPT:
            return "structured script missing or too large"
        try:
            strict_loads(script["text"])
        except (ValueError, RecursionError) as error:
            return str(error) if isinstance(error, Refused) else "invalid JSON"

    scripts = [{"index": k, "text": s["text"], "problem": wrong(s)} for k, s in enumerate(reader.scripts) if s["type"] == "application/ld+json"]
    return {"text": reader.visible(), "count": len(reader.scripts), "scripts": scripts, "problem": problem}


@pandas_udf(PAGE)
def page_content(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_of(x or "") for x in html], columns=PAGE.names)


def cleaned(html: str) -> str:
    """All words of a page but those of scripts, styles and footers, on one line."""
    return " ".join("".join(parsed(html, _Words()).text).split())


def resolved(base: str, href: str) -> str | None:
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@pandas_udf(T.StringType())
def cleaned_text(html: pd.Series) -> pd.Series:
    return html.map(lambda x: cleaned(x or ""))


ANCHOR = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("href", "url", "text")]))


@pandas_udf(ANCHOR)
def anchors(html: pd.Series, base: pd.Series) -> pd.Series:
    """Links of a page in order: as written, resolved against the page's URL, and their text."""
    rows = []
    for page, url in zip(html, base):
        found = parsed(page or "", _Words()).anchors
        rows.append([{"href": h.strip(), "url": resolved(url or "", h.strip()), "text": " ".join(t.split())} for h, t in found])
    return pd.Series(rows)
