"""HTML as a tree of elements and of blocks; broken markup is read as browsers do, as far as paragraphs, list items, cells and raw text go."""

from __future__ import annotations

import html as entities
import re

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Names of HTML elements and of usual boilerplate.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "#root"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select", "textarea", "head", "dialog", "menu", "title", "object", "canvas"}
BOILER_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay"
    " newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments reply replies disqus share sharing social related widget"
    " masthead topbar toolbar pagination pager login signup search skip".split()
)
#: What stands beside such a name without making it another: where it is, and what it is made of.
BESIDE = set(
    "site page main global primary secondary top bottom left right header head foot sticky fixed mobile desktop inner outer box bar list items item links link area zone slot unit block section wrapper wrap container content"
    " group row column col panel pane button buttons icon icons form field input text title posts articles stories news js".split()
)
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CONTENT_NAMES = {"articlebody", "entry-content", "post-content", "article-content", "article-body", "main-content", "content", "article", "post"}
#: Of these, the names of containers that hold more than an article.
WIDE_NAMES = {"content", "main-content"}
#: An opening tag closes an open element of these names, up to the nearest of the boundaries.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = {"#root", "body", "article", "section", "main", "div", "td", "th", "table", "blockquote", "aside", "nav", "footer", "header", "form"}


class Node:
    __slots__ = ("tag", "name", "kids", "boiler", "content", "up", "at")

    def __init__(self, tag: str, name: str, boiler: bool, content: int, up: Node | None):
        self.tag, self.name, self.boiler, self.content, self.up = tag, name, boiler, content, up
        self.kids: list[Node | str] = []
        self.at = -1  # place among the page's blocks

    def nodes(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]

    @property
    def inline(self) -> bool:
        """Is it part of the block around it?"""
        return self.tag in INLINE and not self.boiler


def _boiler_name(token: str) -> bool:
    """A name of boilerplate, alone or with words of BESIDE and numbers: site-footer and ad-slot-2, but not share-price or search-results."""
    parts = [p for p in re.split(r"[-_:]+", token) if p and not p.isdigit()]
    return any(p in BOILER_NAMES for p in parts) and all(p in BOILER_NAMES or p in BESIDE for p in parts)


def _described(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Name for matching, whether it is boilerplate, and whether it is named as content: 1, or 2 as an article."""
    boiler, content, name = tag in BOILER_TAGS, 2 if tag == "article" else int(tag == "main"), tag
    if "=" in attributes:
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "").lower()
            key = key.lower()
            if key == "role":
                boiler |= value in BOILER_ROLES
                content = max(content, int(value == "main"))
            else:
                if key == "class":
                    name = f"{tag}.{value.split()[0]}" if value.split() else tag
                tokens = value.split()
                if tag not in INLINE:
                    content = max([content, *(1 if t in WIDE_NAMES else 2 for t in tokens if t in CONTENT_NAMES)])
                boiler |= tag not in ("html", "body", "article", "main") and any(map(_boiler_name, tokens))
    return name, boiler, 0 if boiler else content


def parse(html: str) -> Node:
    """The page's tree; kids are nodes and decoded strings in order."""
    root = node = Node("#root", "#root", False, 0, None)
    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            node.kids.append(entities.unescape(html[at:]))
            break
        if m.start() > at:
            node.kids.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag, attributes = tag.lower(), m.group(3) or m.group(6) or ""
        if m.group(1) or m.group(4):
            x = node
            while x is not None and x.tag != tag:
                if x.tag in SCOPES and tag not in SCOPES and tag not in ("ul", "ol", "dl", "tr", "html", "body"):
                    x = None
                    break
                x = x.up
            if x is not None and x.up is not None:
                node = x.up
            continue
        if tag not in INLINE and tag not in VOID or tag in ("hr",):
            x = node
            while x.tag not in SCOPES and x.tag != "p":
                x = x.up
            if x.tag == "p":
                node = x.up
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            x = node
            while x is not None and x.tag not in names and x.tag not in bounds:
                x = x.up
            if x is not None and x.tag in names:
                node = x.up
        name, boiler, content = _described(tag, attributes)
        new = Node(tag, name, boiler, content, node)
        node.kids.append(new)
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            if end is None:
                break
            at = html.find(">", end.start()) + 1 or size
        elif tag not in VOID and not attributes.endswith("/"):
            node = new
    return root


def blocks(root: Node) -> list[tuple[Node, int, str]]:
    """(node, place of the block above, own text) of every block, each before those inside it; their places are kept in ``at``."""
    nodes, ups, strings = [root], [-1], [[]]
    root.at = 0
    stack: list[tuple[Node | str, int]] = [(k, 0) for k in reversed(root.kids)]
    while stack:
        x, at = stack.pop()
        if x.__class__ is str:
            strings[at].append(x)
        elif x.tag in VOID:
            strings[at].append(" ")
        elif x.inline:
            stack += [(k, at) for k in reversed(x.kids)]
        else:
            x.at = len(nodes)
            nodes.append(x)
            ups.append(at)
            strings.append([])
            stack += [(k, x.at) for k in reversed(x.kids)]
    return list(zip(nodes, ups, [" ".join("".join(s).split()) for s in strings]))
