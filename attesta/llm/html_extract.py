"""HTML main text by wrapper induction.

Pages of one host are made from one template.

1. Every page becomes a skeleton: its blocks in order, with numbers for names and
   own texts.  Of pages with one main text, by markup alone, the one of the least
   hash stands for all.
2. Of a host's skeletons one is the model, and each of the others is aligned with
   it by simple tree matching (see tree_match.py).  All vote: a node whose text
   is the same wherever it is matched is template; where texts vary, or nodes
   have no partner, there is content.  Texts that recur on nearly all pages with
   unmatched text in one place are template too, so that what the model lacks is
   found.
3. The varying text decides what the main text is.  The deepest container with
   nearly all of it is the host's content slot, whatever it is called.  Names of
   boilerplate are believed while the rest varies too; where they cover nearly
   all that varies they are wrong, and not believed.  An article that the markup
   names is taken in the slot if it holds most of what varies there, or around it.
4. Every page is aligned with its host's model.  Its main text is its slot's,
   without template (but for constant lines inside the article) and without
   subtrees named as menus, headers, footers, sidebars, notices, adverts, forms,
   scripts, styles or comments.

A host whose pages show no variation (one page, or copies of one), and a page in
which the slot has no partner, go by markup alone.  Blocks are joined by a space,
white space within them becomes one, character references are decoded.

Only skeletons are shuffled to make the templates, and those of the hottest hosts
not even to meet their model, which is broadcast.  Pages meet their host's
template in one left join, for which Spark picks a broadcast or a shuffle by the
templates' measured size; it splits a host that is too large for one task.

Rows: null html is empty and gives an empty text; pages without a host form one
group; broken markup is read as far as it can be, of any depth; pages of any
length are read whole, each by one task; of a host's skeletons the one of the
least number and then text is the model; repeated rows give repeated rows; an
empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import stored
from attesta.llm.dom import CONTAINERS, Node, blocks, parse
from attesta.llm.tree_match import Tree, align
from attesta.llm.url_filter import parts as url_parts

#: Share of a host's varying text in its content slot; share of what varies in a slot that a named article must hold.
SLOT_SHARE, NAMED_SHARE = 0.9, 0.5
#: Share of the varying text outside named boilerplate from which the names are believed.
BELIEVED_SHARE = 0.1
#: Pages and share at which a text counts as template.
LEAST_PAGES, SAME_SHARE = 8, 0.95
#: Templates that a task keeps.
KEPT_HOSTS = 2_000
#: Models of up to HOT_BYTES of hosts with over a HOT_SHARE of all skeletons, HOT_LEAST at least, are broadcast: 1 / HOT_SHARE of them at most.
HOT_SHARE, HOT_LEAST, HOT_BYTES = 1e-3, 1_000, 64 << 10

BOILER, CONTAINER, CONTENT, AROUND = 1, 2, 4, 8
FIELDS = np.dtype([("up", "<i4"), ("name", "<u4"), ("text", "<i8"), ("chars", "<i4"), ("flags", "u1")])


def _number(text: str) -> int:
    """A number of 63 bits over 0 for a text; 0 for none."""
    return (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1) if text else 0


def _flags(x: Node) -> int:
    return BOILER * x.boiler | CONTAINER * (x.tag in CONTAINERS) | CONTENT * (x.content == 2) | AROUND * (x.tag in ("article", "main"))


class Page:
    """A page's blocks as a tree, with what its markup says of each."""

    def __init__(self, up: list[int], name: list[int], text: list[int], chars: list[int], flags: list[int]):
        self.tree, self.chars, self.flags = Tree(up, name, text), chars, flags
        self.boiler, self.article = [False] * len(up), [False] * len(up)  # or inside such
        for i, f in enumerate(flags):
            above = up[i]
            self.boiler[i] = bool(f & BOILER) or above >= 0 and self.boiler[above]
            self.article[i] = bool(f & CONTENT) or above >= 0 and self.article[above]

    @classmethod
    def of(cls, found: list[tuple[Node, int, str]]) -> Page:
        names = [xxhash.xxh32_intdigest(x.name.encode("utf-8", "surrogatepass")) for x, _, _ in found]
        return cls([u for _, u, _ in found], names, [_number(s) for _, _, s in found], [len(s) for _, _, s in found], [_flags(x) for x, _, _ in found])

    @classmethod
    def read(cls, raw: bytes) -> Page:
        found = np.frombuffer(raw, FIELDS)
        return cls(*(found[f].tolist() for f in FIELDS.names))

    def written(self) -> bytes:
        out = np.empty(len(self.flags), FIELDS)
        out["up"], out["name"], out["text"], out["chars"], out["flags"] = self.tree.up, self.tree.name, self.tree.text, self.chars, self.flags
        return out.tobytes()

    def main(self) -> int:
        """A number for what markup alone takes for the main text, as far as names seem right."""
        texts, chars = self.tree.text, self.chars
        said = [i for i, t in enumerate(texts) if t]
        for named, share in (([i for i in said if not self.boiler[i]], BELIEVED_SHARE), ([i for i in said if not self.boiler[i] and self.article[i]], NAMED_SHARE)):
            if sum(chars[i] for i in named) < share * sum(chars[i] for i in said):
                break
            said = named
        return hash(tuple([texts[i] for i in said]))


#: What a vote counts: pages matched, of these with the model's text; characters of varying text: all, outside named boilerplate, and of these in a named article.
COUNTS = ("matched", "same", "chars", "free", "named")


def _placed(page: Page, partner: list[int]):
    """(block, place of its partner or of the next block above with one, number of the place if it has no partner) for every block."""
    above, path = [0] * len(partner), [0] * len(partner)
    for i, at in enumerate(partner):
        up = page.tree.up[i]
        if at >= 0 or up < 0:
            above[i] = max(at, 0)
        else:
            above[i] = above[up]
            path[i] = hash((path[up] or above[up], page.tree.name[i])) & 0x3FFFFFFFFFFFFFFF or 1
        yield i, above[i], path[i]


def votes(page: Page, model: Page, out: dict[tuple[int, int], list[int]]) -> None:
    """Adds a page's votes: for (block of the model, 0) the COUNTS; for (number under 0 of a place of unmatched text, number of the text or 0 for any) pages only."""
    seen = set()
    for i, at, path in _placed(page, align(page.tree, model.tree)):
        text = page.tree.text[i]
        count = out.setdefault((at, 0), [0, 0, 0, 0, 0])
        if not path:
            count[0] += 1
            if text == model.tree.text[at]:
                count[1] += 1
                continue
        elif text:
            seen |= {(-path, 0), (-path, text)}
        count[2] += page.chars[i]
        if not page.boiler[i]:
            count[3] += page.chars[i]
            if page.article[i]:
                count[4] += page.chars[i]
    for k in seen:
        out.setdefault(k, [0, 0, 0, 0, 0])[0] += 1


class Template:
    """A host's model, its content slot and the blocks that are template."""

    def __init__(self, model: Page, found: dict[tuple[int, int], list[int]]):
        self.model, up = model, model.tree.up
        self.recurring = {k for k in found if k[0] < 0}
        counts = [found.get((i, 0), (0, 0, 0, 0, 0)) for i in range(len(up))]
        sums = [[c[k] for c in counts] for k in (2, 3, 4)]
        for i in range(len(up) - 1, 0, -1):
            for s in sums:
                s[up[i]] += s[i]
        total, free, named = sums
        self.believed = free[0] >= BELIEVED_SHARE * total[0]
        mass = free if self.believed else total
        self.slot = -1
        if mass[0]:
            for i, f in enumerate(model.flags):  # the last in this order is the deepest on the way down
                if f & CONTAINER and mass[i] >= SLOT_SHARE * mass[0] and not (self.believed and model.boiler[i]):
                    self.slot = i
        self.named = self.slot >= 0 and self.believed and named[self.slot] >= NAMED_SHARE * mass[self.slot] > 0
        self.fixed = {i for i, c in enumerate(counts) if total[0] and c[0] >= LEAST_PAGES and c[1] >= SAME_SHARE * c[0] and model.tree.text[i]}


def _holders(node: Node, test) -> list[Node]:
    """The outermost nodes under ``node`` that pass; nothing inside boilerplate."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.boiler and x is not node:
            continue
        if test(x):
            out.append(x)
        else:
            stack += reversed(x.nodes())
    return out


def _around(node: Node | None) -> Node | None:
    """The outermost of the nearest articles around a node."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.up
    while node is not None and node.up is not None and node.up.tag in ("article", "main"):
        node = node.up
    return node


def by_markup(page: Node) -> list[Node]:
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.content):
        if found := _holders(page, test):
            return found
    return [page]


def content_of(root: Node, template: Template | None) -> tuple[list[Node], set[int], bool]:
    """The nodes whose text is the page's, the places of blocks that are template, and whether names of boilerplate are believed."""
    found = blocks(root)
    if template is None or template.slot < 0:
        return by_markup(root), set(), True
    page, model = Page.of(found), template.model
    partner = align(page.tree, model.tree)
    fixed, slot = set(), None
    for i, at, path in _placed(page, partner):
        if not path and at == template.slot:
            slot = found[i][0]
        if page.article[i] and template.named:
            continue
        if not path and at in template.fixed and page.tree.text[i] == model.tree.text[at] or path and (-path, page.tree.text[i]) in template.recurring:
            fixed.add(i)
    if slot is None:
        return by_markup(root), fixed, True
    if template.named:
        if (around := _around(slot)) is not None:
            return [around], fixed, True
        named = _holders(slot, lambda n: n.tag == "article") or _holders(slot, lambda n: n.content == 2)
        return named or [slot], fixed, True
    return [slot], fixed, template.believed


def text_of(tops: list[Node], fixed: set[int], believed: bool = True) -> str:
    """The nodes' text without boilerplate and template; a block's edge separates as a space does."""
    out: list[str] = []
    for top in tops:
        stack: list[tuple[Node | str, bool]] = [(top, False)]
        while stack:
            x, skip = stack.pop()
            if x.__class__ is str:
                if not skip:
                    out.append(x)
                continue
            if x is not top and (believed and x.boiler or x.tag == "header" and not any(n.tag == "h1" for n in x.nodes())):
                out.append(" ")
                continue
            if not x.inline:
                out.append(" ")
                stack.append((" ", False))
                skip = x.at in fixed
            stack += [(k, skip) for k in reversed(x.kids)]
        out.append(" ")
    return " ".join("".join(out).split())


def main_text(html: str | None, template: Template | None = None) -> str:
    return text_of(*content_of(parse(html or ""), template))


SKELETON = "host string, main bigint, number bigint, skeleton binary"
VOTES = ", ".join(["host string, node bigint, text bigint", *(f"{c} bigint" for c in COUNTS)])


def _skeletons(batches):
    for batch in batches:
        held: dict[tuple[str, int], tuple[int, bytes]] = {}
        for host, html in zip(*(c.to_pylist() for c in batch.columns)):
            number, page = _number(html), Page.of(blocks(parse(html)))
            key = host, page.main()
            if key not in held or number < held[key][0]:
                held[key] = number, page.written()
        if held:
            columns = zip(*((h, m, n, s) for (h, m), (n, s) in held.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["host", "main", "number", "skeleton"])


def _votes(batches):
    models: dict[str, Page] = {}
    for batch in batches:
        found: dict[str, dict] = {}
        for name, skeleton, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if skeleton == raw:
                continue
            if name not in models:
                if len(models) >= KEPT_HOSTS:
                    models.clear()
                models[name] = Page.read(raw)
            votes(Page.read(skeleton), models[name], found.setdefault(name, {}))
        rows = [(h, *at, *c) for h, counts in found.items() for at, c in counts.items()]
        if rows:
            kinds = [pa.string(), *[pa.int64()] * (2 + len(COUNTS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["host", "node", "text", *COUNTS])


def _texts(names):
    """(key, url, text, n_chars) of batches of (key, url, host, html, model, counts)."""

    def run(batches):
        made: dict[str, Template] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part, texts = batch.slice(start, 500), []
                for k, (host, html) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if host not in made and part.column(4)[k].is_valid:
                        if len(made) >= KEPT_HOSTS:
                            made.clear()
                        counts = {(x["node"], x["text"]): [x[c] for c in COUNTS] for x in part.column(5)[k].as_py()}
                        made[host] = Template(Page.read(part.column(4)[k].as_py()), counts)
                    texts.append(main_text(html, made.get(host)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=names)

    return run


def templates(given: DataFrame) -> DataFrame:
    """(host, model, counts) of every host of ``given`` (host, html) whose pages vary."""
    skeletons = given.filter(F.length("html") > 0).select("host", "html").mapInArrow(_skeletons, SKELETON)
    voters = stored(skeletons.groupBy("host", "main").agg(F.min(F.struct("number", "skeleton")).alias("v")).select("host", "v.number", "v.skeleton"), "skeletons")
    models = stored(voters.groupBy("host").agg(F.min(F.struct("number", "skeleton")).alias("m"), F.count("*").alias("n")).select("host", "n", F.col("m.skeleton").alias("model")), "models")
    often = (F.col("n") > max(HOT_LEAST, int(HOT_SHARE * voters.count()))) & (F.octet_length("model") <= HOT_BYTES)
    hot, rest = models.filter(often), models.filter(~often)
    pairs = voters.join(F.broadcast(hot), "host").unionByName(voters.join(F.broadcast(hot.select("host")), "host", "left_anti").join(rest, "host"))
    cast = pairs.select("host", "skeleton", "model").mapInArrow(_votes, VOTES)
    summed = stored(cast.groupBy("host", "node", "text").agg(*(F.sum(c).alias(c) for c in COUNTS)).filter((F.col("text") == 0) | (F.col("matched") >= LEAST_PAGES)), "votes")
    places = summed.filter("text = 0 AND node < 0").select("host", "node", F.col("matched").alias("pages"))
    recurring = summed.filter("text <> 0").join(places, ["host", "node"]).filter(F.col("matched") >= SAME_SHARE * F.col("pages")).select("host", "node", "text", *COUNTS)
    learnt = summed.filter("node >= 0").unionByName(recurring).groupBy("host").agg(F.collect_list(F.struct("node", "text", *COUNTS)).alias("counts"))
    return models.select("host", "model").join(learnt, "host")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    given = pages.select(F.col(key), F.col(url).alias("url"), F.col(html).alias("html"), url_parts(F.col(url))[0].alias("host"))
    schema = T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    learnt = stored(templates(given), "templates")
    return given.join(learnt, "host", "left").select(key, "url", "host", "html", "model", "counts").mapInArrow(_texts(schema.names), schema)
