"""Substring dedup by repeated-phrase automata.

A window is WIDTH consecutive words of one document.  A word is removed if a
window that covers it has a word sequence that also starts in a document with a
smaller id.

1. Every document's windows are dealt into stretches by content-defined anchors
   (see anchors.py).  Equal windows fall into stretches with equal core hashes,
   and a passage copied as a whole gives equal stretches.  Equal stretches are
   aggregated to one with its least document, before and in the shuffle: in any
   other document all of its windows recur.
2. Different stretches with one core may still share windows.  Their words go to
   the shard of the core.  Rolling hashes confirm the windows there that two or
   more documents have; an Aho-Corasick automaton over word numbers is compiled
   from those of a batch of cores, each from its least document, and all stretches
   of the batch stream through it, which locates all occurrences word by word.
   Cores with over MOST_KINDS different stretches have no shard: their windows
   are compared by content, spread over all tasks.
3. The located windows return to their documents, where covered words go.

Only stretches whose core recurs travel with text, and a text is shuffled once.

Rows: null text has no words; a null id counts as larger than any other; rows
with one id don't remove each other's words; texts of any length are read whole,
in blocks; repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored, whatever their names.  Ids are integers.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.anchors import stretches, window_hits, window_rows
from attesta.llm.common import LONG_MAX, hidden, stored, with_fields

#: Fixed value: words in a window.
WIDTH = 50
#: Words in an anchor's hash; stretches compiled into one automaton, if their cores are whole.
GRAM, BATCH = 8, 2000
#: Different stretches of a core that go to one shard.
MOST_KINDS = 500
#: A stretch with a larger share and number of all rows is hot.
HOT_SHARE, HOT_LEAST = 1e-3, 5_000
#: What names a row, in 96 bits.
ROW = ["row", "mark"]
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _stretch_rows(given: DataFrame, width: int) -> DataFrame:
    """(row, mark, doc, core, seg, at): every stretch of every text; at holds its first window and their number."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "mark", "doc", "core", "seg", "at")])
    gram = min(GRAM, width)

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for row, mark, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()
                if len(words) < width:
                    continue
                numbers = _numbers(words)
                core, first, count, _ = stretches(numbers, width, gram)
                raw = memoryview(numbers).cast("B")
                segs = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (a + n + width - 1)]) for a, n in zip(first.tolist(), count.tolist())]
                size = len(core)
                for k, x in enumerate((np.full(size, row), np.full(size, mark), np.full(size, doc), core.view(np.int64), np.array(segs, np.uint64).view(np.int64), first << 8 | count)):
                    out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=schema.names)

    return given.select(*ROW, "doc", "text").mapInArrow(run, schema)


def _texts(pairs: DataFrame, width: int) -> DataFrame:
    """(core, seg, doc, words) of each wanted stretch (core, seg, doc, at) of a text."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("core", "seg", "doc")] + [T.StructField("words", T.StringType())])

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode().split()
                for w in wanted:
                    first, count = w["at"] >> 8, w["at"] & 255
                    out.append((w["core"], w["seg"], w["doc"], b" ".join(words[first : first + count + width - 1]).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=schema.names)

    return pairs.mapInArrow(run, schema)


def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of 64 bits of every window of word numbers."""
    factors = np.random.default_rng(7).integers(1, 1 << 62, width, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    n = len(ids) - width + 1
    out = mixed[:n] * factors[0]
    for k in range(1, width):
        out += mixed[k : k + n] * factors[k]
    return out


def _locate(group: list[tuple[int, int, int, str]], width: int):
    """(core, seg, bits of the windows that start in a smaller document) of a batch of whole cores."""
    number: dict[str, int] = {}
    runs = [tuple(number.setdefault(w, len(number)) for w in words.split(" ")) for _, _, _, words in group]
    sizes = [len(ids) - width + 1 for ids in runs]
    flat = np.concatenate([np.array(ids, np.uint64) for ids in runs])
    ends = np.cumsum([len(ids) for ids in runs])
    own = np.concatenate([np.arange(e - len(ids), e - width + 1) for e, ids in zip(ends.tolist(), runs)])  # windows within one stretch
    rolled, docs = _rolled(flat, width)[own], np.repeat(np.array([g[2] for g in group], np.int64), sizes)
    order = np.lexsort((docs, rolled))
    head = np.concatenate(([True], rolled[order][1:] != rolled[order][:-1]))
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(order)) - 1
    confirmed = order[first[docs[order[first]] < docs[order[last]]]]
    if not len(confirmed):
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    starts = np.cumsum([0, *sizes])
    for k in confirmed.tolist():
        at = int(np.searchsorted(starts, k, "right")) - 1
        i = k - int(starts[at])
        automaton.add_word(runs[at][i : i + width], group[at][2])
    automaton.make_automaton()
    for (core, seg, doc, _), ids, size in zip(group, runs, sizes):
        found = np.zeros(size, bool)
        for end, owner in automaton.iter(ids):
            if owner < doc:
                found[end - width + 1] = True
        if found.any():
            yield core, seg, np.packbits(found).tobytes()


def _automata(texts: DataFrame, width: int) -> DataFrame:
    """(core, seg, found) of the stretches with windows that start in a smaller document."""
    schema = T.StructType([T.StructField("core", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("found", T.BinaryType())])

    def run(batches):
        group: list[tuple[int, int, int, str]] = []

        def flush():
            rows = list(_locate(group, width))
            group.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=schema.names)

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                if len(group) >= BATCH and x[0] != group[-1][0]:
                    yield from flush()
                group.append(x)
        if group:
            yield from flush()

    return texts.repartition("core").sortWithinPartitions("core").mapInArrow(run, schema)


def named(key: str, text: str) -> list[Column]:
    return [F.xxhash64(F.col(key), F.col(text)).alias("row"), F.hash(F.col(key), F.col(text)).cast("long").alias("mark")]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, mark, key, text).  Every join with texts takes just these columns, so Spark shuffles them once and reads the exchange again."""
    return docs.select(*named(key, text), F.col(key), F.col(text))


def at_all_places(parts: DataFrame, marked: DataFrame, known: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The stretches of ``parts`` with what ``marked`` says of their (core, seg); ``known`` has the number n of each.

    A stretch with over a HOT_SHARE of all rows, as third parts of a corpus that
    are copies have, would land in one task.  There are at most 1 / HOT_SHARE
    such, so they meet their places by a broadcast and only the rest is shuffled.
    ``hot``: what is said of them, where that is known without ``marked``.
    """
    most = max(HOT_LEAST, int(parts.count() * HOT_SHARE))
    keys = ["core", "seg"]
    rest = parts.join(F.broadcast(known.filter(F.col("n") > most).select(*keys)), keys, "left_anti").join(marked.filter(F.col("n") <= most).drop("n"), keys)
    return rest.unionByName(parts.join(F.broadcast((marked if hot is None else hot).filter(F.col("n") > most).drop("n")), keys))


def _windows(pairs: DataFrame, text: str, width: int) -> DataFrame:
    """The windows of the ``wanted`` stretches of ``pairs`` (text, wanted), see window_rows."""
    gram = min(GRAM, width)

    def cut(value):
        numbers = _numbers((value or "").encode().split())
        core, first, count, _ = stretches(numbers, width, gram)
        raw = memoryview(numbers).cast("B")
        seg = lambda a, n: (x := xxhash.xxh3_64_intdigest(raw[8 * a : 8 * (a + n + width - 1)])) - (x >> 63 << 64)
        return core, first, count, seg, lambda i: raw[8 * i : 8 * (i + width)]

    return window_rows(pairs.select(text, "wanted"), cut, width)


def _removals(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(row, mark, cuts): the windows to remove of each text that has any."""
    given = docs.select(*named(key, text), F.coalesce(F.col(key).cast("long"), F.lit(LONG_MAX)).alias("doc"), F.col(text).alias("text"))
    parts = stored(_stretch_rows(given, width), "stretches")
    distinct = parts.groupBy("core", "seg").agg(F.min(F.struct("doc", *ROW, "at")).alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
    distinct = distinct.select("core", "seg", "n", F.col("least.doc").alias("first_doc"), *(F.col(f"least.{c}").alias(c) for c in (*ROW, "at")), "most")
    kinds = distinct.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    known = stored(distinct.join(kinds, "core", "left").filter("kinds > 1 OR most > first_doc"), "recurring")
    stretch = F.struct("core", "seg", F.col("first_doc").alias("doc"), "at")
    texts = keyed(docs, key, text)
    wanted = lambda which: texts.join(known.filter(which).groupBy(*ROW).agg(F.collect_list(stretch).alias("wanted")), ROW)
    located = _automata(_texts(wanted(f"kinds BETWEEN 2 AND {MOST_KINDS}").select(key, text, "wanted"), width), width)
    hot = f"kinds > {MOST_KINDS}"
    if not known.filter(hot).isEmpty():
        located = located.unionByName(window_hits(stored(_windows(wanted(hot), text, width), "windows"), True))
    marked = known.select("core", "seg", "n", "first_doc", "most").join(located, ["core", "seg"], "left").filter("most > first_doc OR found IS NOT NULL")
    hits = at_all_places(parts, marked, known).filter("doc > first_doc OR found IS NOT NULL")
    return hits.groupBy(*ROW).agg(F.collect_set(F.struct("at", F.when(F.col("doc") == F.col("first_doc"), F.col("found")).alias("found"))).alias("cuts"))


def covered(size: int, cuts: list[dict] | None, width: int) -> np.ndarray:
    """Which of ``size`` symbols the windows of ``cuts`` cover."""
    edges = np.zeros(size + 1, np.int64)
    for cut in cuts or ():
        first, count = cut["at"] >> 8, cut["at"] & 255
        if cut["found"] is None:
            edges[first] += 1
            edges[first + count - 1 + width] -= 1
        else:
            starts = first + np.flatnonzero(np.unpackbits(np.frombuffer(cut["found"], np.uint8), count=count))
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:size]) > 0


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every document."""
    cuts = _removals(docs, key, text, width)
    given = keyed(docs, key, text).join(cuts, ROW, "left").select(key, text, "cuts")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            sizes, removed, shas = [], [], []
            for value, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (value or "").encode().split()
                gone = covered(len(words), cut, width)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if cut else words
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema)


def cut_out(text: str, gone: np.ndarray) -> str:
    """``text`` without its removed words and the space behind each."""
    raw, out, at = text.encode(), [], 0
    for hit, m in zip(gone.tolist(), _WORD.finditer(raw)):
        if hit:
            out.append(raw[at : m.start()])
            at = m.end() + (raw[m.end() : m.end() + 1].isspace())
    return b"".join([*out, raw[at:]]).decode()


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """All documents with the removed words cut out of ``text``, other columns as they were."""
    cuts = _removals(docs, key, text, width)
    names, cut = [hidden(docs, c) for c in ROW], hidden(docs, "cuts")
    cuts = cuts.select(*(F.col(c).alias(n) for c, n in zip(ROW, names)), F.col("cuts").alias(cut))
    given = docs.select("*", *(c.alias(n) for c, n in zip(named(key, text), names))).join(cuts, names, "left")
    at, schema = docs.columns.index(text), with_fields(docs)

    def run(batches):
        for batch in batches:
            texts = []
            for value, c in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                texts.append(cut_out(value, covered(len(value.encode().split()), c, width)) if c else value)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return given.select(*docs.columns, cut).mapInArrow(run, schema)
