"""Benchmark decontamination by a broadcast hash set of test n-grams.

The items' words are cut into windows of WINDOW words (an item of fewer is one
window).  Executors get the distinct ones as a set of hashes, a sorted array of
64 bits each; every document's words stream past it: a rolling hash of each window
is looked up in a bit table, then in the array, and what it hits is verified word
by word, once however many items share the window.  Hit words can be cut out of a
text, or the document be dropped.

The items are sent to the executors in blocks of about BLOCK_BYTES of text, the
usual benchmarks in one; a worker makes a block's windows once and holds some 6
bytes for each of its bytes, 20 while it makes them.  Any number of items works: the documents run through
one block behind another, without a shuffle, and hits add up; between blocks
they are stored, so that driver and executors hold one block at a time.

Rows: null texts have no words; items without an id are searched but not
listed; items with one id count once; texts of any length are read whole, each by
one task; repeated documents give repeated rows; an
empty table of documents gives an empty table, one of items no hits; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import hidden, stored, with_fields

WINDOW = 10
BLOCK_BYTES = 16 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Stands between documents; no word has such a byte.
GAP = b" "
TABLE_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return (text or "").encode().translate(_FOLD).split()


class Windows:
    """The distinct windows of a block of items: for each length the sorted hashes, and beside each where the window stands and the list of items that have it.

    Windows of one hash are told apart by their words here, once, so that a hit is
    verified against one place however many items share the window.  Lists that
    are equal are kept once; list k below the number of items is item k alone.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = [item for item, _ in items]
        self.number: dict[bytes, int] = {}
        said, at, of, start = [], {}, {}, 0
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if words:
                size = min(window, len(words))
                said.append(np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), np.int32, len(words)))
                count = len(words) - size + 1
                at.setdefault(size, []).append(np.arange(start, start + count, dtype=np.int32))
                of.setdefault(size, []).append(np.full(count, k, np.int32))
                start += len(words)
        self.words = np.concatenate(said) if said else np.empty(0, np.int32)
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 1 << 62, window, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        hashes = self._hashes(list(self.number))[self.words] if said else np.empty(0, np.uint64)
        self.shared: list[list[int]] = []
        self.of_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        known: dict[bytes, int] = {}
        for size in at:
            place, item = np.concatenate(at[size]), np.concatenate(of[size])
            rolled, first, lists = self._distinct(self._rolled(hashes, size)[place], place, item, size, known)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[rolled >> np.uint64(64 - TABLE_BITS)] = True
            self.of_length[size] = table, rolled, first, lists

    def _distinct(self, rolled, place, item, size, known):
        """(hashes, places, lists) of the distinct windows, in the order of hashes; ``item`` is in rising order."""
        order = np.argsort(rolled, kind="stable")
        rolled, place, item = rolled[order], place[order], item[order]
        found = []
        while len(rolled):
            new = np.concatenate(([True], rolled[1:] != rolled[:-1]))
            heads = np.flatnonzero(new)
            head = np.repeat(heads, np.diff(np.append(heads, len(rolled))))
            same = np.ones(len(rolled), bool)
            for j in range(size):
                same &= self.words[place + j] == self.words[place[head] + j]
            # an item that has a window twice stands in its list once
            once = same.copy()
            once[1:] &= (item[1:] != item[:-1]) | new[1:] | ~same[:-1]
            group = item[once]
            ends = np.cumsum(np.add.reduceat(once.astype(np.int64), heads))
            lists = group[ends - np.diff(ends, prepend=0)].astype(np.int64)
            for g in np.flatnonzero(np.diff(ends, prepend=0) > 1).tolist():
                bearers = group[ends[g - 1] if g else 0 : ends[g]]
                lists[g] = known.setdefault(bearers.tobytes(), len(self.names) + len(self.shared))
                if lists[g] == len(self.names) + len(self.shared):
                    self.shared.append(bearers)
            found.append((rolled[heads], place[heads], lists))
            # other windows under the hash of the first
            rolled, place, item = rolled[~same], place[~same], item[~same]
        rolled, place, lists = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(rolled, kind="stable")
        return rolled[order], place[order], lists[order]

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)

    def _rolled(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(hashes) - size + 1)
        out = hashes[:n] * self.factors[0]
        for j in range(1, size):
            out += hashes[j : j + n] * self.factors[j]
        return out

    def hits(self, words: list[bytes]):
        """(start, length, list of items) of every occurrence of a window in ``words``."""
        hashes = self._hashes(words)
        for size, (table, sorted_, place, lists) in self.of_length.items():
            rolled = self._rolled(hashes, size)
            some = np.flatnonzero(table[rolled >> np.uint64(64 - TABLE_BITS)])
            first, last = (np.searchsorted(sorted_, rolled[some], side).tolist() for side in ("left", "right"))
            for i, a, b in zip(some.tolist(), first, last):
                if a < b:
                    said = [self.number.get(w, -1) for w in words[i : i + size]]
                    for k in range(a, b):
                        if self.words[place[k] : place[k] + size].tolist() == said:
                            yield i, size, int(lists[k])
                            break

    def items_of(self, lists: set[int]) -> set[str]:
        """The names of the items of some lists, those without a name left out."""
        out: set[int] = set()
        for k in lists:
            out.update((k,) if k < len(self.names) else self.shared[k - len(self.names)].tolist())
        return {self.names[k] for k in out} - {None}


def cut_out(text: str, cover: np.ndarray) -> str:
    """``text`` without its covered words and the rest between two of them."""
    out, at, before = [], 0, False
    for hit, m in zip(cover.tolist(), WORD.finditer(text)):
        if not (hit and before):
            out.append(text[at : m.start()])
        if not hit:
            out.append(m.group())
        at, before = m.end(), hit
    return "".join([*out, text[at:]])


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).distinct()


def _block_count(items: DataFrame, most: int) -> int:
    return max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // most))


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], names: dict[str, str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, cut: bool = False, most: int = BLOCK_BYTES) -> DataFrame:
    """Columns ``keep`` of every document, and under the given ``names``: words, hit, items and, if ``cut``, text (hit words cut out)."""
    at, cov = hidden(docs, "text"), hidden(docs, "cover")
    items = _items(benchmark, item, item_text)
    count = _block_count(items, most)
    carried = [T.StructField(at, T.StringType()), T.StructField(cov, T.BinaryType()), T.StructField(names["items"], T.ArrayType(T.StringType()))]
    frame = docs.select(*keep, F.col(text).alias(at), F.lit(None).cast("binary").alias(cov), F.lit(None).cast("array<string>").alias(names["items"]))
    out = with_fields(docs.select(*keep), (names["words"], T.LongType()), (names["hit"], T.LongType()), (names["items"], T.ArrayType(T.StringType())), *([(names["text"], T.StringType())] if cut else []))
    n_keep = len(keep)

    def step(block, last):
        def run(batches):
            # a worker makes the windows of a block once, for all its tasks
            windows = block.value.get("windows") or block.value.setdefault("windows", Windows(block.value["items"], window))
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    texts, covers, lists = (batch.column(n_keep + k).to_pylist() for k in range(3))
                    words, ends = [], []
                    for x in texts:
                        words += words_of(x)
                        ends.append(len(words))
                        words.append(GAP)
                    cover, found = np.zeros(len(words), bool), [set() for _ in lists]
                    ends = np.array(ends, np.int64)
                    for i, size, bearers in windows.hits(words):
                        cover[i : i + size] = True
                        found[int(np.searchsorted(ends, i))].add(bearers)
                    starts = np.concatenate(([0], ends[:-1] + 1))
                    parts = []
                    for a, b, had in zip(starts.tolist(), ends.tolist(), covers):
                        part = cover[a:b]
                        parts.append(part | np.unpackbits(np.frombuffer(had, np.uint8), count=b - a).astype(bool) if had else part)
                    items = pa.array([sorted(windows.items_of(x).union(had or ())) for x, had in zip(found, lists)], pa.list_(pa.string()))
                    left = batch.columns[:n_keep]
                    if not last:
                        packed = pa.array([np.packbits(p).tobytes() for p in parts], pa.binary())
                        yield pa.RecordBatch.from_arrays([*left, batch.column(n_keep), packed, items], names=[*keep, at, cov, names["items"]])
                        continue
                    more = [pa.array([len(p) for p in parts], pa.int64()), pa.array([int(p.sum()) for p in parts], pa.int64()), items]
                    if cut:
                        more.append(pa.array([cut_out(x, p) if p.any() else x for x, p in zip(texts, parts)], pa.string()))
                    yield pa.RecordBatch.from_arrays([*left, *more], names=out.names)

        return run

    for k in range(count):
        block, last = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()], k == count - 1
        frame = frame.mapInArrow(step(docs.sparkSession.sparkContext.broadcast({"items": block}), last), out if last else T.StructType([*docs.select(*keep).schema.fields, *carried]))
        if not last:
            frame = stored(frame, "hits")
    return frame


NAMES = {"words": "n_words", "hit": "n_hit", "items": "items", "text": "clean_text"}


def digests(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    rows = scan(docs.select(key, how.get("text", "text")), benchmark, [key], NAMES, **how)
    return rows.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents without a hit, with their columns as they were."""
    names = {k: hidden(docs, k) for k in NAMES}
    rows = scan(docs, benchmark, docs.columns, names, text=text, **how)
    return rows.filter(F.col(names["hit"]) == 0).select(*docs.columns)


def clean_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents, their hit words cut out of ``text``."""
    names = {k: hidden(docs, k) for k in NAMES}
    rows = scan(docs, benchmark, docs.columns, names, text=text, cut=True, **how)
    return rows.withColumn(text, F.col(names["text"])).select(*docs.columns)
