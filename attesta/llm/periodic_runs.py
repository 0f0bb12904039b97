"""Periodic runs of words by Crochemore's partition refinement, and texts with their repeats taken out.

Positions whose factors of one length are equal form a class.  Classes are
refined length by length: what is split off a class last splits, one place
further left, the classes of the next length, and of the parts of a split class
one that holds most of it keeps its name (smaller half): a part that is split off
has at most 8 of 9 members of its class, so a position is split off O(log n)
times.  The members of a class are linked in order.  Neighbours at a distance equal to the length are the starts of
a square whose root is primitive, and squares that start side by side are one
maximal run of that smallest period.

Each text ends in a word of its own, which ends the classes of its last
positions.  Texts of a batch are refined together, as one array with many ends:
a batch holds BATCH words, or one text that is longer, in some 60 bytes a word.
Lengths go up to a text's words divided by the least exponent, as no longer
period has a run.

Rows: a null or empty text has no words, no run and an empty text; a null key
keeps its row; repeated rows give repeated rows; texts of any length are read
whole, each by one task; runs of one start are told apart by their periods; an
empty table gives an empty table; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least LEAST words and EXPONENT periods.
LEAST, EXPONENT = 6, 4
BATCH = 1 << 18
#: A part keeps its class's name if it has so many times the members that aren't touched.
MUCH = 8


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


class _Classes:
    """The classes of positions at one length, and the gap from each position to the next of its class."""

    def __init__(self, symbols: np.ndarray, limit: np.ndarray):
        n = len(symbols)
        self.limit = limit  # the longest period that matters, for each position
        self.name = symbols.astype(np.int64)
        self.names = int(symbols.max()) + 1
        self.size = np.bincount(symbols, minlength=n + 1)
        self.after = np.full(n, -1, np.int64)
        self.before = np.full(n, -1, np.int64)
        self.due: dict[int, list[np.ndarray]] = {}
        self.gap = np.zeros(n, np.int64)
        self.touched = np.zeros(n, bool)
        order = np.argsort(symbols, kind="stable")
        self._link(order, symbols[order], 0)
        self.split_off = order

    def _grow(self, names: int) -> None:
        if names > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(max(names - len(self.size), len(self.size)), np.int64)])

    def _note(self, at: np.ndarray, length: int) -> None:
        """Write down the gaps of these positions, each for the length at which it is a square."""
        gap = np.where(self.after[at] >= 0, self.after[at] - at, 0)
        self.gap[at] = gap
        at = at[(gap > length) & (gap <= self.limit[at])]
        if len(at):
            gap = self.gap[at]
            order = np.argsort(gap, kind="stable")
            at, gap = at[order], gap[order]
            starts = _cuts(gap)
            for d, part in zip(gap[starts].tolist(), np.split(at, starts[1:])):
                self.due.setdefault(d, []).append(part)

    def _link(self, at: np.ndarray, names: np.ndarray, length: int) -> None:
        """Link the members of whole classes, given by class and position."""
        same = names[1:] == names[:-1]
        self.after[at] = np.append(np.where(same, at[1:], -1), -1)
        self.before[at] = np.insert(np.where(same, at[:-1], -1), 0, -1)
        self._note(at, length)

    def squares(self, length: int) -> np.ndarray:
        """The starts of squares with primitive roots of this length, in order."""
        at = np.concatenate(self.due.pop(length, [np.zeros(0, np.int64)]))
        return np.unique(at[self.gap[at] == length])

    def refine(self, length: int) -> bool:
        """From factors of ``length`` to those with one more word; False if nothing was left to split."""
        at = self.split_off - 1
        at = at[at >= 0]
        at = at[(self.size[self.name[at]] > 1) & (self.limit[at] > length)]
        if not len(at):
            return False
        old, right = self.name[at], self.name[at + 1]
        order = np.lexsort((at, right, old))
        at, old, right = at[order], old[order], right[order]
        # parts: members of one class whose right neighbours are of one class; the rest of the class is a part as well
        starts = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (right[1:] != right[:-1]))))
        count = np.diff(np.append(starts, len(at)))
        of = old[starts]
        firsts = _cuts(of)
        moved = np.add.reduceat(count, firsts)
        rest = self.size[of[firsts]] - moved
        # the rest keeps name and links, but for a part beside which it is nothing or very small
        largest = np.maximum.reduceat(count, firsts)
        swapped = largest > MUCH * rest
        stays = np.zeros(len(of), bool)
        if swapped.any():
            group = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(of))))
            candidate = np.flatnonzero(swapped[group] & (count == largest[group]))
            stays[candidate[_cuts(group[candidate])]] = True
        some = np.flatnonzero(swapped & (rest > 0))
        others, theirs = self._others(at, old, of[firsts[some]]) if len(some) else (at[:0], at[:0])
        go = np.repeat(~stays, count)
        parts = np.flatnonzero(~stays)
        at, old = np.append(at[go], others), np.append(old[go], theirs)
        sizes, of = np.append(count[parts], rest[some]), np.append(of[parts], of[firsts[some]])
        self.split_off = at
        if not len(at):
            return False
        fresh = self.names + np.arange(len(of))
        self.names += len(of)
        self._grow(self.names)
        self.size[fresh] = sizes
        np.subtract.at(self.size, of, sizes)
        self._unlink(at, old, length)
        names = np.repeat(fresh, sizes)
        self.name[at] = names
        self._link(at, names, length)
        return True

    def _others(self, at: np.ndarray, old: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members of these classes that aren't in ``at``, by class and position, and their classes: links are followed from where ``at`` breaks off."""
        at = at[np.isin(old, classes)]
        self.touched[at] = True
        found = []
        for links in (self.before, self.after):
            step = links[at]
            while len(step := step[step >= 0]) and len(step := step[~self.touched[step]]):
                found.append(step)
                self.touched[step] = True
                step = links[step]
        out = np.concatenate(found)
        self.touched[at] = False
        self.touched[out] = False
        out = out[np.lexsort((out, self.name[out]))]
        return out, self.name[out]

    def _unlink(self, at: np.ndarray, old: np.ndarray, length: int) -> None:
        """Take positions out of their classes' links: each chain of them is bridged at once."""
        order = np.lexsort((at, old))
        at = at[order]
        breaks = self.after[at[:-1]] != at[1:]
        first, last = at[np.concatenate(([True], breaks))], at[np.concatenate((breaks, [True]))]
        left, right = self.before[first], self.after[last]
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        self._note(left[left >= 0], length)


def find_runs(symbols: np.ndarray, ends: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs, by start and period.

    ``symbols``: the words of texts one behind the other as numbers from 0, words of
    other texts being other numbers, and behind each text a number of its own;
    ``ends``: where those stand.
    """
    words = np.diff(np.concatenate(([-1], ends))) - 1
    limit = np.repeat(words // exponent, words + 1)
    classes, length, found = _Classes(symbols, limit), 1, []
    while True:
        at = classes.squares(length)
        if len(at):
            first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
            size = np.diff(np.append(first, len(at))) - 1 + 2 * length
            good = size >= max(least, exponent * length)
            found.append(np.stack([at[first][good], size[good], np.full(good.sum(), length)], axis=1))
        if not classes.due or not classes.refine(length):
            break
        length += 1
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, given as its words; starts count from the text's first word."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1) - 1
    numbers, _ = pd.factorize(np.array([w for t in texts for w in (*t, b"")], object))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    # words of other texts are other symbols
    order = np.lexsort((numbers, text))
    same = (numbers[order][1:] == numbers[order][:-1]) & (text[order][1:] == text[order][:-1])
    symbols = np.zeros(len(numbers), np.int64)
    symbols[order] = np.cumsum(np.concatenate(([0], ~same)))
    found = find_runs(symbols, ends)
    starts = ends - lengths
    of = np.searchsorted(ends, found[:, 0])
    found[:, 0] -= starts[of]
    return np.split(found, np.searchsorted(of, np.arange(1, len(texts))))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _batches(texts: list[list[bytes]], most: int = BATCH):
    batch, size = [], 0
    for words in texts:
        if batch and size + len(words) > most:
            yield batch
            batch, size = [], 0
        batch.append(words)
        size += len(words)
    if batch:
        yield batch


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) of every document.

    ``runs``: array of (start, length, period), by start and period, counted in
    words from 0; ``collapsed``: the words that stay when every run keeps its first
    period only, joined by one space.
    """
    run = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", run), T.StructField("collapsed", T.StringType())])
    triple = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])

    def of_batch(keys, texts):
        words = [(t or "").encode().split() for t in texts.to_pylist()]
        runs = [r for batch in _batches(words) for r in runs_of(batch)]
        flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
        triples = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(triple))
        lists = pa.ListArray.from_arrays(pa.array(offsets), triples, type=pa.list_(pa.field("element", triple, False)))
        left = [b" ".join(w if not len(r) else [x for x, stays in zip(w, kept(len(w), r).tolist()) if stays]).decode() for w, r in zip(words, runs)]
        return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in words], pa.int64()), lists, pa.array(left, pa.string())], names=schema.names)

    def of_task(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield of_batch(part.column(0), part.column(1))

    return docs.select(F.col(key), F.col(text)).mapInArrow(of_task, schema)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The longest run and the digests of all runs and of the collapsed text, of what periodic_runs() returns."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a periodic end in a tenth of the documents, by the CRC-32 of their keys; a document with a null key stays as it is."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    words = docs.select(F.col(key), F.col(text).alias("text"), h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    sized = words.withColumns({"n": n, "a": F.when(n > 0, (g % n).cast("int"))})
    sized = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    period, left = F.slice("w", F.col("a") + 1, F.col("p")), F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    return sized.select(key, F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))
