"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Texts are UTF-8 bytes.  A byte is removed if a string of WIDTH bytes that covers
it also starts anywhere else, in the same document or another.

1. The strings of a document are dealt into stretches by content-defined anchors
   (see anchors.py): equal strings have anchors with equal GRAM bytes at equal
   offsets.  Equal stretches are aggregated to one with their number; of two or
   more all strings recur.  Only different stretches whose anchors have equal
   bytes are left to compare.
2. Of those each task sorts the suffixes at its anchors, and the mirrored texts
   before them, into runs.  A run is cut into parts by the anchors' hashes,
   front-coded and exchanged: each string as the length it shares with the one
   before it, and the rest.  Anchors with over MOST_KINDS different stretches take
   no part: their strings are compared by content, spread over all tasks.
3. A loser tree merges the runs of each part.  Strings compare by what they
   share with the last one put out; only where that is equal are bytes read,
   from there on, so a known prefix is never compared again.  The merge leaves
   the sorted order and the lengths that neighbours share.
4. A string with d bytes before its anchor recurs if another stretch is within
   d in the mirrored order and within WIDTH - d in the suffix order: both follow
   from the shared lengths, without a further look at the bytes.

Rows: null text is empty; every row is a document of its own, also one that
repeats another; texts of any length are read whole, in blocks; strings that
tie are equal and go alike; an empty table gives an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.anchors import stretches, window_hits, window_rows
from attesta.llm.common import stored
from attesta.llm.substring_dedup import ROW, at_all_places, covered, keyed, named

#: Fixed value: bytes in a string.
WIDTH = 200
#: Bytes of an anchor; stretches in a run; stretches in a part, on average; different stretches of an anchor that go to one part.
GRAM, RUN, PART, MOST_KINDS = 16, 20_000, 10_000, 100_000


def _cut(text: str | None, width: int):
    raw = (text or "").encode()
    return raw, stretches(np.frombuffer(raw, np.uint8), width, min(GRAM, width))


def _segment(raw: bytes, first: int, count: int, width: int) -> int:
    """64 bits of a stretch's bytes, signed; beside the 64 of its anchor."""
    seg = xxhash.xxh3_64_intdigest(raw[first : first + count + width - 1])
    return seg - (seg >> 63 << 64)


def _stretch_rows(given: DataFrame, width: int) -> DataFrame:
    """(row, mark, core, seg, at): every stretch of every text; at holds its first string and their number."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*ROW, "core", "seg", "at")])

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw, (core, first, count, _) = _cut(text, width)
                if len(core):
                    segs = [_segment(raw, a, n, width) for a, n in zip(first.tolist(), count.tolist())]
                    for k, x in enumerate((np.full(len(core), row), np.full(len(core), mark), core.view(np.int64), np.array(segs, np.int64), first << 8 | count)):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=schema.names)

    return given.select(*ROW, "text").mapInArrow(run, schema)


def shared(strings: list[bytes]) -> np.ndarray:
    """What each of the sorted strings shares with the one before it."""
    lengths = np.array([len(s) for s in strings], np.int64)
    wide = int(lengths.max())
    grid = np.frombuffer(b"".join([s.ljust(wide, b"\0") for s in strings]), np.uint8).reshape(-1, wide)
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        equal = np.concatenate([grid[1:] == grid[:-1], np.zeros((len(strings) - 1, 1), bool)], axis=1).argmin(axis=1)
        out[1:] = np.minimum(equal, np.minimum(lengths[1:], lengths[:-1]))
    return out


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared lengths, lengths and tails of sorted strings of up to 65,535 bytes."""
    lcp = shared(strings)
    tails = b"".join([s[k:] for s, k in zip(strings, lcp.tolist())])
    return lcp.astype(np.uint16).tobytes(), np.array([len(s) for s in strings], np.uint16).tobytes(), tails


def decoded(lcps: bytes, lengths: bytes, tails: bytes):
    """(string, length shared with the one before) of a front-coded run, in order."""
    at, last = 0, b""
    for k, n in zip(np.frombuffer(lcps, np.uint16).tolist(), np.frombuffer(lengths, np.uint16).tolist()):
        last = last[:k] + tails[at : at + n - k]
        at += n - k
        yield last, k


def merge(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """(run, shared length) of the sorted strings of all runs, by a loser tree.

    ``runs`` are iterators of (string, length shared with the one before).
    Strings of one run keep their order; of equal strings, those of the earlier
    run come first.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[bytes | None] = [None] * size
    lcp = [0] * size  # with the last string put out
    for i, r in enumerate(runs):
        head[i] = next(r, (None, 0))[0]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes that with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = lcp[a], lcp[b]
        if p != q:  # the longer share with the last one is the smaller string
            return (a, b) if p > q else (b, a)
        n = min(len(x), len(y))
        differ = int.from_bytes(x[p:n]) ^ int.from_bytes(y[p:n])
        if differ:
            same = n - (differ.bit_length() + 7) // 8
            first = x[same] < y[same]
        else:
            same, first = n, len(x) < len(y) or len(x) == len(y) and a < b
        if first:
            lcp[b] = same
            return a, b
        lcp[a] = same
        return b, a

    losers, winners = [0] * size, [0] * (2 * size)
    winners[size:] = range(size)
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    order, same = [], []
    while head[top] is not None:
        order.append(top)
        same.append(lcp[top])
        head[top], lcp[top] = next(runs[top], (None, 0))
        node = (top + size) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1
    return np.array(order, np.int64), np.array(same, np.int64)


RUN_FIELDS = ["cores", "segs", "r_lcp", "r_len", "r_tail", "l_lcp", "l_len", "l_tail", "l_index"]


def _runs(pairs: DataFrame, width: int, parts: int) -> DataFrame:
    """A row for each sorted run and part: front-coded suffixes at anchors (r) and mirrored texts before them (l)."""
    schema = T.StructType([T.StructField("part", T.LongType())] + [T.StructField(f, T.BinaryType()) for f in RUN_FIELDS])
    gram = min(GRAM, width)

    def coded(found):
        right, left, cores, segs = zip(*found)
        order = np.array(sorted(range(len(found)), key=right.__getitem__))
        low = np.array(cores, np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)  # anchors are chosen by the other bits
        part = low * np.uint64(parts) >> np.uint64(32)
        order = order[np.argsort(part[order], kind="stable")]
        part = part[order]
        edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = order[a:b].tolist()
            back = sorted(range(len(own)), key=lambda k: left[own[k]])
            ids = [np.array([x[i] for i in own], np.int64).tobytes() for x in (cores, segs)]
            rows.append((int(part[a]), *ids, *front_code([right[i] for i in own]), *front_code([left[own[k]] for k in back]), np.array(back, np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names=schema.names)

    def run(batches):
        found: list[tuple[bytes, bytes, int, int]] = []
        for batch in batches:
            for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                want = {(w["core"], w["seg"]) for w in wanted}
                near = {c for c, _ in want}
                raw, (core, first, count, anchor) = _cut(text, width)
                for c, a, n, p in zip(core.view(np.int64).tolist(), first.tolist(), count.tolist(), anchor.tolist()):
                    if c in near:
                        seg = _segment(raw, a, n, width)
                        if (c, seg) in want:
                            want.discard((c, seg))
                            found.append((raw[p : a + n - 1 + width], raw[p : p + gram] + raw[a:p][::-1], c, seg))
                if len(found) >= RUN:
                    yield coded(found)
                    found = []
        if found:
            yield coded(found)

    return pairs.mapInArrow(run, schema)


def recurring(right: np.ndarray, right_len: np.ndarray, left: np.ndarray, left_len: np.ndarray, at_right: np.ndarray, at_left: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each stretch and number d of bytes before its anchor: does its string recur in another stretch?

    right, left: shared lengths in the two sorted orders; at_right, at_left: places of the stretches in them.
    """
    n = len(at_right)
    out = np.zeros((n, width - gram + 1), bool)
    for d in range(width - gram + 1):
        valid = np.flatnonzero((right_len >= width - d) & (left_len >= gram + d))
        if len(valid) < 2:
            continue
        kind = np.cumsum(right < width - d)[at_right[valid]] * (n + 1) + np.cumsum(left < gram + d)[at_left[valid]]
        order = np.argsort(kind, kind="stable")
        same = kind[order][1:] == kind[order][:-1]
        hit = np.zeros(len(valid), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        out[valid[hit], d] = True
    return out


def _merged(runs: DataFrame, width: int) -> DataFrame:
    """(core, seg, found): the strings of each stretch that recur in another stretch, as bits."""
    schema = T.StructType([T.StructField("core", T.LongType()), T.StructField("seg", T.LongType()), T.StructField("found", T.BinaryType())])
    gram = min(GRAM, width)

    def part(blocks):
        ids = [np.concatenate([np.frombuffer(b[f], np.int64) for b in blocks]) for f in ("cores", "segs")]
        sizes = [len(b["cores"]) // 8 for b in blocks]
        base = np.cumsum([0, *sizes[:-1]])
        indices = [np.frombuffer(b["l_index"], np.int32).astype(np.int64) + o for b, o in zip(blocks, base.tolist())]
        sides = []
        for side in "rl":
            order, lcp = merge([decoded(b[side + "_lcp"], b[side + "_len"], b[side + "_tail"]) for b in blocks])
            # the strings of a run come in its order
            member, length = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            for k, b in enumerate(blocks):
                own = np.flatnonzero(order == k)
                member[own] = np.arange(sizes[k]) + base[k] if side == "r" else indices[k]
                length[member[own]] = np.frombuffer(b[side + "_len"], np.uint16)
            place = np.empty(len(order), np.int64)
            place[member] = np.arange(len(order))
            sides.append((lcp, length, place))
        (right, right_len, at_right), (left, left_len, at_left) = sides
        hits = recurring(right, right_len, left, left_len, at_right, at_left, width, gram)
        some = np.flatnonzero(hits.any(axis=1))
        found = []
        for s in some.tolist():  # the first string of a stretch has most bytes before the anchor
            before, behind = int(left_len[s]) - gram, width - int(right_len[s])
            found.append(np.packbits(hits[s, behind : before + 1][::-1]).tobytes())
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][some]), pa.array(ids[1][some]), pa.array(found, pa.binary())], names=schema.names)

    def run(batches):
        blocks: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if blocks and blocks[0]["part"] != row["part"]:
                    yield from part(blocks)
                    blocks = []
                blocks.append(row)
        if blocks:
            yield from part(blocks)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _windows(pairs: DataFrame, text: str, width: int) -> DataFrame:
    """The strings of the ``wanted`` stretches of ``pairs`` (text, wanted), see window_rows."""

    def cut(value):
        raw, (core, first, count, _) = _cut(value, width)
        return core, first, count, lambda a, n: _segment(raw, a, n, width), lambda i: raw[i : i + width]

    return window_rows(pairs.select(text, "wanted"), cut, width)


def _removals(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(row, mark, cuts): the strings to remove of each text that has any."""
    given = docs.select(*named(key, text), F.col(text).alias("text"))
    parts = stored(_stretch_rows(given, width), "stretches")
    distinct = parts.groupBy("core", "seg").agg(F.count("*").alias("n"), F.min(F.struct(*ROW)).alias("least")).select("core", "seg", "n", "least.*")
    kinds = distinct.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    known = stored(distinct.join(kinds, "core", "left").filter("kinds > 1 OR n > 1"), "recurring")
    texts = keyed(docs, key, text)
    wanted = lambda which: texts.join(known.filter(which).groupBy(*ROW).agg(F.collect_list(F.struct("core", "seg", F.lit(0).cast("long").alias("doc"))).alias("wanted")), ROW)
    few, hot = f"kinds BETWEEN 2 AND {MOST_KINDS}", f"kinds > {MOST_KINDS}"
    found = _merged(_runs(wanted(few).select(key, text, "wanted"), width, 1 + known.filter(few).count() // PART), width)
    if not known.filter(hot).isEmpty():
        found = found.unionByName(window_hits(stored(_windows(wanted(hot), text, width), "windows"), False))
    marked = known.select("core", "seg", "n").join(found, ["core", "seg"], "left").filter("n > 1 OR found IS NOT NULL")
    often = known.select("core", "seg", "n", F.lit(None).cast("binary").alias("found"))  # these recur as a whole, no merge is needed
    hits = at_all_places(parts, marked.select("core", "seg", "n", F.when(F.col("n") == 1, F.col("found")).alias("found")), known, often)
    return hits.groupBy(*ROW).agg(F.collect_set(F.struct("at", "found")).alias("cuts"))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    cuts = _removals(docs, key, text, width)
    given = keyed(docs, key, text).join(cuts, ROW, "left").select(key, text, "cuts")
    kinds = [T.StructField(key, docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*kinds, T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for batch in batches:
            counts, shas = [], []
            for value, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (value or "").encode()
                gone = covered(len(raw), cut, width) if cut else np.zeros(0, bool)
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if cut else 0
                counts.append((len(raw), int(gone.sum()), spans))
                shas.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes() if cut else raw).hexdigest())
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(shas, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema)


def kept_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, kept binary): what stays of every text; bytes, as a cut may part a character."""
    cuts = _removals(docs, key, text, width)
    given = keyed(docs, key, text).join(cuts, ROW, "left").select(key, text, "cuts")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            out = []
            for value, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer((value or "").encode(), np.uint8)
                out.append(raw[~covered(len(raw), cut, width)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return given.mapInArrow(run, schema)
