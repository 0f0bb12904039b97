"""Content-defined partition of fixed-length windows.

Every window of ``width`` symbols is given to one *anchor*: the leftmost
position, inside the window, of the smallest hashed k-gram.  The choice depends
on the window's own content only, so equal windows always have equal anchors at
equal offsets, wherever they stand.  Consecutive windows with the same anchor
form one *stretch*; a sequence of n symbols has about 2 n / (width - k) of them.

Grouping stretches by the anchor's k-gram therefore brings together all
occurrences of every repeated window while moving one small row per stretch
instead of one per window.  Where one anchor has very many different stretches, its windows
are compared one by one instead, by their content (``window_hits``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored

#: Windows of a stretch, as places in a stretch are packed into a byte; windows worked on at once.
MOST_WINDOWS, BLOCK = 255, 1 << 20
_MULT = 0x9E3779B97F4A7C15


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2**64, mixed) of every k-gram of ``symbols``."""
    n = len(symbols)
    if n < k:
        return np.zeros(0, np.uint64)
    block, length = symbols.astype(np.uint64), 1
    total, used = None, 0
    rest = k
    while rest:
        if rest & 1:
            if total is None:
                total, used = block, length
            else:
                shift = np.uint64(pow(_MULT, length, 1 << 64))
                m = len(total) - length
                total, used = total[:m] * shift + block[used : used + m], used + length
        rest >>= 1
        if rest:
            shift = np.uint64(pow(_MULT, length, 1 << 64))
            block = block[:-length] * shift + block[length:]
            length *= 2
    out = total[: n - k + 1].copy()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _of_block(symbols: np.ndarray, width: int, k: int):
    grams = gram_hashes(symbols, k)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - k + 1, 1
    low = packed
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return grams[at[first]], first, np.diff(np.append(first, len(at))), at[first]


def stretches(symbols: np.ndarray, width: int, k: int):
    """(core hash, first window, number of windows, anchor) of every stretch.

    Empty when the sequence is shorter than ``width``.  Long sequences are worked
    through in blocks of BLOCK windows, so that memory beside the symbols stays
    bounded; a stretch that two blocks share is put together again.
    """
    if width - k + 1 > MOST_WINDOWS:
        raise ValueError(f"windows of {width} symbols need anchors of {width + 1 - MOST_WINDOWS} or more")
    n = len(symbols)
    if n < width:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    found = []
    for start in range(0, n - width + 1, BLOCK):
        core, first, count, anchor = _of_block(symbols[start : min(n, start + BLOCK + width - 1)], width, k)
        found.append((core, first + start, count, anchor + start))
    if len(found) == 1:
        return found[0]
    core, first, count, anchor = map(np.concatenate, zip(*found))
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return core[new], first[new], np.add.reduceat(count, new), anchor[new]


def window_rows(given: DataFrame, cut, width: int) -> DataFrame:
    """(core, seg, doc, i, wa, wb): the windows of the ``wanted`` stretches (core, seg, doc) of each text, with 128 bits of their content.

    ``cut`` gives of a text (core, first window, number of windows, seg as
    unsigned) of its stretches and the bytes of a window by its place.
    """

    def run(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                want = {(w["core"], w["seg"]): w["doc"] for w in wanted}
                near = {c for c, _ in want}
                core, first, count, seg, window = cut(text)
                for c, a, n in zip(core.view(np.int64).tolist(), first.tolist(), count.tolist()):
                    if c in near and (doc := want.pop((c, seg(a, n)), None)) is not None:
                        out += [(c, seg(a, n), doc, i, *np.frombuffer(xxhash.xxh3_128_digest(window(a + i)), np.int64).tolist()) for i in range(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["core", "seg", "doc", "i", "wa", "wb"])

    return given.mapInArrow(run, "core bigint, seg bigint, doc bigint, i bigint, wa bigint, wb bigint")


def window_hits(windows: DataFrame, least_wins: bool) -> DataFrame:
    """(core, seg, found): windows, as bits, that are also in another stretch, or if ``least_wins`` in one of a smaller doc.

    Counting is by the windows' content, combined before the shuffle, so that no
    anchor, however common, makes a large group; the counts are stored before the
    windows meet them, so that Spark can split a window that many stretches have.
    """
    same = stored(windows.groupBy("wa", "wb").agg(F.count("*").alias("n"), F.min("doc").alias("least")).filter("n > 1"), "again")
    hits = windows.join(same, ["wa", "wb"])
    hits = hits.filter("least < doc") if least_wins else hits
    bits = F.transform(F.sequence(F.lit(0), F.lit(MOST_WINDOWS // 8)), lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, k: s + F.when(F.array_contains("at", (b * 8 + k).cast("long")), F.call_function("shiftleft", F.lit(1), 7 - k)).otherwise(0)))
    packed = F.unhex(F.array_join(F.transform(bits, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return hits.groupBy("core", "seg").agg(F.collect_set("i").alias("at")).select("core", "seg", packed.alias("found"))
