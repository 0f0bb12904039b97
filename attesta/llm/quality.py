"""Quality rules: learned decision lists over text statistics.

Base rules come first: fewer than MIN_WORDS words, or over MAX_REPEAT percent of
the words in repeated five-word windows.  A decision list judges the rest.  It is
learned by sequential covering: a conjunction of thresholds is grown on two
thirds of the labelled rows until it hits no good document, its last conditions
are pruned by the other third, and what it covers is taken away before the next
one grows.  A conjunction is kept only while at least PRECISION of what it hits
is labelled bad.  The list becomes one ordered Spark conditional expression.

Learning takes at most SAMPLE labelled rows, those with the smallest hash of
their doc_id, and of documents that repeat a doc_id the one with the least
statistics; statistics and verdicts cover every document.

Rows: null text has no words and fails the base rules; labels with a null
doc_id or quality are left out; without labels of both kinds the list is empty
and keeps all; texts of any length are read whole, each by one task; of
conditions of one gain the first in order of statistic, cut and side is taken;
repeated rows give repeated rows; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import hidden, with_fields

#: Fixed values.
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
#: Parameters of learning.
SAMPLE, PRECISION, CUTS, MOST_CONDITIONS, MOST_RULES = 4000, 0.9, 64, 4, 12

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
STATS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
#: Ratio: (numerator, denominator); 0 where the denominator is 0.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "words": ("n_words", None),
}

Condition = tuple[str, str, float]  # feature, <= or >, threshold
Rule = list[Condition]


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # on ASCII white space, \x20 and \x09-\x0D
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    seen, lines, dup = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(grams)) < len(grams):
            counts, end = Counter(grams), 0
            for i, gram in enumerate(grams):
                if counts[gram] > 1:
                    repeated += i + WINDOW - max(end, i)
                    end = i + WINDOW
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return n, word_chars, symbols, dup, repeated, lines, upper, raw.count(b"!") + raw.count(b"?")


def with_stats(docs: DataFrame, name: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all by default) and a struct of the COUNTS of every text."""
    kept = docs.columns if keep is None else keep
    at = hidden(docs, "text")
    given = docs.select(*kept, F.col(text).alias(at))
    schema = with_fields(docs.select(*kept), (name, STATS))

    def run(batches):
        for batch in batches:
            counts = [measure(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            stats = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * len(COUNTS))], names=COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], stats], names=schema.names)

    return given.mapInArrow(run, schema)


def feature(stats: str, name: str) -> Column:
    top, below = FEATURES[name]
    top = F.col(stats)[top].cast("double")
    return top if below is None else F.when(F.col(stats)[below] > 0, top / F.col(stats)[below]).otherwise(F.lit(0.0))


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, side, cut in rule:
        out &= x[name] <= cut if side == "<=" else x[name] > cut
    return out


def cuts_between(values: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring values where the kinds of rows change; the best cut is one of them."""
    found, first = np.unique(np.sort(values), return_index=True)
    if len(found) < 2:
        return found[:0]
    share = np.add.reduceat(bad[np.argsort(values, kind="stable")].astype(float), first) / np.diff(np.append(first, len(values)))
    same = (share[1:] == share[:-1]) & ((share[1:] == 0) | (share[1:] == 1))
    mids = ((found[1:] + found[:-1]) / 2)[~same]
    return mids[np.unique(np.linspace(0, len(mids) - 1, min(len(mids), CUTS)).astype(int))] if len(mids) else mids


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition of the largest FOIL gain until no good row is hit."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p0, n0 = (inside & bad).sum(), inside.sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            for cut in cuts_between(values[inside], bad[inside]):
                low = values <= cut
                for side, chosen in (("<=", inside & low), (">", inside & ~low)):
                    p, n = (chosen & bad).sum(), chosen.sum()
                    if p and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain:
                        best, gain = (name, side, float(cut)), g
        if best is None:
            break
        rule.append(best)
        inside &= covers([best], x, len(bad))
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last conditions while (p - n) / (p + n) over the held-out rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = covers(r, x, len(bad))
        return (2 * (hit & bad).sum() - hit.sum()) / hit.sum() if hit.any() else -1.0

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size]) >= worth(best):
            best = rule[:size]
    return best


def learn(rows: list[dict], target: str = "bad") -> list[Rule]:
    """An ordered list of conjunctions that hit bad rows; every third row is held out for pruning."""
    n = len(rows)
    bad = np.array([bool(r[target]) for r in rows], bool)
    x = {name: np.array([r[name] for r in rows], float) for name in FEATURES}
    held, left, out = np.arange(n) % 3 == 2, np.ones(n, bool), []
    while len(out) < MOST_RULES and (left & bad & ~held).sum() >= 3:
        part = lambda m: {k: v[m] for k, v in x.items()}  # noqa: B023, E731
        rule = grow(part(left & ~held), bad[left & ~held])
        if not rule:
            break
        if (left & held).any():
            rule = prune(rule, part(left & held), bad[left & held])
        hit = left & covers(rule, x, n)
        if (hit & bad).sum() < PRECISION * hit.sum() or (hit & bad).sum() < 3:
            break
        out.append(rule)
        left &= ~hit
    return out


def expression(rules: list[Rule], stats: str) -> Column:
    """True where the list keeps a document: the first conjunction that holds rejects it."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, side, cut in rule:
            holds = holds & ((feature(stats, name) <= cut) if side == "<=" else (feature(stats, name) > cut))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Learn the list from at most ``sample`` labelled rows."""
    some = labels.select(key, "quality").dropna().orderBy(F.xxhash64(key), key, "quality").limit(sample)
    rows = with_stats(docs.select(key, text).join(F.broadcast(some), key), "stats", text, [key, "quality"])
    rows = rows.select(key, (F.col("quality") == 0).alias("bad"), *(feature("stats", f).alias(f) for f in FEATURES))
    one = rows.groupBy(key, "bad").agg(F.min(F.struct(*FEATURES)).alias("x")).select(key, "bad", "x.*")
    got = one.collect() if sample else []
    return learn(sorted((r.asDict() for r in got), key=lambda r: (zlib.crc32(str(r[key]).encode()), str(r))))


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"])


def judged(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the first five COUNTS, base_failed, kept) of every document."""
    rows = with_stats(docs.select(key, text), "stats", text, [key])
    failed = base_failed("stats")
    return rows.select(key, *(F.col("stats")[c].alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), (~failed & expression(rules, "stats")).alias("kept"))


def filtered(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents that base rules and list keep, with their columns as they were."""
    name = hidden(docs, "stats")
    return with_stats(docs, name, text).filter(~base_failed(name) & expression(rules, name)).drop(name)
