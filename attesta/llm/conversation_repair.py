"""Structure repair of conversations by weighted finite-state composition.

Three machines are composed.  The input acceptor reads a conversation's rows in
order, each as a symbol: the initial of its role and its fault.  The edit
transducer keeps, re-roles or deletes a row, or inserts an empty one; its states
count the insertions since the last row, of which INSERTS are ever worth their
cost, as a third one would come back to a role state.  The role acceptor takes
``(s?(ua)+)?``.

A state of the composition is (row, insertions, role state), and arcs go to more
rows or more insertions, so it has no cycle.  Shortest distances to the end are
taken in reverse topological order with lexicographic weights (cost, labels).
The arcs that leave a state have different labels, so of arcs of one cost the
first label decides which label string is least.

Composition is lazy: the distances of a row's states, less their least, depend
only on the row's symbol and on the distances behind it, and there are few such
vectors.  Each is computed when a conversation first needs it, with the best arc
of each state, and kept.  A row then costs one look-up back and one forth, and
a conversation some three bytes a row; texts stream.

A row's first fault counts: blank (no character but white space), duplicate
(role and text of an earlier row), truncated (its last character that isn't
white space ends no sentence).

Rows: a null role or text counts as one space; rows of one turn, null turns
first, are ordered by role, then by hash of text, repeated rows side by side;
rows whose conv_id is null form one conversation; texts of any length are read
whole; a conversation is read by one task, as its digest is sequential, but
copies of rows and first sightings are counted before; a table without rows
gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attesta.llm.common import stored

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
INSERTS = 2
SPACES = " \t\n\x0b\f\r"

#: Faults of a row.
SOUND, CUT_OFF, BLANK, AGAIN = range(4)

#: The role acceptor: for each state, where an initial leads.
ROLES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
STATES = [(e, g) for e in range(INSERTS + 1) for g in range(len(ROLES))]
AT = {s: k for k, s in enumerate(STATES)}
#: A row's symbol is a number: the place of its initial (the last: any other), four times, and its fault.
INITIALS = "sua-"


def symbol_of(role: str, fault: int) -> int:
    return 4 * INITIALS.find(role[:1] if role[:1] in ("s", "u", "a") else "-") + fault


def rerole_target(g: int) -> str:
    """The one role among user and assistant that may follow."""
    return "u" if "u" in ROLES[g] else "a"


def arcs(symbol: int | None, state: tuple[int, int]):
    """(label, cost, next state, whether a row is read) that leave a state in front of a row, or behind the last."""
    e, g = state
    if symbol is not None:
        initial, fault = INITIALS[symbol // 4], symbol % 4
        yield "D", DELETE, (0, g), True
        if fault not in (BLANK, AGAIN):
            stays = TRUNCATED if fault == CUT_OFF else 0
            if initial in ROLES[g]:
                yield "K", KEEP + stays, (0, ROLES[g][initial]), True
            yield "R", REROLE + stays, (0, ROLES[g][rerole_target(g)]), True
    if e < INSERTS:
        yield "I", INSERT, (e + 1, ROLES[g][rerole_target(g)]), False


class Composition:
    """The composed machine, as far as conversations have asked for it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.known: dict[tuple[int, int], tuple[int, int, tuple]] = {}
        end = [0 if g in ACCEPTED else NEVER for _, g in STATES]
        self.end, self.end_cost, self.end_arcs = self._relax(None, None, end)

    def _relax(self, symbol, behind, distance=None):
        """(vector, what was taken off it, best arcs) of a row with this symbol in front of vector ``behind``."""
        distance = distance or [NEVER] * len(STATES)
        best: list = [None] * len(STATES)
        # arcs that read no row lead to more insertions: those states come first
        for e, g in reversed(STATES):
            k = AT[e, g]
            for label, cost, to, reads in sorted(arcs(symbol, (e, g))):
                total = cost + (self.vectors[behind][AT[to]] if reads else distance[AT[to]])
                if total < distance[k]:
                    distance[k], best[k] = total, (label, AT[to], reads)
        least = min(distance)
        vector = tuple(min(d - least, NEVER) for d in distance)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least, tuple(best)

    def before(self, symbol: int, behind: int):
        found = self.known.get((symbol, behind))
        if found is None:
            found = self.known[symbol, behind] = self._relax(symbol, behind)
        return found

    def cheapest(self, symbols: bytes) -> tuple[int, str]:
        """Cost and label string of the shortest path for a conversation's rows."""
        number, cost, back = self.end, self.end_cost, array("H", [self.end])
        for symbol in reversed(symbols):
            number, more, _ = self.before(symbol, number)
            cost += more
            back.append(number)
        cost += self.vectors[number][AT[0, 0]]
        labels, k = bytearray(), AT[0, 0]
        for n, symbol in enumerate(symbols):
            best, reads = self.before(symbol, back[len(symbols) - n - 1])[2], False
            while not reads:
                label, k, reads = best[k]
                labels += label.encode()
        while self.end_arcs[k]:
            label, k, _ = self.end_arcs[k]
            labels += label.encode()
        return cost, labels.decode()


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, late, turn, role, digest, text): rows with no null role or text, and what orders them."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    at = F.col("turn").cast("long")
    return turns.select("conv_id", at.isNotNull().alias("late"), F.coalesce(at, F.lit(0)).alias("turn"), role.alias("role"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"), text.alias("text"))


def fault_of(text: Column) -> Column:
    """Blank, truncated or sound, by the text alone."""
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)


def symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, late, turn, role, digest, fault, copies, first): distinct rows without texts.

    ``first``: no row of an earlier turn says the same.  Copies are counted and
    first sightings found by aggregations that combine before they shuffle, and
    meet by keys that are distinct, so no conversation or text is gathered.
    """
    order = ["late", "turn"]
    rows = marked(turns).groupBy("conv_id", "role", "digest", *order).agg(F.first(fault_of(F.col("text"))).alias("fault"), F.count("*").alias("copies"))
    first = marked(turns).groupBy("conv_id", "role", "digest").agg(F.min(F.struct(*order)).alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("least.late").alias("l"), F.col("least.turn").alias("t"))
    same = rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"]) & (rows["late"] == first["l"]) & (rows["turn"] == first["t"])
    return rows.join(first, same, "left").select(*rows.columns, first["r"].isNotNull().alias("first"))


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation with a row.

    ``audit`` has the initials of the cheapest edits in order: K(eep), R(erole),
    D(elete), I(nsert); ``illegal`` counts neighbouring rows whose roles' initials
    aren't su, ua or au.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("audit", T.StringType())])

    def of_conversation(machine, rows):
        read, counts, seen, previous, illegal, low, high, last = bytearray(), [0] * 4, 0, None, 0, None, None, None
        for _, late, turn, role, fault, copies, first in rows:
            initial = role[:1]
            if late and turn != last:
                low, high, last, seen = turn if low is None else low, turn, turn, seen + 1
            for n in range(copies):
                now = BLANK if fault == BLANK else fault if first and not n else AGAIN
                counts[now] += 1
                illegal += previous is not None and previous + initial not in ("su", "ua", "au")
                previous = initial
                read.append(symbol_of(role, now))
        gaps = high - low + 1 - seen if low is not None else 0
        return (gaps, counts[BLANK], counts[AGAIN], counts[CUT_OFF], illegal, *machine.cheapest(read))

    def of_task(batches):
        machine, kinds = Composition(), None
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        done = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            done.append((conv, *of_conversation(machine, own)))
            if len(done) == 1000:
                yield batch_of(done)
                done = []
        if done:
            yield batch_of(done)

    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

    of = symbols(turns).repartition("conv_id").sortWithinPartitions("conv_id", "late", "turn", "role", "digest")
    return of.select("conv_id", "late", "turn", "role", "fault", "copies", "first").mapInArrow(of_task, schema)


def repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, inserted ones with empty texts.

    An audit travels in front of its conversation's rows, so neither is joined to
    the other and texts stream; rows come out in order, conversation by conversation.
    """
    schema = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edit", "role", "text"))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def of_conversation(rows):
        """Edits as the audit says; an insertion stands in front of the row that is read next."""
        _, audit, _, _ = next(rows)
        place, g = 0, 0
        for edit in audit:
            role, text = (None, "") if edit == "I" else next(rows)[2:]
            if edit == "D":
                continue
            if edit != "K":
                role = NAMES[rerole_target(g)]
            g = ROLES[g][role[:1]]
            yield place, edit, role, text
            place += 1

    def of_task(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        done, size = [], 0
        for conv, own in groupby(rows, key=lambda r: r[0]):
            for row in of_conversation(own):
                done.append((conv, *row))
                size += len(row[-1]) + 50
                if size > 1 << 20:
                    yield batch_of(done)
                    done, size = [], 0
        if done:
            yield batch_of(done)

    def batch_of(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

    said = marked(turns).select("conv_id", F.lit(True).alias("row"), "late", "turn", "role", "digest", F.lit(None).cast("string").alias("audit"), "text")
    heads = audited.select("conv_id", F.lit(False).alias("row"), F.lit(False).alias("late"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), "audit", F.lit(None).cast("string").alias("text"))
    of = said.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "row", "late", "turn", "role", "digest")
    return of.select("conv_id", "audit", "role", "text").mapInArrow(of_task, schema)


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired()'s rows as they come: `role:text` lines, joined by newlines.  A conversation without rows has none."""
    schema = T.StructType([T.StructField("conv_id", edited.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def of_task(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        done = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            digest = hashlib.sha256()
            for _, place, role, text in own:
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            done.append((conv, digest.hexdigest()))
            if len(done) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=schema.names)

    return edited.select("conv_id", "place", "role", "text").mapInArrow(of_task, schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fault in a quarter of the rows, by the CRC-32 of `conv_id:turn`: dropped, emptied, without sentence ends, repeated, said by the user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, blank) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def report(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation of ``turns``, damaged first; one whose rows all went has zeros."""
    hurt = damaged(turns)
    found = stored(audits(hurt), "audits")
    found = found.join(digests(repaired(hurt, found)).withColumnRenamed("conv_id", "repaired_id"), F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left").drop("repaired_id")
    every = turns.select(F.col("conv_id").alias("every_id")).distinct()
    out = every.join(found, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("every_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
