import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import conversation_repair as R
from attesta.llm.queries import QUERIES

ROLES = ["system", "user", "assistant", "tool", "", " ", "support", "agent"]


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by comparing whole strings; the last initial of the output so far is the state."""

    @cache
    def best(i, last, inserted):
        out = []
        if i == len(rows) and last in ("", "a"):
            out.append((0, "", ()))
        for role in ("user", "assistant"):
            if allowed(last, role[0]) and inserted < 3:
                cost, audit, rest = best(i, role[0], inserted + 1)
                out.append((cost + 5, "I" + audit, ((role, ""), *rest)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, rest = best(i + 1, last, 0)
            out.append((cost + 2, "D" + audit, rest))
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                for label, to, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                    if allowed(last, to[:1]):
                        cost, audit, rest = best(i + 1, to[:1], 0)
                        out.append((cost + price + more, label + audit, ((to, text), *rest)))
        return min(out, default=(1 << 40, "", ()))

    def allowed(last, initial):
        return initial != "" and last + initial in ("s", "u", "su", "ua", "au")

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


CODES = {None: R.SOUND, "truncated": R.CUT_OFF, "blank": R.BLANK, "duplicate": R.AGAIN}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(list(CODES))), max_size=9))
def test_paths_equal_brute_force(rows):
    machine = R.Composition()
    cost, audit, _ = cheapest([(role, "x", fault) for role, fault in rows])
    assert machine.cheapest(bytes(R.symbol_of(role, CODES[fault]) for role, fault in rows)) == (cost, audit)


def test_composition_stays_small():
    dice, machine = random.Random(1), R.Composition()
    for _ in range(300):
        machine.cheapest(bytes(dice.randrange(16) for _ in range(dice.randint(0, 200))))
    vectors = len(machine.vectors)
    cost, audit = machine.cheapest(bytes(dice.randrange(16) for _ in range(300_000)))
    assert vectors < 200 and len(machine.vectors) <= vectors + 10 and len(audit) >= 300_000 and cost > 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(table):
    """The contract, conversation by conversation; rows of one turn by role and by digest of text."""
    convs = {}
    for conv, turn, role, text in table:
        own = convs.setdefault(conv, [])
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()[:16]))
        known = [r[0] for r in rows if r[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        marked = faults([(role, text) for _, role, text in rows])
        of = lambda kind: sum(f == kind for *_, f in marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, made = cheapest(marked)
        out.append((conv, gaps, of("blank"), of("duplicate"), of("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in made))))
    return out


def check(spark, tmp_path, table):
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string, late int, row string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected([r[:4] for r in table]), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    dice, table = random.Random(5), []
    texts = ["Hi.", "Well", "ok?", "", " \t\n", "No!", "…", "End. \n", "å.", None]
    for conv in range(150):
        for turn in range(dice.randint(1, 9)):
            table.append((conv, turn, dice.choice(["system", *["user", "assistant"] * 4, "tool", None, ""]), dice.choice(texts), 1, "x"))
    table += [(None, t, "user" if t % 2 else "assistant", "Yes." * t, 1, "x") for t in range(12)]
    table += [(500, None, r, t, 1, "x") for r in ("user", "assistant", None) for t in ("A.", None)]
    table += [(501, t, "user", "Again.", 1, "x") for t in (0, 0, 0, 5, None, 9, 5)]
    check(spark, tmp_path, table)


def test_dropped_conversations_and_long_ones(spark, tmp_path):
    gone = [c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:5]
    table = [(c, 0, "user", "Hi.", 1, "x") for c in gone] + [(-1, t, "user" if t % 2 else "assistant", f"{t}." if t % 7 else "cut", 1, "x") for t in range(150)]
    table += [(-2, 3, "user", "long " * 300_000 + ".", 1, "x"), (-2, 4, "assistant", "long " * 300_000, 1, "x")]
    check(spark, tmp_path, table)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert R.report(turns).collect() == []


@pytest.mark.parametrize("rows, audit, roles", [([("user", "Hi."), ("assistant", "cut")], "KK", ["user", "assistant"]), ([("assistant", "A."), ("user", "B.")], "DD", [])])
def test_repaired_rows(spark, rows, audit, roles):
    turns = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    audited = R.audits(turns)
    assert audited.first().audit == cheapest(faults(rows))[1]
    got = R.repaired(turns, audited).collect()
    assert [r.role for r in got] == [r for r, _ in cheapest(faults(rows))[2]]
