"""Repaired conversations against a search over all edits, and grammars against what they stand for."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tideline.llm import queries, turns
from tideline.llm.turns import SYMBOLS, Grammar, better, finish, pair_up, product, repair

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    """First fault of each (role, text), in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """Cheapest edits of (role, text) rows, least in ASCII, by trying all of them; insertions at most three in a row."""
    found = faults(rows)
    best = None
    # edits of each row; insertions before each and at the end
    choices = []
    for (role, _), fault in zip(rows, found):
        own = [("D", None, 3)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            own += [("K", role[:1], extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        choices.append(own)
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*choices):
        for where in itertools.product(inserts, repeat=len(rows) + 1):
            initials = "".join(w + (e[1] or "") for w, e in zip(where, [*edits, ("", "", 0)]))
            if not GOOD.match(initials):
                continue
            cost = sum(e[2] for e in edits) + 2 * sum(map(len, where))
            audit = "".join("I" * len(w) + e[0] for w, e in zip(where, [*edits, ("", "", 0)]))
            if best is None or (cost, audit) < best[:2]:
                names = {"u": "user", "a": "assistant"}
                lines = []
                for w, e, row in zip(where, [*edits, ("", None, 0)], [*rows, ("", "")]):
                    lines += [f"{names[i]}:" for i in w]
                    if e[1] is not None:
                        lines.append(f"{row[0] if e[0] == 'K' else names[e[1]]}:{row[1]}")
                best = (cost, audit, "\n".join(lines))
    return best


def stepped(rows):
    """The same by one state machine for conversations of any length."""
    nexts = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {0: (0, "", ())}

    def more(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                for initial, name in (("u", "user"), ("a", "assistant")):
                    after = nexts.get((initial, state))
                    if after is not None:
                        new = (cost + 2, audit + "I", (*lines, f"{name}:"))
                        states[after] = min(states.get(after, new), new)
        return states

    for (role, text), fault in zip(rows, faults(rows)):
        states, best = more(best), {}
        for state, (cost, audit, lines) in states.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                for initial, name in (("s", None), ("u", "user"), ("a", "assistant")):
                    after = nexts.get((initial, state))
                    if after is not None and role[:1] == initial:
                        options.append((after, (cost + extra, audit + "K", (*lines, f"{role}:{text}"))))
                    elif after is not None and name:
                        options.append((after, (cost + 2 + extra, audit + "R", (*lines, f"{name}:{text}"))))
            for after, new in options:
                best[after] = min(best.get(after, new), new)
    last = more(best)
    cost, audit, lines = min(last[s] for s in (0, 3) if s in last)
    return cost, audit, "\n".join(lines)


def row_of(rows):
    """The whole expected row of [(turn, role, text)] in order."""
    pairs = [(r, t) for _, r, t in rows]
    found = faults(pairs)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, text = stepped(pairs)
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def in_order(rows):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_state_machine_is_the_search_over_all_edits():
    rnd = random.Random(3)
    for _ in range(120):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "no", " ", "Go!"])) for _ in range(rnd.randrange(0, 4))]
        assert stepped(rows) == searched(rows)


@pytest.mark.parametrize("block", [1 << 15, 40])
def test_equal_to_the_state_machine(spark, block):
    rnd = random.Random(block)
    data = {}
    for conv in range(150):
        n = rnd.choice([1, 2, 3, 5, 8, 30])
        roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
        data[conv] = [(rnd.choice([None, *range(n)]), rnd.choice(roles), rnd.choice(["Yes.", "no", " ", "", None, "Go!\n", "é?", "…", f"text {rnd.random()}.", f"cut {rnd.random()}"])) for _ in range(n)]
    # one conversation with a third of all rows, without an id, and one with copies of one row alone
    data[None] = [(k % 400, ("user", "assistant")[k % 2], f"line {k}.") for k in range(1200)]
    data[-1] = [(5, "user", "same.")] * 300
    rows = [(c, t, r, x, "extra") for c, own in data.items() for t, r, x in own]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(6)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair(docs, block=block).collect()}
    assert got == {c: row_of(in_order(own)) for c, own in data.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (1, 2, "assistant", " "), (2, 0, "assistant", "cut")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in repair(docs, keep_turns=True).collect())
    assert got == [(1, 0, "user", "Hello."), (1, 1, "assistant", "Again.")]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    data = {r[0]: [] for r in rows}
    for conv, *row in damage(rows):
        data[conv].append(tuple(row))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair_turns(spark, folder).collect()}
    assert got == {c: row_of(in_order(own)) for c, own in data.items()}


def test_query_keeps_conversations_without_turns(spark, tmp_path):
    # 0:60 is dropped by the damage
    gone = next(t for t in range(1000) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    docs = spark.createDataFrame([(0, gone, "user", "x"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    docs.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_repair_turns(spark, str(tmp_path)).collect()}
    assert got[0] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None][6] in ("D", "DD", "")


def test_empty_table(spark):
    assert repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_grammar_stands_for_its_sequences():
    rnd = np.random.default_rng(4)
    sequences = [rnd.integers(0, rnd.integers(1, SYMBOLS + 1), rnd.integers(1, 60)).astype(np.uint8) for _ in range(80)] + [np.zeros(500, np.uint8)]
    rules, top = pair_up(sequences)

    def spelled(symbol):
        return [symbol] if symbol < SYMBOLS else [s for part in rules[symbol - SYMBOLS] for s in spelled(part)]

    assert [[t for s in own for t in spelled(s)] for own in top] == [s.tolist() for s in sequences]
    assert sum(map(len, top)) + 2 * len(rules) < sum(map(len, sequences))
    # no pair is left twice, overlaps in runs apart
    pairs = [p for own in top for p in zip(own.tolist(), own.tolist()[1:]) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))


def test_rules_share_matrices_that_equal_products_of_their_turns():
    sequences = [bytes([1, 2, 1, 2, 8, 5, 2, 3]), bytes([1, 2, 8, 5, 2, 1]), bytes([0, 1, 2] * 5)]
    grammar = Grammar(sequences)
    assert len(grammar.matrices) > SYMBOLS
    for sequence in sequences:
        line = turns.START
        for symbol in sequence:
            line = product([line], turns.TERMINALS[symbol])[0]
        got = grammar.follow(turns.START, sequence)
        assert [r and (r.cost, r.letters()) for r in got] == [r and (r.cost, r.letters()) for r in line]
        assert finish(got).cost == finish(line).cost


def test_ties_go_to_the_rope_least_in_ascii():
    one, two = turns.Rope(4, None, turns.Rope(2, "I"), turns.Rope(2, "R")), turns.Rope(4, "IK")
    assert better(one, two).letters() == "IK" and better(None, one) is one
