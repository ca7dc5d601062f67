"""Repair of conversations by dynamic programming over a grammar of their turns.

A turn is one of nine symbols: whom its role stands for (system, user, assistant, other), whether it is truncated, or that
it has to go (blank, or a duplicate of an earlier turn). Edits lead through four states (nothing yet, after system, after user,
after assistant). A symbol is a matrix of the cheapest edits from state to state; sequences of symbols are min-plus products.

1. Turns lose their texts at the scan: flags and a digest remain. Equal rows of one turn are counted, a turn is a duplicate if
   its role and digest have an earlier turn, and rows are dealt by ranges of (conversation, turn, ...), so that one
   conversation with a third of all rows is many segments, strings of symbols with the counts of their turns.
2. A task takes segments in blocks and compresses the distinct ones by Re-Pair: the most frequent pair of symbols becomes a rule
   until no pair is left twice. Each rule has one matrix, the product of its two symbols, made once and used by all
   conversations of the block. An entry has a cost and a rope, its edits as a tree over the rules' ropes; the least rope
   wins a tie. Every rope ends with an edit of a turn, insertions stand in front of it, so no rope of a stretch is the
   beginning of another one and the least of a product is the product of the least.
3. The edits of a conversation travel with its texts, sorted by turn, and one reader applies them as the texts pass by. A
   digest of a whole conversation has to be made in order; its texts are streamed, never held together.

Defined cases: a null role or text is one blank, a null turn comes first, rows of one turn are taken by role, then by the
digest of their text; rows without a conversation id are one conversation; roles count by their first letter; an empty table has
no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.shared import small_batches, written

#: symbols: initial + 4 if truncated, with initials s, u, a and any other; GONE has to go
INITIALS = ("s", "u", "a")
GONE = 8
SYMBOLS = 9
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
#: next state of user, assistant and system turns; states are: nothing yet, after system, after user, after assistant
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
STATES = 4
#: pairs of initials that may stand beside each other
LEGAL = ("su", "ua", "au")
#: the first fault of a turn
FINE, BLANK, DUPLICATE, CUT = 0, 1, 2, 4
#: symbols that are compressed together
BLOCK = 1 << 15
BLANKS = " \t\n\x0b\x0c\r"


class Rope:
    """Edits with their cost; a leaf has letters, an inner node two parts."""

    __slots__ = ("cost", "left", "right", "text")

    def __init__(self, cost: int, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.cost, self.text, self.left, self.right = cost, text, left, right

    def letters(self) -> str:
        if self.text is None:
            parts, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.text is None:
                    todo += [rope.right, rope.left]
                else:
                    parts.append(rope.text)
            self.text = "".join(parts)
            self.left = self.right = None
        return self.text


def join(one: Rope, two: Rope) -> Rope:
    return Rope(one.cost + two.cost, None, one, two)


def better(one: Rope | None, two: Rope | None) -> Rope | None:
    """The cheaper of two ropes, of equal ones the one least in ASCII."""
    if one is None or two is None:
        return two if one is None else one
    if one.cost != two.cost:
        return one if one.cost < two.cost else two
    return one if one.letters() <= two.letters() else two


Matrix = list[list[Rope | None]]


def product(one: Matrix, two: Matrix) -> Matrix:
    out: Matrix = []
    for row in one:
        line = []
        for j in range(STATES):
            best = None
            for k in range(STATES):
                if row[k] is not None and two[k][j] is not None:
                    best = better(best, join(row[k], two[k][j]))
            line.append(best)
        out.append(line)
    return out


def insertions() -> Matrix:
    """Cheapest insertions from state to state."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        state, n = start, 0
        while state is not None and out[start][state] is None:
            out[start][state] = Rope(n * INSERT, "I" * n)
            state, n = _NEXT.get(("u", state), _NEXT.get(("a", state))), n + 1
    return out


def terminal(symbol: int) -> Matrix:
    """Insertions, then the edit of one turn."""
    edits: Matrix = [[None] * STATES for _ in range(STATES)]
    extra = TRUNCATED if symbol % GONE >= 4 else 0
    for state in range(STATES):
        edits[state][state] = Rope(DELETE, "D")
        if symbol == GONE:
            continue
        for role in INITIALS:
            after = _NEXT.get((role, state))
            if after is None:
                continue
            if symbol % 4 < 3 and INITIALS[symbol % 4] == role:
                edits[state][after] = better(edits[state][after], Rope(KEEP + extra, "K"))
            elif role != "s":
                edits[state][after] = better(edits[state][after], Rope(REROLE + extra, "R"))
    return product(insertions(), edits)


TERMINALS = [terminal(s) for s in range(SYMBOLS)]


def pair_up(sequences: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: rules (left, right), the first of which is symbol ``SYMBOLS``, and the sequences written with them."""
    data = np.concatenate([np.append(s.astype(np.int64), -1) for s in sequences]) if sequences else np.zeros(0, np.int64)
    rules: list[tuple[int, int]] = []
    while data.size > 2:
        left, right = data[:-1], data[1:]
        at = np.flatnonzero((left >= 0) & (right >= 0))
        codes = (left[at] << 32) | right[at]
        values, counts = np.unique(codes, return_counts=True)
        if not counts.size or counts.max() < 2:
            break
        code = int(values[counts.argmax()])
        one, two = code >> 32, code & 0xFFFFFFFF
        at = at[codes == code]
        if one == two:
            # in a run of one symbol every second place begins a pair
            head = np.append(True, np.diff(at) != 1)
            begin = np.maximum.accumulate(np.where(head, np.arange(at.size), 0))
            at = at[(np.arange(at.size) - begin) % 2 == 0]
        data = data.copy()
        data[at] = SYMBOLS + len(rules)
        data = np.delete(data, at + 1)
        rules.append((one, two))
    ends = np.flatnonzero(data == -1)
    return rules, [data[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]


class Grammar:
    """The distinct sequences of a block with one matrix a rule."""

    def __init__(self, sequences: list[bytes]):
        self.place = {s: k for k, s in enumerate(dict.fromkeys(sequences))}
        rules, self.top = pair_up([np.frombuffer(s, np.uint8) for s in self.place])
        self.matrices = list(TERMINALS)
        for one, two in rules:
            self.matrices.append(product(self.matrices[one], self.matrices[two]))
        self.known: dict[bytes, list[Rope | None]] = {}

    def follow(self, states: list[Rope | None], sequence: bytes) -> list[Rope | None]:
        """Best edits up to each state after one more segment."""
        fresh = states is START
        if fresh and sequence in self.known:
            return self.known[sequence]
        line = states
        for symbol in self.top[self.place[sequence]].tolist():
            line = product([line], self.matrices[symbol])[0]
        if fresh:
            self.known[sequence] = line
        return line


START: list[Rope | None] = [Rope(0, ""), None, None, None]
_LAST = insertions()


def finish(states: list[Rope | None]) -> Rope:
    """Best edits of a whole conversation: it ends empty or after an assistant."""
    best = states[0]
    for state in (1, 2, 3):
        if states[state] is not None:
            best = better(best, join(states[state], _LAST[state][3]))
    return best


def _runs(*columns: np.ndarray) -> np.ndarray:
    """First rows of runs of equal values in all columns."""
    size = columns[0].size
    head = np.zeros(size, bool)
    head[:1] = True
    for c in columns:
        head[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(head)


_SEGMENT = "part long, n long, codes binary, blank long, duplicate long, truncated long, illegal long, head int, tail int, first long, last long, turns long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted light rows into segments, the turns of one conversation in one batch; equal rows are never cut."""
    part, number = TaskContext.get().partitionId(), 0
    legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL]
    for batch in batches:
        conv, turns = batch.column(0), np.asarray(batch.column(1).fill_null(0))
        known = np.asarray(batch.column(1).is_valid())
        initial, fault, n = (np.asarray(batch.column(k)).astype(np.int64) for k in (2, 3, 4))
        owner = np.asarray(conv.dictionary_encode(null_encoding="encode").indices)
        bounds = [*_runs(owner).tolist(), owner.size]
        rows = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            k = slice(a, b)
            first = np.cumsum(n[k]) - n[k]
            who = np.repeat(initial[k], n[k])
            # the copies of a row are blank with it, else duplicates of its first
            faults = np.repeat(np.where(fault[k] == BLANK, BLANK, DUPLICATE), n[k])
            faults[first] = fault[k]
            codes = np.where((faults == BLANK) | (faults == DUPLICATE), GONE, who + 4 * (faults == CUT)).astype(np.uint8)
            illegal = ~np.isin(who[:-1] * 4 + who[1:], legal)
            mine = turns[k][known[k]]
            ends = (int(mine[0]), int(mine[-1])) if mine.size else (None, None)
            counts = [int((faults == f).sum()) for f in (BLANK, DUPLICATE, CUT)]
            rows.append((conv[a].as_py(), part, number, codes.tobytes(), *counts, int(illegal.sum()), int(who[0]), int(who[-1]), *ends, int(_runs(mine).size)))
            number += 1
        names = ["conv", "part", "n", "codes", "blank", "duplicate", "truncated", "illegal", "head", "tail", "first", "last", "turns"]
        kinds = [conv.type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4, pa.int32(), pa.int32(), *[pa.int64()] * 3]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Open:
    """A conversation whose segments are still coming."""

    def __init__(self, conv):
        self.conv, self.states = conv, START
        self.counts = [0, 0, 0, 0]
        self.turns, self.first, self.last, self.tail = 0, None, None, None

    def add(self, row: dict, grammar: Grammar) -> None:
        self.states = grammar.follow(self.states, row["codes"])
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[k] += row[name]
        if self.tail is not None:
            self.counts[3] += (self.tail, row["head"]) not in [(INITIALS.index(a), INITIALS.index(b)) for a, b in LEGAL]
        self.tail = row["tail"]
        if row["first"] is not None:
            self.turns += row["turns"] - (row["first"] == self.last)
            self.first = row["first"] if self.first is None else self.first
            self.last = row["last"]

    def row(self) -> tuple:
        best = finish(self.states)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts, best.cost, best.letters())


def _judge(block: int):
    """Sorted segments to one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        state: list[_Open] = []
        kind = None

        def take(rows: list[dict]) -> list[tuple]:
            grammar, done = Grammar([r["codes"] for r in rows]), []
            for row in rows:
                if not state or state[0].conv != row["conv"]:
                    done += [s.row() for s in state]
                    state[:] = [_Open(row["conv"])]
                state[0].add(row, grammar)
            return done

        def out(rows: list[tuple]) -> pa.RecordBatch:
            names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
            kinds = [kind, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        size = 0
        for batch in batches:
            kind = batch.schema.field("conv").type
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["codes"])
                if size >= block:
                    if done := take(held):
                        yield out(done)
                    held, size = [], 0
        done = take(held) if held else []
        done += [s.row() for s in state]
        if done:
            yield out(done)

    return run


def roles_of(audit: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role initial that stands there afterwards, None for deletions): an odd number of turns begins with the system."""
    left = len(audit) - audit.count("D")
    initial = "s" if left % 2 else "u"
    for edit in audit:
        if edit == "D":
            yield edit, None
            continue
        yield edit, initial
        initial = "a" if initial == "u" else "u"


_ROLE = {"u": "user", "a": "assistant"}


class _Repaired:
    """Applies the edits of one conversation to its turns as they pass by."""

    def __init__(self, audit: str):
        self.edits = roles_of(audit)
        self.sum, self.n = hashlib.sha256(), 0

    def _line(self, role: str, text: str) -> tuple[int, str, str]:
        self.sum.update((b"\n" if self.n else b"") + role.encode() + b":" + text.encode())
        self.n += 1
        return self.n - 1, role, text

    def turn(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        for edit, initial in self.edits:
            if edit == "I":
                yield self._line(_ROLE[initial], "")
                continue
            if edit != "D":
                yield self._line(role if edit == "K" else _ROLE[initial], text)
            return

    def rest(self) -> Iterator[tuple[int, str, str]]:
        for _, initial in self.edits:
            yield self._line(_ROLE[initial], "")


def _apply(keep_turns: bool):
    """Sorted rows, each conversation's edits in front of its turns, to one digest a conversation or to its repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, counts, kind = None, None, None, None
        rows: list[tuple] = []
        names = ["conv", "place", "role", "text"] if keep_turns else ["conv", "repaired_sha256", "counts"]

        def out() -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.string()] if keep_turns else [kind, pa.string(), counts]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return batch

        def close() -> None:
            if now is not None:
                last = [(conv, *line) for line in now.rest()]
                rows.extend(last if keep_turns else [(conv, now.sum.hexdigest(), own)])

        own = None
        for batch in batches:
            kind, counts = batch.schema.field(0).type, batch.schema.field(3).type
            for key, role, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if found is not None:
                    close()
                    conv, now, own = key, _Repaired(found["audit"]), found
                    continue
                lines = [(conv, *line) for line in now.turn(role, text)]
                if keep_turns:
                    rows.extend(lines)
            if rows:
                yield out()
        close()
        if rows:
            yield out()

    return run


def _clean(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    out = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return out.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def judged(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of cleaned turns."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", BLANK).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(FINE)
    first_letter = F.substring("role", 1, 1)
    initial = F.when(first_letter == "s", 0).when(first_letter == "u", 1).when(first_letter == "a", 2).otherwise(3)
    light = rows.select("conv", "turn", "role", "digest", initial.alias("initial"), fault.alias("fault"))
    light = written(light.groupBy("conv", "turn", "role", "digest", "initial", "fault").agg(F.count("*").alias("n")), "turns")
    # nulls come first, so a row without a turn has no earlier one
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = light.where(F.col("fault") != BLANK).groupBy("conv", "role", "digest").agg(F.min(when).alias("since"), F.count("*").alias("times")).where("times > 1")
    again = again.select(F.col("conv").alias("of"), F.col("role").alias("as"), F.col("digest").alias("same"), "since")
    same = light["conv"].eqNullSafe(again["of"]) & (light["role"] == again["as"]) & (light["digest"] == again["same"])
    late = (F.col("fault") != BLANK) & (when > F.col("since"))
    flagged = light.join(again, same, "left").withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault")))
    flagged = written(flagged.select("conv", "turn", "role", "digest", "initial", "fault", "n"), "turns")
    order = ("conv", F.col("turn").asc_nulls_first(), "role", "digest")
    dealt = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "initial", "fault", "n")
    kind = dict(rows.dtypes)["conv"]
    segments = written(dealt.mapInArrow(_segments, f"conv {kind}, {_SEGMENT}"), "segments")
    placed = segments.repartition("conv").sortWithinPartitions("conv", "part", "n")
    return placed.mapInArrow(_judge(block), f"conv {kind}, {_COUNTS}")


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_turns: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; with ``keep_turns`` the
    repaired turns instead, as id, place, role and text."""
    small_batches(turns.sparkSession)
    rows = _clean(turns, conv_col, turn_col, role_col, text_col)
    kind = dict(rows.dtypes)["conv"]
    found = written(judged(rows, block), "edits")
    counts = F.struct(*[c for c in found.columns if c != "conv"])
    heads = found.select("conv", F.lit(False).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("digest"), counts.alias("counts"))
    bodies = rows.select("conv", F.lit(True).alias("is_turn"), "turn", "role", "text", "digest", F.lit(None).cast(heads.schema["counts"].dataType).alias("counts"))
    stream = heads.unionByName(bodies).repartition("conv").sortWithinPartitions("conv", "is_turn", F.col("turn").asc_nulls_first(), "role", "digest")
    shape = "place long, role string, text string" if keep_turns else f"repaired_sha256 string, counts struct<{_COUNTS.replace(' ', ':').replace(',:', ',')}>"
    out = stream.select("conv", "role", "text", "counts").mapInArrow(_apply(keep_turns), f"conv {kind}, {shape}")
    chosen = ["place", "role", "text"] if keep_turns else ["counts.*", "repaired_sha256"]
    return out.select(F.col("conv").alias(conv_col), *chosen)
