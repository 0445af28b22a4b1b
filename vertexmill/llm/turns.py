"""Repair of conversation structure, by a run-length dynamic programme.

A conversation's rows, in order, should have the roles of (s?(ua)+)?: a system
turn at most, then user and assistant in turn. Each row has a symbol: the
initial of its role (s, u, a or another) and its first fault: blank (no
character but white space), duplicate (role and text stood earlier in the
conversation), truncated (its last such character is none of .!?), or none.

    edit    cost
    Keep    0, and 3 for a truncated row
    Rerole  3, to user or assistant, and 3 for a truncated row
    Delete  4, the only edit of blank and duplicate rows
    Insert  3, an empty user or assistant turn, anywhere

Symbols are collapsed to runs of equal ones. A run's effect on the four states
of the pattern (nothing yet, after s, after u, after a) is a min-plus matrix of
its symbol, and the run is passed by the cached binary powers of it: from the
end of the conversation the least cost of the rest from each state goes back
run by run. Then choices are unrolled from the front: in each run, doubling by
the same powers gives the least costs before each of its rows, and the first
letter in ASCII order whose cost fits is taken, so that of all cheapest lists
of edits the audit is the ASCII-least.

Rows are ordered by turn (nulls first), then role, then the SHA-256 of role and
text. The order is a range partitioning of keys without texts; each partition
writes its rows of a conversation down as one short code of runs, so that a
conversation of any size is spread and comes together as codes, about a byte a
row. Texts travel once, sorted, past their conversation's code. The digest of a
conversation is one SHA-256 over its texts in order, which one task streams; it
holds the edits and no texts.

Null roles and texts count as one space (an unknown role, a blank text), null
turns go first and count for no gap, rows of a null conv_id are one
conversation. A conversation without rows has zeros, an empty audit and the
hash of the empty string. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as the blanks that do not count.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
INITIALS = "sua"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, BLANK, DUPLICATE, CUT = range(4)
#: The state after a role's initial in each state: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
FAR = 1 << 60


def symbol(initial: int, fault: int) -> str:
    """The letter of a row in a code. initial: place in INITIALS, or 3."""
    return chr(65 + 4 * initial + fault)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of matrices."""
    return np.minimum((a[:, :, None] + b[None]).min(1), FAR)


def _inserts() -> np.ndarray:
    """Least cost from state to state by inserted turns alone."""
    cost = np.full((4, 4), FAR)
    for i, after in enumerate(NEXT):
        cost[i, i] = 0
        for letter in "ua":
            if letter in after:
                cost[i, after[letter]] = min(cost[i, after[letter]], INSERT)
    return _times(_times(cost, cost), cost)


def _edits(letter: str) -> list[list[tuple[str, int, int]]]:
    """(edit, cost, next state) of a row of this symbol from each state, in ASCII order of the edits."""
    initial, fault = divmod(ord(letter) - 65, 4)
    out = []
    for i, after in enumerate(NEXT):
        mine = [("D", DELETE, i)]
        if fault in (NONE, CUT):
            more = TRUNCATED if fault == CUT else 0
            if initial < 3 and INITIALS[initial] in after:
                mine.append(("K", KEEP + more, after[INITIALS[initial]]))
            mine += [("R", REROLE + more, after[x]) for x in "ua" if x in after]
        out.append(mine)
    return out


@lru_cache(None)
def edits(letter: str) -> list[list[tuple[str, int, int]]]:
    return _edits(letter)


@lru_cache(None)
def power(letter: str, k: int) -> np.ndarray:
    """The matrix of 2**k rows of this symbol, with inserts before each."""
    if k:
        return _times(power(letter, k - 1), power(letter, k - 1))
    row = np.full((4, 4), FAR)
    for i, mine in enumerate(edits(letter)):
        for _, cost, j in mine:
            row[i, j] = min(row[i, j], cost)
    return _times(_inserts(), row)


def _passed(letter: str, n: int, rest: np.ndarray) -> np.ndarray:
    """Least cost from each state before n rows of this symbol, from that after them."""
    k = 0
    while n >> k:
        if n >> k & 1:
            rest = (power(letter, k) + rest).min(1)
        k += 1
    return rest


def _within(letter: str, n: int, rest: np.ndarray) -> np.ndarray:
    """(n + 1, 4): least costs with so many rows of the run to go, by doubling."""
    out = np.empty((n + 1, 4), np.int64)
    out[0] = rest
    done, k = 1, 0
    while done <= n:
        more = min(done, n + 1 - done)
        out[done : done + more] = (power(letter, k)[None] + out[:more, None]).min(2)
        done, k = done + more, k + 1
    return out


def runs_of(code: str) -> list[tuple[str, int]]:
    """(symbol, rows) of a code: a letter a run, with its number of rows behind it unless it is one; neighbours of one symbol are joined."""
    parts = ((x[0], int(x[1:] or 1)) for x in re.findall("[A-P][0-9]*", code))
    return [(letter, sum(n for _, n in same)) for letter, same in groupby(parts, key=lambda x: x[0])]


def code_of(runs) -> str:
    return "".join(letter if n == 1 else f"{letter}{n}" for letter, n in runs)


def solve(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's runs."""
    rest = [np.where(np.isin(np.arange(4), FINAL), 0, FAR)]
    rest[0] = (_inserts() + rest[0]).min(1)
    for letter, n in reversed(runs):
        rest.append(_passed(letter, n, rest[-1]))
    rest.reverse()
    audit, state = [], 0
    for r, (letter, n) in enumerate(runs):
        left = _within(letter, n, rest[r + 1]).tolist()
        choices = edits(letter)
        while n:
            now, then = left[n], left[n - 1]
            edit, state, moved = next(_fitting(choices, state, now, then))
            audit.append(edit)
            n -= moved
    while state not in FINAL:
        audit.append("I")
        state = NEXT[state]["a" if state == 2 else "u"]
    return int(rest[0][0]), "".join(audit)


def _fitting(choices, state: int, now: list[int], then: list[int]) -> Iterator[tuple[str, int, int]]:
    """(edit, next state, rows passed) of the cheapest edits, ASCII order."""
    want = now[state]
    first, *others = choices[state]
    if first[1] + then[first[2]] == want:
        yield "D", first[2], 1
    j = NEXT[state]["a" if state == 2 else "u"]
    if INSERT + now[j] == want:
        yield "I", j, 0
    for edit, cost, j in others:
        if cost + then[j] == want:
            yield edit, j, 1


@lru_cache(1 << 16)
def _solve_short(code: str) -> tuple:
    return _summary(runs_of(code))


def _summary(runs: list[tuple[str, int]]) -> tuple:
    """(blank, duplicate, truncated, illegal, cost, audit)."""
    faults, illegal, before = [0] * 4, 0, None
    for letter, n in runs:
        initial, fault = divmod(ord(letter) - 65, 4)
        faults[fault] += n
        illegal += n - 1 + (before is not None and (before, initial) not in ((0, 1), (1, 2), (2, 1)))
        before = initial
    return *faults[1:], illegal, *solve(runs)


def summary(code: str) -> tuple:
    return _solve_short(code) if len(code) <= 64 else _summary(runs_of(code))


def _plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place): nulls of role and text as one space; place orders rows of one turn and role."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("place", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _last(text: Column) -> Column:
    """The last character that is no white space; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def codes(rows: DataFrame) -> DataFrame:
    """(conv_id, part, code, low, high, turns, first, last): for each range partition the runs of a conversation's rows in it, in order of part; turns are the distinct ones, from first to last."""
    last = _last(F.col("text"))
    fault = F.when(last == "", BLANK).when(~last.isin(*STOPS), CUT).otherwise(NONE)
    start = F.substring("role", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    keys = rows.select("conv_id", "turn", "role", "place", (4 * initial + fault).cast("int").alias("symbol"))
    # role and text that stand more than once in a conversation, and the first turn that they stand in
    again = keys.groupBy("conv_id", "place").agg(F.count("*").alias("n"), F.count("turn").alias("known"), F.min("turn").alias("first")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), F.when(F.col("n") == F.col("known"), F.col("first")).alias("first_turn"), F.lit(True).alias("repeated"))
    marked = keys.join(again, keys.conv_id.eqNullSafe(again.c) & (keys.place == again.p), "left")
    late = F.coalesce("repeated", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    order = ("conv_id", "turn", "role", "place")
    rows = marked.select(*order, "symbol", late.alias("late")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, before, out = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "place", "symbol", "late")]
            for conv, turn, role, place, number, late in zip(*columns, strict=True):
                if held is None or held["conv_id"] != conv:
                    if held is not None:
                        out.append(_ended(held))
                    held, before = {"conv_id": conv, "part": part, "runs": [], "low": None, "high": None, "turns": 0, "first": turn, "last": None}, None
                key = (turn, role, place)
                if (late or key == before) and number % 4 != BLANK:  # alike rows stand together within a turn
                    number = number - number % 4 + DUPLICATE
                before = key
                runs = held["runs"]
                if runs and runs[-1][0] == number:
                    runs[-1][1] += 1
                else:
                    runs.append([number, 1])
                if turn is not None and turn != held["high"]:
                    held["turns"] += 1
                    held["high"] = turn
                    held["low"] = turn if held["low"] is None else held["low"]
                held["last"] = turn
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, CODES)
                out = []
        out += [_ended(held)] if held is not None else []
        yield pa.RecordBatch.from_pylist(out, CODES)

    return rows.mapInArrow(run, "conv_id long, part int, code string, low long, high long, turns long, first long, last long")


CODES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("code", pa.string()), *[(c, pa.int64()) for c in ("low", "high", "turns", "first", "last")]])


def _ended(held: dict) -> dict:
    return held | {"code": code_of((chr(65 + x), n) for x, n in held.pop("runs"))}


def _streamed(conversations: DataFrame, ids: DataFrame | None, schema: str, start, row, end) -> DataFrame:
    """Past each conversation's codes its rows in order: start(conv_id, pieces) gives a state, row(state, role, text) and end(state) give output rows."""
    rows = _plain(conversations)
    nothing = {"part": "int", "code": "string", **dict.fromkeys(("low", "high", "turns", "first", "last", "turn"), "long"), "role": "string", "place": "binary", "text": "string"}

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        return df.select("conv_id", F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

    known = rows.select("conv_id") if ids is None else rows.select("conv_id").union(ids.select(F.col("conv_id").cast("long")))
    known = known.distinct()
    both = shaped(known, 0).unionByName(shaped(codes(rows), 1)).unionByName(shaped(rows, 2))
    order = ("conv_id", "kind", "part", "turn", "role", "place")
    dealt = both.repartition("conv_id").sortWithinPartitions(*order).drop("place", "turn")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, pieces, open_, out, size = None, None, [], False, [], 0
        for batch in batches:
            ids, kinds = batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist()
            role, text = batch.column("role"), batch.column("text")
            for k, (i, kind) in enumerate(zip(ids, kinds, strict=True)):
                if kind == 0:
                    if open_:
                        out += end(state if state is not None else start(conv, pieces))
                    conv, pieces, state, open_ = i, [], None, True
                elif kind == 1:
                    pieces.append({c: batch.column(c)[k].as_py() for c in ("code", "low", "high", "turns", "first", "last")})
                else:
                    state = start(conv, pieces) if state is None else state
                    made = row(state, role[k].as_py(), text[k].as_py())
                    out += made
                    size += sum(len(x[-1]) for x in made)
                if len(out) > 4096 or size > 1 << 20:
                    yield _batch(out, names, types)
                    out, size = [], 0
        if open_:
            out += end(state if state is not None else start(conv, pieces))
        if out:
            yield _batch(out, names, types)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class _Repair:
    """The edits of a conversation, applied to its rows as they come."""

    def __init__(self, conv_id: int | None, pieces: list[dict]):
        self.conv_id = conv_id
        self.summary = summary("".join(p["code"] for p in pieces))
        self.audit, self.at, self.state, self.place = self.summary[-1], 0, 0, 0
        known = [p for p in pieces if p["turns"]]
        turns = sum(p["turns"] for p in known) - sum(a["last"] == b["first"] for a, b in zip(known, known[1:], strict=False))
        self.gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
        self.sha, self.first = hashlib.sha256(), True

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._fresh(), ""

    def _fresh(self) -> str:
        letter = "a" if self.state == 2 else "u"
        self.state = NEXT[self.state][letter]
        return "assistant" if letter == "a" else "user"

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand up to and with a row."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._fresh(), text


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of conversations(conv_id, turn, role, text) after repair, numbered from 0."""
    def numbered(r: _Repair, turns) -> list[tuple]:
        out = []
        for edit, role, text in turns:
            out.append((r.conv_id, r.place, edit, role, text))
            r.place += 1
        return out

    return _streamed(conversations, None, "conv_id long, place long, edit string, role string, text string", _Repair, lambda r, role, text: numbered(r, r.take(role, text)), lambda r: numbered(r, r.inserts()))


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row a conversation of conversations(conv_id, turn, role, text), and of ids(conv_id), which may name more.

    gaps: turns missing between the smallest and the largest. illegal: pairs of
    neighbours whose initials are not su, ua or au. audit: the initials of the
    edits in order. repaired_sha256: of the repaired role:text, a line each.
    """
    def add(r: _Repair, turns) -> list[tuple]:
        for _, role, text in turns:
            r.sha.update(f"{'' if r.first else chr(10)}{role}:{text}".encode())
            r.first = False
        return []

    def end(r: _Repair) -> list[tuple]:
        add(r, r.inserts())
        *counts, audit = r.summary
        return [(r.conv_id, r.gaps, *counts, audit, r.sha.hexdigest())]

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _streamed(conversations, ids, schema, _Repair, lambda r, role, text: add(r, r.take(role, text)), end)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with faults planted by the CRC-32 of conv_id:turn modulo 20: a row dropped, emptied, without its stops, twice, or with role user. Nulls count as one space in what is hashed and for role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).filter("h <> 0")
    new_text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    new_role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), copies.alias("copy")).drop("copy")
