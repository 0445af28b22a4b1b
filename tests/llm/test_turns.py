"""Conversation repair against brute force."""

import hashlib
import heapq
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexmill.llm import queries, turns

SOLID = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault), least cost first, then ASCII: states with their whole audits."""
    heap, seen = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in seen and seen[i, last] <= (cost, audit):
            continue
        seen[i, last] = (cost, audit)
        for x in "ua":
            if x in NEXT[last]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, x, (*out, (FULL[x], ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[:1] in NEXT[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for x in "ua":
                    if x in NEXT[last]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, x, (*out, (FULL[x], text))))


def expected(conv_id, rows):
    """rows: (turn, role, text) after damage."""
    place = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), place(*r[1:])))
    seen, marked = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    cost, audit, out = cheapest(marked)
    counts = [sum(f == x for *_, f in marked) for x in ("blank", "duplicate", "truncated")]
    return (conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), [(conv_id, k, *x) for k, x in enumerate(out)]


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if x is None else x for x in (conv, turn, role, text))
        h = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
        role = "user" if h == 4 else role
        for _ in range({0: 0, 3: 2}.get(h, 1)):
            yield conv, turn, role, text


def _by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(rest)
    return out


def _rows():
    r = np.random.default_rng(3)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", "é。", "Yes. \n", "a\x85", "Sure.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", " ", "User", "support", "ua"]
    for conv in range(260):
        for k in range(int(r.integers(1, 14))):
            role = roles[int(r.integers(len(roles)))] if r.random() < 0.4 else ("assistant" if k % 2 else "user")
            text = texts[int(r.integers(len(texts)))] if r.random() < 0.7 else f"{conv} {k}."
            yield conv, (None if r.random() < 0.05 else int(k + r.integers(0, 3)) - 3), (None if r.random() < 0.03 else role), (None if r.random() < 0.03 else text)
    yield from [(None, None, "user", "Hi."), (None, 4, None, None), (None, 1, "assistant", "Ho."), (-5, -(2**40), "user", "Far."), (-5, 2**40, "assistant", "Away.")]
    yield from [(900, k, ("user", "assistant", "system")[k % 3 if k % 40 < 20 else 0], f"x{k % 61}." if k % 7 else "open") for k in range(700)]
    yield from [(901, 5, "user", "Same.")] * 300 + [(901, 6, "assistant", "Same.")] * 300
    yield from [(902, k, "user", "Hello.") for k in range(500)]
    yield from [(903, k, "user", f"{k}.") for k in range(257)]
    yield (904, 0, "user", "long " * 60_000 + ".")


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_brute_force(spark, partitions):
    rows = list(_rows())
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, place int").repartition(5)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # long conversations span partitions
    try:
        got = {r.conv_id: tuple(r) for r in turns.report(df).collect()}
        repaired = sorted(map(tuple, turns.repair(df).select("conv_id", "place", "role", "text").collect()), key=str)
        planted = {r.conv_id: tuple(r) for r in turns.report(turns.damage(df), df).collect()}
        pieces = turns.codes(turns._plain(df)).groupBy("conv_id").count().agg(F.max("count")).first()[0]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert (pieces > 1) == (partitions > 1)
    want = {c: expected(c, x) for c, x in _by_conversation(rows).items()}
    assert got == {c: w for c, (w, _) in want.items()}
    assert repaired == sorted([x for _, out in want.values() for x in out], key=str)
    after = _by_conversation(damaged(rows))
    assert planted == {c: expected(c, after.get(c, []))[0] for c in want}


def test_all_short_conversations():
    """Every list of up to five symbols that are no duplicates."""
    texts = {turns.NONE: "x.", turns.BLANK: "", turns.CUT: "x"}
    faults = {turns.NONE: None, turns.BLANK: "blank", turns.CUT: "truncated"}
    all_ = [(i, f) for i in range(4) for f in texts]
    for n in range(5):
        for rows in itertools.product(all_, repeat=n):
            if n == 4 and hash(rows) % 3:
                continue
            code = "".join(turns.symbol(*r) for r in rows)
            want = cheapest([("suax"[i], texts[f], faults[f]) for i, f in rows])
            assert turns.solve(turns.runs_of(code)) == want[:2]


def test_a_long_run():
    n = 100_000
    cost, audit = turns.solve([(turns.symbol(1, turns.NONE), n)])
    assert cost == 3 * n // 2 == 4 * audit.count("D") + 3 * audit.count("R") + 3 * audit.count("I") and len(audit) - audit.count("I") == n
    short = cheapest([("user", "x.", None)] * 12)
    assert turns.solve([(turns.symbol(1, turns.NONE), 12)]) == short[:2]


def test_empty_table_and_query(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert turns.report(turns.damage(empty), empty).count() == turns.repair(empty).count() == 0
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(40) for t in range(4)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r) for r in queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()}
    after = _by_conversation(damaged(rows))
    assert got == {c: expected(c, after.get(c, []))[0] for c in range(40)}
