"""Operator 13 against a search over all edit strings and a plain reading of the whole query."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glean.llm import queries, repair
from glean.llm.common import table

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def brute_repair(rows):
    """Cheapest edits by Dijkstra over (rows done, initials so far as a state); ties by the least string.

    ``rows``: (initial, must go, truncated).
    """
    # States by what has been written: nothing, s, ...u, ...a.
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        for c in "ua":
            if c in follow[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, follow[state][c]))
                if i < len(rows) and not rows[i][1]:
                    heapq.heappush(heap, (cost + 3 + 3 * rows[i][2], audit + "R", i + 1, follow[state][c]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if not gone and initial in follow[state]:
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, follow[state][initial]))


def by_tables(rows, stretch):
    symbols = np.array([repair.GONE if g else 2 * "suax".index(i) + c for i, g, c in rows], np.int64)
    parts = [symbols[i : i + stretch] for i in range(0, len(symbols), stretch)]
    value = cost = 0
    rights = []
    for p in reversed(parts):
        rights.append(value)
        to, add = repair.TABLES.through(p)
        cost += add[value]
        value = to[value]
    cost += repair.TABLES.values[value][repair.START]
    state, audit = repair.START, ""
    for p, right in zip(parts, reversed(rights)):
        texts, states = repair.TABLES.trace(p, right)
        audit, state = audit + texts[state], states[state]
    return cost, audit + repair.TAIL[state]


def test_tables_find_the_cheapest_and_least_edits():
    rnd = random.Random(4)
    assert len(repair.TABLES.values) < 100
    for _ in range(3000):
        rows = [(rnd.choice("suuaaax"), rnd.random() < 0.2, int(rnd.random() < 0.2)) for _ in range(rnd.randint(0, 14))]
        assert by_tables(rows, rnd.choice([1, 3, 4, 5, 100])) == brute_repair(rows), rows


def test_blocks_of_other_lengths_agree():
    rnd = random.Random(5)
    symbols = np.array([rnd.randrange(9) for _ in range(41)])
    want = repair.TABLES.through(symbols)
    for block in (1, 2, 3):
        got = repair.Tables(block).through(symbols)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def brute_query(rows):
    """``rows``: (conv_id, turn, role, text) -> the report, read plainly."""
    convs = defaultdict(list)
    text_of = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept = convs[conv]
        role, text = text_of(role), text_of(text)
        code = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = {}
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, _, _ in kept if t is not None}
        seen, counts, codes = set(), dict(blank=0, duplicate=0, truncated=0), []
        for _, role, text in kept:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = brute_repair(codes)
        lines, i, last = [], 0, ""
        for e in audit:
            role, text = ("assistant" if last == "u" else "user", "") if e == "I" else kept[i][1:]
            if e == "R":
                role = "assistant" if last == "u" else "user"
            i += e != "I"
            if e != "D":
                lines.append(f"{role}:{text}")
                last = role[0]
        pairs = zip([r[:1] for _, r, _ in kept], [r[:1] for _, r, _ in kept][1:])
        out[conv] = {
            "conv_id": conv,
            "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            **counts,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


def test_query_matches_brute_force(spark):
    conversations = table(spark, SF, "conversations")
    got = {r.conv_id: r.asDict() for r in queries.op13_repair(spark, SF).collect()}
    assert got == brute_query([tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("stretch", [3, 4096])
def test_odd_input(spark, stretch):
    rnd = random.Random(6)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "system", "s."), (2, 1, "", ""), (3, 1, "tool", "x?")]
    rows += [(4, 7, "user", "same.")] * 5 + [(5, 0, None, " \t\r")]
    # One conversation of many stretches; turns are unique in it, so that the order is defined.
    rows += [(6, t, rnd.choice(["system", "user", "assistant", "tool"]), rnd.choice(["a.", "b", "", "c! ", "d?\n", "e" * 50 + "."]) + (str(t) + "." if t % 3 else "")) for t in range(400)]
    rows += [(None, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(10, 60)]
    rows += [(t, 0, "user", "x.") for t in range(100, 200)]  # some of these lose their only row
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("code", F.lit("x")).withColumn("c", F.lit(1))
    got = {r.conv_id: r.asDict() for r in repair.repair_report(frame, stretch).collect()}
    want = brute_query(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v
    assert any(v["audit"] == "" for v in want.values())
    assert repair.repair_report(frame.limit(0)).count() == 0
