"""Conversation repair against a search by cost and letters, and plain loops."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cueweave.llm import conversations as cv

DATA = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")


def best_loop(codes):
    """Least (cost, letters) by Dijkstra; the state is what the role letters so far allow."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(codes) and last in ("", "a"):
            return cost, letters
        following = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        spoken = following[-1]
        heapq.heappush(heap, (cost + 3, letters + "I", at, spoken))
        if at < len(codes):
            first, must_go, cut = codes[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, last))
            if not must_go:
                if first and first in following:
                    heapq.heappush(heap, (cost + 3 * cut, letters + "K", at + 1, first))
                heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", at + 1, spoken))


def damage_loop(rows):
    """conv_id -> rows after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        held = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def repair_loop(rows):
    out = {}
    for conv, held in damage_loop(rows).items():
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            blank, double = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
            cut = not blank and text.rstrip("\x20\t\n\x0b\x0c\r")[-1] not in ".!?"
            seen.add((role, text))
            fault = 0 if blank else 1 if double else 2 if cut else None
            if fault is not None:
                counts[fault] += 1
            codes.append((role[:1], fault in (0, 1), fault == 2))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = best_loop(codes)
        lines, at, last = [], 0, ""
        for e in audit:
            spoken = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if e in "KR":
                lines.append((held[at][1] if e == "K" else spoken) + ":" + held[at][2])
            elif e == "I":
                lines.append(spoken + ":")
            at += e != "I"
            last = lines[-1][0] if lines and e != "D" else last
        assert LEGAL.fullmatch("".join(x[0] for x in lines)) and at == len(held)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(seed, n_conv=60, long=0):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "ok", " ", "", None, "Why?\n", "a.b", "é!", "Hi."]
    rows = []
    for conv in range(n_conv):
        for turn in range(rng.randrange(9)):
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}."))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    rows += [(10_000, t, rng.choice(roles[:3]), rng.choice(texts) if rng.random() < 0.2 else f"word {t}{rng.choice('.! ,')}") for t in range(long)]
    rng.shuffle(rows)
    return rows


def compared(spark, rows, **kind):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit("x")).withColumn("pid", F.lit(1)).repartition(3)
    got = [tuple(r) for r in cv.repair(cv.damaged(table), **kind).collect()]
    assert len(got) == len({r[0] for r in got}) == len({r[0] for r in rows})
    assert {r[0]: r[1:] for r in got} == repair_loop(rows)


def test_search():
    rng = random.Random(3)
    for _ in range(400):
        codes = [(rng.choice("suuaatx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(12))]
        assert cv.cheapest(codes) == best_loop(codes)


def test_search_long():
    """No state is searched again and again: long rows of one role, all cut."""
    began = time.time()
    for codes in ([("u", False, True)] * 512, [("a", False, False)] * 512, [("x", False, False)] * 512, [("s", False, False)] * 512):
        cost, letters = cv.cheapest(codes)
        assert (cost, letters) == best_loop(codes)
    assert time.time() - began < 20


def test_ways_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        codes = [(rng.choice("suuaatx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(2, 10))]
        at = rng.randrange(1, len(codes))
        ways = []
        for q in range(4):
            a = cv.cheapest(codes[:at], cv.START, q)
            for r in range(4):
                b = a and cv.cheapest(codes[at:], q, r)
                if b:
                    ways.append((a[0] + b[0] + 3 * cv.CLOSING[r], a[1] + b[1] + "I" * cv.CLOSING[r]))
        assert min(ways) == best_loop(codes)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    compared(spark, random_rows(seed))


@pytest.mark.parametrize("size", [3, 16])
def test_repair_in_pieces(spark, size):
    """One conversation of many pieces, which holds most rows."""
    compared(spark, random_rows(5, 8, long=150), size=size)


def test_lines_of_parts(spark):
    rows = random_rows(6, 8, long=60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = {}
    for r in cv.repaired(cv.damaged(table), size=8).orderBy("part").collect():
        parts.setdefault(r.conv_id, []).append(r.repaired)
    expected = repair_loop(rows)
    for conv, texts in parts.items():
        assert hashlib.sha256("\n".join(texts).encode()).hexdigest() == expected[conv][-1]
    assert len(parts[10_000]) > 1


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.repair(cv.damaged(empty)).count() == 0
    compared(spark, [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", " " * 300_000), (2, 0, None, None), (None, None, None, None)])


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op12_conversation_repair"](spark, DATA)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == repair_loop(rows)
