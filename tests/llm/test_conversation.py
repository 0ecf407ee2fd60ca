"""Conversation repair against exhaustive search; blocks of long conversations against whole ones."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tracefuse.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile(r"(s?(ua)+)?")


def brute_edits(codes):
    """(cost, initials) by uniform-cost search over (rows done, initials of the roles), written without states or prices."""
    n = len(codes)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        tail = roles[-1:] + str(len(roles) == 0)
        if i == n and PATTERN.fullmatch(roles):
            return cost, audit
        if (i, tail) in done:
            continue
        done.add((i, tail))

        def push(c, label, at, more):
            new = roles + more
            if PATTERN.fullmatch(new) or PATTERN.fullmatch(new + "a") or PATTERN.fullmatch(new + "ua"):
                heapq.heappush(heap, (cost + c, audit + label, at, new))

        for role in "ua":
            push(2, "I", i, role)
        if i < n:
            init, must_go, cut = codes[i]
            push(3, "D", i + 1, "")
            if not must_go:
                push(cut, "K", i + 1, init)
                for role in "ua":
                    push(2 + cut, "R", i + 1, role)


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        convs[conv]
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in rs:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            kind = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else None
            if kind is not None:
                counts[kind] += 1
            seen.add((role, text))
            codes.append((role[:1] if role[:1] and role[0] in "sua" else "x", kind in (0, 1), int(kind == 2)))
        turns = {t for t, _, _ in rs if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        cost, audit = brute_edits(codes)
        left, at = [], iter(rs)
        for e in audit:
            if e == "I":
                left.append((None, ""))
                continue
            _, role, text = next(at)
            if e != "D":
                left.append((role if e == "K" else None, text))
        start = 1 if left and left[0][0] is not None and left[0][0][0] == "s" else 0
        lines = [f"{role if role is not None else ('user', 'assistant')[(i - start) % 2]}:{text}" for i, (role, text) in enumerate(left)]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows, clash=False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    names = ("conv", "block", "place", "code", "cost", "audit", "rows", "long", "tie", "_salt", "draw", "copy")
    return df.select("*", *[F.lit(7).alias(c) for c in names]) if clash else df


def corpus(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(("user", "assistant")) if rnd.random() < 0.5 else ("user", "assistant")[turn % 2]
            if turn == 0 and rnd.random() < 0.4 or rnd.random() < 0.05:
                role = "system"
            text = rnd.choice(("Yes.", "No", "", " \t", "Why?\n", "é!")) if rnd.random() < 0.5 else f"words {rnd.random()}."
            rows.append((c, turn + (rnd.random() < 0.1), role, text))
    rows += [(None, 1, "user", "hello."), (None, None, None, None), (None, None, "assistant", "hi."), (900, None, "tool", "x."),
             (901, 5, "", "empty role."), (902, 1, "Sys", "capital."), (903, 3, "user", "a\nb"), (903, 3, "user", "a\nb")]
    return rows + rows[:7]


def values(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in df.collect()}


@pytest.mark.parametrize("clash", [False, True])
def test_against_search(lspark, clash):
    rows = corpus(1, 150, 9)
    df = conversation.repair(table(lspark, rows, clash))
    got = values(df)
    assert got == brute(rows) and df.count() == len(got)


def test_long_conversations_in_blocks(lspark, monkeypatch):
    rows = corpus(2, 12, 60) + [(77, i // 40, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(300)]
    rows += [(78, 1, "user", "the same words.")] * 200
    monkeypatch.setattr(conversation, "BLOCK_ROWS", 8)
    want = brute(rows)
    assert values(conversation.repair(table(lspark, rows), long_rows=20)) == want
    # the repaired rows give the same hash
    for bound in (20, 10**6):
        turns = conversation.repaired_turns(table(lspark, rows), long_rows=bound).collect()
        texts = defaultdict(list)
        for r in sorted(turns, key=lambda r: (str(r.conv_id), r.block, r.place)):
            texts[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(texts[c]).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}


def test_auction_prices_are_distances():
    rnd = random.Random(6)
    for _ in range(200):
        codes = [rnd.choice((0, 1, 2, 3)) + rnd.choice((0, 0, 4, 8)) for _ in range(rnd.randint(0, 12))]
        behind = [rnd.randint(0, 6) for _ in range(4)]
        lattice = conversation.Lattice(codes, behind)
        dist = {lattice.goal: 0}
        for _ in range(4 * len(codes) + 5):  # Bellman-Ford
            for at, arcs in enumerate(lattice.arcs):
                best = min((cost + dist[h] for _, cost, h in arcs if h in dist), default=None)
                if best is not None and best < dist.get(at, 10**9):
                    dist[at] = best
        for s in range(4):
            assert lattice.settle(s) == dist[s]
        assert all(lattice.price[at] <= dist[at] for at in dist)
        if codes:
            table = conversation.ways(codes)
            for s in range(4):
                through = min(table[4 * s + t] + behind[t] for t in range(4))
                assert through == dist[s]


def test_dropped_and_empty(lspark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = values(conversation.repair(table(lspark, [(dropped, 0, "user", "gone.")])))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert conversation.repair(table(lspark, []).limit(0)).count() == 0
    long = "x" * 200_000 + "."
    assert values(conversation.repair(table(lspark, [(4, 1, "user", long), (4, 2, "assistant", long)]))) == brute(
        [(4, 1, "user", long), (4, 2, "assistant", long)])
