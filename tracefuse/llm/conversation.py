"""Conversation structure repair by an auction shortest-path algorithm.

A conversation is well formed when the initials of its roles read
``(s?(ua)+)?``: an optional system turn, then pairs of a user and an assistant
turn, or nothing.  Repairs walk a lattice of integer costs: node (i, state) has
i rows done; *Delete* (3) and *Keep* (0) and *Rerole* (2) pass a row, *Insert*
(2) adds an empty turn, a truncated row that stays costs 1 more, and blank and
repeated rows must go.

The auction algorithm keeps a price a node and a path from the origin.  At the
path's end it compares the node's price with the cheapest arc plus its head's
price: a price that is too low is raised and the path contracts, else the path
extends along that arc.  When it reaches the goal, the prices along the path are
exact distances.  Prices start as the sum of the costs no repair can avoid, which
satisfies the dual constraints.  The cheapest repair with the ASCII-least
initials follows the tight arcs (price = cost + head's price) in ASCII order;
an arc's head first settles its own price, so an arc that is tight only by a low
price is seen.

Scale.  A conversation of up to ``LONG_ROWS`` rows is repaired in one go.  Longer
ones are ordered by a range partitioning, cut into blocks of ``BLOCK_ROWS`` rows
and never gathered: every block finds its cheapest way between each pair of
states; a pass over these small tables from the last block to the first gives
each block the costs behind it, which fix its tight arcs and so where it leaves
from each state it may be entered in; a second pass hands on the state; then all
blocks trace their repairs side by side.  These passes and the final hash (which
is sequential by definition) stream a conversation's blocks in order and hold
one block at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefuse.session import cut_lineage, salted_join

#: conversations with more rows than this after damage are repaired in blocks
LONG_ROWS = 256
#: rows of a block (a power of two)
BLOCK_ROWS = 64

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
_FAR = 1 << 50

# states: nothing yet, after system, after user, after assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: state after one more turn in the pattern, and that turn's role
NEXT = (_USER, _USER, _ASSISTANT, _USER)
ROLE = ("user", "user", "assistant", "user")
#: state after keeping a turn with initial s, u, a or another one; None where it does not fit
FITS = ((_SYSTEM, _USER, None, None), (None, _USER, None, None), (None, None, _ASSISTANT, None), (None, _USER, None, None))
#: inserts that complete a conversation that ends in a state
ENDING = (0, 2, 1, 0)
GOAL = tuple(INSERT * n for n in ENDING)
#: pairs of neighbouring initials that the pattern has
LEGAL = {(0, 1), (1, 2), (2, 1)}

# a row's code: initial in the two low bits, then "must go" and "truncated"
_MUST_GO, _CUT = 4, 8


class Lattice:
    """Prices and arcs of one block of rows with the costs behind it."""

    def __init__(self, codes: list[int], behind: tuple[int, ...] | list[int]):
        n = len(codes)
        self.goal = 4 * (n + 1)
        self.arcs: list[list[tuple[str, int, int]]] = []
        least = [DELETE if c & _MUST_GO else TRUNCATED if c & _CUT else 0 for c in codes]
        rest = min(behind) + np.concatenate([np.cumsum(least[::-1])[::-1], [0]]).astype(np.int64)
        self.price = np.repeat(rest[:-1], 4).tolist() + list(behind) + [0]
        self.exact = {self.goal}
        for i, c in enumerate(codes):
            stay = TRUNCATED if c & _CUT else 0
            for state in range(4):
                arcs = [("D", DELETE, 4 * i + 4 + state), ("I", INSERT, 4 * i + NEXT[state])]
                if not c & _MUST_GO:
                    if (to := FITS[state][c & 3]) is not None:
                        arcs.append(("K", KEEP + stay, 4 * i + 4 + to))
                    arcs.append(("R", REROLE + stay, 4 * i + 4 + NEXT[state]))
                self.arcs.append(arcs)
        self.arcs += [[("", behind[state], self.goal)] for state in range(4)]

    def settle(self, origin: int) -> int:
        """Exact distance from a node to the goal, by auction."""
        price, path = self.price, [origin]
        while path[-1] not in self.exact:
            at = path[-1]
            best, to = min((cost + price[head], head) for _, cost, head in self.arcs[at])
            if price[at] < best:
                price[at] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        self.exact.update(path)
        return price[origin]

    def trace(self, state: int) -> tuple[str, int]:
        """Initials of the ASCII-least cheapest repair from a state, and the state it leaves in."""
        self.settle(state)
        at, initials = state, []
        while self.arcs[at][0][0]:
            for label, cost, head in self.arcs[at]:
                if cost + self.price[head] == self.price[at] == cost + self.settle(head):
                    initials.append(label)
                    at = head
                    break
        return "".join(initials), at % 4


def ways(codes: list[int]) -> list[int]:
    """Cheapest cost of a block from each state (rows) to each state (columns); inserts behind its last row excluded."""
    out = [_FAR] * 16
    for goal in (_USER, _ASSISTANT):
        lattice = Lattice(codes, [0 if s == goal else _FAR for s in range(4)])
        for state in range(4):
            out[4 * state + goal] = lattice.settle(state)
    # nothing but deletions leads to a state before the first pair, or those and one system turn
    out[0] = out[4 * _SYSTEM + _SYSTEM] = DELETE * len(codes)
    kept = [TRUNCATED if c & _CUT else 0 for c in codes if not c & (_MUST_GO | 3)]
    if kept:
        out[_SYSTEM] = DELETE * (len(codes) - 1) + min(kept)
    return out


def apply_edits(initials: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of every turn left, in order."""
    out, row = [], 0
    for e in initials:
        if e == "I":
            out.append((e, ROLE[state], ""))
            state = NEXT[state]
            continue
        if e == "R":
            out.append((e, ROLE[state], texts[row]))
            state = NEXT[state]
        elif e == "K":
            out.append((e, roles[row], texts[row]))
            state = FITS[state]["sua".find(roles[row][:1])]
        row += 1
    return out


def ending(state: int) -> list[tuple[str, str, str]]:
    out = []
    for _ in range(ENDING[state]):
        out.append(("I", ROLE[state], ""))
        state = NEXT[state]
    return out


# ---- rows ----------------------------------------------------------------------------

def _key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """conv, turn, role and text of every row that is left after the damage; NULLs are one space where they are text."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    draw = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    rows = conversations.select(_key("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), draw.alias("draw")).filter("draw != 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("draw") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(True), times)).alias("copy")).drop("copy")


def initial(role: str) -> int:
    return "sua".find(role[0]) & 3 if role else 3  # -1 & 3 = 3: another initial


_SPACE = " \t\n\x0b\x0c\r"


def fault(text: str) -> int:
    """1 blank, 2 truncated, 0 neither."""
    end = text.rstrip(_SPACE)
    return 1 if not end else 0 if end[-1] in ".!?" else 2


_REPORT = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
_TURNS = "turns array<struct<edit:string,role:string,text:string>>"


def repair_rows(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """Report values (without the hash) and the turns left of one conversation in order."""
    seen, codes, counts = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts):
        code, bad = initial(role), fault(text)
        if bad == 1:
            counts[0] += 1
            code |= _MUST_GO
        elif (role, text) in seen:
            counts[1] += 1
            code |= _MUST_GO
        elif bad:
            counts[2] += 1
            code |= _CUT
        seen.add((role, text))
        codes.append(code)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))
    lattice = Lattice(codes, GOAL)
    cost = lattice.settle(_START)
    initials, state = lattice.trace(_START)
    left = apply_edits(initials, _START, roles, texts) + ending(state)
    return (gaps, *counts, illegal, cost, initials + "I" * ENDING[state]), left


def _short(batches):
    for b in batches:
        out = []
        for conv, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            values, left = repair_rows([r["turn"] for r in rows], [r["role"] for r in rows], [r["text"] for r in rows])
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in left).encode()).hexdigest()
            out.append((conv, *values, digest, [{"edit": e, "role": r, "text": t} for e, r, t in left]))
        names = [f.split()[0] for f in _REPORT.split(", ")] + ["turns"]
        kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2 + [
            pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


# ---- long conversations --------------------------------------------------------------

def _streamed(df: DataFrame, order: list, run, schema: str) -> DataFrame:
    """``run(rows)`` over each conversation's rows in order, one task a conversation, a row at a time."""

    def batches_of(batches):
        def rows():
            for b in batches:
                yield from b.to_pylist()

        out = []
        for row in run(rows()):
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return df.repartition("conv").sortWithinPartitions("conv", *order).mapInArrow(batches_of, schema)


def _costs_behind(rows):
    """Last block first: the costs behind each block, and the cost from its start."""
    conv, behind = None, None
    for r in rows:
        if r["conv"] != conv:
            conv, behind = r["conv"], list(GOAL)
        through = [min(r["ways"][4 * s + t] + behind[t] for t in range(4)) for s in range(4)]
        yield {"conv": conv, "block": r["block"], "behind": behind, "cost": through[_START]}
        behind = through


def _entries(rows):
    """First block first: the state each block is entered in, and the illegal pair between it and the one before."""
    conv, state, last = None, _START, None
    for r in rows:
        if r["conv"] != conv:
            conv, state, last = r["conv"], _START, None
        seam = int(last is not None and (last, r["codes"][0] & 3) not in LEGAL)
        yield {"conv": conv, "block": r["block"], "entry": state, "leaves": r["leads"][state], "seam": seam}
        state, last = r["leads"][state], r["codes"][-1] & 3


def _digests(rows):
    """Hash and initials of each conversation, block by block."""
    conv, digest, initials, empty, state = None, None, [], True, _START

    def done():
        closing = ending(state)
        for _, role, text in closing:
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
        return {"conv": conv, "audit": "".join(initials) + "I" * len(closing), "repaired_sha256": digest.hexdigest()}

    for r in rows:
        if r["conv"] != conv:
            if digest:
                yield done()
            conv, digest, initials, empty = r["conv"], hashlib.sha256(), [], True
        for t in r["turns"]:
            digest.update((("" if empty else "\n") + f"{t['role']}:{t['text']}").encode())
            empty = False
        initials.append(r["initials"])
        state = r["leaves"]
    if digest:
        yield done()


def _long_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and blocks (conv, block, initials, leaves, turns) of long conversations."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # repeated rows are apart by "tie", so that they need not share a range; the checkpoint freezes the places
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = cut_lineage(tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
                         .withColumn("place", F.monotonically_increasing_id()))
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    first_letter = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    narrow = placed.select(
        "conv", "place", "turn", (end == "").alias("blank"), F.right(end, F.lit(1)).isin(".", "!", "?").alias("whole"),
        F.when((F.col("role") == "") | (first_letter == 0), 3).otherwise(first_letter - 1).alias("initial"),
        F.sha2(F.concat(F.col("role"), F.lit("\0"), F.col("text")).cast("binary"), 256).alias("said"))
    # a row repeats another when it is not the first of its words: places are unique, so this join is even
    firsts = narrow.groupBy("conv", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = narrow.drop("said").join(firsts, "place", "left")
    repeated = F.col("first").isNull() & ~F.col("blank")
    cut = ~F.col("whole") & ~F.col("blank") & F.col("first").isNotNull()
    code = (F.col("initial") + F.when(F.col("blank") | F.col("first").isNull(), _MUST_GO).otherwise(0)
            + F.when(cut, _CUT).otherwise(0))
    block = F.floor(F.col("place") / F.lit(BLOCK_ROWS)).cast("long")
    marked = cut_lineage(marked.select("conv", "place", "turn", "blank", repeated.alias("repeated"), cut.alias("cut"),
                                       code.cast("int").alias("code"), block.alias("block")))
    coded = marked.groupBy("conv", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("codes"))

    def table_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([ways(c) for c in b.column(2).to_pylist()], pa.list_(pa.int64()))],
                ["conv", "block", "codes", "ways"])

    blocks = cut_lineage(coded.mapInArrow(table_of, "conv string, block long, codes array<int>, ways array<long>"))
    behind = cut_lineage(_streamed(blocks.select("conv", "block", "ways"), [F.col("block").desc()], _costs_behind,
                                   "conv string, block long, behind array<long>, cost long"))

    def leads_of(batches):
        for b in batches:
            leads, inner = [], []
            for codes, costs in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                lattice = Lattice(codes, costs)
                leads.append([lattice.trace(s)[1] for s in range(4)])
                inner.append(sum((x & 3, y & 3) not in LEGAL for x, y in zip(codes, codes[1:])))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(leads, pa.list_(pa.int32())), pa.array(inner, pa.int64())],
                                             ["conv", "block", "codes", "leads", "inner"])

    led = cut_lineage(blocks.join(behind, ["conv", "block"]).select("conv", "block", "codes", "behind").mapInArrow(
        leads_of, "conv string, block long, codes array<int>, leads array<int>, inner long"))
    entered = cut_lineage(_streamed(led.select("conv", "block", "codes", "leads"), [F.col("block")], _entries,
                                    "conv string, block long, entry long, leaves long, seam long"))
    words = placed.groupBy("conv", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("rows"))

    def traced(batches):
        for b in batches:
            initials, turns = [], []
            for rows, codes, costs, entry in zip(*[b.column(i).to_pylist() for i in (2, 3, 4, 5)]):
                found, _ = Lattice(codes, costs).trace(entry)
                initials.append(found)
                left = apply_edits(found, entry, [r["role"] for r in rows], [r["text"] for r in rows])
                turns.append([{"edit": e, "role": r, "text": t} for e, r, t in left])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(6), pa.array(initials, pa.string()),
                 pa.array(turns, pa.list_(pa.struct([(n, pa.string()) for n in ("edit", "role", "text")])))],
                ["conv", "block", "leaves", "initials", "turns"])

    known = led.select("conv", "block", "codes").join(behind.select("conv", "block", "behind"), ["conv", "block"]).join(
        entered.select("conv", "block", "entry", "leaves"), ["conv", "block"])
    pieces = cut_lineage(words.join(known, ["conv", "block"]).select(
        "conv", "block", "rows", "codes", "behind", "entry", "leaves").mapInArrow(
        traced, f"conv string, block long, leaves long, initials string, {_TURNS}"))
    hashed = _streamed(pieces, [F.col("block")], _digests, "conv string, audit string, repaired_sha256 string")
    sums = marked.groupBy("conv").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "repeated", "cut")])
    turns = marked.filter(F.col("turn").isNotNull()).select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    illegal = led.select("conv", "inner").unionByName(entered.select("conv", F.col("seam").alias("inner"))).groupBy("conv").agg(
        F.sum("inner").alias("illegal"))
    cost = behind.groupBy("conv").agg(F.min_by("cost", "block").alias("cost"))
    report = (sums.join(turns, "conv", "left").join(illegal, "conv").join(cost, "conv").join(hashed, "conv")
              .select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank",
                      F.col("repeated").alias("duplicate"), F.col("cut").alias("truncated"), "illegal", "cost", "audit",
                      "repaired_sha256"))
    return report, pieces


def _repaired(conversations: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Short conversations' reports with turns; long ones' reports and blocks (None where there are none)."""
    rows = damage(conversations)
    many = cut_lineage(rows.groupBy("conv").count().filter(F.col("count") > long_rows).select("conv", F.lit(True).alias("long")))
    report = blocks = None
    if not many.isEmpty():
        sided = salted_join(rows, many, "conv", "left", salt_cols=["conv", "turn", "text"])
        rows = sided.filter("long IS NULL").drop("long")
        report, blocks = _long_blocks(sided.filter("long").drop("long"))
    # the struct's order is the conversation's: NULL turns first, then turn, role and text
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return listed.mapInArrow(_short, f"{_REPORT}, {_TURNS}"), report, blocks


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken after the damage, by turn (NULLs first), then role and text,
    so that the order is defined where turns repeat.

    Edge cases: a NULL conv_id is a conversation of its own; a NULL role or text
    is one space (and so a blank row, or an initial that never fits); repeated
    rows are duplicates after the first; a conversation without rows after the
    damage has zeros, an empty audit and the hash of the empty text; an empty
    table gives an empty result; only conv_id, turn, role and text are read.
    """
    short, report, _ = _repaired(conversations, long_rows)
    found = short.drop("turns")
    found = found if report is None else found.unionByName(report)
    every = conversations.select("conv_id", _key("conv_id").alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def repaired_turns(conversations: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """The repaired rows: conv_id, block, place, edit (K, R or I), role, text; in order of (block, place).

    The inserts that close a long conversation are in its last block's place
    after its rows.  Edge cases as in :func:`repair`; a conversation without
    turns has no row.
    """
    short, _, blocks = _repaired(conversations, long_rows)
    out = short.select("conv", F.lit(0).cast("long").alias("block"), F.posexplode("turns").alias("place", "t"))
    if blocks is not None:
        last = blocks.groupBy("conv").agg(F.max("block").alias("block"))
        closing = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("edit", "role", "text"), t)])
                                      for t in ending(s)]).cast("array<struct<edit:string,role:string,text:string>>")
                            for s in range(4)])
        ends = last.withColumn("is_last", F.lit(True))
        whole = blocks.join(ends, ["conv", "block"], "left").withColumn(
            "turns", F.when(F.col("is_last"), F.concat("turns", F.get(closing, F.col("leaves").cast("int")))).otherwise(F.col("turns")))
        out = out.unionByName(whole.select("conv", "block", F.posexplode("turns").alias("place", "t")))
    ids = conversations.select("conv_id", _key("conv_id").alias("conv")).distinct()
    return out.join(ids, "conv").select("conv_id", "block", "place", "t.edit", "t.role", "t.text")
