"""Line dedup against brute force: hot lines, ties, repeated rows, NULLs, clashing names."""

import random
from collections import defaultdict

from llm.conftest import edge_rows, frame, sentence

from tracefuse.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[line.strip(SPACES).translate(LOWER)].add(r[0])
    gone = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items()
            if len(k) >= 20 and len(ids) >= 3}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if (k := x.strip(SPACES).translate(LOWER)) not in gone or r[0] is not None and gone[k] == r[0]]
        out.append((r[0], len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    pool = [sentence(rnd, rnd.randint(1, 12)) for _ in range(40)]
    common = "subscribe to our daily newsletter and read on"
    rows = edge_rows()
    for i in range(300):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 6))] + [sentence(rnd, 8)]
        lines = [f"  {x.upper()}\t" if rnd.random() < 0.2 else x for x in lines]
        if i % 3:
            lines.insert(rnd.randrange(len(lines)), common)
        rows.append((1000 + i, "\n".join(lines), "en", "hot", 1))
    rows += rows[-5:]  # repeated rows
    rows += [(1001, "another text of one document\n" + common, "en", None, 1)] * 2
    rows += [(None, common + "\n" + pool[0], "en", None, 1)] * 4
    # 19 and 20 code points, also with letters of two bytes
    rows += [(2000 + i, "é" * 19 + "\n" + "é" * 20 + "\n" + "x" * 19 + "\n" + "x" * 20, "fr", "s", 1) for i in range(3)]
    rows += [(3000 + i, "only two documents hold this line\nonly two documents hold this line", "en", "s", 1) for i in range(2)]
    return rows


def test_against_brute_force(lspark, monkeypatch):
    rows = corpus()
    for hot, clash in ((line_dedup.HOT_LINES, False), (20, True), (1, False)):  # all, some and no lines broadcast
        monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
        got = line_dedup.dedup_lines(frame(lspark, rows, clash)).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == brute(rows)


def test_line_stays_once_in_the_largest_document(lspark):
    line = "this very line is found in all of the documents"
    rows = [(i, f"own words {i}\n{line}\n{line}", "en", "s", 1) for i in (7, 3, 9, 5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(lspark, rows)).collect()}
    assert {i: r.n_dropped for i, r in got.items()} == {7: 2, 3: 2, 9: 0, 5: 2}
    assert got[3].text == "own words 3" and got[9].text == rows[2][1]


def test_very_long_text_and_empty_table(lspark):
    long = "\n".join(f"line number {i % 5000} of the long text" for i in range(60_000))
    rows = [(1, long, "en", "s", 1)] + [(i, "line number 7 of the long text", "en", "s", 1) for i in (2, 3)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(lspark, rows)).collect()}
    assert got[1].n_lines == 60_000 and got[1].n_dropped == 12 and got[2].text == "" and got[3].n_dropped == 0
    assert line_dedup.dedup_lines(frame(lspark, []).limit(0)).count() == 0
