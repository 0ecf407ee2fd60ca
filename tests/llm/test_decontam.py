"""Occurrences against brute-force semi-global alignment; planted passages and edge cases."""

import random
import tracemalloc
from collections import Counter

from llm.conftest import edge_rows, frame, sentence

from tracefuse.llm import decontam

ITEM = "item_id long, text string"


def fewest_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def damaged(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        p = rnd.randrange(len(out))
        kind = rnd.random()
        if kind < 1 / 3:
            out[p] = rnd.choice("abc xyz")
        elif kind < 2 / 3:
            del out[p]
        else:
            out.insert(p, rnd.choice("abc xyz"))
    return "".join(out)


def test_against_brute_force():
    rnd = random.Random(11)
    hits = 0
    for _ in range(120):
        item = sentence(rnd, rnd.randint(3, 30))
        norm = decontam.normalise(item)
        text = f"{sentence(rnd, 30)} {damaged(rnd, norm, rnd.randint(0, len(norm) // 8 + 1))} {sentence(rnd, 30)}"
        index = decontam.ItemIndex([(7, item)])
        true = fewest_edits(norm, decontam.normalise(text))
        got = decontam.find_items(index, text)
        if true <= index.edits[0]:
            hits += 1
            assert [(i, e) for i, e, _ in got] == [(7, true)]
        else:
            assert not got
    assert 30 < hits < 110


def test_many_items_and_surface_changes():
    rnd = random.Random(12)
    items = [(i, sentence(rnd, 25)) for i in range(50)]
    index = decontam.ItemIndex(items)
    for i, t in items:
        text = sentence(rnd, 300) + "\n" + t.upper().replace(" ", " -- ") + "!\n" + sentence(rnd, 300)
        assert i in [k for k, _, _ in decontam.find_items(index, text)]
        assert decontam.find_items(index, t) and not decontam.find_items(index, sentence(rnd, 400))


def test_short_items_are_whole_words():
    index = decontam.ItemIndex([(1, "42"), (2, "Paris!"), (3, "a b"), (4, "..."), (5, "42"), (6, "long enough item")])
    assert decontam.find_items(index, "in PARIS it was 42, a-b") == [(1, 0, 18), (2, 0, 8), (3, 0, 22), (5, 0, 18)]
    assert decontam.find_items(index, "parisian 420 ab") == [] == decontam.find_items(index, "")
    assert [i for i, _, _ in decontam.find_items(index, "a long enough item 42")] == [1, 5, 6]


def plain_diagonals(index, chars):
    out = Counter()
    for at, h in zip(*index.shared(chars)):
        for k in range(index.first[h], index.first[h + 1]):
            out[int(index.item[k]), int(at - index.pos[k])] += 1
    return out


def test_repetitive_texts_count_like_all_pairs(monkeypatch):
    rnd = random.Random(13)
    items = [(1, "ha ha " * 40), (2, "ha ha " * 5 + sentence(rnd, 20)), (3, sentence(rnd, 30))]
    text = decontam.normalise("ha " * 300 + items[2][1] + " ha" * 200 + sentence(rnd, 50))
    for dense, run, block in ((64, 1 << 20, 1 << 17), (0, 50, 64), (1, 100, 200), (4, 1, 1 << 10)):
        monkeypatch.setattr(decontam, "_DENSE", dense)
        monkeypatch.setattr(decontam, "_RUN", run)
        monkeypatch.setattr(decontam, "_BLOCK", block)
        index = decontam.ItemIndex(items)
        chars = decontam.codes(text)
        got = Counter()
        for item, diagonal, counts in index.diagonals(chars):
            for i, d, n in zip(item.tolist(), diagonal.tolist(), [1] * len(item) if counts is None else counts.tolist()):
                got[i, d] += n
        assert got == plain_diagonals(index, chars)
        assert [i for i, e, _ in decontam.find_items(index, text) if e == 0] == [1, 3]


def test_long_repetitive_text_in_bounded_memory():
    index = decontam.ItemIndex([(1, "ha ha " * 1000)])
    tracemalloc.start()
    assert decontam.find_items(index, "ha " * 2_700_000)[0][:2] == (1, 0)  # 8 MB: 1.8e9 pairs a q-gram
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_tables(lspark):
    rows = edge_rows()
    passage = rows[7][1]
    bench = lspark.createDataFrame([(1, passage), (2, passage), (3, None), (4, ""), (5, "abc"), (None, "zz zz zz zz zz zz zz"),
                                    (6, "one two")], ITEM).selectExpr("*", "1 as doc_id", "2 as edits")
    for clash in (False, True):
        df = frame(lspark, rows, clash)
        for block in (decontam.BLOCK_CHARS, 700):  # one block of items and several
            got = sorted((r.doc_id, r.item_id, r.edits) for r in decontam.contamination(df, bench, block).collect())
            want = [(d, i, 0) for d in (6, 7, 7, 12) for i in (1, 2)] + [(8, 1, 2), (8, 2, 2)]
            assert got == sorted(want)
            kept = decontam.drop_contaminated(df, bench, block)
            assert kept.columns == df.columns
            assert kept.count() == len(rows) - 5
    empty = frame(lspark, []).limit(0)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(frame(lspark, rows), bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(frame(lspark, rows), bench.limit(0)).count() == len(rows)
