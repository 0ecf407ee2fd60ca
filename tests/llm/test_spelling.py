"""Spelling variants: pivots, complete near pairs, forms and roots against brute force."""

import random
import re
import zlib
from collections import Counter

from llm.conftest import edge_rows, frame, sentence

from tracefuse.llm import spelling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(rows):
    n = Counter()
    for r in rows:
        for run, times in Counter(x.translate(LOWER) for x in re.findall("[A-Za-zÀ-ÿ]+", r[1] or "")).items():
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += times
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    near = {w: [x for x in words if distance_is_one(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words}


def typo(rnd, w):
    k = rnd.randrange(len(w))
    c = rnd.choice("abcdeé÷ÿ")
    return rnd.choice((w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]))


def corpus():
    rnd = random.Random(3)
    base = ["".join(rnd.choice(("the", "re", "ing", "ou", "é", "st", "an")) for _ in range(rnd.randint(2, 4))) for _ in range(60)]
    pool = []
    for w in base:
        near = w
        for times in (40, 13, 6, 3, 3):
            pool += [near] * times
            near = typo(rnd, near) if len(near) > 3 else near
    pool += ["aaaaa"] * 9 + ["aaaaaa"] * 4 + ["aaaab"] * 4 + ["baaaa"] * 4
    rnd.shuffle(pool)
    rows = edge_rows()
    rows += [(500 + i, "; ".join(pool[at:at + 40]).capitalize() + " 中", "en", "s", 1) for i, at in enumerate(range(0, len(pool), 40))]
    return rows + rows[-2:]


def test_against_brute_force(lspark):
    rows = corpus()
    words = brute_words(rows)
    want = brute(words)
    assert sum(v[1] for v in want.values()) > 100 and any(v[4] != v[2] for v in want.values() if v[2])
    for clash in (False, True):
        got = spelling.variants(frame(lspark, rows, clash)).collect()
        assert len(got) == len(want)
        assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want


def test_near_pairs_are_complete_over_a_small_alphabet(lspark):
    """Few letters: ties in the order, repeated bigrams, many pairs."""
    rnd = random.Random(8)
    words = {"".join(rnd.choice("ab" if i % 2 else "abc") for _ in range(rnd.randint(5, 8))): 1 + i for i in range(500)}
    df = lspark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df).collect()]
    assert sorted(got) == sorted((a, b) for a in words for b in words if a < b and distance_is_one(a, b))


def test_pivots_are_the_cheapest_disjoint_pair():
    rnd = random.Random(4)
    for _ in range(300):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 12)))
        grams = sorted({word[i:i + 2] for i in range(len(word) - 1)})
        weights = sorted((rnd.randint(1, 9), g) for g in grams)
        order = {g: (place, n) for place, (n, g) in enumerate(weights)}
        positions, last = spelling.prefix_of(word, order)
        assert all((order[word[i:i + 2]][0] <= last) == (i in positions) for i in range(len(word) - 1))
        a, b = spelling.pivots_of(word, positions, order)
        cost = {i: order[word[i:i + 2]][1] for i in positions}
        assert b - a >= 2 and cost[a] + cost[b] == min(cost[i] + cost[j] for i in positions for j in positions if j - i >= 2)


def test_counting_in_slices(lspark, monkeypatch):
    rows = [(1, sentence(random.Random(1), 400) + " Straßenbahn" * 30, "de", "s", 1), (2, "x" * 3000, "en", "s", 1)] * 2
    want = brute_words(rows)
    monkeypatch.setattr(spelling, "_SLICE", 50)
    assert [list(spelling._runs(b"ab cd" * 30))] and sum(map(len, spelling._runs(b"ab cd " * 30))) == 60
    held = spelling._Counts()
    for r in rows:
        runs = list(spelling._runs(r[1].encode()))
        held.add([str(r[0])] * len(runs), runs)
    got = held.rows(5).to_pydict()
    assert {w: n for w, n in zip(got["word"], got["n"]) if n >= 3} == want


def test_empty_table(lspark):
    assert spelling.variants(frame(lspark, []).limit(0)).count() == 0
