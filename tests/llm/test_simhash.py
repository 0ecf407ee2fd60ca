"""Fingerprints, links and components against a brute-force version."""

import random

import xxhash
from llm.conftest import edge_rows, frame
from pyspark.sql import functions as F

from tracefuse.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits=4):
    seen, out = {}, {}
    for start in fps:
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in group and bin(x ^ y).count("1") <= max_bits:
                    group.add(y)
                    todo.append(y)
        for g in group:
            seen[g], out[g] = start, frozenset(group)
    return out


def expected(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_components(sorted(set(fps)))
    first = {}
    for r, f in zip(rows, fps):
        g = groups[f]
        if r[0] is not None:
            first[g] = min(first.get(g, r[0]), r[0])
    return sorted(((r[0], f"{f:016x}", first.get(groups[f])) for r, f in zip(rows, fps)), key=str)


def test_documents_against_brute_force(lspark):
    rows = edge_rows()
    for clash in (False, True):
        got = sorted(map(tuple, simhash.near_duplicates(frame(lspark, rows, clash)).collect()), key=str)
        assert got == expected(rows)


def test_links_against_brute_force(lspark):
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(4):  # chains of near fingerprints, with 1 to 6 bits changed
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = lspark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [tuple(r) for r in simhash.links(df).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_long_chain_is_one_component(lspark):
    edges = lspark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(4)
    roots = dict(map(tuple, simhash.star_roots(edges).collect()))
    assert all(roots[i] == 0 for i in range(1, 301)) and roots[1001] == 1000


def test_star_with_hubs_is_salted(lspark, monkeypatch):
    rnd = random.Random(9)
    edges = [(5000 + i, i) for i in range(600)] + [(5000, 9000)] + [(7, 8000 + i) for i in range(300)]  # two hubs and more
    edges += [(9000, 10000 + i) for i in range(700)] + [(20000 + i, 20001 + i) for i in range(40)]
    rnd.shuffle(edges)
    df = lspark.createDataFrame(edges, "a long, b long").repartition(4)
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, seen = {}, set()
    for start in sorted(near):
        todo = [start] if start not in seen else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                want[x] = start
                todo += near[x]
    for salt_edges in (8, 1 << 30):
        monkeypatch.setattr(simhash, "SALT_EDGES", salt_edges)
        got = dict(map(tuple, simhash.star_roots(df).collect()))
        assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) <= set(want.values())


def test_with_least_joins_every_edge_once(lspark, monkeypatch):
    rnd = random.Random(2)
    edges = sorted({(rnd.choice((1, 1, 1, 2, rnd.randrange(50))), rnd.randrange(1000)) for _ in range(3000)})
    df = lspark.createDataFrame(edges, "a long, b long")
    low = df.groupBy("a").agg(F.min("b").alias("m"))
    least = {a: min(b for x, b in edges if x == a) for a, _ in edges}
    monkeypatch.setattr(simhash, "SALT_EDGES", 40)
    _, hot = simhash._load(df)
    assert hot and max(s for _, s in hot) > 10
    for cells in ([], hot):
        got = sorted(map(tuple, simhash._with_least(df, low, cells).collect()))
        assert got == [(a, b, least[a]) for a, b in edges]


def test_one_per_group_with_repeated_ids(lspark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long, "x"), (1, long, "a"), (1, long.upper(), "b"), (1, "other words of it and more", "y"), (2, long, "q"),
            (3, "a text of its own that is alone", "z"), (None, "nothing else is like this one text", "n"),
            (None, "nothing else is like this one text", "m")]
    df = lspark.createDataFrame(rows, "doc_id long, text string, _fp string").repartition(5)
    got = {tuple(r) for r in simhash.one_per_group(df).collect()}
    # of rows with one id and fingerprint the smallest text stays, then the smallest row
    assert got == {(1, long.upper(), "b"), (1, "other words of it and more", "y"), rows[5], rows[7]}


def test_one_per_group_keeps_columns_and_one_row(lspark):
    rows = edge_rows()
    want = expected(rows)
    for clash in (False, True):
        df = frame(lspark, rows, clash)
        kept = simhash.one_per_group(df)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
        # one row a component; the blank texts form one whose smallest id is 1
        assert sorted(ids) == sorted({c for _, _, c in want if c is not None})


def test_empty_table(lspark):
    df = frame(lspark, []).limit(0)
    assert simhash.near_duplicates(df).count() == 0 and simhash.one_per_group(df).count() == 0
