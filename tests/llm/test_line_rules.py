"""Base measures against brute force; verdicts on planted boilerplate, copies and edge cases."""

import random
import re
from collections import Counter

from llm.conftest import edge_rows, frame, sentence

from tracefuse.llm import line_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(wins)
    covered = {p for i, w in enumerate(wins) if often[w] > 1 for p in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered), failed)


def test_measures_against_brute_force(lspark):
    rows = edge_rows()
    for clash in (False, True):
        got = line_rules.judge(frame(lspark, rows, clash)).collect()
        have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                       for r in got), key=str)
        assert have == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
        assert not any(r.kept for r in got if r.base_failed)


def test_repeat_words_property():
    rnd = random.Random(2)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 60))]
        assert line_rules.repeat_words(words) == brute(b" ".join(words).decode())[4]


def corpus():
    rnd = random.Random(9)
    common = "subscribe to our daily newsletter and read on"
    rows = [(i, sentence(rnd, 60) + "\n" + common, "en", "hot", 1) for i in range(80)]
    rows += [(200 + i, common + "\n" + sentence(rnd, 2) + "\n" + "SUBSCRIBE to our daily  newsletter and read on\n" + common,
              "en", "hot", 1) for i in range(5)]
    copy = "\n".join(sentence(rnd, 12) for _ in range(6))
    rows += [(300 + i, copy, "en", "hot", 1) for i in range(60)]
    near = [copy.replace("\n", f"\n{sentence(rnd, 3)} ", 1) for _ in range(9)]  # with the copies ten texts: not above the limit
    rows += [(400 + i, t, "en", "hot", 1) for i, t in enumerate(near)]
    rows += [(500 + i, sentence(rnd, 40) + "\n" + common, "en", None, 1) for i in range(30)]
    return rows, common


def test_frequent_lines_reject_depleted_documents_only(lspark, monkeypatch):
    rows, common = corpus()
    df = frame(lspark, rows)
    for bound in (1, 20, 10_000):  # no, some and all lines broadcast
        monkeypatch.setattr(line_rules, "HOT_LINES", bound)
        got = {r.doc_id: r for r in line_rules.judge(df).collect()}
        assert len(got) == len(rows)
        for i, r in got.items():
            assert r.kept == (not 200 <= i < 300), (i, r)
            # copies are one document: with nine other texts their lines are at the limit and stay
            assert r.removed_words == (0 if 300 <= i < 500 else 24 if 200 <= i < 300 else 8), (i, r.removed_words)


def test_lines_that_come_together_are_all_frequent(lspark):
    rnd = random.Random(11)
    same = [sentence(rnd, 6) for _ in range(5)]
    rows = [(i, "\n".join([*same[:3], sentence(rnd, 120), *same[3:]]), "en", "site", 1) for i in range(120)]
    rows += [(500 + i, "\n".join([*same, sentence(rnd, 4)]), "en", "site", 1) for i in range(4)]
    got = {r.doc_id: r for r in line_rules.judge(frame(lspark, rows)).collect()}
    assert all(r.removed_words == 30 and r.kept == (i < 500) for i, r in got.items())


def test_strip_and_keep(lspark):
    rows, common = corpus()
    df = frame(lspark, rows, clash=True)
    kept = line_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 5
    out = {r.doc_id: r.text for r in line_rules.strip_lines(df).collect()}
    assert len(out) == len(rows) - 5
    assert not any(common in t for t in out.values())
    before = {r[0]: r[1] for r in rows}
    assert all(out[i] == before[i] for i in [*range(300, 360), *range(400, 409)])


def test_empty_table(lspark):
    df = frame(lspark, []).limit(0)
    assert line_rules.judge(df).count() == 0 and line_rules.keep_good(df).count() == 0


def test_copy_group_does_not_hide_a_line(lspark):
    """A footer in many unrelated documents and one large group of copies."""
    rnd = random.Random(21)
    footer = "all about us and where to find our offices"
    copy = sentence(rnd, 60) + "\n" + footer
    rows = [(i, sentence(rnd, 60) + "\n" + footer, "en", "big", 1) for i in range(40)]
    rows += [(1000 + i, copy, "en", "big", 1) for i in range(600)]
    got = {r.doc_id: r for r in line_rules.judge(frame(lspark, rows)).collect()}
    assert all(r.removed_words == 9 and r.kept for r in got.values())


def test_template_pages_are_depleted(lspark):
    """Pages of two shared lines and a short line of their own are distinct documents."""
    rnd = random.Random(22)
    for pages in (30, 400):
        shared = [sentence(rnd, 45), sentence(rnd, 45)]
        rows = [(i, "\n".join([shared[0], sentence(rnd, 10), shared[1]]), "en", "site", 1) for i in range(pages)]
        got = line_rules.judge(frame(lspark, rows)).collect()
        assert all(r.removed_words == 90 and not r.kept for r in got)


def test_template_pages_that_differ_in_a_word_or_a_figure(lspark):
    """Different texts are different documents; equal ones count once however many there are."""
    rnd = random.Random(23)
    shared = [sentence(rnd, 45), sentence(rnd, 45)]
    for own in (lambda i: f"page number {i} of this house", lambda i: f"the word of the day is w{i:04x}x here"):
        rows = [(i, "\n".join([shared[0], own(i), shared[1]]), "en", "site", 1) for i in range(40)]
        got = line_rules.judge(frame(lspark, rows)).collect()
        assert all(not r.kept and r.removed_words >= 90 for r in got)
    copies = [(i, "\n".join([shared[0], "page number 1", shared[1]]), "en", "site", 1) for i in range(400)]
    assert all(r.kept and not r.removed_words for r in line_rules.judge(frame(lspark, copies)).collect())


def brute_verdicts(rows):
    """Distinct texts per (host, normalised line), over all rows."""
    import re as _re
    def keys(text):
        out = {}
        for line in (text or "").split("\n"):
            w = _re.findall(r"[^\x20\x09-\x0D]+", line)
            if w:
                k = _re.sub("[1-9]", "0", _re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(w)))
                out[k] = out.get(k, 0) + len(w)
        return out
    holders = {}
    for r in rows:
        for k in keys(r[1]):
            holders.setdefault((r[3], k), set()).add(r[1] or "")
    out = []
    for r in rows:
        gone = sum(n for k, n in keys(r[1]).items() if len(holders[r[3], k]) > 10)
        n, failed = brute(r[1])[0], brute(r[1])[5]
        out.append((r[0], gone, not failed and not 100 * (n - gone) < 20 * n))
    return sorted(out, key=str)


def test_verdicts_against_brute_force(lspark):
    rows = edge_rows() + corpus()[0]
    rnd = random.Random(31)
    pool = [sentence(rnd, 7) for _ in range(25)]
    rows += [(2000 + i, "\n".join(rnd.choice(pool) for _ in range(6)), "en", rnd.choice(["s0", None, "hot"]), 1) for i in range(200)]
    got = line_rules.judge(frame(lspark, rows)).collect()
    assert sorted(((r.doc_id, r.removed_words, r.kept) for r in got), key=str) == brute_verdicts(rows)


def test_clashing_names(lspark):
    from pyspark.sql import functions as F
    rows, _ = corpus()
    names = ("_id", "_key", "_keys", "_host", "_bad_id", "_bad_key", "v_id", "v_key", "v_gone", "v_host", "c0", "c1", "c9", "f_host", "words")
    df = frame(lspark, rows).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for run in (line_rules.keep_good, line_rules.strip_lines):
        out = run(df)
        assert out.columns == df.columns and out.count() == len(rows) - 5
        assert out.select("v_gone", "c9", "_keys").distinct().collect() == [(8, 12, 2)]


def test_limit_does_not_grow_with_the_host(lspark):
    rnd = random.Random(24)
    footer = "printed by the same house as all the others"
    for size in (60, 3000):
        rows = [(i, sentence(rnd, 30) + ("\n" + footer if i < 13 else ""), "en", "large", 1) for i in range(size)]
        got = line_rules.judge(frame(lspark, rows)).collect()
        assert {r.doc_id for r in got if r.removed_words == 9} == set(range(13))
        assert {r.removed_words for r in got} == {0, 9}
