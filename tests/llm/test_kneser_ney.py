"""The model against a dictionary implementation, its total probability, its files and edge cases."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import edge_rows, frame

from tracefuse.llm import kneser_ney as kn
from tracefuse.llm.common import splitmix64, unmix64


def words_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [w for w in low.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ")
            .replace(b"\x0c", b" ").split(b" ") if w] + [None]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


class Brute:
    def __init__(self, rows):
        train = [words_of(t) for i, t in rows if crc(i) % 10 != 0]
        self.c = Counter(w for d in train for w in d)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter((h, w) for d in train for h, w in zip(["<s>", *d], d))
        self.total, self.kinds, self.before = Counter(), defaultdict(Counter), Counter()
        for (h, w), n in self.pairs.items():
            self.total[h] += n
            self.kinds[h][min(n, 3)] += 1
            self.before[w] += 1
        self.d = self.disc(self.pairs.values())
        self.e = self.disc(self.before.values())
        self.types = len(self.pairs)

    @staticmethod
    def disc(values):
        n = Counter(values)
        return kn.discounts(n[1], n[2], n[3], n[4])

    def low(self, w):
        a = self.before[w]
        own = max(a - (self.e[min(a, 3) - 1] if a else 0), 0) / self.types
        return own + sum(self.e[min(x, 3) - 1] for x in self.before.values()) / self.types / (self.v + 1)

    def p(self, h, w):
        if not self.total[h]:
            return self.low(w)
        n = self.pairs[h, w]
        gamma = sum(self.d[k - 1] * m for k, m in self.kinds[h].items()) / self.total[h]
        return max(n - (self.d[min(n, 3) - 1] if n else 0), 0) / self.total[h] + gamma * self.low(w)

    def row(self, i, text):
        d = words_of(text)
        return (i, crc(i) % 10 == 0, len(d), sum(self.c[w] > 0 for w in d), self.n,
                sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in d),
                sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *d], d)))


def test_against_brute_force(lspark):
    rows = [r for r in edge_rows() if r[0] != 10] + edge_rows(2)[16:]
    brute = Brute([(r[0], r[1]) for r in rows])
    words = [*brute.c, "unknown"]
    for h in ("<s>", b"the", b"of", b"unknown"):
        assert sum(brute.p(h, w) for w in words) == pytest.approx(1)
    for clash in (False, True):
        got = sorted(kn.score_documents(frame(lspark, rows, clash)).collect(), key=lambda r: str(tuple(r)[:4]))
        want = sorted((brute.row(r[0], r[1]) for r in rows), key=lambda r: str(r[:4]))
        assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
        have = sorted((r.base_score, r.score, r.perplexity) for r in got)
        need = sorted((w[5], w[6], 10 ** (-w[6] / w[2])) for w in want)
        assert np.allclose(have, need, rtol=1e-9)


def test_files_are_removed_and_mix_is_invertible(lspark):
    kn.score_documents(frame(lspark, edge_rows())).count()
    folder = lspark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("kn-")]
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (unmix64(splitmix64(x)) == x).all()


def test_counts_above_32_bits(tmp_path):
    keys = np.sort(splitmix64((np.arange(4, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)))
    model = kn.Model(str(tmp_path), 0, 0, np.array([0, 10]), 0, 10)
    tasks = [np.array([2**32 - 1, 7, 2**32 - 1, 1], "<u4"), np.array([2**32 - 1, 1, 0, 1], "<u4")]
    group = pa.table({"part": pa.array([0, 0], pa.int32()), "keys": [keys.tobytes()] * 2, "counts": [t.tobytes() for t in tasks]})
    kn._write_pairs(model)(group)
    pairs = kn.SortedParts(kn.ModelStore(str(tmp_path)), "pairs", 0)
    asked = np.sort(np.append(keys, np.uint64(5)))
    want = dict(zip(keys.tolist(), [2**33 - 2, 8, 2**32 - 1, 2]))
    assert kn.pair_counts(pairs, asked).tolist() == [want.get(k, 0) for k in asked.tolist()]


def test_empty_and_no_training(lspark):
    assert kn.score_documents(frame(lspark, []).limit(0)).count() == 0
    only_held = frame(lspark, [(None, "a b", None, None, None)])
    r = kn.score_documents(only_held).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
