"""Spelling variant grouping by pivotal grams.

Words are counted over the whole corpus, and two words are near when they differ
by one inserted, deleted or replaced code point.  Bigrams are ordered by the
number of words that hold them, rarest first.  A word's *prefix* is its three
rarest bigram occurrences (with all ties of the third); its *pivots* are the two
disjoint prefix bigrams whose frequencies add up to the least, found by dynamic
programming over positions.  One edit destroys at most one of two disjoint
bigrams, so of two near words the one whose prefix ends earlier in the order
has a pivot in the prefix of the other (every bigram up to the prefix's end is
in the prefix).

Position limits.  The edit lies on one side of a pivot, so the other side is
equal as a whole: everything up to the end of the left pivot (edit behind it) or
everything from the start of the right pivot (edit before it).  Of the rest of
the other word, its first or its second half is free of the edit, too.  A probe
is therefore the untouched side, the length of the other word and one untouched
half; the index holds the same of every prefix bigram, a join on the 64-bit hash
of that key proposes pairs and the join condition verifies order and distance.

Scale: everything after the count works on distinct words.  The bigram order
has at most 90 x 90 entries (the alphabet is 26 + 64 letters), which bounds what
the driver sends to the tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes, blobs
from tracefuse.session import cut_lineage

MIN_LETTERS = 5
MIN_COUNT = 3
#: a form has at least this many times the word's occurrences
FORM_RATIO = 2
MODULUS = 97
#: bigrams of a word's prefix: gram length x edits + 1
PREFIX = 3
_FLUSH = 1_000_000
_SLICE = 4_000_000
#: runs counted at once
_GROUP = 200_000

# one byte per letter (Latin-1): a-z and U+00C0-U+00FF stay, A-Z are lower-cased, all else separates
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


# ---- counting ------------------------------------------------------------------------

def _runs(text: bytes):
    """The lower-cased letter runs of a text as Latin-1 bytes, in lists of about ``_SLICE`` bytes."""
    flat = text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS)
    at = 0
    while len(flat) - at > _SLICE:
        end = flat.find(b" ", at + _SLICE)
        if end < 0:
            break
        yield flat[at:end].split()
        at = end
    yield flat[at:].split()


def _crc_table() -> np.ndarray:
    """What one more zero byte does to a CRC register, by its low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()
#: runs of up to this many UTF-8 bytes share a document's table of shifted CRCs
_SHIFTS = 64


class _Counts:
    """Counts of damaged runs.

    crc32(id ':' run) is taken apart: crc(A+B) is crc(A) moved by B's length in
    zero bytes, xor crc(B).  A run's part is computed once a distinct run, a
    document's part once a length, and the rest is array arithmetic.
    """

    def __init__(self):
        self.ids: dict[bytes, int] = defaultdict(count().__next__)  # the next number for a new run
        self.crcs, self.sizes, self.counts = (np.zeros(0, k) for k in (np.uint32, np.int64, np.int64))
        self.damaged: Counter = Counter()

    def _describe(self, new: list[bytes]) -> None:
        """Makes room for new runs: CRC and length of each in UTF-8."""
        coded = [r if r.isascii() else r.decode("latin-1").encode() for r in new]
        self.crcs = np.concatenate([self.crcs, np.fromiter(map(zlib.crc32, coded), np.uint32, len(new))])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, coded), np.int64, len(new))])
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])

    def add(self, docs: list[str], runs: list[list[bytes]]) -> None:
        """Counts the runs of some documents."""
        known, flat = len(self.ids), list(chain.from_iterable(runs))
        at = np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))
        if len(self.ids) > known:
            self._describe(list(islice(self.ids, known, None)))
        starts = np.fromiter((zlib.crc32(f"{d}:".encode()) for d in docs), np.uint32, len(docs))
        moved = np.empty((_SHIFTS + 1, len(docs)), np.uint32)
        moved[0] = starts
        for n in range(_SHIFTS):
            moved[n + 1] = (moved[n] >> 8) ^ _CRC[moved[n] & 255]
        doc = np.repeat(np.arange(len(docs)), np.fromiter(map(len, runs), np.int64, len(runs)))
        sizes = self.sizes[at]
        h = self.crcs[at] ^ moved[np.minimum(sizes, _SHIFTS), doc]
        for i in np.flatnonzero(sizes > _SHIFTS).tolist():
            h[i] = zlib.crc32(flat[i].decode("latin-1").encode(), int(starts[doc[i]]))
        hit = h % np.uint32(MODULUS) == 0
        self.counts += np.bincount(at[~hit], minlength=len(self.counts))
        for i, code in zip(np.flatnonzero(hit).tolist(), h[hit].tolist()):
            r = flat[i]
            k = code % len(r)
            self.damaged[r[:k] + r[k + 1:]] += 1

    def rows(self, min_letters: int) -> pa.RecordBatch:
        for r, n in self.damaged.items():
            if r in self.ids:
                self.counts[self.ids[r]] += n
        held = [(r, n) for r, n in zip(self.ids, self.counts.tolist()) if n and len(r) >= min_letters]
        held += [(r, n) for r, n in self.damaged.items() if r not in self.ids and len(r) >= min_letters]
        return pa.RecordBatch.from_arrays([pa.array([r.decode("latin-1") for r, _ in held], pa.string()),
                                           pa.array([n for _, n in held], pa.int64())], ["word", "n"])


def count_words(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): damaged letter runs of at least ``min_letters`` code points and ``min_count`` occurrences."""

    def run(batches):
        held, ids, lists, size = _Counts(), [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), blobs(b.column(1))):
                for runs in _runs(text):
                    ids.append(doc or "")
                    lists.append(runs)
                    size += len(runs)
                    if size > _GROUP:
                        held.add(ids, lists)
                        ids, lists, size = [], [], 0
                        if len(held.ids) > _FLUSH:
                            yield held.rows(min_letters)
                            held = _Counts()
        held.add(ids, lists)
        yield held.rows(min_letters)

    return (docs.select(F.col("doc_id").cast("string").alias("doc_id"), as_bytes("text").alias("text"))
            .mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# ---- pivots and prefixes -------------------------------------------------------------

def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """(place, words) of every bigram, rarest first; at most 90 x 90 bigrams."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    rows = words.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {g: (place, n) for place, (n, g) in enumerate(sorted((r["count"], r["gram"]) for r in rows))}


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], int]:
    """Positions of the prefix bigrams (ascending) and the place of the last one in the order."""
    places = [order[word[i:i + 2]][0] for i in range(len(word) - 1)]
    last = sorted(places)[min(PREFIX, len(places)) - 1]
    return [i for i, p in enumerate(places) if p <= last], last


def pivots_of(word: str, positions: list[int], order: dict[str, tuple[int, int]], wanted: int = 2) -> list[int]:
    """``wanted`` disjoint prefix bigrams of least total frequency, ascending; ties go to the left.

    best[k] is the cheapest choice of k bigrams that end before a position,
    extended position by position (a bigram at p may follow one at p - 2 or less).
    """
    best: list[list[tuple[int, tuple[int, ...]]]] = []  # per prefix bigram: cheapest choice of k that ends with it
    for j, p in enumerate(positions):
        weight = order[word[p:p + 2]][1]
        mine = [(weight, (p,))]
        for k in range(1, wanted):
            before = [best[i][k - 1] for i in range(j) if positions[i] <= p - 2 and len(best[i]) >= k]
            if not before:
                break
            cost, chosen = min(before)
            mine.append((cost + weight, (*chosen, p)))
        best.append(mine)
    return list(min(b[wanted - 1] for b in best if len(b) >= wanted)[1])


def _halves(rest: int) -> tuple[int, int]:
    """Lengths of the halves of the other word's rest: the one beside the untouched side, and the far one."""
    return rest // 2, rest - rest // 2


def index_keys(word: str, positions: list[int]) -> list[int]:
    """Keys under which a word is found: both sides of each prefix bigram with either half of the rest."""
    size, out = len(word), []
    for p in positions:
        near, far = _halves(size - p - 2)
        head = word[:p + 2]
        out += [f"<{size}:{head}:n{word[p + 2:p + 2 + near]}", f"<{size}:{head}:f{word[size - far:]}"]
        near, far = _halves(p)
        tail = word[p:]
        out += [f">{size}:{tail}:n{word[p - near:p]}", f">{size}:{tail}:f{word[:far]}"]
    return [xxhash.xxh64_intdigest(k) for k in out]


def probe_keys(word: str, pivots: list[int]) -> list[int]:
    """Keys of the words that may be near: for each length of the other word, either half of its rest."""
    size, out = len(word), []
    left, right = pivots[0], pivots[-1]
    for other in (size - 1, size, size + 1):
        rest, have = other - left - 2, size - left - 2  # edit behind the left pivot
        if rest >= 0:
            near, far = _halves(rest)
            head = word[:left + 2]
            if near <= have:
                out.append(f"<{other}:{head}:n{word[left + 2:left + 2 + near]}")
            if far <= have:
                out.append(f"<{other}:{head}:f{word[size - far:]}")
        rest, have = other - (size - right), right  # edit before the right pivot
        if rest >= 0:
            near, far = _halves(rest)
            tail = word[right:]
            if near <= have:
                out.append(f">{other}:{tail}:n{word[right - near:right]}")
            if far <= have:
                out.append(f">{other}:{tail}:f{word[:far]}")
    return [xxhash.xxh64_intdigest(k) for k in dict.fromkeys(out)]


def _keyed(words: DataFrame, order: dict[str, tuple[int, int]], probes: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            keys, at, ends = [], [], []
            for i, word in enumerate(b.column(0).to_pylist()):
                positions, last = prefix_of(word, order)
                ends.append(last)
                mine = probe_keys(word, pivots_of(word, positions, order)) if probes else index_keys(word, positions)
                keys += mine
                at += [i] * len(mine)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.uint64).view(np.int64)), b.column(0).take(at), b.column(1).take(at),
                 pa.array(ends, pa.int32()).take(at)], ["key", "word", "n", "last"])

    return words.mapInArrow(run, "key long, word string, n long, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), each pair of near words once."""
    order = gram_order(words)
    a, b = _keyed(words, order, True).alias("a"), _keyed(words, order, False).alias("b")
    # the word whose prefix ends earlier probes; of equal ends the smaller word
    turn = (F.col("a.last") < F.col("b.last")) | ((F.col("a.last") == F.col("b.last")) & (F.col("a.word") < F.col("b.word")))
    on = (F.col("a.key") == F.col("b.key")) & turn & (F.levenshtein("a.word", "b.word", 1) == 1)
    return (a.join(b, on).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"),
                                 F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct())


def follow(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root): the last form of every word that has one; the chain's length halves each round."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = at.select(F.col("word").alias("mid"), F.col("root").alias("far"))
        moved = at.join(on, F.col("root") == F.col("mid"), "left")
        nxt = cut_lineage(moved.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if nxt.filter("moved").isEmpty():
            return nxt.select("word", "root")
        at = nxt.select("word", "root")
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root per distinct word.

    Edge cases: NULL and empty texts have no words; a NULL doc_id is written as
    the empty text where it decides about damage; repeated rows count again;
    of near words of equal count the smallest is the form; an empty table gives
    an empty result; only doc_id and text are read.
    """
    words = cut_lineage(count_words(docs))
    pairs = cut_lineage(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    # the largest count first, then the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    named = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    roots = follow(named.filter(F.col("form").isNotNull()))
    return (named.join(roots, "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
