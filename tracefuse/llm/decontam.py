"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are normalised (case folded, letters and figures kept, everything else
one space).  An item of m characters may occur with up to e = floor(m *
EDIT_SHARE) edits.  By the q-gram lemma an occurrence shares at least
t = m + 1 - q * (e + 1) of the item's q-grams with the text, on diagonals that
differ by at most e.  Diagonals are cut into bands of width 2^z > e that
overlap by e, so one band holds them all: shared q-grams are counted per
(item, band), bands with t or more are retained, and each retained region is
verified by semi-global alignment within the band.  Shared q-grams are counted
in runs of bounded size; where a text and an item repeat a q-gram so often that
their pairs outnumber the characters by far, its diagonals are counted by a
convolution of the two position lists instead, block by block.  Items with
fewer than q normalised characters occur where their words do.

The items are the stated query set: they are taken in blocks of at most
``BLOCK_CHARS`` characters (their total is measured first), each block is
indexed once and broadcast, and all documents pass each block without a
shuffle.  Every q-gram position of every document is looked up; nothing is
sampled and no candidate is capped.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import texts

Q = 8
EDIT_SHARE = 0.08
#: items a block may hold: 16 million characters index in about 0.5 GB
BLOCK_CHARS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_TEXT = re.compile(r"[\W_]+")
_BITMAP_BITS = 22
#: shared q-grams expanded at a time
_RUN = 1 << 20
#: pairs of one q-gram per character of text and item above which diagonals are counted by convolution
_DENSE = 64
_BLOCK = 1 << 17


def normalise(text: str) -> str:
    return _NOT_TEXT.sub(" ", text.casefold()).strip()


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of every run of q characters."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = (chars.astype(np.uint64) + np.uint64(1)) * _BASE
    out = wide[:n].copy()
    for j in range(1, q):
        out *= np.uint64(0x100000001B3)
        out ^= wide[j:n + j]
    return out


class ItemIndex:
    """q-grams of a block of items: sorted hashes with their (item, position) lists."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_share: float = EDIT_SHARE):
        self.q = q
        normal = [(i, normalise(t)) for i, t in items]
        kept = [(i, n) for i, n in normal if len(n) >= q]
        # items without a q-gram, by their words
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, n in normal:
            if 0 < len(n) < q:
                self.short.setdefault(tuple(n.split(" ")), []).append(i)
        self.short_sizes = sorted({len(words) for words in self.short})
        self.ids = [i for i, _ in kept]
        self.texts = [n for _, n in kept]
        self.chars = [codes(n) for n in self.texts]
        m = np.array([len(c) for c in self.chars], np.int64)
        # an item of few characters gets the largest budget that leaves one shared q-gram
        self.edits = np.minimum((m * edit_share).astype(np.int64), np.maximum((m + 1 - q) // q, 0))
        self.edits -= (m + 1 - q * (self.edits + 1)) < 1
        self.edits = np.maximum(self.edits, 0)
        self.least = np.maximum(m + 1 - q * (self.edits + 1), 1)
        self.width = 1 << int(self.edits.max(initial=0)).bit_length()
        grams = [qgrams(c, q) for c in self.chars]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, np.int64)
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = item[order].astype(np.int32), pos[order].astype(np.int32)
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)
        # runs of one q-gram in one item
        owner = np.repeat(np.arange(len(self.hashes)), np.diff(self.first))
        self.run_first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (self.item[1:] != self.item[:-1])])) \
            if len(owner) else np.empty(0, np.int64)
        self.run_last = np.append(self.run_first[1:], len(owner))
        #: longest run of each q-gram
        self.longest = np.maximum.reduceat(self.run_last - self.run_first, np.searchsorted(self.run_first, self.first[:-1])) \
            if len(owner) else np.empty(0, np.int64)
        self.bitmap = np.zeros(1 << _BITMAP_BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)] = True

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text position, index of the q-gram) of every q-gram of the text that an item has."""
        grams = qgrams(chars, self.q)
        at = np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - _BITMAP_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.searchsorted(self.hashes, grams[at])
        found[found == len(self.hashes)] = 0
        same = self.hashes[found] == grams[at]
        return at[same], found[same]

    def diagonals(self, chars: np.ndarray):
        """(item, diagonal, shared q-grams on it) in arrays of bounded size; a diagonal may come in several parts.

        No counts (None): one for each entry.
        """
        at, found = self.shared(chars)
        sizes = self.first[found + 1] - self.first[found]
        if sizes.sum() > _DENSE * len(chars):  # some q-gram may be dense
            names, often = np.unique(found, return_counts=True)
            dense = names[often * self.longest[names] > _DENSE * len(chars)]
            for h in dense.tolist():
                yield from self._dense_diagonals(at[found == h], h, len(chars))
            plain = ~np.isin(found, dense)
            at, found, sizes = at[plain], found[plain], sizes[plain]
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _RUN, "right")))
            n = sizes[begin:stop]
            slot = np.arange(int(n.sum())) + np.repeat(self.first[found[begin:stop]] - (np.cumsum(n) - n), n)
            item = self.item[slot].astype(np.int64)
            yield item, np.repeat(at[begin:stop], n) - self.pos[slot], None
            begin = stop

    def _dense_diagonals(self, at: np.ndarray, h: int, length: int):
        """Diagonals of one q-gram that text positions ``at`` and some item repeat often."""
        runs = range(int(np.searchsorted(self.run_first, self.first[h])), int(np.searchsorted(self.run_first, self.first[h + 1])))
        for r in runs:
            pos = self.pos[self.run_first[r]:self.run_last[r]].astype(np.int64)
            item = int(self.item[self.run_first[r]])
            if len(at) * len(pos) <= _DENSE * length:
                step = max(1, _RUN // len(pos))
                parts = ((d, None) for i in range(0, len(at), step)
                         for d in [(at[i:i + step, None] - pos[None, :]).ravel()])
            else:
                parts = _convolved(at, pos)
            for diagonal, counts in parts:
                yield np.full(len(diagonal), item), diagonal, counts

    def regions(self, chars: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal of the band) of the retained bands."""
        low = -(max(map(len, self.chars), default=0) // self.width) - 2
        span = len(chars) // self.width + 2 - low
        held, n = [], 0
        for item, diagonal, counts in self.diagonals(chars):
            band = diagonal // self.width
            # a diagonal in the first e of a band also counts for the band before it
            again = (diagonal - band * self.width) < self.edits[item]
            keys = item * span + (band - low)
            both = None if counts is None else np.concatenate([counts, counts[again]])
            held.append(_added(np.concatenate([keys, keys[again] - 1]), both))
            n += len(held[-1][0])
            if n > 2 * _RUN:
                held = [_added(*map(np.concatenate, zip(*held)))]
                n = 0
        if not held:
            return []
        keys, counts = held[0] if len(held) == 1 else _added(*map(np.concatenate, zip(*held)))
        chosen = counts >= self.least[keys // span]
        return [(int(k // span), (int(k % span) + low) * self.width) for k in keys[chosen]]

    def short_hits(self, norm: str) -> dict[int, int]:
        """End of the first occurrence of every item below q characters, as whole words."""
        out: dict[int, int] = {}
        if not self.short:
            return out
        words = norm.split(" ")
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        for k in self.short_sizes:
            for i in range(len(words) - k + 1):
                for item in self.short.get(tuple(words[i:i + k]), ()):
                    out.setdefault(item, ends[i + k - 1] - 1)
        return out


def _added(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and their summed counts (None: one each)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    names, where = np.unique(keys, return_inverse=True)
    return names, np.bincount(where, counts, len(names)).astype(np.int64)


def _convolved(at: np.ndarray, pos: np.ndarray):
    """(diagonals, pairs on each) of all pairs of two ascending position lists, a block of ``at`` at a time."""
    first = int(pos[0])
    m = int(pos[-1]) - first + 1
    block = max(_BLOCK, m)
    size = 1 << (block + m).bit_length()
    back = np.zeros(size)
    back[m - 1 - (pos - first)] = 1
    back = np.fft.rfft(back)
    for base in range(int(at[0]), int(at[-1]) + 1, block):
        here = at[np.searchsorted(at, base):np.searchsorted(at, base + block)]
        if not len(here):
            continue
        marks = np.zeros(size)
        marks[here - base] = 1
        # whole numbers far below the precision of a double
        counts = np.rint(np.fft.irfft(np.fft.rfft(marks) * back, size)).astype(np.int64)
        some = np.flatnonzero(counts)
        yield some - (m - 1) + base - first, counts[some]


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """Fewest edits (at most ``budget``) of a whole-item occurrence on diagonals low..high, and its end.

    The occurrence may begin and end anywhere in ``text``; cell (i, k) of the
    band stands for text position low + i + k after i item characters.
    """
    width, n = high - low + 1, len(text)
    far = budget + 1
    steps = np.arange(width)
    ends = low + steps
    row = np.where((ends >= 0) & (ends <= n), 0, far)
    for i in range(1, len(item) + 1):
        ends = ends + 1
        inside = (ends >= 1) & (ends <= n)
        same = np.zeros(width, bool)
        same[inside] = text[ends[inside] - 1] == item[i - 1]
        new = row + ~same  # match or replace keeps the diagonal
        new[~inside] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # item character without a text character
        new[(ends < 0) | (ends > n)] = far
        new = np.minimum.accumulate(new - steps) + steps  # text characters without an item character
        new[(ends < 0) | (ends > n)] = far
        row = np.minimum(new, far)
        if row.min() > budget:
            return None
    k = int(row.argmin())
    return int(row[k]), int(low + len(item) + k)


def find_items(index: ItemIndex, text: str) -> list[tuple[int, int, int]]:
    """(item id, fewest edits, end in the normalised text) of every item that occurs."""
    norm = normalise(text)
    chars = codes(norm)
    best: dict[int, tuple[int, int]] = {}
    brief = [(i, 0, end) for i, end in index.short_hits(norm).items()]
    for item, low in index.regions(chars):
        budget = int(index.edits[item])
        most = best[item][0] - 1 if item in best else budget
        if most < 0:
            continue
        # the band with its overlap; edits may leave it by the budget on either side
        first, last = low - budget, low + index.width + 2 * budget
        start = max(first, 0)
        stop = last + len(index.chars[item]) + budget
        at = norm.find(index.texts[item], start, max(stop, 0))
        got = (0, at + len(index.texts[item])) if at >= 0 else \
            banded_distance(index.chars[item], chars, first, last, most)
        if got and (item not in best or got < best[item]):
            best[item] = got
    return sorted(brief + [(index.ids[i], d, e) for i, (d, e) in best.items()])


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Items in blocks of bounded size, each collected on its own (normalised duplicates stay)."""
    size = F.coalesce(F.length("text"), F.lit(0))
    total = benchmark.agg(F.sum(size).alias("n"), F.max(size).alias("top")).first()
    if not total.n:
        return
    blocks = max(1, -(-int(total.n) // block_chars))
    marked = benchmark.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for i in range(blocks):
        rows = marked.filter((F.col("block") == i) & F.col("text").isNotNull()).distinct().collect()
        yield [(r.item_id, r.text) for r in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, q: int = Q,
                  edit_share: float = EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, edits, end_at per document and item that occurs in it.

    ``end_at`` is the end of the best occurrence in the normalised text.

    Edge cases: NULL and empty texts match nothing; items with fewer than ``q``
    normalised characters match as whole words without edits, items with none
    never; items with equal
    texts each match; repeated documents each get their rows; an empty table on
    either side gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, end_at long"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(ItemIndex(items, q, edit_share))

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, i, e, at) for d, t in zip(b.column(0).to_pylist(), texts(b.column(1)))
                        for i, e, at in find_items(shared.value, t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "item_id", "edits", "end_at"])

        out = out.union(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` in which no benchmark item occurs; columns are those of ``docs``.

    Edge cases: rows with NULL or empty text stay; an empty benchmark keeps all
    rows; repeated rows go or stay together; no column but ``text`` is read, so
    further columns of any name pass unchanged; items as in :func:`contamination`.
    """
    at = docs.columns.index("text")
    for items in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))

        def run(batches, shared=shared):
            for b in batches:
                clean = [not find_items(shared.value, t) for t in texts(b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
