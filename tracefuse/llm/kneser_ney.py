"""Interpolated modified Kneser-Ney bigram model: counted in Spark, sorted hash arrays, memory-mapped.

Counting.  Tasks count words (64-bit hashes) and then bigrams of the training
documents locally, sort them, and send each hash range one packed array a task;
a range is merged in one task and written as a sorted array file.  The number
of ranges follows the number of input partitions, so a range stays small
however large the corpus is, and a hot word or pair is one pre-aggregated entry
a task.  A word's id is its place in the sorted word hashes; a bigram's key is
the invertibly mixed pair of ids, so keys are spread evenly and never collide.

Storing.  ``ModelStore`` keeps the files in the cluster's shared checkpoint
folder through pyarrow's file systems, written under a private name and moved,
so a repeated task is harmless.  Workers memory-map them (a copy in their own
temp folder, unlinked at once, where the shared folder is not a mounted path).
The files are removed when the scores have been written.

Scoring.  A batch looks up its distinct words and bigrams in sorted order.

p(w|h) = max(c(hw) - D, 0)/c(h) + gamma(h) p1(w), where p1 is the same formula
over continuation counts with the uniform 1/(V+1) below it (the 1 is for unknown
words); D is one of three discounts by count (1, 2, 3 and more).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes, blobs, id_crc32, splitmix64, unmix64
from tracefuse.session import cut_lineage, ensure_checkpoint_dir

HELD_MODULUS = 10
ADD = 0.1
#: hash of the end token (the empty word) and of the sentence start (no word holds a line end)
END = xxhash.xxh64_intdigest(b"")
_CACHE = 500_000
#: entries a task counts before it sends them on
_FLUSH = 6_000_000
_FLUSH_WORDS = 1_000_000
#: a larger count stands in a file of its own
_LARGE = 0xFFFFFFFF


# ---- files ---------------------------------------------------------------------------

class ModelStore:
    """Sorted arrays of one model under a shared folder."""

    def __init__(self, uri: str):
        if "://" not in uri:  # "file:/x" or a plain path
            uri = f"file://{os.path.abspath(uri.removeprefix('file:'))}"
        self.uri = uri

    def _at(self, name: str):
        fs, path = pafs.FileSystem.from_uri(self.uri)
        return fs, f"{path}/{name}"

    def write(self, name: str, values: np.ndarray) -> None:
        fs, path = self._at(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        private = f"{path}.{uuid.uuid4().hex}"
        with fs.open_output_stream(private) as out:
            out.write(np.ascontiguousarray(values).view(np.uint8).data if len(values) else b"")
        fs.move(private, path)

    def map(self, name: str, dtype: str) -> np.ndarray:
        fs, path = self._at(name)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound or not info.size:
            return np.empty(0, dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            return np.memmap(path, dtype, "r")
        with tempfile.NamedTemporaryFile() as copy, fs.open_input_stream(path) as src:
            while chunk := src.read(1 << 24):
                copy.write(chunk)
            copy.flush()
            return np.memmap(copy.name, dtype, "r")  # stays readable without its name

    def remove(self) -> None:
        fs, path = self._at("")
        fs.delete_dir(path.rstrip("/"))


class SortedParts:
    """One ascending sequence of 64-bit keys in range files; ranges are the keys' top bits."""

    def __init__(self, store: ModelStore, name: str, bits: int):
        self.store, self.name, self.bits = store, name, bits
        self.keys: dict[int, np.ndarray] = {}
        self.extra: dict[tuple[int, str], np.ndarray] = {}

    def part(self, k: int) -> np.ndarray:
        if k not in self.keys:
            self.keys[k] = self.store.map(f"{self.name}-{k}.keys", "<u8")
        return self.keys[k]

    def column(self, k: int, kind: str, dtype: str) -> np.ndarray:
        if (k, kind) not in self.extra:
            self.extra[k, kind] = self.store.map(f"{self.name}-{k}.{kind}", dtype)
        return self.extra[k, kind]

    def find(self, sorted_keys: np.ndarray):
        """(part, slice of the keys, places, found) per part that the ascending keys touch."""
        tops = (sorted_keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(sorted_keys), np.int64)
        names, first = np.unique(tops, return_index=True)
        for k, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_keys)]):
            part = self.part(k)
            if not len(part):
                yield k, slice(a, b), np.zeros(b - a, np.int64), np.zeros(b - a, bool)
                continue
            at = np.searchsorted(part, sorted_keys[a:b])
            at[at == len(part)] = 0
            yield k, slice(a, b), at, part[at] == sorted_keys[a:b]


# ---- counting ------------------------------------------------------------------------

_PACKED = "part int, keys binary, counts binary"


def _packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending keys and their counts, one row per range."""
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    names, first = np.unique(tops, return_index=True)
    ends = [*first[1:].tolist(), len(keys)]
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()),
         pa.array([keys[a:b].tobytes() for a, b in zip(first.tolist(), ends)], pa.binary()),
         pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(first.tolist(), ends)], pa.binary())],
        ["part", "keys", "counts"])


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and their summed counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.empty(0, counts.dtype)


def _merged(group: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(k, "<u8") for k in group["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(c, "<u4") for c in group["counts"].to_pylist()]).astype(np.int64)
    return group["part"][0].as_py(), *_summed(keys, counts)


def _count_words(bits: int):
    def run(batches):
        held, documents, tokens = Counter(), 0, 0

        def out():
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
            counts = np.fromiter(held.values(), np.int64, len(held))
            return _packed(*_summed(np.append(hashes, np.uint64(END)), np.append(counts, documents)), bits)

        for b in batches:
            for text in blobs(b.column(0)):
                documents += 1
                cut = text.lower().split()
                tokens += len(cut) + 1
                held.update(cut)
                if len(held) > _FLUSH_WORDS or tokens > _LARGE >> 1:  # counts travel in 32 bits
                    yield out()
                    held, documents, tokens = Counter(), 0, 0
        if documents:
            yield out()
    return run


@dataclass
class Model:
    """What a worker needs to open the model: a few numbers per range file."""

    uri: str
    word_bits: int
    pair_bits: int
    word_starts: np.ndarray  # first id of every word range
    train_tokens: int
    vocabulary: int
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    top_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_types: int = 0
    low_mass: float = 1.0


class Words:
    """Word to id (its place in the sorted hashes), -1 for unknown; remembered up to a bound."""

    def __init__(self, model: Model):
        self.parts = SortedParts(ModelStore(model.uri), "words", model.word_bits)
        self.starts = model.word_starts
        self.ids: dict[bytes, int] = {}
        self.end = int(self._lookup(np.array([END], np.uint64))[0])

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        order = np.argsort(hashes)
        ids = np.full(len(hashes), -1, np.int64)
        for k, where, at, found in self.parts.find(hashes[order]):
            ids[order[where]] = np.where(found, at + self.starts[k], -1)
        return ids

    def batch(self, documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens (each document ends with the end token) and tokens per document."""
        cut = [d.lower().split() for d in documents]
        if len(self.ids) > _CACHE:
            self.ids.clear()
        new = list(set().union(*cut).difference(self.ids)) if cut else []
        if new:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            self.ids.update(zip(new, self._lookup(hashes).tolist()))
        get, end = self.ids.__getitem__, self.end
        sizes = np.fromiter((len(c) + 1 for c in cut), np.int64, len(cut))
        ids = np.empty(int(sizes.sum()), np.int64)
        at = 0
        for c in cut:
            ids[at:at + len(c)] = np.fromiter(map(get, c), np.int64, len(c))
            at += len(c) + 1
            ids[at - 1] = end
        return ids, sizes


def _pair_keys(ids: np.ndarray, sizes: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(context id, pair) per token: the pair packs context and word in 32 bits each."""
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[np.cumsum(sizes) - sizes] = start_id
    return context, (context.astype(np.uint64) << np.uint64(32)) | (ids.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def _slices(column, size: int = 4_000_000):
    """Documents of a column in runs of about ``size`` bytes."""
    held, n = [], 0
    for t in blobs(column):
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _count_pairs(model: Model):
    def run(batches):
        words = Words(model)
        held, n = [], 0

        def out():
            return _packed(*_summed(splitmix64(np.concatenate(held))), model.pair_bits)

        for b in batches:
            for documents in _slices(b.column(0)):
                ids, sizes = words.batch(documents)
                held.append(_pair_keys(ids, sizes, model.vocabulary)[1])
                n += len(ids)
                if n >= _FLUSH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
    return run


_STATS = "part int, ids binary, ones binary, twos binary, more binary, before binary"


def _write_words(uri: str):
    def run(group: pa.Table) -> pa.Table:
        part, keys, counts = _merged(group)
        store = ModelStore(uri)
        store.write(f"words-{part}.keys", keys.astype("<u8"))
        store.write(f"words-{part}.counts", counts.astype("<i8"))
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([len(keys)], pa.int64()),
                         "tokens": pa.array([int(counts.sum())], pa.int64())})
    return run


def _write_pairs(model: Model):
    """Merges and writes one range of bigrams; returns what their words and contexts gain, by id range."""
    edges = model.word_starts

    def run(group: pa.Table) -> pa.Table:
        part, keys, counts = _merged(group)
        store = ModelStore(model.uri)
        store.write(f"pairs-{part}.keys", keys.astype("<u8"))
        store.write(f"pairs-{part}.counts", np.minimum(counts, _LARGE).astype("<u4"))
        if len(large := np.flatnonzero(counts >= _LARGE)):
            store.write(f"pairs-{part}.large", np.stack([large, counts[large]]).astype("<i8").reshape(-1))
        pairs = unmix64(keys)
        context, word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, inverse = np.unique(np.concatenate([context, word]), return_inverse=True)
        left, right = inverse[:len(context)], inverse[len(context):]
        kinds = [np.bincount(left[counts == 1], minlength=len(ids)), np.bincount(left[counts == 2], minlength=len(ids)),
                 np.bincount(left[counts > 2], minlength=len(ids)), np.bincount(right, minlength=len(ids))]
        top = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        slot = np.searchsorted(edges, ids, "right") - 1
        names, first = np.unique(slot, return_index=True)
        spans = list(zip(first.tolist(), [*first[1:].tolist(), len(ids)]))
        rows = {"part": pa.array(names, pa.int32()),
                # ids as gaps: small numbers, which the shuffle compresses
                "ids": pa.array([np.diff(ids[a:b], prepend=edges[s]).astype("<u4").tobytes()
                                 for s, (a, b) in zip(names.tolist(), spans)], pa.binary())}
        for name, kind in zip(("ones", "twos", "more", "before"), kinds):
            rows[name] = pa.array([kind[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())
        # the counts of counts travel as one more row of a range of their own
        rows["part"] = pa.concat_arrays([rows["part"], pa.array([-1], pa.int32())])
        for name in ("ids", "ones", "twos", "more", "before"):
            extra = np.array([*top, len(keys)], "<i8").tobytes() if name == "ids" else b""
            rows[name] = pa.concat_arrays([rows[name], pa.array([extra], pa.binary())])
        return pa.table(rows)
    return run


def _write_contexts(uri: str, starts: np.ndarray, sizes: np.ndarray):
    """Adds up one id range: followers by count of each word as context, and its continuation count."""

    def run(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        if part < 0:
            top = sum(np.frombuffer(x, "<i8") for x in group["ids"].to_pylist())
            values = [*top.tolist()]
        else:
            sums = np.zeros((4, int(sizes[part])), np.int64)
            for row in group.to_pylist():
                at = np.cumsum(np.frombuffer(row["ids"], "<u4").astype(np.int64))
                for i, name in enumerate(("ones", "twos", "more", "before")):
                    sums[i][at] += np.frombuffer(row[name], "<u4")
            store = ModelStore(uri)
            store.write(f"words-{part}.followers", sums[:3].T.astype("<u4").reshape(-1))
            store.write(f"words-{part}.before", sums[3].astype("<i8"))
            values = [*[int((sums[3] == k).sum()) for k in (1, 2, 3, 4)], int((sums[3] > 2).sum())]
        return pa.table({"part": pa.array([part], pa.int32()),
                         **{f"n{i + 1}": pa.array([int(v)], pa.int64()) for i, v in enumerate(values)}})
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from the counts of counts; within [0, count]."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a else k * 0.5
        found.append(min(max(d, 0.0), float(k)) or 1e-3)
    return tuple(found)


def _range_bits(docs: DataFrame) -> int:
    """Ranges follow the input's partitions (each at most a scan split): at least 8 and twice as many."""
    return max(3, (2 * docs.rdd.getNumPartitions() - 1).bit_length())


def held_out():
    return id_crc32("doc_id") % HELD_MODULUS == 0


def train(docs: DataFrame, store_uri: str) -> Model:
    """Counts the training documents and writes the model's arrays; the driver gets a few numbers a range."""
    text = docs.filter(~held_out()).select(as_bytes("text").alias("text"))
    bits = _range_bits(docs)
    words = (text.mapInArrow(_count_words(bits), _PACKED).groupBy("part")
             .applyInArrow(_write_words(store_uri), "part int, n long, tokens long").toPandas())
    sizes = np.zeros(1 << bits, np.int64)
    sizes[words["part"].to_numpy(np.int64)] = words["n"].to_numpy(np.int64)
    starts = np.cumsum(sizes) - sizes
    vocabulary = int(sizes.sum())
    if vocabulary >= 1 << 32:
        raise ValueError("word ids are 32 bits")
    model = Model(store_uri, bits, bits + 1, starts, int(words["tokens"].sum()), vocabulary)
    if not vocabulary:
        return model
    # ids from the vocabulary's size on (the sentence start) get a range of their own
    sizes = np.append(sizes, 1)
    edges = np.append(starts, vocabulary)
    model.word_starts = edges
    pairs = (text.mapInArrow(_count_pairs(model), _PACKED).groupBy("part").applyInArrow(_write_pairs(model), _STATS))
    rows = (pairs.groupBy("part").applyInArrow(_write_contexts(store_uri, edges, sizes),
                                               "part int, n1 long, n2 long, n3 long, n4 long, n5 long").toPandas())
    kinds = ["n1", "n2", "n3", "n4", "n5"]
    top = rows[rows["part"] < 0][kinds].sum()
    low = rows[(rows["part"] >= 0) & (rows["part"] < len(sizes) - 1)][kinds].sum()
    model.top_discounts = discounts(*[int(top[k]) for k in kinds[:4]])
    model.low_discounts = discounts(*[int(low[k]) for k in kinds[:4]])
    model.pair_types = int(top["n5"])
    d1, d2, d3 = model.low_discounts
    model.low_mass = (d1 * int(low["n1"]) + d2 * int(low["n2"]) + d3 * int(low["n5"])) / model.pair_types
    return model


# ---- scoring -------------------------------------------------------------------------

def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts <= 0, 0.0, np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2])))


def pair_counts(pairs: SortedParts, keys: np.ndarray) -> np.ndarray:
    """Counts of ascending pair keys, 0 for those not in the model."""
    seen = np.zeros(len(keys), np.int64)
    for k, where, places, found in pairs.find(keys):
        if not found.any():
            continue
        counts = np.where(found, pairs.column(k, "counts", "<u4")[places], 0).astype(np.int64)
        if (over := counts == _LARGE).any():
            at, full = pairs.column(k, "large", "<i8").reshape(2, -1)
            counts[over] = full[np.searchsorted(at, places[over])]
        seen[where] = counts
    return seen


class Scorer:
    """Opens the arrays and scores batches of documents."""

    def __init__(self, model: Model):
        self.model = model
        store = ModelStore(model.uri)
        self.words = Words(model)
        self.pairs = SortedParts(store, "pairs", model.pair_bits)

    def _by_id(self, ids: np.ndarray):
        """Counts, continuation counts and followers by count of distinct ascending ids."""
        count, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        followers = np.zeros((len(ids), 3), np.int64)
        slots = np.searchsorted(self.model.word_starts, ids, "right") - 1
        # empty ranges share their start with the next one: "right" picks the last, which holds the id
        names, first = np.unique(slots, return_index=True)
        for k, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(ids)]):
            at = ids[a:b] - self.model.word_starts[k]
            column = self.words.parts.column
            if k < len(self.model.word_starts) - 1:
                count[a:b] = column(k, "counts", "<i8")[at]
            if len(more := column(k, "followers", "<u4")):
                followers[a:b] = more.reshape(-1, 3)[at]
            if len(seen := column(k, "before", "<i8")):
                before[a:b] = seen[at]
        return count, before, followers

    def score(self, documents: list[bytes]):
        """n_tokens, n_known, base_score and score per document."""
        m = self.model
        ids, sizes = self.words.batch(documents)
        context, pair = _pair_keys(ids, sizes, m.vocabulary)
        names, inverse = np.unique(np.concatenate([ids, context]), return_inverse=True)
        known = names >= 0
        count, before = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        followers = np.zeros((len(names), 3), np.int64)
        if known.any():
            count[known], before[known], followers[known] = self._by_id(names[known])
        word, left = inverse[:len(ids)], inverse[len(ids):]
        base = np.log10((count + ADD) / (m.train_tokens + ADD * (m.vocabulary + 1)))[word]
        # pairs with both words known
        both = (ids >= 0) & (context >= 0)
        keys, where = np.unique(splitmix64(pair[both]), return_inverse=True)
        seen = pair_counts(self.pairs, keys)
        pair_count = np.zeros(len(ids), np.int64)
        pair_count[both] = seen[where]
        # a word is a context as often as something follows it: its count, less nothing but the end token;
        # the sentence start precedes every training document
        total = count.astype(np.float64)
        total[names == self.words.end] = 0
        total[names == m.vocabulary] = count[names == self.words.end].sum() if (names == self.words.end).any() else 0
        types = float(m.pair_types) or 1.0
        low = (np.maximum(before - _discount(before, m.low_discounts), 0) / types
               + m.low_mass / (m.vocabulary + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(total > 0, followers @ np.array(m.top_discounts) / total, 1.0)
        h = total[left]
        high = np.maximum(pair_count - _discount(pair_count, m.top_discounts), 0) / np.where(h > 0, h, 1.0)
        logs = np.log10(np.where(h > 0, high, 0.0) + gamma[left] * low[word])
        begin = np.cumsum(sizes) - sizes
        return (sizes, np.add.reduceat((count[word] > 0).astype(np.int64), begin),
                np.add.reduceat(base, begin), np.add.reduceat(logs, begin))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity per row.

    Edge cases: NULL and blank texts are one end token; a NULL doc_id is held
    out (its CRC is that of the empty text); without training documents every
    score is that of the uniform model over one unknown word (zero); repeated
    rows train as often as they occur and each get their row; an empty table
    gives an empty result; only doc_id and text are read.
    """
    spark = docs.sparkSession
    uri = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kn-{uuid.uuid4().hex}"
    model = train(docs, uri)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            at = 0
            for documents in _slices(b.column(2)):
                n = len(documents)
                sizes, known, base, logs = scorer.score(documents)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), b.column(1).slice(at, n), pa.array(sizes), pa.array(known),
                     pa.array(np.full(n, model.train_tokens)), pa.array(base), pa.array(logs),
                     pa.array(10.0 ** (-logs / sizes))], names)
                at += n

    rows = docs.select("doc_id", held_out().alias("held_out"), as_bytes("text").alias("text"))
    scored = cut_lineage(rows.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double, perplexity double"))
    if model.vocabulary:
        ModelStore(uri).remove()
    return scored
