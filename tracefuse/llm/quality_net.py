"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

1. Random indexing over the whole corpus.  Tokens (letter runs with their case
   shape, figures, mark runs) fall into ``BUCKETS`` hash buckets; every bucket
   has a fixed sparse random index vector, and its word vector is the sum of the
   index vectors of the tokens within ``REACH`` positions of its occurrences.
   Tasks add up integer tables of fixed size, Spark sums them by bucket, so the
   result is exact and independent of partitioning, and the table (a few MB
   whatever the corpus) may be broadcast.
2. A document is pooled: mean and deviation of its word vectors, and the mean
   products of vectors one and two tokens apart.
3. A two-layer numpy network is trained on a bounded sample of labelled
   documents (``MAX_TRAIN``, the documented bound: those with the smallest id
   hashes) and its probabilities are calibrated by one temperature on labelled
   documents kept out of training.

Scores see texts only, never labels, language, source or id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import id_crc32, splitmix64, texts

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
HIDDEN = 24
EPOCHS = 40
BATCH = 256
RATE = 0.01
DECAY = 1e-4
SEED = 7
MAX_TRAIN = 20_000
THRESHOLD = 0.7
FEATURES = (2 + REACH) * DIMS
_POOL_BLOCK = 2048


def index_vectors() -> np.ndarray:
    """Sparse +1/-1 vector per bucket; the last row (between documents) is zero."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS + 1, DIMS), np.int8)
    spots = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO))
    np.put_along_axis(out[:BUCKETS], spots, signs, axis=1)
    return out


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sign of the basic plane: class (0 space, 1 letter, 2 figure, 3 mark), lower case, is it upper case."""
    chars = [chr(c) for c in range(0x10000)]
    kinds = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 for c in chars], np.uint8)
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint64)
    return kinds, lower, np.array([c.isupper() for c in chars])


_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(64)], np.uint64)


def token_buckets(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens of some texts, one after the other, and the tokens of each text.

    A token is a run of one class of signs.  Letter runs hash by their lower
    case and shape (lower, title, upper), figures by length, marks by sign and
    length, so junk that decorates words is told from prose.
    """
    kinds, lower, upper = _signs()
    codes = np.frombuffer("\n".join(batch).encode("utf-32-le", "replace"), "<u4")
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(len(batch), np.int64)
    plane = np.minimum(codes, 0xFFFF)
    kind = kinds[plane]
    starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(codes)))
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    hashes = np.add.reduceat(np.where(codes > 0xFFFF, codes, lower[plane]) * _POWERS[place & 63], starts)
    capitals = np.add.reduceat(upper[plane].astype(np.int64), starts)
    shape = np.where((capitals == sizes) & (sizes > 1), 2, np.where(upper[plane[starts]], 1, 0))
    run = kind[starts]
    key = np.where(run == 1, hashes * np.uint64(3) + shape.astype(np.uint64),
                   np.where(run == 2, np.uint64(7) + np.minimum(sizes, 6).astype(np.uint64),
                            codes[starts].astype(np.uint64) * np.uint64(16) + np.minimum(sizes, 3).astype(np.uint64)))
    bucket = (splitmix64(key) % np.uint64(BUCKETS)).astype(np.int32)
    real = run != 0
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])[:-1]])
    owner = np.searchsorted(begin, starts[real], "right") - 1
    return bucket[real], np.bincount(owner, minlength=len(batch))


def _runs(column):
    """Texts of a column in runs of about a million signs."""
    held, n = [], 0
    for t in texts(column):
        held.append(t)
        n += len(t)
        if n >= 1 << 20:
            yield held
            held, n = [], 0
    if held:
        yield held


def pool_texts(column, vectors: np.ndarray) -> np.ndarray:
    """Feature row of every text of a column."""
    out = []
    for run in _runs(column):
        ids, sizes = token_buckets(run)
        ends = np.cumsum(sizes)
        out += [pool(ids[b - n:b], vectors) for b, n in zip(ends.tolist(), sizes.tolist())]
    return np.array(out, np.float32).reshape(-1, FEATURES)


def _add_contexts(ids: np.ndarray, index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the neighbours' index vectors of every token; documents are REACH separators apart."""
    near = index[ids]
    context = np.zeros_like(near)  # at most 2 * REACH in size: bytes hold it
    for r in range(1, REACH + 1):
        context[r:] += near[:-r]
        context[:-r] += near[r:]
    order = np.argsort(ids, kind="stable")
    names, first = np.unique(ids[order], return_index=True)
    sums[names] += np.add.reduceat(context[order], first, axis=0, dtype=np.int32)
    counts[names] += np.diff(np.append(first, len(ids)))


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket, n, v0..v31: exact sums over every document's tokens."""
    names = ["bucket", "n", *[f"v{i}" for i in range(DIMS)]]

    def run(batches):
        index = index_vectors()
        sums, counts = np.zeros((BUCKETS + 1, DIMS), np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for some in _runs(b.column(0)):
                ids, sizes = token_buckets(some)
                apart = np.full(len(ids) + REACH * len(sizes), BUCKETS, np.int32)
                apart[np.arange(len(ids)) + REACH * np.repeat(np.arange(len(sizes)), sizes)] = ids
                _add_contexts(apart, index, sums, counts)
        used = np.flatnonzero(counts[:BUCKETS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), *[pa.array(sums[used, i]) for i in range(DIMS)]], names)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, ", ".join(f"{n} long" for n in names))
    return parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Centred, scaled word vector per bucket (fixed size: BUCKETS x DIMS floats)."""
    rows = context_sums(docs).toPandas()
    out = np.zeros((BUCKETS, DIMS), np.float64)
    if not len(rows):
        return out.astype(np.float32)
    n = rows["n"].to_numpy(np.float64)
    mean = rows[[f"v{i}" for i in range(DIMS)]].to_numpy(np.float64) / n[:, None]
    mean -= (mean * n[:, None]).sum(axis=0) / n.sum()
    spread = np.sqrt((mean * mean * n[:, None]).sum(axis=0) / n.sum())
    out[rows["bucket"].to_numpy()] = mean / np.maximum(spread, 1e-9)
    return out.astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a document's word vectors, mean products one and two apart (zeros if empty)."""
    if not len(ids):
        return np.zeros(FEATURES, np.float32)
    total, square, cross = np.zeros(DIMS), np.zeros(DIMS), np.zeros((REACH, DIMS))
    for at in range(0, len(ids), _POOL_BLOCK):  # short runs: single precision within, double across
        x = vectors[ids[at:at + _POOL_BLOCK + REACH]]
        y = x[:_POOL_BLOCK]
        total += y.sum(axis=0)
        square += np.einsum("ij,ij->j", y, y)
        for r in range(1, REACH + 1):
            z = x[r:_POOL_BLOCK + r]
            cross[r - 1] += np.einsum("ij,ij->j", x[:len(z)], z)
    n = len(ids)
    mean = total / n
    deviation = np.sqrt(np.maximum(square / n - mean * mean, 0))
    pairs = np.maximum(n - np.arange(1, REACH + 1), 1)[:, None]
    return np.concatenate([mean, deviation, (cross / pairs).reshape(-1)]).astype(np.float32)


class Network:
    """Inputs standardised, tanh layer, one logistic output divided by a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.weights = None
        if len(set(labels.tolist())) < 2:  # nothing to learn from: the prior is the score
            return
        rng = np.random.default_rng(SEED)
        check = np.arange(len(labels)) % 5 == 4
        self.mean = features.mean(axis=0)
        self.scale = np.maximum(features.std(axis=0), 1e-6)
        x, y = self._standard(features), labels.astype(np.float64)
        fit = ~check if len(set(labels[~check].tolist())) == 2 and check.any() else np.ones(len(y), bool)
        balance = np.where(y == 1, 0.5 / max(y[fit].mean(), 1e-9), 0.5 / max(1 - y[fit].mean(), 1e-9))
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        rows = np.flatnonzero(fit)
        for _ in range(EPOCHS):
            order = rng.permutation(rows)
            for at in range(0, len(order), BATCH):
                k = order[at:at + BATCH]
                h = np.tanh(x[k] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40)))
                d = (p - y[k]) * np.sqrt(balance[k]) / len(k)
                dh = np.outer(d, w[2]) * (1 - h * h)
                grads = [x[k].T @ dh + DECAY * w[0], dh.sum(axis=0), h.T @ d + DECAY * w[2], d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] -= RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        self.weights = w
        z, held = self.logits(features[check] if check.any() else features), y[check] if check.any() else y
        temperatures = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
        losses = [np.mean(np.logaddexp(0, z / t) - held * z / t) for t in temperatures]
        self.temperature = float(temperatures[int(np.argmin(losses))])

    def _standard(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features.astype(np.float64) - self.mean) / self.scale, -8, 8)

    def logits(self, features: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(self._standard(features) @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.prior)
        # rounded: the last digits of a matrix product depend on how many rows it has
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40))), 12)


def held_out():
    """A row whose label is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return id_crc32("doc_id") % 4 == 2


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_train: int = MAX_TRAIN) -> Network:
    """Network fitted on at most ``max_train`` labelled documents (a label row and its text).

    Labels of a repeated id count once (the smallest); rows with a NULL id or
    NULL quality teach nothing.
    """
    spark = docs.sparkSession
    sample = (labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    known = spark.createDataFrame(sample.toPandas(), "doc_id long, quality int")
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches):
        for b in batches:
            rows = pool_texts(b.column(2), shared.value).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float32()))],
                                             ["doc_id", "quality", "features"])

    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    pooled = (joined.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, features array<float>")
              .groupBy("doc_id").agg(F.min(F.struct("quality", "features")).alias("r"))
              .select("doc_id", "r.quality", "r.features").toPandas().sort_values("doc_id"))
    features = np.array(pooled["features"].tolist(), np.float32).reshape(-1, FEATURES)
    return Network(features, pooled["quality"].to_numpy(np.int64))


def _scorer(docs: DataFrame, labels: DataFrame, max_train: int):
    vectors = word_vectors(docs)
    net = train(docs, labels, vectors, max_train)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def score(column) -> np.ndarray:
        vectors, net = shared.value
        return net.score(pool_texts(column, vectors))

    return score, net


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row.

    Edge cases: NULL and empty texts are scored from the zero vector; without
    labels of both kinds the share of label 1 (0.5 if there is none) is every
    score; repeated rows each get the same score; an empty table gives an empty
    result; only doc_id and text (labels: doc_id, quality) are read.
    """
    score, _ = _scorer(docs, labels, max_train)

    def run(batches):
        for b in batches:
            s = score(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return (docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN,
              threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` predicted 1; columns are those of ``docs``.

    Without labels of both kinds there is no classifier and every row stays.
    """
    score, net = _scorer(docs, labels, max_train)
    if net.weights is None:
        return docs
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
