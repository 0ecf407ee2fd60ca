"""Random forests that outgrow the driver: trees are grown, kept and applied by the executors (L4).

MLlib builds every node of every tree in the driver, and a deep forest has
about as many nodes a tree as the table has rows.  ``Forest`` lets MLlib fit
only what is sure to stay small there, and otherwise grows the same forest
with the rules of MLlib: its candidate splits, Poisson(1) bootstrap counts,
Gini gain of weighted classes, a new feature subset at each node, depth limit,
merged sibling leaves, probabilities and importances.  The random numbers come
from hashes of row and tree and from a generator per node instead of MLlib's
generators, so such a forest is another draw of the same distribution.

1. Rows are binned to a byte a feature and frozen with a row id.
2. A node of more than ``TASK_ROWS`` rows is split by histograms added up over
   all partitions, level by level; the driver keeps only these top nodes.
3. Smaller nodes are dealt out as groups, each a task: of several whole trees
   where a table has few rows, else of nodes of one tree.  A row is sent once
   to each group that needs it.  ``TREES_AT_ONCE`` bounds the copies on disk.
4. The finished subtrees stay in the checkpoint folder.  To score, rows are
   sent to the groups their trees lead to, and the votes are added up by row
   as integers, so that their order does not matter.
"""

from __future__ import annotations

import io
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from tracefuse.session import cut_lineage

#: forests of at most so many nodes, counted at their worst, are fitted by MLlib in the driver
DRIVER_NODES = 1 << 19
#: rows of a node that one task grows to its end; larger nodes are split by all partitions together
TASK_ROWS = 1 << 18
#: trees grown or applied at a time where the table has more than TASK_ROWS rows
TREES_AT_ONCE = 8
#: nodes whose histograms are in memory together while a task grows a tree
_NODES_AT_ONCE = 8192
#: votes are added up as integers of this unit
_UNIT = 1 << 50
_LEAF = 0xFFFFFFFF
_DOUBLES = pa.list_(pa.float64())
_EPSILON = float(np.finfo(np.float64).eps)


@dataclass
class Top:
    """The nodes of one tree above its groups.  Children of node i are left[i] and left[i] + 1, left is -1
    without children; group is the group that goes on from there, -1 where none does."""

    uid: list[int] = field(default_factory=lambda: [1])
    depth: list[int] = field(default_factory=lambda: [0])
    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    group: list[int] = field(default_factory=lambda: [-1])
    votes: dict[int, list[float]] = field(default_factory=dict)  # of leaves among these nodes

    def child(self, uid: int, depth: int) -> None:
        for values, v in ((self.uid, uid), (self.depth, depth), (self.feature, 0), (self.bin, 0), (self.left, -1), (self.group, -1)):
            values.append(v)

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row comes to."""
        at = np.zeros(len(bins), np.int64)
        left, feature, cut = np.array(self.left), np.array(self.feature), np.array(self.bin)
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            a = at[rows]
            at[rows] = left[a] + (bins[rows, feature[a]] > cut[a])
            rows = rows[left[at[rows]] >= 0]
        return at


@dataclass
class Trees:
    """Trees grown together: their tops by number, the number of groups and their subtrees."""

    tops: dict[int, Top]
    groups: int
    grown: DataFrame | None = None  # g, t, node, tree


def _matrix(column, features: int) -> np.ndarray:
    a = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.binary())
    if not len(a):
        return np.empty((0, features), np.uint8)
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(len(a), features)


def _binned(cuts: Sequence[np.ndarray]):
    """Bin of every value as a byte: the number of cuts below it."""

    @F.arrow_udf("binary")
    def bins(rows: pa.Array) -> pa.Array:
        x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(cuts))
        out = np.empty(x.shape, np.uint8)
        for j, c in enumerate(cuts):
            out[:, j] = np.searchsorted(c, x[:, j])
        ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(len(cuts))
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])

    return bins


def _find_cuts(rows: DataFrame, features: int, max_bins: int, n: int, seed: int) -> list[np.ndarray]:
    """MLlib's candidate splits of each feature: midpoints between all values where they are few, else
    quantiles; like MLlib from 10,000 rows or the square of the bins, whichever is more."""
    wanted, most = max(max_bins * max_bins, 10000), min(max_bins, n) - 1

    def of(key, values):
        x, where = np.unique(values["x"].to_numpy(), return_inverse=True)
        weight = np.bincount(where, weights=values["w"].to_numpy())
        found = (x[:-1] + x[1:]) / 2.0
        if len(found) > most:
            stride, upto = weight.sum() / (most + 1), np.cumsum(weight)
            keep, target = [], stride
            for i in range(1, len(x)):
                if abs(upto[i - 1] - target) < abs(upto[i] - target):
                    keep.append(i - 1)
                    target += stride
            found = found[keep]
        return pd.DataFrame({"pos": [key[0]], "cuts": [found.tolist()]})

    some = rows if n <= wanted else rows.sample(False, wanted / n, seed)
    values = some.select("w", F.posexplode("x").alias("pos", "x"))
    out = {r.pos: np.array(r.cuts) for r in values.groupBy("pos").applyInPandas(of, "pos int, cuts array<double>").collect()}
    return [out.get(j, np.empty(0)) for j in range(features)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 20)])])


def _times(ids: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    """How often each row is in the sample of a tree: Poisson(1) of a hash of row and tree."""
    if not bootstrap:
        return np.ones(len(ids), np.int64)
    with np.errstate(over="ignore"):
        key = _mix(_mix(np.array([seed], np.int64).astype(np.uint64)) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        u = _mix(_mix(ids.astype(np.uint64) + np.uint64(1)) ^ key) >> np.uint64(11)
    return np.searchsorted(_POISSON, u * 2.0 ** -53, side="right")


def _subsets(rng: np.random.Generator, nodes: int, features: int, m: int) -> np.ndarray:
    """``m`` different features for each of the nodes."""
    if m >= features:
        return np.tile(np.arange(features), (nodes, 1))
    return np.argpartition(rng.random((nodes, features)), m, axis=1)[:, :m]


def _gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(-1)
    some, out = np.where(total > 0, total, 1.0), 1.0
    for k in range(stats.shape[-1]):  # in MLlib's order: equal gains stay equal
        share = stats[..., k] / some
        out = out - share * share
    return np.where(total > 0, out, 0.0)


def _best_cut(weights: np.ndarray, counts: np.ndarray, impurity: np.ndarray):
    """Best cut of one feature for each node from its histogram (nodes x bins x classes): gain, bin and
    the classes and rows on both sides.  A cut without rows on one side does not count."""
    upto, rows = np.cumsum(weights, 1), np.cumsum(counts, 1)
    left, n_left = upto[:, :-1], rows[:, :-1]
    right, n_right = upto[:, -1:] - left, rows[:, -1:] - n_left
    w_left, w_right = left.sum(-1), right.sum(-1)
    total = w_left + w_right
    total = np.where(total > 0, total, 1.0)
    gain = impurity[:, None] - w_left / total * _gini(left) - w_right / total * _gini(right)
    gain = np.where((n_left > 0) & (n_right > 0), gain, -np.inf)
    cut = gain.argmax(1)
    at = np.arange(len(cut)), cut
    return gain[at], cut, left[at], right[at], n_left[at], n_right[at]


def _histograms(bins: np.ndarray, node: np.ndarray, nodes: int, width: int, y: np.ndarray, weight: np.ndarray,
                times: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    cell = node * width + bins
    w = np.bincount(cell * classes + y, weights=weight, minlength=nodes * width * classes)
    n = np.bincount(cell, weights=times, minlength=nodes * width)
    return w.reshape(nodes, width, classes), n.reshape(nodes, width)


def _grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, times: np.ndarray, classes: int, width: int, m: int,
          levels: int, rng: np.random.Generator):
    """One (sub)tree, level by level.  ``levels``: below its root at most.  Nodes are numbered by level, so that
    the children of the k-th inner node are 2k + 1 and 2k + 2.  Returns a code of feature and bin or _LEAF for
    each node, the share of the classes of each leaf, importance by feature and the root's classes."""
    features = bins.shape[1]
    stats = np.bincount(y, weights=weight, minlength=classes)[None, :]
    root, found, depth = stats[0], [], 0
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)  # rows of nodes that may be split, by node
    may = np.ones(1, bool)
    while True:
        impurity = _gini(stats)
        tried = np.flatnonzero(may & (impurity >= _EPSILON) & (depth < levels))
        a = len(tried)
        gain, feature, cut = np.zeros(a), np.zeros(a, np.int64), np.zeros(a, np.int64)
        sides = np.zeros((a, 2, classes))
        if a:
            place = np.full(len(stats), -1)
            place[tried] = np.arange(a)
            keep = place[node] >= 0
            rows, node = rows[keep], place[node[keep]]
            subsets = _subsets(rng, a, features, m)
            edges = np.searchsorted(node, np.arange(0, a + _NODES_AT_ONCE, _NODES_AT_ONCE))
            for k, first in enumerate(range(0, a, _NODES_AT_ONCE)):
                last = min(a, first + _NODES_AT_ONCE)
                some, own = rows[edges[k]:edges[k + 1]], node[edges[k]:edges[k + 1]] - first
                some_y, some_w, some_n = y[some], weight[some], times[some]
                for f in subsets[first:last].T:
                    w, n = _histograms(bins[some, f[own]], own, last - first, width, some_y, some_w, some_n, classes)
                    g, c, left, right, _, _ = _best_cut(w, n, impurity[tried[first:last]])
                    better = np.flatnonzero(g > gain[first:last])
                    into = better + first
                    gain[into], cut[into], feature[into] = g[better], c[better], f[better]
                    sides[into, 0], sides[into, 1] = left[better], right[better]
        inner = gain > 0
        code = np.full(len(stats), _LEAF, np.uint32)
        code[tried[inner]] = feature[inner] << 8 | cut[inner]
        worth = np.zeros(len(stats))
        worth[tried[inner]] = gain[inner] * stats[tried[inner]].sum(1)
        found.append((code, stats, worth))
        if not inner.any():
            break
        place = np.full(a, -1)
        place[inner] = np.arange(inner.sum())
        keep = inner[node]
        rows, node = rows[keep], node[keep]
        node = 2 * place[node] + (bins[rows, feature[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        stats, depth = sides[inner].reshape(-1, classes), depth + 1
        may = np.ones(len(stats), bool)
    # from the bottom up: siblings that are leaves and predict the same class become one leaf
    for i in range(len(found) - 2, -1, -1):
        code, below = found[i][0], found[i + 1]
        inner = np.flatnonzero(code != _LEAF)
        leaf, says = (below[0] == _LEAF).reshape(-1, 2), below[1].argmax(1).reshape(-1, 2)
        code[inner[leaf.all(1) & (says[:, 0] == says[:, 1])]] = _LEAF
        found[i] = (code, found[i][1], found[i][2], inner)
    # from the top down: what is left
    kept, out = np.ones(1, bool), []
    for i, (code, stats, worth, *inner) in enumerate(found):
        out.append((code[kept], stats[kept], worth[kept]))
        if i + 1 < len(found):
            kept = np.repeat(kept[inner[0]] & (code[inner[0]] != _LEAF), 2)
            if not kept.any():
                break
    code, stats, worth = (np.concatenate(x) for x in zip(*out, strict=True))
    leaf = code == _LEAF
    total = stats[leaf].sum(1, keepdims=True)
    importance = np.bincount(code[~leaf] >> 8, weights=worth[~leaf], minlength=features)
    return code, stats[leaf] / np.where(total > 0, total, 1.0), importance, root


def _packed(code: np.ndarray, votes: np.ndarray) -> bytes:
    return zlib.compress(len(code).to_bytes(8, "little") + code.tobytes() + votes.tobytes(), 1)


class _Subtree:
    def __init__(self, packed: bytes, classes: int):
        data = zlib.decompress(packed)
        n = int.from_bytes(data[:8], "little")
        self.code = np.frombuffer(data, np.uint32, n, 8)
        self.votes = np.rint(np.frombuffer(data, np.float64, offset=8 + 4 * n).reshape(-1, classes) * _UNIT).astype(np.int64)
        leaf = self.code == _LEAF
        self.next = np.where(leaf, np.cumsum(leaf) - 1, 2 * np.cumsum(~leaf) - 1).astype(np.int64)

    def vote(self, bins: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            rows = rows[self.code[at[rows]] != _LEAF]
            if not len(rows):
                return self.votes[self.next[at]]
            a = at[rows]
            code = self.code[a]
            at[rows] = self.next[a] + (bins[rows, code >> 8] > (code & 255))


def _split_top(rows: DataFrame, tops: dict[int, Top], how: dict, task_rows: int, n: int):
    """Splits every node of more than ``task_rows`` rows over all partitions, a level at a time.
    Returns rows, classes and worth (gain by weight) of the nodes, by tree and node."""
    features, classes, width, m, seed = (how[k] for k in ("features", "classes", "width", "m", "seed"))
    size, stats, worth = {(t, 0): n for t in tops}, {}, {}
    opened = {t: [0] for t in tops}

    def subset(t: int, uid: int) -> np.ndarray:
        return _subsets(np.random.default_rng([seed & 0xFFFFFFFF, t, uid]), 1, features, m)[0]

    while any(opened.values()):
        nodes = {t: np.array(v) for t, v in opened.items() if v}

        def add(batches: Iterator[pa.RecordBatch], nodes=nodes) -> Iterator[pa.RecordBatch]:
            w = {t: np.zeros((m, len(v), width, classes)) for t, v in nodes.items()}
            c = {t: np.zeros((m, len(v), width)) for t, v in nodes.items()}
            subsets = {t: np.stack([subset(t, tops[t].uid[i]) for i in v]) for t, v in nodes.items()}
            seen = False
            for b in batches:
                bins, ids, y, weight = _matrix(b["bins"], features), *(b[k].to_numpy() for k in ("id", "y", "w"))
                for t, v in nodes.items():
                    place = np.full(len(tops[t].uid), -1)
                    place[v] = np.arange(len(v))
                    times = _times(ids, t, seed, how["bootstrap"])
                    at = place[tops[t].route(bins)]
                    some = np.flatnonzero((at >= 0) & (times > 0))
                    if not len(some):
                        continue
                    seen, own, some_n = True, at[some], times[some]
                    for j, f in enumerate(subsets[t].T):
                        x, y_n = _histograms(bins[some, f[own]], own, len(v), width, y[some], weight[some] * some_n, some_n, classes)
                        w[t][j] += x
                        c[t][j] += y_n
            part = TaskContext.get().partitionId()
            for t, v in nodes.items() if seen else ():
                yield pa.RecordBatch.from_pydict({
                    "t": pa.array([t] * len(v), pa.int32()), "node": pa.array(v, pa.int32()), "part": pa.array([part] * len(v), pa.int32()),
                    "w": pa.array([w[t][:, i].tobytes() for i in range(len(v))], pa.binary()),
                    "n": pa.array([c[t][:, i].tobytes() for i in range(len(v))], pa.binary())})

        def best(key, table):
            t, node = (k.as_py() for k in key)
            table = table.sort_by("part")
            w = sum(np.frombuffer(x.as_py()) for x in table["w"]).reshape(m, 1, width, classes)
            c = sum(np.frombuffer(x.as_py()) for x in table["n"]).reshape(m, 1, width)
            total, found = w[0, 0].sum(0), None
            for j, f in enumerate(subset(t, tops[t].uid[node])):
                g, cut, left, right, n_left, n_right = _best_cut(w[j], c[j], _gini(total)[None])
                if g[0] > (found[0] if found else 0.0):
                    found = float(g[0]), int(f), int(cut[0]), left[0].tolist(), right[0].tolist(), int(n_left[0]), int(n_right[0])
            found = found or (0.0, 0, 0, [], [], 0, 0)
            return pa.table({"t": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "total": pa.array([total.tolist()], _DOUBLES),
                             "gain": [found[0]], "feature": pa.array([found[1]], pa.int32()), "cut": pa.array([found[2]], pa.int32()),
                             "left": pa.array([found[3]], _DOUBLES), "right": pa.array([found[4]], _DOUBLES),
                             "n_left": pa.array([found[5]], pa.int64()), "n_right": pa.array([found[6]], pa.int64())})

        found = (rows.mapInArrow(add, "t int, node int, part int, w binary, n binary").groupBy("t", "node")
                 .applyInArrow(best, "t int, node int, total array<double>, gain double, feature int, cut int, "
                                     "left array<double>, right array<double>, n_left long, n_right long").collect())
        opened = defaultdict(list)
        for r in sorted(found, key=lambda r: (r.t, r.node)):
            top, depth = tops[r.t], tops[r.t].depth[r.node] + 1
            stats[r.t, r.node] = np.array(r.total)
            if r.gain <= 0:
                continue
            worth[r.t, r.node] = r.gain * sum(r.total)
            top.feature[r.node], top.bin[r.node], top.left[r.node] = r.feature, r.cut, len(top.uid)
            for side, (own, count) in enumerate(((r.left, r.n_left), (r.right, r.n_right))):
                node = len(top.uid)
                top.child(2 * top.uid[r.node] + side, depth)
                size[r.t, node], stats[r.t, node] = count, np.array(own)
                if count > task_rows and depth < how["depth"] and _gini(stats[r.t, node]) >= _EPSILON:
                    opened[r.t].append(node)
    return size, stats, worth


def _plan_groups(tops: dict[int, Top], size: dict, stats: dict, task_rows: int, at_once: int) -> int:
    """Gives the nodes that tasks go on from to groups: whole trees together where no tree was split, else
    nodes of a tree up to ``task_rows`` rows.  Returns the number of groups."""
    if all(len(top.uid) == 1 for top in tops.values()) and not stats:
        groups = min(len(tops), at_once)
        for k, top in enumerate(tops.values()):
            top.group[0] = k * groups // len(tops)
        return groups
    groups = 0
    for t, top in tops.items():
        room = 0
        for node in range(len(top.uid)):
            if top.left[node] >= 0:
                continue
            if size[t, node] > task_rows:  # could not be split
                total = stats[t, node].sum()
                top.votes[node] = (stats[t, node] / (total or 1.0)).tolist()
                continue
            if size[t, node] > room:
                groups, room = groups + 1, task_rows
            room -= size[t, node]
            top.group[node] = groups - 1
    return groups


def _sent(trees: dict[int, Top], groups: int, features: int, seed: int | None, bootstrap: bool):
    """Sends every row once to each group that grows (``seed``) or applies a tree for it.  Leaves among the
    top nodes are counted in the group that the row's id falls on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, ids = _matrix(b["bins"], features), b["id"].to_numpy()
            keys = []
            for t, top in trees.items():
                g = np.array(top.group)[top.route(bins)]
                if seed is None:
                    g = np.where(g >= 0, g, ids % max(groups, 1))
                else:
                    g = np.where(_times(ids, t, seed, bootstrap) > 0, g, -1)
                some = np.flatnonzero(g >= 0)
                keys.append(np.unique(g[some] * len(ids) + some))
            keys = np.unique(np.concatenate(keys))
            if len(keys):
                out = b.take(pa.array(keys % len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(keys // len(ids), pa.int32()), *out.columns], ["g", *out.schema.names])

    return run


def _grow_groups(tops: dict[int, Top], how: dict):
    """Grows the nodes of one group; a task has the rows of one group."""
    features, classes, seed = how["features"], how["classes"], how["seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b["g"][0].as_py(), *(b[k].to_numpy() for k in ("id", "y", "w")), _matrix(b["bins"], features))
                 for b in batches if b.num_rows]
        if not parts:
            return
        group = parts[0][0]
        ids, y, weight, bins = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
        del parts
        order = np.argsort(ids)  # rows come in any order: sums shall not depend on it
        ids, y, weight, bins = ids[order], y[order].astype(np.int64), weight[order], bins[order]
        for t, top in tops.items():
            nodes = np.flatnonzero(np.array(top.group) == group)
            if not len(nodes):
                continue
            times = _times(ids, t, seed, how["bootstrap"])
            at = np.where(times > 0, top.route(bins), -1)
            for node in nodes:
                some = np.flatnonzero(at == node)
                if not len(some):
                    continue
                code, votes, importance, root = _grow(
                    bins[some], y[some], weight[some] * times[some], times[some], classes, how["width"], how["m"],
                    how["depth"] - top.depth[node], np.random.default_rng([seed & 0xFFFFFFFF, t, top.uid[node]]))
                yield pa.RecordBatch.from_pydict({
                    "g": pa.array([group], pa.int32()), "t": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()),
                    "tree": pa.array([_packed(code, votes)], pa.binary()), "leaf": pa.array([len(code) == 1]),
                    "root": pa.array([root.tolist()], _DOUBLES), "importance": pa.array([importance.tolist()], _DOUBLES)})

    return run


def _apply_groups(tops: dict[int, Top], groups: int, features: int, classes: int):
    """Adds up the votes of one group's subtrees for each row; the subtrees come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, dict[int, _Subtree]] = defaultdict(dict)
        for b in batches:
            kind = b["kind"].to_numpy()
            first = int(np.searchsorted(kind, 1))
            for t, node, packed in zip(*(b[k].slice(0, first).to_pylist() for k in ("t", "node", "data")), strict=True):
                own[t][node] = _Subtree(packed, classes)
            b = b.slice(first)
            if not b.num_rows:
                continue
            group, bins, ids = b["g"][0].as_py(), _matrix(b["data"], features), b["id"].to_numpy()
            votes = np.zeros((len(ids), classes), np.int64)
            for t, top in tops.items():
                if t not in own and not top.votes:
                    continue
                at = top.route(bins)
                for node, subtree in own.get(t, {}).items():
                    some = np.flatnonzero(at == node)
                    votes[some] += subtree.vote(bins[some])
                for node, share in top.votes.items():
                    votes[(at == node) & (ids % groups == group)] += np.rint(np.array(share) * _UNIT).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"id": b["id"], **{f"v{k}": votes[:, k] for k in range(classes)}})

    return run


def _merged(top: Top, t: int, stats: dict, leaves: dict[int, np.ndarray], worth: dict, features: int) -> np.ndarray:
    """Merges sibling leaves among the top nodes, children before parents; importance of those that stay."""
    importance, gone = np.zeros(features), set()
    for node in range(len(top.uid) - 1, -1, -1):
        if top.left[node] < 0:
            continue
        children = top.left[node], top.left[node] + 1
        if all(c in leaves for c in children) and len({int(leaves[c].argmax()) for c in children}) == 1:
            leaves[node] = stats[t, node]
            top.left[node], gone = -1, gone | set(children)
            for c in children:
                top.votes.pop(c, None)
            top.votes[node] = (stats[t, node] / (stats[t, node].sum() or 1.0)).tolist()
        else:
            importance[top.feature[node]] += worth[t, node]
    return importance


class Forest(RandomForestClassifier):
    """MLlib's random forest, grown by the executors where its nodes would not fit the driver."""

    def _fit(self, dataset: DataFrame):
        levels = 2 ** (self.getMaxDepth() + 1) - 1
        if self.getNumTrees() * levels <= DRIVER_NODES:
            return super()._fit(dataset)
        n = dataset.count()
        if self.getNumTrees() * min(levels, 2 * n) <= DRIVER_NODES:
            return super()._fit(dataset)
        return self._grow_distributed(dataset, n)

    def _grow_distributed(self, dataset: DataFrame, n: int) -> ForestModel:
        spark = dataset.sparkSession
        rows, classes = self._checked(dataset)
        features = len(rows.select("x").first()["x"])
        cuts = _find_cuts(rows, features, self.getMaxBins(), n, self.getSeed())
        rows = cut_lineage(rows.select(F.monotonically_increasing_id().alias("id"), F.col("y").cast("int").alias("y"), "w",
                                       _binned(cuts)(F.col("x")).alias("bins")))
        how = {"features": features, "classes": classes, "width": max(len(c) for c in cuts) + 1, "m": self._subset_size(features),
               "depth": self.getMaxDepth(), "seed": self.getSeed(), "bootstrap": self.getBootstrap()}
        wide, trees = n > TASK_ROWS, range(self.getNumTrees())
        per_tree, done = np.zeros((len(trees), features)), []
        for first in range(0, len(trees), TREES_AT_ONCE if wide else len(trees)):
            tops = {t: Top() for t in trees[first:first + TREES_AT_ONCE if wide else None]}
            size, stats, worth = _split_top(rows, tops, how, TASK_ROWS, n) if wide else ({}, {}, {})
            groups = _plan_groups(tops, size, stats, TASK_ROWS, 2 * spark.sparkContext.defaultParallelism)
            grown, heads = None, []
            if groups:
                grown = cut_lineage(
                    rows.mapInArrow(_sent(tops, groups, features, self.getSeed(), self.getBootstrap()),
                                    "g int, id long, y int, w double, bins binary")
                    .repartitionById(groups, F.col("g"))
                    .mapInArrow(_grow_groups(tops, how), "g int, t int, node int, tree binary, leaf boolean, "
                                                         "root array<double>, importance array<double>"))
                heads = sorted(grown.drop("tree", "g").collect(), key=lambda r: (r.t, r.node))
                grown = grown.select("g", "t", "node", "tree")
            leaves: dict[int, dict[int, np.ndarray]] = {t: {i: stats[t, i] for i in top.votes} for t, top in tops.items()}
            for r in heads:
                per_tree[r.t] += np.array(r.importance)
                if r.leaf:
                    leaves[r.t][r.node] = np.array(r.root)
            for t, top in tops.items():
                per_tree[t] += _merged(top, t, stats, leaves[t], worth, features)
            done.append(Trees(tops, groups, grown))
        total = per_tree.sum(1, keepdims=True)
        importance = (per_tree / np.where(total > 0, total, 1.0)).sum(0)
        model = ForestModel(done, cuts, classes, importance / (importance.sum() or 1.0))
        return model._set(featuresCol=self.getFeaturesCol())

    def _checked(self, dataset: DataFrame) -> tuple[DataFrame, int]:
        """(label y, weight w, features x) with MLlib's checks of these columns, and the number of classes."""
        jvm = dataset.sparkSession._jvm
        checks = getattr(getattr(jvm.org.apache.spark.ml.util, "DatasetUtils$"), "MODULE$")
        some = jvm.scala.Option.apply
        classes = checks.getNumClasses(dataset._jdf, self.getLabelCol(), 100)
        weight = self.getWeightCol() if self.isDefined(self.weightCol) and self.getWeightCol() else None
        return dataset.select(Column(checks.checkClassificationLabels(self.getLabelCol(), some(classes))).alias("y"),
                              Column(checks.checkNonNegativeWeights(some(weight))).alias("w"),
                              vector_to_array(Column(checks.checkNonNanVectors(self.getFeaturesCol()))).alias("x")), classes

    def _subset_size(self, features: int) -> int:
        """Features tried at a node, as MLlib reads ``featureSubsetStrategy``."""
        named = {"auto": "all" if self.getNumTrees() == 1 else "sqrt"}
        kind = named.get(kind := self.getFeatureSubsetStrategy().lower(), kind)
        sizes = {"all": features, "sqrt": int(np.ceil(np.sqrt(features))), "log2": max(1, int(np.ceil(np.log2(features)))),
                 "onethird": int(np.ceil(features / 3.0))}
        if kind in sizes:
            return sizes[kind]
        return min(int(kind), features) if kind.isdigit() else int(np.ceil(float(kind) * features))


class ForestModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """A forest whose subtrees are a table of the shared folder, applied by the executors."""

    def __init__(self, trees: Sequence[Trees] = (), cuts: Sequence[np.ndarray] = (), classes: int = 2,
                 importance: np.ndarray | None = None):
        super().__init__()
        self.trees_at_once, self.cuts, self.numClasses = list(trees), list(cuts), classes
        self.featureImportances = DenseVector(importance if importance is not None else [])

    @property
    def getNumTrees(self) -> int:
        return sum(len(x.tops) for x in self.trees_at_once)

    @property
    def numFeatures(self) -> int:
        return len(self.cuts)

    def votes(self, rows: DataFrame) -> DataFrame:
        """(id, v0, v1, ...): the votes of all trees for frozen rows (id, bins), in units of 1 / 2**50."""
        names, features = [f"v{k}" for k in range(self.numClasses)], self.numFeatures
        total = None
        for some in self.trees_at_once:
            groups = max(some.groups, 1)
            sent = rows.select("id", "bins").mapInArrow(_sent(some.tops, groups, features, None, False), "g int, id long, bins binary")
            none = F.lit(None).cast("int")
            sent = sent.select("g", F.lit(1).alias("kind"), none.alias("t"), none.alias("node"), "id", F.col("bins").alias("data"))
            if some.grown is not None:
                sent = sent.unionByName(some.grown.select("g", F.lit(0).alias("kind"), "t", "node", F.lit(None).cast("long").alias("id"),
                                                          F.col("tree").alias("data")))
            out = (sent.repartitionById(groups, F.col("g")).sortWithinPartitions("kind")
                   .mapInArrow(_apply_groups(some.tops, groups, features, self.numClasses),
                               "id long, " + ", ".join(f"{v} long" for v in names)))
            out = out if total is None else total.unionByName(out)
            total = cut_lineage(out.groupBy("id").agg(*[F.sum(v).alias(v) for v in names]))
        return total

    def predict_rows(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` with rawPrediction, probability and prediction."""
        kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
        x = vector_to_array(F.col(self.getFeaturesCol()))
        rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("id"), *kept, _binned(self.cuts)(x).alias("bins")))
        classes = [F.col(f"v{k}") for k in range(self.numClasses)]
        total = sum(classes[1:], classes[0]).cast("double")
        best = F.array_position(F.array(*classes), F.greatest(*classes) if len(classes) > 1 else classes[0]) - 1
        return rows.join(self.votes(rows), "id").select(
            *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
            array_to_vector(F.array(*[v / F.lit(float(_UNIT)) for v in classes])).alias("rawPrediction"),
            array_to_vector(F.array(*[F.when(total > 0, v / total).otherwise(0.0) for v in classes])).alias("probability"),
            best.cast("double").alias("prediction"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.predict_rows(dataset, dataset.columns)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, m = SparkSession.active(), self.model
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={
            "cuts": [c.tolist() for c in m.cuts], "classes": m.numClasses, "importance": m.featureImportances.toArray().tolist(),
            "groups": [x.groups for x in m.trees_at_once]})
        tops = []
        for k, some in enumerate(m.trees_at_once):
            for t, top in some.tops.items():
                leaves = sorted(top.votes)
                np.savez(data := io.BytesIO(), nodes=np.array([top.uid, top.depth, top.feature, top.bin, top.left, top.group], np.int64),
                         leaves=np.array(leaves, np.int64), votes=np.array([top.votes[i] for i in leaves]))
                tops.append((k, t, bytearray(data.getvalue())))
        spark.createDataFrame(tops, "part int, t int, top binary").write.parquet(f"{path}/tops")
        for k, some in enumerate(m.trees_at_once):
            if some.grown is not None:
                some.grown.write.parquet(f"{path}/grown/part={k}")


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        meta = DefaultParamsReader.loadMetadata(path, spark)
        groups = meta["groups"]
        tops: list[dict[int, Top]] = [{} for _ in groups]
        for r in spark.read.parquet(f"{path}/tops").orderBy("part", "t").collect():
            with np.load(io.BytesIO(bytes(r.top))) as data:
                top = Top(*data["nodes"].tolist())
                top.votes = dict(zip(data["leaves"].tolist(), data["votes"].tolist(), strict=True))
            tops[r.part][r.t] = top
        grown = [spark.read.parquet(f"{path}/grown/part={k}") if g else None for k, g in enumerate(groups)]
        model = ForestModel([Trees(*x) for x in zip(tops, groups, grown, strict=True)], [np.array(c) for c in meta["cuts"]],
                            meta["classes"], np.array(meta["importance"]))
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
