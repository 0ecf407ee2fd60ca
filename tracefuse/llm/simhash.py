"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments.  Two fingerprints that differ
in at most ``MAX_BITS`` = 4 bits differ in at most one bit in one of the three
segments (three segments with two or more differences each would need six), so
they agree on one *one-wildcard variant* of that segment: the segment with one
bit left out.  Every distinct fingerprint is indexed under its 64 variants (bit
``v`` of the fingerprint is the wildcard of variant ``v``), an equality join on
(variant, remaining bits) proposes pairs and the join condition verifies the
Hamming distance, so only true links leave the join, each exactly once (under
its first matching variant).

Copies never meet each other: documents with one fingerprint form one class
before the join, and the join is between classes.  Components of the class
graph come from alternating large-star/small-star rounds, each written to the
checkpoint folder; the driver only sees ``LOAD_CELLS`` counts a round.

Work: 64 index rows per distinct fingerprint; the expected number of proposed
pairs is 64 * n^2 / 2^21 for n unrelated fingerprints, checked inside the join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes, blobs, word_spans
from tracefuse.session import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: first bit of each segment; 64 ends the last one
SEGMENTS = (0, 21, 42, 64)
#: cells that nodes are hashed into to find loaded ones, and edges a cell may have before it is salted
LOAD_CELLS = 1 << 12
SALT_EDGES = 128
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of lower-cased (A-Z) word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        shingles = [joined]
    else:
        starts, ends = word_spans(words)
        last = shingle_words - 1
        shingles = [joined[a:b] for a, b in zip(starts[:len(words) - last].tolist(), ends[last:].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) per row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in blobs(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", as_bytes("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _mask(lo: int, hi: int, without: int | None = None) -> int:
    m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    if without is not None:
        m &= ~(1 << without)
    return m - (1 << 64) if m >> 63 else m


def _bits(x: Column, lo: int, hi: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(_mask(lo, hi))))


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``max_bits`` or fewer differing bits."""
    if max_bits >= 2 * (len(SEGMENTS) - 1):
        raise ValueError("three segments with one wildcard serve up to five differing bits")
    masks = []
    for lo, hi in zip(SEGMENTS, SEGMENTS[1:]):
        masks += [F.lit(_mask(lo, hi, v)) for v in range(lo, hi)]
    index = (classes.select("fp", F.posexplode(F.array(*masks)).alias("variant", "mask"))
             .select("variant", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp"))
    a, b = index.alias("a"), index.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    v = F.col("a.variant")
    # the pair belongs to its first segment with at most one difference, and there
    # to the variant that leaves out the differing bit (none: the segment's first)
    own = F.lit(False)
    earlier = F.lit(True)
    for lo, hi in zip(SEGMENTS, SEGMENTS[1:]):
        diff = x.bitwiseAND(F.lit(_mask(lo, hi)))
        here = (v >= lo) & (v < hi) & earlier
        own = own | (here & ((diff == F.expr("shiftleft(1L, a.variant)")) | ((diff == 0) & (v == lo))))
        earlier = earlier & (_bits(x, lo, hi) > 1)
    on = ((v == F.col("b.variant")) & (F.col("a.rest") == F.col("b.rest"))
          & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= max_bits) & own)
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _cell(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(LOAD_CELLS)).cast("int")


def _load(pairs: DataFrame) -> tuple[tuple[int, int], list[tuple[int, int]]]:
    """(state of an edge list, salted cells as (cell, salts)); at most ``LOAD_CELLS`` rows reach the driver.

    Every edge counts in the cells of both ends.  A cell with more than
    ``SALT_EDGES`` edges and four times the mean of the cells gets salts in proportion.
    """
    ends = pairs.select(F.explode(F.array(_cell("a"), _cell("b"))).alias("cell"), F.xxhash64("a", "b").alias("h"))
    cells = ends.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(r.n for r in cells)
    fair = max(SALT_EDGES, 4 * total / LOAD_CELLS)
    return (total, sum(int(r.s) for r in cells)), [(r.cell, math.ceil(r.n / fair)) for r in cells if r.n > fair]


def _with_least(edges: DataFrame, low: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``low`` (a, m).

    Edges of a salted cell are spread by ``b``, the least rows of its nodes
    are repeated once a salt.  The broadcast holds under a quarter of the cells.
    """
    if not hot:
        return edges.join(low, "a")
    table = F.broadcast(edges.sparkSession.createDataFrame(hot, "cell int, salts int"))
    salts = F.coalesce("salts", F.lit(1))
    spread = (edges.withColumn("cell", _cell("a")).join(table, "cell", "left")
              .select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt")))
    copies = (low.withColumn("cell", _cell("a")).join(table, "cell", "left")
              .select("a", "m", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")))
    return spread.join(copies, ["a", "salt"]).select("a", "b", "m")


def star_roots(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge list (a, b); root is the smallest node reachable.

    Large-star then small-star each round; minima are pre-aggregated and joined
    back, by salted keys where cells of nodes hold many edges, so a node with
    very many neighbours is never one task's list.  (In a small-star a node has
    at most one edge more than before the large-star, so one count serves both.)
    """

    def largest(pairs: DataFrame, hot: list) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return (_with_least(both, low, hot).filter(F.col("b") > F.col("a"))
                .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())

    def smallest(pairs: DataFrame, hot: list) -> DataFrame:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = (_with_least(down, low, hot).filter(F.col("b") != F.col("m"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        return moved.union(low.select("a", F.col("m").alias("b"))).distinct()

    pairs = cut_lineage(edges)
    seen, hot = _load(pairs)
    for _ in range(max_rounds):
        pairs = cut_lineage(smallest(largest(pairs, hot), hot))
        state, hot = _load(pairs)
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _components(docs: DataFrame, max_bits: int, shingle_words: int) -> DataFrame:
    """(doc_id, fp, root, component_id) per row, from one reading of the texts."""
    fps = cut_lineage(fingerprints(docs, shingle_words))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = star_roots(links(classes, max_bits))
    member = (classes.join(roots, F.col("fp") == F.col("node"), "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    linked = member.join(roots.select("root").distinct(), "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    named = (member.join(smallest, "root", "left")
             .select("fp", "root", F.coalesce("smallest", "first_id").alias("component_id")))
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS,
                    shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the document itself included.

    Edge cases: NULL or blank texts have fingerprint zero and are linked like
    any other; fewer words than a shingle hash as one shingle; a NULL doc_id is
    kept and never chosen as smallest (a component of NULL ids only has NULL);
    repeated rows each get their row; an empty table gives an empty result;
    only ``doc_id`` and ``text`` are read, so further columns cannot clash.
    """
    return (_components(docs, max_bits, shingle_words)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_per_group(docs: DataFrame, max_bits: int = MAX_BITS,
                  shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: its smallest doc_id.

    Where that doc_id is repeated inside the component, the row with the
    smallest fingerprint stays, of equal ones that with the smallest text, then
    the smallest row as JSON; a component of NULL ids keeps one row too.
    Columns are those of ``docs``.  Texts are read for their fingerprints once;
    only where a chosen doc_id has several rows are those rows' fingerprints
    computed again to tell them apart.
    """
    members = cut_lineage(_components(docs, max_bits, shingle_words))
    chosen = cut_lineage(members.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
                         .groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.min("fp").alias("keep_fp"))
                         .select("keep_id", "keep_fp"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, key = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    rows = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = cut_lineage(chosen.join(rows.filter("n > 1"), F.col("keep_id").eqNullSafe(F.col("doc_id")))
                          .select("keep_id", "keep_fp"))
    chosen_id = F.col(key).eqNullSafe(F.col("keep_id"))
    if several.isEmpty():
        kept = plain.join(chosen, chosen_id, "left_semi")
    else:
        once = chosen.join(several.select(F.col("keep_id").alias("other")).distinct(),
                           F.col("keep_id").eqNullSafe(F.col("other")), "left_anti")
        kept = plain.join(once, chosen_id, "left_semi")
        unclear = plain.join(several, chosen_id, "left_semi")
        marked = _marked(unclear, text, shingle_words)
        same = chosen_id & (F.col("_fp") == F.col("keep_fp"))
        whole = F.struct(*plain.columns)
        first = (marked.join(several, same, "left_semi").groupBy(key, "_fp")
                 .agg(F.min_by(whole, F.struct(F.col(text), F.to_json(whole))).alias("row")))
        kept = kept.unionByName(first.select("row.*"))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _marked(rows: DataFrame, text: str, shingle_words: int) -> DataFrame:
    """``rows`` with their fingerprint as ``_fp``."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in blobs(b.column(b.num_columns - 1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(fps.view(np.int64))], [*b.schema.names[:-1], "_fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _fp long"
    return rows.withColumn("_bytes", as_bytes(text)).mapInArrow(run, schema)
