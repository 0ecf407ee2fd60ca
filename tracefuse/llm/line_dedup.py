"""Line dedup: lines found in several documents stay only in the largest document that holds them.

Every text is cut at line ends; a line's key is the line without ASCII white
space at both ends, A-Z lower-cased.  Keys of at least ``MIN_CHARS`` code points
are hashed to 128 bits and exploded to (hash, doc_id) rows, distinct documents
are counted per hash, and hashes of ``MIN_DOCS`` or more documents lose their
lines everywhere but in the largest doc_id.  The decisions go back to the texts
as one list of hashes a text, and the lines left are joined in their order.

Scale: the rows that are counted are narrow (two longs and an id) and distinct
per document before they are counted per hash, so a line in a third of all
documents is one partial count a task.  Where counts go back to the rows, the
hot hashes (each over 1/``HOT_LINES`` of all rows, so at most ``HOT_LINES`` of
them) are broadcast and the others, of which none is large, are joined by
shuffle.  A list never holds more than its text's own lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes, blobs
from tracefuse.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
#: a hash is hot when it has more than this fraction (one in so many) of all rows
HOT_LINES = 10_000

_KEYS = "array<struct<hi:long,lo:long>>"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Key of a line, None where it has fewer than ``min_chars`` code points."""
    key = line.strip().lower()  # bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key) < 4 * min_chars
                                and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def line_hashes(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit hash of each line's key in text order, None for lines that are too short."""
    digest = xxhash.xxh3_128_digest
    return [None if (k := line_key(x, min_chars)) is None else digest(k) for x in text.split(b"\n")]


def _packed(lists: list[list[bytes]]) -> pa.Array:
    longs = np.frombuffer(b"".join(d for ds in lists for d in ds), "<i8").reshape(-1, 2)
    offsets = np.concatenate([[0], np.cumsum([len(ds) for ds in lists])]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(longs[:, 0].copy()), pa.array(longs[:, 1].copy())], ["hi", "lo"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def line_facts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_key, keys) per row: the distinct hashes of its countable lines; texts without any are left out."""

    def run(batches):
        for b in batches:
            found = [list(dict.fromkeys(h for h in line_hashes(t, min_chars) if h)) for t in blobs(b.column(2))]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(found)], ["doc_id", "text_key", "keys"])
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    text = as_bytes("text")
    return (docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
            .mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, keys {_KEYS}"))


def frequent_lines(facts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hi, lo, docs, keep_id): hashes in ``min_docs`` or more distinct documents and the largest of these."""
    each = facts.select("doc_id", F.inline("keys")).select("hi", "lo", "doc_id").distinct()
    return (each.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keep_id"))
            .filter(F.col("docs") >= min_docs))


def dropped_lines(facts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, text_key, gone): the hashes that each text loses, one row a text that loses any."""
    rows = facts.select("doc_id", "text_key", F.inline("keys"))
    total = facts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    is_hot = F.col("docs") * HOT_LINES > total
    hot = frequent.filter(is_hot).select("hi", "lo", "keep_id")  # at most HOT_LINES rows: their rows add up to no more than all
    rest = frequent.filter(~is_hot).select("hi", "lo", "keep_id")
    lost = rows.join(F.broadcast(hot), ["hi", "lo"]).unionByName(
        rows.join(F.broadcast(hot.select("hi", "lo")), ["hi", "lo"], "left_anti").join(rest, ["hi", "lo"]))
    return (lost.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_key")
            .agg(F.collect_set(F.struct("hi", "lo")).alias("gone")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text that is left, per row.

    Edge cases: a NULL or empty text is one empty line; rows of one doc_id are
    one document, whatever their texts; a NULL doc_id is one document of its
    own and never the largest; repeated rows each get their row; a line that
    occurs several times in a text goes or stays as a whole; an empty table
    gives an empty result; only doc_id and text are read, so further columns
    cannot clash.
    """
    facts = cut_lineage(line_facts(docs, min_chars))
    frequent = cut_lineage(frequent_lines(facts, min_docs))
    gone = dropped_lines(facts, frequent).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone")
    text = as_bytes("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_key") == F.col("g_key")), "left")

    def run(batches):
        for b in batches:
            sizes, dropped, left = [], [], []
            for text, lost in zip(blobs(b.column(1)), b.column(2).to_pylist()):
                if not lost:
                    sizes.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    left.append(text)
                    continue
                away = {(d["hi"], d["lo"]) for d in lost}
                lines = text.split(b"\n")
                hashes = [None if h is None else (int.from_bytes(h[:8], "little", signed=True),
                                                  int.from_bytes(h[8:], "little", signed=True))
                          for h in line_hashes(text, min_chars)]
                stay = [x for x, h in zip(lines, hashes) if h not in away]
                sizes.append(len(lines))
                dropped.append(len(lines) - len(stay))
                left.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array([x.decode("utf-8", "replace") for x in left], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "gone").mapInArrow(
        run, f"doc_id {kind}, n_lines long, n_dropped long, text string")
