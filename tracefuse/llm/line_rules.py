"""Quality rules with cross-document line frequency.

Base rules look at one text.  The method's rule looks at the corpus: every line
is normalised (A-Z lower-cased, figures to 0, words joined by one space) and
hashed; for each host (``source``) and line the distinct documents that have it
are counted; lines above the limit are removed, and a document that loses too
much of itself is rejected.

Copies of one document are not many documents: rows of a host with equal texts
count once, however many there are.  Texts that differ anywhere are different
documents, so template pages with a word of their own count one by one.

Texts are read once; the narrow per-document rows (counts and 8-byte line
hashes) are written to the checkpoint folder and everything else derives from
them.  A line's rows are made distinct by (host, line, text) before they are
counted, so a line in a third of all documents is one partial count a task.
Where the verdict goes back to the rows, lines with more than 1/``HOT_LINES`` of
all rows (at most ``HOT_LINES`` of them) are broadcast and the others, of which
none is large, are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes, blobs
from tracefuse.session import cut_lineage

MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30
#: a line is frequent above this many distinct documents of its host, however large the host
LINE_MIN_DOCS = 10
#: a document is depleted when fewer than this percentage of its words is left
MIN_LEFT_PERCENT = 20
#: a line is hot when it has more than this fraction (one in so many) of all rows
HOT_LINES = 10_000

SYMBOLS = re.compile(rb"[#*$%&|<>]")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def repeat_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words covered by windows of ``window`` words that occur twice or more, the first included."""
    n = len(words)
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    width, groups = 1, None
    while width < window:  # exact ranks of windows of 2, 4, 8 words by doubling
        pair = rank[:-width] * n + rank[width:]
        _, rank, groups = np.unique(pair, return_inverse=True, return_counts=True)
        if len(groups) == len(rank):
            return 0
        width *= 2
    often = (groups[rank] > 1).astype(np.int64)
    cover = np.zeros(n + 1, np.int64)
    cover[:len(often)] += often
    cover[window:window + len(often)] -= often
    return int((np.cumsum(cover)[:n] > 0).sum())


def line_key(line_words: list[bytes]) -> int:
    """First eight bytes of the MD5 of a normalised line, as an unsigned number."""
    norm = b" ".join(line_words).lower().translate(_DIGITS)
    return int.from_bytes(hashlib.md5(norm).digest()[:8], "big")


def measure(text: bytes) -> tuple:
    """Counts of one text, its distinct lines' keys and their word counts over all occurrences."""
    words = text.split()
    word_chars = len(b"".join(words).decode("utf-8", "replace"))
    n_dup, seen, counts = 0, set(), {}
    for line in text.split(b"\n"):
        lw = line.split()
        if not lw:
            continue
        if line in seen:
            n_dup += 1
        seen.add(line)
        k = line_key(lw)
        counts[k] = counts.get(k, 0) + len(lw)
    return (len(words), word_chars, len(SYMBOLS.findall(text)), n_dup, repeat_words(words),
            list(counts), list(counts.values()))


_SCHEMA = ("doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, "
           "n_dup_lines long, n_repeat_words long, keys array<long>, sizes array<long>")


def _signed(values: list[int]) -> list[int]:
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _measure_batches(batches):
    for b in batches:
        rows = [measure(t) for t in blobs(b.column(3))]
        arrays = [b.column(0), b.column(1), b.column(2)]
        arrays += [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        arrays += [pa.array([_signed(r[i]) for r in rows], pa.list_(pa.int64())) for i in (5, 6)]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SCHEMA.split(", ")])


def frequent_lines(facts: DataFrame, min_docs: int = LINE_MIN_DOCS) -> DataFrame:
    """(host, line, docs): lines in more than ``min_docs`` distinct texts of a host."""
    each = facts.select("host", "text_key", F.explode("keys").alias("line")).distinct()
    return each.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") > min_docs)


def judge(docs: DataFrame) -> DataFrame:
    """Measures and verdict per row: doc_id, host, text_key, counts, removed_words, removed_keys, base_failed, kept.

    ``removed_keys`` are the hashes of the document's own lines above the limit.

    Edge cases: NULL and blank texts have no words and fail the base rule; a
    NULL source is a host of its own; equal texts of a host count once;
    repeated rows each get the same verdict; an empty table gives an empty
    result; only doc_id, text and source are read.
    """
    text = as_bytes("text")
    facts = cut_lineage(docs.select("doc_id", F.col("source").alias("host"),
                                    F.xxhash64(text).alias("text_key"), text.alias("text"))
                        .mapInArrow(_measure_batches, _SCHEMA)
                        .withColumn("row_no", F.monotonically_increasing_id()))
    frequent = cut_lineage(frequent_lines(facts).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "docs"))
    lines = facts.select("row_no", "host", F.inline(F.arrays_zip("keys", "sizes"))).withColumnsRenamed(
        {"keys": "line", "sizes": "words"})
    total = facts.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    is_hot = F.col("docs") * HOT_LINES > total
    same = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line"))
    hot = F.broadcast(frequent.filter(is_hot))  # at most HOT_LINES rows: their documents add up to no more than all rows
    lost = lines.join(hot, same, "left_semi").unionByName(
        lines.join(hot, same, "left_anti").join(frequent.filter(~is_hot), same, "left_semi"))
    removed = lost.groupBy("row_no").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_keys"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = (facts.drop("keys", "sizes").join(removed, "row_no", "left")
           .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
           .withColumn("base_failed", base_failed))
    depleted = 100 * (F.col("n_words") - F.col("removed_words")) < MIN_LEFT_PERCENT * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row_no")


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by position, so that no column clashes with the operator's own; the new names."""
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _same_row(at: dict[str, str]):
    return (F.col(at["doc_id"]).eqNullSafe(F.col("v_id")) & F.col(at["source"]).eqNullSafe(F.col("v_host"))
            & (F.xxhash64(as_bytes(at["text"])) == F.col("v_key")))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep; columns are those of ``docs``, whatever their names.

    Edge cases as in :func:`judge`; a rejected row's copies (same id, source and text) go with it.
    """
    bad = judge(docs).filter(~F.col("kept")).select(
        F.col("doc_id").alias("v_id"), F.col("host").alias("v_host"), F.col("text_key").alias("v_key")).distinct()
    plain, at = _numbered(docs)
    return plain.join(bad, _same_row(at), "left_anti").toDF(*docs.columns)


def strip_lines(docs: DataFrame) -> DataFrame:
    """Kept rows of ``docs`` without their lines above the limit (blank lines stay); same columns, whatever their names.

    Where a text loses lines, a long or int column ``n_chars`` gets its new length.

    Edge cases as in :func:`judge`: NULL and blank texts are rejected, repeated
    rows stay or go together, an empty table gives an empty result.
    """
    good = cut_lineage(judge(docs).filter("kept").select(
        F.col("doc_id").alias("v_id"), F.col("host").alias("v_host"), F.col("text_key").alias("v_key"),
        F.array_sort("removed_keys").alias("v_gone")).distinct())
    names = docs.columns
    plain, at_name = _numbered(docs)
    plain_names = plain.columns
    joined = plain.join(good, _same_row(at_name), "inner").select(
        *plain.columns, F.coalesce("v_gone", F.array().cast("array<long>")).alias("v_gone"))
    at = names.index("text")
    sized = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None

    def run(batches):
        for b in batches:
            out, sizes = [], b.column(sized).to_pylist() if sized is not None else []
            for i, (text, keys) in enumerate(zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                if text and keys:
                    gone = set(keys)
                    text = "\n".join(x for x in text.split("\n") if not (w := x.encode().split())
                                     or _signed([line_key(w)])[0] not in gone)
                    sizes[i:i + 1] = [len(text)] * len(sizes[i:i + 1])
                out.append(text)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(out, b.column(at).type)
            if sized is not None:
                columns[sized] = pa.array(sizes, b.column(sized).type)
            yield pa.RecordBatch.from_arrays(columns, plain_names)

    return joined.mapInArrow(run, plain.schema).toDF(*names)
