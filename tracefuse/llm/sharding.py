"""Rendezvous (highest-random-weight) sharding of stable record keys over weighted shards.

Every (key, shard) pair gets a uniform number u from the first 52 bits of
``md5(key ':' shard)`` and the key goes to the shard with the smallest
``-ln(u) / weight``.  A key's numbers for the old shards do not change when a
shard is added, so rows only move into the new shard, and an expected share of
weight/total weight of them.  Slots number a shard's rows without gaps from
zero by an exact distributed rank (range blocks with offsets), never by one
task per shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefuse.llm.common import as_bytes
from tracefuse.operators.ranking import global_rank

HASH_DIGITS = 13


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a text key; ties go to the smaller shard, NULL counts as ''."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    draws = [F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}")).cast("binary")), 1, HASH_DIGITS), 16, 10)
             .cast("long") for i in range(len(weights))]
    if len(set(weights)) == 1:
        # equal weights: the smallest -ln(u) is the largest u, compared as exact integers
        costs = [-d for d in draws]
    else:
        unit = float(1 << (4 * HASH_DIGITS))
        costs = [-F.log((d + F.lit(0.5)) / F.lit(unit)) / F.lit(float(w)) for d, w in zip(draws, weights)]
    picks = [F.struct(c.alias("cost"), F.lit(i).alias("shard")) for i, c in enumerate(costs)]
    return F.array_min(F.array(*picks))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row.

    ``weights`` has one entry a shard; ``grown_weights`` (default: one more
    shard of the last weight) gives ``grown_shard``.

    Edge cases: a NULL doc_id is the key ''; a NULL text has size 1 and CRC 0;
    repeated rows share their shard and get slots of their own; an empty table
    gives an empty result; only ``doc_id`` and ``text`` are read.
    """
    grown = list(grown_weights) if grown_weights is not None else [*weights, weights[-1]]
    text = as_bytes("text")
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
        F.monotonically_increasing_id().alias("tie"))
    ranked = global_rank(placed, ["shard"], ["doc_id", "text_crc32", "size", "tie"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
