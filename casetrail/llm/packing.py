"""Conflict-constrained best-fit packing of documents into sequences of fixed length.

Documents are cut into pieces of at most the capacity; pieces are dealt into blocks by hash, and each block is packed
by itself, largest piece first. Open bins are kept in order of residual room and carry a bitmap of their sources and
one of their duplicate clusters. From the tightest bin with enough room the search goes on to the next one until a bin
without conflict is found; a new bin opens if there is none. No piece is ever dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

CAPACITY = 2048
#: Pieces of a block: bounds a task's memory; more input makes more blocks.
BLOCK = 4000
_OUT = "block int, bin int, key {0}, piece int, first_word long, n_words long, fill long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin of each item; items are taken in the given order. Sources and clusters are small numbers, -1 for none.

    No bin gets two items of one source or of one cluster. Of the bins that take an item, the one with the least
    residual room does, and of equal ones the oldest.
    """
    bins: list[int] = []
    rooms: list[tuple[int, int]] = []  # residual room and bin, in order
    held: list[list[int]] = []  # bitmaps of sources and clusters
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms):
            maps = held[rooms[at][1]]
            if not (maps[0] & source_bit or maps[1] & cluster_bit):
                break
            at += 1
        if at == len(rooms):
            room, number = capacity, len(held)
            held.append([0, 0])
        else:
            room, number = rooms.pop(at)
        held[number][0] |= source_bit
        held[number][1] |= cluster_bit
        if room > size:
            insort(rooms, (room - size, number))
        bins.append(number)
    return bins


def _numbers(column: pa.ChunkedArray, shared_only: bool = False) -> list[int]:
    """Small numbers for equal values, -1 for null; with shared_only also -1 for values that stand alone."""
    values = column.to_pylist()
    count = Counter(values)
    number: dict = {None: -1}
    for v in values:
        if v not in number:
            number[v] = -1 if shared_only and count[v] == 1 else len(number)
    return [number[v] for v in values]


def _pack(capacity: int):
    def pack(block: pa.Table) -> pa.Table:
        block = block.sort_by([("n_words", "descending"), ("order", "ascending"), ("piece", "ascending"), ("tie", "ascending")])
        sizes = block["n_words"].to_numpy()
        bins = np.array(best_fit(sizes.tolist(), _numbers(block["source"]), _numbers(block["cluster"], True), capacity), np.int64)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return pa.table({"block": block["block"], "bin": pa.array(bins, pa.int32()), "key": block["key"], "piece": block["piece"],
                         "first_word": block["first_word"], "n_words": block["n_words"], "fill": pa.array(fill, pa.int64())})
    return pack


def word_count(text: str) -> Column:
    """Number of words, runs of other characters than space and 0x09-0x0D."""
    found = F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", -1)
    return (F.size(found) - (F.element_at(found, 1) == "").cast("int") - ((F.size(found) > 1) & (F.element_at(found, -1) == "")).cast("int")).cast("long")


def same_words(text: str) -> Column:
    """Cluster of texts with equal words, whatever the case and the space between; null for texts without words."""
    plain = F.trim(F.regexp_replace(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(plain != "", F.xxhash64(plain))


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source",
         cluster: Column | None = None, block_rows: int = BLOCK) -> DataFrame:
    """Per piece: ``block, bin`` (together one packed sequence), key, ``piece, first_word, n_words`` and ``fill`` of the bin.

    A document of up to ``capacity`` words is one piece, a longer one several full pieces and a rest; one without words
    is a piece of size 0, which takes no room. A null source or cluster conflicts with nothing. Without repeated keys,
    rows are packed alike whatever order they come in; identical rows share a cluster and so never share a bin. Empty tables give no rows.
    """
    count = word_count(text)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(base.LEAST)).alias("order"), F.col(source).cast("string").alias("source"),
                       (same_words(text) if cluster is None else cluster).cast("long").alias("cluster"), count.alias("total"), F.xxhash64(text).alias("tie"))
    last = F.greatest(F.ceil(F.col("total") / F.lit(capacity)).cast("int") - 1, F.lit(0))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * capacity
    pieces = pieces.select("key", "order", "source", "cluster", "tie", "piece", first.alias("first_word"), F.least(F.lit(capacity).cast("long"), F.col("total") - first).alias("n_words"))
    pieces = base.store(pieces, "pieces")
    blocks = max(1, -(-pieces.count() // block_rows))
    # Only rows alike in key, text and piece number land in one block whatever the number of blocks; the place spreads
    # them too where a key repeats. Without repeated keys the packing depends on the rows alone.
    repeated = docs.groupBy(key).count().where("count > 1").limit(1).count() > 0
    spot = F.xxhash64("order", "piece", "tie", *([F.monotonically_increasing_id()] if repeated else []))
    dealt = pieces.withColumn("block", F.pmod(spot, F.lit(blocks)).cast("int"))
    kind = dict(docs.dtypes)[key]
    out = dealt.groupBy("block").applyInArrow(_pack(capacity), _OUT.format(kind))
    return out.withColumnRenamed("key", key)
