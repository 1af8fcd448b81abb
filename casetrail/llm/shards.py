"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split on another bit.

All work is DataFrame operations on keys, hashes and sizes; texts are not moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm import base

LIMIT = 1 << 20
#: Bits of the content hash; further bits tell identical rows apart.
CONTENT_BITS, ROW_BITS = 60, 32
#: Bits a round of counting looks at beyond those an even spread would need.
AHEAD = 6


def _bits(number: Column, width: int) -> Column:
    return F.lpad(F.bin(number), width, "0")


def hash_bits(key: str, text: str) -> Column:
    """Bits of md5(key and text), then bits of the row's place, which only identical rows ever need."""
    content = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    number = F.conv(F.substring(content, 1, CONTENT_BITS // 4), 16, 10).cast("long")
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << ROW_BITS))
    return F.concat(_bits(number, CONTENT_BITS), _bits(row, ROW_BITS))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory: ``shard`` (bit prefix, '' for one bucket), ``depth, shard_bytes, shard_rows``.

    ``rows`` has ``bits`` and ``bytes``. A round counts buckets at one depth, sums them up to all prefixes above and
    takes the shortest that fit; rows of buckets still over the limit go on to deeper bits. A single row is a leaf
    whatever its size.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    most = CONTENT_BITS + ROW_BITS
    low, high = 0, min(most, max(1, math.ceil(math.log2(max(1, total / limit)))) + AHEAD)
    leaves, left = None, rows.select("bits", "bytes")
    while True:
        cells = left.groupBy(F.substring("bits", 1, high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = base.store(cells, "cells")
        above = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "bytes", "n")
        buckets = above.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        buckets = base.store(buckets, "buckets")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") >= most)
        whole = buckets.where(fits)
        over = buckets.where(~fits).select("depth", "shard")
        # A leaf is a bucket that fits under a parent that does not.
        under = over.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
        parent = F.expr("substring(shard, 1, depth - 1)")
        found = whole.where(F.col("depth") > low).withColumn("parent", parent).join(under, ["depth", "parent"], "left_semi").drop("parent")
        found = found.unionByName(whole.where(F.col("depth") == low)).select("shard", "depth", "shard_bytes", "shard_rows")
        leaves = found if leaves is None else leaves.unionByName(found)
        deep = over.where(F.col("depth") == high).select(F.col("shard").alias("cell"))
        if high >= most or not deep.limit(1).count():
            return base.store(leaves, "directory")
        left = base.store(left.withColumn("cell", F.substring("bits", 1, high)).join(deep, "cell", "left_semi").drop("cell"), "oversized")
        # Buckets at this depth did not fit, so the next round starts one bit deeper.
        low, high = high + 1, min(most, high + 1 + AHEAD)


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_bytes`` (UTF-8 bytes of the text, null is 0), ``shard`` (bit prefix), ``depth, shard_bytes, shard_rows``.

    No shard holds more than ``limit`` bytes unless it is a single row. Rows with equal key and text differ in the bits
    of their place, so even these split. An empty table gives no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("id"), hash_bits(key, text).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    rows = base.store(rows, "hashed")
    leaves = directory(rows, limit)
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most one per bit
    # The leaf above a row is found through the depths that occur: one equal-key join on the candidate prefixes.
    prefixes = F.array(*[F.expr(f"substring(bits, 1, {d})") for d in depths]).cast("array<string>")
    placed = rows.select("id", "bytes", F.explode(prefixes).alias("shard")).join(leaves, "shard")
    return placed.select(F.col("id").alias(key), F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows")


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet, one folder per shard (``shard=b`` and its bits); needs keys that name one row."""
    shard = assign(docs, limit, key, text).select(key, F.concat(F.lit("b"), "shard").alias("shard"))
    docs.join(shard, key).repartition(F.col("shard")).write.partitionBy("shard").parquet(path)
