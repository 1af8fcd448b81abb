"""Shared small parts: row keys, stored intermediates, partition counts, packed arrays, merged spans."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casetrail.session import checkpoint_folder

LEAST = -(2**63)
BLOCK_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def one_key(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows with a column that names each of them: ``key`` itself, or where it repeats or is null a number in its order."""
    if not docs.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).limit(1).count():
        return docs, key
    name = "row_in_order"
    while name in docs.columns:
        name += "_"
    return store(docs.orderBy(key).withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``doc`` (key as an order, null first), ``alt`` (0, or a hash of the text where keys repeat), ``text`` (never null).

    Rows with equal key and equal text count as one document; rows that share only the key are ordered by ``alt``.
    """
    texts = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    repeated = docs.groupBy(F.col(key)).count().where("count > 1").limit(1).count() > 0
    alt = F.xxhash64(texts) if repeated else F.lit(0).cast("long")
    return docs.select(F.col(key), order.alias("doc"), alt.alias("alt"), texts.alias("text"))


#: Folders that ``store`` has written in this process; results that are still to be computed read them.
WRITTEN: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts the lineage, survives lost executors, computed once."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored intermediates once nothing reads them any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in WRITTEN:
            WRITTEN.remove(path)


def partitions(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Shuffle partitions for work on the texts of ``df``: the session's number, more where the tables below are larger."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < 2**60)  # local data has no estimate
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / block_bytes))


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def unpack(column: pa.Array, kind: type) -> np.ndarray:
    """All arrays packed in a binary column, end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans per owner: overlapping and touching spans become one. Owners are numbers from 0."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order].astype(np.int64), end[order].astype(np.int64)
    # Shift each owner's places past those of the owner before, so that one running maximum serves all.
    width = int(end.max()) + 2
    reach = np.maximum.accumulate(end + owner * width)
    new = np.ones(len(owner), bool)
    new[1:] = (start + owner * width)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(owner)) - 1
    return owner[head], start[head], reach[last] - owner[last] * width


def spans_by_document(spans: DataFrame) -> DataFrame:
    """One row per document with its spans (``doc, alt, start, end``); as many as a document has, no more."""
    return spans.groupBy("doc", "alt").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, how: str = "left") -> DataFrame:
    """Documents with their spans; the texts are shuffled once, the spans build the hash side."""
    return docs.join(spans_by_document(spans).hint("shuffle_hash"), ["doc", "alt"], how)


def list_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and end of a list<struct<start, end>> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    owner = np.asarray(pc.list_parent_indices(column), np.int64)
    flat = column.flatten()
    return owner, np.asarray(flat.field("start"), np.int64), np.asarray(flat.field("end"), np.int64)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that batches of long texts stay small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ordered_pair(c: str) -> Column:
    return F.struct(F.col("doc"), F.col("alt"), F.col(c))
