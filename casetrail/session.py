"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the library relies on: UTC clocks, zone-less parquet timestamps read as instants, AQE."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none (tests) gets a folder of its own under the temporary folder; a cluster
    must name one, as executors would otherwise write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/casetrail-{spark.sparkContext.applicationId}"


#: With this setting the files of a plan's shuffles go when it has run; a plan that runs again writes them again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Plans made inside run once: their shuffle files do not stay until the session's garbage is collected. A Spark without this
    setting keeps them as before."""
    if not spark.conf.isModifiable(_CLEANUP):
        yield
        return
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def run_once(df: DataFrame) -> DataFrame:
    """The same rows by a plan of its own that is meant to run once and then leaves no shuffle files."""
    with _cleaned_up(df.sparkSession):
        return df.select("*")  # the setting counts when the plan is made


def stored(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder as Parquet and read back: as ``cut_lineage``, for many rows, as columns take less disk."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    with _cleaned_up(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: a lost executor costs one re-read and not the whole iteration."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return run_once(df).checkpoint(eager=True)


def spread(df: DataFrame, split_bytes: int = 128 * 1024 * 1024) -> DataFrame:
    """Deal the rows of a small input over all cores.

    Input too small to give every core a split (a few small files) would leave cores idle during costly per-row work.
    The planner's size estimate decides, nothing runs for it; larger input passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * split_bytes else df


def in_parts(df: DataFrame, key: str, part_bytes: int = 4 * 1024 * 1024) -> DataFrame:
    """Shuffle rows by a key into parts of about ``part_bytes`` of source files, so that a task's share does not grow with the input.

    For rows read from a source, as the planner's size estimate decides (columnar files hold a row in a few bytes);
    the session's number of parts is the least.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(least, min(-(-estimate // part_bytes), 10_000)), key)
