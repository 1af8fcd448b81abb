"""Writing results and named intermediates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from casetrail.session import cut_lineage
from casetrail.sources.readers import path_exists, read_positional


def save_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a result folder as parquet, csv (with header) or json."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def convert_all(spark: SparkSession, source: str, target: str, schemas: Mapping[str, Sequence[str]]) -> list[str]:
    """Convert every extract that exists (CSV) to parquet under its contract's names; returns the names converted."""
    done = []
    for name, columns in schemas.items():
        path = f"{source.rstrip('/')}/{name}.csv"
        if path_exists(spark, path):
            save_results(read_positional(spark, path, columns), f"{target.rstrip('/')}/{name}.parquet")
            done.append(name)
    return done


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Named intermediate: computed once into reliable storage and registered as a temporary view."""
    stored = cut_lineage(df)
    stored.createOrReplaceTempView(name)
    return stored
