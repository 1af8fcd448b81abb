"""Positional reads, optional tables, conversion and discovery of extract files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetrail.functions import fixed
from casetrail.functions.scalars import normalize_id, number


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _is_csv(path: str) -> bool:
    lowered = path.rstrip("/").lower()
    if lowered.endswith((".parquet", ".pq")):
        return False
    if lowered.endswith(".csv"):
        return True
    raise ValueError(f"unsupported file extension in {path!r}; expected .parquet, .pq or .csv")


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def first_row(spark: SparkSession, path: str) -> list[str]:
    """Cells of a CSV file's first row (one row is read), without a byte order mark."""
    row = spark.read.csv(path, header=False).limit(1).first()
    cells = ["" if v is None else str(v).strip() for v in row] if row else []
    if cells:
        cells[0] = cells[0].lstrip("﻿")
    return cells


def normalize_ids(df: DataFrame, columns: Sequence[str] = fixed.ID_COLUMNS) -> DataFrame:
    """Id columns as trimmed text without the trailing zeros of a float round trip."""
    return df.withColumns({c: normalize_id(F.col(c)) for c in columns if c in df.columns})


def read_positional(spark: SparkSession, path: str, names: Sequence[str], ids: Sequence[str] = fixed.ID_COLUMNS) -> DataFrame:
    """Table whose column order is the contract: names come from ``names``, never from the file.

    CSV may have a header or not (told by its first cell); all its columns are text. A width other than expected raises.
    """
    names = list(names)
    if _is_csv(path):
        cells = first_row(spark, path)
        if len(cells) != len(names):
            raise ValueError(f"{path}: expected {len(names)} columns, got {len(cells)}")
        has_header = cells[0] == names[0]
        df = spark.read.schema(_text_schema(names)).csv(path, header=has_header, enforceSchema=True, escape='"')
        if not has_header:
            df = df.withColumn(names[0], F.regexp_replace(names[0], "^﻿", ""))
    else:
        df = spark.read.parquet(path)
        if len(df.columns) != len(names):
            raise ValueError(f"{path}: expected {len(names)} columns, got {len(df.columns)}")
        df = df.toDF(*names)
    return normalize_ids(df, ids)


def read_optional(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Table, or an empty one of that shape when the path does not exist."""
    if path_exists(spark, path):
        return read_positional(spark, path, names)
    return spark.createDataFrame([], _text_schema(names))


def load_cohort(spark: SparkSession, path: str) -> DataFrame:
    """Saved cohort: headerless UTF-8 CSV with CRLF rows and perhaps a byte order mark; any bad row fails the read."""
    schema = T.StructType([
        T.StructField("LogID", T.StringType()), T.StructField("EncounterCSN", T.DecimalType(18, 0)),
        T.StructField("PAT_ID", T.StringType()), T.StructField("SurgeryDate", T.DateType()),
        T.StructField("SurgeryYear", T.IntegerType()), T.StructField("PrimaryCPT", T.StringType()),
        T.StructField("AgeYears", T.DecimalType(5, 2))])
    df = spark.read.schema(schema).csv(path, header=False, encoding="UTF-8", lineSep="\r\n", mode="FAILFAST")
    return df.withColumn("LogID", F.regexp_replace("LogID", "^﻿", ""))


def read_comorbidities(spark: SparkSession, path: str) -> DataFrame:
    """Side file in its 19- or 20-column form, with or without header; counts as integers, an absent column as 0."""
    cells = first_row(spark, path)
    names = fixed.COMORBIDITY_COLUMNS if len(cells) >= 20 else fixed.COMORBIDITY_COLUMNS[:19]
    has_header = cells[0].upper() == "LOGID"
    df = spark.read.schema(_text_schema(names)).csv(path, header=has_header, enforceSchema=True)
    df = df.withColumn("LogID", normalize_id(F.regexp_replace("LogID", "^﻿", "")))
    counts = {c: F.coalesce(number(F.col(c)).cast("int"), F.lit(0)) for c in names[1:]}
    return df.withColumns(counts | {c: F.lit(0) for c in fixed.COMORBIDITY_COLUMNS if c not in names})


def rename_present(df: DataFrame, names: Mapping[str, str] = fixed.REGISTRY_NAMES) -> DataFrame:
    """Rename columns that are there and leave the rest."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def version_table(spark: SparkSession, path: str) -> DataFrame:
    """Versioned unit lookup (id, name, type, bucket, start, end) from a CSV with header."""
    return spark.read.schema("Clarity_ID bigint, Unit_Name string, UnitType string, GNNUnitType string, "
                             "StartDate date, EndDate date").csv(path, header=True)


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small literal table given in code; meant for lookups of at most a few hundred rows."""
    return spark.createDataFrame(list(rows), schema)


def discover(spark: SparkSession, folder: str, names: Sequence[str], required: Sequence[str]) -> DataFrame:
    """First CSV of a folder that names the required columns in its header or, without one, has the positional width."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.csv")
    statuses = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    for path in sorted(s.getPath().toString() for s in (statuses or [])):
        cells = first_row(spark, path)
        if cells and cells[0] == names[0]:
            if set(required) <= set(cells):
                found = spark.read.schema(_text_schema(cells)).csv(path, header=True, enforceSchema=True)
                return normalize_ids(found.select(*required))
        elif len(cells) == len(names):
            return normalize_ids(read_positional(spark, path, names).select(*required))
    raise FileNotFoundError(f"no CSV with columns {list(required)} in {folder}")
